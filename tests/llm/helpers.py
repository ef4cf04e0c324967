"""Small fixtures shared by the tests of the training-data operators."""

import random

#: Columns whose names clash with names inside the operators.
ODD_COLUMNS = "doc_id long, text string, id long, t string, k0 string, f0 int, th string, key string, kind string, `a.b` int"

WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one".split()


def odd_docs(spark, rows):
    """Documents with extra columns of clashing names; the row's place fills them."""
    full = [(d, t, i, f"t{i}", f"k{i}", i, f"h{i}", f"y{i}", f"z{i}", i) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, ODD_COLUMNS)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(n))


def corpus(seed: int, n: int = 120) -> list[tuple]:
    """Random texts with nulls, empties, copies, near copies, shared lines, repeated rows and one long text."""
    rng = random.Random(seed)
    shared = [prose(rng, 6) for _ in range(4)]
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.05:
            text = None
        elif kind < 0.1:
            text = rng.choice(["", " ", "\n", " \t\n"])
        elif kind < 0.3 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.45 and rows:
            old = (rng.choice(rows)[1] or "x").split(" ")
            old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)
        else:
            text = "\n".join(prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            text = f"{text or ''}\n  {rng.choice(shared).upper()} \n"
        rows.append((i, text))
    rows.append((n, prose(rng, 30_000)))
    rows.append(rows[3])
    return rows
