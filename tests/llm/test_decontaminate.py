import random
import re

from tablesteps.llm import decontaminate as D

from .helpers import corpus, docs, odd_docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, tests, window=10):
    windows = {}
    for item, text in tests:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in rows:
        w, hit, items = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    items |= own
        out.append((d, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=repr)


def longest(rows, tests, window=10):
    best = {}
    for d, text in rows:
        w = words(text)
        for _, t in tests:
            q = words(t)
            for i in range(len(w)):
                for j in range(len(q)):
                    n = 0
                    while i + n < len(w) and j + n < len(q) and w[i + n] == q[j + n]:
                        n += 1
                    if n >= min(window, len(q)) and (n, -i) > best.get(d, (0, 1)):
                        best[d] = (n, -i)
    return {d: (n, -i) for d, (n, i) in best.items()}


def planted(seed):
    rng = random.Random(seed)
    tests = [(i, prose(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 25, 40]))) for i in range(25)]
    tests += [(90, None), (91, ""), (92, "?!"), (None, "null item has these words"), (5, tests[6][1])]
    rows = corpus(seed, 60)
    for i in range(40):
        text = words(rng.choice(tests)[1])
        a = rng.randint(0, 3)
        rows.append((500 + i, f"{prose(rng, rng.randint(0, 9))} {' '.join(text[a : a + rng.randint(1, 40)]).upper()}; {prose(rng, 4)}"))
    return rows, tests


def items_of(spark, tests):
    return spark.createDataFrame(tests, "item_id long, text string")


def run(found):
    out = found.select("doc_id", "n_words", D.n_hit().alias("n"), "items").collect()
    return sorted(((r.doc_id, r.n_words, r.n, tuple(sorted(r["items"]))) for r in out), key=repr)


def test_against_brute_force(spark):
    rows, tests = planted(5)
    assert run(D.find_matches(docs(spark, rows), items_of(spark, tests), ["doc_id"])) == brute(rows, tests)


def test_blocks_give_the_same(spark):
    rows, tests = planted(6)
    small = D.find_matches(docs(spark, rows), items_of(spark, tests), ["doc_id"], block_bytes=700)
    assert run(small) == brute(rows, tests)


def test_longest_match(spark):
    rows, tests = planted(7)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 2000]
    out = D.find_matches(docs(spark, rows), items_of(spark, tests), ["doc_id"]).collect()
    assert {r.doc_id: (r.longest, r.longest_at) for r in out if r.longest} == longest(rows, tests)


def test_same_word_everywhere(spark):
    rows = [(1, "a " * 3000), (2, "a a a a a a a a a"), (3, "b")]
    tests = [(1, "a " * 60), (2, "a a a")]
    assert run(D.find_matches(docs(spark, rows), items_of(spark, tests), ["doc_id"])) == brute(rows, tests)


def test_empty_tables_and_odd_columns(spark):
    none = items_of(spark, [])
    assert run(D.find_matches(docs(spark, [(1, "a b")]), none, ["doc_id"])) == [(1, 2, 0, ())]
    assert run(D.find_matches(docs(spark, []), items_of(spark, [(1, "a b")]), ["doc_id"])) == []
    df = odd_docs(spark, [(1, "x secret words y"), (2, None), (3, "clean"), (3, "clean")])
    clean = D.remove_contaminated(df, items_of(spark, [(1, "Secret, words")]))
    assert clean.columns == df.columns
    assert sorted((r.doc_id, r["a.b"]) for r in clean.collect()) == [(2, 1), (3, 2), (3, 3)]


def test_columns_named_like_inner_ones_pass_through(spark):
    words = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, f"x {words} y"), (2, "clean")], "doc_id long, text string")
    df = df.selectExpr("*", "7 AS __3", "8 AS f0", "9 AS c0", "10 AS items", "11 AS `a.b`")
    kept = D.remove_contaminated(df, spark.createDataFrame([(1, words)], "item_id long, text string"))
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 7, 8, 9, 10, 11)]
