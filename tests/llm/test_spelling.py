import random
import re
import zlib
from collections import Counter

import pytest

from tablesteps.llm import spelling as S

from .helpers import corpus, docs, odd_docs


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(n):
    forms, rows = {}, []
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            forms[w] = best
        rows.append((w, len(near)))
    out = []
    for w, n_near in rows:
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n[w], n_near, n[forms[w]] if w in forms else None))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def letters(seed, n):
    """Documents full of variants: few letters, lengths about the bound, accents, chains of forms, a very common word."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 10))) for _ in range(30)]
    rows = [(None, None), (1, ""), (2, "Ähnlich×÷Ähnlich ähnlich ähnlich")]
    for i in range(3, n):
        words = []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(base[: rng.choice([2, 5, 30])])
            if rng.random() < 0.2:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcé") + w[p:], w[:p] + rng.choice("abc") + w[p + 1 :]])
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(n, "z" * 5000 + " " + "z" * 5001)] * 2 + [rows[5]]
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"bucket_words": 1, "tile_words": 3}), (3, {"bucket_words": 64, "tile_words": 10})])
def test_variants_against_brute_force(spark, seed, options):
    rows = letters(seed, 260)
    want = brute(counted(rows))
    assert any(r[1] for r in want) and len({r[4] for r in want}) > 5
    assert result(S.spelling_variants(docs(spark, rows), **options)) == want


def test_prose_and_clashing_columns(spark):
    rows = corpus(7, 60) + letters(4, 40)
    df = odd_docs(spark, rows).withColumnsRenamed({"key": "word", "kind": "bucket", "th": "n"})
    assert result(S.spelling_variants(df)) == brute(counted(rows))


def test_chain_of_forms_leads_to_the_last(spark):
    rows = [(i, " ".join(["abcdefgh"] * 200)) for i in range(40)] + [(50 + i, "abcdefg " * 30) for i in range(10)] + [(99, "abcdef " + "abcdefgx " * 3)]
    want = {r[0]: r for r in brute(counted(rows))}
    assert want["abcdefgx"][2] == "abcdefgh"
    assert result(S.spelling_variants(docs(spark, rows))) == sorted(want.values(), key=repr)


def test_empty_table(spark):
    assert S.spelling_variants(docs(spark, [])).collect() == []
    assert S.spelling_variants(docs(spark, [(1, None), (2, "short")])).collect() == []


def test_index_holds_exactly_the_words_at_one_edit():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([7, 8]))) for _ in range(300)})
    index = S.PositionIndex(words, 7)
    import numpy as np

    found = set(zip(*(x.tolist() for x in index.one_edit(np.flatnonzero(index.same)))))
    assert found == {(i, j) for i, a in enumerate(words) if len(a) == 7 for j, b in enumerate(words) if one_edit(a, b)}
