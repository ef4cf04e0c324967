import re

import xxhash

from tablesteps.llm import components as C
from tablesteps.llm import simhash as S

from .helpers import corpus, docs, odd_docs


def print_of(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=2):
    prints = [(d, print_of(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, f in prints:
        for e, g in prints:
            if (f ^ g).bit_count() <= bits:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return sorted((d, f"{f:016x}", find(d)) for d, f in prints)


def run(df, **options):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_groups(df, **options).collect())


def test_against_brute_force(spark):
    rows = corpus(3)
    assert run(docs(spark, rows)) == brute(rows)


def test_pairs_are_complete_and_single(spark):
    base = [0x0123456789ABCDEF, 0xFFFFFFFF00000000, 0, (1 << 64) - 1]
    values = sorted({b ^ m ^ n for b in base for m in (0, 1, 1 << 31, 1 << 32, 1 << 63) for n in (0, 1 << 5, 1 << 40, 1 << 62)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    mask = (1 << 64) - 1
    for bits, segments in ((2, 2), (1, 2), (0, 2), (3, 4), (5, 4)):
        got = [(r.a, r.b) for r in S.near_pairs(table, bits, segments).collect()]
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= bits}
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = {(r.node, r.component) for r in C.component_ids(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (201, 200)}
    assert got == want
    assert C.component_ids(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty_table_null_id_and_odd_columns(spark):
    assert run(docs(spark, [])) == []
    rows = [(4, "one two three four"), (None, "one two three four"), (2, None), (9, " \n"), (4, "one two three four")]
    got = {(r.doc_id, r.component_id) for r in S.near_groups(docs(spark, rows)).collect()}
    assert got == {(4, 4), (None, 4), (2, 2), (9, 2)}
    df = odd_docs(spark, rows)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r["a.b"]) for r in kept.collect()) == [(2, 2), (4, 0), (4, 4)]


def test_columns_named_like_inner_ones_pass_through(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x y z")], "doc_id long, text string")
    df = df.selectExpr("*", "7 AS __id", "8 AS i", "9 AS c0", "10 AS root", "11 AS `a.b`")
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 7, 8, 9, 10, 11), (3, "x y z", 7, 8, 9, 10, 11)]
