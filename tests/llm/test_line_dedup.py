import hashlib

from tablesteps.llm import line_dedup as L
from tablesteps.llm.minimal_hash import MinimalHash

from .helpers import corpus, docs, odd_docs

BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    owners = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line).strip(BLANK)
            if len(key) >= 10:
                owners.setdefault(key, set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = owners.get(lower(line).strip(BLANK), set())
            if len(own) < 2 or min(own) == d:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    out = L.drop_repeated_lines(df, ["doc_id"]).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out), key=repr)


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(docs(spark, rows)) == brute(rows)


def test_many_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    rows = corpus(2, 80)
    lines = L.line_hashes(docs(spark, rows).selectExpr("coalesce(text, '') t", "doc_id did", "xxhash64(text) th"), 10)
    few = {(r.did, tuple(sorted(r.drop))) for r in L.repeated_lines(lines, probe_rows=3).collect()}
    one = {(r.did, tuple(sorted(r.drop))) for r in L.repeated_lines(lines).collect()}
    assert few == one and few


def test_null_id_sorts_last(spark):
    rows = [(None, "a shared long line"), (7, "a shared long line\nshort"), (None, "another line that null holds alone")]
    out = {(r.doc_id, r.kept) for r in L.drop_repeated_lines(docs(spark, rows), ["doc_id"]).collect()}
    assert out == {(None, ""), (7, "a shared long line\nshort"), (None, "another line that null holds alone")}


def test_empty_table_and_odd_columns(spark):
    assert run(docs(spark, [])) == []
    df = odd_docs(spark, [(2, "SAME long line here\nown two"), (1, " same long line here"), (3, None)])
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text, r.k0, r["a.b"]) for r in out.collect()} == {
        (1, " same long line here", "k1", 1), (2, "own two", "k0", 0), (3, None, "k2", 2),
    }


def test_minimal_hash_is_minimal_and_perfect():
    import numpy as np

    rng = np.random.default_rng(0)
    high, low = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    high[:50] = high[50]  # equal halves are told apart by the other
    h = MinimalHash.build(high, low)
    assert sorted(h.numbers(high, low).tolist()) == list(range(5000))
    again = MinimalHash(h.sizes, h.words)
    assert (again.numbers(high, low) == h.numbers(high, low)).all()
