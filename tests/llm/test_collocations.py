import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablesteps.llm import collocations as C

KIND = "doc_id long, text string, lang string"


def brute(rows, max_words=4, min_count=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    most = Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = (lang, p[i : i + k])
                most[key] = max(most[key], a)
    by_lang = {}
    for (lang, p), a in cand.items():
        if 100 * most[lang, p] >= 80 * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))
        )
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in by_lang.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def texts(seed, n, small=8):
    """Repeated phrases (also within themselves), every separator, nulls, a language that is null or "und", one long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(small)] + ["Éa", "the", "THE", " x", "語", "a b"]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) for _ in range(12)]
    gaps = [" ", " ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r\n", "\x0b", "\x0c", "!?", ": ", ";"]
    rows = [(0, None, "en"), (1, "", None), (2, " .\t. ", "xx"), (3, "one", "yy")]

    def prose(m):
        return "".join(rng.choice([rng.choice(words), rng.choice(phrases), "la la la la la"]) + rng.choice(gaps) for _ in range(m))

    for i in range(4, n):
        rows.append((i, prose(rng.randint(1, 40)), rng.choice(["en", "en", "en", "de", None, "und"])))
    rows.append((n, prose(4000), "de"))
    return [*rows, rows[7], rows[7]]


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"min_count": 4, "top": 25}), (3, {"max_words": 2}), (4, {"max_words": 3, "min_count": 1})])
def test_collocations_against_brute_force(spark, seed, options):
    rows = texts(seed, 160)
    want = brute(rows, **options)
    assert len(want) > 20
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert result(C.collocations(df, **options)) == want


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], KIND)
    assert C.collocations(none).collect() == []
    rows = texts(6, 60)
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS a", "2 AS n", "3 AS prefix", "4 AS `x.y`", "5 AS phrase")
    assert result(C.collocations(df)) == brute(rows)
    assert C.collocations(spark.createDataFrame([(1, None, None)] * 40, KIND)).collect() == []


def test_flushes_in_the_middle_change_nothing(monkeypatch):
    """Tasks that send their stripes often give the same sums."""
    rows = texts(8, 80)

    def counts(size, bitmap):
        counter, out = C.Counter(size, bitmap, bitmap, True, 1000), Counter()
        batches = [b for _, text, lang in rows for b in counter.add((lang or "und").encode(), (text or "").encode())]
        for b in [*batches, *counter.stripes(), *counter.bucket_rows()]:
            for r in b.to_pylist():
                if r["lang"] == C.BUCKETS:
                    m, data = r["n"][0], r["next"][0]
                    for place, n in zip(np.frombuffer(data, "<u2", m).tolist(), data[2 * m :]):
                            out[r["bundle"], place] += n
                    continue
                prefixes = [p for p, size in zip(r["prefix"], r["size"]) for _ in range(size)]
                for prefix, word, n in zip(prefixes, r["next"], r["n"], strict=True):
                    out[r["lang"], prefix, r["bundle"], word] += n
        return out, len(batches)

    every = np.full(1 << (C.FILTER_BITS - 3), 255, dtype=np.uint8)
    once = [counts(k, every) for k in range(4)]
    for name, small in (("CHUNK_WORDS", 50), ("TASK_WORDS", 9), ("TASK_ENTRIES", 40), ("TASK_BUCKETS", 70)):
        monkeypatch.setattr(C, name, small)
    for (want, _), (got, sent) in zip(once, (counts(k, every) for k in range(4))):
        cut = {key for key, n in want.items() if len(key) == 2 and n >= 255}  # one row counts 255 at most
        assert sent > 5 and {k: n for k, n in got.items() if k not in cut} == {k: n for k, n in want.items() if k not in cut}
        assert all(got[key] >= 255 for key in cut)


def test_bitmap_lets_no_kept_phrase_out(spark):
    phrases = [f"p{i} q{i % 7}" for i in range(5000)]
    df = spark.createDataFrame([(b"en", p.encode()) for p in phrases], "lang binary, phrase binary").repartition(4)
    bitmap = np.frombuffer(C.bitmap_of(df), dtype=np.uint8)
    words = C.Words(b"en", [(b"", b"")], [0])
    at = np.array([[words[w.encode()] for w in p.split()] for p in phrases])
    hashes = np.array(words.hashes, dtype=np.uint64)
    assert C.in_bitmap(bitmap, C.phrase_bits(hashes[at.reshape(-1)], 2)[::2]).all()
    assert not C.in_bitmap(bitmap, C.phrase_bits(hashes[at[:, ::-1].reshape(-1)], 2)[::2]).mean() > 0.01


def test_buckets_of_all_rows_are_summed():
    rng = np.random.default_rng(3)
    sums, want, rows = C.BucketSums(30), np.zeros((3, C.ROW_BUCKETS), dtype=int), []
    for piece in range(3):
        for _ in range(20):
            place = np.unique(rng.integers(0, C.ROW_BUCKETS, 20_000)).astype("<u2")
            times = rng.integers(1, 4, len(place)).astype(np.uint8)
            want[piece, place] += times
            rows.append({"bundle": piece, "next": [place.tobytes() + times.tobytes()], "n": [len(place)]})
    table = pa.Table.from_pylist(rows, pa.schema({"bundle": pa.int32(), "next": pa.list_(pa.binary()), "n": pa.list_(pa.int64())}))
    out = [*sums.add(table.slice(0, 33)), *sums.add(table.slice(33)), *sums.closed()]
    for piece, row in enumerate(r for b in out for r in b.to_pylist()):
        bits = np.unpackbits(np.frombuffer(row["next"][0], dtype=np.uint8), bitorder="little")
        assert row["total"] == piece and (bits == (want[piece] >= 30)).all() and 0 < bits.sum() < len(bits)


def test_bad_parameters_are_refused(spark):
    df = spark.createDataFrame([], KIND)
    for options in ({"max_words": 1}, {"max_words": 9}, {"min_count": 0}, {"top": 0}):
        with pytest.raises(ValueError):
            C.collocations(df, **options)
