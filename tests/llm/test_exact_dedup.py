import hashlib
import random
import re
from collections import defaultdict

import pytest

from tablesteps.llm import exact_dedup as X

from .helpers import corpus, docs, odd_docs


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    out = []
    for d, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((d, keep, len(groups[bare]), d == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, **options):
    out = X.exact_groups(df, **options).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out), key=repr)


def test_against_brute_force(spark):
    rows = corpus(11) + [(900 + i, "same  text") for i in range(40)] + [(950, "same text "), (None, "sametext"), (None, "only null")]
    assert run(docs(spark, rows)) == brute(rows)


def test_splits_and_overflow_pages(spark):
    rows = [(i, f"text {i % 60}") for i in range(300)] + [(1000 + i, "hot") for i in range(100)]
    assert run(docs(spark, rows), bucket_rows=7, max_depth=5) == brute(rows)
    entries = docs(spark, rows).selectExpr("xxhash64(text) AS key")
    index = X.directory(spark, entries, bucket_rows=7, max_depth=5)
    counts = {r.p: r["count"] for r in entries.groupBy(X.prefix_of(5).alias("p")).count().collect()}
    rows_held = -(-2 * 400 // 32)
    assert [prefix for prefix, _, _ in index] == list(range(32))
    for bucket in {b for _, b, _ in index}:
        own = [(p, pages) for p, b, pages in index if b == bucket]
        n = sum(counts.get(p, 0) for p, _ in own)
        assert n <= rows_held or len(own) == 1 and own[0][1] == -(-n // rows_held)  # a range of prefixes, split while overfull
    assert any(pages > 1 for _, _, pages in index)


def test_whole_directory_in_one_bucket(spark):
    rows = [(1, "a"), (2, "b")]
    assert run(docs(spark, rows), max_depth=3) == brute(rows)


def test_directory_grows_by_doubling():
    assert X.grown([1, 1, 1, 1], 4, 2) == [0, 0, 0, 0]
    assert X.grown([3, 0, 1, 1], 2, 2) == [0, 1, 2, 2]  # the left half splits twice, the right half never
    assert X.grown([0, 0, 0, 0, 0, 0, 9, 0], 1, 3) == [0, 0, 0, 0, 4, 4, 6, 7]
    rng = random.Random(3)
    for _ in range(50):
        counts = [rng.choice([0, 0, 1, 2, 9]) for _ in range(32)]
        firsts = X.grown(counts, 4, 5)
        for first in set(firsts):
            own = [p for p, f in enumerate(firsts) if f == first]
            span = len(own)
            assert own == list(range(first, first + span)) and span & (span - 1) == 0 and first % span == 0
            assert span == 1 or sum(counts[first:first + span]) <= 4
            parent = first - first % (2 * span)
            assert span == 32 or sum(counts[parent:parent + 2 * span]) > 4  # no split without need


def index_of(spark, rows, buckets, max_depth=5):
    entries = docs(spark, rows).selectExpr("doc_id AS id", "xxhash64(text) AS key", "sha2(text, 256) AS tag", "length(text) AS chars")
    return entries, X.index_table(spark, entries, buckets or X.directory(spark, entries, 7, max_depth), max_depth)


def test_owner_tasks_read_their_buckets_only(spark):
    rows = [(i, f"text {i % 200}") for i in range(400)]
    entries, index = index_of(spark, rows, None)
    where = index.selectExpr("bucket", "key", "spark_partition_id() AS task", "input_file_name() AS file").distinct().collect()
    tasks = {b: {(r.task, r.file) for r in where if r.bucket == b} for b in {r.bucket for r in where}}
    assert len(tasks) > 10 and all(len(t) == 1 for t in tasks.values())  # a bucket has one file and one task
    assert len({t for ts in tasks.values() for t in ts}) > 5
    plan = X.owned_chains(index.filter("pages = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # chained where the files lie
    # Another directory, other owners: with one bucket all keys are one task's.
    _, one = index_of(spark, rows, [(p, 0, 1) for p in range(32)])
    assert one.selectExpr("spark_partition_id()").distinct().count() == 1


def test_a_wrong_directory_gives_wrong_groups(spark, monkeypatch):
    rows = [(i, f"text {i % 200}") for i in range(400)]
    right = X.directory
    monkeypatch.setattr(X, "directory", lambda *a: [r for r in right(*a) if r[0] != 3])
    assert len(run(docs(spark, rows), bucket_rows=7, max_depth=5)) < 400  # keys that it does not name are lost
    monkeypatch.setattr(X, "directory", lambda *a: [(p, b, 1 + p % 2) for p, b, _ in right(*a)])
    assert run(docs(spark, rows), bucket_rows=7, max_depth=5) == brute(rows)  # pages that need not be are merged


def test_different_bytes_under_one_key_and_tag_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(X.F, "sha2", lambda c, n: X.F.lit("same tag"))
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: X.F.lit(5).cast("long"))
    with pytest.raises(ValueError):
        X.exact_groups(docs(spark, [(1, "a"), (2, "b")]))


def test_empty_table_and_odd_columns(spark):
    assert run(docs(spark, [])) == []
    df = odd_docs(spark, [(5, "x y"), (3, "xy"), (4, None), (6, ""), (5, "x y")])
    kept = X.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r["a.b"]) for r in kept.collect()) == [(4, 2), (5, 0), (5, 4)]


def test_no_python_in_the_plan(spark):
    plan = X.exact_groups(docs(spark, corpus(1, 20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_like_inner_ones_pass_through(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    df = df.selectExpr("*", "7 AS __id", "8 AS i", "9 AS c0", "10 AS kept", "11 AS `a.b`")
    kept = X.drop_copies(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(2, "a  b", 7, 8, 9, 10, 11), (3, "c", 7, 8, 9, 10, 11)]
