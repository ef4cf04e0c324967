"""JSON arrays read in splits of any size, against the json module."""

import json
import random

import pytest

from tablesteps.sources.json_arrays import read_json_array

SCHEMA = "id long, t string, sub struct<a:array<long>, s:string>"


def document(seed, n, indent):
    rng = random.Random(seed)
    bits = ["}", "{", "]", "[", ",", '"', "\\", "é語", "x" * 30, "\\\\\"", "line", "\n", "\t", ""]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [{"id": i, "t": text(), "sub": {"a": [1, 2, i][: rng.randint(0, 3)], "s": text() * rng.choice([1, 1, 30])}} for i in range(n)]
    return rows, json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2))


@pytest.mark.parametrize("seed, split, indent", [(1, 400, None), (2, 900, 2), (3, 2500, None), (4, 1 << 20, 1)])
def test_array_in_splits(spark, tmpdir_shared, seed, split, indent):
    want = []
    for k in range(2):
        rows, text = document(10 * seed + k, 60, indent)
        want += [(r["id"], r["t"], r["sub"]["a"], r["sub"]["s"]) for r in rows]
        with open(f"{tmpdir_shared}/f{k}.json", "w", encoding="utf-8") as f:
            f.write("\ufeff" * k + text + "\n" * k)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = read_json_array(spark, tmpdir_shared, SCHEMA).select("id", "t", "sub.a", "sub.s").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_array_types_and_edges(spark, tmpdir_shared):
    def read(text, schema=None):
        import os
        import uuid

        path = f"{tmpdir_shared}/{uuid.uuid4().hex}.json"
        with open(path, "w") as f:
            f.write(text)
        return read_json_array(spark, path, schema)

    df = read(' [ {"a": 1, "b": [ {"c": "}"} ]} ,\n {"a": 2.5} ] ')
    assert df.dtypes == [("a", "double"), ("b", "array<struct<c:string>>")]
    assert sorted(r.a for r in df.collect()) == [1.0, 2.5]
    assert read("[]", "a int").collect() == [] and read("", "a int").collect() == [] and read(" [ ] ", "a int").collect() == []
    assert [r.a for r in read("[1, [2, 3], null]", "a int").collect()].count(None) >= 2
