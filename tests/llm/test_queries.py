import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from oracle_check import compare, duck  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from tablesteps.llm import queries as Q  # noqa: E402
from tablesteps.llm import sentencepiece  # noqa: E402

from .test_decontaminate import brute as contaminated  # noqa: E402
from .test_line_dedup import BLANK, lower  # noqa: E402
from .test_simhash import brute as near  # noqa: E402

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_each_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_sql(spark, name):
    ok, _, _, detail = compare(spark, duck(SF), name, Q.QUERIES[name], Q.ORACLE[name], SF)
    assert ok, detail


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_returns_every_row(spark, name):
    table = "pages" if name.startswith("op7_") else "documents"
    assert Q.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_pipeline_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    owners = {}
    for d, text in rows:
        for line in text.split("\n"):
            key = lower(line).strip(BLANK)
            if len(key) >= 10:
                owners.setdefault(key, set()).add(d)
    after = []
    for d, text in rows:
        own = [owners.get(lower(x).strip(BLANK), {d}) for x in text.split("\n")]
        after.append((d, "\n".join(x for x, o in zip(text.split("\n"), own) if len(o) < 2 or min(o) == d)))
    one = {d for d, _, root in near(after) if d == root}
    hit = {d for d, _, n, _ in contaminated(after, tests) if n}
    want = {d: t for d, t in after if d in one and d not in hit}
    out = {r.doc_id: r for r in P.run(spark, SMALL).collect()}
    assert {d: r.text for d, r in out.items()} == want
    assert all(r.decodes and r.n_chars == len(r.text) for r in out.values())
    encoder = sentencepiece.Encoder(sentencepiece.Pieces(Q.PIECE_MODEL))
    some = sorted(want)[:50]
    assert [out[d].piece_ids for d in some] == [x.tolist() for x in encoder.encode([want[d].encode() for d in some])]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "1 AS k0", "2 AS `a.b`", "'x' AS t")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).collect() == []
    nulls = docs.limit(3).selectExpr("doc_id", "cast(null as string) AS text", "cast(null as string) AS lang", "source", "n_chars")
    for _, stage in P.STAGES:
        stage(spark, nulls, SMALL).collect()
