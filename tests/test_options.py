"""Options that reach a reader or writer, tested without a server."""

import glob

from tablesteps.session import local_path, shared_dir
from tablesteps.sinks.files import write_csv
from tablesteps.sources import documents as D
from tablesteps.sources import jdbc as J
from tablesteps.sources.csv import read_csv


def test_quote_all_quotes_every_cell_and_header(spark, tmpdir_shared):
    df = spark.createDataFrame([(1, 'a "b"', None), (2, "c,d\ne", "x")], "n int, t string, u string").coalesce(1)
    for quoted, want in ((True, '"n","t","u"\n'), (False, "n,t,u\n")):
        out = f"{tmpdir_shared}/q{quoted}"
        write_csv(df, out, quote_all=quoted)
        [name] = glob.glob(f"{local_path(out)}/part-*.csv")
        with open(name, newline="") as f:
            text = f.read()
        assert text.startswith(want) and ('"2","c,d\ne","x"' in text) == quoted
        assert sorted(tuple(r) for r in read_csv(spark, out).collect()) == [(1, 'a "b"', None), (2, "c,d\ne", "x")]


class Recorder:
    """Stands for ``spark.read``: keeps the format and the options, and loads a given table."""

    def __init__(self, df):
        self.df, self.kind, self.options_set = df, None, {}
        self.read = self

    def format(self, kind):
        self.kind = kind
        return self

    def option(self, key, value):
        self.options_set[key] = value
        return self

    def options(self, **more):
        self.options_set.update(more)
        return self

    def load(self):
        return self.df


def test_stage_text_reaches_the_collection_reader_unchanged(spark):
    df = spark.createDataFrame([("1", 2)], "_id string, n int")
    stages = '[{"$match": {"n": {"$gt": 1}}}, {"$sort": {"n": -1}}]'
    seen = Recorder(df)
    assert D.read_collection(seen, "mongodb://host/", "shop", "orders", stages).columns == ["_id", "n"]
    assert seen.kind == "mongodb"
    assert seen.options_set == {
        "connection.uri": "mongodb://host/", "database": "shop", "collection": "orders", "aggregation.pipeline": stages
    }
    plain = Recorder(df)
    D.read_collection(plain, "mongodb://host/", "shop", "orders")
    assert "aggregation.pipeline" not in plain.options_set


def test_timeout_fetch_size_and_set_up_statement_reach_the_jdbc_reader(spark):
    seen = Recorder(spark.range(1))
    J.read_jdbc(
        seen, "jdbc:postgresql://host/db", query="SELECT * FROM f(:n)", params={"n": "it's"}, timeout=7, fetch_size=123,
        prepare_query="CALL fill(:n)", properties={"user": "u"},
    )
    told = seen.options_set
    assert seen.kind == "jdbc" and told["queryTimeout"] == "7" and told["fetchsize"] == "123" and told["user"] == "u"
    assert told["prepareQuery"] == "CALL fill('it''s')" and told["query"] == "SELECT * FROM f('it''s')"
    assert told["driver"] == "org.postgresql.Driver" and "dbtable" not in told


def test_fetch_size_and_timeout_against_an_embedded_database(spark):
    url = f"jdbc:derby:{local_path(shared_dir(spark, 'derby-options'))};create=true"
    J.execute_all(spark, url, ["CREATE TABLE T (N INT)", "INSERT INTO T VALUES 1, 2, 3, 4, 5"])
    got = J.read_jdbc(spark, url, query="SELECT N FROM T WHERE N > :least", params={"least": 2}, timeout=30, fetch_size=1)
    assert sorted(r[0] for r in got.collect()) == [3, 4, 5]
