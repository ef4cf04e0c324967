"""CSV corner cases (FIXTURES §2), delimiter detection, writer options."""

import datetime as dt
import os

import pytest

from pyspark.sql import types as T

from tablesteps.sinks.files import write_csv
from tablesteps.sources.csv import detect_delimiter, read_csv


def put(folder, name, text):
    p = os.path.join(folder, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return p


def test_quotes_newlines_blank_lines_short_long_rows(spark, tmpdir_shared):
    p = put(
        tmpdir_shared,
        "a.csv",
        'a,b,c\n"x, ""y""",2,3\n\n   \n"l1\nl2",5,6\n1\n7,8,9,10\n',
    )
    df = read_csv(spark, p, auto_convert=False, multi_line=True)
    got = [tuple(r) for r in df.collect()]
    assert ('x, "y"', "2", "3") in got
    assert ("l1\nl2", "5", "6") in got
    assert ("7", "8", "9") in got
    assert len(got) == 4  # blank and white-space lines skipped


def test_short_row_nulls_when_converting(spark, tmpdir_shared):
    p = put(tmpdir_shared, "s.csv", "a,b,c\n1\n2,3,4\n")
    df = read_csv(spark, p)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1, None, None), (2, 3, 4)]


def test_trimming_and_no_header(spark, tmpdir_shared):
    p = put(tmpdir_shared, "t.csv", ' x ," x "\n1,2\n')
    df = read_csv(spark, p, header=False, auto_convert=False)
    assert df.columns == ["Column0", "Column1"]
    assert [tuple(r) for r in df.collect()][0] == ("x", "x")


def test_duplicate_header_last_value_wins(spark, tmpdir_shared):
    p = put(tmpdir_shared, "d.csv", "a,A\n1,2\n")
    df = read_csv(spark, p)
    assert df.columns == ["a"]
    assert df.first()[0] == 2


def test_multi_char_delimiter(spark, tmpdir_shared):
    p = put(tmpdir_shared, "m.csv", "a||b\n1||2\n")
    df = read_csv(spark, p, delimiter="||")
    assert df.columns == ["a", "b"] and tuple(df.first()) == (1, 2)


def test_inference(spark, tmpdir_shared):
    p = put(
        tmpdir_shared,
        "i.csv",
        "i,big,d,b,t,mixed,e\n1,3000000000,1.5,true,2024-01-15,1,\n007,1,1.5e3,False,2024/01/15,x,\n-5,2,2.0,TRUE,2024-01-16,2,\n",
    )
    df = read_csv(spark, p)
    types = {f.name: f.dataType for f in df.schema.fields}
    assert isinstance(types["i"], T.IntegerType)
    assert isinstance(types["big"], T.StringType)
    assert isinstance(types["d"], T.DoubleType)
    assert isinstance(types["b"], T.BooleanType)
    assert isinstance(types["t"], T.TimestampNTZType)
    assert isinstance(types["mixed"], T.StringType)
    rows = sorted(df.collect(), key=lambda r: r["i"])
    assert [r["i"] for r in rows] == [-5, 1, 7]
    assert rows[1]["t"] == dt.datetime(2024, 1, 15)
    assert rows[2]["d"] == 1500.0
    assert all(r["e"] is None for r in rows)


def test_bool_casing_makes_text(spark, tmpdir_shared):
    p = put(tmpdir_shared, "bc.csv", "b\ntrue\ntRue\n")
    assert isinstance(read_csv(spark, p).schema["b"].dataType, T.StringType)


def test_detect_delimiter(spark, tmpdir_shared):
    assert detect_delimiter(spark, put(tmpdir_shared, "x1.csv", "a;b;c\n1;2;3\n")) == ";"
    assert detect_delimiter(spark, put(tmpdir_shared, "x2.csv", "a\tb\n1\t2\n")) == "\t"
    assert detect_delimiter(spark, put(tmpdir_shared, "x3.csv", "a,b;c\n")) == ","  # tie keeps order
    assert detect_delimiter(spark, put(tmpdir_shared, "x4.csv", "abc\n")) == ","


def test_writer_formats(spark, tmpdir_shared):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 2, 3, 4, 5), True, None, 'a"b')], "ts timestamp_ntz, ok boolean, n string, s string"
    )
    out = os.path.join(tmpdir_shared, "w")
    write_csv(df, out)
    text = "".join(
        open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part-")
    )
    assert "2020-01-02 03:04:05,true,,\"a\"\"b\"" in text


def test_buffer_size_checked(spark, tmpdir_shared):
    import pytest

    p = put(tmpdir_shared, "b.csv", "a\n1\n")
    assert read_csv(spark, p, buffer_size=1).count() == 1
    with pytest.raises(ValueError):
        read_csv(spark, p, buffer_size=0)


def test_user_schema_bad_cells_become_null(spark, tmpdir_shared):
    p = put(tmpdir_shared, "us.csv", "n,b\n1,true\nx,maybe\n")
    rows = sorted(read_csv(spark, p, schema={"n": "int", "b": "boolean"}).collect(), key=lambda r: str(r.n))
    assert [(r.n, r.b) for r in rows] == [(1, True), (None, None)]


def test_empty_first_file_and_appended_parts(spark, tmpdir_shared):
    from tablesteps.sinks.files import write_csv

    put(tmpdir_shared, "many/a.csv", "")
    put(tmpdir_shared, "many/b.csv", "x,y\n1,2\n")
    put(tmpdir_shared, "many/c.csv", "x,y\n3,4\n")
    folder = os.path.join(tmpdir_shared, "many")
    assert sorted(tuple(r) for r in read_csv(spark, folder).collect()) == [(1, 2), (3, 4)]
    out = os.path.join(tmpdir_shared, "appended")
    for part in (spark.range(0, 10), spark.range(10, 20)):
        write_csv(part.repartition(3), out, append=True)
    assert sorted(r.id for r in read_csv(spark, out).collect()) == list(range(20))


def test_other_header_order_is_refused(spark, tmpdir_shared):
    put(tmpdir_shared, "order/a.csv", "x,y\n1,2\n")
    put(tmpdir_shared, "order/b.csv", "y,x\n1,2\n")
    with pytest.raises(Exception):
        read_csv(spark, os.path.join(tmpdir_shared, "order")).collect()


# ------------------------------------------------- quoted newlines in splits
def _cells(text):
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text, newline="")))
    return rows[0], rows[1:]


def _random_csv(seed, n=150, end="\n"):
    import random

    rng = random.Random(seed)
    bits = ["a", "b,c", 'say ""hi""', "line\nbreak", "two\r\nkinds", "\n\n", "é語", "", "x" * 40, '""', "\n,\n"]
    rows = ["id,text,more"]
    for i in range(n):
        cells = ['"' + "".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) + '"' for _ in range(2)]
        if rng.random() < 0.3:
            cells[rng.randrange(2)] = "plain"
        if rng.random() < 0.02:
            cells[0] = '"' + "long\n" * 700 + '"'  # longer than a split
        rows.append(f"{i}," + ",".join(cells))
    return end.join(rows) + rng.choice(["", end])


@pytest.mark.parametrize("seed, split, end", [(1, 1500, "\n"), (2, 3000, "\r\n"), (3, 1 << 20, "\n")])
def test_quoted_newlines_in_splits_of_any_size(spark, tmpdir_shared, seed, split, end):
    wanted = []
    for k in range(2):
        text = _random_csv(10 * seed + k, end=end)
        with open(f"{tmpdir_shared}/f{k}.csv", "w", newline="", encoding="utf-8") as f:
            f.write("\ufeff" * k + text)
        wanted += _cells(text)[1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = read_csv(spark, tmpdir_shared, trim=False, auto_convert=False)
        got = sorted([r.id, r.text, r.more] for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.columns == ["id", "text", "more"]
    assert got == sorted(wanted)


def test_quoted_newlines_by_default_equal_the_whole_file_reader(spark, tmpdir_shared):
    path = f"{tmpdir_shared}/one.csv"
    with open(path, "w", newline="") as f:
        f.write('a,a,\n1,"x\ny",2\n\n  \n3,"p ""q""\n",4,extra\n5\n6,"open\nto the end')
    default, whole = read_csv(spark, path), read_csv(spark, path, multi_line=True)
    assert default.schema == whole.schema
    assert sorted(map(repr, default.collect())) == sorted(map(repr, whole.collect()))
    assert ("p \"q\"") in {r[0] for r in default.collect()}


def test_quoted_newlines_with_another_header_fail(spark, tmpdir_shared):
    for name, head in (("a", "x,y"), ("b", "y,x")):
        with open(f"{tmpdir_shared}/{name}.csv", "w") as f:
            f.write(f'{head}\n1,"l1\nl2"\n')
    with pytest.raises(Exception, match="header differs"):
        read_csv(spark, tmpdir_shared).collect()
    rows = read_csv(spark, tmpdir_shared, header=False, auto_convert=False).collect()
    assert sorted(map(tuple, rows)) == [("1", "l1\nl2"), ("1", "l1\nl2"), ("x", "y"), ("y", "x")]


def test_files_without_quoted_newlines_stay_with_the_native_reader(spark, tmpdir_shared):
    path = f"{tmpdir_shared}/plain.csv"
    with open(path, "w") as f:
        f.write('a,b\n1,"x, ""y"""\n2,z\n')
    df = read_csv(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and sorted(map(tuple, df.collect())) == [(1, 'x, "y"'), (2, "z")]


def test_cells_with_and_without_white_space_at_their_ends(spark):
    """Cells that begin and end visibly are taken as they are; every other end is searched."""
    from pyspark.sql import functions as F

    from tablesteps.sources.csv import WHITESPACE, trimmed

    ends = ["", "a", "~", "!", "\x7f", "\x00", "\x1c", "é", "\U0001f600", *WHITESPACE]
    cells = [x + m + y for x in ends for y in ends for m in ("", "b c", "　")]
    df = spark.createDataFrame([(c,) for c in [*cells, None]], "c string")
    got = df.select("c", trimmed(F.col("c")).alias("t"), F.btrim("c", F.lit(WHITESPACE)).alias("w")).collect()
    assert all(r.t == r.w == (r.c and r.c.strip(WHITESPACE)) for r in got)


def test_types_of_a_wide_table_are_found_cell_by_cell(spark):
    """The checks stand once in the plan, however many columns there are."""
    from tablesteps.functions import typed

    cells = {"int": ["1", "-20", None], "double": ["1", "2.5", None], "boolean": ["true", "False", None], "string": [None, None, None],
             "timestamp_ntz": ["2024-01-02", "1/2/2024", None]}
    names = [f"{k}.{i}" for i in range(40) for k in cells]
    df = spark.createDataFrame([[cells[n.split(".")[0]][r] for n in names] for r in range(3)], ", ".join(f"`{n}` string" for n in names))
    seen, kept = [], typed.cell_kind
    typed.cell_kind = lambda *a: seen.append(a) or kept(*a)
    try:
        assert typed.infer_types(df) == {n: n.split(".")[0] for n in names}
    finally:
        typed.cell_kind = kept
    assert len(seen) == 1
    assert typed.infer_types(df.limit(0)) == dict.fromkeys(names, "string")
