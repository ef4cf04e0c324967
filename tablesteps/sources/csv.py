"""Delimited text.

Defaults follow the reference: header row, ``,``, UTF-8, trimmed cells,
automatic type conversion.  The parse itself is Spark's CSV reader:

* every column is read as text, positionally, so duplicate or blank
  header names cannot be renamed by the reader; names come from the
  first file's header line, untrimmed; for a duplicated name the last
  column's value wins at the first position;
* every file's header must match the first non-empty file's (the read
  fails otherwise instead of mixing columns up);
* quoted delimiters and doubled quotes are handled; short rows get nulls,
  extra cells are dropped;
* blank and white-space-only lines are dropped;
* conversion runs the inference pass of ``functions.typed`` over all
  rows (one aggregate job), unless a schema is given.

Large files are split across tasks, also where cells hold newlines: see
``sources.quoted_records``.  One scan counts quotes; files in which every line
has an even number of them go to Spark's reader as they are.
``multi_line=True`` leaves it all to Spark's reader, one task per file (for
records that end in a lone carriage return, and encodings other than UTF-8);
``multi_line=False`` skips the scan, for files known to hold no such cell.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.functions.typed import apply_types, infer_types
from tablesteps.sources.files import first_file
from tablesteps.sources.quoted_records import quoted_records

# Reference defaults and delimiter detection.
DEFAULT_DELIMITER = ","
DEFAULT_BUFFER_SIZE = 65_536
DETECT_CANDIDATES = (",", ";", "\t", "|")
DETECT_LINES = 5
NO_HEADER_PREFIX = "Column"
# Fixed value: the Unicode White_Space characters trimmed from cells.
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(cell: Column) -> Column:
    """The cell without white space at its ends; one that begins and ends with a visible ASCII sign is not searched."""
    plain = (cell >= "!") & (cell < "\x7f") & F.substring(cell, -1, 1).between("!", "~")
    return F.when(plain, cell).otherwise(F.btrim(cell, F.lit(WHITESPACE)))


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """The candidate seen most often in the first 5 lines; ties keep
    the order ``, ; \\t |``; nothing readable -> ``,``."""
    first = first_file(spark, path)
    if first is None:
        return DEFAULT_DELIMITER
    try:
        lines = [r[0] for r in spark.read.option("encoding", encoding).text(first).limit(DETECT_LINES).collect()]
    except Exception:  # noqa: BLE001 - unreadable file: fall back as the reference does
        return DEFAULT_DELIMITER
    if not lines:
        return DEFAULT_DELIMITER
    counts = [(sum(ln.count(d) for ln in lines), -i, d) for i, d in enumerate(DETECT_CANDIDATES)]
    return max(counts)[2]


def _header(spark: SparkSession, path: str, delimiter: str, quote: str, encoding: str) -> list[str]:
    file = first_file(spark, path)
    if file is None:
        return []
    first = (
        spark.read.options(sep=delimiter, quote=quote, escape=quote, encoding=encoding, header="false")
        .option("multiLine", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(file)
        .limit(1)
        .collect()
    )
    if not first:
        return []
    return ["" if v is None else v for v in first[0]]


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = DEFAULT_DELIMITER,
    header: bool = True,
    encoding: str = "utf-8",
    trim: bool = True,
    auto_convert: bool = True,
    quote: str = '"',
    schema: Mapping[str, str] | None = None,
    multi_line: bool | None = None,
    buffer_size: int = DEFAULT_BUFFER_SIZE,
) -> DataFrame:
    """S1/S2 (see the module docstring).  ``buffer_size`` is accepted for
    compatibility and checked, but Hadoop's readers do their own buffering."""
    if buffer_size <= 0:
        raise ValueError("buffer size must be greater than zero")
    if delimiter is None:
        delimiter = detect_delimiter(spark, path, encoding)
    if not delimiter:
        raise ValueError("delimiter must not be empty")
    if header:
        names = _header(spark, path, delimiter, quote, encoding)
        width = len(names)
    else:
        probe = spark.read.options(sep=delimiter, quote=quote, escape=quote, encoding=encoding).csv(path)
        width = len(probe.columns)
        names = [f"{NO_HEADER_PREFIX}{i}" for i in range(width)]
    if not width:
        return spark.createDataFrame([], T.StructType([]))
    # Plain distinct names are checked against every file's header by Spark's reader.
    plain = header and len({n.lower() for n in names}) == width and all(n.strip() for n in names)
    fields = names if plain else [f"_c{i}" for i in range(width)]
    positional = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    records = None
    if multi_line is None and quote and encoding.lower().replace("-", "") == "utf8":
        records = quoted_records(spark, path, quote)
    elif multi_line is None:
        multi_line = True
    raw = _parsed(records, names if header else None, width, delimiter, quote) if records is not None else (
        spark.read.schema(positional)
        .options(sep=delimiter, quote=quote, escape=quote, encoding=encoding)
        .option("header", "true" if header else "false")
        .option("enforceSchema", "false" if plain else "true")
        .option("multiLine", "true" if multi_line else "false")
        .option("mode", "PERMISSIVE")
        .csv(path)
        .toDF(*[f"_c{i}" for i in range(width)])
    )
    cells = [F.col(f"_c{i}") for i in range(width)]
    if trim:
        cells = [trimmed(c) for c in cells]
    # blank / white-space-only line: first cell blank, the rest missing
    blank = F.coalesce(cells[0], F.lit("")) == ""
    for c in cells[1:]:
        blank = blank & c.isNull()
    if not trim:
        blank = F.btrim(F.coalesce(cells[0], F.lit("")), F.lit(WHITESPACE)) == ""
        for c in cells[1:]:
            blank = blank & c.isNull()
    # duplicate names (case-insensitive): last value wins at the first position
    out_names: list[str] = []
    out_cols = []
    for name, c in zip(names, cells):
        pos = next((i for i, n in enumerate(out_names) if n.lower() == name.lower()), None)
        if pos is None:
            out_names.append(name)
            out_cols.append(c)
        else:
            out_cols[pos] = c
    df = raw.filter(~blank).select(*[c.alias(n) for c, n in zip(out_cols, out_names)])
    if not auto_convert:
        return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in out_names])
    # empty text converts to null
    df = df.select(*[F.when(F.col(f"`{n}`") == "", None).otherwise(F.col(f"`{n}`")).alias(n) for n in out_names])
    types = dict(schema) if schema is not None else infer_types(df)
    return apply_types(df, types)


def _parsed(records: DataFrame, names: list[str] | None, width: int, delimiter: str, quote: str) -> DataFrame:
    """Records as text columns ``_c0`` ...; the first of each file must be the header ``names``, if there is one."""
    options = {"sep": delimiter, "quote": quote, "escape": quote, "multiLine": "true", "mode": "PERMISSIVE"}
    schema = ", ".join(f"_c{i} string" for i in range(width))
    parsed = records.select("first", "file", F.from_csv("record", schema, options).alias("r"))
    if names is not None:
        same = F.lit(True)
        for i, n in enumerate(names):
            same = same & (F.coalesce(F.col(f"r._c{i}"), F.lit("")) == n)
        told = F.concat(F.lit("header differs from that of the first file: "), F.col("file"))
        parsed = parsed.filter(~F.when(F.col("first") & ~same, F.raise_error(told).cast("boolean")).otherwise(F.col("first")))
    return parsed.select("r.*")


def read_csv_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = DEFAULT_DELIMITER, multi_line: bool = True,
    files_per_batch: int | None = None,
):
    """S3 async read as a file-drop stream: new files in ``path`` become
    micro-batches.  A stream needs its schema up front.  Dropped files are
    read whole, so newlines inside quotes are part of a cell;
    ``multi_line=False`` splits large files instead.  ``files_per_batch``
    bounds the files of a micro-batch.

    Cells are trimmed, blank lines dropped and texts converted as by
    ``read_csv`` (a cell that does not convert is null), and a file whose
    header names other columns than the schema, or in another order, fails
    the stream."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = spark.readStream.schema(T.StructType([T.StructField(n, T.StringType()) for n in wanted.names]))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    raw = (
        reader
        .options(sep=delimiter, header="true", quote='"', escape='"', enforceSchema="false")
        .option("multiLine", "true" if multi_line else "false")
        .csv(path)
    )
    cells = [trimmed(F.col(f"`{n}`")) for n in wanted.names]
    blank = F.coalesce(cells[0], F.lit("")) == ""
    for c in cells[1:]:
        blank = blank & c.isNull()
    texts = raw.filter(~blank).select(*[F.when(c != "", c).alias(n) for c, n in zip(cells, wanted.names)])
    return apply_types(texts, {f.name: f.dataType.simpleString() for f in wanted.fields})
