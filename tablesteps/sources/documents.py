"""Document collections as DataFrames.

A collection is a DataFrame of documents (JSON Lines files, or any
table).  ``find`` applies the reference's find options in the server's
order: filter -> sort -> skip -> limit -> project.  Extended-JSON values
(``$oid``, ``$numberDecimal``, ``$date``) are mapped to string, string
and timestamp.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesteps.functions.names import named

from tablesteps.operators import rows as R
from tablesteps.operators.order import Key

# Extended-JSON wrappers and what they become.
EXTENDED_JSON = {"$oid": "string", "$numberDecimal": "string", "$date": "timestamp", "$numberLong": "bigint"}
ID_FIELD = "_id"


def _utc_wall_clock(instant):
    """An instant as its zone-less UTC wall-clock time, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def _unwrap(col, dtype: T.DataType):
    if isinstance(dtype, T.StructType):
        names = [f.name for f in dtype.fields]
        if len(names) == 1 and names[0] in EXTENDED_JSON:
            inner = col.getField(names[0])
            target = EXTENDED_JSON[names[0]]
            if target == "timestamp":
                return _utc_wall_clock(
                    F.coalesce(F.try_to_timestamp(inner.cast("string")), F.timestamp_millis(inner.try_cast("long")))
                )
            return inner.cast(target)
        whole = F.struct(*[_unwrap(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(col.isNotNull(), whole)  # a null sub-document stays null
    if isinstance(dtype, T.ArrayType):
        et = dtype.elementType
        if isinstance(et, (T.StructType, T.ArrayType)):
            return F.transform(col, lambda x: _unwrap(x, et))
    return col


def normalise(df: DataFrame) -> DataFrame:
    """Replace extended-JSON wrappers by plain values, at any depth."""
    return df.select(*[_unwrap(named(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a collection exported as JSON Lines (one document per line)."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return normalise(reader.json(path))


def find(
    coll: DataFrame,
    where: Mapping[str, object] | None = None,
    sort: tuple[str, int] | None = None,
    skip: int = 0,
    limit: int | None = None,
    project: Sequence[str] | None = None,
    id_fields: Sequence[str] = (ID_FIELD,),
) -> DataFrame:
    """S15 find: equality filter, one sort key (1 / -1), skip, limit, projection.

    ``where`` holds field -> value equalities (dotted fields reach into
    sub-documents).  Ties of the sort key are broken by ``id_fields`` so
    skip/limit are reproducible.  The projection drops ``_id`` unless it
    is listed.
    """
    df = coll
    for field, value in (where or {}).items():
        df = df.filter(F.col(field) == F.lit(value)) if value is not None else df.filter(F.col(field).isNull())
    order = []
    if sort is not None:
        order.append(Key(sort[0], sort[1] >= 0))
    order += [Key(f, True) for f in id_fields if f in df.columns]
    if limit is not None:
        df = R.page(df, skip, limit, order)
    elif skip:
        df = R.skip(df, skip, order)
    elif sort is not None:
        df = df.orderBy(*[k.column() for k in order])
    if project is not None:
        df = df.select(*[F.col(p).alias(p.split(".")[-1]) for p in project])
    return df


# ------------------------------------------------------------- connector
CONNECTOR_FORMAT = "mongodb"


def read_collection(
    spark: SparkSession,
    connection_uri: str,
    database: str,
    collection: str,
    pipeline: str | None = None,
) -> DataFrame:
    """S15/S16 against a live server through the document-store connector.

    ``pipeline`` (aggregation stages as JSON text) is handed to the server
    unchanged; there is no local interpreter for it.  Needs the connector
    jar on the classpath; without it Spark reports the missing format.
    """
    reader = (
        spark.read.format(CONNECTOR_FORMAT)
        .option("connection.uri", connection_uri)
        .option("database", database)
        .option("collection", collection)
    )
    if pipeline:
        reader = reader.option("aggregation.pipeline", pipeline)
    return normalise(reader.load())


def _wrap(col, dtype: T.DataType):
    """A value in extended JSON, at any depth."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        # zone-less UTC wall clock, formatted from its own text (no session-zone round trip)
        if isinstance(dtype, T.TimestampType):
            wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
        else:
            wall = col.cast("timestamp_ntz")
        iso = F.concat(F.regexp_replace(wall.cast("string"), " ", "T"), F.lit("Z"))
        return F.when(col.isNotNull(), F.struct(iso.alias("$date")))
    if isinstance(dtype, T.DecimalType):
        return F.when(col.isNotNull(), F.struct(col.cast("string").alias("$numberDecimal")))
    if isinstance(dtype, T.BinaryType):
        return F.base64(col)
    if isinstance(dtype, T.StructType):
        whole = F.struct(*[_wrap(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(col.isNotNull(), whole)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _wrap(x, dtype.elementType))
    return col


def to_extended_json(df: DataFrame) -> DataFrame:
    """One JSON document per row; timestamps as ``{"$date": ...}``,
    decimals as ``{"$numberDecimal": ...}``, binary as base64 text, inside
    sub-documents and arrays too."""
    cols = [_wrap(named(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(df: DataFrame, path: str, append: bool = False) -> None:
    """W14 insert-many into a collection export (JSON Lines, extended JSON).

    Replace-with-upsert by key is ``operators.upsert.upsert_replace``
    applied before the write; ``append=False`` is drop-collection-first.
    """
    to_extended_json(df).write.mode("append" if append else "overwrite").text(path)


def write_collection(df: DataFrame, connection_uri: str, database: str, collection: str, upsert_key: str | None = None, drop_first: bool = False) -> None:
    """W14 through the connector: insert, or replace-by-key when ``upsert_key``."""
    w = (
        df.write.format(CONNECTOR_FORMAT)
        .option("connection.uri", connection_uri)
        .option("database", database)
        .option("collection", collection)
    )
    if upsert_key:
        w = w.option("operationType", "replace").option("idFieldList", upsert_key).option("upsertDocument", "true")
    w.mode("overwrite" if drop_first else "append").save()


class DocumentQuery:
    """S15 find options as a fluent, immutable builder.

    As on the server: a later ``where`` replaces the earlier one, there is
    one sort key, and the options apply as filter -> sort -> skip ->
    limit -> project whatever order they were given in.
    """

    def __init__(self, where=None, sort=None, skip=0, limit=None, project=None, id_fields=(ID_FIELD,)):
        self._o = dict(where=where, sort=sort, skip=skip, limit=limit, project=project, id_fields=id_fields)

    def _with(self, **kw) -> "DocumentQuery":
        return DocumentQuery(**{**self._o, **kw})

    def where(self, field: str, value) -> "DocumentQuery":
        return self._with(where={field: value})

    def sort(self, field: str, direction: int = 1) -> "DocumentQuery":
        return self._with(sort=(field, direction))

    def skip(self, n: int) -> "DocumentQuery":
        if n < 0:
            raise ValueError("skip must be non-negative")
        return self._with(skip=n)

    def limit(self, n: int) -> "DocumentQuery":
        if n < 0:
            raise ValueError("limit must be non-negative")
        return self._with(limit=n)

    def project(self, *fields: str) -> "DocumentQuery":
        return self._with(project=list(fields))

    def run(self, coll: DataFrame) -> DataFrame:
        return find(coll, **self._o)
