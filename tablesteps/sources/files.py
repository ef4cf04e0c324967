"""File listing, object-store URIs and dispatch by extension.

Object stores are read in place through Hadoop file systems (``s3a://``,
``abfss://``, ``gs://``): no download to a machine-local temp file.
Credentials and region are Hadoop settings of the session.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def s3_uri(bucket: str, key: str = "") -> str:
    return f"s3a://{bucket}/{key.lstrip('/')}"


def azure_uri(account: str, container: str, path: str = "") -> str:
    return f"abfss://{container}@{account}.dfs.core.windows.net/{path.lstrip('/')}"


def gcs_uri(bucket: str, key: str = "") -> str:
    return f"gs://{bucket}/{key.lstrip('/')}"


def object_store_settings(kind: str, **settings: str) -> dict[str, str]:
    """Hadoop keys for credentials / region; apply with ``apply_settings``."""
    kind = kind.lower()
    if kind == "s3":
        keys = {
            "access_key": "fs.s3a.access.key",
            "secret_key": "fs.s3a.secret.key",
            "region": "fs.s3a.endpoint.region",
            "endpoint": "fs.s3a.endpoint",
        }
    elif kind == "azure":
        account = settings.get("account", "")
        keys = {"account_key": f"fs.azure.account.key.{account}.dfs.core.windows.net"}
    elif kind == "gcs":
        keys = {"project": "fs.gs.project.id", "keyfile": "google.cloud.auth.service.account.json.keyfile"}
    else:
        raise ValueError("kind must be s3, azure or gcs")
    return {keys[k]: v for k, v in settings.items() if k in keys}


def apply_settings(spark: SparkSession, settings: Mapping[str, str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in settings.items():
        conf.set(k, v)


def first_file(spark: SparkSession, path: str) -> str | None:
    """The first non-empty data file under ``path`` (a file, a directory or a
    glob) by name; one row reaches the driver, however many files there are."""
    found = list_objects(spark, path).filter("length > 0").agg(F.min("path")).first()
    return found[0] if found else None


def list_objects(spark: SparkSession, prefix: str) -> DataFrame:
    """S26 listing: path, length, modification time (contents not read)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(prefix)
        .select("path", "length", "modificationTime")
    )


def read_text_object(spark: SparkSession, uri: str) -> DataFrame:
    """S26 ReadText: one row per object with its whole text."""
    return spark.read.text(uri, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


# File extensions and the reader they select.
EXTENSIONS = {
    ".csv": "csv",
    ".txt": "csv",
    ".json": "json",
    ".jsonl": "jsonl",
}


def kind_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"Unsupported file type: {ext or path}")
    return EXTENSIONS[ext]


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by extension."""
    kind = kind_of(path)
    if kind == "csv":
        from tablesteps.sources.csv import read_csv

        return read_csv(spark, path, **options)
    if kind == "json":
        from tablesteps.sources.json import read_json

        return read_json(spark, path, **options)
    from tablesteps.sources.json import read_json_lines

    return read_json_lines(spark, path, **options)
