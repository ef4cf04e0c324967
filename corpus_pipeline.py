"""A corpus pipeline of five stages over ``documents``.

Each stage works on what its predecessor kept, written as Parquet in
between.  All stages but the last return the columns of ``documents``:
language ID drops texts without an identified language, line dedup
shortens texts (and ``n_chars`` with them), SimHash near-dedup keeps the
smallest id of each group, decontamination drops documents that hold a
benchmark window, and SentencePiece adds the piece ids and whether they
decode to the text.

Nulls, empty tables, repeated rows and extra columns follow the operators'
definitions: a null or letterless text is not identified and goes in the
first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.llm import decontaminate, language_id, line_dedup, sentencepiece, simhash
from tablesteps.llm.common import saved
from tablesteps.llm.queries import PIECE_MODEL, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, chars_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``piece_ids``, their number, and whether decoding gives the text back."""
    back = sentencepiece.encode_and_decode(docs, PIECE_MODEL, docs.columns)
    inner = back.toDF(*[f"k{i}" for i in range(len(docs.columns))], "piece_ids", "decoded")
    text = F.coalesce(F.col(f"k{docs.columns.index('text')}"), F.lit(""))
    return inner.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)],
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        (F.col("decoded") == text).alias("decodes"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate_docs),
    ("sentencepiece", tokenize),
]

#: Classifier and tokenizer cannot be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
