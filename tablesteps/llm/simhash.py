"""SimHash near-duplicates with multi-index hashing.

A fingerprint is cut into ``SEGMENTS`` equal segments.  Two fingerprints
within ``max_bits`` differ in some segment by at most
``max_bits // SEGMENTS`` bits, so it is enough to enumerate that small
Hamming ball around each segment, fetch the table entries of every
member, and verify the complete distance.  Copies share a fingerprint and
stand for one table entry, so a group of copies never multiplies pairs.

Links between fingerprints become groups by ``components``.

Defined results: null and empty texts (and texts of white space) have the
fingerprint 0, which links like any other; texts of fewer words than a
shingle are one shingle; rows with equal text share a fingerprint.  A null
id is never a group's id unless the group has no other: it sorts last and
then reads null.  Ids are whole numbers; text that is no number fails the job.

Bound: each fingerprint probes with 66 keys, and a probe meets about N / 2^32
others by chance: fine to some 10^9 documents, about 150 candidates a
fingerprint at 10^10.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import map_text, quoted, saved, texts_of
from .components import component_ids

#: Words in a shingle and the largest distance of linked fingerprints.
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Segments of 32 bits: buckets stay small up to billions of fingerprints.
SEGMENTS = 2
#: Seed of the shingle hash (fixed by the contract).
SEED = 42
#: Shingles whose bits are counted at a time.
HASH_ROWS = 1 << 17
#: Stands for a null id inside the operator.
NO_ID = (1 << 63) - 1


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    ends = ends[width - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(begins), HASH_ROWS):
        cut = map(slice, begins[at : at + HASH_ROWS].tolist(), ends[at : at + HASH_ROWS].tolist())
        hashes = map(xxhash.xxh64_digest, map(flat.__getitem__, cut), repeat(SEED))
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8)).reshape(-1, 64)
        for part in range(0, len(bits), 255):  # sums of 255 fit a byte
            ones += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (the 64 bits as a signed long)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        values = np.array([fingerprint(t, width) for t in texts_of(texts)], dtype=np.uint64)
        return [pa.array(values.view(np.int64))]

    return map_text(docs, text_col, keep, [StructField("fingerprint", LongType())], lambda: run)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def segment(value: Column, number: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, number * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def near_pairs(table: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct fingerprints at most ``max_bits`` apart, each once.

    ``table`` has one row per distinct ``fingerprint``.
    """
    bits = 64 // segments
    radius = max_bits // segments
    value = F.col("fingerprint")

    def tagged(masks: list[int], seg: Column, tag: Column) -> Column:
        return F.transform(F.lit(masks).cast("array<long>"), lambda m: seg.bitwiseXOR(m) + tag)

    def keyed(masks: list[int]) -> Column:
        """Segment keys with the segment's number above them."""
        each = []
        for n in range(segments):
            seg = segment(value, n, bits)
            tag = F.lit(n).cast("long") * F.lit(1 << bits).cast("long")
            each.append(tagged(masks, seg, tag))
        return F.concat(*each)

    probes = table.select(value.alias("a"), F.explode(keyed(ball(bits, radius))).alias("key"))
    entries = table.select(value.alias("b"), F.explode(keyed([0])).alias("key"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    # A pair that several segments find is taken from the first of them only.
    number = F.shiftrightunsigned("key", bits)
    first = F.lit(True)
    for n in range(segments - 1):
        first = first & ((number <= n) | (F.bit_count(segment(apart, n, bits)) > radius))
    return (
        probes.join(entries, "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= max_bits) & first)
        .select("a", "b")
    )


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable."""
    spark = docs.sparkSession
    prints = saved(spark, fingerprints(docs, [id_col], text_col, width).toDF("id", "fingerprint"), "simhash-prints")
    known = F.coalesce(F.col("id"), F.lit(NO_ID))
    table = saved(spark, prints.groupBy("fingerprint").agg(F.min(known).alias("node")), "simhash-table")
    pairs = saved(spark, near_pairs(table, max_bits), "simhash-pairs")
    groups = component_ids(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))  # by fingerprint
    # The group's id is the smallest document id of its fingerprints.
    named = table.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("component", "fingerprint")
    )
    roots = named.groupBy("root").agg(F.min("node").alias("component_id"))
    labels = named.join(roots, "root").select("fingerprint", "component_id")
    out = prints.join(labels, "fingerprint").select(
        "id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )
    return out.toDF(id_col, "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; all columns as they were.

    Rows that repeat the kept id all stay: they are the same document.
    """
    groups = near_groups(docs, id_col, text_col, **options).toDF("i", "print", "root")
    kept = groups.filter(F.col("i").eqNullSafe(F.col("root"))).select("i").distinct()
    inner = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])
    own = F.col(f"c{docs.columns.index(id_col)}")
    return inner.join(kept, own.eqNullSafe(F.col("i")), "left_semi").toDF(*docs.columns)
