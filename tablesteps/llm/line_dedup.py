"""Line dedup over a sharded minimal perfect hash.

1. Tasks hash the lines of their documents (128 bits, numpy and xxhash).
2. Hashes are counted (combined in each task before the shuffle); those of
   at least two documents are the index's keys.
3. The keys are cut into shards of about ``SHARD_KEYS``.  One task per
   shard builds a minimal perfect hash and, in its order, compact arrays:
   fingerprint, count and owner (smallest document id).  The shards are
   written to the shared folder.
4. Line hashes probe the arrays instead of joining lines: they are dealt
   to (shard, copy) groups of about ``PROBE_ROWS`` rows, each headed by
   one copy of its shard's arrays, and stream past them.  A line of a third
   of all documents only means more copies of one shard.
5. Documents lose the lines found whose owner is another document.

Defined results: null and empty texts have one empty line.  Rows that
share an id are one document.  A null id counts as one document that sorts
after all others.  A key's lines all stay in its owner, repeats included.
Ids are whole numbers; text that is no number fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, prepare_workers, quoted, saved, slices, texts_of
from .minimal_hash import MinimalHash

#: Shortest key, in code points, and least number of documents.
MIN_CHARS = 10
#: Keys in a shard: bounds a builder's and a prober's memory (about 5 MB of arrays).
SHARD_KEYS = 1 << 17
#: Probes that share one copy of a shard's arrays.
PROBE_ROWS = 1 << 18
#: Stands for a null id inside the operator.
NO_ID = (1 << 63) - 1

_CONTINUATION = bytes(range(0x80, 0xC0))


def keys_of(text: bytes, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """Line number and key of each line whose key is long enough."""
    for n, line in enumerate(text.lower().split(b"\n")):  # bytes: only A-Z change
        key = line.strip()  # bytes: space and 0x09 to 0x0D
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, _CONTINUATION)) >= min_chars):
            yield n, key


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``did``, ``th``, ``pos``, ``high``, ``low`` of each long enough line of (``t``, ``did``, ``th``)."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES, batch.num_rows):
                pos, hashes, sizes = [], [], []
                for text in texts_of(part.column(0)):
                    before = len(pos)
                    for n, key in keys_of(text, min_chars):
                        pos.append(n)
                        hashes.append(xxhash.xxh3_128_digest(key))
                    sizes.append(len(pos) - before)
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                both = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(row),
                        part.column(2).take(row),
                        pa.array(pos, pa.int32()),
                        pa.array(both[:, 0]),
                        pa.array(both[:, 1]),
                    ],
                    names=["did", "th", "pos", "high", "low"],
                )

    return docs.mapInArrow(run, "did long, th long, pos int, high long, low long")


def build_shard(table: pa.Table) -> pa.Table:
    """One shard's perfect hash and arrays from its keys."""
    high, low, owner, count = (table.column(c).to_numpy() for c in ("high", "low", "owner", "n"))
    high, low = high.view(np.uint64), low.view(np.uint64)
    hashed = MinimalHash.build(high, low)
    order = np.argsort(hashed.numbers(high, low))
    blobs = [hashed.sizes, hashed.words, low[order], owner[order], count[order]]
    return pa.table(
        [table.column("shard")[:1], *[pa.array([x.tobytes()], pa.binary()) for x in blobs]],
        names=["shard", "sizes", "words", "prints", "owners", "counts"],
    )


def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (shard, copy, kind): a shard's arrays (kind 0), then the probes they answer (kind 1)."""
    shard, hashed, prints, owners = None, None, None, None
    for batch in batches:
        at = np.array(batch.column("shard"))
        heads = np.flatnonzero(np.array(batch.column("kind")) == 0)
        cuts = np.unique(np.concatenate([[0], heads, np.flatnonzero(np.diff(at)) + 1, [len(at)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if batch.column("kind")[a].as_py() == 0:
                sizes, words, prints, owners = (
                    np.frombuffer(batch.column(c)[a].as_buffer(), dtype=t)
                    for c, t in (("sizes", np.int64), ("words", np.uint64), ("prints", np.uint64), ("owners", np.int64))
                )
                shard, hashed = int(at[a]), MinimalHash(sizes, words)
                a += 1
            if a == b or int(at[a]) != shard:
                continue  # a shard without arrays repeats nothing
            part = batch.slice(a, b - a)
            high, low, did = (np.array(part.column(c)) for c in ("high", "low", "did"))
            low = low.view(np.uint64)
            number = hashed.numbers(high.view(np.uint64), low)
            found = np.flatnonzero(number >= 0)
            found = found[prints[number[found]] == low[found]]
            lost = found[owners[number[found]] != did[found]]
            if len(lost):
                rows = pa.array(lost)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(rows) for c in ("did", "th", "pos")], names=["did", "th", "pos"]
                )


def build_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """The written shards, and their number."""
    spark = lines.sparkSession
    keys = saved(
        spark,
        lines.groupBy("high", "low")
        .agg(F.min("did").alias("owner"), F.max("did").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("owner <> last")
        .drop("last"),
        "line-keys",
    )
    shards = -(-keys.count() // SHARD_KEYS) or 1
    schema = "shard int, sizes binary, words binary, prints binary, owners binary, counts binary"
    built = keys.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build_shard, schema)
    return saved(spark, built, "line-index"), shards


def shard_of(shards: int) -> Column:
    return (F.shiftrightunsigned("high", 32) % shards).cast("int")


def repeated_lines(lines: DataFrame, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """``did``, ``th``, ``drop`` (line numbers): what each document loses."""
    index, shards = build_index(lines)
    lines = lines.withColumn("shard", shard_of(shards))
    # One row per shard (a key count divided by SHARD_KEYS): small enough to broadcast.
    copies = lines.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / probe_rows).cast("int").alias("copies"))
    probes = lines.join(F.broadcast(copies), "shard").select(
        "shard",
        F.pmod(F.xxhash64("did", "th", "pos"), F.col("copies")).cast("int").alias("copy"),
        F.lit(1).alias("kind"),
        "did",
        "th",
        "pos",
        "high",
        "low",
    )
    arrays = index.join(F.broadcast(copies), "shard").select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
        F.lit(0).alias("kind"),
        "sizes",
        "words",
        "prints",
        "owners",
    )
    lost = (
        probes.unionByName(arrays, allowMissingColumns=True)
        .repartition("shard", "copy")
        .sortWithinPartitions("shard", "copy", "kind")
        .mapInArrow(probe, "did long, th long, pos int")
    )
    return lost.groupBy("did", "th").agg(F.collect_set("pos").alias("drop"))


def drop_repeated_lines(
    docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """``keep`` columns, ``n_lines`` (before), ``n_dropped`` and ``kept`` (the text that stays)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    keyed = docs.select(
        text.alias("t"),
        F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(text).alias("th"),
        *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)],
    )
    lines = saved(spark, line_hashes(keyed.select("t", "did", "th"), min_chars), "line-hashes")
    lost = repeated_lines(lines)
    # Texts travel as their lines, so that a text is split once, before the shuffle.
    split = keyed.select(F.split("t", "\n", -1).alias("lines"), "did", "th", *[f"k{i}" for i in range(len(keep))])
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.col("lines")[i]))
    out = split.join(lost, ["did", "th"], "left").select(
        *[f"k{i}" for i in range(len(keep))],
        F.size("lines").cast("long"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long"),
        F.array_join(kept, "\n"),
    )
    return out.toDF(*keep, "n_lines", "n_dropped", "kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The documents with their repeated lines gone; other columns as they were, but for ``chars_col`` (the text's length)."""
    out = drop_repeated_lines(docs, docs.columns, id_col, text_col)
    inner = out.toDF(*[f"k{i}" for i in range(len(docs.columns))], "n_lines", "n_dropped", "kept")
    changed = F.col("n_dropped") > 0
    columns = []
    for i, (name, kind) in enumerate(docs.dtypes):
        old = F.col(f"k{i}")
        if name == text_col:
            old = F.when(changed, F.col("kept")).otherwise(old)
        elif name == chars_col:
            old = F.when(changed, F.length("kept").cast(kind)).otherwise(old)
        columns.append(old.alias(name))
    return inner.select(*columns)
