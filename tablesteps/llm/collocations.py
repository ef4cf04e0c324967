"""Phrase collocations by stripes.

One structure serves everything: a stripe, keyed by language and prefix, counts
the words that follow the prefix; its last slot counts where nothing (kept)
follows.  Extensions are its entries, the frequency of the prefix is its total,
and what a phrase can be subsumed by is a maximum over entries.

Stripes of prefixes of 0, 1, 2 and 3 words are built in that order, one scan of
the texts each:

1. Tasks number the words they meet and count (prefix, next word) in numpy, a
   bounded number of words and entries at a time.  Beside it they count phrases
   one word longer than these by hash bucket (2^``FILTER_BITS`` buckets).
2. Partial stripes travel in bundles: a row holds a task's stripes of one hash share
   of (prefix, page of the next word), ``BUNDLES`` shares for each language.  The pages
   spread the long stripe of a common prefix over the bundles.  Sorted partitions stream
   past the merge, which adds stripes elementwise and holds one bundle.  Bucket counts
   travel along, as rows of the language ``BUCKETS``, and become a bitmap of the
   buckets of ``min_count`` or more.
3. Entries of fewer than ``min_count`` are left out after the merge (the total keeps
   them).  A longer phrase of ``min_count`` occurrences has only parts of as
   many, and its bucket has as many.  So the next scan counts a place only if its
   prefix is one of the phrases kept (a second bitmap, of their hashes), and its
   next word only if the longer phrase passes the first.  Both bitmaps have a fixed
   size; what they let through in vain costs a row and is dropped by its count, so
   a corpus that fills them is counted as exactly, with more rows.

Candidates are the entries; the part before a cut is a prefix with its total, the
part behind it is looked up among the entries.  A word more never raises a frequency, so
the phrases that are one word longer decide what is subsumed.  Numbers that
multiply are decimals.

Defined results: null text is empty; null lang is ``und`` (with the rows whose lang
is ``und``).  Texts of any length are counted whole.  Repeated rows count again.
Ties in score go by ``a``, then by the phrase's bytes.  An empty table gives no rows.
Only the text and lang columns are read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, prepare_workers, quoted, saved
from .tiles import changes, same_key

# Fixed values (the contract's): what ends a piece, longest phrase, least frequency, factors.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
MAX_WORDS = 4
MIN_COUNT = 30
SCORE_TIMES = 2_000_000
SUBSUMED_PERCENT = 80
TOP = 2000
NO_LANG = "und"

#: Words a task knows, and entries and buckets it holds, before it sends them on.
TASK_WORDS = 1 << 19
TASK_ENTRIES = 1 << 20
TASK_BUCKETS = 1 << 22
#: Words counted at a time.
CHUNK_WORDS = 1 << 18
#: Bits (as a power of two) of each bitmap: 16 MB.
FILTER_BITS = 27
#: Bundles of a language, and pages of a stripe by words of its prefix.
BUNDLES = 1024
PAGES = (1024, 8, 2, 1)
#: Stands for a language in the rows of bucket counts (no UTF-8); buckets in such a row.
BUCKETS = b"\xff"
ROW_BUCKETS = 1 << 15

_BREAK = b"\xff"  # no byte of UTF-8: stands between pieces
_TABLE = bytes(_BREAK[0] if c in PIECE_ENDS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of words; 0 is the break between pieces.  ``names`` and ``hashes`` by number."""

    def __init__(self, lang: bytes, names: list[tuple[bytes, bytes]], hashes: list[int]):
        super().__init__({_BREAK: 0})
        self.lang, self.names, self.hashes = lang, names, hashes
        self.seed = xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append((self.lang, word))
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n


def phrase_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the phrase of ``size`` words at each place, given the hashes of the words."""
    n = len(hashes) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = (h ^ hashes[i : i + n]) * _MULTIPLY
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


class Counter:
    """Counts (prefix, next word) of the texts given, and buckets of phrases that are one word longer.

    ``known`` is the bitmap of phrases as long as the prefix, ``buckets`` of those with the next word.
    """

    def __init__(self, size: int, known: np.ndarray | None, buckets: np.ndarray | None, longer: bool, min_count: int):
        self.size, self.known, self.buckets, self.longer = size, known, buckets, longer
        self.most = min(min_count, 255)  # a bucket's count is of no interest beyond
        self.seen: list[np.ndarray] = []
        self.held_buckets = 0
        self.clear()

    def clear(self) -> None:
        self.langs: dict[bytes, Words] = {}
        self.names: list[tuple[bytes, bytes]] = [(b"", b"")]
        self.hashes: list[int] = [0]
        self.numbers: list[int] = [0]
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        if lang not in self.langs:
            self.langs[lang] = Words(lang, self.names, self.hashes)
        self.numbers += map(self.langs[lang].__getitem__, text.translate(_TABLE).replace(_BREAK, b" \xff ").split())
        self.numbers.append(0)
        if len(self.numbers) >= CHUNK_WORDS:
            self.count()
            if self.held >= TASK_ENTRIES:
                self.merge()
            if self.held >= TASK_ENTRIES * 3 // 4 or len(self.names) >= TASK_WORDS:
                yield from self.stripes()
            if self.held_buckets >= TASK_BUCKETS:
                yield from self.bucket_rows()

    def count(self) -> None:
        k = self.size
        at = np.array(self.numbers + [0] * (k + 2), dtype=np.int64)
        self.numbers = [0]
        hashes = np.array(self.hashes, dtype=np.uint64)[at]
        words = [at > 0]  # places with a phrase of 1, 2, ... words
        for i in range(1, k + 2):
            words.append(words[-1][:-1] & words[0][i:])
        if not k:
            rows, longer = at[words[0]][:, None], words[1]
        else:
            known = words[k - 1] & in_bitmap(self.known, phrase_bits(hashes, k))
            follows = words[k] & known[:-1] & known[1:] & in_bitmap(self.buckets, phrase_bits(hashes, k + 1))
            place = np.flatnonzero(known)
            rows = at[place[:, None] + np.arange(k + 1)]
            rows[~np.append(follows, False)[place], k] = 0
            longer = words[k + 1] & follows[:-1] & follows[1:]
        if self.longer:
            self.seen.append(phrase_bits(hashes, k + 2)[longer])
            self.held_buckets += len(self.seen[-1])
        rows, counts = distinct(rows, np.ones(len(rows), dtype=np.int64))
        self.rows.append(rows)
        self.counts.append(counts)
        self.held += len(rows)

    def bucket_rows(self) -> Iterator[pa.RecordBatch]:
        """The buckets counted, ``ROW_BUCKETS`` of them a row: places (two bytes each), then counts (one)."""
        if not self.held_buckets:
            return
        buckets, counts = np.unique(np.concatenate(self.seen), return_counts=True)
        self.seen, self.held_buckets = [], 0
        times = np.minimum(counts, self.most).astype(np.uint8)
        place, piece = (buckets % ROW_BUCKETS).astype("<u2"), buckets // ROW_BUCKETS
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        ends = np.append(first[1:], len(piece))
        made = [place[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
        for s in range(0, len(first), 1024):
            m = len(first[s : s + 1024])
            one = pa.array(np.arange(m + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([BUCKETS] * m, pa.binary()),
                    pa.array(piece[first[s : s + m]].astype(np.int32)),
                    pa.array([None] * m, pa.list_(pa.binary())),
                    pa.array([None] * m, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(one, pa.array(made[s : s + m], pa.binary())),
                    pa.ListArray.from_arrays(one, pa.array(ends[s : s + m] - first[s : s + m])),
                ],
                names=["lang", "bundle", "prefix", "size", "next", "n"],
            )

    def merge(self) -> None:
        rows, counts = distinct(np.concatenate(self.rows), np.concatenate(self.counts))
        self.rows, self.counts, self.held = [rows], [counts], len(rows)

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """All that is held, as partial stripes; then begins anew."""
        if len(self.numbers) > 1:
            self.count()
        if self.held:
            self.merge()
            rows, counts, k = self.rows[0], self.counts[0], self.size
            hashes = np.array(self.hashes, dtype=np.uint64)
            share = (hashes[rows[:, k]] >> np.uint64(40)) % np.uint64(PAGES[k])
            for i in range(k):
                share = (share ^ hashes[rows[:, i]]) * _MULTIPLY
                share ^= share >> np.uint64(29)
            bundle = (share % np.uint64(BUNDLES)).astype(np.int64)
            lang_of = {lang: i for i, lang in enumerate(self.langs)}
            # The first word tells the language: the empty prefix has the word itself.
            lang = np.array([lang_of.get(x, 0) for x, _ in self.names])[rows[:, 0]]
            order = np.lexsort([*(rows[:, i] for i in range(k - 1, -1, -1)), bundle, lang])
            rows, counts, where = rows[order], counts[order], lang[order] * BUNDLES + bundle[order]
            first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            stripe = np.append(True, (where[1:] != where[:-1]) | (rows[1:, :k] != rows[:-1, :k]).any(axis=1))
            begins = np.flatnonzero(stripe)
            words = [w for _, w in self.names]
            follow = pa.array(words, pa.binary()).take(pa.array(rows[:, k]))
            prefixes = pa.array([b" ".join([words[i] for i in r]) for r in rows[begins, :k].tolist()], pa.binary())
            sizes = pa.array(np.diff(np.append(begins, len(rows))).astype(np.int32))
            counts, names = pa.array(counts), list(self.langs)
            ends = np.append(first, len(rows))
            stripe_ends = np.searchsorted(begins, ends)
            for s in range(0, len(first), 256):
                at = ends[s : s + 257]
                by_stripe = stripe_ends[s : s + 257]
                entry, head = slice(int(at[0]), int(at[-1])), slice(int(by_stripe[0]), int(by_stripe[-1]))
                entry_lists, head_lists = (pa.array((x - x[0]).astype(np.int32)) for x in (at, by_stripe))
                here = where[at[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in (here // BUNDLES).tolist()], pa.binary()),
                        pa.array((here % BUNDLES).astype(np.int32)),
                        pa.ListArray.from_arrays(head_lists, prefixes[head]),
                        pa.ListArray.from_arrays(head_lists, sizes[head]),
                        pa.ListArray.from_arrays(entry_lists, follow[entry]),
                        pa.ListArray.from_arrays(entry_lists, counts[entry]),
                    ],
                    names=["lang", "bundle", "prefix", "size", "next", "n"],
                )
        self.clear()


def distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of word numbers, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    code = rows[:, 0]
    for i in range(1, rows.shape[1]):
        # Dense numbers of the part so far leave room for the next word: exact, no hash.
        code = (code if i == 1 else np.unique(code, return_inverse=True)[1].reshape(-1).astype(np.int64)) << 32 | rows[:, i]
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return rows[order[first]], np.add.reduceat(counts[order], first)


def partial_stripes(texts: DataFrame, size: int, known, buckets, longer: bool, min_count: int) -> DataFrame:
    """One row per task, ``lang`` and ``bundle`` (or a few): each ``prefix``, the ``size`` of its stripe, and the entries of
    all of them one after another, ``next`` (words) and ``n`` (their counts); and rows of bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [None if x is None else np.frombuffer(x.value, dtype=np.uint8) for x in (known, buckets)]
        counter = Counter(size, *bitmaps, longer, min_count)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from counter.add(lang, text.as_py())
        yield from counter.stripes()
        yield from counter.bucket_rows()

    schema = "lang binary, bundle int, prefix array<binary>, size array<int>, next array<binary>, n array<bigint>"
    return texts.mapInArrow(run, schema)


class BucketSums:
    """Bucket counts of sorted rows; a finished piece becomes a row with its bitmap."""

    def __init__(self, min_count: int):
        self.least, self.piece = min(min_count, 255), None

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        blobs, sizes = (pc.list_flatten(table.column(c).combine_chunks()) for c in ("next", "n"))
        for piece, blob, m in zip(table.column("bundle").to_pylist(), blobs, sizes.to_pylist()):
            if piece != self.piece:
                yield from self.closed()
                self.piece, self.sums = piece, np.zeros(ROW_BUCKETS, dtype=np.int64)
            data = blob.as_py()
            # A row has a place once.
            self.sums[np.frombuffer(data, dtype="<u2", count=m)] += np.frombuffer(data, dtype=np.uint8, offset=2 * m)

    def closed(self) -> Iterator[pa.RecordBatch]:
        if self.piece is not None:
            bits = np.packbits(self.sums >= self.least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([BUCKETS], pa.binary()),
                    pa.array([b""], pa.binary()),
                    pa.array([self.piece], pa.int64()),
                    pa.array([[bits]], pa.list_(pa.binary())),
                    pa.array([[0]], pa.list_(pa.int64())),
                ],
                names=["lang", "prefix", "total", "next", "n"],
            )


def merged(partial: DataFrame, min_count: int) -> DataFrame:
    """Stripes merged elementwise: ``lang``, ``prefix``, ``total`` and the entries of ``min_count`` or more, one row for
    each page of a prefix; and the bitmap of the buckets (``lang`` ``BUCKETS``, the piece as ``total``)."""
    keys = ["lang", "bundle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # entries of the bundle at hand
        sums = BucketSums(min_count)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            of_buckets = pc.equal(table.column("lang"), BUCKETS)
            yield from sums.add(table.filter(of_buckets))
            table = table.filter(pc.invert(of_buckets))
            if not table.num_rows:
                continue
            cuts = [0, *changes(table, keys).tolist(), table.num_rows]
            if held is not None and not same_key(held, table, keys):
                yield from closed(summed(held), min_count)
                held = None
            for a, b in zip(cuts, cuts[1:]):
                if held is not None and a:
                    yield from closed(summed(held), min_count)
                    held = None
                more = entries(table.slice(a, b - a))
                held = more if held is None else pa.concat_tables([held, more])
                if held.num_rows > TASK_ENTRIES:
                    held = summed(held)
        if held is not None:
            yield from closed(summed(held), min_count)
        yield from sums.closed()

    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, "lang binary, prefix binary, total bigint, next array<binary>, n array<bigint>"
    )


def entries(table: pa.Table) -> pa.Table:
    """Bundles as one row for each entry."""
    prefix, size, follow, n = (table.column(c).combine_chunks() for c in ("prefix", "size", "next", "n"))
    sizes = pc.list_flatten(size).to_numpy()
    stripe = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    at = pc.list_parent_indices(follow)
    return pa.table(
        {
            "lang": table.column("lang").combine_chunks().take(at),
            "bundle": table.column("bundle").combine_chunks().take(at),
            "prefix": pc.list_flatten(prefix).take(stripe),
            "next": pc.list_flatten(follow),
            "n": pc.list_flatten(n),
        }
    )


def summed(table: pa.Table) -> pa.Table:
    """Entries of one bundle, added up elementwise."""
    keys = ["lang", "bundle", "prefix", "next"]
    return table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select([*keys, "n"])


def closed(table: pa.Table, min_count: int) -> Iterator[pa.RecordBatch]:
    """Finished stripes as rows, entries of rare extensions only in the total."""
    often = pc.and_(pc.greater_equal(table.column("n"), min_count), pc.greater(pc.binary_length(table.column("next")), 0))
    order = [("lang", "ascending"), ("prefix", "ascending")]
    keys = ["lang", "prefix"]
    table = table.append_column("often", pc.cast(often, pa.int32()))
    totals = table.group_by(keys, use_threads=False).aggregate([("n", "sum"), ("often", "sum")]).sort_by(order)
    kept = table.filter(often).sort_by(order)
    ends = np.zeros(totals.num_rows + 1, dtype=np.int32)
    np.cumsum(totals.column("often_sum").to_numpy(), out=ends[1:])
    follow, n = (kept.column(c).combine_chunks() for c in ("next", "n"))
    columns = {k: totals.column(k).combine_chunks() for k in keys} | {"total": totals.column("n_sum").combine_chunks()}
    columns |= {"next": pa.ListArray.from_arrays(pa.array(ends), follow), "n": pa.ListArray.from_arrays(pa.array(ends), n)}
    yield from pa.table(columns).to_batches(max_chunksize=8192)


def bitmap_of(phrases: DataFrame) -> bytes:
    """The bitmap of the phrases' hashes, gathered from the tasks in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, split = batch.column(0).to_pylist(), [p.split(b" ") for p in batch.column(1).to_pylist()]
            seeds = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
            size = len(split[0])
            hashes = np.array([xxhash.xxh64_intdigest(w, seeds[x]) for x, p in zip(langs, split) for w in p], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(phrase_bits(hashes, size)[::size]))], names=["bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(run, "bit bigint")
    pieces = bits.groupBy(F.floor(F.col("bit") / ROW_BUCKETS).alias("piece")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(ROW_BUCKETS)).cast("bigint")).alias("bits")
    )
    return whole_bitmap(pieces)


def whole_bitmap(pieces: DataFrame) -> bytes:
    """The pieces put together (2^FILTER_BITS bits, whatever the corpus)."""
    size = ROW_BUCKETS // 8
    whole = bytearray(1 << (FILTER_BITS - 3))
    for piece, data in pieces.collect():
        whole[piece * size : piece * size + size] = data[:size]
    return bytes(whole)


def stripe_tables(docs: DataFrame, text_col: str, lang_col: str, max_words: int, min_count: int) -> list[DataFrame]:
    """Merged stripes of prefixes of 0 to ``max_words`` - 1 words, written."""
    spark = docs.sparkSession
    prepare_workers(spark)
    texts = docs.select(
        F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit(NO_LANG)).cast("binary").alias("lang"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    tables: list[DataFrame] = []
    for size in range(max_words):
        sent = []
        if size:
            buckets = tables[-1].filter(F.col("lang") == BUCKETS).select("total", F.col("next")[0])
            sent = [spark.sparkContext.broadcast(x) for x in (bitmap_of(phrases_of(tables[-1])), whole_bitmap(buckets))]
        known, buckets = sent or (None, None)
        partial = partial_stripes(texts, size, known, buckets, size + 1 < max_words, min_count)
        tables.append(saved(spark, merged(partial, min_count), f"stripes-{size}"))
        for x in sent:
            x.destroy()
    return tables


def phrases_of(stripes: DataFrame) -> DataFrame:
    """``lang``, ``prefix``, ``last`` (the word that follows), ``phrase``, ``f`` of the entries."""
    each = stripes.filter((F.col("lang") != BUCKETS) & (F.size("next") > 0)).select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("x"))
    space = F.when(F.length("prefix") > 0, F.lit(b" ")).otherwise(F.lit(b""))
    return each.select(
        "lang", "prefix", F.col("x.next").alias("last"), F.concat("prefix", space, "x.next").alias("phrase"), F.col("x.n").alias("f")
    )


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the best phrases of each language."""
    if not 2 <= max_words <= len(PAGES):
        raise ValueError(f"max_words must be between 2 and {len(PAGES)}")
    if min_count < 1 or top < 1:
        raise ValueError("min_count and top must be at least 1")
    spark = docs.sparkSession
    tables = stripe_tables(docs, text_col, lang_col, max_words, min_count)
    n = tables[0].filter(F.col("lang") != BUCKETS).groupBy("lang").agg(F.sum("total").alias("n"))
    found = [phrases_of(t) for t in tables]
    totals = _union([t.filter(F.col("lang") != BUCKETS).select("lang", "prefix", "total") for t in tables[1:]])
    totals = totals.groupBy("lang", F.col("prefix").alias("left")).agg(F.sum("total").alias("l")).filter(F.col("l") >= min_count)
    lefts = saved(spark, totals, "phrases-totals")
    known = saved(spark, _union([p.select("lang", "phrase", "f") for p in found]), "phrases-kept")
    longer = _union([p.withColumn("words", F.lit(i + 1)) for i, p in enumerate(found) if i])
    longer = saved(spark, longer.withColumn("w", F.split(F.col("phrase").cast("string"), " ")).drop("phrase"), "phrases-long")
    for t in tables[1:]:
        forget(t)
    words = F.col("w")
    text = F.array_join(words, " ").cast("binary")
    # What a phrase lies in: entries of its own stripe, and entries whose prefix it continues.
    wider = longer.filter("words > 2")
    subsumers = (
        wider.select("lang", F.col("prefix").alias("phrase"), "f")
        .unionAll(wider.select("lang", F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " ").cast("binary").alias("phrase"), "f"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("most"))
    )
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = longer.select("lang", "words", "w", text.alias("phrase"), F.col("f").alias("a"), cut.alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").cast("binary").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").cast("binary").alias("right"),
    )
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr(f"({SCORE_TIMES} * cast(a as decimal(28,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", score.cast("long"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    big = "decimal(28,0)"
    held = (
        weakest.join(subsumers, ["lang", "phrase"], "left")
        .filter(F.coalesce(100 * F.col("most").cast(big) < SUBSUMED_PERCENT * F.col("a").cast(big), F.lit(True)))
        .select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = held.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(n, "lang").select(
        F.col("lang").cast("string").alias("lang"),
        F.col("rank").cast("long").alias("rank"),
        F.col("phrase").cast("string").alias("phrase"),
        "a",
        "l",
        "r",
        "n",
        "score",
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out
