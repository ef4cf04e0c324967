"""Spelling variants by a bit-sliced position index over the vocabulary.

1. Words and their counts: letter runs of whole texts, exploded and counted with
   partial aggregates (JVM only).
2. Shards.  Of two words one edit apart, the shorter having ``t`` letters, either
   the first ``t // 2`` letters or the last ``t - t // 2`` are equal.  Each word
   goes, for ``t`` its length and its length less one, to the shard of its head
   and to the shard of its tail; shards are dealt to buckets of about
   ``BUCKET_WORDS`` words, and a bucket that a common head or tail overfills is
   cut into tiles (``tiles``), so nothing is capped.
3. Index of a tile: for every position and letter a bitset over the tile's words.
   All words of ``t`` letters are looked up together.  Reading a word letter by
   letter keeps three bitsets: words with no error so far, words with one replaced
   letter, and words one letter ahead, for which the bitsets of the next
   position are read.  At the end they hold the words at exactly one edit
   (words with a letter less find this pair from their side).
4. A pair counts in the shard of its head if the heads are equal, else in that of
   its tail, so it is found once.  Partners, the form and the root follow by
   joins; roots by pointer doubling.

Defined results: null text has no words and a null id counts as empty text.
Repeated rows count again.  Ties between forms go to the smallest word in
code-point order.  Very long runs are words like others.  Empty tables give
no rows.  Only the id and the text are read, so extra columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, saved
from .tiles import over_tiles, tiled

# Fixed values (the contract's): letters of a word, what is lower-cased, which runs lose a letter, bounds.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES = 31
MIN_LETTERS = 7
MIN_COUNT = 2
FORM_TIMES = 10

#: Words of a bucket, and of a slice of an overfull one.
BUCKET_WORDS = 2048
TILE_WORDS = 4096
#: Bits of the sets of words that are looked up together.
LOOKUP_BITS = 1 << 22


def damaged(run: Column, id_text: Column) -> Column:
    """The run, or what is left when the hash of id and run takes a letter from it."""
    h = F.crc32(F.concat(id_text, F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % LOSES == 0, less).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n`` of all words of enough letters and occurrences."""
    # A run under MIN_LETTERS can only lose letters.
    runs = F.regexp_extract_all(F.col(quoted(text_col)).cast("string"), F.lit(RUN), F.lit(0))
    long_runs = F.filter(runs, lambda r: F.length(r) >= MIN_LETTERS)
    id_text = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    each = docs.select(id_text.alias("id"), F.explode(long_runs).alias("run"))
    words = each.select(damaged(F.translate("run", UPPER, LOWER), F.col("id")).alias("word"))
    return words.filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def shards(words: DataFrame, bucket_words: int) -> DataFrame:
    """``bucket``, ``t``, ``tail``, ``word``, ``n``: each word in the buckets of its heads and tails."""
    length = F.length("word")
    t = F.explode(F.filter(F.array(length, length - 1), lambda x: x >= MIN_LETTERS))
    rows = words.select("word", "n", t.alias("t")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("tail"))
    head = F.floor(F.col("t") / 2).cast("int")
    part = F.when(~F.col("tail"), F.substring("word", F.lit(1), head)).otherwise(
        F.expr("right(word, t - cast(floor(t / 2) as int))")
    )
    buckets = max(1, 4 * words.count() // bucket_words)
    return rows.select(F.pmod(F.xxhash64("t", "tail", part), F.lit(buckets)).alias("bucket"), "t", "tail", "word", "n")


class PositionIndex:
    """Bitsets over words of ``t`` and ``t + 1`` letters, by position and letter."""

    def __init__(self, words: list[str], t: int):
        self.t, self.n = t, len(words)
        sizes = np.array([len(w) for w in words])
        wide = "".join(w if len(w) > t else w + "\0" for w in words)
        codes = np.frombuffer(wide.encode("utf-32-le"), dtype="<u4").reshape(self.n, t + 1)
        self.letters, at = np.unique(codes, return_inverse=True)
        self.codes = at.reshape(self.n, t + 1)
        self.bytes = -(-self.n // 64) * 8
        self.same = sizes == t
        self.longer = sizes == t + 1
        self.bits = np.zeros((t + 1, len(self.letters), self.bytes), dtype=np.uint8)
        for p in range(t + 1):
            has = self.codes[:, p] == np.arange(len(self.letters))[:, None]
            self.bits[p, :, : -(-self.n // 8)] = np.packbits(has, axis=1, bitorder="little")

    def sets(self, member: np.ndarray) -> np.ndarray:
        out = np.zeros(self.bytes, dtype=np.uint8)
        out[: -(-self.n // 8)] = np.packbits(member, bitorder="little")
        return out.view(np.uint64)

    def one_edit(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of ``t`` letters (by number): pairs (word, word of the index) at exactly one edit."""
        index = self.bits.view(np.uint64)
        none = np.full((len(words), self.bytes // 8), np.uint64(0xFFFFFFFFFFFFFFFF))  # no error so far
        changed = np.zeros_like(none)  # one letter replaced
        ahead = np.zeros_like(none)  # one letter of the word passed over: the next position is read
        for i in range(self.t):
            letter = self.codes[words, i]
            here, after = index[i, letter], index[i + 1, letter]
            changed = changed & here | none & ~here
            ahead = (ahead | none) & after
            none = none & here
        found = changed & self.sets(self.same) | (ahead | none) & self.sets(self.longer)
        hit = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : self.n]
        at, other = np.nonzero(hit)
        return words[at], other


def near_in_tile(tile: pa.Table) -> pa.Table | None:
    """Pairs of a tile, both ways: ``word``, ``near`` and its count."""
    lo, hi = tile.column("lo")[0].as_py(), tile.column("hi")[0].as_py()
    words, n, t, tail, own = (tile.column(c).to_pylist() for c in ("word", "n", "t", "tail", "own"))
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(t, tail)):
        groups.setdefault(key, []).append(i)
    left: list[int] = []
    right: list[int] = []
    for (size, by_tail), rows in groups.items():
        if len(rows) < 2:
            continue
        index = PositionIndex([words[i] for i in rows], size)
        asked = np.flatnonzero(index.same)
        step = max(1, LOOKUP_BITS // (index.bytes * 8))
        head = size // 2
        for s in range(0, len(asked), step):
            for a, b in zip(*(x.tolist() for x in index.one_edit(asked[s : s + step]))):
                i, j = rows[a], rows[b]
                heads = words[i][:head] == words[j][:head]
                if by_tail and (heads or words[i][head:] != words[j][head - size :]) or not by_tail and not heads:
                    continue  # another shard's pair
                if lo != hi and own[i] == own[j]:
                    continue  # another tile's pair
                left.append(i)
                right.append(j)
                if len(words[j]) > size:  # the longer word doesn't ask here
                    left.append(j)
                    right.append(i)
    if not left:
        return None
    return pa.table(
        {"word": [words[i] for i in left], "near": [words[j] for j in right], "near_n": pa.array([n[j] for j in right], pa.int64())}
    )


def near_words(words: DataFrame, bucket_words: int = BUCKET_WORDS, tile_words: int = TILE_WORDS) -> DataFrame:
    """``word``, ``near``, ``near_n`` for every two words at one inserted, deleted or replaced letter, both ways."""
    rows = tiled(shards(words, bucket_words), ["bucket"], "word", tile_words)
    return over_tiles(rows, ["bucket"], near_in_tile, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for words with a form: forms followed to the last one (they grow tenfold, so chains are short)."""
    spark = forms.sparkSession
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = saved(spark, at.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_words: int = BUCKET_WORDS,
    tile_words: int = TILE_WORDS,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    spark = docs.sparkSession
    words = saved(spark, vocabulary(docs, id_col, text_col), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    about = near_words(words, bucket_words, tile_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    large = (-F.col("best.less")) >= FORM_TIMES * F.col("n")
    found = saved(
        spark,
        words.join(about, "word", "left").select(
            "word",
            F.when(large, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    forget(words)
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
