"""Benchmark decontamination with suffix arrays over the training text.

Every slice of documents inside a task is one shard: its words become
numbers (of the test vocabulary, 0 for all others), a suffix array orders
the training suffixes, and every suffix of every test item is
binary-searched in it.  The range of training suffixes that share its
first ``window`` words gives all locations of that window; comparing on
beyond the window gives the longest verbatim match.

Only training suffixes that open like some test window (first three
words, or the whole window if shorter) enter the array: no other suffix
can hold a window, so results are exact while the sort stays small.
Numbers stand for whole words, so an equal number is an equal word.

The shards need no shuffle.  The test set goes to the tasks in blocks of
``block_bytes``: one pass over the documents for each block, merged by
row afterwards when there are several.

Defined results: null and empty texts have no words and no hits; an item
without words has no window; rows that repeat an item id count once in
``items``; a null item id is listed as the empty string.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from .common import blocks_of, map_text, quoted, saved, texts_of
from .suffixes import suffix_array

WINDOW = 10
#: Bytes of test text in one block: bounds what a task holds of the test set.
BLOCK_BYTES = 8 << 20
#: Pairs of test and training suffix compared at a time.
PAIR_ROWS = 50_000

# Bytes of word characters ([0-9], letters lower-cased, all of 0x80 and above) map to themselves, the rest to a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

FIELDS = [
    StructField("n_words", LongType()),
    StructField("hit_starts", ArrayType(LongType())),
    StructField("hit_ends", ArrayType(LongType())),
    StructField("items", ArrayType(StringType())),
    StructField("longest", LongType()),
    StructField("longest_at", LongType()),
]

_ITEMS = [f.name for f in FIELDS].index("items")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    return text.translate(_WORD_BYTES).split()


class TestSet:
    """One block of test items, numbered for the search."""

    def __init__(self, items: list[tuple], window: int):
        vocab: dict[bytes, int] = {}
        tokens, starts, owners, widths, self.ids = [], [], [], [], []
        for item_id, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            width = min(window, len(words))
            first = len(tokens)
            tokens += [vocab.setdefault(w, len(vocab) + 1) for w in words] + [0]
            count = len(words) - width + 1
            starts += range(first, first + count)
            owners += [len(self.ids)] * count
            widths += [width] * count
            self.ids.append("" if item_id is None else str(item_id))
        self.vocab, self.window = vocab, window
        self.depth = max((len(words_of((t or "").encode())) for _, t in items), default=1)
        self.starts = np.array(starts, dtype=np.int64)
        self.owners = np.array(owners, dtype=np.int64)
        self.widths = np.array(widths, dtype=np.int64)
        self.tokens = np.concatenate([np.array(tokens, dtype=np.int32), np.zeros(self.depth + 3, dtype=np.int32)])
        self.base = np.int64(len(vocab) + 1)
        assert self.base < 1 << 21, "block_bytes is too large"
        self.openings = {}  # by length: sorted codes of the windows' first words
        self.codes = np.zeros(len(starts), dtype=np.int64)
        for k in (1, 2, 3):
            own = np.flatnonzero(np.minimum(self.widths, 3) == k)
            self.codes[own] = self.code(self.tokens, self.starts[own], k)
            if len(own):
                self.openings[k] = np.unique(self.codes[own])

    def code(self, tokens: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        out = tokens[at].astype(np.int64)
        for j in range(1, k):
            out = out * self.base + tokens[at + j]
        return out


def candidates(test: TestSet, tokens: np.ndarray) -> np.ndarray:
    """Training positions that open like a test window."""
    known = tokens != 0
    n = len(tokens) - test.depth - 3
    chosen = np.zeros(n, dtype=bool)
    for k, codes in test.openings.items():
        ok = known[:n].copy()
        for j in range(1, k):
            ok &= known[j : n + j]
        at = np.flatnonzero(ok)
        if len(at):
            code = test.code(tokens, at, k)
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            chosen[at[codes[found] == code]] = True
    return np.flatnonzero(chosen)


def search(test: TestSet, tokens: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of training suffixes that share its whole window (vectorised binary search)."""
    width = test.widths[queries]
    span = np.arange(int(width.max()))
    wanted = test.tokens[test.starts[queries][:, None] + span]
    used = span < width[:, None]
    ends = []
    for upper in (False, True):
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            have = tokens[order[np.minimum(mid, len(order) - 1)][:, None] + span]
            differ = (have != wanted) & used
            first = differ.argmax(axis=1)
            row = np.arange(len(queries))
            less = have[row, first] < wanted[row, first]
            equal = ~differ[row, first]
            right = open_ & (less & ~equal | equal & upper)
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        ends.append(low)
    return ends[0], ends[1]


def matcher(test: TestSet):
    """The text function of one task."""
    get, missing = test.vocab.get, repeat(0)

    def run(texts: pa.Array) -> list[pa.Array]:
        rows = [words_of(t) for t in texts_of(texts)]
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        first = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(counts + 1, out=first[1:])
        tokens = np.zeros(int(first[-1]) + test.depth + 3, dtype=np.int32)
        for r, at, n in zip(rows, first.tolist(), counts.tolist()):
            tokens[at : at + n] = np.fromiter(map(get, r, missing), dtype=np.int32, count=n)
        starts: list = [[] for _ in rows]
        stops: list = [[] for _ in rows]
        items: list = [[] for _ in rows]
        longest, where = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        at = candidates(test, tokens)
        if len(at):
            order = suffix_array(tokens, at, test.depth)
            seen = [np.unique(test.code(tokens, order, k)) for k in (1, 2, 3)]
            opens = np.zeros(len(test.starts), dtype=bool)
            for k in test.openings:
                own = np.minimum(test.widths, 3) == k
                opens |= own & np.isin(test.codes, seen[k - 1])
            queries = np.flatnonzero(opens)
            low, high = search(test, tokens, order, queries)
            found = np.flatnonzero(high > low)
            queries, low, high = queries[found], low[found], high[found]
            edge = np.zeros(len(tokens) + 1, dtype=np.int64)
            owners = set()
            done = 0
            sizes = high - low
            while done < len(queries):  # the pairs of a few queries at a time
                upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), PAIR_ROWS)) + done)
                part = slice(done, upto)
                done = upto
                q = np.repeat(queries[part], sizes[part])
                inner = np.arange(len(q)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
                for cut in range(0, len(q), PAIR_ROWS):
                    qq = q[cut : cut + PAIR_ROWS]
                    pos = order[(np.repeat(low[part], sizes[part]) + inner)[cut : cut + PAIR_ROWS]]
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + test.widths[qq], -1)
                    doc = np.searchsorted(first, pos, side="right") - 1
                    owners.update(zip(doc.tolist(), test.owners[qq].tolist()))
                    length = test.widths[qq].copy()
                    live = np.arange(len(qq))
                    while len(live):  # words beyond the window; zeros end items and documents
                        a = test.tokens[test.starts[qq[live]] + length[live]]
                        live = live[(a != 0) & (a == tokens[pos[live] + length[live]])]
                        length[live] += 1
                    best = np.lexsort((pos, -length, doc))
                    best = best[np.concatenate([[True], doc[best][1:] != doc[best][:-1]])]
                    d, n, p = doc[best], length[best], pos[best] - first[doc[best]]
                    better = (n > longest[d]) | ((n == longest[d]) & (p < where[d]))
                    longest[d[better]], where[d[better]] = n[better], p[better]
            covered = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
                d = int(np.searchsorted(first, a, side="right")) - 1
                starts[d].append(a - int(first[d]))
                stops[d].append(b - int(first[d]))
            for d, owner in owners:
                items[d].append(test.ids[owner])
        return [
            pa.array(counts),
            pa.array(starts, pa.list_(pa.int64())),
            pa.array(stops, pa.list_(pa.int64())),
            pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
            pa.array(longest),
            pa.array(where),
        ]

    return run


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns, ``n_words``, the hit word ranges (``hit_starts``, ``hit_ends``, end exclusive; disjoint,
    ascending), ``items`` with a window in the row, ``longest`` verbatim match in words and its first place.
    """
    spark = docs.sparkSession
    tests = (
        TestSet(block, window)
        for block in blocks_of(
            benchmark,
            [quoted(item_col), quoted(item_text)],
            F.coalesce(F.octet_length(quoted(item_text)), F.lit(0)) + 16,
            block_bytes,
        )
    )
    first, second = next(tests, TestSet([], window)), next(tests, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first)
        return map_text(docs, text_col, keep, FIELDS, lambda: matcher(sent.value))
    # Several blocks: number the rows once in a written copy, match each block in a pass of its own, merge by number.
    inner = [f"k{i}" for i in range(len(keep))]
    numbered = saved(
        spark,
        docs.select(
            F.col(quoted(text_col)).alias("t"),
            *[F.col(quoted(c)).alias(k) for c, k in zip(keep, inner)],
            F.monotonically_increasing_id().alias("row"),
        ),
        "decontaminate-rows",
    )
    parts = []
    for test in chain([first, second], tests):
        sent = spark.sparkContext.broadcast(test)
        parts.append(
            saved(
                spark,
                map_text(numbered, "t", ["row"], FIELDS, lambda sent=sent: matcher(sent.value)),
                "decontaminate-block",
            )
        )
        sent.unpersist()
    merged = merge_blocks(reduce(DataFrame.unionAll, parts))
    names = [f.name for f in FIELDS]
    return numbered.join(merged, "row").select(*inner, *names).toDF(*keep, *names)


def merge_blocks(parts: DataFrame) -> DataFrame:
    """One row per ``row`` from the rows of all blocks: hit ranges united, items together, the longest match of all."""
    ranges = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))
    merged = parts.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        ranges.alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.min(F.struct((-F.col("longest")).alias("n"), F.col("longest_at").alias("at"))).alias("best"),
    )
    last = "element_at(acc, -1)"
    united = F.expr(
        f"""aggregate(r, slice(r, 1, least(1, size(r))), (acc, x) -> if(x.hit_starts <= {last}.hit_ends,
              concat(slice(acc, 1, size(acc) - 1), array(named_struct('hit_starts', {last}.hit_starts,
                'hit_ends', greatest({last}.hit_ends, x.hit_ends)))),
              concat(acc, array(x))))"""
    )
    return merged.withColumn("u", united).select(
        "row",
        "n_words",
        F.col("u.hit_starts").alias("hit_starts"),
        F.col("u.hit_ends").alias("hit_ends"),
        "items",
        (-F.col("best.n")).alias("longest"),
        F.col("best.at").alias("longest_at"),
    )


def n_hit() -> Column:
    """Number of words inside the hit ranges."""
    return F.expr("aggregate(arrays_zip(hit_starts, hit_ends), 0L, (n, r) -> n + r.hit_ends - r.hit_starts)")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any window of the test set; all columns as they were."""
    found = find_matches(docs, benchmark, docs.columns, text_col, **options)
    mine = [f"c{i}" for i in range(len(docs.columns))]
    clean = found.toDF(*mine, *[f"f{i}" for i in range(len(FIELDS))]).filter(F.size(f"f{_ITEMS}") == 0)
    return clean.select(*[F.col(m).alias(c) for m, c in zip(mine, docs.columns)])
