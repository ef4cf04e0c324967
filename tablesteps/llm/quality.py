"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are made in tasks (numpy over the bytes,
word and line counts).  At most ``sample_rows`` labelled documents (those
with the smallest hash of the id) give the training matrix; the driver
bins each statistic at its quantiles and grows trees from histograms of
gradients.  The trees are flattened into arrays (a node's children lie at
2i+1 and 2i+2), which tasks walk for all rows and trees at once.

Defined results: null and empty texts have the statistics of an empty text
and a score like any other.  Without labels every score is 0.5; with one
label only, that label's share.  A document labelled several times counts
once, with its lowest label.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from .common import held_out, map_text, quoted, saved, texts_of

#: Labelled documents in the training sample (bound of what the driver fits on).
SAMPLE_ROWS = 20_000
#: Histogram bins of a statistic, boosting rounds, depth, step, and least hessian and penalty of a leaf.
BINS, ROUNDS, DEPTH, STEP, LEAST, PENALTY = 64, 100, 4, 0.1, 2.0, 1.0
#: Score from which a document counts as good.
GOOD = 0.7

# Classes of bytes whose shares are statistics.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "stop": b".?",
    "comma": b",;:'\"()-",
    "shout": b"!",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
    "control": bytes([*range(9), 11, 12, 13, *range(14, 32), 127]),
    "beyond": bytes(range(0xC0, 0x100)),
}
_TABLE = np.zeros(256, dtype=np.uint8)
for _n, _bytes in enumerate(_CLASSES.values(), start=1):
    _TABLE[list(_bytes)] = _n

STATISTICS = [
    "log_bytes", *_CLASSES, "log_words", "word_length", "longest_word", "short_words", "distinct_words", "top_word",
    "doubled_words", "ends_in_sign", "capitalised", "shouted", "log_lines", "line_length", "repeated_lines", "blank_lines",
]


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    n = max(1, len(text))
    share = np.bincount(_TABLE[np.frombuffer(text, dtype=np.uint8)], minlength=len(_CLASSES) + 1)[1:] / n
    words = text.split()
    count = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    kinds = list(counts.items())
    signed = sum(c for w, c in kinds if w[-1] < 128 and not w[-1:].isalnum() and w[-1] not in b".,")
    capital = sum(c for w, c in kinds if 65 <= w[0] <= 90)
    shouted = sum(c for w, c in kinds if len(w) > 2 and w.isupper())
    lines = text.split(b"\n")
    return [
        np.log1p(len(text)),
        *share.tolist(),
        np.log1p(len(words)),
        float(sizes.mean()),
        np.log1p(float(sizes.max())),
        float((sizes <= 3).sum()) / count,
        len(counts) / count,
        top / count,
        sum(map(eq, words, words[1:])) / count,
        signed / count,
        capital / count,
        shouted / count,
        np.log1p(len(lines)),
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(not x.strip() for x in lines) / len(lines),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


class Trees:
    """Boosted trees in arrays of shape (trees, nodes)."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray, depth: int):
        self.base, self.feature, self.limit, self.value, self.depth = base, feature, limit, value, depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds: all trees of all rows advance one level at a time."""
        if not len(self.feature):
            return np.full(len(x), self.base)
        tree = np.arange(len(self.feature))
        node = np.zeros((len(x), len(tree)), dtype=np.int64)
        for _ in range(self.depth):
            over = np.take_along_axis(x, self.feature[tree, node], axis=1) > self.limit[tree, node]
            node = 2 * node + 1 + over
        return self.base + self.value[tree, node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Logistic gradient boosting from histograms."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes, inner = (1 << depth + 1) - 1, (1 << depth) - 1
    none = Trees(base, *(np.zeros((0, nodes), dtype=t) for t in (np.int64, np.float64, np.float64)), depth)
    if len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    feature = np.zeros((rounds, nodes), dtype=np.int64)
    limit = np.full((rounds, nodes), np.inf)
    value = np.zeros((rounds, nodes))
    raw = np.full(len(y), base)
    width = BINS + 1
    for t in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            gain = np.full((many, x.shape[1]), 0.0)
            cut = np.zeros((many, x.shape[1]), dtype=np.int64)
            for f in range(x.shape[1]):
                slot = (node - first) * width + binned[:, f]
                g = np.bincount(slot, slope, many * width).reshape(many, width)
                h = np.bincount(slot, bend, many * width).reshape(many, width)
                gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gr, hr = ga - gl, ha - hl
                better = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - ga**2 / (ha + PENALTY)
                better[(hl < LEAST) | (hr < LEAST)] = 0.0
                better = better[:, : len(edges[f])]
                if better.shape[1]:
                    cut[:, f] = better.argmax(axis=1)
                    gain[:, f] = better[np.arange(many), cut[:, f]]
            best = gain.argmax(axis=1)
            for k in range(many):
                if gain[k, best[k]] > 1e-9:
                    f = int(best[k])
                    feature[t, first + k], limit[t, first + k] = f, edges[f][cut[k, f]]
            over = x[np.arange(len(y)), feature[t, node]] > limit[t, node]
            node = 2 * node + 1 + over
        g = np.bincount(node - inner, slope, 1 << depth)
        h = np.bincount(node - inner, bend, 1 << depth)
        value[t, inner:] = STEP * g / (h + PENALTY)
        raw += value[t, node]
    return Trees(base, feature, limit, value, depth)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents that are not held out."""
    spark = docs.sparkSession
    named = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y"))
    named = named.filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.min("y").alias("y"))
    # A share of the hash range cuts the labels to about the sample before any are ranked, so no task holds it all.
    turn = F.shiftrightunsigned(F.xxhash64("id"), 1)
    share = min(1.0, (1.3 * sample_rows + 1000) / max(named.count(), 1))
    near = named.filter(turn <= F.lit(share * float(1 << 63)))
    chosen = saved(spark, near.orderBy(turn, "id").limit(sample_rows), "quality-sample")

    def run(texts: pa.Array) -> list[pa.Array]:
        x = matrix(texts_of(texts))
        return [pa.array(list(x), pa.list_(pa.float64()))]

    picked = (
        docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))
        .join(F.broadcast(chosen), "id")  # at most sample_rows rows of two numbers
        .dropDuplicates(["id"])
    )
    rows = map_text(picked, "t", ["id", "y"], [StructField("x", ArrayType(DoubleType()))], lambda: run).toArrow()
    rows = rows.sort_by("id")
    x = np.array(rows.column("x").combine_chunks().values).reshape(-1, len(STATISTICS))
    return fit(x, np.array(rows.column("y").to_pylist(), dtype=np.float64) > 0)


def score(docs: DataFrame, model: Trees, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: better)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = sent.value
        return lambda texts: [pa.array(trees.score(matrix(texts_of(texts))))]

    return map_text(docs, text_col, keep, [StructField("score", DoubleType())], make)
