"""Language identification by hierarchical discrimination.

A text is counted as hashed byte n-grams of its letters.  A family of
languages is predicted first (one linear support vector machine per
family); inside the family one-versus-one machines separate the closely
related languages and vote.

Training takes at most ``per_label`` documents of each label and about
``sample`` of all (those with
the smallest hash of the id, so the choice does not depend on order or
partitioning; a few less if their hashes lie thin).  Their features are made in tasks; the driver fits the
machines on those rows, which keep only the n-grams that occur.  Every document is then predicted from
its whole text.

Defined results: a null text or one without any letter is ``und`` with
score 0, as is every text when no label was learned.  With a single
label, that label.  Rows that repeat an id or a text get equal results.
Equal chances of families and equal votes of languages go to the first
one in alphabetical order.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField

from .common import held_out, joined, map_text, quoted, saved, texts_of

#: Documents of each label in the training sample (bound of what the driver fits on).
PER_LABEL = 800
#: Documents of the training sample in all; shared among the labels, one of each at least.
SAMPLE = 16_000
#: Hashed features of each n-gram length.
BINS = 1 << 12
GRAMS = (2, 3)
UNKNOWN = "und"

# Families of common language codes (fixed values); any other label is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn mr ur ne gu pa",
    "cjk": "zh ja ko",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

# Letters keep their bytes (A-Z and the Latin-1 capitals lower-cased); other ASCII becomes a space.
_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8
)
_LETTER = regex.compile(r"\p{L}")


def family_of(label: str) -> str:
    return _FAMILY.get(label.lower().split("-")[0].split("_")[0], "only:" + label)


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts = joined(texts, b"  ")
    out = _FOLD[data]
    if len(data):
        capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        out[1:][capital] += 32
    return out, starts


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram counts, scaled to length 1; one row per text."""
    data, starts = folded(texts)
    n = len(texts)
    row = np.repeat(np.arange(n, dtype=np.int64) * BINS, np.diff(starts))
    out = np.empty((n, BINS * len(GRAMS)), dtype=np.float32)
    wide = data.astype(np.uint32)
    blank = data == 32
    # No n-gram begins at the blank before the next text: it would count the neighbour's letters for this row.
    last = np.zeros(len(data), dtype=bool)
    last[starts[1:] - 1] = True
    for g, size in enumerate(GRAMS):
        count = len(wide) - size + 1
        if count <= 0:
            out[:, g * BINS : (g + 1) * BINS] = 0
            continue
        code = wide[:count].copy()
        for j in range(1, size):
            code = code * np.uint32(256) + wide[j : count + j]
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
        use = ~(blank[:count] & blank[1 : count + 1]) & ~last[:count]
        hits = np.bincount((row[:count] + slot)[use], minlength=n * BINS)
        out[:, g * BINS : (g + 1) * BINS] = hits[: n * BINS].reshape(n, BINS)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


class Rows:
    """Sparse rows: ``at`` (columns) and ``value`` of row i lie from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, starts: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
        self.starts, self.at, self.value, self.width = starts, at, value, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[self.starts[i] : self.starts[i + 1]], self.value[self.starts[i] : self.starts[i + 1]]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.array([v @ w[at] for at, v in map(self.row, range(len(self)))])


def fit_svm(x: Rows, chosen: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30, stop: float = 1e-3, seed: int = 1) -> np.ndarray:
    """A linear support vector machine (squared hinge, dual coordinate descent) on the ``chosen`` rows, ``y`` being
    theirs; the last weight is the bias.  A round that changes no dual variable by ``stop`` is the last."""
    y = y.astype(np.float64)
    own = np.array([v @ v for _, v in map(x.row, chosen)], dtype=np.float64) + 1 + 1 / (2 * cost)  # 1 for the bias
    alpha, w, bias = np.zeros(len(chosen)), np.zeros(x.width), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(chosen)):
            at, value = x.row(chosen[i])
            slope = y[i] * (value @ w[at] + bias) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - slope / own[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * value
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < stop:
            break
    return np.append(w, bias)


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Scale that turns margins into chances: least logistic loss on the training margins."""
    slopes = np.linspace(0.5, 12, 47)
    return float(slopes[np.argmin([np.logaddexp(0, -s * margin * y).mean() for s in slopes])])


class Model:
    """Family machines and the one-versus-one machines inside each family."""

    def __init__(self, x: Rows, labels: list[str]):
        labels = np.array(labels, dtype=object)
        own = np.array([family_of(v) for v in labels], dtype=object)
        self.families = sorted(set(own.tolist()))
        self.labels = {f: sorted(set(labels[own == f].tolist())) for f in self.families}
        whole = np.arange(len(x))
        self.outer = [self._machine(x, whole, own == f) for f in self.families] if len(self.families) > 1 else []
        self.inner = {}
        for f in self.families:
            for a, b in combinations(self.labels[f], 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                self.inner[a, b] = self._machine(x, rows, labels[rows] == a)

    @staticmethod
    def _machine(x: Rows, rows: np.ndarray, is_first: np.ndarray) -> tuple[np.ndarray, float]:
        y = np.where(is_first, 1.0, -1.0)
        w = fit_svm(x, rows, y)
        return w.astype(np.float32), fit_slope(x.times(w[:-1])[rows] + w[-1], y)

    @staticmethod
    def _chance(machine: tuple[np.ndarray, float], x: np.ndarray) -> np.ndarray:
        w, slope = machine
        return 1 / (1 + np.exp(-slope * (x @ w[:-1] + w[-1])))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        if self.outer:
            chance = np.column_stack([self._chance(m, x) for m in self.outer]).astype(np.float64)
            chance /= chance.sum(axis=1, keepdims=True)
        else:
            chance = np.ones((n, 1))
        family = chance.argmax(axis=1)
        label, score = np.empty(n, dtype=object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            names = self.labels[f]
            votes, sure = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for i, j in combinations(range(len(names)), 2):
                first = self._chance(self.inner[names[i], names[j]], x[rows])
                votes[:, i] += first >= 0.5
                votes[:, j] += first < 0.5
                sure[:, i] += first
                sure[:, j] += 1 - first
            best = (votes + sure / (len(names) + 1)).argmax(axis=1)
            label[rows] = np.array(names, dtype=object)[best]
            within = sure[np.arange(len(rows)), best] / max(1, len(names) - 1) if len(names) > 1 else 1.0
            score[rows] = chance[rows, k] * within
        return label, np.clip(score, 0.0, 1.0)


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_label: int = PER_LABEL,
    sample: int = SAMPLE,
) -> Model | None:
    """Fit on at most ``per_label`` labelled documents of each label and ``sample`` of all (but one of each label at
    least); None if there is none."""
    spark = docs.sparkSession
    named = docs.select(
        F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"), F.col(quoted(label_col)).cast("string").alias("label")
    ).filter(F.col("label").isNotNull() & ~held_out("id"))
    # Ids first (no text is read for that), then the texts of those few.  A share of the hash range cuts each
    # label to about the sample before it is ranked, so a label of very many documents does not meet in one task.
    ids = named.select("id", "label").distinct()
    counts = saved(spark, ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "language-labels")
    per_label = max(1, min(per_label, sample // max(1, counts.count())))
    # So small a share of a sample of few would often hold none: at least 20 are expected.
    share = counts.select("label", (F.lit(float(max(1.3 * per_label, 20))) / F.col("n")).alias("share"))
    near = ids.join(F.broadcast(share), "label").filter(  # one row of two values for each label
        F.shiftrightunsigned(F.xxhash64("id"), 1) <= F.col("share") * float(1 << 63)
    )
    turn = F.expr("row_number() OVER (PARTITION BY label ORDER BY shiftrightunsigned(xxhash64(id), 1), id)")
    chosen = saved(spark, near.withColumn("turn", turn).filter(F.col("turn") <= per_label), "language-sample")
    picked = named.join(F.broadcast(chosen.select("id", "label")), ["id", "label"], "left_semi").dropDuplicates(["id", "label"])

    def run(texts: pa.Array) -> list[pa.Array]:
        x = features(texts_of(texts))
        at = [np.flatnonzero(r).astype(np.int32) for r in x]
        return [
            pa.array(at, pa.list_(pa.int32())),
            pa.array([r[i] for r, i in zip(x, at)], pa.list_(pa.float32())),
        ]

    fields = [StructField("at", ArrayType(IntegerType())), StructField("value", ArrayType(FloatType()))]
    rows = map_text(picked.filter(F.col("t").isNotNull()), "t", ["id", "label"], fields, lambda: run).toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("label", "ascending"), ("id", "ascending")])
    at, value = rows.column("at").combine_chunks(), rows.column("value").combine_chunks()
    x = Rows(at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy(), BINS * len(GRAMS))
    return Model(x, rows.column("label").to_pylist())


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = sent.value

        def run(texts: pa.Array) -> list[pa.Array]:
            raw = texts_of(texts)
            lettered = np.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in raw], dtype=bool)
            label, score = np.full(len(raw), UNKNOWN, dtype=object), np.zeros(len(raw))
            if known is not None and lettered.any():
                rows = np.flatnonzero(lettered)
                label[rows], score[rows] = known.predict(features([raw[i] for i in rows]))
            return [pa.array(label.tolist(), pa.string()), pa.array(score)]

        return run

    return map_text(docs, text_col, keep, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make)


def keep_identified(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.0
) -> DataFrame:
    """The documents whose language is identified (not ``und``, and scored ``least_score`` or more); columns as they were."""
    out = predict(docs, model, docs.columns, text_col).toDF(*[f"k{i}" for i in range(len(docs.columns))], "pred", "score")
    clear = out.filter((F.col("pred") != UNKNOWN) & (F.col("score") >= least_score))
    return clear.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
