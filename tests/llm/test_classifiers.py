import numpy as np
import pytest

from tablesteps.llm import language_id as I
from tablesteps.llm import quality as Q

from .helpers import docs, odd_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(spark, documents):
    model = I.train(documents, per_label=150)
    out = I.predict(documents, model, ["doc_id", "lang"]).withColumn("held", I.held_out("doc_id")).collect()
    held = [r for r in out if r.held]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert set(model.families) == {"germanic", "romance"} and ("de", "en") in model.inner and ("de", "fr") not in model.inner


def test_language_defined_cases(spark, documents):
    model = I.train(documents, per_label=50)
    df = odd_docs(spark, [(1, None), (2, ""), (3, "123 !? ***"), (4, "the and of the that with " * 3000), (4, "the and of the that with " * 3000), (None, "der die das und nicht")])
    out = I.predict(df, model, df.columns)
    got = {r["a.b"]: r.lang_pred for r in out.collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "en", 4: "en", 5: "de"}
    kept = I.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r["a.b"] for r in kept.collect()) == [3, 4, 5]
    none = docs(spark, []).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert I.train(none) is None
    assert I.predict(df, None, ["doc_id"]).select("lang_pred", "score").distinct().collect() == [("und", 0.0)]
    assert I.predict(docs(spark, []), model, ["doc_id"]).collect() == []


def test_language_one_label_and_unknown_families(spark):
    one = spark.createDataFrame([(i, "words here", "xx") for i in range(40)], "doc_id long, text string, lang string")
    got = I.predict(one, I.train(one), ["doc_id"]).first()
    assert got.lang_pred == "xx" and got.score == 1.0
    two = spark.createDataFrame([(i, "ab " * 9 if i % 2 else "xy " * 9, "q1" if i % 2 else "q2") for i in range(80)], "doc_id long, text string, lang string")
    assert {(r.doc_id % 2, r.lang_pred) for r in I.predict(two, I.train(two), ["doc_id"]).collect()} == {(1, "q1"), (0, "q2")}


def test_training_sees_neither_held_out_rows_nor_order(spark, documents):
    one = I.train(documents, per_label=40)
    hidden = documents.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'zz', lang) AS lang")
    two = I.train(hidden.repartition(7), per_label=40)
    assert one.labels == two.labels
    assert all(np.allclose(a[0], b[0]) for a, b in zip(one.outer, two.outer))


def features_by_brute_force(text):
    """The n-grams of one text, counted one by one."""
    raw = bytearray(text.encode())
    for i, c in enumerate(raw):
        if 65 <= c <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
            raw[i] = c + 32
        elif c < 128 and not 97 <= c <= 122:
            raw[i] = 32
    raw += b"  "
    out = np.zeros(2 * I.BINS)
    for g, size in enumerate(I.GRAMS):
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            if gram[:2] != b"  ":
                out[g * I.BINS + (int.from_bytes(gram, "big") * 2654435761 % 2**32 >> 20)] += 1
    out = np.sqrt(out)
    return out / max(np.sqrt((out * out).sum()), 1e-12)


def predicted_by_brute_force(model, x):
    def sure(machine):
        w, slope = machine
        return 1 / (1 + np.exp(-slope * (sum(float(a) * float(b) for a, b in zip(x, w)) + float(w[-1]))))

    family = max(zip(model.families, model.outer), key=lambda m: sure(m[1]))[0] if model.outer else model.families[0]
    names = model.labels[family]
    votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            p = sure(model.inner[a, b])
            votes[a if p >= 0.5 else b] += 1
            total[a] += p
            total[b] += 1 - p
    return max(names, key=lambda n: (votes[n], total[n]))


def test_language_against_brute_force(spark, documents):
    texts = ["", "Über Äpfel ÉCOLE × x", "a", "the end", "日本語 text", "mixed 123 CASE--words"]
    got = I.features([t.encode() for t in texts * 2])
    for i, t in enumerate(texts * 2):  # whatever stands beside it
        assert np.allclose(got[i], features_by_brute_force(t), atol=1e-6), t
    model = I.train(documents, per_label=60)
    rows = I.predict(documents.limit(60), model, ["doc_id", "text"]).collect()
    assert len(rows) == 60
    for r in rows:
        want = predicted_by_brute_force(model, features_by_brute_force(r.text)) if r.text and any(c.isalpha() for c in r.text) else "und"
        assert r.lang_pred == want


def test_sparse_machine_equals_a_dense_one():
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)), 0.0)
    dense[5] = 0  # a row without n-grams
    at = [np.flatnonzero(r) for r in dense]
    x = I.Rows(np.cumsum([0, *map(len, at)]), np.concatenate(at), np.concatenate([r[i] for r, i in zip(dense, at)]), 40)
    chosen = np.flatnonzero(rng.random(60) < 0.8)
    y = np.where(dense[chosen, 0] + dense[chosen, 1] > dense[chosen, 2], 1.0, -1.0)
    w = I.fit_svm(x, chosen, y, rounds=20_000, stop=1e-7)
    assert np.allclose(x.times(w[:-1]), dense @ w[:-1])
    # At the optimum the gradient of the squared hinge loss is zero.
    slack = np.maximum(0, 1 - y * (dense[chosen] @ w[:-1] + w[-1]))
    assert np.allclose(w[:-1], 8.0 * (slack * y) @ dense[chosen], atol=1e-4)


def test_language_sample_is_bounded_in_all(spark, monkeypatch):
    rows = [(i, f"word{i % 30} text of label", f"l{i % 30}") for i in range(3000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    real = I.Model.__init__
    monkeypatch.setattr(I.Model, "_machine", staticmethod(lambda x, r, first: (np.zeros(x.width + 1, np.float32), 1.0)))
    monkeypatch.setattr(I.Model, "__init__", lambda self, x, labels: (sizes.append((len(x), len(set(labels)))), real(self, x, labels))[1])
    I.train(labelled, per_label=40, sample=90)
    I.train(labelled, per_label=2, sample=90)
    I.train(labelled, per_label=40, sample=10)
    assert sizes == [(90, 30), (60, 30), (30, 30)]  # shared by all; fewer wanted; one of each at least


def test_quality_held_out_accuracy(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(documents, labels)
    rows = Q.score(documents, model, ["doc_id"]).withColumn("held", Q.held_out("doc_id")).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([a > b for a in good for b in bad])
    assert auc > 0.97 and np.mean([s >= Q.GOOD for s in good]) > 0.95


def test_trees_learn_and_walk_like_plain_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = Q.fit(x, y, rounds=40)
    assert np.mean((model.score(x) > 0.5) == y) > 0.97

    def walk(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.limit[t, node])
            total += model.value[t, node]
        return total

    assert np.allclose([walk(r) for r in x[:50]], model.raw(x[:50]))


def test_quality_defined_cases(spark):
    df = odd_docs(spark, [(1, None), (2, ""), (3, "a fine text " * 9000), (3, "a fine text " * 9000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    empty = Q.train(df, none)
    assert {r.score for r in Q.score(df, empty, df.columns).collect()} == {0.5}
    same = spark.createDataFrame([(i, 1) for i in range(20)] + [(1, None), (None, 0)], "doc_id long, quality int")
    scores = {r["a.b"]: r.score for r in Q.score(df, Q.train(df, same), df.columns).collect()}
    assert scores[0] == scores[1] and scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())
    assert Q.score(docs(spark, []), empty, ["doc_id"]).collect() == []
    assert len(Q.statistics(b"")) == len(Q.STATISTICS) and not np.isnan(Q.statistics(b"")).any()
