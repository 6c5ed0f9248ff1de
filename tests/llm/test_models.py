import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import bradleyterry as bt
from veldspar.llm import ordinal


def corpus(seed=4, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["zzgrok", "zzblam", "zzfump", "zzdrat"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for b in rng.sample(bad, rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), b + rng.choice(["", ",", "ish"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    return docs, labels


def test_ordinal(spark, docs_of):
    docs, labels = corpus()
    df = docs_of([*docs, (900, None), (901, ""), (None, "some text"), (3, docs[3][1])])
    known = spark.createDataFrame([*labels[:300], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(df, known, ordinal.Settings(steps=60))
    assert len(model.thresholds) == 3 and np.all(np.diff(model.thresholds) > 0)
    scored = ordinal.score(df, model)
    assert scored.columns == ["doc_id", "text", "score", "fp", "severity", "p_toxic"] and scored.count() == len(docs) + 4
    got = {r.doc_id: r for r in scored.collect()}
    held = [i for i, _, y in labels[300:]]
    right = sum((got[i].p_toxic >= 0.5) == (labels[i][2] == 1) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.severity <= 3 for r in got.values()) and got[900].severity == got[901].severity
    none = ordinal.fit(df, known.limit(0))
    assert {r.severity for r in ordinal.score(df, none).collect()} == {0.0}
    assert ordinal.score(df.limit(0), model).count() == 0


def minus_likelihood(x, rows, y, size):
    """Row by row, from the definition of the model."""
    theta, total = [x[size]], 0.0
    for gap in x[size + 1 :]:
        theta.append(theta[-1] + math.exp(gap))
    below = lambda k, eta: 0.0 if k < 0 else 1.0 if k == len(theta) else 1 / (1 + math.exp(eta - theta[k]))
    for cols, grade in zip(rows, y, strict=True):
        eta = sum(x[c] for c in cols)
        total -= math.log(below(grade, eta) - below(grade - 1, eta))
    return total


@pytest.mark.parametrize(("grades", "seed"), [(2, 1), (3, 2), (4, 3), (4, 4)])
def test_ordinal_gradient_by_finite_differences(grades, seed):
    rng, size = np.random.default_rng(seed), 6
    rows = [sorted(rng.choice(size, rng.integers(0, size), replace=False).tolist()) for _ in range(40)]
    y = rng.integers(0, grades, 40)
    x = rng.normal(size=size + grades - 1)
    got = ordinal.loss_gradient(x, np.repeat(np.arange(40), [len(r) for r in rows]), np.array([c for r in rows for c in r], np.int64), y, size)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert abs((minus_likelihood(x + step, rows, y, size) - minus_likelihood(x - step, rows, y, size)) / 2e-5 - got[i]) < 1e-4


def test_ordinal_fit_maximises_the_likelihood(spark):
    """No step along any parameter improves the brute-force penalised likelihood of the sample noticeably."""
    docs, labels = corpus(n=120)
    s = ordinal.Settings(steps=90)
    model = ordinal.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), s)
    place, bad = ordinal._Features(s.buckets, model.words), ("zzgrok", "zzblam", "zzfump", "zzdrat")
    rows = [place.of(t) for _, t in docs]
    y = [min(len({w for w in t.split() if w.startswith(bad)}), 3) for _, t in docs]  # here the marker words are those planted
    assert {i for i, g in enumerate(y) if g} == {i for i, _, toxic in labels if toxic}
    size = len(model.words)
    x = np.concatenate((model.weights, model.thresholds[:1], np.log(np.diff(model.thresholds))))
    value = lambda v: minus_likelihood(v, rows, y, size) / len(rows) + 3e-4 / 2 * float((v[:size] ** 2).sum())
    best = value(x)
    for i in range(len(x)):
        for step in (-0.3, 0.3):
            moved = x.copy()
            moved[i] += step
            assert value(moved) > best - 5e-3


def test_toxic_documents_of_the_other_half(spark):
    """At the query's settings: fitted on half of the labels, at least 0.9 of the other half's toxic documents go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    s = ordinal.Settings()
    scored = ordinal.score(docs.join(labels.filter(~half), "doc_id").select("doc_id", "text", "toxic"), ordinal.fit(docs, labels.filter(half), s))
    counts = {(r.toxic, r.gone): r["count"] for r in scored.groupBy("toxic", (F.col("p_toxic") >= s.reject_at).alias("gone")).count().collect()}
    assert counts[1, True] >= 0.9 * (counts[1, True] + counts[1, False])
    assert counts[0, True] <= 0.01 * (counts[0, True] + counts[0, False])


def test_toxicity_of_a_very_long_text(spark, docs_of):
    docs, labels = corpus(n=120)
    model = ordinal.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    long = "bado " * 400_000
    got = {r.doc_id: r.p_toxic for r in ordinal.score(docs_of([(1, long), (2, long + "zzgrok zzblam zzfump"), (3, "x" * 2_000_000)]), model).collect()}
    assert got[1] < 0.5 < got[2] and got[3] < 0.5  # the last words count like the first


def quality_docs(n=300):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        good = i % 4 > 0
        docs.append((i, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_bradley_terry(spark, docs_of):
    docs, labels = quality_docs()
    df = docs_of([*docs, (900, None), (901, ""), (902, "x" * 200000), (None, "some text"), (3, docs[3][1])])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = bt.fit(df, known)
    rows = bt.score(df, model).collect()
    assert len(rows) == len(docs) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    crossed = spark.createDataFrame([(i, 1 - y if bt_held else y, 0) for (i, y, _), bt_held in zip(labels, [r.h for r in spark.range(len(labels)).select(bt.held_out(F.col("id")).alias("h")).collect()], strict=True)], "doc_id long, quality int, toxic int")
    again = bt.fit(df, crossed)  # labels of held-out rows aren't read
    assert np.allclose(again.weights, model.weights)
    assert bt.score(df.limit(0), model).count() == 0
    assert len({r.score for r in bt.score(df, bt.fit(df, known.limit(0))).collect()}) == 1  # nothing was learnt


def test_quality_learns_from_every_label(spark):
    """16,000 labels: the threshold is the quantile of all documents that aren't held out, and each of them is in a pair."""
    docs, labels = quality_docs(500)
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    copies = spark.range(32).select((F.col("id") * 500).alias("shift"))
    spread = lambda t: t.crossJoin(F.broadcast(copies)).withColumn("doc_id", F.col("doc_id") + F.col("shift")).drop("shift")
    df = spread(df).withColumn("text", F.concat("text", F.lit(" "), F.sha2(F.col("doc_id").cast("string"), 256)))
    model = bt.fit(df, spread(known))
    rows = df.join(spread(known), "doc_id").filter(~bt.held_out(F.col("doc_id"))).select("text", "quality").toArrow()
    scores, bad = np.sort(bt.features(rows.column("text").combine_chunks()).astype(np.float32).astype(float) @ model.weights), rows.column("quality").to_pylist().count(0)
    assert len(scores) > 12_500 and abs(model.threshold - (scores[bad - 1] + scores[bad]) / 2) < 1e-9


@pytest.mark.parametrize(("good", "bad"), [(300, 20), (20, 300), (1, 200), (130, 129), (1, 1)])
def test_every_labelled_document_is_in_a_pair(spark, good, bad):
    n = good + bad
    unit = [np.eye(1, bt.DIMS, i % bt.DIMS, dtype=np.float32)[0] * (1 + i // bt.DIMS) for i in range(n)]
    ranked = spark.createDataFrame([(i, int(i < good), bytearray(unit[i].tobytes())) for i in range(n)], "doc_id long, y int, x binary")
    met = np.array([np.frombuffer(r.d, np.float32) for r in bt.pairs(ranked, {0: bad, 1: good}, bt.Settings()).collect()])
    assert len(met) >= min(3, min(good, bad)) * max(good, bad)
    held = {(int(c), float(v)) for row in met for c, v in zip(np.nonzero(row)[0], row[np.nonzero(row)[0]], strict=True)}
    sign = [1 if i < good else -1 for i in range(n)]
    seen = sum((i % bt.DIMS, float(sign[i] * (1 + i // bt.DIMS))) in held for i in range(n))
    assert seen >= n - 1  # a pair's common column may hide one of the two


def test_newton_matches_a_closed_form(spark):
    import pyarrow as pa

    from veldspar.llm.common import newton, written

    rows = written(spark.createDataFrame([(float(i),) for i in range(10)], "x double"), "t")

    def derivatives(w, batch: pa.RecordBatch):
        x = batch.column(0).to_numpy()
        return float(((w[0] - x) ** 2).sum()) / 2, np.array([(w[0] - x).sum()]), np.array([[float(len(x))]])

    assert abs(newton(rows, derivatives, 1, l2=0.0)[0] - 4.5) < 1e-9
