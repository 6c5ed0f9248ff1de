import random

import numpy as np
import pytest

from veldspar.llm import bitslice, decontam


def brute_top(vectors, every, k=5):
    v = [(i, np.floor(256 * np.array(x, np.float64)).astype(int)) for i, x in vectors]
    out = set()
    for q, x in v:
        if q % every == 0:
            scores = sorted((-int(x @ y), i) for i, y in v if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("scale", [0.0, 0.2, 40.0])
def test_top_k_exact(spark, scale):
    rng = np.random.default_rng(3)
    vectors = [(i, (scale * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(12)]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumnRenamed("embedding", "embedding")
    got = {tuple(r) for r in bitslice.search(df, df.filter("vec_id % 20 = 0")).collect()}
    assert got == brute_top(vectors, 20)


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [3.0]), (6, [-1.0, 0.5]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in bitslice.search(df, df).filter("query_id = 0").collect())
    assert got == [(0, 1, 5, 256 * 768), (0, 2, 6, -256 * 256 + 512 * 128), (0, 3, 7, 0)]
    with pytest.raises(ValueError, match="too large"):
        bitslice.search(spark.createDataFrame([(0, [3e9])], "vec_id long, embedding array<double>"), df)
    empty = df.limit(0)
    assert bitslice.search(empty, empty).count() == 0
    one = df.filter("vec_id = 0")
    assert bitslice.search(one, one).count() == 0


def words(rng, n):
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, 25 + i)).capitalize() + ".") for i in range(12)]
    docs, planted = [], set()
    for d in range(80):
        text = words(rng, rng.randint(5, 300))
        if d % 4 == 0:
            i = d // 4 % 12
            item = items[i][1].split()
            if d % 8 == 0:  # reworded: every seventh word changed, every ninth gone
                item = [w if k % 7 else "changed" for k, w in enumerate(item) if k % 9 != 4]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() if d % 12 == 0 else w for w in item]
            planted.add((d, i))
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, ""), (902, "..."), (None, "nothing of it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, ""), (51, None), (52, "!!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == planted
    sliced = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, decontam.Settings(slice_items=5)).collect()}
    assert sliced == planted
    assert decontam.leaks(df.limit(0), bench).count() == 0
    assert decontam.leaks(df, bench.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(2)
    for _ in range(60):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 30))], [rng.randrange(7) for _ in range(rng.randint(0, 40))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        mask = {}
        for i, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << i
        assert decontam.lcs(mask, len(a), b) == table[-1][-1]


def test_recall_of_whole_texts(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert exact <= got


def test_recall_does_not_depend_on_the_number_of_items(spark):
    rng = random.Random(4)
    texts = [words(rng, 160) for _ in range(1000)]
    docs = [(d, " ".join(t)) for d, t in enumerate(texts)]
    items = []
    for i in range(3000):
        d, size = i // 3, rng.randint(16, 50)
        at = i % 3 * 50 + rng.randint(0, 50 - size)
        items.append((i, " ".join(texts[d][at : at + size])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert {(i // 3, i) for i, _ in items} <= got


def test_items_of_frequent_words_and_without_ids(spark):
    rng = random.Random(5)
    common = "to be or not that is the question of a and in".split()
    docs = [(d, " ".join(rng.choices(common, k=200) + words(rng, 5))) for d in range(60)]
    item = "to be or not to be that is the question"
    docs += [(100, f"{docs[0][1]} {item} {docs[1][1]}"), (101, item.upper()), (102, "to be or not to be is the question"), (103, "a of"), (None, item), (104, item), (104, item)]
    rare = " ".join(words(rng, 30))
    docs.append((105, f"{docs[2][1]} {rare}"))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, cosine int")
    bench = spark.createDataFrame([(1, item), (None, rare), (3, None)], "item_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in decontam.leaks(df, bench, decontam.Settings(stop_idf=2.0)).collect()), key=str)
    assert {x for x in got if x[0] >= 100 or x[0] < 0} == {(100, 1), (101, 1), (102, 1), (-1, 1), (104, 1), (105, None)} and got.count((104, 1)) == 2
    small = decontam.Settings(stop_idf=2.0, slice_words=12, pass_slices=1)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in decontam.leaks(df, bench, small).collect()), key=str) == got


def test_reworded_items(spark):
    """Every fifth word of each item changed, every eleventh left out: most are found."""
    rng = random.Random(6)
    docs = [(d, " ".join(words(rng, 200))) for d in range(150)]
    items = [(i, words(rng, rng.randint(20, 60))) for i in range(150)]
    hold = [(d, f"{t[: len(t) // 2]} {' '.join(words(rng, 1)[0] if k % 5 == 2 else w for k, w in enumerate(items[d][1]) if k % 11 != 7)} {t[len(t) // 2 :]}") for d, t in docs]
    df, bench = spark.createDataFrame(hold, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert sum((i, i) in got for i in range(150)) >= 0.9 * 150 and all(a == b for a, b in got)


def test_items_of_common_words_among_rare_ones(spark):
    """Ten words of little weight, word for word, in windows whose other words weigh much."""
    rng = random.Random(9)
    common, docs = words(rng, 12), []
    for d in range(400):
        text = [f"rare{d}x{k}" for k in range(200)]
        for w in common:
            if rng.random() < 0.9:
                text[rng.randint(0, 199)] = w
        docs.append(text)
    items = [(i, " ".join(rng.choice(common) for _ in range(10))) for i in range(50)]
    for i, text in items:
        docs[i][80:80] = text.split()
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(50)} <= found
    assert all(d < 50 for d, _ in found)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(3)
    dense = (rng.standard_normal((60, 5)) @ rng.standard_normal((5, 40))).astype(np.float32)
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in dense], "col array<int>, val array<float>")
    found = decontam.randomised_svd(rows, 40, decontam.Settings(rank=5))
    want = np.linalg.svd(dense)[2][:5].T
    assert np.allclose(np.abs(np.sum(found * want, axis=0)), 1, atol=1e-3)
