import numpy as np
import pytest

from veldspar.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tag int"


def brute(rows, every, positives=5, negatives=10):
    v = [(i, lab, np.floor(256 * np.array(x, np.float64)).astype(int)) for i, x, lab in rows]
    out = []
    for a, lab, x in v:
        if a % every:
            continue
        scores = sorted((-int(x @ y), i, k == lab) for i, k, y in v if i != a)
        for s, p, _ in [t for t in scores if t[2]][:positives]:
            ok = [t for t in scores if not t[2] and -30 * s <= -100 * t[0] <= -90 * s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "dims"), [(0.3, 64), (1.0, 10), (40.0, 96), (0.0, 3)])
def test_exact(spark, scale, dims, monkeypatch):
    monkeypatch.setattr(hardneg, "SLICE_BYTES", 8 * dims * 20)  # several passes
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((4, dims))
    rows = [(i, (scale * (middles[i % 5 % 4] + rng.standard_normal(dims))).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(1000 + i, rows[1][1], i % 3) for i in range(90)]  # a common vector: ties
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hardneg.mine(df, df.filter("vec_id % 10 = 0"))
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute(rows, 10)


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(1)
    exact = np.floor(256 * rng.standard_normal((300, 64)) / 8).astype(np.int64)
    codes, align, rest = hardneg.encode(exact)
    asked = hardneg.Asked(np.arange(20), np.zeros(20), exact[:20])
    score, known, error = exact[:20] @ exact.T, 0.0, 0.0
    for level in range(hardneg.LEVELS):
        t = asked.product(level, np.arange(20)[:, None], codes[level][None])
        known, error = known + t * align[level], error + align[level] * asked.error[level][:, None]
        assert (np.abs(score - known) <= error + rest[level] * asked.norm[:, None] + 1e-3).all()
    assert (rest[-1] < 0.2 * np.sqrt((exact**2).sum(axis=1))).all()
    z = hardneg.rotated(hardneg.rotated(exact.astype(float), 1), 1, back=True)
    assert np.allclose(z, exact)


def test_few_rows_are_scored():
    rng = np.random.default_rng(2)
    exact = np.floor(256 * rng.standard_normal((2000, 64)) / 8).astype(np.int64)
    block = (np.arange(2000), np.zeros(2000, np.int64), exact, *hardneg.encode(exact))
    asked = hardneg.Asked(np.arange(30), np.zeros(30, np.int64), exact[:30])
    low, high = np.full(30, -(1 << 62)), np.full(30, 1 << 62)
    window, row, score = hardneg.best_of_block(block, asked, np.arange(30), low, high, np.full(30, -np.inf), True, 5)
    assert len(window) < 30 * 2000 / 20
    for w in range(30):
        assert sorted(score[window == w])[-5:] == sorted(np.delete(exact @ exact[w], w))[-5:]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None)]
    rows += [(6, [2.0], 1), (7, [1.0, 5.0], 2), (7, [1.0, 5.0], 2), (8, [], 2), (9, [0.0, 9.0], 1), (0, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hardneg.mine(df, df.filter("vec_id = 0")).select("positive_id", "rank", "negative_id").collect())
    assert got == [(6, 1, 7), (6, 2, 7), (9, 1, 8)]
    assert hardneg.mine(df.limit(0), df).count() == 0
    assert hardneg.mine(df, df.limit(0)).count() == 0
    assert hardneg.mine(df.filter("vec_id = 6"), df.filter("vec_id = 6")).count() == 0
    with pytest.raises(ValueError, match="too large"):
        hardneg.mine(spark.createDataFrame([(0, [3e9], 1, "x", 1)], "vec_id long, embedding array<double>, label int, score string, tag int"), df)
