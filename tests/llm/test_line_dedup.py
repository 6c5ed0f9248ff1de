import collections
import random

import numpy as np
import pytest

from veldspar.llm import linehash

WHITE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=20, min_docs=3):
    holders = collections.defaultdict(list)
    for i, t in rows:
        for key in {lower(x.strip(WHITE)) for x in (t or "").split("\n")}:
            holders[key].append(i)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            key = lower(x.strip(WHITE))
            ids = holders[key]
            most = max((j for j in ids if j is not None), default=None)
            if len(key) < min_chars or len(ids) < min_docs or i == most:
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept).encode()))
    return sorted(out, key=str)


def found(df, **more):
    return sorted(((r[0], r[1], r[2], bytes(r[3])) for r in linehash.deduplicated(df, **more).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["ÄÖÜ", "alpha", "beta", "Gamma", "ΔΕΛΤΑ", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        lines = [rng.choice(["", " ", "\t", " "]) + rng.choice([str.upper, str, str])(rng.choice(pool)) + rng.choice(["", "  ", "\r"]) for _ in range(rng.randint(0, 8))]
        lines += ["A line that a third of all documents hold"] * (i % 3 == 0)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "a" * 300_000 + "\n" + "b" * 20)]
    rows += [(7, rows[7][1]), (None, "no id here but a long line"), (None, "no id here but a long line"), (None, "NO ID here but a long line\nmore"), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("more", [{}, {"shard_keys": 7}, {"shard_keys": 7, "limit_bytes": 0, "probes": 20}, {"limit_bytes": 0}])
def test_against_brute_force(spark, docs_of, more):
    rows = rows_of(len(more))
    assert found(docs_of(rows), **more) == brute(rows)
    assert found(docs_of(rows), min_chars=5, min_docs=2, **more) == brute(rows, 5, 2)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_few_rows(docs_of, limit):
    assert found(docs_of([]), limit_bytes=limit) == []
    assert found(docs_of([(1, None)]), limit_bytes=limit) == [(1, 1, 0, b"")]
    three = [(i, "One and the same line here") for i in (1, 2, 9)]
    assert found(docs_of(three), limit_bytes=limit) == [(1, 1, 1, b""), (2, 1, 1, b""), (9, 1, 0, three[0][1].encode())]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
    if n > 2:
        keys[1, 0] = keys[0, 0]  # halves may agree
    sizes, bits = linehash.build(keys)
    s = linehash.Shard(sizes.tobytes(), bits.tobytes(), b"", b"", b"")
    assert sorted(s.number(keys).tolist()) == list(range(len(keys)))
    assert 8 * len(bits) <= 8 * n + 128
    others = rng.integers(0, 1 << 63, (1000, 2)).astype(np.uint64)
    full = linehash.Shard(sizes.tobytes(), bits.tobytes(), keys[np.argsort(s.number(keys)), 1].tobytes(), np.zeros(n, np.int64).tobytes(), np.zeros(n, np.int64).tobytes())
    assert full.probe(keys)[0].all()
    assert not full.probe(others)[0].any()
