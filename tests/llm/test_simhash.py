import random

import numpy as np
import pytest
import xxhash

from veldspar.llm import simhash as s
from veldspar.llm.common import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {v: min(g) for g in groups.values() for v in g}


@pytest.mark.parametrize("text", ["", " \n\t", "One", "a b c", "A b C d", "ÄÖ ä\u00a0b c d e f", "x " * 5000, "the quick  brown\tfox jumps over the lazy dog " * 3])
def test_fingerprint(text):
    assert s.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.sql("select xxhash64('the quick brown fox') h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_against_brute_force(spark, crowd):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = set(seeds)
    for x in seeds[:20]:
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = s.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd)
    for r in links.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4
    found = {r.v: r.root for r in components(links).collect()}
    expected = brute_components(signed, signed)
    assert {v: found.get(v, v) for v in signed} == expected


def test_edge_cases(docs_of):
    long = "word " * 30000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same text here you see"), (5, "SAME text\there you   see"), (4, "same text here you see"), (6, long), (7, long), (None, "alone in the world is it")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in s.near_duplicates(docs_of(rows)).collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 4, 4), (False, 5, 4), (False, 6, 6), (False, 7, 6), (True, 0, None)]
    assert s.near_duplicates(docs_of([])).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = s.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    assert all(r.fp & (1 << 64) - 1 == plain_fingerprint(texts[r.doc_id]) for r in got[:40])
    assert {r.doc_id: r.component_id for r in got} == brute_components([r.doc_id for r in got], [r.fp for r in got])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7)]
    found = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 300)}}
    assert np.all([r == 0 for v, r in found.items() if v <= 50])


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_similar(texts, least=0.8):
    """Group number of each text: components of the pairs with so similar sets of shingles."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(0, 1))]
    return words


def test_similar_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five", "one two three four six"]
    for size in (12, 40, 150, 600):
        for _ in range(12):
            base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(size)]
            texts += [" ".join(edited(rng, base, rng.randint(0, max(1, size // 40)))) for _ in range(rng.randint(1, 5))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.key: r.group for r in s.similar(df, "doc_id").collect()}
    assert same_partition([got[i] for i in range(len(texts))], brute_similar(texts))
    assert s.similar(df.limit(0), "doc_id").count() == 0


def test_a_crowd_of_near_copies_is_one_group(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(900)] + [" ".join(rng.choices(base, k=100)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r.group for r in s.similar(df, "doc_id", s=s.Similar(heavy=100)).collect()}
    assert same_partition([got[i] for i in range(len(texts))], brute_similar(texts))


@pytest.mark.parametrize("settings", [s.Similar(), s.Similar(small=2, heavy=8)])
def test_crowds_that_are_not_one_component(spark, settings):
    """Copies with so many edits that few pairs are similar, chains among them, and a passage that other texts share."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [" ".join(edited(rng, base, rng.randint(1, 8))) for _ in range(400)]
    texts += [" ".join([*passage, *[word() for _ in range(rng.randint(5, 60))]]) for _ in range(200)]
    texts += [" ".join([*passage, *edited(rng, t.split()[60:], 1)]) for t in texts[400:440]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r.group for r in s.similar(df, "doc_id", s=settings).collect()}
    expected = brute_similar(texts)
    assert 100 < len(set(expected)) < 500
    assert same_partition([got[i] for i in range(len(texts))], expected)
