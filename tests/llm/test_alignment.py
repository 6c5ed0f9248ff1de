import collections
import hashlib
import random

import numpy as np
import pytest

from veldspar.llm import aligned

TEXTS = [
    "The quick brown fox, jumping over 12,345 lazy dogs!", "Größe und Überfluß — naïve café", "日本語のテキスト と emoji 🎉🎉", "a", " ", "\n\n\t tab\r\nline  two   spaces", "",
    None, "<|endoftext|> <s> </s> <unk> [INST]", "already ▁ marked", "zero\0byte", "word " * 700, "x" * 3000, "Ünï" * 400 + " end", "1234567890" * 90, " nbsp​zero width",
]


@pytest.fixture(scope="module")
def pair():
    return aligned.Pair(aligned.Settings())


def brute_text(text, pair):
    """(a, b, links, groups) of byte ranges compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(aligned.Settings().a)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=aligned.Settings().b)
    if not text:
        return [], [], [], []
    a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.a.bytes[i] for i in a) != whole or b"".join(pair.b.bytes[i] for i in b) != whole:
        return [], [], [], []
    ends = [np.cumsum([len(x.bytes[i]) for i in ids]).tolist() for x, ids in ((pair.a, a), (pair.b, b))]
    starts = [[0, *e[:-1]] for e in ends]
    links, low = [], 0
    for i in range(len(a)):
        while ends[1][low] <= starts[0][i]:
            low += 1
        j = low
        while j < len(b) and starts[1][j] < ends[0][i]:
            links.append((i, j))
            j += 1
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, p, q = [], 0, 0
    for end in common:
        i, j = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[p:i], b[q:j]))
        p, q = i, j
    return a, b, links, groups


def brute(rows, pair):
    each = [(i, *brute_text(t, pair)) for i, t in rows]
    n = collections.Counter(p for _, a, b, links, _ in each for p in {(a[i], b[j]) for i, j in links})
    top = collections.defaultdict(int)
    for (x, _), c in n.items():
        top[x] = max(top[x], c)
    out = []
    for i, a, b, links, groups in each:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        pairs = [(a[x], b[y]) for x, y in links]
        out.append((i, len(a), len(b), len(groups), len(links), sum(n[p] == top[p[0]] for p in pairs), sum(n[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(4)
    words = "der die das Haus house maison naïve co-operate 3.14 ... \n ünïcödé 東京 tokenization antidisestablishmentarianism".split(" ")
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    return [*rows, rows[0], (None, TEXTS[0]), (None, None), (5000, " ".join(rng.choice(words) for _ in range(3000)))]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 17 * 100])
def test_figures(docs_of, pair, slice_bytes):
    rows = rows_of()
    got = aligned.digest(docs_of(rows), slice_bytes=slice_bytes).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, pair)


def test_links_and_cuts(docs_of, pair):
    rows = rows_of()[:30]
    for r in aligned.align(docs_of(rows)).collect():
        a, b, links, groups = brute_text(dict(rows)[r.doc_id], pair)
        assert (r.a, r.b, list(zip(r.link_a, r.link_b, strict=True))) == (a, b, links)
        assert r.cut_a == np.cumsum([len(g) for g, _ in groups]).tolist()
        assert r.cut_b == np.cumsum([len(h) for _, h in groups]).tolist()


def test_stretches_change_nothing(pair):
    texts = [t for _, t in rows_of()]
    one, many = aligned.aligned(texts, pair, 1 << 40), aligned.aligned(texts, pair, 5)
    for x, y in zip(vars(one).values(), vars(many).values(), strict=True):
        assert np.array_equal(x, y)
    ends = np.cumsum(pair.lengths[0][one.a]), np.cumsum(pair.lengths[1][one.b])
    assert len(aligned.stretches(*ends, one.a_off, one.b_off, 50)[0]) > len(one.a_off) + 20


def test_fast_encoder_agrees(pair):
    assert pair.a.fast is not None
    texts = [" " + t for t in TEXTS if t] + [" " * 30000 + "x", "\n" * 5000, "ab" * 20000]
    for t in texts:
        assert pair.a.ids(t) == pair.a.whole.encode(t, add_special_tokens=False).ids


def test_few_rows(docs_of):
    assert aligned.digest(docs_of([])).count() == 0
    assert aligned.align(docs_of([])).count() == 0
    assert [tuple(r) for r in aligned.digest(docs_of([(1, None)])).select(COLUMNS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
