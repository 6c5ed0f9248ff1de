"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded twice: with a space in front by a byte-level BPE file (A), and as it is by a SentencePiece model, which adds the
space (B). Tokens whose byte ranges overlap are linked; where a token of A and one of B end together, both sequences are
cut, which makes groups of tokens that cover the same bytes.

The merge walks all texts of a batch in lockstep: one state vector holds a pointer into A and one into B for every text.
A step emits one link for each text, a cut where both tokens end, and advances the pointers whose tokens end first; texts
that are done leave the vector. A long text takes part as several stretches, parted at common ends, so that a step has
much to do until the last.

Id pairs are counted over all texts: a task adds up its texts' distinct pairs before the shuffle. The counts go back to the
texts in slices of at most ``SLICE_BYTES``, one slice a pass; a pass reads each text's pairs, not the text.

Texts that are null or empty, or whose tokens don't spell the text with a space in front (byte by byte, each token with a
byte at least), have no tokens and take part in no count. Special tokens' strings inside texts are plain text. Rows are
documents, whatever their ids: equal rows count each, ids may be null. Empty tables give none. A row's text must fit a
task. Other columns stay out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import pieces as text_pieces
from veldspar.llm.common import trim, written
from veldspar.llm.pieces import decoded

SLICE_BYTES, BATCH, STRETCH, MOST_PAIRS = 32 << 20, 2 << 20, 256, 1 << 20

#: Fixed value: how byte-level BPE files of this kind part a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Settings:
    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


# ---- the tokenizers ----


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters stand for themselves,
    the others, in order, for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file: ids of texts, and each id's bytes.

    Where the file's merges come in the order of their ids, ranks are ids, and a faster library finds the same tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        plain = {t: i for t, i in vocab.items() if t not in special}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
        for t, i in plain.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ordered = [vocab[m] for m in merged]
        ways = spec.get("pre_tokenizer") or {}
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.fast = None
        if ordered == sorted(ordered) and set(ordered) == {i for t, i in plain.items() if len(t) > 1} and spec.get("normalizer") is None and ways.get("type") == "ByteLevel" and ways.get("use_regex", True) and not ways.get("add_prefix_space"):
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={self.bytes[i]: i for i in plain.values()}, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001 - the library panics on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A SentencePiece model: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Pair:
    """Both tokenizers with their tables."""

    def __init__(self, s: Settings):
        self.a, self.b = ByteLevel(s.a), Pieces(s.b)
        self.size = len(self.a.bytes), len(self.b.bytes)
        self.span = self.size[0] * self.size[1]
        self.tables = tuple(pa.array(x.bytes, pa.large_binary()) for x in (self.a, self.b))
        self.lengths = tuple(np.array([len(y) for y in x.bytes], np.int64) for x in (self.a, self.b))
        self.marks = [f"{i}{end}" for n, last in zip(self.size, "|;", strict=True) for i in range(n) for end in (",", last)]


_kept: dict[Settings, Pair] = {}


def _pair(s: Settings) -> Pair:
    """Kept by the Python worker from one task to the next."""
    if s not in _kept:
        _kept.clear()
        _kept[s] = Pair(s)
    return _kept[s]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1])), offsets


# ---- the merge ----


def stretches(a_end: np.ndarray, b_end: np.ndarray, a_off: np.ndarray, b_off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of A and B of the stretches, and the numbers of tokens behind the last. Texts of more than size tokens are
    parted at the first common end after every size tokens, if one of the next 64 is common."""
    first_a, first_b = [a_off], [b_off]
    long = np.flatnonzero(np.diff(a_off) > size)
    if len(long):
        each = (np.diff(a_off)[long] - 1) // size
        text = np.repeat(long, each)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + 1
        k = (a_off[text] + nth * size)[:, None] + np.arange(min(64, size))
        inside = k < a_off[text + 1][:, None] - 1
        k = np.minimum(k, len(a_end) - 1)
        at = np.searchsorted(b_end, a_end[k])
        common = inside & (b_end[np.minimum(at, len(b_end) - 1)] == a_end[k])
        some = np.flatnonzero(common.any(axis=1))
        pick = common[some].argmax(axis=1)
        first_a.append(k[some, pick] + 1)
        first_b.append(at[some, pick] + 1)
    return np.unique(np.concatenate(first_a)), np.unique(np.concatenate(first_b))


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, cut_a, cut_b): linked token numbers, and whether a group ends with a token. a_end, b_end: where each
    token ends; a_first, b_first: the stretches' first tokens, and the end of the last."""
    i, j, stop = a_first[:-1].copy(), b_first[:-1].copy(), a_first[1:].copy()
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    left, right = [i[:0]], [j[:0]]
    while len(i):
        left.append(i)
        right.append(j)
        ends = a_end[i], b_end[j]
        a_done, b_done = ends[0] <= ends[1], ends[1] <= ends[0]
        both = a_done & b_done
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + a_done, j + b_done
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    return np.concatenate(left), np.concatenate(right), cut_a, cut_b


@dataclass
class Aligned:
    """A batch's texts that have tokens (rows: their numbers), aligned. Links come ordered by text."""

    rows: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_off: np.ndarray
    b_off: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def per_text(self, offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    def link_text(self) -> np.ndarray:
        return np.searchsorted(self.a_off, self.link_a, "right") - 1

    def digests(self, marks: list[str], size_a: int) -> list[str]:
        """SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.flatnonzero(self.cut_a), np.flatnonzero(self.cut_b)
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.concatenate(([0], last_b + 1))[group_a]] = 2 * self.a.astype(np.int64) + self.cut_a
        order[np.arange(len(self.b)) + last_a[group_b] + 1] = 2 * (size_a + self.b.astype(np.int64)) + self.cut_b
        offsets = (self.a_off + self.b_off).tolist()
        codes = order.tolist()
        return [hashlib.sha256("".join([marks[c] for c in codes[x:y]])[:-1].encode()).hexdigest() for x, y in zip(offsets, offsets[1:], strict=False)]


def aligned(texts: list[str | None], pair: Pair, size: int = STRETCH) -> Aligned:
    some = [k for k, t in enumerate(texts) if t]
    a, a_off = _flat([pair.a.ids(" " + texts[k]) for k in some])
    b, b_off = _flat(pair.b.ids([texts[k] for k in some]))
    whole = [(" " + texts[k]).encode() for k in some]
    good = np.ones(len(some), bool)
    for ids, off, table, lengths in ((a, a_off, pair.tables[0], pair.lengths[0]), (b, b_off, pair.tables[1], pair.lengths[1])):
        good &= np.array([x == y for x, y in zip(decoded(off, ids, table).to_pylist(), whole, strict=True)], bool)
        good &= np.diff(np.concatenate(([0], np.cumsum(lengths[ids] == 0)))[off]) == 0
    if not good.all():
        (a, a_off), (b, b_off) = ((x[np.repeat(good, np.diff(off))], np.concatenate(([0], np.cumsum(np.diff(off)[good])))) for x, off in ((a, a_off), (b, b_off)))
    a_end, b_end = np.cumsum(pair.lengths[0][a]), np.cumsum(pair.lengths[1][b])  # both run on over the texts, which have equal bytes
    link_a, link_b, cut_a, cut_b = lockstep(a_end, b_end, *stretches(a_end, b_end, a_off, b_off, size))
    order = np.lexsort((link_b, link_a))
    return Aligned(np.array(some, np.int64)[good], a, b, a_off, b_off, link_a[order], link_b[order], cut_a, cut_b)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _lists(n: int, rows: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """n lists of ints, of which the given rows hold the values between their offsets; the others are empty."""
    counts = np.zeros(n, np.int64)
    counts[rows] = np.diff(offsets)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, link_a, link_b, cut_a, cut_b), arrays of ints: token ids; linked positions in a and b (the n-th of both are
    a link); how many tokens of a and b precede the end of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(s)
        for batch in text_pieces(batches, "text", BATCH):
            x, n = aligned(batch.column(1).to_pylist(), pair), batch.num_rows
            links = np.searchsorted(x.link_a, x.a_off)
            text = x.link_text()
            columns = [_lists(n, x.rows, x.a_off, x.a), _lists(n, x.rows, x.b_off, x.b), _lists(n, x.rows, links, x.link_a - x.a_off[text]), _lists(n, x.rows, links, x.link_b - x.b_off[text])]
            for flags, off in ((x.cut_a, x.a_off), (x.cut_b, x.b_off)):
                at = np.flatnonzero(flags)
                edges = np.searchsorted(at, off)
                columns.append(_lists(n, x.rows, edges, at - np.repeat(off[:-1], np.diff(edges)) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "a", "b", "link_a", "link_b", "cut_a", "cut_b"])
        trim()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in ("a", "b", "link_a", "link_b", "cut_a", "cut_b")))


# ---- figures over all texts ----

_STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _figures(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Each text's figures, its distinct id pairs (a * number of B's ids + b, ascending) and how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(s)
        for batch in text_pieces(batches, "text", BATCH):
            x, n = aligned(batch.column(1).to_pylist(), pair), batch.num_rows
            text = x.link_text()
            cell, times = np.unique(text * pair.span + x.a[x.link_a].astype(np.int64) * pair.size[1] + x.b[x.link_b], return_counts=True)
            edges = np.searchsorted(cell // pair.span, np.arange(len(x.rows) + 1))
            whole = [np.zeros(n, np.int64) for _ in range(4)]
            for column, value in zip(whole, (np.diff(x.a_off), np.diff(x.b_off), x.per_text(x.a_off, x.cut_a), np.bincount(text, minlength=len(x.rows))), strict=True):
                column[x.rows] = value
            digests = np.full(n, "", object)
            digests[x.rows] = x.digests(pair.marks, pair.size[0])
            packed = []
            for values in (cell % pair.span, times.astype(np.uint32)):
                parts = np.full(n, b"", object)
                parts[x.rows] = [values[p:q].tobytes() for p, q in zip(edges, edges[1:], strict=False)]
                packed.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, whole), pa.array(digests, pa.string()), *packed], [c.split()[0] for c in _STORED.split(", ")])
            del x, text, cell, times
        trim()

    return written(_texts(docs, id_col, text_col).mapInArrow(run, _STORED), "aligned")


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and where each row's begin."""
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and len(column) else np.zeros(0, kind)
    return values, (offsets - offsets[0]).astype(np.int64) // width if len(column) else np.zeros(1, np.int64)


def pair_counts(stored: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many texts hold each id pair, and whether no other pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, back = np.unique(np.concatenate((pairs, *waiting)), return_inverse=True)
            return found, np.bincount(back, np.concatenate((n, np.ones(len(back) - len(n), np.int64))), len(found)).astype(np.int64)

        for batch in text_pieces(batches, "pairs", BATCH):
            waiting.append(_numbers(batch.column(0), "<i8")[0].copy())
            size += len(waiting[-1])
            if size > MOST_PAIRS:
                pairs, n = merged(pairs, n)
                waiting, size = [], 0
            if len(pairs) > MOST_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                pairs, n = pairs[:0], n[:0]
        pairs, n = merged(pairs, n)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        trim()

    counts = stored.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    a = Window.partitionBy(F.expr(f"pair div {size_b}"))  # at most size_b pairs each
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(a)).alias("best"))


_FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def digest(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum): n_best of a text's links have a pair that no other of its
    A id is more frequent than; count_sum adds the counts of all links' pairs."""
    stored = _figures(docs, s, id_col, text_col)
    counts = written(pair_counts(stored, _pair(s).size[1]), "pair-counts")
    passes = max(1, -(-counts.count() * 17 // slice_bytes))
    parts = [_looked_up(stored, counts.filter(F.pmod(F.xxhash64("pair"), F.lit(passes)) == p)) for p in range(passes)]
    if passes == 1:
        return parts[0].drop("row")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("row", *_FIGURES).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def _looked_up(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """The figures of each text, over the pairs of one slice of counts, whose size has been checked."""
    t = counts.sort("pair").toArrow()
    shared = stored.sparkSession.sparkContext.broadcast(tuple(t[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in text_pieces(batches, "pairs", BATCH):
            pairs, edges = _numbers(batch.column(6), "<i8")
            times = _numbers(batch.column(7), "<u4")[0].astype(np.int64)
            at = np.searchsorted(known, pairs)
            at[at == len(known)] = 0
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = []
            for value in (times * best[at], times * n[at]) if len(known) else (times, times):
                sums.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(np.where(hit, value, 0))))[edges]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(8), *(batch.column(c) for c in range(6)), *sums], ["row", *_FIGURES, "n_best", "count_sum"])
        trim()

    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return stored.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, kinds)
