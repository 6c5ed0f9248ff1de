"""SentencePiece encoding by sampling without replacement, and decoding.

The model's pieces span a lattice over each text. Its paths have probabilities proportional to the product of their
pieces' weights, and a Gumbel-perturbed best-first (A-star) search over sets of paths emits the ``samples`` paths with
the largest perturbed log-probabilities: distinct segmentations, drawn without replacement. The bound of a set is the
exact perturbed maximum of its paths, so the first paths that come out are the right ones:

* the whole lattice has a Gumbel variable located at 0; a path drawn from the lattice inherits it,
* the paths that share this path's words before word i and differ from it at word i make one further set for every i,
  located at log P(words before i) + log(1 - P(word i)), with a Gumbel variable truncated at its parent's,
* the set with the largest variable is split next.

No piece of the model crosses a space or a newline, so the lattice is a chain of word lattices, which are kept by word
up to ``most_edges`` and forgotten at the end of a task. Masses are sums in logarithms, without differences, so sets of
very small probability are kept like others.
Random numbers are hashes of (row key, sample, word, step): partitioning and batches don't change a result.

The model file's path is a parameter; BPE models carry ranks instead of probabilities, so a piece of rank r weighs
(r + 2.7) ** -alpha (Zipf). Characters without a piece become bytes, as in the library.

Null and empty texts have the one empty segmentation. A text with fewer segmentations than asked gives all it has.
Null keys share one seed. Repeated rows give equal samples. U+2581 itself is read back as a space (as by the library):
``round_trip`` is then false. Texts of any length are whole; only the key and text columns are read.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import pieces as text_pieces
from veldspar.llm.common import trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass(frozen=True)
class Settings:
    model: str = MODEL
    samples: int = 2
    alpha: float = 1.0
    seed: int = 17
    most_edges: int = 1_250_000  # of the kept lattices, at 24 bytes


BATCH = 1 << 18  # bytes of text that are sampled together
_SLOT_BITS, _BASE, _SPREAD, _UNKNOWN = 19, 0x100000001B3, 0x9E3779B97F4A7C15, -11.5


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        h = 0
        for c in w:
            h = (h * _BASE + ord(c) + 1) & (1 << 64) - 1
        out.append(h)
    return np.array(out, np.uint64)


class Words(dict):
    """Word -> number of its lattice. Node 0 ends every lattice; each node's edges lie together, likeliest first."""

    def __init__(self, s: Settings):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=s.model)
        self.settings, self.bytes, self.text = s, {}, []
        vocabulary: dict[str, int] = {}
        self.weight: list[float] = []
        zipf = all(model.get_score(i) <= -1 or model.get_score(i) == 0 for i in range(0, model.get_piece_size(), 97))
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            self.weight.append(0.0)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.text.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or SPACE in piece[1:] or "\n" in piece:
                continue
            self.weight[i] = (2.7 - score) ** -s.alpha if zipf else math.exp(s.alpha * score)
            vocabulary[piece] = i
            for k in range(1, len(piece)):
                vocabulary.setdefault(piece[:k], -1)
        self.longest = max(map(len, vocabulary))
        self.log_weight = np.log(np.maximum(np.array(self.weight), 1e-300))
        size = 1 << _SLOT_BITS
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        known = list(vocabulary.items())
        for h, (_, k) in zip(_hashes([x for x, _ in known]).tolist(), known, strict=True):
            at = (h * _SPREAD & (1 << 64) - 1) >> 64 - _SLOT_BITS
            while self.ids[at] != -2:
                at = (at + 1) % size
            self.keys[at], self.ids[at] = h, k
        self.release()

    def reset(self) -> None:
        """Forget all words."""
        self.clear()
        self.n_nodes, self.n_edges, self.n_words, self.new = 1, 0, 0, []
        trim()

    def release(self) -> None:
        """Give the arrays back; memory that isn't written to isn't taken."""
        size = self.settings.most_edges * 5 // 4
        self.first, self.root = np.zeros(size // 2, np.int32), np.zeros(size // 8, np.int32)
        self.cum, self.logq = np.zeros(size), np.zeros(size)
        self.target, self.piece = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.reset()

    def __missing__(self, word: str) -> int:
        """A new word's number; its lattice is still to be built."""
        self.new.append(word)
        self[word] = number = self.n_words + len(self.new) - 1
        return number

    def _room(self, nodes: int, edges: int, words: int) -> None:
        for names, need in ((("first",), self.n_nodes + nodes + 1), (("cum", "logq", "target", "piece"), self.n_edges + edges), (("root",), self.n_words + words)):
            for name in names:
                old = getattr(self, name)
                if need > len(old):
                    grown = np.zeros(max(need, len(old) * 3 // 2), old.dtype)
                    grown[: len(old)] = old
                    setattr(self, name, grown)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for a mere prefix of pieces, -2 for neither."""
        at = ((h * np.uint64(_SPREAD)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        ids = self.ids[at]
        wrong = np.flatnonzero((self.keys[at] != h) & (ids != -2))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.ids)
            ids[wrong] = self.ids[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != h[wrong]) & (ids[wrong] != -2)]
        return ids

    def add(self, new: list[str]) -> None:
        """Build the lattices of the words that have the next numbers, all at once: nodes are numbered by their distance from the word's end, and
        log q of an edge, its probability from its node on, is exact to the last digits even where q is close to 1."""
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        chars = np.frombuffer(("\0".join(new) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        n, most = len(chars), self.longest  # a slot for each character and one for each word's end
        end_of = np.cumsum(lengths + 1) - 1
        room = (np.repeat(end_of, lengths + 1) - np.arange(n)).astype(np.int32)
        plus = chars.astype(np.uint64) + np.uint64(1)
        alive = np.flatnonzero(room)
        h, counts, found = np.zeros(len(alive), np.uint64), np.zeros(n, np.int32), []
        for size in range(1, most + 1):
            if size > 1:
                fits = room[alive] >= size
                alive, h = alive[fits], h[fits]
            if not len(alive):
                break
            with np.errstate(over="ignore"):
                h = h * np.uint64(_BASE) + plus[alive + (size - 1)]
            ids = self._find(h)
            if size == 1:  # no piece for the character: its bytes, as likely as the rarest pieces
                found.append((alive, np.maximum(ids, -1)))
                ids = np.where(ids >= 0, ids, -1 - (ids == -2))
                counts[alive] = 1
            else:
                has = ids >= 0
                found.append((alive[has], ids[has]))
                counts[found[-1][0]] += 1
            alive, h = alive[ids > -2], h[ids > -2]
        order = np.argsort(room.astype(np.uint16) if lengths.max(initial=0) < 1 << 16 else room, kind="stable")[len(new) :]
        levels = np.cumsum(np.bincount(room, minlength=1)) - len(new)  # nodes of levels 0 to k
        rank = np.zeros(n, np.int32)  # of a slot; the ends are rank 0
        rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        total = int(counts.sum())
        place = np.zeros(len(order) + 1, np.int64)
        np.cumsum(counts[order], out=place[1:])
        fill = np.zeros(n, np.int64)
        fill[order] = place[:-1]
        target, piece, weight = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        for size in range(len(found), 0, -1):  # longer pieces first: they are the likelier ones
            src, ids = found[size - 1]
            e = fill[src]
            fill[src] += 1
            target[e], piece[e] = rank[src + size], ids
            weight[e] = self.log_weight[ids] if size > 1 else np.where(ids >= 0, self.log_weight[np.maximum(ids, 0)], _UNKNOWN)
        beta, cum = np.zeros(len(order) + 1), np.empty(total)
        for k in range(1, len(levels)):
            a, b = int(levels[k - 1]), int(levels[k])
            if a == b:
                continue
            start, stop = place[a], place[b]
            first, each = place[a:b] - start, np.diff(place[a : b + 1])
            x = weight[start:stop] + beta[target[start:stop]]
            top = np.maximum.reduceat(x, first)
            x -= np.repeat(top, each)
            likely = np.exp(x)
            whole = np.add.reduceat(likely, first)
            log_whole = np.log(whole)
            beta[a + 1 : b + 1] = top + log_whole
            weight[start:stop] = x - np.repeat(log_whole, each)
            run = np.cumsum(likely)
            run -= np.repeat((run - likely)[first], each)
            cum[start:stop] = run / np.repeat(whole, each)
            likely[x == 0.0] = 0.0
            sure = np.flatnonzero((x == 0.0) & (np.repeat(whole, each) < 2.0))  # more than half: from what the others have
            weight[start + sure] = -np.log1p(np.repeat(np.add.reduceat(likely, first), each)[sure])
        cum[place[1:] - 1] = 2.0
        # further bytes of a character without a piece: a chain of nodes with one edge each
        unknown = found[0][0][found[0][1] < 0] if found else np.zeros(0, np.int64)
        raw = [chr(c).encode("utf-8", "replace") for c in chars[unknown].tolist()]
        more = sum(len(r) - 1 for r in raw)
        self._room(len(order) + more, total + more, len(new))
        base, at = self.n_nodes - 1, self.n_edges  # rank r is node base + r, rank 0 node 0
        self.first[base + 1 : base + 1 + len(order)] = at + place[:-1]
        span = slice(at, at + total)
        self.target[span] = np.where(target > 0, base + target, 0)
        self.piece[span], self.logq[span], self.cum[span] = piece, weight, cum
        node, edge = base + 1 + len(order), at + total
        for slot, r in zip(unknown.tolist(), raw, strict=True):
            e = at + int(place[rank[slot]]) - 1  # the shortest step is the last
            self.piece[e] = self.bytes[r[0]]
            for b in r[1:]:
                self.first[node], self.target[edge], self.target[e] = edge, self.target[e], node
                self.piece[edge], self.cum[edge], self.logq[edge] = self.bytes[b], 2.0, 0.0
                e, node, edge = edge, node + 1, edge + 1
        self.root[self.n_words : self.n_words + len(new)] = np.where(lengths > 0, base + rank[end_of - lengths], 0)
        self.n_nodes, self.n_edges, self.n_words = node, edge, self.n_words + len(new)
        self.first[node] = edge  # a node's edges end where those of the next begin

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The word numbers of each text; words not met before are added."""
        each = [np.array([self[x] for x in self.split(t or "")], np.int32) for t in texts]
        if self.new:
            new, self.new = self.new, []
            self.add(new)
        return each

    def split(self, text: str) -> list[str]:
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ") if text else []


def _uniform(keys: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit keys (the finaliser of SplitMix64)."""
    x = keys + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_STEP = np.uint64(0xD1342543DE82EF95)
_SAMPLE = np.uint64(0xA24BAED4963EE407)


class _Tables:
    def __init__(self, w: Words):
        self.first, self.cum, self.target, self.piece, self.logq = w.first, w.cum, w.target, w.piece, w.logq

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths from the nodes to their ends: log-probabilities, offsets of each path's edges, and the edges."""
        n = len(nodes)
        logp, counts = np.zeros(n), np.zeros(n, np.int32)
        alive = np.flatnonzero(nodes)
        node, key = nodes[alive], keys[alive].copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            u = _uniform(key)
            edge = self.first[node]
            late = np.flatnonzero(u > self.cum[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] > self.cum[edge[late]]]
            logp[alive] += self.logq[edge]
            steps.append((alive, edge))
            counts[alive] += 1
            node = self.target[edge]
            on = np.flatnonzero(node)
            alive, node, key = alive[on], node[on], key[on] + _STEP
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        edges = np.empty(int(offsets[-1]), np.int32)
        for t, (who, edge) in enumerate(steps):
            edges[offsets[who] + t] = edge
        return logp, offsets, edges

    def edges_of(self, node: int) -> list[tuple[int, float]]:
        """The edges of a node with their log-probabilities."""
        a, b = int(self.first[node]), int(self.first[node + 1])
        return list(zip(range(a, b), self.logq[a:b].tolist(), strict=True))

    def other(self, root: int, taken: list[tuple[int, ...]], rng: random.Random) -> tuple[tuple[int, ...], float]:
        """A path from root that none of the taken ones is, drawn by its probability, and its log-probability.

        Edges that begin a taken path weigh what the taken paths leave below them; the others all of theirs."""
        left = _left(self, root, taken)
        new: list[int] = []
        node, level = root, left
        while node:
            found = self.edges_of(node)
            logs = [x + (level[e][0] if level and e in level else 0.0) for e, x in found]
            top = max(logs)
            e = (found[0] if len(found) == 1 else rng.choices(found, [math.exp(x - top) for x in logs])[0])[0]
            new.append(e)
            node, level = int(self.target[e]), level[e][1] if level and e in level else None
        return tuple(new), float(self.logq[new].sum())

    def log_rest(self, root: int, taken: list[tuple[int, ...]]) -> float:
        """The log of the mass of all paths from root but for the taken ones: a sum, without differences."""
        left = _left(self, root, taken)
        return _log_sum([x + (left[e][0] if e in left else 0.0) for e, x in self.edges_of(root)])


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in logs))


def _left(tables: _Tables, root: int, taken: list[tuple[int, ...]]) -> dict[int, tuple[float, dict]]:
    """Of the taken paths as a tree: edge -> (log of the share below it that isn't taken, the edges that follow)."""
    tree: dict[int, dict] = {}
    for path in taken:
        at = tree
        for e in path:
            at = at.setdefault(e, {})
    out: dict[int, tuple[float, dict]] = {}
    todo = [(tree, out, False)]
    while todo:  # depth first without recursion: words may be long
        level, result, ready = todo.pop()
        if not ready:
            todo.append((level, result, True))
            for e, below in level.items():
                result[e] = (0.0, {})
                todo.append((below, result[e][1], False))
        else:
            for e, below in level.items():
                follow = result[e][1]
                node = int(tables.target[e])
                log = _log_sum([y + (follow[x][0] if x in follow else 0.0) for x, y in tables.edges_of(node)]) if node else -math.inf
                result[e] = (log, follow)
    return out


def _truncated(location: np.ndarray, top: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gumbel variables at their locations, truncated at top; -inf where the location is."""
    e = -np.log(_uniform(keys))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(location - top) + e))


def sample_batch(w: Words, texts: list[str | None], seeds: np.ndarray, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For sample 1, 2, ...: (rows that have it, log_prob, perturbed, threshold, offsets, piece ids).

    threshold is the perturbed log-probability of the first path that isn't emitted; it is the same array for all."""
    each = w.numbers(texts)
    n_docs = len(each)
    count = np.array([len(x) for x in each], np.int64)
    start = np.concatenate(([0], np.cumsum(count)))
    words = np.concatenate(each) if start[-1] else np.zeros(0, np.int32)
    tables, roots = _Tables(w), w.root[words]
    doc = np.repeat(np.arange(n_docs), count)
    position = (np.arange(len(words)) - start[doc]).astype(np.uint64)
    with np.errstate(over="ignore"):
        word_key = seeds[doc] + position * np.uint64(0x9FB21C651E98DF25)
    full = np.flatnonzero(count)
    branches: list[dict] = []
    g_root = -np.log(-np.log(_uniform(seeds ^ np.uint64(0x5851F42D4C957F2D))))

    def emit(k: int, who: np.ndarray, top: np.ndarray, parent: np.ndarray, cut: np.ndarray) -> None:
        """Sample k of the documents who: the parent branch's words before cut, another path at cut, free ones after."""
        has = np.zeros(n_docs, bool)
        has[who] = True
        begin = np.where(has, cut + (parent >= 0), count)
        fresh = np.flatnonzero(position >= begin.astype(np.uint64)[doc]) if len(words) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            logp, offsets, edges = tables.draw(roots[fresh], word_key[fresh] + np.uint64(k + 1) * _SAMPLE)
        of_word = np.zeros(len(words))
        of_word[fresh] = logp
        slot, source = np.full(len(words), -1, np.int64), np.full(len(words), k, np.int32)
        slot[fresh] = np.arange(len(fresh))
        changed: dict[int, tuple[int, ...]] = {}
        spent: dict[int, list[tuple[int, ...]]] = {}
        for d in who[parent[who] >= 0].tolist():
            old, at = branches[parent[d]], int(start[d] + cut[d])
            own = old["spent"].get(at) or [path_at(int(parent[d]), at)]
            found = tables.other(int(roots[at]), own, random.Random(f"{seeds[d]} {k} {cut[d]}"))
            changed[at], of_word[at] = found
            spent[at] = [*own, found[0]]
            old["g"][at] = -np.inf  # what is left of it goes on as a set of the new branch
            copy = slice(int(start[d]), at)
            of_word[copy], source[copy] = old["logp"][copy], np.where(old["source"][copy] >= 0, old["source"][copy], parent[d])
        location = np.full(len(words), -np.inf)
        before = np.cumsum(of_word) - of_word
        before -= before[start[:-1].clip(0, max(len(words) - 1, 0))][doc] if len(words) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.log(-np.expm1(of_word))
            for at, own in spent.items():
                rest[at] = tables.log_rest(int(roots[at]), own)
            own_word = (position >= np.where(has, cut, count).astype(np.uint64)[doc]) if len(words) else np.zeros(0, bool)
            location = np.where(own_word, before + rest, -np.inf)
        with np.errstate(over="ignore"):
            g = _truncated(location, top[doc], word_key ^ (np.uint64(k + 1) * np.uint64(0xC2B2AE3D27D4EB4F)))
        total = np.zeros(n_docs)
        if len(full):
            total[full] = np.add.reduceat(of_word, start[full])
        branches.append({"has": has, "logp": of_word, "g": g, "total": total, "top": top, "slot": slot, "source": source, "offsets": offsets, "edges": edges, "changed": changed, "spent": spent})

    def path_at(k: int, at: int) -> tuple[int, ...]:
        b = branches[k]
        if at in b["changed"]:
            return b["changed"][at]
        if b["source"][at] != k:
            return path_at(int(b["source"][at]), at)
        s = b["slot"][at]
        return tuple(b["edges"][b["offsets"][s] : b["offsets"][s + 1]].tolist())

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: the largest variable of all sets, its branch and word."""
        top, which, word = np.full(n_docs, -np.inf), np.full(n_docs, -1), np.zeros(n_docs, np.int64)
        for k, b in enumerate(branches):
            if not len(full):
                break
            m = np.full(n_docs, -np.inf)
            m[full] = np.maximum.reduceat(b["g"], start[full])
            better = np.flatnonzero(m > top)
            top[better], which[better] = m[better], k
        for k, b in enumerate(branches):
            mine = which == k
            if mine.any():
                hit = np.flatnonzero((b["g"] == top[doc]) & mine[doc] & np.isfinite(b["g"]))
                word[doc[hit[::-1]]] = position[hit[::-1]].astype(np.int64)
        return top, which, word

    emit(0, np.arange(n_docs), g_root, np.full(n_docs, -1), np.zeros(n_docs, np.int64))
    for k in range(1, samples):
        top, which, word = best()
        emit(k, np.flatnonzero(which >= 0), top, which, word)
    threshold = best()[0]
    for k, b in enumerate(branches):
        who = np.flatnonzero(b["has"])
        lengths, parts = np.zeros(len(words), np.int64), []
        wanted = b["has"][doc]
        for j, old in enumerate(branches[: k + 1]):
            some = np.flatnonzero(wanted & (b["source"] == j) & (old["slot"] >= 0))
            lengths[some] = np.diff(old["offsets"])[old["slot"][some]]
            parts.append(some)
        changed = {at: path for j, old in enumerate(branches[: k + 1]) for at, path in old["changed"].items() if wanted[at] and b["source"][at] == j}
        for at, path in changed.items():
            lengths[at] = len(path)
        place = np.concatenate(([0], np.cumsum(lengths)))
        out = np.empty(int(place[-1]), np.int32)
        for some, old in zip(parts, branches, strict=False):
            if len(some):
                begin, spans = old["offsets"][old["slot"][some]], lengths[some]
                inside = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
                out[np.repeat(place[some], spans) + inside] = tables.piece[old["edges"][np.repeat(begin, spans) + inside]]
        for at, path in changed.items():
            out[place[at] : place[at + 1]] = tables.piece[list(path)]
        by_doc = place[start]
        yield who, b["total"][who], b["top"][who], threshold[who], np.concatenate(([0], np.cumsum(by_doc[who + 1] - by_doc[who]))), out


def decoded(offsets: np.ndarray, ids: np.ndarray, table: pa.Array) -> pa.Array:
    """The UTF-8 bytes of each row of piece ids, the first space included. table: each piece's bytes."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pc.take(table, pa.array(ids, pa.int32())))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean, pieces array<int>"


def encode(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and sample: its piece ids, normalised log-probability, perturbed log-probability, the
    log of its inclusion probability 1 - exp(-exp(log_prob - threshold)), and whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _words(s)
        table = pa.array(w.text, pa.large_binary())
        try:
            for batch in text_pieces(batches, "text", BATCH):
                if w.n_edges > s.most_edges:
                    w.reset()
                keys, texts = batch.column(0), batch.column(1)
                with np.errstate(over="ignore"):
                    seeds = np.array([zlib.crc32(str(x).encode()) for x in keys.to_pylist()], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(s.seed)
                whole = pa.array([b" " + t if t else b"" for t in texts.cast(pa.binary()).to_pylist()], pa.large_binary())
                for k, (who, log_prob, top, threshold, offsets, ids) in enumerate(sample_batch(w, texts.to_pylist(), seeds, s.samples)):
                    if not len(who):
                        continue
                    rows = pa.array(who, pa.int64())
                    with np.errstate(over="ignore", divide="ignore"):
                        gap = log_prob - threshold
                        inclusion = np.where(gap > 700, 0.0, np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700))))))
                    same = pc.equal(decoded(offsets, ids, table), pc.take(whole, rows))
                    yield pa.RecordBatch.from_arrays([keys.take(rows), pa.array(np.full(len(who), k + 1, np.int32)), pa.array(np.diff(offsets)), pa.array(log_prob), pa.array(top), pa.array(inclusion), same, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip", "pieces"])
        finally:
            w.release()  # the worker goes on to other tasks

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, s: Settings = Settings(), pieces_col: str = "pieces", out_col: str = "text") -> DataFrame:
    """encoded with the text of its piece ids; null ids give null. The column replaces one of that name."""

    @F.pandas_udf("string")
    def texts(ids):  # noqa: ANN001, ANN202
        table = _words(s).text
        return ids.map(lambda x: None if x is None else b"".join([table[i] for i in x])[1:].decode("utf-8", "replace"))

    return encoded.withColumn(out_col, texts(F.col(pieces_col)))


_kept: dict[Settings, Words] = {}


def _words(s: Settings) -> Words:
    """Kept by the Python worker from one task to the next."""
    if s not in _kept:
        _kept.clear()
        _kept[s] = Words(s)
    return _kept[s]
