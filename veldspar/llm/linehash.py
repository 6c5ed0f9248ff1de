"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without ``WHITE`` at both ends and with A-Z lower-cased; keys below ``min_chars`` code points never
count. Each document emits every key once, as a hash of 128 bits in two halves; a grouped count with map-side combining (a line that
a third of all documents holds is a few rows a task) gives how many documents hold the key and the largest of their ids. Keys that
``min_docs`` documents hold are dealt to shards of about ``SHARD_KEYS`` by their first half. A shard is one row: the
levels of a minimal perfect hash, and at each key's number its fingerprint (the second half), count and owner.

Documents probe these arrays; lines are never joined. While all shards fit ``limit_bytes`` they are broadcast and the
texts are read once more. Beyond that only the hashes travel: each (shard, salt) is a stream of probes that follows a copy of the shard's
arrays; a shard with many probes has more salts. What a document loses comes back to it as a list of hashes.

Two keys are taken as equal if their hashes agree; a key outside of the index passes for one inside only if the fingerprint
agrees. Rows are documents, whatever their ids. A key's lines
stay in every row with the largest id; null ids are below all others and count as one such id. A null or empty text is one
empty line. Equal rows have equal results. Empty tables give none. A row's text must fit a task. Other columns stay
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import bounded_broadcast, written
from veldspar.llm.common import pieces as text_pieces

WHITE = b" \t\n\x0b\x0c\r"
SHARD_KEYS, PROBES, LIMIT_BYTES, BATCH = 200_000, 2_000_000, 32 << 20, 4 << 20

NO_KEY = bytes(16)

_SHARD = "shard int, n int, sizes binary, bits binary, prints binary, counts binary, owners binary"


# ---- the minimal perfect hash ----


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys, rows of two uint64, fall at a level."""
    with np.errstate(over="ignore"):
        x = _mixed(keys[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) + keys[:, 1] * np.uint64(2 * level + 1)
        return (_mixed(x) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, their bits as one packed array) of distinct keys, rows of two uint64. At each level a key that falls alone sets
    its bit; the others go on to the next level, of twice their number, until none is left."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
        if len(sizes) > 400:
            raise ValueError("keys aren't distinct")
    return np.array(sizes, np.int64), np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)


class Shard:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, owners: bytes):
        self.sizes, self.words = np.frombuffer(sizes, np.int64), np.frombuffer(bits, "<u8")
        self.prints, self.counts, self.owners = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(owners, np.int64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number from 0, different for different keys of the shard; for others any number, or -1."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + _place(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, start = left[~hit], start + int(size)
        return out

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, count, owner) of each key."""
        number = self.number(keys)
        found = number >= 0
        found[found] = self.prints[number[found]] == keys[found, 1]
        counts, owners = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        counts[found], owners[found] = self.counts[number[found]], self.owners[number[found]]
        return found, counts, owners


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys[:, 0] >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


# ---- lines ----


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def hashes(lines: list[bytes], min_chars: int) -> list[bytes]:
    """The 16 bytes of the hash of each line's key, ``NO_KEY`` for short ones."""
    out = []
    for line in lines:
        key = line.strip(WHITE).lower()
        counts = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if counts else NO_KEY)
    return out


def _keys(digests: list[bytes]) -> np.ndarray:
    """(n, 2) uint64: first and second hash of each."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _distinct(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, pa.Array]:
    """The distinct keys of every text, one text after the other, and each key's text number."""
    each = [list(set(hashes(_lines(t), min_chars)) - {NO_KEY}) for t in texts.to_pylist()]
    return _keys([x for one in each for x in one]), pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def counted(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, n, owner): of every distinct key, how many documents hold it and the largest of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "text", BATCH):
            h, text = _distinct(batch.column(1), min_chars)
            yield pa.RecordBatch.from_arrays([_signed(h[:, 0]), _signed(h[:, 1]), batch.column(0).take(text)], ["h1", "h2", "doc_id"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "h1 long, h2 long, doc_id long").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))


def index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shards, their number) over the rows of counts, one row a shard, written to the shared folder."""
    counts = written(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        keys = np.stack([t[c].to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1)
        sizes, bits = build(keys)
        place = Shard(sizes.tobytes(), bits.tobytes(), b"", b"", b"").number(keys)
        columns = []
        for x in (keys[:, 1], t["n"].to_numpy(), t["owner"].fill_null(_NONE).to_numpy()):
            columns.append(np.empty(len(keys), x.dtype))
            columns[-1][place] = x
        values = [pa.array([x.tobytes()], pa.binary()) for x in (sizes, bits, *columns)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([len(keys)], pa.int32()), *values], [c.split()[0] for c in _SHARD.split(", ")])

    dealt = counts.withColumn("shard", (F.shiftrightunsigned("h1", 32) % shards).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(pack, _SHARD), "line-shards"), shards


_NONE = -(1 << 63)


# ---- probing ----


def deduplicated(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept binary): each text without the lines whose keys at least min_docs documents hold,
    except in the one with the largest id. kept is UTF-8; a null text is kept as an empty one."""
    shards, number = index(counted(docs, min_chars, id_col, text_col).filter(F.col("n") >= min_docs), shard_keys)
    size = shards.agg(F.sum(sum(F.length(c) for c in ("sizes", "bits", "prints", "counts", "owners")))).first()[0] or 0
    if size <= limit_bytes:
        return _probed_in_place(_texts(docs, id_col, text_col), shards, number, min_chars)
    return _probed_by_shard(_texts(docs, id_col, text_col), shards, number, min_chars, probes)


def _kept(lines: list[bytes], gone: np.ndarray) -> bytes:
    return b"\n".join([x for x, g in zip(lines, gone.tolist(), strict=True) if not g])


_RESULT = "doc_id long, n_lines long, n_dropped long, kept binary"


def _result(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, dropped, kept = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])


def _probed_in_place(texts: DataFrame, shards: DataFrame, number: int, min_chars: int) -> DataFrame:
    """All shards in every task; their size has been checked."""
    rows = shards.select("shard", "sizes", "bits", "prints", "counts", "owners").collect()
    shared = texts.sparkSession.sparkContext.broadcast({r[0]: tuple(r)[1:] for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {s: Shard(*map(bytes, x)) for s, x in shared.value.items()}
        for batch in text_pieces(batches, "text", BATCH):
            each = [_lines(t) for t in batch.column(1).to_pylist()]
            starts = np.cumsum([0, *map(len, each)])
            h = _keys([y for x in each for y in hashes(x, min_chars)])
            ids = np.repeat(batch.column(0).fill_null(_NONE).to_numpy(), np.diff(starts))
            gone, shard, real = np.zeros(len(h), bool), _shard_of(h, number), h.any(axis=1)
            for s, x in arrays.items():
                mine = np.flatnonzero((shard == s) & real)
                found, _, owner = x.probe(h[mine])
                gone[mine] = found & (owner != ids[mine])
            parts = [(x, gone[a:b]) for x, a, b in zip(each, starts, starts[1:], strict=False)]
            yield _result(batch.column(0), [(len(x), int(g.sum()), _kept(x, g)) for x, g in parts])

    return texts.mapInArrow(run, _RESULT)


def _probed_by_shard(texts: DataFrame, shards: DataFrame, number: int, min_chars: int, probes: int) -> DataFrame:
    """Hashes travel to the shards; each document gets back what it loses."""
    keyed = texts.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.xxhash64("text").alias("t1"), F.hash("text", F.length("text")).alias("t2")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "text", BATCH):
            h, text = _distinct(batch.column(0), min_chars)
            yield pa.RecordBatch.from_arrays([_signed(h[:, 0]), _signed(h[:, 1]), batch.column(1).take(text), pa.array(_shard_of(h, number))], ["h1", "h2", "row", "shard"])

    asked = written(keyed.select("text", "row").mapInArrow(emit, "h1 long, h2 long, row struct<id: long, t1: long, t2: int>, shard int"), "line-probes")
    salts = written(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(probes)).cast("int").alias("salts")), "line-salts")
    salted = asked.join(bounded_broadcast(salts, 8), "shard").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    copies = shards.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    arrays = ["sizes", "bits", "prints", "counts", "owners"]
    probe = salted.select("shard", "salt", F.lit(1).alias("kind"), "h1", "h2", "row", *[F.lit(None).cast("binary").alias(c) for c in arrays])
    array = copies.select("shard", "salt", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2")], F.lit(None).cast("struct<id: long, t1: long, t2: int>").alias("row"), *arrays)
    stream = array.union(probe).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if kind[a] == 0:
                    now, held = (shard[a], salt[a]), Shard(*(batch.column(c)[a].as_py() for c in range(6, 11)))
                elif now == (shard[a], salt[a]):
                    part = batch.slice(a, b - a)
                    keys = np.stack([part.column(c).to_numpy().view(np.uint64) for c in (3, 4)], axis=1)
                    found, _, owner = held.probe(keys)
                    lost = found & (owner != part.column(5).field("id").to_numpy())
                    digests = [x.tobytes() for x in keys[lost]]
                    yield pa.RecordBatch.from_arrays([part.column(5).filter(pa.array(lost)), pa.array(digests, pa.binary())], ["row", "key"])

    lost = stream.mapInArrow(run, "row struct<id: long, t1: long, t2: int>, key binary").groupBy("row").agg(F.collect_set("key").alias("lost"))  # one document's keys

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, "text", BATCH):
            rows = []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, some = _lines(text), set(lost or ())
                gone = np.array([x in some for x in hashes(lines, min_chars)])
                rows.append((len(lines), int(gone.sum()), _kept(lines, gone)))
            yield _result(batch.column(0), rows)

    return keyed.join(lost, "row", "left").select("doc_id", "text", "lost").mapInArrow(drop, _RESULT)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {white}), '{upper}', '{lower}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.owner AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(array_to_string(list(line ORDER BY pos) FILTER (NOT gone), chr(10)), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
