"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance r share a variant within r / 2 of both. Emitting all 2,081 variants of a 64-bit
fingerprint within 2 bits finds every pair within 4, at 2,081 shuffled rows a fingerprint. The same argument on parts
of the fingerprint is far cheaper: of three parts of 21 or 22 bits the one that differs most holds at least 2 of 4
differing bits, so some pair of parts differs in 2 bits at most, and the variants within 1 bit on each of the three
pairs (131 rows a fingerprint) lose no link. Colliding pairs are verified on all 64 bits. A bucket with more than
``crowd`` fingerprints isn't paired: its members emit their whole 64-bit balls, where all members of a bucket are
within 4 bits of each other, so a star to the smallest holds the same components.

Nulls: a null text counts as empty; null ids get a fingerprint and, where no other row shares their group, a null
component. Repeated ids are classed row by row. Empty and white-space texts have fingerprint 0 and link like others.
An empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.

``similar`` finds texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more. Whole-text
fingerprints of such texts differ in about ten bits, more than a ball can cover, so each text also gets ``samples``
fingerprints of the ``smallest`` shingle hashes under as many permutations; two texts share one with probability
similarity ** smallest. Balls around the whole-text fingerprint and equal sample fingerprints give candidates, which
are verified on the whole sets. In a bucket of up to ``small`` texts all are compared. In a larger one each is first
compared with the bucket's smallest and the smallest of its salt, in another order in every bucket. What isn't one
component by that is joined exactly, by a prefix filter on the sets, so a large bucket leaves no link out and is neither
paired nor gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import bounded_broadcast, components, pieces, written

_BLOCK = 1 << 15


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles in order, repeats included, in blocks; fewer words make one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        span = slice(at, at + _BLOCK)
        yield np.array([digest(joined[s:e], seed) for s, e in zip(first[span], last[span], strict=True)], dtype="<u8")


def majority(blocks: Iterator[np.ndarray]) -> int:
    """Signed 64-bit number whose bits are those that are set in more than half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text's word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    return majority(shingle_hashes(words, width, seed)) if words else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): one row a document, in Arrow batches; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            fps = [fingerprint(t or b"", width) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fp: Column, mask: int, radius: int, tag: int = 0) -> Column:
    """All values within radius bits of fp on the bits of mask; the bits outside hold tag."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    flips = [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]
    base = fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(tag)))
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]) if len(flips) < 200 else _flip_pairs(), lambda x: base.bitwiseXOR(x))


def _flip_pairs() -> Column:
    """0, every single bit and every pair of bits of 64, without a literal of 2,081 entries."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: j > i), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))
    return F.concat(F.array(F.lit(0).cast("long")), bits, pairs)


#: Three parts of the 64 bits; a projection leaves one of them out and names it there.
PARTS = [(1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42]


def links(fps: DataFrame, distance: int = 4, crowd: int = 64) -> DataFrame:
    """(a, b) between different fingerprints (column fp, distinct, not null): every component of the graph of pairs
    within distance bits is joined by them, and each is such a pair. distance is 4 at most."""
    if not 0 <= distance <= 4:
        raise ValueError("distance must be 0 to 4")
    keys = F.concat(*[_variants(F.col("fp"), ~part & (1 << 64) - 1, 1, tag=(k + 1) << (part & -part).bit_length() - 1) for k, part in enumerate(PARTS)])
    by_key = Window.partitionBy("key").orderBy("fp")
    found = fps.select("fp", F.explode(keys).alias("key")).withColumn("n", F.count("*").over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("n > 1")
    found = written(found.withColumn("before", F.when(F.col("n") <= crowd, F.filter(F.collect_list("fp").over(by_key.rowsBetween(-crowd, -1)), lambda p: F.bit_count(p.bitwiseXOR(F.col("fp"))) <= distance))).filter("n > %d or size(before) > 0" % crowd).select("fp", "n", "before"), "simhash-buckets")
    close = found.filter(F.col("n") <= crowd).select(F.col("fp").alias("a"), F.explode("before").alias("b"))
    crowded = found.filter(F.col("n") > crowd).select("fp").distinct()
    if distance == 4:
        by_variant = Window.partitionBy("variant")
        star = crowded.select("fp", F.explode(_variants(F.col("fp"), (1 << 64) - 1, 2)).alias("variant")).select(F.col("fp").alias("a"), F.min("fp").over(by_variant).alias("b")).filter("a <> b")
    else:  # a bucket of half the distance: verified against its smallest would lose links, so each level is paired
        star = crowded.alias("x").join(crowded.alias("y"), F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).filter("a > b")
    return close.union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, crowd: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that is reached over links within distance bits."""
    fps = written(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    roots = components(links(classes.select("fp"), distance, crowd)).withColumnRenamed("v", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Similar:
    width: int = 5
    similarity: float = 0.8
    distance: int = 4
    samples: int = 8
    smallest: int = 3
    salts: int = 32
    small: int = 13  # texts of a bucket up to which all are compared at once
    heavy: int = 512  # partners of one text from which its set is sent in copies


#: Columns of 64 parities each.
PARITIES = [f"odd{i}" for i in range(8)]


def _sketch(text: bytes, s: Similar) -> tuple[int, ...]:
    """Of a text: hash of its words, number of different shingles, whole fingerprint, and the sample fingerprints."""
    words = text.lower().split()
    same = np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], "<u8").view("<i8")[0]
    if not words:
        return (int(same), 0, *[0] * (1 + s.samples))
    h = np.concatenate(list(shingle_hashes(words, s.width)))
    whole, h = majority(iter([h])), np.unique(h)
    turned = (h[None, :] ^ (np.arange(1, s.samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    turned ^= turned >> np.uint64(32)
    turned *= np.uint64(0xD6E8FEB86659FD93)
    few = np.partition(turned, s.smallest - 1, axis=1)[:, : s.smallest] if len(h) > s.smallest else turned
    bits = np.unpackbits(np.ascontiguousarray(few).view(np.uint8).reshape(s.samples, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return (int(same), len(h), whole, *np.packbits(bits * 2 > few.shape[1], axis=1, bitorder="little").view("<i8")[:, 0].tolist())


def _sets(rows: DataFrame, s: Similar) -> DataFrame:
    """(same, hashes): the sorted distinct shingle hashes of each text (column text), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            words = [(t or b"").lower().split() for t in part.column(0).cast(pa.binary()).to_pylist()]
            same = np.array([xxhash.xxh64_intdigest(b" ".join(w), 43) for w in words], "<u8").view("<i8")
            sets = [np.unique(np.concatenate(list(shingle_hashes(w, s.width)))) if w else np.zeros(0, np.uint64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(same), pa.array([x.tobytes() for x in sets], pa.binary())], ["same", "hashes"])

    return rows.select("text").mapInArrow(run, "same long, hashes binary").dropDuplicates(["same"])


def _verified(pairs: DataFrame, sets: DataFrame, s: Similar) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The set of a text with very many partners goes out in copies."""
    heavy = written(pairs.groupBy("b").count().filter(F.col("count") > s.heavy).select("b", F.lit(True).alias("heavy")), "heavy-partners")
    salted = pairs.join(bounded_broadcast(heavy, 16), "b", "left").select("a", "b", F.when(F.col("heavy"), F.pmod(F.xxhash64("a"), F.lit(s.salts))).otherwise(F.lit(0).cast("long")).alias("salt"))
    left = salted.join(sets.select(F.col("same").alias("a"), F.col("hashes").alias("x")), "a")
    copies = sets.withColumnRenamed("same", "b").join(bounded_broadcast(heavy, 16), "b", "left")
    right = copies.select("b", F.col("hashes").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("heavy"), s.salts - 1).otherwise(0).cast("long"))).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= s.similarity * max(len(x), len(y)) else 0
                keep.append(both >= s.similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _prefixes(loose: DataFrame, s: Similar) -> DataFrame:
    """(same, root, size, token, at, parities) of loose (same, root, size, hashes): the first hashes of each set in one
    order of all hashes, rare ones first. Sets that are similar enough share one of these (prefix filter). The parities
    say of each of 512 classes of hashes whether the set holds an odd number of them: two sets differ in at least as
    many hashes as parities (bitmap filter).

    Any order gives all pairs. The counts that it goes by are those of all sets, of the hashes that are frequent enough
    that 100,000 of them at most are kept."""
    spark = loose.sparkSession
    total = loose.agg(F.sum("size")).first()[0] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "hashes"):
            values, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["token", "n"])

    counted = loose.select("hashes").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(8, total / 100_000))
    rows = counted.collect()
    common = np.array(sorted((r.token, r.n) for r in rows), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value[:, 0], shared.value[:, 1]
        for part in pieces(batches, "hashes"):
            firsts, odd = [], []
            for x in part.column(3):
                x = np.frombuffer(x.as_buffer(), np.int64)
                odd.append(np.packbits(np.bincount(x & 511, minlength=512) & 1).view(np.int64))
                spot = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                often = np.where(known[spot] == x, counts[spot], 0) if len(known) else np.zeros(len(x), np.int64)
                firsts.append(x[np.lexsort((x, often))][: len(x) - int(np.ceil(s.similarity * len(x) - 1e-9)) + 1])
            lengths = [len(x) for x in firsts]
            of = pa.array(np.repeat(np.arange(len(firsts)), lengths))
            at = np.concatenate([np.arange(n) for n in lengths]).astype(np.int64)
            parities = [pa.array(np.ascontiguousarray(c)).take(of) for c in np.array(odd).T]
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(of) for i in range(3)], pa.array(np.concatenate(firsts)), pa.array(at), *parities], ["same", "root", "size", "token", "at", *PARITIES])

    return loose.select("same", "root", "size", "hashes").mapInArrow(run, "same long, root long, size long, token long, at long, " + ", ".join(f"{n} long" for n in PARITIES))


def _rest(crowds: DataFrame, roots: DataFrame, sets: DataFrame, s: Similar) -> DataFrame:
    """Pairs (a, b) of texts in large buckets that may be similar enough and aren't in one component yet: all such pairs.

    A pair of one component can't change the components, so buckets that are one component are done. The sets of the
    others' texts meet by their prefixes; of each pair that meets, one is outside of the prefix's largest component."""
    placed = written(crowds.join(roots.withColumnRenamed("v", "same"), "same", "left").select("table", "value", "same", "size", F.coalesce("root", "same").alias("root")), "similar-placed")
    unsettled = written(placed.groupBy("table", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("table", "value"), "similar-unsettled")
    loose = written(placed.join(bounded_broadcast(unsettled, 16), ["table", "value"], "left_semi").select("same", "size", "root").distinct(), "similar-loose")
    marks = written(_prefixes(written(sets.join(bounded_broadcast(loose, 24), "same"), "similar-loose-sets"), s), "similar-prefixes")
    counted = marks.groupBy("token", "root").agg(F.count("*").alias("n"))
    met = counted.groupBy("token").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("n")).filter("roots > 1")
    met = written(marks.join(met.select("token", "n", F.col("top.root").alias("top")), "token"), "similar-meetings")
    salts = F.when(F.col("n") > s.heavy, s.salts).otherwise(1).cast("long")
    apart = met.filter("root <> top").select("token", F.col("same").alias("a"), F.col("size").alias("x"), F.col("at").alias("i"), F.col("root").alias("p"), *[F.col(n).alias(f"a_{n}") for n in PARITIES], F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    others = met.select("token", F.col("same").alias("b"), F.col("size").alias("y"), F.col("at").alias("j"), F.col("root").alias("q"), "top", *PARITIES, F.pmod(F.xxhash64("same"), salts).alias("salt"))
    each_once = (F.col("q") == F.col("top")) | (F.col("a") > F.col("b"))
    enough = F.least(F.col("x") - F.col("i"), F.col("y") - F.col("j")) >= s.similarity / (1 + s.similarity) * (F.col("x") + F.col("y")) - 1e-6
    differing = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"a_{n}"))) for n in PARITIES), F.lit(0))
    alike = differing <= (1 - s.similarity) / (1 + s.similarity) * (F.col("x") + F.col("y")) + 1e-6
    pairs = apart.join(others, ["token", "salt"]).filter((F.col("p") != F.col("q")) & each_once & enough & alike)
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar(docs: DataFrame, key_col: str, text_col: str = "text", s: Similar = Similar()) -> DataFrame:
    """(key, group): texts linked by similar pairs have the same group, other texts one of their own.

    key is a long that isn't null; rows with equal keys must have equal texts. Null and empty texts are equal texts; a
    text of fewer words than ``width`` is one shingle. Texts that differ in letter case (A-Z) or white space are equal."""
    names = [f"s{i}" for i in range(s.samples)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            rows = np.array([_sketch(t or b"", s) for t in part.column(1).cast(pa.binary()).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], ["key", "same", "size", "fp", *names])

    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    sketches = written(texts.mapInArrow(run, "key long, same long, size long, fp long, " + ", ".join(f"{n} long" for n in names)), "similar-sketches")
    classes = written(sketches.groupBy("same").agg(F.min("key").alias("key"), F.min("size").alias("size"), F.min("fp").alias("fp"), *[F.min(n).alias(n) for n in names]), "similar-classes")

    turned = F.col("same").bitwiseXOR(F.xxhash64("table"))  # another order in every table, so other texts are the smallest
    members = classes.select("same", "size", F.posexplode(F.array("fp", *names)).alias("table", "value")).withColumn("salt", F.pmod(F.xxhash64("same"), F.lit(s.salts)))
    nearest = members.groupBy("table", "value", "salt").agg(F.min(turned).alias("near"), F.count("*").alias("n"))
    first = nearest.groupBy("table", "value").agg(F.min("near").alias("far"), F.sum("n").alias("n")).filter("n > 1")
    leaders = nearest.drop("n").join(first, ["table", "value"])
    met = members.join(leaders, ["table", "value", "salt"]).select("same", "size", "table", "value", "near", "far", "n", turned.alias("order"))
    before = F.collect_list("order").over(Window.partitionBy("table", "value").orderBy("order").rowsBetween(-s.small, -1))
    small = met.filter(F.col("n") <= s.small).withColumn("others", before).select("same", "table", F.explode("others").alias("other"))
    crowds = written(met.filter(F.col("n") > s.small), "similar-crowds")
    star = crowds.select("same", "table", F.explode(F.array("near", "far")).alias("other"))
    by_sample = small.union(star).select(F.col("same").alias("a"), F.col("other").bitwiseXOR(F.xxhash64("table")).alias("b"))

    of_fp = classes.groupBy("fp").agg(F.min("same").alias("same"))
    balls = written(links(of_fp.select("fp"), s.distance), "similar-balls")
    by_ball = balls.join(of_fp.select(F.col("fp").alias("a"), F.col("same").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("same").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = written(by_sample.union(by_ball).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "similar-candidates")

    paired = pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct()
    keys = written(classes.join(paired, "same", "left_semi").select("key"), "similar-keys")
    sets = written(_sets(texts.join(bounded_broadcast(keys, 16), "key", "left_semi"), s), "similar-sets")
    close = written(_verified(pairs, sets, s), "similar-links")
    roots = written(components(close), "similar-roots")
    rest = written(_rest(crowds, roots, sets, s), "similar-rest")
    if not rest.isEmpty():
        close = close.union(written(_verified(rest, sets, s), "similar-links"))
        roots = written(components(close), "similar-roots")
    return sketches.select("key", "same").join(roots.withColumnRenamed("v", "same"), "same", "left").select("key", F.coalesce("root", "same").alias("group"))
