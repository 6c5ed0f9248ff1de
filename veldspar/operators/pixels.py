"""Pixel analytics over a long table of pixels (image, x, y, r, g, b) or of marked pixels (image, x, y, cluster): many
images at once, so every step groups or joins by image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions import calc
from veldspar.operators.windows import bands
from veldspar.sources.scratch import shared_folder

# Fixed value: squared colour distance beyond which a pixel isn't background.
FAR = 60 * 60

# Fixed value: squared colour distance up to which a pixel is background for certain.
NEAR = 30 * 30


def _written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of files. These are far smaller than their rows, so Spark would broadcast too much by their size: joins of
    as many rows as there are pixels are hinted to merge."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side, for tables that grow with the images. What is grouped from written pixels is also
    taken for small before it is counted, and a broadcast that was planned once stays."""
    return left.join(right.hint("merge"), on, how)


def _distance(a: str, b: str) -> Column:
    return sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in ("r", "g", "b"))


def background(pixels: DataFrame) -> DataFrame:
    """(image, bg_r, bg_g, bg_b): the border's most frequent colour (ties by colour), or the whole image's if that leaves
    less foreground."""
    ends = pixels.groupBy("image").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    on_edge = (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))
    colours = pixels.join(ends, "image").groupBy("image", "r", "g", "b").agg(F.count("*").alias("n"), F.count_if(on_edge).alias("edge"))
    most = lambda n: F.max_by(F.struct("r", "g", "b"), F.struct(F.col(n), -F.col("r"), -F.col("g"), -F.col("b")))
    best = colours.groupBy("image").agg(most("edge").alias("e"), most("n").alias("c"))
    with_best = colours.join(best, "image").select("*", *[F.col(f"e.{k}").alias(f"e{k}") for k in "rgb"], *[F.col(f"c.{k}").alias(f"c{k}") for k in "rgb"])
    far = lambda p: F.sum(F.when(_distance("", p) > FAR, F.col("n")).otherwise(0))
    sums = with_best.groupBy("image").agg(far("e").alias("fe"), far("c").alias("fc"), F.first("e").alias("e"), F.first("c").alias("c"))
    pick = F.when(F.col("fc") < F.col("fe"), F.col("c")).otherwise(F.col("e"))
    return sums.select("image", pick.alias("p")).select("image", *[F.col(f"p.{k}").alias(f"bg_{k}") for k in "rgb"])


def foreground(pixels: DataFrame, bg: DataFrame, most: float = 0.5) -> DataFrame:
    """Pixels far from the background, of images in which they are at most ``most`` of all."""
    marked = pixels.join(bg, "image").withColumn("fg", _distance("", "bg_") > FAR)
    keep = marked.groupBy("image").agg((F.count_if("fg") / F.count("*")).alias("share")).filter(F.col("share") <= most).select("image")
    return marked.filter("fg").join(keep, "image", "left_semi").select("image", "x", "y", "r", "g", "b")


def hue_clusters(fg: DataFrame, most: int = 6, reach: int = 3, least_saturation: float = 0.2) -> DataFrame:
    """(image, cluster, hue): peaks of the histogram of hues in 5-degree bins, weighted by saturation; a peak takes the
    bins within ``reach`` of it. A bounded number of rounds."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    s = calc.saturation(*rgb)
    hist = _written(fg.filter(s >= least_saturation).groupBy("image", F.floor(calc.hue(*rgb) / 5).cast("int").alias("slot")).agg(F.sum(s).alias("w")).filter("slot is not null"), "hues")
    out = None
    for k in range(1, most + 1):
        peak = hist.groupBy("image").agg(F.max_by("slot", F.struct(F.col("w"), -F.col("slot"))).alias("peak"))
        found = peak.select("image", F.lit(k).alias("cluster"), (F.col("peak") * 5 + 2.5).alias("hue"))
        out = found if out is None else out.union(found)
        gap = F.least(F.pmod(F.col("slot") - F.col("peak"), F.lit(72)), F.pmod(F.col("peak") - F.col("slot"), F.lit(72)))
        hist = _written(hist.join(peak, "image").filter(gap > reach).select("image", "slot", "w"), "hues")
    return out


def assigned(fg: DataFrame, centres: DataFrame, least_saturation: float = 0.2, widest: float = 30.0) -> DataFrame:
    """fg with its cluster: 0 for neutral pixels, the nearest hue, or -1 (fringe) beyond ``widest`` degrees."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    per_image = centres.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("cluster", "hue"))).alias("centres"))  # at most six
    gaps = F.transform("centres", lambda c: F.struct(calc.hue_gap(c["hue"], calc.hue(*rgb)).alias("gap"), c["cluster"].alias("cluster")))
    nearest = F.array_min(gaps)
    return fg.join(per_image, "image", "left").withColumn("cluster", F.when(calc.saturation(*rgb) < least_saturation, 0).when(nearest["gap"] <= widest, nearest["cluster"]).otherwise(-1)).drop("centres")


def _neighbours(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row at all positions around it, as (image, x, y)."""
    around = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx or dy]
    return df.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around]))).withColumns({"x": F.col("x") + F.col("_d.dx"), "y": F.col("y") + F.col("_d.dy")}).drop("_d")


def absorbed(marked: DataFrame, passes: int = 2) -> DataFrame:
    """Fringe pixels (cluster -1) take the most frequent cluster around them, in a bounded number of passes."""
    for _ in range(passes):
        near = _neighbours(marked.filter("cluster > 0").select("image", "x", "y", F.col("cluster").alias("_c"))).groupBy("image", "x", "y", "_c").agg(F.count("*").alias("n")).groupBy("image", "x", "y").agg(F.max_by("_c", F.struct(F.col("n"), -F.col("_c"))).alias("_c"))
        marked = _written(marked.join(near.hint("merge"), ["image", "x", "y"], "left").withColumn("cluster", F.when((F.col("cluster") == -1) & F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col("cluster"))).drop("_c"), "absorbed")
    return marked


def faint(pixels: DataFrame, bg: DataFrame, least_saturation: float = 0.25) -> DataFrame:
    """(image, x, y): pixels without colour that differ from the background, but too little for the foreground."""
    d = _distance("", "bg_")
    grey = F.coalesce(calc.saturation(F.col("r"), F.col("g"), F.col("b")), F.lit(0.0)) < least_saturation
    return pixels.join(bg, "image").filter((d > NEAR) & (d <= FAR) & grey).select("image", "x", "y")


def absorbed_faint(marked: DataFrame, pale: DataFrame, width: int = 1 << 20) -> DataFrame:
    """marked (image, x, y, cluster) and the faint pixels (image, x, y) whose group touches a neutral one (cluster 0), as
    neutral. Groups are taken whole, so the order in which pixels are looked at doesn't matter."""
    groups = _written(components(pale.withColumn("cluster", F.lit(0)), 1, width), "faint")
    touched = groups.join(_neighbours(marked.filter("cluster = 0").select("image", "x", "y")), ["image", "x", "y"], "left_semi").select("image", "component").distinct()
    return marked.unionByName(groups.join(touched, ["image", "component"], "left_semi").select("image", "x", "y", "cluster"), allowMissingColumns=True)


def _smallest_labels(nodes: DataFrame, edges: DataFrame, keys: list[str], most_rounds: int) -> DataFrame:
    """(keys, p, component): the smallest p among the nodes (keys, p) that edges (keys, p, q; both ways) connect. Minimum
    labels go to the neighbours and then along their own label, until none changes."""
    now = _written(nodes.select(*keys, "p", F.col("p").alias("label")), "labels")
    for _ in range(most_rounds):
        spread = edges.join(now.select(*keys, F.col("p").alias("q"), "label").hint("merge"), [*keys, "q"]).groupBy(*keys, "p").agg(F.min("label").alias("m"))
        step = now.join(spread.hint("merge"), [*keys, "p"], "left").select(*keys, "p", "label", F.least("label", "m").alias("m"))
        jump = step.join(step.select(*keys, F.col("p").alias("m"), F.col("m").alias("mm")).hint("merge"), [*keys, "m"], "left").select(*keys, "p", F.least("m", "mm").alias("label"), (F.least("m", "mm") < F.col("label")).alias("changed"))
        after = _written(jump, "labels")
        now = after.drop("changed")
        if not after.filter("changed").limit(1).count():
            return now.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


# Fixed value: side of the square tiles in which touching pixels are found at once.
TILE = 256


def _half(reach: int) -> list[tuple[int, int]]:
    """The steps to positions around one, of each opposite pair one."""
    return [(dx, dy) for dy in range(reach + 1) for dx in range(-reach, reach + 1) if dy or dx > 0]


def _tile_labels(group: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, reach: int) -> np.ndarray:
    """For pixels at x, y of a tile (both from 0) the smallest p that they touch, over others of their group."""
    wide = TILE + 2 * reach
    codes, place = np.unique((group * wide + y + reach) * wide + x + reach, return_inverse=True)
    label, pairs = np.arange(len(codes)), []
    for dx, dy in _half(reach):
        to = codes + dy * wide + dx
        at = np.minimum(np.searchsorted(codes, to), len(codes) - 1)
        hit = np.flatnonzero(codes[at] == to)
        pairs.append((hit, at[hit]))
    a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    least = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(least, label[place], p)
    return least[label[place]]


def components(marked: DataFrame, reach: int = 1, width: int = 1 << 20, most_rounds: int = 200) -> DataFrame:
    """marked (image, x, y, cluster) with component: the smallest position (y * width + x) of the pixels of one cluster
    that touch each other. Tiles of a fixed size label their own pixels, as many at a time as a batch holds; labels that
    touch across the sides of tiles are then connected. Pixels without an image, cluster or position are left out."""
    tile = {"_tx": F.floor(F.col("x") / TILE).cast("long"), "_ty": F.floor(F.col("y") / TILE).cast("long")}
    keys = ["image", "cluster", "_tx", "_ty"]
    known = marked.dropna(subset=["image", "cluster", "x", "y"]).withColumns({**tile, "_p": F.col("y").cast("long") * width + F.col("x")})
    dealt = known.repartition(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*dealt.schema.fields, T.StructField("_l", T.LongType())])

    def labelled(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        x, y, tx, ty, p = (rows[c].to_numpy().astype(np.int64) for c in ("x", "y", "_tx", "_ty", "_p"))
        label = _tile_labels(np.cumsum(new), x - tx * TILE, y - ty * TILE, p, reach)
        (out,) = rows.append_column("_l", pa.array(label)).combine_chunks().to_batches()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            new = _changes(held, keys)
            last = int(np.flatnonzero(new)[-1])  # the last tile may go on in the next batch
            if last:
                yield labelled(held.slice(0, last), new[:last])
                held = held.slice(last)
        if held is not None:
            yield labelled(held, _changes(held, keys))

    own = _written(dealt.mapInArrow(run, schema), "tiles")
    lx, ly = F.col("x") - F.col("_tx") * TILE, F.col("y") - F.col("_ty") * TILE
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _half(reach)])
    across = F.filter(steps, lambda s: (lx + s["dx"] < 0) | (lx + s["dx"] >= TILE) | (ly + s["dy"] >= TILE))
    out = own.select("image", "cluster", "x", "y", F.col("_l").alias("p"), F.explode(across).alias("_s")).select("image", "cluster", (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y"), "p")
    rim = own.filter((lx < reach) | (lx >= TILE - reach) | (ly < reach)).select("image", "cluster", "x", "y", F.col("_l").alias("q"))
    pairs = _written(out.join(rim.hint("merge"), ["image", "cluster", "x", "y"]).select("image", "cluster", "p", "q").distinct(), "touching")
    columns = marked.columns
    if not pairs.limit(1).count():
        return own.select(*columns, F.col("_l").alias("component"))
    edges = pairs.union(pairs.select("image", "cluster", F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    joined = _smallest_labels(edges.select("image", "cluster", "p").distinct(), edges, ["image", "cluster"], most_rounds)
    return own.join(joined.withColumnRenamed("p", "_l").hint("merge"), ["image", "cluster", "_l"], "left").select(*columns, F.coalesce("component", "_l").alias("component"))


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the keys are others than in the row before; true for the first row."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(rows[k].slice(1), rows[k].slice(0, rows.num_rows - 1)).to_numpy() for k in keys])
    return new


def geometry(parts: DataFrame) -> DataFrame:
    """Box, area, fill, aspect and centre of each component."""
    g = parts.groupBy("image", "cluster", "component").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return g.withColumns({"fill": F.col("area") / (w * h), "aspect": w / h})


def line_bands(marked: DataFrame, least: int = 8, share: float = 0.4, gap: int = 2, thickest: int = 6, vertical: bool = False) -> DataFrame:
    """(image, first, last): bands of rows (columns, if vertical) that are covered enough, thin ones only."""
    along, across = ("y", "x") if vertical else ("x", "y")
    width = marked.groupBy("image").agg((F.max(along) - F.min(along) + 1).alias("w"))
    rows = marked.groupBy("image", across).agg(F.countDistinct(along).alias("n")).join(width, "image").filter(F.col("n") >= F.greatest(F.lit(least), share * F.col("w")))
    return bands(rows, ["image"], across, gap).filter(F.col("last") - F.col("first") + 1 <= thickest)


def line_extent(marked: DataFrame, least: int = 8) -> DataFrame:
    """(image, y, first, last): from the first to the last run of at least ``least`` pixels of each row."""
    runs = bands(marked.select("image", "y", "x").distinct(), ["image", "y"], "x", 1).filter(F.col("last") - F.col("first") + 1 >= least)
    return runs.groupBy("image", "y").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def trimmed(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Lines (image, y, first, last) cut at the outermost vertical frame lines (image, x)."""
    ends = frames.groupBy("image").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return lines.join(ends, "image", "left").withColumns({"first": F.greatest("first", "lo"), "last": F.least("last", "hi")}).drop("lo", "hi").filter("first <= last")


def round_parts(parts: DataFrame) -> DataFrame:
    """Components with two tests: a round box that is filled like a disc, and 90 % of the pixels inside its ellipse."""
    g = geometry(parts)
    rx, ry = (F.col("x1") - F.col("x0") + 1) / 2, (F.col("y1") - F.col("y0") + 1) / 2
    dx, dy = (F.col("x") + 0.5 - F.col("x0") - rx) / rx, (F.col("y") + 0.5 - F.col("y0") - ry) / ry
    inside = parts.join(g, ["image", "cluster", "component"]).groupBy("image", "cluster", "component").agg(F.count_if(dx * dx + dy * dy <= 1.0 + 1e-9).alias("inside"))
    return g.join(inside, ["image", "cluster", "component"]).select("image", "cluster", "component", "area", (F.col("aspect").between(0.7, 1.43) & F.col("fill").between(0.6, 0.95)).alias("is_round"), (F.col("inside") >= 0.9 * F.col("area")).alias("is_disc"))


def rings(parts: DataFrame, sizes: DataFrame, least_share: float = 0.6, least_size: float = 0.3, square: float = 0.12, most_fill: float = 0.25, stroke: tuple[float, float] = (3.0, 0.05)) -> DataFrame:
    """(image, cluster, component, cx, cy, radius, tolerance, covered): of each image (sizes: image, w, h) the component with
    the largest box (ties: the smallest) among those that are large, square and hollow. Its outline is what the pixels of
    its cluster leave within the tolerance of the radius; that has to be in ``least_share`` of 72 angle bins."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    fits = (F.least(w, h) >= least_size * F.least("image_w", "image_h")) & (F.abs(w - h) <= square * F.greatest(w, h)) & (F.col("fill") <= most_fill)
    sized = _merged(geometry(parts), sizes.select("image", F.col("w").alias("image_w"), F.col("h").alias("image_h")), ["image"]).filter(fits)
    best = sized.groupBy("image").agg(F.max_by(F.struct("cluster", "component", "x0", "x1", "y0", "y1"), F.struct(w * h, -F.col("component"), -F.col("cluster"))).alias("b")).select("image", "b.*")
    radius = (w + h) / 4
    ring = best.select("image", "cluster", "component", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), radius.alias("radius"), F.greatest(F.lit(stroke[0]), stroke[1] * radius).alias("tolerance"))
    on = _polar(_merged(parts.select("image", "cluster", "x", "y"), ring, ["image", "cluster"])).filter(F.abs(F.col("_d") - F.col("radius")) <= F.col("tolerance"))
    covered = on.groupBy("image").agg((F.countDistinct(F.floor(F.col("_a") / 5)) / 72).alias("covered")).filter(F.col("covered") >= least_share)
    return _merged(ring, covered, ["image"])


def _polar(df: DataFrame) -> DataFrame:
    """Distance (_d) and angle in degrees (_a; rounded, so that 45 is 45 everywhere) of x, y from cx, cy."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return df.withColumns({"_d": F.hypot(dx, dy), "_a": F.pmod(F.round(F.degrees(F.atan2(dy, dx)), 9), F.lit(360.0))})


def ring_notches(parts: DataFrame, found: DataFrame, inner: float = 0.8, clear: int = 2, least: int = 4) -> DataFrame:
    """(image, angle, n): where the ring's own pixels reach inwards, between ``inner`` of the radius and its stroke, with no
    pixel of another cluster within ``clear``. The densest three neighbouring bins of 5 degrees (ties: the smallest) give
    the circular mean of their pixels, if there are ``least`` of them."""
    own = _polar(_merged(parts.select("image", "cluster", "component", "x", "y"), found.drop("covered"), ["image", "cluster", "component"]))
    dents = own.filter((F.col("_d") >= inner * F.col("radius")) & (F.col("_d") < F.col("radius") - F.col("tolerance")))
    near = _neighbours(dents.select("image", "cluster", "x", "y", F.col("x").alias("_x"), F.col("y").alias("_y")), clear)
    others = _merged(near, parts.select("image", "x", "y", F.col("cluster").alias("_other")), ["image", "x", "y"]).filter("_other <> cluster").select("image", F.col("_x").alias("x"), F.col("_y").alias("y"))
    free = _merged(dents, others, ["image", "x", "y"], "left_anti").select("image", F.floor(F.col("_a") / 5).cast("int").alias("own"), F.radians("_a").alias("a"))
    three = free.select("image", "own", "a", F.explode(F.array(*[F.pmod(F.col("own") + k, F.lit(72)) for k in (-1, 0, 1)])).alias("slot"))
    sums = three.groupBy("image", "slot").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("slot")).alias("held"), F.sum(F.sin("a")).alias("s"), F.sum(F.cos("a")).alias("c")).filter((F.col("held") > 0) & (F.col("n") >= least))
    return sums.groupBy("image").agg(F.max_by(F.struct("s", "c", "n"), F.struct(F.col("n"), -F.col("slot"))).alias("b")).select("image", F.pmod(F.degrees(F.atan2("b.s", "b.c")), F.lit(360.0)).alias("angle"), "b.n")


def notch(angles: DataFrame) -> DataFrame:
    """(image, angle): circular mean of the densest three neighbouring angle bins. angles: image, slot (0-71), n."""
    axis = angles.select("image").distinct().join(F.broadcast(angles.sparkSession.range(72).select(F.col("id").cast("int").alias("slot"))))
    full = axis.join(angles, ["image", "slot"], "left").select("image", "slot", F.coalesce("n", F.lit(0)).alias("n"))
    spread = full.select("image", "n", F.col("slot").alias("own"), F.explode(F.array(*[F.pmod(F.col("slot") + k, F.lit(72)) for k in (-1, 0, 1)])).alias("slot"))
    rad = F.radians(F.col("own") * 5 + 2.5)
    three = spread.groupBy("image", "slot").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.sin(rad)).alias("s"), F.sum(F.col("n") * F.cos(rad)).alias("c"))
    return three.groupBy("image").agg(F.max_by(F.struct("s", "c"), F.struct(F.col("n"), -F.col("slot"))).alias("b")).select("image", F.pmod(F.degrees(F.atan2("b.s", "b.c")), F.lit(360.0)).alias("angle"))


def text_rows(g: DataFrame, least: int = 3, gap: float = 2.0) -> DataFrame:
    """(image, y, first, last, n): aligned components of about one height whose gaps are small, three and more."""
    h = F.col("y1") - F.col("y0") + 1
    w = Window.partitionBy("image", "row").orderBy("x0")
    row = g.withColumn("row", F.floor(F.col("cy") / 2)).withColumn("h", h)
    new = F.coalesce(((F.col("x0") - F.lag("x1").over(w) > gap * F.col("h")) | (F.col("h") > 2 * F.lag("h").over(w)) | (F.lag("h").over(w) > 2 * F.col("h"))).cast("int"), F.lit(0))
    runs = row.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("image", "row", "_g").agg(F.min("x0").alias("first"), F.max("x1").alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_g")


def _turned(g: DataFrame) -> DataFrame:
    """Boxes with rows and columns exchanged."""
    return g.withColumns({"x0": F.col("y0"), "y0": F.col("x0"), "x1": F.col("y1"), "y1": F.col("x1")})


def near_pairs(g: DataFrame, gap: float = 1.3, shift: float = 0.4, ratio: float = 1.67) -> DataFrame:
    """(image, p, q): boxes (image, p, x0, x1, y0, y1) of like heights that stand beside each other, p being the left one.
    Heights differ by ``ratio`` at most, the gap and the shift of the centres are at most that share of the larger one.

    A box meets others in square cells whose side follows the height: the right one is in the cell of its left end and
    centre alone, the left one in all cells where such an end can be, so a pair meets once. Pixels belong to one
    component, so a cell holds a bounded number of boxes."""
    h, centre = (F.col("y1") - F.col("y0") + 1).cast("double"), (F.col("y0") + F.col("y1")) / 2
    level = F.floor(F.log2("h"))
    b = g.select("image", "p", "x0", "x1", h.alias("h"), centre.alias("centre"))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level") + 1))
    right = b.withColumn("level", level).select("image", "level", cell(F.col("x0")).alias("cx"), cell(F.col("centre")).alias("cy"), *[F.col(c).alias(f"r_{c}") for c in ("p", "x0", "h", "centre")])
    left = b.withColumn("level", F.explode(F.sequence(F.floor(F.log2(F.col("h") / ratio)), F.floor(F.log2(F.col("h") * ratio)))))
    left = left.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1") + gap * ratio * F.col("h")))))
    left = left.withColumn("cy", F.explode(F.sequence(cell(F.col("centre") - shift * ratio * F.col("h")), cell(F.col("centre") + shift * ratio * F.col("h")))))
    larger = F.greatest("h", "r_h")
    fits = (F.struct("x0", "p") < F.struct(F.col("r_x0").alias("x0"), F.col("r_p").alias("p"))) & (F.col("r_x0") - F.col("x1") <= gap * larger)
    fits &= (F.abs(F.col("centre") - F.col("r_centre")) <= shift * larger) & (larger <= ratio * F.least("h", "r_h"))
    return _merged(left, right, ["image", "level", "cx", "cy"]).filter(fits).select("image", "p", F.col("r_p").alias("q"))


def text_runs(g: DataFrame, vertical: bool = False, least: int = 2, most_rounds: int = 200) -> DataFrame:
    """(image, component, run): boxes (image, component, x0, x1, y0, y1, is_round) that chains of near pairs connect, ``least``
    in a run and not all of them round. run is the smallest component in it. g's components are unique in an image."""
    b = (_turned(g) if vertical else g).withColumn("p", F.col("component").cast("long"))
    pairs = _written(near_pairs(b), "pairs")
    labels = _smallest_labels(b, pairs.union(pairs.select("image", F.col("q").alias("p"), F.col("p").alias("q"))), ["image"], most_rounds).withColumnRenamed("component", "run")
    runs = _merged(b.select("image", "component", "is_round", "p"), labels, ["image", "p"])
    kept = runs.groupBy("image", "run").agg(F.count("*").alias("n"), F.bool_and("is_round").alias("dots")).filter((F.col("n") >= least) & ~F.col("dots")).select("image", "run")
    return _merged(runs, kept, ["image", "run"], "left_semi").select("image", "component", "run")


def aligned_boxes(g: DataFrame, vertical: bool = False, least: int = 3, slack: tuple[float, float] = (2.5, 0.25), ratio: float = 1.43) -> DataFrame:
    """(image, component, row): boxes on one line, however far apart: in the order of their centres a box joins the row
    before it if its centre follows the last one's within the slack (pixels, or share of the first one's height) and its
    height is like the first one's. Rows of ``least`` boxes stay, if not all of them are round.

    An image's boxes pass through a task in order; only the row's first and last box are held."""
    b = _turned(g) if vertical else g
    ordered = b.select("image", "component", "is_round", ((F.col("y0") + F.col("y1")) / 2).alias("centre"), (F.col("y1") - F.col("y0") + 1).cast("double").alias("h")).repartition("image").sortWithinPartitions("image", "centre", "component")

    def numbered(chunks):  # noqa: ANN001, ANN202
        image, first, last, row = object(), 0.0, 0.0, 0
        for chunk in chunks:
            rows = []
            for i, centre, h in zip(chunk["image"], chunk["centre"], chunk["h"], strict=True):
                if i != image:
                    image, first, row = i, h, 0
                elif centre - last > max(slack[0], slack[1] * first) or max(h, first) > ratio * min(h, first):
                    first, row = h, row + 1
                last = centre
                rows.append(row)
            yield chunk.assign(row=rows)

    rows = ordered.mapInPandas(numbered, T.StructType([*ordered.schema.fields, T.StructField("row", T.LongType())]))
    kept = rows.groupBy("image", "row").agg(F.count("*").alias("n"), F.bool_and("is_round").alias("dots")).filter((F.col("n") >= least) & ~F.col("dots")).select("image", "row")
    return rows.join(kept, ["image", "row"], "left_semi").select("image", "component", "row")


def unit_areas(g: DataFrame) -> DataFrame:
    """(image, unit): the median area of round components, then the median of those up to three times it."""
    med = g.groupBy("image").agg(F.median("area").alias("m"))
    return g.join(med, "image").filter(F.col("area") <= 3 * F.col("m")).groupBy("image").agg(F.median("area").alias("unit"))


def point_counts(g: DataFrame, units: DataFrame, noise: float = 0.25) -> DataFrame:
    """Components with their estimated points: area over unit, half to even, one at least; smaller specks go."""
    return g.join(units, "image").filter(F.col("area") >= noise * F.col("unit")).withColumn("points", F.greatest(F.lit(1), F.rint(F.col("area") / F.col("unit")).cast("int")))


def without_halos(parts: DataFrame, share: float = 0.5) -> DataFrame:
    """Components without the neutral ones (cluster 0) of whose pixels this share touches coloured pixels."""
    near = _neighbours(parts.filter("cluster > 0").select("image", "x", "y")).distinct()
    neutral = parts.filter("cluster = 0")
    touched = neutral.join(near.hint("merge"), ["image", "x", "y"], "left_semi").groupBy("image", "component").agg(F.count("*").alias("t"))
    halos = neutral.groupBy("image", "component").agg(F.count("*").alias("n")).join(touched, ["image", "component"]).filter(F.col("t") >= share * F.col("n")).select("image", "component", F.lit(0).alias("cluster"))
    return parts.join(halos, ["image", "component", "cluster"], "left_anti")


def depth(parts: DataFrame, rounds: int = 4) -> DataFrame:
    """parts with depth: how many times a pixel survives the removal of the pixels at the edge of its component."""
    keys = ["image", "component", "x", "y"]
    left, out = parts.select(*keys), None
    for k in range(1, rounds + 1):
        both = left.withColumn("_own", F.lit(1)).union(_neighbours(left).select(*keys, F.lit(0).alias("_own")))
        inner = both.groupBy(*keys).agg(F.count_if(F.col("_own") == 0).alias("n"), F.max("_own").alias("_own")).filter("n = 8 and _own = 1").select(*keys)
        inner = _written(inner, "depth")
        out = inner.withColumn("depth", F.lit(k)) if out is None else out.union(inner.withColumn("depth", F.lit(k)))
        left = inner
    deep = out.groupBy(*keys).agg(F.max("depth").alias("depth"))
    return parts.join(deep.hint("merge"), keys, "left").fillna(0, ["depth"])


def chamfer(parts: DataFrame, most_rounds: int = 256) -> DataFrame:
    """parts with distance: 3 for each straight and 4 for each diagonal step to the nearest position outside of the pixel's
    component. Borders start; distances go from pixels that have changed to their neighbours until none changes, which
    takes as many rounds as the thickest part is deep, and raises beyond ``most_rounds``."""
    keys = ["image", "cluster", "component", "x", "y"]
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(4 if dx and dy else 3).alias("cost")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    to = lambda df: df.withColumn("_s", F.explode(steps)).withColumns({"x": F.col("x") + F.col("_s.dx"), "y": F.col("y") + F.col("_s.dy")})
    pixel = _written(parts.select(*keys).dropna(), "parts")
    around = pixel.withColumn("_cost", F.lit(0)).union(to(pixel).select(*keys, F.col("_s.cost").alias("_cost")))
    held = around.groupBy(*keys).agg(F.count_if(F.col("_cost") == 3).alias("straight"), F.count_if(F.col("_cost") > 0).alias("n"), F.min("_cost").alias("_own")).filter("_own = 0")
    start = F.when(F.col("straight") < 4, 3).when(F.col("n") < 8, 4)
    now = _written(held.select(*keys, start.cast("int").alias("distance"), start.isNotNull().alias("changed")), "distances")
    for _ in range(most_rounds):
        if not now.filter("changed").limit(1).count():
            return now.select(*keys, "distance") if set(parts.columns) == set(keys) else parts.join(now.drop("changed").hint("merge"), keys)
        offers = to(now.filter("changed").select(*keys, "distance")).select(*keys, F.lit(False).alias("_own"), (F.col("distance") + F.col("_s.cost")).alias("distance"))
        both = now.select(*keys, F.lit(True).alias("_own"), "distance").union(offers).groupBy(*keys).agg(F.bool_or("_own").alias("_own"), F.min(F.when(F.col("_own"), F.col("distance"))).alias("_was"), F.min("distance").alias("distance"))
        better = F.coalesce(F.col("distance") < F.col("_was"), F.col("distance").isNotNull() & F.col("_was").isNull())
        now = _written(both.filter("_own").select(*keys, "distance", better.alias("changed")), "distances")
    raise RuntimeError(f"distances did not settle in {most_rounds} rounds")


def markers(deep: DataFrame, thickness: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(image, cluster, component, marker, cx, cy, core, reach): markers on a curve. deep are its pixels with their chamfer
    distance, thickness (image, thickness) is that of the curves. Pixels that lie deeper than a curve and a pixel are a
    marker's core; touching ones are one marker, named by its smallest position, and reach is how far its body goes."""
    cut = F.rint((F.col("thickness") + 1) * 3)
    core = _merged(deep, thickness, ["image"]).filter(F.col("distance") >= cut).select("image", "cluster", "x", "y", F.col("component").alias("_part"), "distance")
    found = components(core, 1, width)
    return found.groupBy("image", "cluster", F.col("_part").alias("part"), F.col("component").alias("marker")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("core"), (F.max("distance") / 3 + 0.5).alias("reach")).withColumnRenamed("part", "component")


def marker_bodies(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(image, cluster, component, marker, x, y): the pixels of the part within a marker's reach. A marker lists the
    positions it reaches, so work grows with the markers' areas, not with pixels times markers."""
    r = F.col("reach")
    at = lambda c, n: F.explode(F.sequence(F.ceil(F.col(c) - r).cast("int"), F.floor(F.col(c) + r).cast("int"))).alias(n)
    reached = found.select("*", at("cx", "x")).select("*", at("cy", "y")).filter(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= r)
    return _merged(reached.select("image", "cluster", "component", "marker", "x", "y"), parts.select("image", "cluster", "component", "x", "y"), ["image", "cluster", "component", "x", "y"])


def curves(parts: DataFrame, least_span: float = 0.4, least_filled: float = 0.9) -> DataFrame:
    """(image, component, columns, thickness): components that span enough of the image, in most of its columns; the
    thickness is the 20th percentile of their vertical runs."""
    image = parts.groupBy("image").agg((F.max("x") - F.min("x") + 1).alias("w"))
    column = parts.groupBy("image", "component", "x").agg(F.count("*").alias("run"))
    c = column.groupBy("image", "component").agg(F.count("*").alias("columns"), (F.max("x") - F.min("x") + 1).alias("span"), F.percentile("run", F.lit(0.2)).alias("thickness"))
    return c.join(image, "image").filter((F.col("span") >= least_span * F.col("w")) & (F.col("columns") >= least_filled * F.col("span"))).select("image", "component", "columns", "thickness")


def cells(marked: DataFrame, columns: int, rows: int) -> DataFrame:
    """(image, cell_x, cell_y, cluster, n): pixels per cell of a grid over the content's box."""
    box = marked.groupBy("image").agg(F.min("x").alias("x0"), (F.max("x") - F.min("x") + 1).alias("w"), F.min("y").alias("y0"), (F.max("y") - F.min("y") + 1).alias("h"))
    j = marked.join(box, "image")
    return j.groupBy("image", F.floor((F.col("x") - F.col("x0")) * columns / F.col("w")).cast("int").alias("cell_x"), F.floor((F.col("y") - F.col("y0")) * rows / F.col("h")).cast("int").alias("cell_y"), "cluster").agg(F.count("*").alias("n"))


def allocated(shares: DataFrame, keys: list[str], cell: list[str], weight: str, total: str) -> DataFrame:
    """Each group's total over its cells in proportion to their weights, by largest remainders: sums are kept."""
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys))
    df = shares.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.col(total) - F.sum("_f").over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), *cell)
    return df.withColumn("_left", left).withColumn("_n", F.row_number().over(order)).withColumn("allocated", (F.col("_f") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_e", "_f", "_left", "_n")


def slopes(marked: DataFrame, size: int) -> DataFrame:
    """(image, cell_x, cell_y, angle): principal direction, in degrees, of the pixels of a cell and the cells around it."""
    cx, cy = F.floor(F.col("x") / size).cast("int"), F.floor(F.col("y") / size).cast("int")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = marked.groupBy("image", cx.alias("x"), cy.alias("y")).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    wide = _neighbours(m).join(m.select("image", "x", "y"), ["image", "x", "y"], "left_semi").union(m.select("image", "n", "sx", "sy", "sxx", "syy", "sxy", "x", "y").select(*_neighbours(m).columns))
    s = wide.groupBy("image", "x", "y").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    xx, yy, xy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return s.select("image", F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), F.degrees(0.5 * F.atan2(2 * xy, xx - yy)).alias("angle"))


def legend(g: DataFrame, lines: DataFrame, ring_images: DataFrame) -> DataFrame:
    """(image, cluster, points, lines, kind): wafer where there is a ring, chart where there are lines, else unknown."""
    pts = g.groupBy("image", "cluster").agg(F.count("*").alias("points"))
    n = lines.groupBy("image").agg(F.count("*").alias("lines"))
    out = pts.join(n, "image", "left").join(ring_images.select("image").distinct().withColumn("ring", F.lit(True)), "image", "left").fillna(0, ["lines"])
    return out.select("image", "cluster", "points", "lines", F.when(F.col("ring"), "wafer").when(F.col("lines") > 0, "chart").otherwise("unknown").alias("kind"))
