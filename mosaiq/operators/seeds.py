"""Seeds of segmentations: hex lattices, greedy minimum distance, coverage, density peaks, tracks over scales."""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.operators.distance import nearest_source
from mosaiq.operators.order import index_of, quantiles
from mosaiq.operators.regions import connected
from mosaiq.session import ship
from mosaiq.sources.stage import stage


def hex_lattice(spark: SparkSession, height: int, width: int, radius: float, u: float = 0.0, v: float = 0.0) -> DataFrame:
    """Points of a hexagonal lattice with one point an area of pi radius^2, moved by (u, v) steps: index, y, x inside the grid."""
    s = sqrt(2 * pi / sqrt(3)) * radius
    rise = s * sqrt(3) / 2
    rows, cols = int(height / rise) + 4, int(width / s) + 4
    i = spark.range(-3, rows).select(F.col("id").alias("i"))
    points = i.select("i", F.explode(F.sequence(F.lit(-3 - rows // 2), F.lit(cols + 3))).alias("j"))
    points = points.select("i", "j", ((F.col("i") + v) * rise).alias("y"), ((F.col("j") + 0.5 * F.col("i") + u + 0.5 * v) * s).alias("x"))
    inside = points.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return inside.select(((F.col("i") + 3) * (cols + rows + 10) + F.col("j") + 3 + rows).cast("long").alias("index"), F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c"))


def snap_to_minimum(points: DataFrame, surface: DataFrame, value: str, reach: float) -> DataFrame:
    """Each point moved to the cell of least value in the disc around it; ties to the first cell in row order."""
    k = int(reach)
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= reach * reach)))
    near = points.select("index", F.col("r").alias("_r"), F.col("c").alias("_c"), offsets.alias("o")).select("index", (F.col("_r") + F.col("o.a")).alias("r"), (F.col("_c") + F.col("o.b")).alias("c"))
    best = near.join(surface.select("r", "c", value), ["r", "c"]).groupBy("index").agg(F.min(F.struct(F.col(value).alias("v"), "r", "c")).alias("m"))
    return best.select("index", "m.r", "m.c")


def close_pairs(points: DataFrame, limit2: int, strict: bool = True) -> DataFrame:
    """Pairs (a before b by rank) nearer than sqrt(limit2), through square buckets of that side."""
    side = max(1, int(sqrt(limit2)) + 1)
    own = points.withColumns({"_y": F.floor(F.col("r") / side), "_x": F.floor(F.col("c") / side)})
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = own.select(F.col("rank").alias("a"), F.col("r").alias("ra"), F.col("c").alias("ca"), "_y", "_x", shift.alias("o")).select("a", "ra", "ca", (F.col("_y") + F.col("o.i")).alias("_y"), (F.col("_x") + F.col("o.j")).alias("_x"))
    d2 = (F.col("r") - F.col("ra")) * (F.col("r") - F.col("ra")) + (F.col("c") - F.col("ca")) * (F.col("c") - F.col("ca"))
    return sent.join(own.select(F.col("rank").alias("b"), "r", "c", "_y", "_x"), ["_y", "_x"]).where((F.col("a") < F.col("b")) & ((d2 < limit2) if strict else (d2 <= limit2))).select("a", "b")


def accept_in_order(points: DataFrame, limit2: int, strict: bool = True) -> DataFrame:
    """Points (rank, r, c) that a pass in order of rank accepts, each at least sqrt(limit2) from all accepted before it.

    rank may be of any type that has an order, a struct for instance, without equal values.

    The same set as the sequential pass, in rounds: a point without an open conflict before it is accepted, what
    conflicts with it goes. Each round is two joins; the number of rounds is the longest chain of conflicts.
    """
    points = open_ = stage(points, "open")  # made once: pairs read them twice
    conflicts = stage(close_pairs(points, limit2, strict), "conflicts")
    taken = None
    while open_.head(1):
        live = conflicts.join(open_.select(F.col("rank").alias("a")), "a", "left_semi").join(open_.select(F.col("rank").alias("b")), "b", "left_semi")
        won = stage(open_.join(live.select(F.col("b").alias("rank")).distinct(), "rank", "left_anti"), "won")
        lost = live.join(won.select(F.col("rank").alias("a")), "a", "left_semi").select(F.col("b").alias("rank"))
        open_ = stage(open_.join(won.select("rank").unionByName(lost).distinct(), "rank", "left_anti"), "open")
        taken = won if taken is None else taken.unionByName(won)
    return points.limit(0) if taken is None else taken


def nearest_seed(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """r, c, d2: the squared distance of each cell to its nearest seed, however far; null without a seed."""
    return nearest_source(cells, seeds).select("r", "c", "d2")


def complete_coverage(cells: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """seeds (rank, r, c) and more, so that every cell lies within `limit` of one.

    Cells farther than that from all seeds are taken farthest first, then in row order, by their distance to the seeds
    given; one that a cell taken before covers is passed over. New ranks follow the greatest one, in that order. Without
    a seed nothing is added, as no distance is known.
    """
    own = stage(seeds.select(F.col("rank").cast("long").alias("rank"), "r", "c"), "own-seeds")
    far = nearest_seed(cells, own).where(F.col("d2") > limit * limit)
    key = F.struct((-F.col("d2")).alias("d2"), "r", "c")
    more = accept_in_order(far.select(key.alias("rank"), "r", "c"), limit * limit, strict=False)
    last = own.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    placed = index_of(more.select(F.col("rank.d2").alias("_d2"), "r", "c"), ["_d2", "r", "c"])
    return own.unionByName(placed.select((F.col("index") + last + 1).cast("long").alias("rank"), "r", "c"))


def coverage_summary(covered: DataFrame, limit: float) -> DataFrame:
    """One row: cells, quantiles and maximum of the distance to the nearest seed, cells within the limit."""
    far = covered.select(F.sqrt("d2").alias("d"))
    one = far.agg(F.count(F.lit(1)).alias("cells"), F.max("d").alias("max"), F.count_if(F.col("d") <= limit).alias("within"))
    at = quantiles(far, [], "d", [0.5, 0.95, 0.99]).select(*(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p50", "p95", "p99"))))
    return one.join(at, how="left")  # one row each


def centroids(labels: DataFrame) -> DataFrame:
    """Centre of mass of each segment of each run."""
    return labels.where("label > 0").groupBy("run_id", "spatialr", "ranger", "phase", "label").agg(F.avg("r").alias("y"), F.avg("c").alias("x"))


def density_peaks(points: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """Peaks per scale of the smoothed number of points a cell: spatialr, r, c, density.

    Own definition: a separable triangular kernel of half width `radius` with integer weights, so sums are exact; a peak
    is the greatest cell of its (2 radius + 1)^2 box, the first in row order if equal.
    """
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("s")
    weight = F.lit(radius + 1) - F.abs("s")
    counts = points.groupBy("spatialr", F.floor(F.col("y") + 0.5).cast("int").alias("r"), F.floor(F.col("x") + 0.5).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("spatialr", "r", "c", "n", shift).groupBy("spatialr", "r", (F.col("c") + F.col("s")).alias("c")).agg(F.sum(F.col("n") * weight).alias("n"))
    smooth = rows.select("spatialr", "r", "c", "n", shift).groupBy("spatialr", (F.col("r") + F.col("s")).alias("r"), "c").agg(F.sum(F.col("n") * weight).alias("density"))
    smooth = stage(smooth.join(cells.select("r", "c"), ["r", "c"], "left_semi"), "smoothed")
    key = F.struct(F.col("density").alias("v"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))
    across = smooth.select("spatialr", "r", "c", key.alias("k"), shift).groupBy("spatialr", "r", (F.col("c") + F.col("s")).alias("c")).agg(F.max("k").alias("k"))
    best = across.select("spatialr", "r", "c", "k", shift).groupBy("spatialr", (F.col("r") + F.col("s")).alias("r"), "c").agg(F.max("k").alias("k"))
    return smooth.join(best, ["spatialr", "r", "c"]).where((-F.col("k.r") == F.col("r")) & (-F.col("k.c") == F.col("c"))).select("spatialr", "r", "c", "density")


#: Rows and columns of a tile of the smoothed grid.
PEAK_SIDE = 512


def smoothed(counts: np.ndarray, sigma: float) -> np.ndarray:
    """counts under a Gaussian cut off at four sigmas, rows first, then columns; zero outside; single precision a pass."""
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 / (sigma * sigma) * x**2)
    w /= w.sum()
    for axis in (0, 1):
        wide = np.pad(counts.astype(np.float64), [(reach, reach) if k == axis else (0, 0) for k in (0, 1)])
        n = counts.shape[axis]
        part = lambda k, wide=wide, n=n, axis=axis: wide.take(range(reach + k, reach + k + n), axis=axis)
        total = part(0) * w[reach]
        for k in range(reach, 0, -1):
            total = total + (part(-k) + part(k)) * w[reach - k]
        counts = total.astype(np.float32)
    return counts


def greatest_around(values: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value of each one's box of 2 reach + 1 rows and columns; zero outside."""
    for axis in (0, 1):
        wide = np.pad(values, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)])
        values = np.max([wide.take(range(k, k + values.shape[axis]), axis=axis) for k in range(2 * reach + 1)], axis=0)
    return values


def _local_peaks(height: int, width: int, radius: int, side: int):
    sigma = max(1.0, radius / 2)
    window = max(1, radius)
    halo = int(4 * sigma + 0.5) + window

    def run(table: pa.Table) -> pa.Table:
        group, tr, tc = (table.column(k)[0].as_py() for k in ("_g", "_tr", "_tc"))
        top, left = max(0, tr * side - halo), max(0, tc * side - halo)
        bottom, right = min(height, (tr + 1) * side + halo), min(width, (tc + 1) * side + halo)
        counts = np.zeros((bottom - top, right - left), np.float32)
        np.add.at(counts, (table.column("r").to_numpy() - top, table.column("c").to_numpy() - left), table.column("n").to_numpy().astype(np.float32))
        density = smoothed(counts, sigma)
        peak = (density == greatest_around(density, window)) & (density > 0)
        r, c = np.nonzero(peak)
        own = ((r + top) // side == tr) & ((c + left) // side == tc)
        r, c = r[own], c[own]
        return pa.table([pa.array([group] * len(r), pa.int64()), pa.array((r + top).astype(np.int64)), pa.array((c + left).astype(np.int64)), pa.array(density[r, c].astype(np.float64))], ["_g", "r", "c", "density"])

    return run


def gaussian_peaks(points: DataFrame, height: int, width: int, radius: int, group: str = "spatialr", run: str = "run_id") -> DataFrame:
    """Peaks per group of the density of points (group, run, y, x) on a grid of so many rows and columns: group, r, c, density.

    Points go to the nearest cell, halves to even, those outside to the edge; the points of one run in one cell count once.
    The counts are smoothed by a Gaussian of sigma radius / 2, one at least, cut off at four sigmas, in single precision. A
    peak is a cell that no cell of the box of radius around it exceeds; 4-connected peaks are one, at their first cell in
    row order. Tiles hold the points near them, so work follows the area that has points. group: whole numbers.
    """
    ship(points.sparkSession)
    at = lambda x, n: F.least(F.greatest(F.rint(x), F.lit(0)), F.lit(n - 1)).cast("long")
    cells = points.where("y is not null and x is not null").select(F.col(group).cast("long").alias("_g"), F.col(run).alias("_run"), at("y", height).alias("r"), at("x", width).alias("c")).distinct()
    counts = cells.groupBy("_g", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    halo = int(4 * max(1.0, radius / 2) + 0.5) + max(1, radius)
    near = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / PEAK_SIDE), F.floor((F.col(x) + halo) / PEAK_SIDE)))
    sent = counts.select("*", near("r").alias("_tr")).select("*", near("c").alias("_tc"))
    inside = (F.col("_tr") >= 0) & (F.col("_tc") >= 0) & (F.col("_tr") * PEAK_SIDE < height) & (F.col("_tc") * PEAK_SIDE < width)
    found = sent.where(inside).groupBy("_g", "_tr", "_tc").applyInArrow(_local_peaks(height, width, radius, PEAK_SIDE), "_g long, r long, c long, density double")
    found = stage(found, "peaks")
    # groups lie below each other, a free row between, so that one pass joins the plateaus of all
    order = F.dense_rank().over(Window.orderBy("_g"))
    shift = F.broadcast(found.select("_g").distinct().withColumn("_shift", (order - 1).cast("long") * (height + 1)))  # a row a group
    placed = found.join(shift, "_g").select("_g", "density", "_shift", (F.col("r") + F.col("_shift")).alias("r"), "c").withColumn("cell", F.col("r") * (1 << 31) + F.col("c"))
    joined = connected(stage(placed, "plateaus"), ["_g"])
    return joined.where("cell = region").select(F.col("_g").alias(group), (F.col("r") - F.col("_shift")).alias("r"), "c", "density")


def peak_support(peaks: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """peaks with the runs, phases and rangers that have a point within radius. Points and peaks meet in buckets."""
    side = int(radius) + 1
    bucket = lambda y, x: {"_y": F.floor(y / side), "_x": F.floor(x / side)}
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = peaks.withColumns(bucket(F.col("r"), F.col("c"))).select("spatialr", "r", "c", "density", "_y", "_x", shift.alias("o")).select("spatialr", "r", "c", "density", (F.col("_y") + F.col("o.i")).alias("_y"), (F.col("_x") + F.col("o.j")).alias("_x"))
    near = sent.join(points.withColumns(bucket(F.col("y"), F.col("x"))).select("spatialr", "y", "x", "run_id", "phase", "ranger", "_y", "_x"), ["spatialr", "_y", "_x"])
    d2 = (F.col("y") - F.col("r")) * (F.col("y") - F.col("r")) + (F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))
    return near.where(d2 <= radius * radius).groupBy("spatialr", "r", "c", "density").agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("phase").alias("phases"), F.count_distinct("ranger").alias("rangers"))


def scale_tracks(peaks: DataFrame, reach: float) -> DataFrame:
    """Peaks (node, step, r, c; steps number the scales from 0) with `track`: chains of mutual nearest peaks of next scales.

    A track is named by its smallest node; tracks of one scale are dropped. Links join neighbouring scales only, so
    labels spread along chains as long as the scales are many.
    """
    peaks = stage(peaks.select("node", "step", "r", "c"), "peaks")  # read for both sides of links, tracks and steps
    d2 = (F.col("a.r") - F.col("b.r")) * (F.col("a.r") - F.col("b.r")) + (F.col("a.c") - F.col("b.c")) * (F.col("a.c") - F.col("b.c"))
    side = int(reach) + 1
    cut = lambda d: d.withColumns({"_y": F.floor(F.col("r") / side), "_x": F.floor(F.col("c") / side)})
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = cut(peaks).select("node", "step", "r", "c", "_y", "_x", shift.alias("o")).select("node", "step", "r", "c", (F.col("_y") + F.col("o.i")).alias("_y"), (F.col("_x") + F.col("o.j")).alias("_x")).alias("a")
    b = cut(peaks).alias("b")
    near = a.join(b, (F.col("a.step") + 1 == F.col("b.step")) & (F.col("a._y") == F.col("b._y")) & (F.col("a._x") == F.col("b._x"))).where(d2 <= reach * reach).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), d2.alias("d2"))
    near = stage(near, "near-peaks")
    forth = near.groupBy("u").agg(F.min_by("v", F.struct("d2", "v")).alias("v"))
    back = near.groupBy("v").agg(F.min_by("u", F.struct("d2", "u")).alias("u"))
    links = stage(forth.join(back, ["u", "v"]), "links")
    tracks = stage(peaks.select("node", "step", "r", "c", F.col("node").alias("track")), "tracks")
    steps = peaks.select("step").distinct().count()
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    for _ in range(max(0, steps - 1)):
        least = both.join(tracks.select(F.col("node").alias("v"), "track"), "v").groupBy(F.col("u").alias("node")).agg(F.min("track").alias("_t"))
        tracks = stage(tracks.join(least, "node", "left").withColumn("track", F.least("track", F.coalesce("_t", "track"))).drop("_t"), "tracks")
    wide = tracks.groupBy("track").agg(F.count_distinct("step").alias("scales")).where("scales >= 2")
    return tracks.join(wide, "track")


def stable_seeds(tracks: DataFrame, runs: str, limit2: int) -> DataFrame:
    """Tracks' median places as seeds, best supported first, at least sqrt(limit2) apart: rank, r, c, scales, runs."""
    own = tracks.groupBy("track").agg(F.floor(F.median("r") + 0.5).cast("int").alias("r"), F.floor(F.median("c") + 0.5).cast("int").alias("c"), F.max("scales").alias("scales"), F.sum(runs).alias("runs"))
    keyed = own.withColumns({"_s": -F.col("scales"), "_n": -F.col("runs")})
    ranked = stage(index_of(keyed, ["_s", "_n", "r", "c", "track"], "rank").withColumn("rank", (F.col("rank") + 1).cast("long")).drop("_s", "_n"), "ranked")
    kept = accept_in_order(ranked.select("rank", "r", "c"), limit2)
    return ranked.join(kept.select("rank"), "rank", "left_semi").drop("track")
