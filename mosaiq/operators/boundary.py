"""Boundaries of segmentations: extraction, distance-clipped agreement, Jaccard, ensemble support, scale gate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.distance import nearest_source
from mosaiq.operators.response import medoids, robust_lower_support
from mosaiq.session import ship
from mosaiq.sources.stage import stage

#: Rows of a band of labels.
BAND = 64
#: The largest reach that tiles look around themselves, their side at most, and cells of all runs that one holds, roughly.
REACH, SIDE, CELLS = 64, 256, 1 << 23


def boundary_pixels(labels: DataFrame) -> DataFrame:
    """Pixels whose right or lower neighbour has another label; both must be valid. One ordered pass a row, one a column.

    Labels are shuffled once, by run and band of rows; a band's first row is also sent to the band above.
    """
    band = F.floor(F.col("r") / BAND)
    valid = labels.where("label > 0").select("run_id", "spatialr", "ranger", "phase", "r", "c", "label")
    sent = valid.withColumn("_band", F.explode(F.when(F.pmod("r", F.lit(BAND)) == 0, F.array(band, band - 1)).otherwise(F.array(band)))).repartition("run_id", "_band")
    beside = lambda line, step: F.lead(F.struct(step, "label")).over(Window.partitionBy("run_id", "_band", line).orderBy(step))
    seen = sent.withColumns({"_right": beside("r", "c"), "_below": beside("c", "r")})
    right = (F.col("_right.c") == F.col("c") + 1) & (F.col("_right.label") != F.col("label"))
    below = (F.col("_below.r") == F.col("r") + 1) & (F.col("_below.label") != F.col("label"))
    return seen.where((F.col("_band") == band) & (right | below)).select("run_id", "spatialr", "ranger", "phase", "r", "c")


def boundary_support(labels: DataFrame, edges: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per scale and valid pixel: the share of runs with a boundary there; -1 at those of `cells` (r, c) that aren't valid."""
    runs = labels.groupBy("spatialr").agg(F.count_distinct("run_id").alias("runs"))
    seen = edges.groupBy("spatialr", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    valid = labels.where("label > 0").select("spatialr", "r", "c").distinct()
    out = valid.join(seen, ["spatialr", "r", "c"], "left").join(F.broadcast(runs), "spatialr").select("spatialr", "r", "c", (F.coalesce("n", F.lit(0)) / F.col("runs")).alias("support"))  # one row a scale
    if cells is None:
        return out
    every = cells.select("r", "c").distinct().join(F.broadcast(runs.select("spatialr")))
    return every.join(out, ["spatialr", "r", "c"], "left").select("spatialr", "r", "c", F.coalesce("support", F.lit(-1.0)).alias("support"))


def nearest_boundary(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, r, c, d2: the squared distance of cells (run_id, r, c) to the run's nearest boundary pixel, however far."""
    return nearest_source(cells, edges, ["run_id"]).select("run_id", "r", "c", "d2")


def pair_class(left: str = "a", right: str = "b") -> Column:
    """What differs between two runs: the seed phase, the ranger, the radius or several."""
    same = lambda c: F.col(f"{left}.{c}") == F.col(f"{right}.{c}")
    return (
        F.when(same("spatialr") & same("ranger") & ~same("phase"), "seed_realization")
        .when(same("spatialr") & same("phase") & ~same("ranger"), "ranger")
        .when(same("ranger") & same("phase") & ~same("spatialr"), "radius")
        .otherwise("factorial_cross")
    )


def _scores_far(own: DataFrame, edges: DataFrame, both: DataFrame) -> DataFrame:
    """Scores of any reach: each run is asked once for its distance at the pixels that are a boundary in a run it is paired with.

    A pixel then gathers the runs that have a boundary there and the distances asked for, a row a run of the design at most,
    so pairs are scored where they lie and only their sums are shuffled.
    """
    partners = both.groupBy("own").agg(F.collect_set("other").alias("others"))  # runs of a design
    asked = own.join(partners, "own").groupBy("r", "c").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"), F.collect_set("own").alias("owns"))
    asked = stage(asked, "asked")
    near = nearest_boundary(asked.select(F.explode("others").alias("run_id"), "r", "c"), edges).where("d2 is not null")
    far = near.groupBy("r", "c").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "d2"))).alias("far"))
    pixels = asked.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "owns").join(far, ["r", "c"])
    met = pixels.select(F.explode("owns").alias("own"), "far").join(both, "own").withColumn("d2", F.element_at("far", F.col("other"))).where("d2 is not null")
    # integers sum to the same value in any order
    score = F.floor(F.greatest(F.lit(0.0), 1 - F.sqrt("d2") / F.col("reach")) * 1e9 + 0.5).cast("long")
    return met.groupBy("left_run", "right_run", "reach").agg(F.sum(score).alias("score"))


def clipped_squares(mask: np.ndarray, halo: int) -> np.ndarray:
    """Squared distances of the cells of mask, without a rim of halo, to its nearest true cell; above halo ** 2 they only say so."""
    n, w = mask.shape
    at = np.arange(w, dtype=np.int32)
    left = at - np.maximum.accumulate(np.where(mask, at, -w - halo), axis=1)
    right = np.minimum.accumulate(np.where(mask, at, 2 * w + halo)[:, ::-1], axis=1)[:, ::-1] - at
    flat = np.minimum(np.minimum(left, right), halo + 1)[:, halo : w - halo].astype(np.int32) ** 2
    out = flat[halo : n - halo].copy()
    for k in range(1, halo + 1):
        np.minimum(out, np.minimum(flat[halo - k : n - halo - k], flat[halo + k : n - halo + k]) + k * k, out=out)
    return out


def _in_tile(side: int, halo: int):
    def run(edges: pa.Table, pairs: pa.Table) -> pa.Table:
        score = np.zeros(pairs.num_rows, np.int64)
        if edges.num_rows and pairs.num_rows:
            top, left = (pairs.column(x)[0].as_py() * side - halo for x in ("_tr", "_tc"))
            r, c = (np.asarray(edges.column(x).to_numpy(), np.int64) - low for x, low in (("_r", top), ("_c", left)))
            coded = pa.chunked_array(edges.column("_run").chunks).combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy()
            number = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
            by = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[by], np.arange(len(number) + 1))
            masks, squares, tables = {}, {}, {}

            def mask(k):
                if k not in masks:
                    one = by[ends[k] : ends[k + 1]]
                    masks[k] = np.zeros((side + 2 * halo, side + 2 * halo), bool)
                    masks[k][r[one], c[one]] = True
                return masks[k]

            for i, (own, other, reach) in enumerate(zip(*(pairs.column(x).to_pylist() for x in ("own", "other", "reach")), strict=True)):
                if own not in number or other not in number:
                    continue
                a, b = number[own], number[other]
                if b not in squares:
                    squares[b] = clipped_squares(mask(b), halo)
                if reach not in tables:
                    far = np.arange(2 * (halo + 1) ** 2 + 1)
                    with np.errstate(divide="raise", invalid="raise"):
                        tables[reach] = np.floor(np.maximum(0.0, 1 - np.sqrt(far) / reach) * 1e9 + 0.5).astype(np.int64)
                inside = mask(a)[halo : halo + side, halo : halo + side]
                score[i] = tables[reach][squares[b][inside]].sum()  # integers sum to the same value in any order
        return pa.table([*(pairs.column(x) for x in ("left_run", "right_run", "reach")), pa.array(score)], ["left_run", "right_run", "reach", "score"])

    return run


def _scores_near(own: DataFrame, both: DataFrame, halo: int, runs: int) -> DataFrame:
    """Scores of a reach of at most halo: tiles hold all runs' boundaries and those as far as halo around them, as beyond it nothing scores."""
    side = max(4 * halo, min(SIDE, int((CELLS / runs) ** 0.5)))
    tile = lambda c, by=0: F.floor((F.col(c).cast("long") + by) / side)
    own = own.where("r is not null and c is not null")
    tiles = own.select(tile("r").alias("_tr"), tile("c").alias("_tc")).distinct()
    around = own.select(F.col("own").alias("_run"), F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"), F.explode(F.sequence(tile("r", -halo), tile("r", halo))).alias("_tr"))
    sent = around.select("*", F.explode(F.sequence(F.floor((F.col("_c") - halo) / side), F.floor((F.col("_c") + halo) / side))).alias("_tc"))
    asked = both.join(F.broadcast(tiles))  # a row a tile of the grid
    types = {f.name: f.dataType.simpleString() for f in both.schema}
    ship(own.sparkSession)
    schema = f"left_run {types['left_run']}, right_run {types['right_run']}, reach {types['reach']}, score long"
    scored = sent.groupBy("_tr", "_tc").cogroup(asked.groupBy("_tr", "_tc")).applyInArrow(_in_tile(side, halo), schema)
    return scored.groupBy("left_run", "right_run", "reach").agg(F.sum("score").alias("score"))


def pair_support(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (left_run, right_run, reach) with `support`: boundary pixels of each side score max(0, 1 - distance / reach)
    against the other side, summed both ways over all boundary pixels of both; 1 without any.

    edges and pairs are read several times, so they should be tables. Up to a reach of REACH tiles score what lies in
    them, and boundaries are shuffled once; a larger one asks for exact distances, however far.
    """
    both = pairs.select("left_run", "right_run", "reach", F.explode(F.array(F.struct(F.col("left_run").alias("own"), F.col("right_run").alias("other")), F.struct(F.col("right_run").alias("own"), F.col("left_run").alias("other")))).alias("x")).select("left_run", "right_run", "reach", "x.*")
    paired = both.select("own").distinct()
    own = edges.select(F.col("run_id").alias("own"), "r", "c").join(F.broadcast(paired), "own", "left_semi")  # runs of a design
    sized = own.groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    total = both.join(sized, "own", "left").groupBy("left_run", "right_run", "reach").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pixels"))
    reach, runs = pairs.agg(F.max("reach")).first()[0] or 0, paired.count()
    known = both.where("reach is not null")
    summed = _scores_far(own, edges, known) if reach > REACH else _scores_near(own, known, max(1, math.ceil(reach)), max(1, runs))
    out = total.join(summed, ["left_run", "right_run", "reach"], "left")
    return out.select("left_run", "right_run", "reach", "pixels", F.when(F.col("pixels") > 0, F.coalesce("score", F.lit(0)) / 1e9 / F.col("pixels")).otherwise(F.lit(1.0)).alias("support"))


def run_pairs(labels: DataFrame) -> DataFrame:
    """All pairs of runs of one scale with their class and reach (the scale)."""
    runs = labels.select("run_id", "spatialr", "ranger", "phase").distinct()
    joined = runs.alias("a").join(runs.alias("b"), F.col("a.spatialr") == F.col("b.spatialr")).where("a.run_id < b.run_id")
    return joined.select(F.col("a.spatialr").alias("spatialr"), F.col("a.run_id").alias("left_run"), F.col("b.run_id").alias("right_run"), pair_class().alias("pair_class"), F.col("a.spatialr").cast("double").alias("reach"))


def boundary_jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared over all boundary pixels of each pair; 1 if neither has any."""
    sized = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    cells = edges.select("run_id", "spatialr", "r", "c")
    shared = cells.alias("a").join(cells.alias("b"), ["spatialr", "r", "c"]).where("a.run_id < b.run_id").groupBy(F.col("a.run_id").alias("left_run"), F.col("b.run_id").alias("right_run")).agg(F.count(F.lit(1)).alias("both"))
    out = pairs.join(shared, ["left_run", "right_run"], "left")
    for side in ("left", "right"):
        out = out.join(sized.select(F.col("run_id").alias(f"{side}_run"), F.col("n").alias(f"{side}_n")), f"{side}_run", "left")
    union = F.coalesce("left_n", F.lit(0)) + F.coalesce("right_n", F.lit(0)) - F.coalesce("both", F.lit(0))
    return out.select("left_run", "right_run", F.coalesce("both", F.lit(0)).alias("shared"), union.alias("united"), F.when(union > 0, F.coalesce("both", F.lit(0)) / union).otherwise(F.lit(1.0)).alias("jaccard"))


def scored_pairs(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """All pairs of runs of one scale with their support, as a table; edges is one that was written."""
    pairs = stage(run_pairs(labels), "pairs")
    return stage(pairs.join(pair_support(edges, pairs.select("left_run", "right_run", "reach")), ["left_run", "right_run", "reach"]), "scored")


def ensemble_rank(labels: DataFrame, edges: DataFrame, runs: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Scales by ensemble support: the geometric mean of four robust supports, from most to least supported.

    Seed realisations and rangers of one scale, the boundary medoid against that of the next scales, and scale match.
    A missing component gives 0 and evaluable false. edges is a table that was written; scored are its scored_pairs, if known.
    """
    # read by the robust supports, the medoids and the ladder
    scored = scored_pairs(labels, edges) if scored is None else scored
    robust = scored.groupBy("spatialr").agg(*(robust_lower_support(F.collect_list(F.when(F.col("pair_class") == k, F.col("support")))).alias(k) for k in ("seed_realization", "ranger")))
    mid = medoids(scored, "support", largest=True).select("spatialr", "run_id")
    ladder = mid.withColumn("next_run", F.lead("run_id").over(Window.orderBy("spatialr"))).withColumn("next", F.lead("spatialr").over(Window.orderBy("spatialr"))).where("next is not null")  # one row a scale
    steps = stage(ladder, "ladder").select(F.col("run_id").alias("left_run"), F.col("next_run").alias("right_run"), F.sqrt(F.col("spatialr") * F.col("next")).alias("reach"), "spatialr", "next")
    near = steps.join(pair_support(edges, steps.select("left_run", "right_run", "reach")), ["left_run", "right_run", "reach"])
    radius = near.select(F.explode(F.array("spatialr", "next")).alias("spatialr"), "support").groupBy("spatialr").agg(robust_lower_support(F.collect_list("support")).alias("radius"))
    match = runs.groupBy("spatialr").agg(robust_lower_support(F.collect_list("scale_match")).alias("scale_match"))
    parts = ("seed_realization", "ranger", "radius", "scale_match")
    out = robust.join(mid.withColumnRenamed("run_id", "medoid_run"), "spatialr").join(radius, "spatialr", "left").join(match, "spatialr", "left")
    whole = F.col(parts[0]).isNotNull() & F.col(parts[1]).isNotNull() & F.col(parts[2]).isNotNull() & F.col(parts[3]).isNotNull()
    product = F.col(parts[0]) * F.col(parts[1]) * F.col(parts[2]) * F.col(parts[3])
    out = out.withColumns({"evaluable": whole, "score": F.when(whole, F.pow(product, F.lit(0.25))).otherwise(F.lit(0.0))})
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).desc(), "spatialr")))


def scale_gate(ranked: DataFrame) -> DataFrame:
    """Whether the two best scales are neighbours on the scale ladder, what lies between, and whether the best is at an end."""
    ladder = ranked.withColumn("step", F.dense_rank().over(Window.orderBy("spatialr")))  # one row a scale
    ends = ladder.agg(F.max("step").alias("top"))
    pair = ladder.where("rank <= 2").agg(F.max(F.when(F.col("rank") == 1, F.col("spatialr"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("spatialr"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("step"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("step"))).alias("b"))
    side = F.when(F.col("a") == F.col("top"), "upper").when(F.col("a") == 1, "lower").otherwise("inside")
    return pair.join(ends).select("first", "second", F.least("first", "second").alias("lower"), F.greatest("first", "second").alias("upper"), (F.abs(F.col("a") - F.col("b")) == 1).alias("adjacent"), F.greatest(F.abs(F.col("a") - F.col("b")) - 1, F.lit(0)).alias("between"), side.alias("boundary_side"))


def gain_share(scores: DataFrame, best: str = "s1", second: str = "s2", midpoint: str = "sm") -> DataFrame:
    """(sm - s2) / (s1 - s2), and the handoff: the midpoint if that is above one half, else the best."""
    gain = F.col(best) - F.col(second)
    share = F.when(gain > 0, (F.col(midpoint) - F.col(second)) / gain)
    return scores.withColumns({"gain_share": share, "handoff": F.when(share > 0.5, "midpoint").otherwise("first"), "warning": share.isNull()})


def midpoint_px(low: Column, high: Column) -> Column:
    """The scale halfway between two, halves up; null unless it lies strictly inside."""
    m = F.floor((low + high) / 2 + 0.5).cast("int")
    return F.when((m > low) & (m < high), m)
