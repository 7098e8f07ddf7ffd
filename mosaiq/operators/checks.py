"""Checks and small tables around the main operators: resolution groups, rank checks, cutoffs, perturbations, point cuts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.distance import nearest_source
from mosaiq.operators.order import nth_values
from mosaiq.sources.stage import stage


def resolution_groups(headers: DataFrame, relative: float = 1e-6, absolute: float = 1e-7, ends: bool = False) -> DataFrame:
    """Rasters (xres, yres) grouped by resolutions that agree within a tolerance: group, rasters, xres, yres.

    Distinct resolutions are few; sorted, a gap larger than the tolerance starts a new group.
    """
    distinct = headers.groupBy("xres", "yres").agg(F.count(F.lit(1)).alias("rasters"))
    order = Window.orderBy("xres", "yres")
    wide = lambda c: F.abs(F.col(c) - F.lag(c).over(order)) > F.greatest(F.lit(absolute), relative * F.greatest(F.abs(c), F.abs(F.lag(c).over(order))))
    marked = distinct.withColumn("_new", F.coalesce((wide("xres") | wide("yres")).cast("int"), F.lit(1)))
    numbered = marked.withColumn("group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bounds = [f(c).alias(f"{c}_{n}") for c in ("xres", "yres") for n, f in (("low", F.min), ("high", F.max))] if ends else []
    return numbered.groupBy("group").agg(F.sum("rasters").alias("rasters"), F.min("xres").alias("xres"), F.min("yres").alias("yres"), *bounds)


def resolution_report(headers: DataFrame, relative: float = 1e-6, absolute: float = 1e-7) -> DataFrame:
    """Per group of resolutions: rasters, variants, pairs of variant and replicate, projections, rotated rasters.

    headers: variant_id, replicate, xres, yres, proj, rotated. Groups as in resolution_groups, whose ends bound them.
    """
    ends = resolution_groups(headers.select("xres", "yres"), relative, absolute, True).drop("xres", "yres")
    inside = (F.col("xres") >= F.col("xres_low")) & (F.col("xres") <= F.col("xres_high")) & (F.col("yres") >= F.col("yres_low")) & (F.col("yres") <= F.col("yres_high"))
    met = headers.join(F.broadcast(ends), inside)  # a row a group of resolutions
    return met.drop("rasters").groupBy("group").agg(F.count(F.lit(1)).alias("rasters"), F.count_distinct("variant_id").alias("variants"), F.count_distinct("variant_id", "replicate").alias("pairs"), F.count_distinct("proj").alias("projections"), F.count_if("rotated").alias("rotated"))


def one_resolution(headers: DataFrame) -> DataFrame:
    """The mean resolution of all rasters, one row; reading it fails if there is none or they disagree."""
    one = resolution_groups(headers.select("xres", "yres")).agg(F.count(F.lit(1)).alias("_groups"))
    mean = headers.agg(((F.avg(F.abs("xres")) + F.avg(F.abs("yres"))) / 2).alias("resolution"))
    good = F.when(F.col("_groups") == 1, F.col("resolution"))
    return mean.join(one).select(F.coalesce(good, F.raise_error(F.lit("rasters have no or several resolutions")).cast("double")).alias("resolution"))


def rank_check(ranked: DataFrame, score: str, stored: str, key: str) -> DataFrame:
    """One row: candidates, stored ranks that differ from the ranks of the scores, and scores outside 0..1."""
    true = F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), key))  # candidates are few
    out = ranked.withColumn("_true", true)
    return out.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("_true") != F.col(stored)).alias("mismatches"), F.count_if((F.col(score) < -1e-9) | (F.col(score) > 1 + 1e-9)).alias("outside"))


def jump_cutoff(sizes: DataFrame, value: str, keys: tuple[str, ...] = (), smooth: int = 101, least: int = 1) -> DataFrame:
    """Per keys the size at which the logarithms of the sorted sizes bend most, the first of equal bends; `least` for fewer than ten.

    Equal sizes count one by one. They are counted first: of a size that occurs several times only the first, the last and
    one between can matter. `smooth`, the width of a running median of the logarithms, changes nothing whatever it is: in
    sorted values the median of a window is its middle one.
    """
    counts = sizes.where(F.col(value) > 0).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_v")
    log = F.log("_v")
    own = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_l": log, "_before": F.lag(log).over(order), "_after": F.lead(log).over(order)})
    bend = lambda x: F.floor(x * 1e9 + 0.5)
    one = F.when(F.col("_n") == 1, F.struct(bend(F.col("_after") - 2 * F.col("_l") + F.col("_before")).alias("b"), (-F.col("_start")).alias("i")))
    first = F.when(F.col("_n") > 1, F.struct(bend(F.col("_l") - 2 * F.col("_l") + F.col("_before")).alias("b"), (-F.col("_start")).alias("i")))
    between = F.when(F.col("_n") > 2, F.struct(bend(F.col("_l") - 2 * F.col("_l") + F.col("_l")).alias("b"), (-F.col("_start") - 1).alias("i")))
    last = F.when(F.col("_n") > 1, F.struct(bend(F.col("_after") - 2 * F.col("_l") + F.col("_l")).alias("b"), (-F.col("_start") - F.col("_n") + 1).alias("i")))
    bends = own.select(*keys, "_v", "_n", F.array_max(F.filter(F.array(one, first, between, last), lambda x: x["b"].isNotNull())).alias("_b"))
    found = bends.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max_by("_v", "_b").alias("_at"))
    cut = F.when(F.col("n") >= 10, F.greatest(F.lit(least), F.rint("_at").cast("int"))).otherwise(F.lit(least))
    return found.select(*keys, cut.alias("cutoff"), "n")


def knee_cutoff(sizes: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per keys the value where the second difference of the sorted logarithms is greatest; the first if tied."""
    distinct = sizes.where(F.col(value) > 0).select(*keys, value).distinct()
    order = Window.partitionBy(*keys).orderBy(value)
    log = F.log(value)
    second = F.lead(log).over(order) - 2 * log + F.lag(log).over(order)
    bent = distinct.withColumn("bend", second).where("bend is not null")
    return bent.groupBy(*keys).agg(F.min_by(F.struct(value, "bend"), F.struct(-F.floor(F.col("bend") * 1e9 + 0.5), F.col(value))).alias("x")).select(*keys, f"x.{value}", "x.bend")


def perturbation_grid(base: DataFrame, ranger_step: float, minsize_step: int, spatialr_step: int, floor: int = 1, most: int | None = None) -> DataFrame:
    """The 3 x 3 x 3 grid around each base row (candidate_id, spatialr, ranger, minsize), with the base marked.

    With `most` the base and the rows of the smallest hashes stay (a sampling operator).
    """
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    # base rows are moved once, 27 times fewer than theirs; the groups and whatever asks for whole candidates stay in place
    out = base.repartition("candidate_id").select("*", steps.alias("o")).select(
        "candidate_id",
        (F.col("spatialr") + F.col("o.a") * spatialr_step).alias("spatialr"),
        (F.col("ranger") + F.col("o.b") * ranger_step).alias("ranger"),
        F.greatest(F.lit(floor), F.col("minsize") + F.col("o.c") * minsize_step).alias("minsize"),
        ((F.col("o.a") == 0) & (F.col("o.b") == 0) & (F.col("o.c") == 0)).alias("is_baseline"),
    )
    out = out.where("spatialr > 0 and ranger > 0").groupBy("candidate_id", "spatialr", "ranger", "minsize").agg(F.max("is_baseline").alias("is_baseline"))
    if most is None:
        return out
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy((~F.col("is_baseline")).cast("int"), F.xxhash64("spatialr", "ranger", "minsize"), "spatialr", "ranger", "minsize"))
    return out.withColumn("_i", place).where(F.col("_i") <= most).drop("_i")


def one_baseline(perturbations: DataFrame, key: str = "candidate_id") -> DataFrame:
    """perturbations; reading it fails for a group without exactly one baseline row."""
    counted = perturbations.withColumn("_n", F.count_if("is_baseline").over(Window.partitionBy(key)))
    fails = F.raise_error(F.concat(F.lit("not one baseline: "), F.col(key).cast("string"))).cast("boolean")
    return counted.where(F.when(F.col("_n") == 1, True).otherwise(fails)).drop("_n")


def percentile_cut(points: DataFrame, value: str, percent: float, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per keys the value at place floor(n (1 - percent / 100)) of the sorted values (not interpolated), at least `least`."""
    groups = stage(points.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "groups")
    asked = groups.select(*keys, "n", F.least(F.floor(F.col("n") * (1 - percent / 100)), F.col("n") - 1).alias("at"))
    found = nth_values(points.select(*keys, value), list(keys), value, asked.select(*keys, "at"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = asked.alias("a").join(found.alias("b"), reduce(and_, [F.col("a.at") == F.col("b.at"), *same]))
    return met.select(*(F.col(f"a.{k}") for k in keys), F.greatest(F.lit(least), F.col("b.value")).alias("threshold"), "a.n")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows only one of the tables has."""
    return left.exceptAll(right).agg(F.count(F.lit(1)).alias("left_only")).join(right.exceptAll(left).agg(F.count(F.lit(1)).alias("right_only")))


def bilinear(points: DataFrame, surface: DataFrame, value: str) -> DataFrame:
    """The surface (r, c, value) at points (point_id, y, x): four neighbours weighted by their nearness; null at a gap."""
    y0, x0 = F.floor("y"), F.floor("x")
    corners = F.explode(F.array(*(F.struct((y0 + a).cast("int").alias("r"), (x0 + b).cast("int").alias("c"), ((1 - a) + (2 * a - 1) * (F.col("y") - y0)).alias("wy"), ((1 - b) + (2 * b - 1) * (F.col("x") - x0)).alias("wx")) for a in (0, 1) for b in (0, 1))))
    sent = points.select("point_id", corners.alias("k")).select("point_id", "k.r", "k.c", (F.col("k.wy") * F.col("k.wx")).alias("w")).where("w > 0")
    met = sent.join(surface.select("r", "c", value), ["r", "c"], "left").groupBy("point_id").agg(F.count_if(F.col(value).isNull()).alias("_gaps"), F.sum(F.col("w") * F.col(value)).alias("_v"))
    return met.select("point_id", F.when(F.col("_gaps") == 0, F.col("_v")).alias(value))


def snap_to_valid(points: DataFrame, valid: DataFrame) -> DataFrame:
    """points (rank, r, c) moved to the nearest valid cell, however far; ties by row, then column.

    Without a valid cell none is left.
    """
    near = nearest_source(points, valid).where("d2 is not null").select("r", "c", "near_r", "near_c")
    kind = lambda c: points.schema[c].dataType
    return points.select("rank", "r", "c").join(near, ["r", "c"]).select("rank", F.col("near_r").cast(kind("r")).alias("r"), F.col("near_c").cast(kind("c")).alias("c"))
