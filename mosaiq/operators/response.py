"""How alike the runs of one scale are: distances of distributions, medoids, diagnostics, spatial dominance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.segments import CLASSES

#: Default limits of the response diagnostics; None turns one off.
LIMITS = {
    "min_central": 0.5,
    "max_lower": 0.35,
    "max_upper": 0.35,
    "max_edge": 0.5,
    "max_spread": 1.5,
    "max_skew": 1.5,
    "max_flutter": 1.0,
    "max_jump": 1.5,
    "max_pattern": 1.0,
    "min_agreement": 0.6,
}


def above(x: Column, limit: float | None) -> Column:
    """Whether x exceeds a limit; never without one."""
    return F.lit(False) if limit is None else x > limit


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def ordinal_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of the cumulated shares."""
    step = F.aggregate(
        F.zip_with(a, b, lambda x, y: x - y),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("total")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["total"] + F.abs(s["sum"] + x)).alias("total")),
        lambda s: s["total"],
    )
    return step


def run_pairs(runs: DataFrame, group: str = "spatialr") -> DataFrame:
    """Pairs of runs of one group, left before right, with ordinal, histogram, tail, radius quantile and combined distances.

    Runs are summaries and a group is an ensemble of a stated design, so pairs are few.
    """
    tails, quantiles = ("lower_tail", "central", "upper_tail"), ("q50", "q75", "q90", "q95")
    fields = ("classes", "histogram", *tails, *quantiles)
    a = runs.select(group, F.col("run_id").alias("left_run"), *(F.col(c).alias(f"a_{c}") for c in fields))
    b = runs.select(group, F.col("run_id").alias("right_run"), *(F.col(c).alias(f"b_{c}") for c in fields))
    pairs = a.join(b, group).where("left_run < right_run")
    apart = lambda names: reduce(lambda x, y: x + y, (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names))
    out = pairs.withColumns({"ordinal": ordinal_distance(F.col("a_classes"), F.col("b_classes")), "histogram": l1(F.col("a_histogram"), F.col("b_histogram")), "tail": apart(tails), "radius": apart(quantiles)})
    return out.select(group, "left_run", "right_run", "ordinal", "histogram", "tail", "radius", (F.col("ordinal") + F.col("histogram") + F.col("tail")).alias("combined"))


def both_ways(pairs: DataFrame, group: str, value: str) -> DataFrame:
    return pairs.select(group, F.explode(F.array(F.struct(F.col("left_run").alias("run_id"), F.col(value).alias("v")), F.struct(F.col("right_run").alias("run_id"), F.col(value).alias("v")))).alias("x")).select(group, "x.*")


def medoids(pairs: DataFrame, value: str, group: str = "spatialr", largest: bool = False) -> DataFrame:
    """The run of each group with the least (or largest) mean value to the others; ties go to the smaller run_id at 1e-9."""
    mean = both_ways(pairs, group, value).groupBy(group, "run_id").agg(F.avg("v").alias("mean"))
    key = F.floor(F.col("mean") * 1e9 + 0.5) * (-1 if largest else 1)
    place = F.row_number().over(Window.partitionBy(group).orderBy(key, "run_id"))
    return mean.withColumn("_place", place).where("_place = 1").drop("_place")


def group_diagnostics(runs: DataFrame, group: str = "spatialr", limits: dict[str, float | None] = LIMITS) -> DataFrame:
    """Centre, spread, skew, tail shares and flags of the runs of a group."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd")
    out = runs.groupBy(group).agg(
        F.count(F.lit(1)).alias("runs"),
        F.median("q50").alias("centre"),
        F.median(F.col("q90") - F.col("q10")).alias("spread"),
        F.avg(F.col("q90") + F.col("q10") - 2 * F.col("q50")).alias("skew"),
        *(F.avg(c).alias(f"{c}_mean") for c in ("lower_tail", "central", "upper_tail")),
        *(sd(c) for c in ("lower_tail", "central", "upper_tail")),
        F.collect_set("dominant_class").alias("_dominant"),
        F.median("scale_match").alias("scale_match_median"),
    )
    has = lambda k: F.array_contains("_dominant", k)
    low, mid, up = F.col("lower_tail_mean"), F.col("central_mean"), F.col("upper_tail_mean")
    return out.withColumns(
        {
            "dominant_classes": F.size("_dominant"),
            "centered": (F.col("centre") >= 0.5) & (F.col("centre") <= 2.0) & (mid >= (limits["min_central"] or 0.0)),
            "edge_loaded": above(low + up, limits["max_edge"]),
            "one_sided_lower": above(low, limits["max_lower"]) & (low > up * 1.5),
            "one_sided_upper": above(up, limits["max_upper"]) & (up > low * 1.5),
            "missing_central": F.lit(False) if limits["min_central"] is None else mid < limits["min_central"],
            "strongly_skewed": above(F.abs("skew"), limits["max_skew"]),
            "unstably_spread": above(F.col("spread"), limits["max_spread"]),
            "lower_dominated": (low > mid) & (low > up),
            "upper_dominated": (up > mid) & (up > low),
            "multimodal": (F.size("_dominant") >= 3) | (has("small") & has("large")),
        }
    ).drop("_dominant")


def analysis_matrix(labels: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """Per run and block of cell x cell pixels: area share of each size class (array), the dominant class and the tail."""
    known = labels.where("label > 0").select("run_id", "spatialr", "r", "c", "label").join(segments.select("run_id", "label", "size_class"), ["run_id", "label"])
    out = known.groupBy("run_id", "spatialr", F.floor(F.col("r") / cell).alias("cell_row"), F.floor(F.col("c") / cell).alias("cell_col")).agg(F.array(*(F.avg((F.col("size_class") == k).cast("double")) for k in CLASSES)).alias("shares"), F.count(F.lit(1)).alias("pixels"))
    at = lambda k: F.get("shares", F.lit(k))
    low, mid, up = at(0) + at(1), at(2), at(3) + at(4)
    return out.withColumns({"dominant_class": F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("shares", F.array_max("shares")).cast("int")), "tail": F.when((mid >= low) & (mid >= up), "central").when(low >= up, "lower").otherwise("upper")})


def spatial_dominance(matrix: DataFrame) -> DataFrame:
    """Per run: cells, the share of cells that each class or tail dominates, and the area share of those not central."""
    share = lambda c, k: F.avg((F.col(c) == k).cast("double"))
    problem = F.sum(F.when(F.col("tail") != "central", F.col("pixels")).otherwise(0)) / F.sum("pixels")
    return matrix.groupBy("run_id", "spatialr").agg(F.count(F.lit(1)).alias("cells"), problem.alias("problem_area"), *(share("dominant_class", k).alias(k) for k in CLASSES), *(share("tail", k).alias(f"{k}_cells") for k in ("lower", "central", "upper")))


TAIL_CELLS = ("lower_cells", "central_cells", "upper_cells")


def dominance_pairs(dominance: DataFrame, group: str = "spatialr") -> DataFrame:
    """Pairs of runs of one group, left before right, with the L1 distance of what dominates their cells."""
    one = dominance.select(group, "run_id", F.array(*CLASSES, *TAIL_CELLS).alias("v"))
    both = one.alias("a").join(one.alias("b"), F.col(f"a.{group}") == F.col(f"b.{group}")).where("a.run_id < b.run_id")
    return both.select(F.col(f"a.{group}").alias(group), F.col("a.run_id").alias("left_run"), F.col("b.run_id").alias("right_run"), l1(F.col("a.v"), F.col("b.v")).alias("spatial"))


def spatial_stability(dominance: DataFrame, group: str = "spatialr", limits: dict[str, float | None] = LIMITS) -> DataFrame:
    """Per group: mean and greatest distance of the runs' dominance, agreements, ranges, persistence and the jump flag.

    An agreement is the greatest mean share of a size class (or tail) over the runs; a group of one run has no distance.
    """
    far = dominance_pairs(dominance, group).groupBy(group).agg(F.avg("spatial").alias("distance_mean"), F.max("spatial").alias("distance_max"))
    span = lambda c: (F.max(c) - F.min(c))
    out = dominance.groupBy(group).agg(
        F.greatest(*(F.avg(k) for k in CLASSES)).alias("agreement"),
        F.greatest(*(F.avg(k) for k in TAIL_CELLS)).alias("tail_agreement"),
        *(span(c).alias(f"{n}_range") for n, c in (("lower", "lower_cells"), ("central", "central_cells"), ("upper", "upper_cells"), ("problem", "problem_area"))),
        F.avg("lower_cells").alias("lower_persistence"),
        F.avg("upper_cells").alias("upper_persistence"),
    )
    out = out.join(far, group, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("distance_mean", "distance_max")})
    low = F.lit(False) if limits["min_agreement"] is None else F.col("agreement") < limits["min_agreement"]
    return out.withColumn("spatial_jump", above(F.col("distance_max"), limits["max_pattern"]) | low)


def robust_lower_support(values: Column) -> Column:
    """median - 1.4826 MAD of an array, within 0 and 1; null if it is empty."""
    from mosaiq.functions.exprs import array_median, clip

    m = array_median(values)
    return F.when(F.size(values) > 0, clip(m - 1.4826 * array_median(F.transform(values, lambda x: F.abs(x - m))), 0.0, 1.0))
