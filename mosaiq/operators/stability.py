"""Per-pixel reproducibility of repeated products, variant summaries and rankings.

One groupBy gathers the replicates of a pixel (a handful), array functions do the rest: no second shuffle, no join
back of medians.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.exprs import array_median
from mosaiq.operators.order import quantiles
from mosaiq.sources.stage import stage

BANDS = ("b1", "b2", "b3")


def valid_pixels(obs: DataFrame, nodata: float = 0.0, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Observations with every band present and not all bands equal to nodata."""
    present = reduce(lambda a, b: a & b, (F.col(b).isNotNull() & ~F.isnan(b) for b in bands))
    blank = reduce(lambda a, b: a & b, (F.col(b) == nodata for b in bands))
    return obs.where(present & ~blank)


def pixel_stability(obs: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Per (variant_id, r, c): valid_count, the median of each band, mad (mean over bands) and rmse to the median."""
    gathered = valid_pixels(obs, bands=bands).groupBy("variant_id", "r", "c").agg(F.count(F.lit(1)).alias("valid_count"), *(F.collect_list(b).alias(f"_{b}") for b in bands))
    medians = gathered.withColumns({f"med_{b}": array_median(F.col(f"_{b}")) for b in bands})
    off = lambda b: F.transform(f"_{b}", lambda x: F.abs(x - F.col(f"med_{b}")))
    mad = reduce(lambda a, b: a + b, (array_median(off(b)) for b in bands)) / len(bands)
    square = reduce(lambda a, b: a + b, (F.aggregate(off(b), F.lit(0.0), lambda s, x: s + x * x) for b in bands))
    return medians.select("variant_id", "r", "c", "valid_count", *(f"med_{b}" for b in bands), mad.alias("mad"), F.sqrt(square / (F.col("valid_count") * len(bands))).alias("rmse"))


def masks(pixels: DataFrame, replicates: int, threshold: float) -> DataFrame:
    """pixels with stable, unstable (on fully supported pixels; 255 elsewhere) and quality (1 stable, 2 unstable, 0 none)."""
    full = F.col("valid_count") == replicates
    ok = F.col("rmse") <= threshold
    return pixels.withColumns({"stable": F.when(full, ok.cast("int")).otherwise(255), "unstable": F.when(full, (~ok).cast("int")).otherwise(255), "quality": F.when(full & ok, 1).when(full, 2).otherwise(0)})


def variant_summary(pixels: DataFrame, grid_cells: int, replicates: int, threshold: float) -> DataFrame:
    """One row a variant; fractions over the whole grid, exact p95 by linear interpolation."""
    full = F.col("valid_count") == replicates
    stable = full & (F.col("rmse") <= threshold)
    pixels = stage(pixels.select("variant_id", "valid_count", "mad", "rmse"), "pixels")
    p95 = {c: quantiles(pixels, ["variant_id"], c, [0.95]).select("variant_id", F.get("q", F.lit(0)).alias(f"p95_{c}")) for c in ("mad", "rmse")}
    return (
        pixels.groupBy("variant_id")
        .agg(
            F.count(F.lit(1)).alias("any_support"),
            F.count_if(full).alias("full_support"),
            F.sum("valid_count").alias("observations"),
            F.min("valid_count").alias("least_seen"),
            F.max("valid_count").alias("max_valid_count"),
            F.avg("mad").alias("mean_mad"),
            F.avg("rmse").alias("mean_rmse"),
            F.count_if(stable).alias("stable_pixels"),
            F.count_if(full & ~stable).alias("unstable_pixels"),
        )
        .join(p95["mad"], "variant_id")
        .join(p95["rmse"], "variant_id")
        .withColumns(
            {
                "min_valid_count": F.when(F.col("any_support") < grid_cells, F.lit(0)).otherwise(F.col("least_seen")).cast("long"),
                "mean_valid_count": F.col("observations") / grid_cells,
                "any_support_fraction": F.col("any_support") / grid_cells,
                "full_support_fraction": F.col("full_support") / grid_cells,
                "variable_support_fraction": (F.col("any_support") - F.col("full_support")) / grid_cells,
                "persistence": F.col("full_support") / F.col("any_support"),
                "dropout": (F.col("any_support") - F.col("full_support")) / F.col("any_support"),
                "stable_fraction": F.when(F.col("full_support") > 0, F.col("stable_pixels") / F.col("full_support")),
                "unstable_fraction": F.when(F.col("full_support") > 0, F.col("unstable_pixels") / F.col("full_support")),
            }
        )
        .drop("least_seen")
    )


def support_histogram(pixels: DataFrame, grid_cells: int, replicates: int) -> DataFrame:
    """Pixels of each variant by valid_count, from 0 to the number of replicates."""
    counts = pixels.groupBy("variant_id").agg(*(F.count_if(F.col("valid_count") == k).alias(str(k)) for k in range(1, replicates + 1)), F.count(F.lit(1)).alias("seen"))
    rows = F.array(F.struct(F.lit(0).alias("valid_count"), (F.lit(grid_cells) - F.col("seen")).alias("pixels")), *(F.struct(F.lit(k).alias("valid_count"), F.col(str(k)).alias("pixels")) for k in range(1, replicates + 1)))
    return counts.select("variant_id", F.explode(rows).alias("x")).select("variant_id", "x.*")


#: The three rankings: column, whether small values come first.
RANKINGS = {
    "continuous": (("p95_rmse", True), ("mean_rmse", True), ("p95_mad", True), ("mean_mad", True)),
    "mask": (("stable_fraction", False), ("unstable_fraction", True)),
    "support": (("dropout", True), ("variable_support_fraction", True), ("persistence", False)),
}


def ten_thousandths(x: Column) -> Column:
    """A key at 4 decimals, halves up, as an integer."""
    return F.floor(x * 1e4 + 0.5).cast("long")


def rank_variants(summary: DataFrame, kind: str) -> DataFrame:
    """summary with `rank` from 1 by one of RANKINGS at 4 decimals; missing keys come last, ties go by variant_id."""
    order = [(ten_thousandths(F.col(c)).asc_nulls_last() if up else ten_thousandths(F.col(c)).desc_nulls_last()) for c, up in RANKINGS[kind]]
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(*order, "variant_id")))  # one row a variant


def threshold_review(pixels: DataFrame, replicates: int, thresholds: list[float]) -> DataFrame:
    """Per threshold and variant: stable and unstable pixels among fully supported ones, and their fractions.

    One aggregate counts for all thresholds at once; pixels are not multiplied.
    """
    full = F.col("valid_count") == replicates
    counted = pixels.groupBy("variant_id").agg(F.count_if(full).alias("n"), *(F.count_if(full & (F.col("rmse") <= t)).alias(f"s{k}") for k, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"s{k}").alias("stable_pixels")) for k, t in enumerate(thresholds)))
    out = counted.select("variant_id", "n", F.explode(rows).alias("x")).select("x.threshold", "variant_id", "x.stable_pixels", (F.col("n") - F.col("x.stable_pixels")).alias("unstable_pixels"), "n")
    return out.withColumns({"stable_fraction": F.when(F.col("n") > 0, F.col("stable_pixels") / F.col("n")), "unstable_fraction": F.when(F.col("n") > 0, F.col("unstable_pixels") / F.col("n"))}).drop("n")


def threshold_winners(review: DataFrame) -> DataFrame:
    """The variant with the most stable pixels at each threshold; then the fewest unstable ones, then variant_id."""
    order = Window.partitionBy("threshold").orderBy(F.col("stable_fraction").desc_nulls_last(), F.col("unstable_fraction").asc_nulls_last(), "variant_id")
    return review.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def medoid_replicate(obs: DataFrame, pixels: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Replicates by distance to their variant's median image: common_pixels, distance, rank (1: the medoid)."""
    both = valid_pixels(obs, bands=bands).join(pixels.select("variant_id", "r", "c", *(f"med_{b}" for b in bands)), ["variant_id", "r", "c"])
    square = reduce(lambda a, b: a + b, (F.pow(F.col(b) - F.col(f"med_{b}"), 2) for b in bands))
    found = both.groupBy("variant_id", "replicate").agg(F.count(F.lit(1)).alias("common_pixels"), F.sqrt(F.sum(square) / (F.count(F.lit(1)) * len(bands))).alias("distance"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("variant_id").orderBy(F.col("distance").asc_nulls_last(), "replicate")))


def selected_product(summary: DataFrame) -> DataFrame:
    """The first variant of the continuous ranking, and whether the other rankings agree."""
    first = {k: rank_variants(summary, k).where("rank = 1").select(F.col("variant_id").alias(f"{k}_first")) for k in RANKINGS}
    out = first["continuous"].join(first["mask"]).join(first["support"])  # one row each
    return out.select(F.col("continuous_first").alias("variant_id"), (F.col("mask_first") == F.col("continuous_first")).alias("mask_agrees"), (F.col("support_first") == F.col("continuous_first")).alias("support_agrees"))


def product_context(summary: DataFrame, medoids: DataFrame) -> DataFrame:
    """selected_product with the firsts of the other rankings, the variant's medoid replicate and its distance, and warnings.

    medoids: variant_id, replicate, distance, rank. Warnings: support_differs, mask_differs, no_medoid.
    """
    first = {k: rank_variants(summary, k).where("rank = 1").select(F.col("variant_id").alias(n)) for k, n in (("continuous", "variant_id"), ("support", "support_variant"), ("mask", "mask_variant"))}
    one = first["continuous"].join(first["support"]).join(first["mask"])  # one row each
    nearest = medoids.where("rank = 1 and distance is not null").select("variant_id", F.col("replicate").alias("medoid"), F.col("distance").alias("medoid_distance"))
    out = one.join(nearest, "variant_id", "left")
    differs = lambda c, name: F.when(F.col(c) != F.col("variant_id"), F.lit(name))
    warnings = F.array(differs("support_variant", "support_differs"), differs("mask_variant", "mask_differs"), F.when(F.col("medoid").isNull(), F.lit("no_medoid")))
    return out.withColumn("warnings", F.array_join(F.filter(warnings, lambda x: x.isNotNull()), ";"))


def grid_modes(obs: DataFrame, reference: str) -> DataFrame:
    """Extents of the variants' rasters combined: union, intersection (empty: no row) and one reference variant."""
    per = obs.groupBy("variant_id").agg(F.min("c").alias("xmin"), (F.max("c") + 1).alias("xmax"), F.min("r").alias("ymin"), (F.max("r") + 1).alias("ymax"))
    low, high = ("xmin", "ymin"), ("xmax", "ymax")
    union = per.agg(*(F.min(x).alias(x) for x in low), *(F.max(x).alias(x) for x in high)).withColumn("mode", F.lit("union"))
    common = per.agg(*(F.max(x).alias(x) for x in low), *(F.min(x).alias(x) for x in high)).withColumn("mode", F.lit("intersection")).where("xmax > xmin and ymax > ymin")
    own = per.where(F.col("variant_id") == reference).drop("variant_id").withColumn("mode", F.lit("reference"))
    out = union.unionByName(common).unionByName(own).where("xmin is not null")
    return out.select("mode", "xmin", "xmax", "ymin", "ymax", (F.col("xmax") - F.col("xmin")).alias("xsize"), (F.col("ymax") - F.col("ymin")).alias("ysize"))
