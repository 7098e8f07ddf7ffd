"""Segment populations of segmentation runs: sizes, radii, scale match, size classes, weighted quantiles, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.exprs import equivalent_radius

#: Size classes by q, and the left-closed bins of the q histogram.
CLASSES = ("micro", "small", "in_scale", "large", "oversize")
BINS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
RUN = ("run_id", "spatialr", "ranger", "phase")
#: Percentiles of the cells of a segment.
ZONAL = (5, 10, 25, 50, 75, 90, 95)


def size_class(q: Column) -> Column:
    return F.when(q < 0.25, "micro").when(q < 0.5, "small").when(q <= 2, "in_scale").when(q <= 4, "large").otherwise("oversize")


def segment_sizes(labels: DataFrame, pixel_area: float = 1.0) -> DataFrame:
    """One row a segment: pixels, area, equivalent radius, q (radius over the run's scale), size class. Label 0 is no segment."""
    counted = labels.where("label > 0").groupBy(*RUN, "label").agg(F.count(F.lit(1)).alias("pixels"))
    area = F.col("pixels") * pixel_area
    out = counted.withColumns({"area": area, "radius": equivalent_radius(area)}).withColumn("q", F.col("radius") / F.col("spatialr"))
    return out.withColumn("size_class", size_class(F.col("q")))


def class_shares(segments: DataFrame) -> DataFrame:
    """Per run and size class (all of them): segments, area and area share."""
    own = segments.groupBy("run_id").pivot("size_class", list(CLASSES)).agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    value = lambda k, what: F.coalesce(F.col(f"{k}_{what}"), F.lit(0))
    total = reduce(lambda a, b: a + b, (value(k, "area") for k in CLASSES))
    rows = F.array(*(F.struct(F.lit(k).alias("size_class"), value(k, "n").cast("long").alias("segments"), value(k, "area").cast("double").alias("area"), (value(k, "area") / total).alias("share")) for k in CLASSES))
    return own.select("run_id", F.explode(rows).alias("x")).select("run_id", "x.*")


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, at: tuple[float, ...]) -> DataFrame:
    """Step quantiles: the first value whose share of the weight up to it reaches each probability.

    Equal values are summed first, so the ordered window sees distinct values only.
    """
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = summed.withColumn("_cdf", F.sum("_w").over(up_to) / F.sum("_w").over(Window.partitionBy(*keys)))
    name = lambda p: f"{value}{round(p * 100):02d}"
    return cdf.groupBy(*keys).agg(*(F.coalesce(F.min(F.when(F.col("_cdf") >= p, F.col(value))), F.max(value)).alias(name(p)) for p in at))


def scale_match(segments: DataFrame) -> DataFrame:
    """Area-weighted mean of min(q, 1 / q) of each run; 0 without segments of a finite positive q."""
    good = (F.col("q") > 0) & (F.col("area") > 0)
    top = F.sum(F.when(good, F.col("area") * F.least(F.col("q"), 1 / F.col("q"))))
    return segments.groupBy("run_id", "spatialr").agg(F.coalesce(top / F.sum(F.when(good, F.col("area"))), F.lit(0.0)).alias("scale_match"))


def q_histogram(segments: DataFrame) -> DataFrame:
    """Area share of each run in the bins of q: columns h0..h6."""
    total = F.sum("area")
    cell = lambda k: (F.col("q") >= BINS[k]) & ((F.col("q") < BINS[k + 1]) if k + 1 < len(BINS) else F.lit(True))
    return segments.groupBy("run_id", "spatialr").agg(*((F.sum(F.when(cell(k), F.col("area")).otherwise(0)) / total).alias(f"h{k}") for k in range(len(BINS))))


def run_summary(segments: DataFrame) -> DataFrame:
    """One row a run: counts, class shares (array in class order), histogram (array), tails, q quantiles, scale match."""
    total = F.sum("area")
    share = lambda cond: F.sum(F.when(cond, F.col("area")).otherwise(0)) / total
    cell = lambda k: (F.col("q") >= BINS[k]) & ((F.col("q") < BINS[k + 1]) if k + 1 < len(BINS) else F.lit(True))
    good = F.col("q") > 0
    one = segments.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("segments"),
        total.alias("area"),
        F.array(*(share(F.col("size_class") == k) for k in CLASSES)).alias("classes"),
        F.array(*(share(cell(k)) for k in range(len(BINS)))).alias("histogram"),
        F.coalesce(F.sum(F.when(good, F.col("area") * F.least(F.col("q"), 1 / F.col("q")))) / F.sum(F.when(good, F.col("area"))), F.lit(0.0)).alias("scale_match"),
    )
    quantiles = weighted_quantiles(segments, ["run_id"], "q", "area", (0.1, 0.5, 0.75, 0.9, 0.95))
    c = lambda k: F.get("classes", F.lit(k))
    out = one.join(quantiles, "run_id").withColumns({"lower_tail": c(0) + c(1), "central": c(2), "upper_tail": c(3) + c(4)})
    return out.withColumn("dominant_class", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("classes", F.array_max("classes")).cast("int")))


#: Quantiles of areas and radii, and of q by area, in percent.
PERCENTS = (10, 25, 50, 75, 90, 95)


def population_summary(segments: DataFrame, run_radius: str = "spatialr") -> DataFrame:
    """One row a run with all that describes its segments.

    segments, per_hectare, area, max_label; mean and quantiles of area and of radius; mean and quantiles of q by area, and
    q_run_p50, its median by area relative to the run's own radius (a column, null or 0 for none); the histogram h0 to h6 of q;
    for each size class its area and share of it, its segments and the 50 % and 90 % quantile of its radii (0 without any);
    lower_tail, central, upper_tail and edge_loaded shares; scale_match; dominant_class and regime. One aggregate over
    segments and one over distinct values of q.
    """
    total = F.sum("area")
    of = lambda k, x: F.when(F.col("size_class") == k, x)
    at = lambda x, p: F.percentile(x, F.lit(p / 100))
    cell = lambda k: (F.col("q") >= BINS[k]) & ((F.col("q") < BINS[k + 1]) if k + 1 < len(BINS) else F.lit(True))
    one = segments.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("segments"),
        total.alias("area"),
        F.max("label").alias("max_label"),
        F.max(run_radius).alias("_run_radius"),
        *((F.sum(F.when(cell(k), F.col("area")).otherwise(0)) / total).alias(f"h{k}") for k in range(len(BINS))),
        *(F.coalesce(F.sum(of(k, F.col("area"))), F.lit(0.0)).alias(f"{k}_area") for k in CLASSES),
        F.avg("area").alias("area_mean"),
        F.avg("radius").alias("radius_mean"),
        (F.sum(F.col("q") * F.col("area")) / total).alias("q_mean"),
        *(at(c, p).alias(f"{c}_p{p}") for c in ("area", "radius") for p in PERCENTS),
        *(F.coalesce(F.sum(of(k, F.col("area"))) / total, F.lit(0.0)).alias(f"{k}_share") for k in CLASSES),
        *(F.count(of(k, F.col("area"))).alias(f"{k}_segments") for k in CLASSES),
        *(F.coalesce(at(of(k, F.col("radius")), p), F.lit(0.0)).alias(f"{k}_radius_p{p}") for k in CLASSES for p in (50, 90)),
        F.coalesce(F.sum(F.when(F.col("q") > 0, F.col("area") * F.least(F.col("q"), 1 / F.col("q")))) / F.sum(F.when(F.col("q") > 0, F.col("area"))), F.lit(0.0)).alias("scale_match"),
    )
    out = one.join(weighted_quantiles(segments, ["run_id"], "q", "area", tuple(p / 100 for p in PERCENTS)), "run_id")
    middle = weighted_quantiles(segments, ["run_id"], "radius", "area", (0.5,)).withColumnRenamed("radius50", "_r50")
    out = out.join(middle, "run_id").withColumn("q_run_p50", F.when(F.col("_run_radius") > 0, F.col("_r50") / F.col("_run_radius"))).drop("_r50", "_run_radius")
    share = lambda k: F.col(f"{k}_share")
    out = out.withColumns({"per_hectare": F.col("segments") / (F.col("area") / 10_000), "lower_tail": share("micro") + share("small"), "central": share("in_scale"), "upper_tail": share("large") + share("oversize")})
    shares = F.array(*(share(k) for k in CLASSES))
    dominant = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(shares, F.array_max(shares)).cast("int"))
    return out.withColumns({"edge_loaded": F.col("lower_tail") + F.col("upper_tail"), "dominant_class": dominant, "regime": regime(F.col("lower_tail"), F.col("central"), F.col("upper_tail"))})


def regime(lower: Column, central: Column, upper: Column) -> Column:
    """The tail with the greatest share, the first one of equal shares."""
    return F.when((lower >= central) & (lower >= upper), "lower_tail").when(central >= upper, "central").otherwise("upper_tail")


def class_table(segments: DataFrame) -> DataFrame:
    """Per run and size class that occurs: share of the segments and of the area; with the run's unweighted quantiles of q."""
    total = Window.partitionBy("run_id")
    counted = segments.groupBy("run_id", "size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    q = segments.groupBy("run_id").agg(*(F.percentile("q", F.lit(p / 100)).alias(f"q_p{p}") for p in (10, 25, 50, 75, 90)))
    shares = counted.select("run_id", "size_class", (F.col("n") / F.sum("n").over(total)).alias("segment_share"), (F.col("area") / F.sum("area").over(total)).alias("area_share"))
    return shares.join(q, "run_id")


def post_mask(labels: DataFrame, valid: DataFrame) -> DataFrame:
    """labels with 0 where the place (r, c) isn't among the valid ones."""
    seen = valid.select("r", "c").distinct().withColumn("_valid", F.lit(True))
    return labels.join(seen, ["r", "c"], "left").withColumn("label", F.when(F.col("_valid"), F.col("label")).otherwise(0)).drop("_valid").select(*labels.columns)


def exported_labels(labels: DataFrame, valid: DataFrame) -> DataFrame:
    """Labels counted from 0 (negative: none) as they are written: moved by one, 0 where there is none or the place isn't valid."""
    return post_mask(labels.withColumn("label", F.when(F.col("label") >= 0, F.col("label") + 1).otherwise(0)), valid)


def segment_attributes(labels: DataFrame, pixel: float = 1.0) -> DataFrame:
    """Per run and segment: pixels, area, box (top, left, bottom, right, in pixels) and centre; what a polygon layer lists."""
    own = labels.where("label > 0").groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.min("r").alias("top"), F.min("c").alias("left"), (F.max("r") + 1).alias("bottom"), (F.max("c") + 1).alias("right"), F.avg("r").alias("y"), F.avg("c").alias("x"))
    return own.withColumn("area", F.col("pixels") * pixel * pixel)


def mask_small(labels: DataFrame, least: int) -> DataFrame:
    """labels without the segments of fewer pixels than that."""
    small = labels.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least)
    return labels.join(small, ["run_id", "label"], "left_anti")


def label_size_stats(segments: DataFrame) -> DataFrame:
    """Per run: segments, interpolated quantiles of their pixels, and the shares below 2, 5, 10 and 20 pixels."""
    below = lambda n: F.avg((F.col("pixels") < n).cast("double")).alias(f"below_{n}")
    return segments.groupBy("run_id").agg(F.count(F.lit(1)).alias("segments"), F.percentile("pixels", F.lit(0.25)).alias("p25"), F.percentile("pixels", F.lit(0.5)).alias("p50"), F.percentile("pixels", F.lit(0.75)).alias("p75"), *(below(n) for n in (2, 5, 10, 20)))


def zonal_stats(labels: DataFrame, features: DataFrame, bands: tuple[str, ...] = ("m1", "m2", "m3")) -> DataFrame:
    """Per run, segment and band: count, mean, median, min, max, population stdev and variance, quantiles of the cells in it."""
    named = {"n": F.count, "mean": F.avg, "min": F.min, "max": F.max, "variance": F.var_pop, "stdev": F.stddev_pop, "q": lambda b: F.percentile(b, F.array(*(F.lit(p / 100) for p in ZONAL)))}
    values = labels.where("label > 0").select("run_id", "label", "r", "c").join(features.select("r", "c", *bands), ["r", "c"]).select("run_id", "label", *bands)
    # a segment's cells meet before they are counted, as counts of a few cells each are larger than the cells; one count a band for all quantiles
    values = values.repartition("run_id", "label")
    own = values.groupBy("run_id", "label").agg(*(F.struct(*(f(b).alias(n) for n, f in named.items())).alias(b) for b in bands))
    each = own.select("run_id", "label", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("x")) for b in bands))).alias("y")).select("run_id", "label", "y.band", "y.x.*")
    at = {p: F.get("q", F.lit(i)) for i, p in enumerate(ZONAL)}
    return each.select("run_id", "label", "band", "n", "mean", at[50].alias("median"), "min", "max", "variance", "stdev", *(at[p].alias(f"q{p:02d}") for p in ZONAL))
