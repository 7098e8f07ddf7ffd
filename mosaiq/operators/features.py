"""Features of cells: validity, colour indices, quantile scaling, directional inertia, first principal component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.exprs import clip
from mosaiq.operators.order import quantiles


def valid_mask(pixels: DataFrame, invalid: tuple[tuple[float, ...], ...], bands: tuple[str, ...] = ("b1", "b2", "b3"), nodata: float | None = None, alpha: str | None = None, least_alpha: float = 1.0) -> DataFrame:
    """pixels with `valid`: no band is nodata, alpha is high enough and no invalid colour matches in all bands."""
    rules = []
    if nodata is not None:
        rules += [F.col(b) != nodata for b in bands]
    if alpha is not None:
        rules.append(F.col(alpha) >= least_alpha)
    rules += [reduce(lambda a, b: a | b, (F.col(b) != v for b, v in zip(bands, colour, strict=True))) for colour in invalid]
    if not rules:
        raise ValueError("a valid mask needs at least one rule")
    return pixels.withColumn("valid", F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False)))


def colour_indices(pixels: DataFrame, bands: tuple[str, ...] = ("b1", "b2", "b3")) -> DataFrame:
    """pixels with exg = 2G - R - B, exr = 1.4R - B, exgr = exg - exr and bri = (R + G + B) / 3."""
    r, g, b = (F.col(x) for x in bands)
    exg, exr = 2 * g - r - b, 1.4 * r - b
    return pixels.withColumns({"exg": exg, "exr": exr, "exgr": exg - exr, "bri": (r + g + b) / 3})


def quantile_parameters(cells: DataFrame, bands: tuple[str, ...], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row a band: low and high quantile, centre and half width."""
    stacked = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands)))
    ends = quantiles(cells.select(stacked.alias("x")).select("x.*"), ["band"], "value", [low, high])
    out = ends.select("band", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 2).otherwise(F.raise_error(F.concat(F.lit("no spread in band "), F.col("band"))))
    return out.select("band", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("centre"), width.cast("double").alias("scale"))


def quantile_scaled(cells: DataFrame, bands: tuple[str, ...], low: float = 0.02, high: float = 0.98, valid: str | None = None, background: float = 0.0) -> DataFrame:
    """cells with each band scaled to -1..1 by its quantiles.

    With a column `valid`, quantiles are those of the valid cells, and the others (null counts as not valid) get the background.
    """
    one = quantile_parameters(cells if valid is None else cells.where(F.col(valid)), bands, low, high).groupBy().pivot("band", list(bands)).agg(F.first("centre").alias("centre"), F.first("scale").alias("scale"))
    joined = cells.join(F.broadcast(one))  # one row
    scaled = joined.withColumns({b: clip((F.col(b) - F.col(f"{b}_centre")) / F.col(f"{b}_scale"), -1.0, 1.0) for b in bands}).drop(*one.columns)
    return scaled if valid is None else masked(scaled, bands, valid, background)


def directional_inertia(cells: DataFrame, band: str, radius: int, levels: int = 32, low: float = 0.0, high: float = 50.0) -> DataFrame:
    """Per cell and direction the mean squared difference of levels over the pairs within the window; and the greatest.

    The inertia of a co-occurrence matrix is a mean over pairs, so no matrix is built: pairs meet in a shifted join,
    and the window sums are separable, rows first, then columns.
    """
    level = F.floor(clip((F.col(band) - low) / (high - low), 0.0, 0.999999) * levels)
    own = cells.select("r", "c", level.cast("int").alias("q"))
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("direction"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(((0, 1), (1, 0), (1, 1), (1, -1))))))
    sent = own.select("r", "c", "q", steps.alias("o")).select("o.direction", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("q").alias("p"))
    pairs = sent.join(own, ["r", "c"]).select("direction", "r", "c", ((F.col("q") - F.col("p")) * (F.col("q") - F.col("p"))).alias("d"))
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("s")
    rows = pairs.select("direction", "r", "c", "d", shift).groupBy("direction", "r", (F.col("c") + F.col("s")).alias("c")).agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"))
    both = rows.select("direction", "r", "c", "d", "n", shift).groupBy("direction", (F.col("r") + F.col("s")).alias("r"), "c").agg((F.sum("d") / F.sum("n")).alias("inertia"))
    return own.select("r", "c").join(both, ["r", "c"]).groupBy("r", "c").agg(F.max("inertia").alias("inertia"))


def local_variance(cells: DataFrame, bands: tuple[str, ...], radius: int) -> DataFrame:
    """Sum over bands of the variance of the cells in the (2 radius + 1)^2 box around each cell, from separable sums."""
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("s")
    parts = {f"{b}_1": F.col(b) for b in bands} | {f"{b}_2": F.col(b) * F.col(b) for b in bands}
    own = cells.select("r", "c", F.lit(1).alias("n"), *(v.alias(k) for k, v in parts.items()))
    names = ["n", *parts]
    rows = own.select("r", "c", *names, shift).groupBy("r", (F.col("c") + F.col("s")).alias("c")).agg(*(F.sum(x).alias(x) for x in names))
    box = rows.select("r", "c", *names, shift).groupBy((F.col("r") + F.col("s")).alias("r"), "c").agg(*(F.sum(x).alias(x) for x in names))
    variance = reduce(lambda a, b: a + b, (F.col(f"{b}_2") / F.col("n") - F.pow(F.col(f"{b}_1") / F.col("n"), 2) for b in bands))
    return cells.select("r", "c").join(box, ["r", "c"]).select("r", "c", F.greatest(F.lit(0.0), variance).alias("variance"))


def first_component(cells: DataFrame, bands: tuple[str, ...] = ("m1", "m2", "m3"), rounds: int = 200) -> DataFrame:
    """cells with pc1, the first principal component without normalisation; the largest loading is positive.

    The covariance is one aggregate; its first vector comes from power iteration on that small matrix.
    """
    import numpy as np

    k = len(bands)
    row = cells.agg(*(F.avg(b).alias(f"m_{b}") for b in bands), *(F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(bands) for j, b in enumerate(bands))).first()  # one row
    if row[0] is None:
        return cells.withColumn("pc1", F.lit(None).cast("double"))
    cov = np.array([[row[f"c_{i}_{j}"] for j in range(k)] for i in range(k)])
    v = np.ones(k) / np.sqrt(k) + np.arange(k) * 1e-3
    for _ in range(rounds):
        w = cov @ v
        if not np.linalg.norm(w):
            break
        v = w / np.linalg.norm(w)
    v = v * np.sign(v[np.abs(v).argmax()])
    return cells.withColumn("pc1", reduce(lambda a, b: a + b, ((F.col(b) - row[f"m_{b}"]) * float(x) for b, x in zip(bands, v, strict=True))))


def clip_rescale(cells: DataFrame, column: str, top: float = 255.0, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The column clipped to its quantiles and stretched to 0..top."""
    ends = quantiles(cells, [], column, [low, high]).withColumnRenamed("q", "_q")
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return cells.join(F.broadcast(ends)).withColumn(column, (F.least(F.greatest(F.col(column), lo), hi) - lo) * top / (hi - lo)).drop("_q")


def feature_bands(cells: DataFrame, small: str, large: str, bands: tuple[str, ...] = ("m1", "m2", "m3"), eps: float = 1e-6) -> DataFrame:
    """cells with the six feature bands f1..f6: exgr, exr, bri, small and large structure, and their ratio small / (large + eps)."""
    out = colour_indices(cells, bands)
    six = ("exgr", "exr", "bri", small, large)
    return out.withColumns({f"f{k + 1}": F.col(c).cast("double") for k, c in enumerate(six)} | {"f6": F.col(small) / (F.col(large) + eps)})


def masked(cells: DataFrame, bands: tuple[str, ...], valid: str = "valid", background: float = 0.0) -> DataFrame:
    """cells with the bands set to the background where they aren't valid; a null flag counts as not valid."""
    return cells.withColumns({b: F.when(F.coalesce(F.col(valid), F.lit(False)), F.col(b)).otherwise(F.lit(background)) for b in bands})


def stack_with_mask(stack: DataFrame, mask: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """r, c, the bands and valid of a stack (r, c, bands) and a mask (r, c, valid) over the same places.

    Reading it fails if one of them has a place that the other hasn't, as grids of different sizes would.
    """
    missing = [b for b in bands if b not in stack.columns]
    if missing:
        raise ValueError(f"the stack has no bands {', '.join(missing)}")
    own = stack.select("r", "c", *bands, F.lit(True).alias("_s"))
    both = own.join(mask.select("r", "c", F.col("valid").alias("_v"), F.lit(True).alias("_m")), ["r", "c"], "full")
    agree = F.when(F.col("_s").isNotNull() & F.col("_m").isNotNull(), F.coalesce(F.col("_v").cast("boolean"), F.lit(False)))
    error = F.raise_error(F.format_string("stack and mask differ at row %d, column %d", "r", "c")).cast("boolean")
    return both.select("r", "c", *bands, F.coalesce(agree, error).alias("valid"))


def standard_parameters(cells: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """One row a band: mean and population standard deviation."""
    stacked = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands)))
    return cells.select(stacked.alias("x")).select("x.*").groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def standardised(cells: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """cells with each band less its mean, over its standard deviation; 0 for a band without spread."""
    one = standard_parameters(cells, bands).groupBy().pivot("band", list(bands)).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    joined = cells.join(F.broadcast(one))  # one row
    return joined.withColumns({b: F.when(F.col(f"{b}_sd") > 0, (F.col(b) - F.col(f"{b}_mean")) / F.col(f"{b}_sd")).otherwise(0.0) for b in bands}).drop(*one.columns)


def intensity_normalised(pixels: DataFrame, image: str, bands: tuple[str, ...], top: float = 255.0) -> DataFrame:
    """Own rule: each band of each image stretched from its least to its greatest value to 0..top; 0 without spread."""
    ends = pixels.groupBy(image).agg(*(F.min(b).alias(f"_lo_{b}") for b in bands), *(F.max(b).alias(f"_hi_{b}") for b in bands))
    out = pixels.join(ends, image)
    stretch = lambda b: F.when(F.col(f"_hi_{b}") > F.col(f"_lo_{b}"), (F.col(b) - F.col(f"_lo_{b}")) * top / (F.col(f"_hi_{b}") - F.col(f"_lo_{b}"))).otherwise(F.lit(0.0))
    return out.withColumns({b: stretch(b) for b in bands}).drop(*(f"_{e}_{b}" for e in ("lo", "hi") for b in bands))


def resample_nearest(pixels: DataFrame, bands: tuple[str, ...], xmin: float, ymin: float, xres: float, yres: float, source_res: float, width: int, height: int) -> DataFrame:
    """Pixels of a source grid (origin 0, source_res) on another grid: the one whose cell holds each target centre."""
    spark = pixels.sparkSession
    target = spark.range(width * height).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    at = target.withColumns({"_r": F.floor((ymin + (F.col("r") + 0.5) * yres) / source_res).cast("int"), "_c": F.floor((xmin + (F.col("c") + 0.5) * xres) / source_res).cast("int")})
    return at.join(pixels.select(F.col("r").alias("_r"), F.col("c").alias("_c"), *bands), ["_r", "_c"], "left").select("r", "c", *(F.coalesce(b, F.lit(0.0)).alias(b) for b in bands))


def block_of(cells: DataFrame, size: int) -> DataFrame:
    """cells with the block (window) of size x size that holds each."""
    return cells.withColumns({"block_row": F.floor(F.col("r") / size).cast("int"), "block_col": F.floor(F.col("c") / size).cast("int")})


def local_maximum(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Cells whose value is the greatest in the box around them; of equal neighbours the first in row order."""
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("s")
    key = F.struct(F.col(value).alias("v"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))
    rows = cells.select("r", "c", key.alias("k"), shift).groupBy("r", (F.col("c") + F.col("s")).alias("c")).agg(F.max("k").alias("k"))
    best = rows.select("r", "c", "k", shift).groupBy((F.col("r") + F.col("s")).alias("r"), "c").agg(F.max("k").alias("k"))
    return cells.join(best, ["r", "c"]).where((-F.col("k.r") == F.col("r")) & (-F.col("k.c") == F.col("c"))).drop("k")
