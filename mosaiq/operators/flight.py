"""Flight lines of image positions: sorties, dominant axis, lines, centred image windows, grid blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.exprs import angular_difference, array_median, axis_difference, longitude_wrap, metres_per_degree
from mosaiq.operators.order import index_of, quantiles, ranged
from mosaiq.sources.stage import stage

MICRO = 1_000_000


def sorties(images: DataFrame, gap_seconds: int, name: str = "sortie", bucket_seconds: int = 3_600) -> DataFrame:
    """images with a session number from 1 (a long): a gap of more than gap_seconds starts a new one; order (t_us, image_id).

    Two levels instead of one global window: rows are windowed inside coarse time buckets, bucket ends are chained in
    a table with one row a bucket, and numbers are added up from there. Rows without a time are left out.
    """
    width = bucket_seconds * MICRO
    images = images.where("t_us is not null")
    own = images.withColumn("_bucket", F.floor(F.col("t_us") / width))
    inside = Window.partitionBy("_bucket").orderBy("t_us", "image_id")
    marked = own.withColumn("_gap", F.col("t_us") - F.lag("t_us").over(inside))
    ends = own.groupBy("_bucket").agg(F.min("t_us").alias("_from"), F.max("t_us").alias("_to"))
    chain = Window.orderBy("_bucket")  # one row a bucket
    first = ends.withColumn("_starts", F.coalesce((F.col("_from") - F.lag("_to").over(chain) > gap_seconds * MICRO).cast("long"), F.lit(1)))
    breaks = (F.col("_gap") > gap_seconds * MICRO).cast("long")
    within = marked.withColumn("_in", F.sum(F.coalesce(breaks, F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = within.groupBy("_bucket").agg(F.max("_in").alias("_all"))
    before = first.join(total, "_bucket").withColumn("_base", F.sum(F.col("_starts") + F.col("_all")).over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_all"))
    return within.join(before.select("_bucket", "_base"), "_bucket").withColumn(name, F.col("_base") + F.col("_in")).drop("_bucket", "_gap", "_in", "_base")


def dominant_axis(images: DataFrame, *keys: str, strict: bool = False) -> DataFrame:
    """The circular mean of the doubled headings, halved, in 0..180; null if they cancel. `strength` from 0 to 1.

    strict: reading it fails where headings cancel.
    """
    double = F.radians(F.col("yaw") * 2)
    out = images.groupBy(*keys).agg(F.count(F.lit(1)).alias("images"), F.sum(F.cos(double)).alias("_x"), F.sum(F.sin(double)).alias("_y"))
    size = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    axis = F.when(size / F.col("images") > 1e-12, F.pmod(F.degrees(F.atan2("_y", "_x")) / 2, F.lit(180.0)))
    if strict:
        axis = F.coalesce(axis, F.raise_error(F.concat_ws(" ", F.lit("headings cancel:"), *(F.col(k).cast("string") for k in keys))).cast("double"))
    return out.select(*keys, "images", axis.alias("axis"), (size / F.col("images")).alias("strength"))


def flight_lines(images: DataFrame, axis: float, tolerance: float = 30.0, key: str = "sortie") -> DataFrame:
    """Images on a line: with direction (1 along the axis, -1 against) and line (from 1 in each sortie).

    An image off the axis ends a line and is left out; so does a change of direction or a gap of more than
    max(10 s, 5 median intervals), measured from the image before, on the axis or not.
    """
    off = axis_difference(F.col("yaw"), F.lit(axis)) > tolerance
    direction = F.when(angular_difference(F.col("yaw"), F.lit(axis)) <= 90, 1).otherwise(-1)
    # a sortie may be most of the images: ranges of its order are the unit, whose ends are chained, a row a range
    rows = ranged(images.withColumns({"_off": off, "direction": direction}), [key, "t_us", "image_id"])
    own = F.struct(key, "t_us", "image_id", "_off", "direction")
    ends = rows.groupBy("_part").agg(F.max(own).alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # one row a range
    before = F.coalesce(F.lag(own).over(Window.partitionBy("_part").orderBy(key, "t_us", "image_id")), F.col("_end"))
    seen = rows.join(F.broadcast(ends), "_part").withColumn("_before", before).drop("_end")
    seen = seen.withColumn("_before", F.when(F.col(f"_before.{key}").eqNullSafe(F.col(key)), F.col("_before"))).withColumn("_step", F.col("t_us") - F.col("_before.t_us"))
    seen = stage(seen, "steps")
    typical = quantiles(seen.where("_step > 0"), [key], "_step", [0.5]).select(key, F.get("q", F.lit(0)).alias("_median"))
    typical = seen.select("_part", key).distinct().join(typical, key, "left")
    limit = F.greatest(F.lit(10.0 * MICRO), 5 * F.coalesce("_median", F.lit(1.0 * MICRO)))
    broken = F.col("_before._off") | (F.col("_before.direction") != F.col("direction")) | (F.col("_step") > limit)
    flagged = stage(seen.join(typical, ["_part", key]).withColumn("_new", F.when(~F.col("_off"), F.coalesce(broken, F.lit(True)).cast("long")).otherwise(0)), "flagged")
    earlier = F.sum("_new").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = flagged.groupBy("_part", key).agg(F.sum("_new").alias("_new")).select("_part", key, F.coalesce(earlier, F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", key).orderBy("t_us", "image_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = flagged.withColumn("line", F.sum("_new").over(inside)).join(base, ["_part", key]).withColumn("line", F.col("line") + F.col("_base"))
    return numbered.where(~F.col("_off")).select(*images.columns, "direction", "line")


def local_metres(images: DataFrame, axis: float) -> DataFrame:
    """images with along_m and cross_m: metres from the mean position, along and across the axis.

    Longitudes are taken relative to one of them and wrapped, so a flight across 180 degrees stays together. Means are
    summed as decimals, so they are the same in any order of the rows.
    """
    exact = lambda c: F.sum(F.col(c).try_cast("decimal(28,18)")).cast("double") / F.nullif(F.count(F.col(c).try_cast("decimal(28,18)")), F.lit(0))
    mean = images.agg(exact("lat").alias("_lat"), F.min("lon").alias("_base"))
    images = images.join(F.broadcast(mean)).withColumn("_off", longitude_wrap(F.col("lon") - F.col("_base")))  # one row
    images = images.join(F.broadcast(images.agg(exact("_off").alias("_lon"))))
    north, east = metres_per_degree(F.col("_lat"))
    y, x = (F.col("lat") - F.col("_lat")) * north, (F.col("_off") - F.col("_lon")) * east
    a = F.radians(F.lit(axis))
    return images.withColumns({"along_m": x * F.sin(a) + y * F.cos(a), "cross_m": x * F.cos(a) - y * F.sin(a)}).drop("_lat", "_lon", "_off", "_base")


def centred_windows(lines: DataFrame, per_line: int, keys: tuple[str, ...] = ("sortie", "line")) -> DataFrame:
    """Of each line with enough images the most centred run of per_line images: first_image, last_image, mid, far, span,
    the line's median cross_m, the middle along_m and the greatest distance from the centre, radial.

    The least of (|mid|, farthest, span, first image) wins; images are ordered along the line.
    """
    order = Window.partitionBy(*keys).orderBy("along_m", "t_us", "image_id")
    ahead = order.rowsBetween(Window.currentRow, per_line - 1)
    runs = lines.withColumns({"last_image": F.last("image_id").over(ahead), "_end": F.last("along_m").over(ahead), "far": F.max(F.abs("along_m")).over(ahead), "_n": F.count(F.lit(1)).over(ahead), "_cross": F.median("cross_m").over(Window.partitionBy(*keys)), "radial": F.max(F.sqrt(F.col("along_m") * F.col("along_m") + F.col("cross_m") * F.col("cross_m"))).over(ahead)}).where(F.col("_n") == per_line)
    runs = runs.withColumns({"mid": F.abs((F.col("along_m") + F.col("_end")) / 2), "span": F.col("_end") - F.col("along_m")})
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("mid", "far", "span", "image_id"))
    return runs.withColumn("_i", best).where("_i = 1").select(*keys, F.col("image_id").alias("first_image"), "last_image", "mid", "far", "span", F.col("_cross").alias("cross_m"), ((F.col("along_m") + F.col("_end")) / 2).alias("along_m"), "radial")


def grid_block(windows: DataFrame, lines: int, key: str = "sortie") -> DataFrame:
    """The run of `lines` neighbouring lines whose windows lie nearest to the centre, one row over all keys.

    Lines are ordered by cross_m; the block's centre is the middle of its outer lines across and the median of its windows
    along. The least of (distance of that centre, farthest image, distance across, key, first line's place) wins. Returns
    the key, first_line, last_line, centre, farthest, cross_centre, along_centre and `lines`, in order across.
    """
    # windows of one key may be most of them, so runs are met by places in the whole order, not in a window of the key
    placed = index_of(windows.select(key, "line", "cross_m", "along_m", "radial"), [key, "cross_m", "line"], "_at")
    runs = placed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: F.col("_at") - k)).alias("_start"), F.struct("_at", key, "line", "cross_m", "along_m", "radial").alias("_x"))
    runs = runs.groupBy("_start").agg(F.array_sort(F.collect_list("_x")).alias("_run"))
    first, last, each = F.get("_run", F.lit(0)), F.element_at("_run", -1), lambda c: F.transform("_run", lambda x: x[c])
    runs = runs.where((F.size("_run") == lines) & first[key].eqNullSafe(last[key])).select(
        "_start",
        first[key].alias(key),
        ((first["cross_m"] + last["cross_m"]) / 2).alias("cross_centre"),
        array_median(each("along_m")).alias("along_centre"),
        F.array_max(each("radial")).alias("farthest"),
        each("line").alias("lines"),
    )
    scored = runs.withColumn("centre", F.sqrt(F.col("cross_centre") * F.col("cross_centre") + F.col("along_centre") * F.col("along_centre")))
    best = scored.orderBy("centre", "farthest", F.abs("cross_centre"), "_start").limit(1)  # places ascend by key
    return best.select(key, F.get("lines", F.lit(0)).alias("first_line"), F.element_at("lines", -1).alias("last_line"), "centre", "farthest", "cross_centre", "along_centre", "lines")


def validity_reasons(images: DataFrame) -> DataFrame:
    """images with `reasons`: why a position can't be used, joined by semicolons; empty if it can."""
    checks = F.array(
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.lit("no position")),
        F.when((F.abs("lat") > 90) | (F.abs("lon") > 180), F.lit("position out of range")),
        F.when(F.col("t_us").isNull(), F.lit("no capture time")),
        F.when(F.col("yaw").isNull(), F.lit("no heading")),
    )
    return images.withColumn("reasons", F.array_join(F.filter(checks, lambda x: x.isNotNull()), ";"))
