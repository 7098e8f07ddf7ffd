"""Ground control points: their table with elevations, and where images show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.exprs import zero_padded
from mosaiq.operators.checks import bilinear


def control_points(points: DataFrame, surface: DataFrame, value: str) -> DataFrame:
    """gcp_id (prefixed by point), x, y and elev of points (gcp_id, row, column, x, y): the surface (r, c, value) at row and
    column, from its four neighbours; null at a gap.

    Repeated points of one gcp_id stay apart if they lie at different places.
    """
    placed = points.withColumn("point_id", F.struct("gcp_id", F.col("row").cast("double").alias("row"), F.col("column").cast("double").alias("column")))
    elev = bilinear(placed.select("point_id", F.col("row").alias("y"), F.col("column").alias("x")).distinct(), surface, value).withColumnRenamed(value, "elev")
    return placed.join(elev, "point_id", "left").select(F.concat(F.lit("point"), F.col("gcp_id").cast("string")).alias("gcp_id"), "x", "y", "elev")


def image_points(marks: DataFrame) -> DataFrame:
    """gcp_id, image_path, x and y of marks (gcp, part_folder, media_folder, image_file, x, y), in order of id and path.

    Marks without a place are left out. A path is PART_pp/mMEDIA/DJI_iiii.JPG, with numbers filled up by zeros.
    """
    path = F.concat(F.lit("PART_"), zero_padded(F.col("part_folder"), 2), F.lit("/"), F.col("media_folder").cast("string"), F.lit("MEDIA/DJI_"), zero_padded(F.col("image_file"), 4), F.lit(".JPG"))
    named = marks.where("x is not null").select(F.concat(F.lit("point"), F.col("gcp").cast("string")).alias("gcp_id"), path.alias("image_path"), "x", "y")
    return named.orderBy("gcp_id", "image_path")


def unmatched_points(points: DataFrame, marks: DataFrame) -> DataFrame:
    """gcp_id and missing, of points that no image shows (marks) and of marks without a point (points)."""
    own, seen = points.select("gcp_id").distinct(), marks.select("gcp_id").distinct()
    return own.join(seen, "gcp_id", "left_anti").withColumn("missing", F.lit("marks")).unionByName(seen.join(own, "gcp_id", "left_anti").withColumn("missing", F.lit("points")))
