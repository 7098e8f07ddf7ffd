"""Views that give the star-schema tables the shapes this engine works on: observations, labels, ledgers, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLICATES = 3
#: Rows of lineitem for each cell of the grid, about 1.4 observations a cell, variant and replicate at any size.
ROWS_PER_CELL = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_for(rows: int) -> int:
    """Rows and columns of the grid for so many rows: it grows with them, so that cells hold as much at any size."""
    return max(8, int((rows / ROWS_PER_CELL) ** 0.5))


def grid_side(spark: SparkSession, sf_dir: str) -> int:
    return side_for(table(spark, sf_dir, "lineitem").count())


def pixel_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate rasters of all rows: variant_id, replicate, r, c, b1..b3 on a square grid, nodata cells included."""
    return observations(table(spark, sf_dir, "lineitem"))


def observations(lineitem: DataFrame) -> DataFrame:
    """pixel_obs of this table."""
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("double")
    side = side_for(lineitem.count())
    return (
        lineitem
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("variant_id"),
            ((F.col("l_linenumber") - 1) % REPLICATES + 1).cast("int").alias("replicate"),
            (F.col("l_orderkey") % side).cast("int").alias("r"),
            (F.col("l_partkey") % side).cast("int").alias("c"),
        )
        .agg(F.min(F.col("l_quantity") - 1).alias("b1"), F.min(milli("l_discount")).alias("b2"), F.min(milli("l_tax")).alias("b3"))
    )


def attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing attempts: variant_id, replicate, status, attempt_seq (order of arrival)."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "ok_no_ortho").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant_id"), F.concat(F.lit("rep_"), (F.col("o_custkey") % 5).cast("string")).alias("replicate"), status.alias("status"), F.col("o_orderkey").alias("attempt_seq"))


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image positions: image_id, t_us (capture time in microseconds), lat, lon, yaw in degrees."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("image_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), (50 + (e % 97) / 10000).alias("lat"), (8 + (e % 89) / 10000).alias("lon"), ((e * 37) % 360).cast("double").alias("yaw"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def cells(obs: DataFrame) -> DataFrame:
    """One feature vector per cell: r, c and the medians m1..m3 over all valid observations."""
    return obs.where("not (b1 = 0 and b2 = 0 and b3 = 0)").groupBy("r", "c").agg(*(F.median(f"b{k}").alias(f"m{k}") for k in (1, 2, 3)))


def label_px(cell: DataFrame) -> DataFrame:
    """An ensemble of 36 segmentations of the cells: 3 scales x 3 rangers x 4 phases."""
    spark = cell.sparkSession
    runs = spark.createDataFrame([(s, g, p) for s in (4, 6, 9) for g in (1, 2, 3) for p in range(4)], "spatialr int, ranger int, phase int")
    s, g, p = F.col("spatialr"), F.col("ranger"), F.col("phase")
    row = F.floor((F.col("r") + (p % 2) * 0.5 * s) / s) * 2_000_000
    col = F.floor((F.col("c") + F.floor(p / 2) * 0.5 * s) / s) * 2
    label = row + col + F.when(F.col("m1") > 15 + 5 * g, 1).otherwise(0) + 1
    run_id = F.concat(F.lit("s"), s.cast("string"), F.lit("_g"), g.cast("string"), F.lit("_p"), p.cast("string"))
    return cell.join(F.broadcast(runs)).select(run_id.alias("run_id"), "spatialr", "ranger", "phase", "r", "c", label.cast("long").alias("label"))  # 36 runs by construction


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions of one set of objects: item, a, b."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("a"), F.col("source").alias("b"))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor design with one row a cell: flag (3 levels), state (2 levels) and integer metrics."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state")).agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("quantity"),
        F.max(F.floor(F.col("l_extendedprice") * 100 + 0.5)).cast("double").alias("top_cents"),
    )
