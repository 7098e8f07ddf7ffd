"""Sources, sinks and streams."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mosaiq.sources import tables
from mosaiq.sources.stage import clear, root_of, stage
from mosaiq.streaming import ledger as stream


def test_ledger_round_trip(spark, tmp_path):
    row = ["e", "v1", "rep_1", "ok", "0", "c", "p", "o", "f", "ortho.tif", "log", "1.5"]
    df = spark.createDataFrame([row, [*row[:3], "failed", "1", *row[5:9], "NA", *row[10:]]], ", ".join(f"{c} string" for c in tables.LEDGER))
    tables.append_ledger(df.coalesce(1), str(tmp_path / "l"))
    tables.append_ledger(df.coalesce(1), str(tmp_path / "l"))
    got = tables.read_ledger(spark, str(tmp_path / "l"))
    assert got.count() == 2 and {r["status"] for r in got.collect()} == {"ok"}
    with pytest.raises(ValueError, match="missing columns"):
        tables.append_ledger(df.drop("status"), str(tmp_path / "m"))


def test_text_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", " x ", [1, 2]), ("b", "NA", [])], "variant_id string, k string, v array<int>")
    tables.write_text_table(df.coalesce(1), str(tmp_path / "t"), "\t")
    got = {r["variant_id"]: r for r in tables.read_text_table(spark, str(tmp_path / "t"), "\t").collect()}
    assert got["a"]["k"] == "x" and got["b"]["k"] is None and got["a"]["v"] == "[1,2]"
    tables.write_text_table(df.select("variant_id", "k").coalesce(1), str(tmp_path / "v"))
    assert {r["variant_id"]: r["overrides"] for r in tables.read_variants(spark, str(tmp_path / "v")).collect()} == {"a": {"k": "x"}, "b": {}}


def test_rasters(spark, tmp_path):
    df = spark.createDataFrame([("v", 0, 0, 1.0, None), ("w", 1, 1, 2.0, 3.0)], "variant_id string, r int, c int, b1 double, b2 double")
    tables.write_raster(df, str(tmp_path / "r"))
    got = {r["variant_id"]: r["b2"] for r in tables.read_raster(spark, str(tmp_path / "r")).collect()}
    assert got == {"v": 0.0, "w": 3.0}
    heads = spark.createDataFrame([("a", 1.0, 1.0, "p", 0.0, 0.0), ("b", 1.0 + 1e-8, 1.0, "p", 0.0, 0.0), ("c", 2.0, 1.0, "p", 0.0, 0.0), ("d", 1.0, 1.0, "p", 0.1, 0.0)], "raster_id string, xres double, yres double, proj string, rot1 double, rot2 double")
    assert {r["raster_id"]: r["usable"] for r in tables.raster_headers(heads).collect()} == {"a": True, "b": True, "c": False}


def test_written_steps_are_cleared(spark):
    df = stage(spark.range(3), "three")
    path = Path(root_of(spark).removeprefix("file://"))
    assert df.count() == 3 and any(path.iterdir())
    clear(spark)
    assert not path.exists()


def test_streamed_ledger(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "failed", 1), ("a", "r", "ok", 2)], tables.ATTEMPTS)
    df.coalesce(1).write.csv(str(tmp_path / "in"), header=True)
    q = stream.to_memory(stream.latest_per_key(stream.read_attempts(spark, str(tmp_path / "in"))), "latest_test", "complete", str(tmp_path / "cp"))
    q.awaitTermination(120)
    row = spark.table("latest_test").first()
    assert (row["status"], row["attempts"]) == ("ok", 2)


def test_streamed_sessions(spark, tmp_path):
    spark.range(4).select((F.col("id") * F.when(F.col("id") < 3, 100).otherwise(10_000)).alias("s")).select(F.timestamp_seconds("s").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    images = spark.readStream.schema("t timestamp").parquet(str(tmp_path / "in"))
    q = stream.to_parquet(stream.sessions(images, "t", late="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["images"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()] == [3]
