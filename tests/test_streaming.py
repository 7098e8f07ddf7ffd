"""The stream's flight lines equal the batch's on images that come late and out of order."""

import numpy as np
from pyspark.sql import functions as F

from mosaiq.operators import flight as batch
from mosaiq.streaming import flight as stream
from mosaiq.streaming import ledger


def test_streamed_lines_equal_the_batch(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = []
    for mission in ("a", "b"):
        t = 1_700_000_000.0
        for i in range(160):
            t += float(r.choice([1, 2, 3, 15, 400], p=[0.5, 0.25, 0.15, 0.06, 0.04]))
            rows.append((mission, 1000 * (mission == "b") + i, t, float(r.choice([44.0, 46.0, 225.0, 130.0], p=[0.5, 0.2, 0.2, 0.1]))))
    end = max(x[2] for x in rows) + 10_000
    df = spark.createDataFrame([*rows, (None, 7, 1_700_000_000.0, 1.0), ("a", 8, None, 1.0), ("a", 9, 1_700_000_001.0, None)], "mission string, image_id long, s double, yaw double")
    timed = df.select("mission", "image_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("time"), "yaw")
    order = sorted(rows, key=lambda x: x[2] + r.uniform(0, 300))  # up to five minutes late
    folder = str(tmp_path / "in")
    schema = "mission string, image_id long, s double, yaw double"
    parts = [order[k : k + 60] for k in range(0, len(order), 60)] + [[("a", 5000, end, 0.0), ("b", 5001, end, 0.0)], [("c", 5002, end + 5000, 0.0)]]
    for part in parts:  # a file a batch
        spark.createDataFrame(part, schema).select("mission", "image_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("time"), "yaw").coalesce(1).write.mode("append").parquet(folder)
    images = spark.readStream.schema("mission string, image_id long, time timestamp, yaw double").option("maxFilesPerTrigger", 1).parquet(folder)
    query = ledger.to_parquet(stream.flight_lines(images, 45.0, 60.0, late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(300)
    got = sorted((x["mission"], x["sortie"], x["line"], x["direction"], x["image_id"]) for x in spark.read.parquet(str(tmp_path / "out")).collect() if x["image_id"] < 5000)
    want = []
    for mission in ("a", "b"):
        own = timed.where((F.col("mission") == mission) & F.col("time").isNotNull() & F.col("yaw").isNotNull()).withColumn("t_us", F.unix_micros("time"))
        lines = batch.flight_lines(batch.sorties(own, 300), 45.0, 60.0)
        want += [(mission, x["sortie"], x["line"], x["direction"], x["image_id"]) for x in lines.collect()]
    assert got == sorted(want) and len({x[:2] for x in got}) > 5
