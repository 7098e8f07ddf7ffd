"""Grids of 32-bit floats beside a text header, read and written by many tasks.

A grid is a file of values, row after row, and a header of lines KEY = value: CELLCOUNT_X, CELLCOUNT_Y, NODATA_VALUE and
TOPTOBOTTOM (rows run from the bottom unless TRUE). A row of the grid is a record of fixed length, so any file system that
Spark reads is split at rows, and a file of any size goes to many tasks. Writing needs a folder that driver and executors
share as files: each task puts the rows of its blocks at their own place of one file, which gets its name when all are in.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.session import ship

#: Bytes of a split of the file, roughly.
SPLIT_BYTES = 1 << 25
#: Cells of a block that one task writes at once.
BLOCK_CELLS = 1 << 22


def read_header(spark: SparkSession, header: str) -> dict[str, str]:
    lines = [line.value for line in spark.read.text(header).limit(100).collect()]  # a header
    return {k.strip().upper(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x)}


def read_grid(spark: SparkSession, header: str) -> DataFrame:
    """r, c, value of a grid; nodata values and those that aren't finite are left out. The values are in the file of the
    same name that ends in .sdat; one that doesn't hold the cells of the header is an error.
    """
    ship(spark)
    keys = read_header(spark, header)
    width, height = int(keys["CELLCOUNT_X"]), int(keys["CELLCOUNT_Y"])
    nodata = np.float32(keys.get("NODATA_VALUE", "-99999").split(";")[0])
    down = keys.get("TOPTOBOTTOM", "FALSE").upper() == "TRUE"
    path = re.sub(r"\.[^./]*$", ".sdat", header)
    size = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = size.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(size).getLen()
    if size != 4 * width * height:
        raise ValueError(f"{size} bytes for {width} x {height} cells")
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(4 * width), "mapreduce.input.fileinputformat.split.maxsize": str(SPLIT_BYTES)}
    records = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    lines = spark.createDataFrame(records.map(lambda x: (int(x[0]), bytearray(x[1]))), "line long, content binary")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for line, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = np.frombuffer(content.as_buffer(), "<f4")
                at = np.flatnonzero(np.isfinite(values) & (values != nodata))
                row = line if down else height - 1 - line
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row, np.int32)), pa.array(at.astype(np.int32)), pa.array(values[at].astype(np.float64))], ["r", "c", "value"])

    return lines.mapInArrow(cells, "r int, c int, value double")


def _write_block(path: str, width: int, height: int, rows: int, nodata: float):
    def run(cells: pa.Table, blocks: pa.Table) -> pa.Table:
        written = []
        for block in blocks.column("block").to_pylist():
            first, last = block * rows, min(height, (block + 1) * rows)
            grid = np.full((last - first, width), nodata, "<f4")
            if cells.num_rows:
                r, c, value = (cells.column(x).to_numpy() for x in ("r", "c", "value"))
                grid[r - first, c] = value
            with open(path, "r+b") as f:  # whole rows at their own place: a task that runs again writes the same bytes
                f.seek(4 * width * (height - last))
                f.write(grid[::-1].tobytes())
                f.flush()
                os.fsync(f.fileno())
            written.append(last - first)
        return pa.table([pa.array(written, pa.int64())], ["rows"])

    return run


def write_grid(df: DataFrame, header: str, width: int, height: int, nodata: float = -99999.0, pixel: float = 1.0) -> None:
    """r, c, value as a grid, from the bottom row; null values and cells that aren't there become nodata.

    Cells outside the grid, or two values for one cell, are an error. Blocks of rows go to tasks; nothing but their number
    of rows comes to the driver. header: a path in a folder that driver and executors share.
    """
    spark = df.sparkSession
    ship(spark)
    header = re.sub(r"^file:(//)?", "", header)
    own = df.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value")).where("value is not null")
    odd = own.agg(F.count_if(F.expr(f"r is null or c is null or r < 0 or c < 0 or r >= {height} or c >= {width}")), F.count(F.lit(1))).first()
    if odd[0]:
        raise ValueError(f"{odd[0]} values outside {width} x {height} cells")
    if own.groupBy("r", "c").count().where("count > 1").head(1):
        raise ValueError("several values for one cell")
    rows = max(1, BLOCK_CELLS // width)
    blocks = spark.range(-(-height // rows)).select(F.col("id").alias("block"))
    beside = f"{header}.{uuid.uuid4().hex}.tmp"
    with open(beside, "wb") as f:
        f.truncate(4 * width * height)
    try:
        placed = own.withColumn("block", F.floor(F.col("r") / rows).cast("long")).groupBy("block").cogroup(blocks.groupBy("block"))
        written = placed.applyInArrow(_write_block(beside, width, height, rows, nodata), "rows long").agg(F.sum("rows")).first()[0]
        if written != height:
            raise OSError(f"{written} of {height} rows are written")
        os.replace(beside, Path(header).with_suffix(".sdat"))
    finally:
        Path(beside).unlink(missing_ok=True)
    text = {"NAME": Path(header).stem, "DATAFORMAT": "FLOAT", "CELLCOUNT_X": width, "CELLCOUNT_Y": height, "CELLSIZE": pixel, "NODATA_VALUE": nodata, "TOPTOBOTTOM": "FALSE"}
    Path(header).write_text("".join(f"{k}\t= {v}\n" for k, v in text.items()))
