"""Sources and sinks: ledgers, CSV, TSV and JSON tables, variant tables, raster tables, step manifests. Grids: `grids`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from mosaiq.functions.exprs import exif_time, missing_to_null

#: Columns of an attempt ledger; all text.
LEDGER = ("experiment_id", "variant_id", "replicate", "status", "return_code", "config_file", "project_dir", "output_dir", "project_file", "ortho_file", "launcher_log", "elapsed_sec")
ATTEMPTS = "variant_id string, replicate string, status string, attempt_seq long"
STEP = StructType([StructField("step", StringType()), StructField("status", StringType()), StructField("inputs", MapType(StringType(), StringType())), StructField("artifacts", MapType(StringType(), StringType())), StructField("provenance", MapType(StringType(), StringType()))])


def _require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV table with a header; every column is text, trimmed, missing marks become null."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')
    return raw.select(*(missing_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns))


def write_text_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A CSV or TSV table; nested values become JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, sep=sep)


def read_ledger(spark: SparkSession, path: str, usable: bool = True) -> DataFrame:
    """A ledger with its columns checked; usable rows only (status ok, with an output) unless told otherwise."""
    rows = _require(read_text_table(spark, path), LEDGER).select(*LEDGER)
    known = F.when(F.col("status").isin("ok", "ok_no_ortho", "failed"), F.col("status"))
    rows = rows.withColumn("status", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))).cast("string")))
    return rows.where((F.col("status") == "ok") & F.col("ortho_file").isNotNull()) if usable else rows


def append_ledger(df: DataFrame, path: str) -> None:
    _require(df, LEDGER).select(*LEDGER).write.mode("append").csv(path, header=True)


def existing_files(spark: SparkSession, rows: DataFrame, column: str, folder: str) -> DataFrame:
    """rows whose file is there and not empty, by a listing without contents; paths may be whole or relative to the folder."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[a-z0-9]+:(//[^/]*)?", ""), r"/(\./)+", "/"), r"/+", "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0").select(plain(F.col("path")).alias("_path"))
    own = F.col(column)
    whole = F.when(own.rlike(r"^([a-z0-9]+:)?/"), own).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), own))
    return rows.withColumn("_path", plain(whole)).join(listed, "_path", "left_semi").drop("_path").select(*rows.columns)


def newest_file(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The path with the latest modification time, one row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def read_json_rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON file that holds a list of objects."""
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """A variant table: variant_id and a map of the overrides that aren't missing."""
    rows = _require(read_text_table(spark, path), ("variant_id",))
    keys = [c for c in rows.columns if c != "variant_id"]
    pairs = F.create_map(*(x for c in keys for x in (F.lit(c), F.col(f"`{c}`")))) if keys else F.create_map().cast("map<string,string>")
    return rows.select("variant_id", F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("overrides"))


def read_step_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEP).json(path, multiLine=True)


def write_raster(df: DataFrame, path: str, nodata: float = 0.0, block: int = 512) -> None:
    """Pixels as Parquet, partitioned by variant; missing band values become nodata. Rows are clustered by block."""
    bands = [c for c in df.columns if c.startswith("b")]
    filled = df.withColumns({b: F.coalesce(b, F.lit(nodata)) for b in bands})
    filled.repartitionByRange("variant_id", F.floor(F.col("r") / block), F.floor(F.col("c") / block)).write.mode("overwrite").partitionBy("variant_id").parquet(path)


def read_usable(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Rows of a ledger that can be analysed: status ok, an output that is there and not empty, variant and replicate given.

    Fails if such a row lacks its variant or replicate, or if there is none.
    """
    rows = existing_files(spark, read_ledger(spark, path), "ortho_file", folder)
    rows.cache()
    try:
        bad = rows.where("variant_id is null or replicate is null").count()
        if bad:
            raise ValueError(f"{bad} rows without variant_id or replicate")
        if not rows.head(1):
            raise ValueError(f"no usable rows in {path}")
    finally:
        rows.unpersist()
    return rows


def write_ledger(df: DataFrame, path: str) -> None:
    """A whole ledger in its columns' order; other columns are an error."""
    odd = [c for c in df.columns if c not in LEDGER]
    if odd:
        raise ValueError(f"not columns of a ledger: {', '.join(odd)}")
    _require(df, LEDGER).select(*LEDGER).write.mode("overwrite").csv(path, header=True)


def write_step_manifest(df: DataFrame, path: str) -> None:
    """Step manifests as JSON, one object a row; exactly the five keys, a step and a status."""
    if sorted(df.columns) != sorted(f.name for f in STEP.fields):
        raise ValueError(f"a step manifest has the keys {', '.join(f.name for f in STEP.fields)}")
    checked = df.withColumn("step", F.coalesce(F.when((F.length(F.trim("step")) > 0) & (F.length(F.trim("status")) > 0), F.col("step")), F.raise_error(F.lit("a step manifest without step or status")).cast("string")))
    checked.select(*(F.col(f.name).cast(f.dataType) for f in STEP.fields)).write.mode("overwrite").json(path)


def preflight(frames: dict[str, DataFrame], contract: dict[str, dict[str, str]]) -> list[str]:
    """What keeps tables from being used: missing tables, missing columns, and types other than the contract's.

    contract: for each table its columns and their simple types (an empty type takes any). Only schemas are read.
    """
    out = []
    for name, columns in contract.items():
        if name not in frames:
            out.append(f"{name}: no such table")
            continue
        types = dict(frames[name].dtypes)
        for column, kind in columns.items():
            if column not in types:
                out.append(f"{name}.{column}: missing")
            elif kind and types[column] != kind:
                out.append(f"{name}.{column}: {types[column]} in place of {kind}")
    return out


def count_inputs(spark: SparkSession, folder: str, suffixes: tuple[str, ...], leave_out: str | None = None) -> int:
    """Files below a folder, not empty, with one of the suffixes, in any case, but those of one name. Only the listing is read."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(name.alias("n"))
    pattern = "(" + "|".join(re.escape(s.lower()) for s in suffixes) + ")$"
    return found.where(F.col("n").rlike(pattern)).where(F.lit(leave_out is None) | (F.col("n") != (leave_out or "").lower())).count()


#: Names that an image's tags have: column, tag.
TAGS = {"source_path": "SourceFile", "lat": "GPSLatitude", "lon": "GPSLongitude", "altitude_m": "GPSAltitude", "captured": "DateTimeOriginal", "yaw": "FlightYawDegree"}


def read_exif_positions(spark: SparkSession, path: str) -> DataFrame:
    """Image positions of a JSON list of tags (numbers as numbers), in order of time and path: the tags, t_us, reasons.

    A row that can't be used stays, with the reasons why (see flight.validity_reasons).
    """
    from mosaiq.operators.flight import validity_reasons

    rows = spark.read.schema(", ".join(f"{t} string" for t in TAGS.values())).json(path, multiLine=True)
    own = rows.select(*((F.col(t) if c in ("source_path", "captured") else F.expr(f"try_cast({t} as double)")).alias(c) for c, t in TAGS.items()))
    timed = own.withColumn("t_us", F.unix_micros(exif_time(F.col("captured"))))
    return validity_reasons(timed).orderBy(F.col("t_us").asc_nulls_last(), "source_path")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def raster_headers(headers: DataFrame) -> DataFrame:
    """Raster headers without rotated ones; `usable` says whether resolution and projection agree with the first raster."""
    first = headers.orderBy("raster_id").limit(1).select(F.col("xres").alias("_x"), F.col("yres").alias("_y"), F.col("proj").alias("_p"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1e-7), 1e-6 * F.greatest(F.abs(a), F.abs(b)))
    return headers.where("rot1 = 0 and rot2 = 0").join(F.broadcast(first)).withColumn("usable", close("xres", "_x") & close("yres", "_y") & (F.col("proj") == F.col("_p"))).drop("_x", "_y", "_p")
