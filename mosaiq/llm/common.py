"""What the operators share: a folder all executors see, materialised steps, distributed running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.session import ship
from mosaiq.sources.stage import root_of

#: Rows that one task of a distributed rank is meant to hold.
ROWS_PER_CHUNK = 250_000
#: Rows of an Arrow batch, which a Python worker and the JVM both hold.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session has its own setting: texts are long.

    It changes the session, so only the registered queries and the pipeline call it, no operator does.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{root_of(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mosaiq_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised steps that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_mosaiq_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def chunk_count(rows: int) -> int:
    """Chunks for a ranking over so many rows."""
    return max(8, -(-rows // ROWS_PER_CHUNK))


def running_total(df: DataFrame, keys: list[str], classes: list[str], ties: list[str], weight, out: str, chunks: int) -> DataFrame:
    """Add `out`: the sum of weight over the rows before each row of its keys, ordered by classes, then by a hash of ties.

    Two levels keep a hot key out of one task: rows are cut into chunks by a hash of the ties, totals of
    (keys, classes, chunk) are summed in order, and only rows of one chunk are ordered together. Nothing but
    the totals meets in one task. df must give the same rows whenever it is read.
    """
    d = df.withColumn("__chunk", F.pmod(F.xxhash64(*ties), F.lit(chunks)).cast("int")).withColumn("__w", F.lit(weight) if isinstance(weight, int) else weight)
    cell = [*keys, *classes, "__chunk"]
    before = Window.partitionBy(*keys).orderBy(*classes, "__chunk").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(*classes, "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*cell).agg(F.sum("__w").alias("__w")).withColumn("__before", F.coalesce(F.sum("__w").over(before), F.lit(0))).drop("__w")
    inside = Window.partitionBy(*cell).orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = d.join(totals, cell)
    return joined.withColumn(out, (F.col("__before") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).cast("long")).drop("__chunk", "__w", "__before")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also makes this package importable on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Keys that may be called hot: a key is hot above a share of 1 / HOT_KEYS of all rows, so there can't be more.
HOT_KEYS = 100_000
#: Rows of a key that one task may always get.
FEW_ROWS = 2_000


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame | None:
    """keys and __salts of the hot keys of a materialised table with a row for each key and its number of rows, n.

    A key is hot above max(FEW_ROWS, total / HOT_KEYS) rows, so the table has at most HOT_KEYS rows whatever the input
    and may be broadcast; no salt of a hot key has more rows than that bound, roughly. None where no key is hot.
    """
    total = counts.agg(F.sum(n), F.max(n)).first()
    bound = max(FEW_ROWS, (total[0] or 0) // HOT_KEYS)
    if (total[1] or 0) <= bound:
        return None
    return F.broadcast(counts.where(F.col(n) > bound).select(*keys, F.ceil(F.col(n) / bound).cast("int").alias("__salts")))


def meet(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame | None, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with side on keys; the rows of hot keys are dealt by `spread` over salts, to each of which side goes.

    how: inner, left or left_semi. side should have few rows for each hot key.
    """
    if hot is None:
        return rows.join(side, keys, how)
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copies = side.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0))))).drop("__salts")
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def without_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """documents but the rows whose doc_id is in ids (one column); rows with a null doc_id stay."""
    name = f"id_{uuid.uuid4().hex}"  # that documents have no column of
    ids = materialise(ids.toDF(name).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return documents.join(side, F.col("doc_id") == F.col(name), "left_anti")
