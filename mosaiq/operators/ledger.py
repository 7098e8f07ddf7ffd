"""Ledgers of processing attempts: latest attempt, status, resume plans; factor grids and candidate populations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("ok", "ok_no_ortho", "failed")


def derive_status(return_code: Column, ortho: Column) -> Column:
    """ok with an output, ok_no_ortho without, failed for any other return code."""
    done = return_code.cast("string") == "0"
    return F.when(done & (F.length(F.trim(ortho)) > 0), "ok").when(done, "ok_no_ortho").otherwise("failed")


def check_status(attempts: DataFrame) -> DataFrame:
    """attempts; reading it fails on a status that isn't known."""
    known = F.col("status").isin(*STATUSES)
    return attempts.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null"))))))


def latest_attempts(attempts: DataFrame, keys: tuple[str, ...] = ("variant_id", "replicate"), seq: str = "attempt_seq") -> DataFrame:
    """The last attempt of each key, with how many there were. Partial max_by, so a key's attempts never meet in a sort."""
    rest = [c for c in attempts.columns if c not in keys]
    found = attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, *[c for c in rest if c != seq])).alias("x"), F.count(F.lit(1)).alias("attempts"))
    return found.select(*keys, "x.*", "attempts")


def status_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("variant_id", "status").agg(F.count(F.lit(1)).alias("n"))


def attempt_labels(attempts: DataFrame) -> DataFrame:
    """attempts with a label: the replicate for the first one, then replicate_attempt_2 and so on."""
    nth = F.row_number().over(Window.partitionBy("variant_id", "replicate").orderBy("attempt_seq"))
    return attempts.withColumn("label", F.when(nth == 1, F.col("replicate")).otherwise(F.concat("replicate", F.lit("_attempt_"), nth.cast("string"))))


#: Fields that an attempt must have filled before a run may be skipped.
KEPT = ("config_file", "project_dir", "output_dir", "project_file", "launcher_log")


def resume_plan(planned: DataFrame, attempts: DataFrame, done: tuple[str, ...] = ("ok", "ok_no_ortho"), filled: tuple[str, ...] = ()) -> DataFrame:
    """Planned (variant_id, replicate) whose latest attempt isn't done, or is without one of the fields `filled` (as KEPT)."""
    whole = F.lit(True)
    for c in filled:
        whole = whole & (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    good = latest_attempts(attempts).where(F.col("status").isin(*done) & whole).select("variant_id", "replicate")
    return planned.join(good, ["variant_id", "replicate"], "left_anti")


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """df; reading it fails if two rows have the same keys."""
    text = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    ok = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), text)).cast("boolean"))
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def factor_grid(spark: SparkSession, factors: dict[str, list | DataFrame]) -> DataFrame:
    """All combinations of the factors' levels, with a variant_id made of them. A design has few levels, so it's small.

    A factor's levels are a list, or a table whose first column holds them; those of a table count once, nulls not at all.
    """

    def levels_of(name: str, levels: list | DataFrame) -> DataFrame:
        if isinstance(levels, DataFrame):
            return levels.select(F.col(levels.columns[0]).alias(name)).dropna().distinct()
        return spark.createDataFrame([(x,) for x in levels], [name])

    grid = reduce(lambda a, b: a.crossJoin(b), [levels_of(*x) for x in factors.items()])
    return grid.select(F.concat_ws("_", *(F.concat(F.lit(f"{k}-"), F.col(k).cast("string")) for k in factors)).alias("variant_id"), *factors)


def candidate_population(scales: DataFrame, rangers: DataFrame, phases: DataFrame, budget: int) -> DataFrame:
    """Scales x rangers x phases; fails if there are more than the budget, never cuts."""
    out = scales.crossJoin(rangers).crossJoin(phases)
    n = out.count()
    if n > budget:
        raise ValueError(f"{n} candidates are more than the budget of {budget}")
    return out.withColumn("candidate_id", F.format_string("s%d_g%d_p%d", "spatialr", "ranger", "phase")).withColumn("is_baseline", (F.col("ranger") == 2) & (F.col("phase") == 0))


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A fixed sample of n rows: those with the smallest hash of their keys (a sampling operator)."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)
