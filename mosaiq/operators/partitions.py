"""Comparing partitions: contingency tables, adjusted Rand index, best overlaps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.sources.stage import stage


def contingency(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """a, b, n over the complete pairs: items without a part on either side are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: items, index; null for fewer than two items or without any spread. Everything follows from one contingency table."""
    table = contingency(df, a, b)
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = table.agg(F.sum("n").alias("items"), pairs(F.col("n")).alias("both"))
    left = table.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("left"))
    right = table.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("right"))
    one = cells.join(left).join(right)  # one row each
    every = F.col("items") * (F.col("items") - 1) / 2
    expected = F.col("left") * F.col("right") / every
    top = (F.col("left") + F.col("right")) / 2 - expected
    return one.select("items", F.when((F.col("items") >= 2) & (top != 0), (F.col("both") - expected) / top).alias("ari"))


def best_overlaps(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each part of the first partition the part of the second with the greatest overlap: shared items, shares of both."""
    table = contingency(df, a, b)
    left = table.groupBy(a).agg(F.sum("n").alias("left_n"))
    right = table.groupBy(b).agg(F.sum("n").alias("right_n"))
    best = table.groupBy(a).agg(F.min_by(F.struct(b, "n"), F.struct(-F.col("n"), F.col(b))).alias("x")).select(a, F.col(f"x.{b}").alias(b), F.col("x.n").alias("n"))
    return best.join(left, a).join(right, b).select(a, b, "n", (F.col("n") / F.col("left_n")).alias("left_share"), (F.col("n") / F.col("right_n")).alias("right_share"))


def hoover_scores(df: DataFrame, a: str = "a", b: str = "b", threshold: float = 0.8) -> DataFrame:
    """One row: shares of the area of partition a that b matches, splits, merges or misses.

    Own definition, after Hoover's: a part of a is matched if one part of b and it cover at least the threshold of each
    other; split if two or more parts of b that lie to the threshold within it cover the threshold of it; merged if it lies
    to the threshold within a part of b that two or more such parts cover to the threshold; missed otherwise. A part that
    fits several is counted under the first.
    """
    table = contingency(df, a, b)
    left = table.groupBy(a).agg(F.sum("n").alias("left_n"))
    right = table.groupBy(b).agg(F.sum("n").alias("right_n"))
    met = table.join(left, a).join(right, b).withColumns({"_in_a": F.col("n") / F.col("right_n") >= threshold, "_in_b": F.col("n") / F.col("left_n") >= threshold})
    merged = met.where("_in_b").groupBy(b).agg(F.count(F.lit(1)).alias("_parts"), F.sum("n").alias("_covered"), F.first("right_n").alias("_n")).where((F.col("_parts") >= 2) & (F.col("_covered") >= threshold * F.col("_n"))).select(b, F.lit(True).alias("_merged"))
    parts = met.join(merged, b, "left").groupBy(a).agg(
        F.first("left_n").alias("n"),
        F.max(F.col("_in_a") & F.col("_in_b")).alias("_matched"),
        F.count_if("_in_a").alias("_inside"),
        F.sum(F.when(F.col("_in_a"), F.col("n")).otherwise(0)).alias("_covered"),
        F.max(F.col("_in_b") & F.coalesce("_merged", F.lit(False))).alias("_merged"),
    )
    kind = F.when(F.col("_matched"), "matched").when((F.col("_inside") >= 2) & (F.col("_covered") >= threshold * F.col("n")), "split").when(F.col("_merged"), "merged").otherwise("missed")
    kinds = parts.withColumn("kind", kind)
    share = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias(k)
    return kinds.agg(F.count(F.lit(1)).alias("parts"), *(share(k) for k in ("matched", "split", "merged", "missed")))


def printed_metrics(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """keys, metric and value of lines that say "name: number" or "name = number"; names in lower case with underscores."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9 _/().-]*?)\s*(?::|=)\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$"
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_extract(column, pattern, 1))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    found = lines.where(F.col(column).rlike(pattern)).select(*keys, name.alias("metric"), F.regexp_extract(column, pattern, 2).cast("double").alias("value"))
    return found.where("metric != ''")


def printed_spread(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """metric_spread of the metrics that lines print; equal lines of the same keys are counted first and read once."""
    equal = stage(lines.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_times")), "lines")
    return metric_spread(printed_metrics(equal, [*keys, "_times"], column), keys, "_times")


def metric_spread(metrics: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """Mean and sample sd (0 for one value) of each metric's finite values: keys, metric, n, mean, sd.

    times, if given, says how many times a row counts.
    """
    good = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    if times is not None:
        group, n = [*keys, "metric"], F.col(times)
        values = stage(good.groupBy(*group, "value").agg(F.sum(n).alias("_n")), "printed")
        means = stage(values.groupBy(*(F.col(k).alias(f"_{k}") for k in group)).agg(F.sum("_n").alias("n"), (F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("mean")), "means")
        met = values.join(F.broadcast(means), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in group]))  # a row a key and metric
        square = F.sum(F.col("_n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
        return met.groupBy(*group, "n", "mean").agg(F.coalesce(F.sqrt(square / F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0.0)).alias("sd"))
    return good.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def ari_stability(labels: DataFrame, group: str = "spatialr") -> DataFrame:
    """Mean and sample sd of the adjusted Rand index over all pairs of runs of a group: labels (run_id, group, r, c, label).

    One contingency table for all pairs: a cell gathers its labels, one a run, cells with equal labels are counted, and pair
    counts follow from three sums of the table.
    """
    own = labels.where("label > 0").select(group, "run_id", "r", "c", "label")
    place = own.groupBy(group, "r", "c").agg(F.array_sort(F.collect_list(F.struct("run_id", "label"))).alias("_x"))
    alike = stage(place.groupBy(group, "_x").agg(F.count(F.lit(1)).alias("_n")), "alike")  # a segment's cells mostly agree in all runs
    left = alike.select(group, "_x", "_n", F.explode("_x").alias("_a"))
    met = left.select(group, "_a", "_n", F.explode(F.filter("_x", lambda b: b["run_id"] > F.col("_a.run_id"))).alias("_b"))
    table = stage(met.groupBy(group, F.col("_a.run_id").alias("left_run"), F.col("_b.run_id").alias("right_run"), F.col("_a.label").alias("x"), F.col("_b.label").alias("y")).agg(F.sum("_n").alias("n")), "table")
    key = [group, "left_run", "right_run"]
    choose = lambda n: F.sum(n * (n - 1) / 2)
    both = table.groupBy(*key).agg(F.sum("n").alias("items"), choose(F.col("n")).alias("both"))
    left = table.groupBy(*key, "x").agg(F.sum("n").alias("n")).groupBy(*key).agg(choose(F.col("n")).alias("left"))
    right = table.groupBy(*key, "y").agg(F.sum("n").alias("n")).groupBy(*key).agg(choose(F.col("n")).alias("right"))
    expected = F.col("left") * F.col("right") / (F.col("items") * (F.col("items") - 1) / 2)
    top = (F.col("left") + F.col("right")) / 2 - expected
    scored = both.join(left, key).join(right, key).withColumn("ari", F.when((F.col("items") >= 2) & (top != 0), (F.col("both") - expected) / top))
    return scored.groupBy(group).agg(F.count("ari").alias("pairs"), F.avg("ari").alias("mean"), F.stddev_samp("ari").alias("sd"))
