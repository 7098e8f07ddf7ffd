"""Study statistics: factor effects, correlations, numeric summaries, changes from a baseline, collection of results."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.order import counted, quantiles, sum_before
from mosaiq.sources.stage import stage

#: The 97.5 % quantile of Student's t for 1 to 30 degrees of freedom.
T_975 = (12.706204736, 4.30265273, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.20098516, 2.17881283, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.10092204, 2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.06865761, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456)


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a metric: keys, metric, value."""
    return df.unpivot(keys, metrics, "metric", "value") if keys else df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("x.*")


def factor_effects(design: DataFrame, factor: str, others: list[str], metrics: list[str]) -> DataFrame:
    """High minus low level of a two-level factor, paired within cells of the other factors: one row a metric.

    pairs, mean, sd, standard error, 95 % interval, and the effect in percent of the mean absolute value. Cells with
    more or fewer than one row a level give no pair. All metrics in one pass.
    """
    ends = design.agg(F.min(factor).alias("low"), F.max(factor).alias("high"), F.count_distinct(factor).alias("levels"))
    rows = long_form(design.withColumn("_f", F.col(factor)), ["_f", *others], metrics).join(F.broadcast(ends)).where("levels = 2")
    one = lambda side: F.max(F.when(F.col("_f") == F.col(side), F.col("value")))
    many = lambda side: F.count_if(F.col("_f") == F.col(side))
    cells = rows.groupBy("metric", *others).agg(one("high").alias("h"), one("low").alias("l"), many("high").alias("nh"), many("low").alias("nl"), F.first("low").alias("low_level"), F.first("high").alias("high_level"), F.sum(F.abs("value")).alias("size"), F.count("value").alias("n"))
    good = (F.col("nh") == 1) & (F.col("nl") == 1) & F.col("h").isNotNull() & F.col("l").isNotNull()
    d = F.when(good, F.col("h") - F.col("l"))
    out = cells.groupBy("metric").agg(F.first("low_level").alias("low_level"), F.first("high_level").alias("high_level"), F.count(d).alias("pairs"), F.avg(d).alias("mean_difference"), F.when(F.count(d) > 1, F.stddev_samp(d)).alias("sd"), (F.sum("size") / F.sum("n")).alias("mean_size"))
    t = F.coalesce(F.get(F.array(*map(F.lit, T_975)), (F.col("pairs") - 2).cast("int")), F.lit(1.959963985))
    half = F.when(F.col("pairs") > 1, t * F.col("sd") / F.sqrt("pairs"))
    return out.select(F.lit(factor).alias("factor"), "metric", "low_level", "high_level", "pairs", "mean_difference", "sd", (F.col("sd") / F.sqrt("pairs")).alias("se"), (F.col("mean_difference") - half).alias("ci_low"), (F.col("mean_difference") + half).alias("ci_high"), F.when(F.col("mean_size") != 0, 100 * F.col("mean_difference") / F.col("mean_size")).alias("relative_percent"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the mean rank of equal values. Ranks come from counts of distinct values, not from a sort of all rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sum_before(counts, [column], F.col("_n"), "_below").select(column, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, column, "left")


def correlations(df: DataFrame, metrics: list[str], method: str = "pearson") -> DataFrame:
    """Pairs of metrics: n (complete pairs), r; null if n < 3 or one has no spread. All pairs in one aggregate.

    Spearman ranks the rows in which both metrics are there, pair by pair where a metric has gaps.
    """
    names = {m: m for m in metrics}
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    if method == "spearman":
        df = stage(df.select(*metrics), "metrics")
        gaps = df.agg(*(F.count_if(F.col(m).isNull()).alias(m) for m in metrics)).first()  # one row
        if any(gaps[m] for m in metrics):  # ranks are among the complete rows of each pair
            each = [correlations(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b], method) for a, b in pairs]
            return reduce(DataFrame.unionByName, each)
        for m in metrics:
            df = average_ranks(df, m, f"_r_{m}")
            names[m] = f"_r_{m}"
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*(F.count_if(both(a, b)).alias(f"n{k}") for k, (a, b) in enumerate(pairs)), *(F.corr(F.when(both(a, b), F.col(names[a])), F.when(both(a, b), F.col(names[b]))).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("left_metric"), F.lit(b).alias("right_metric"), F.col(f"n{k}").alias("n"), F.when((F.col(f"n{k}") >= 3) & ~F.isnan(f"r{k}"), F.col(f"r{k}")).alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t: the regularised incomplete beta function by its continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        out = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + top * d or tiny), 1 + top / c or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def with_p_values(correlated: DataFrame) -> DataFrame:
    """correlations with p_value, two-sided, by Student's t with n - 2 degrees of freedom; null where r is.

    One row a pair of metrics: few, so a Python function an Arrow batch costs nothing.
    """

    @F.pandas_udf("double")
    def tails(n: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for k, x in zip(n.tolist(), r.tolist(), strict=True):
            if x is None or math.isnan(x) or k < 3:
                out.append(None)
            else:
                out.append(0.0 if abs(x) >= 1 else _tail(abs(x) * math.sqrt((k - 2) / (1 - x * x)), k - 2))
        return pd.Series(out, dtype="float64")

    p = tails(F.col("n"), F.col("r"))
    return correlated.withColumn("p_value", F.when(F.col("r").isNotNull(), p))


def correlation_matrix(correlated: DataFrame) -> DataFrame:
    """Pairs both ways and each metric with itself: row_metric, column_metric, r; the long form of a heat map."""
    both = correlated.select(F.explode(F.array(F.struct(F.col("left_metric").alias("row_metric"), F.col("right_metric").alias("column_metric"), "r"), F.struct(F.col("right_metric").alias("row_metric"), F.col("left_metric").alias("column_metric"), "r"))).alias("x")).select("x.*")
    own = both.select("row_metric").distinct().select("row_metric", F.col("row_metric").alias("column_metric"), F.lit(1.0).alias("r"))
    return both.unionByName(own)


def flattened(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, field and value (text) of the top level of a JSON object; nested values stay JSON. Other text gives no rows."""
    return df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))


def wide_profiles(design: DataFrame, artifacts: dict[str, DataFrame], fields: dict[str, tuple[str, str, str]], key: str = "run_id", report: str | None = None) -> DataFrame:
    """One row a run of the design, with a column for each field: (artifact, JSON path, type).

    artifacts: key and json, one row a run; a run without one has null in its fields, as where a path leads nowhere or
    to another type. report: the artifact whose status tells how the run went, as run_status: not_run without it,
    invalid_or_empty_report if it isn't JSON or has no status.
    """
    out = design
    for name, rows in artifacts.items():
        out = out.join(rows.select(key, F.col("json").alias(f"_{name}")), key, "left")
    columns = [F.expr(f"try_cast(get_json_object(`_{a}`, '{path}') as {kind})").alias(name) for name, (a, path, kind) in fields.items()]
    if report is not None:
        text = F.col(f"_{report}")
        status = F.when(text.isNull(), "not_run").otherwise(F.coalesce(F.get_json_object(text, "$.status"), F.lit("invalid_or_empty_report")))
        columns.append(status.alias("run_status"))
    return out.select(*design.columns, *columns)


def finished(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows whose status is final: complete, or left to the user's choice."""
    return rows.where(F.col(status).isin("complete", "choice_required"))


def numeric_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per keys and metric: n, mean, sample sd, coefficient of variation in percent, median, raw MAD, min, max, range."""
    group = [*keys, "metric"]
    counts = counted(long_form(df, keys, metrics), group, "value")  # rows are read once; all else goes by distinct values
    known = F.when(F.col("value").isNotNull(), F.col("_n"))
    one = counts.groupBy(*group).agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), (F.sum(F.col("value") * F.col("_n")) / F.sum(known)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))

    def beside(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        """left with the columns of right, a row a group and metric; keys may be null."""
        same = [left[k].eqNullSafe(right[f"_{k}"]) for k in group]
        return left.join(F.broadcast(right), reduce(lambda a, b: a & b, same), how).drop(*(f"_{k}" for k in group))

    own = [F.col(k).alias(f"_{k}") for k in group]
    middle = quantiles(counts, group, "value", [0.5], weight="_n").select(*own, F.get("q", F.lit(0)).alias("median"))
    found = stage(beside(one, middle), "medians")
    off = beside(counts, found.select(*own, "n", "mean", "median"), "inner").withColumns({"_off": F.abs(F.col("value") - F.col("median")), "_square": F.col("_n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))})
    sd = off.groupBy(*group).agg(F.sqrt(F.sum("_square") / F.when(F.max("n") > 1, F.max("n") - 1)).alias("sd")).select(*own, "sd")
    mad = quantiles(off, group, "_off", [0.5], weight="_n").select(*own, F.get("q", F.lit(0)).alias("mad"))
    return beside(beside(found, sd), mad).withColumns({"cv_percent": F.when(F.col("mean") != 0, 100 * F.col("sd") / F.col("mean")), "range": F.col("max") - F.col("min")})


def change_from_baseline(df: DataFrame, keys: list[str], metrics: list[str], baseline: Column) -> DataFrame:
    """Each other row's metrics against those of the one baseline row: change and relative_percent; missing values go."""
    rows = long_form(df.withColumn("_base", baseline), [*keys, "_base"], metrics).where(F.col("value").isNotNull() & ~F.isnan("value"))
    base = rows.where("_base").select("metric", F.col("value").alias("base"))
    out = rows.where("not _base").join(base, "metric")
    return out.select(*keys, "metric", "base", "value", (F.col("value") - F.col("base")).alias("change"), F.when(F.col("base") != 0, 100 * (F.col("value") - F.col("base")) / F.abs("base")).alias("relative_percent"))


def metric_extrema(df: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """The best row of each metric; directions are 'min' and 'max', ties go to the smaller key."""
    one = df.agg(*(F.min_by(F.struct(key, m), F.struct((F.col(m) if d == "min" else -F.col(m)).alias("v"), key)).alias(m) for m, d in metrics.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.col(f"{m}.{key}").alias(key), F.col(f"{m}.{m}").cast("double").alias("value")) for m, d in metrics.items()))).alias("x")).select("x.*")


def collect_results(plan: DataFrame, results: list[DataFrame], keys: list[str]) -> DataFrame:
    """The plan with every optional result joined on, where there is one."""
    return reduce(lambda a, b: a.join(b, keys, "left"), results, plan)


def missing_results(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of unlike tables under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distribution_table(df: DataFrame, role: str, fields: list[str]) -> DataFrame:
    """Per role and field: n, mean, median, min, max, p05, p95 and the population sd."""
    rows = long_form(df, [role], fields).where(F.col("value").isNotNull())
    q = quantiles(counted(rows, [role, "metric"], "value"), [role, "metric"], "value", [0.05, 0.5, 0.95], weight="_n").select(role, "metric", *(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p05", "median", "p95"))))
    return rows.groupBy(role, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("sd")).join(q, [role, "metric"])


def top_two(ranked: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """Per keys the best and second candidate of a ranking, wide, and the gap of their scores."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), name))
    own = ranked.withColumn("_i", place).where("_i <= 2").groupBy(*keys)
    at = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c)))
    return own.agg(at(name, 1).alias("first"), at(score, 1).alias("first_score"), at(name, 2).alias("second"), at(score, 2).alias("second_score"), (at(score, 1) - at(score, 2)).alias("gap"))
