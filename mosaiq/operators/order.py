"""Global order without one task for all rows: indices and running sums over ranges, values at places by selection."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from mosaiq.session import ship
from mosaiq.sources.stage import stage

#: Rows of a group that one aggregate may hold for an exact quantile; groups above it are ordered over all tasks.
GROUP_ROWS = 2_000_000
#: Bits of a value that a step of the selection tells apart, and places that may be broadcast.
BITS, PLACES = 12, 100_000


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df, written in range partitions by `order`, with the number of its partition."""
    return stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")


def sum_before(df: DataFrame, order: list[str], weight: Column, out: str) -> DataFrame:
    """df with `out`: the sum of weight over all rows before each, in ascending order; equal rows in any order.

    Only the partitions' sums, one row a task, meet in one window. Rows that are equal in `order` stay in one range, so
    many equal ones are to be counted first: callers give distinct values or keys.
    """
    rows = ranged(df.withColumn("_w", weight), order)
    sums = rows.groupBy("_part").agg(F.sum("_w").alias("_w"))
    before = sums.select("_part", F.coalesce(F.sum("_w").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).drop("_part", "_w", "_before")


def index_of(df: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """df with its place from 0 in ascending order."""
    return sum_before(df, order, F.lit(1).cast("long"), out)


@F.pandas_udf(LongType())
def _ordered(values: pd.Series) -> pd.Series:
    """The bits of doubles as whole numbers in the same order; both zeros are equal, NaN is the greatest."""
    x = values.to_numpy(dtype=np.float64) + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(DoubleType())
def _value(ordered: pd.Series) -> pd.Series:
    bits = ordered.to_numpy(dtype=np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def nth_values(values: DataFrame, keys: list[str], value: str, asked: DataFrame, weight: str | None = None) -> DataFrame:
    """keys, at and value of asked (keys, at: places from 0 among the group's values in ascending order), each once.

    weight, if given, says how many times a row's value counts.

    Selection without a sort: the numbers that doubles' bits make in their order are refined BITS bits a step. A step
    counts the values of each group by these bits, among those that agree with a place's bits so far, and moves each place
    into its bucket; a bucket of one value ends the search. Only counts are shuffled, at most 2 ** BITS a place and step,
    so ties and hot groups cost nothing. keys may hold nulls.
    """
    ship(values.sparkSession)
    named = [f"_k{i}" for i in range(len(keys))]
    hashed = F.xxhash64(*(keys or [F.lit(0)])).alias("_g")  # only deals rows: keys are compared as well
    own = stage(values.where(F.col(value).isNotNull()).select(hashed, *(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_m"), _ordered(F.col(value).cast("double")).alias("_u")), "ordered")
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in named]
    places = stage(asked.select(hashed, *(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col("at").cast("long").alias("at"), F.col("at").cast("long").alias("_left"), F.lit(0).cast("long").alias("_prefix")).distinct(), "places")
    done, width = None, 0
    while width < 64:
        step = min(BITS, 64 - width)
        width += step
        seen = own.withColumn("_next", F.shiftright("_u", 64 - width))
        if width > step:
            live = places.select("_g", *named, "_prefix").distinct()
            live = F.broadcast(live) if live.count() <= PLACES else live
            seen = seen.withColumn("_prefix", F.shiftright("_u", 64 - width + step))
            both = seen.alias("a").join(live.alias("b"), reduce(and_, [F.col("a._g") == F.col("b._g"), F.col("a._prefix") == F.col("b._prefix"), *same]))
            seen = both.select("a.*")
        else:
            seen = seen.withColumn("_prefix", F.lit(0).cast("long"))
        counts = seen.groupBy("_g", *named, "_prefix", "_next").agg(F.sum("_m").alias("_n"), F.min("_u").alias("_low"), F.max("_u").alias("_high"))
        before = Window.partitionBy("_g", *named, "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        inside = [F.col("a._g") == F.col("b._g"), F.col("a._prefix") == F.col("b._prefix"), F.col("a._left") >= F.col("b._before"), F.col("a._left") < F.col("b._before") + F.col("b._n"), *same]
        met = places.alias("a").join(counts.alias("b"), reduce(and_, inside))
        met = stage(met.select("a._g", *(f"a.{n}" for n in named), "a.at", (F.col("a._left") - F.col("b._before")).alias("_left"), F.col("b._next").alias("_prefix"), "b._low", "b._high"), "places")
        ended = met.where("_low = _high").select(*named, "at", F.col("_low").alias("_u"))
        done = ended if done is None else done.unionByName(ended)
        places = met.where("_low != _high").drop("_low", "_high")
        if not places.head(1):
            break
    return done.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), "at", F.coalesce(_value("_u"), F.lit(float("nan"))).alias("value"))  # pandas has no NaN beside null


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value as a double and `_n`, how many rows have it, as a table: equal values are one row, nulls are counted too."""
    return stage(df.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("_n")), "counts")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], group_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """keys and q: the exact quantiles `at` of the values of each group, interpolated, as an array. Nulls are left out.

    Groups of at most group_rows rows are gathered in one aggregate; where one is larger, the values at the places asked
    for are selected by counts of bits. Both ways give the same numbers. With a weight (value counts, see `counted`) df is read
    as it is.
    """
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_m"))
    own = stage(own.drop("_m"), "values").withColumn("_m", F.lit(1).cast("long")) if weight is None else own
    sizes = stage(own.groupBy(*keys).agg(F.sum("_m").alias("_n"), F.count(F.lit(1)).alias("_rows")), "sizes")
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest <= (GROUP_ROWS if group_rows is None else group_rows):
        return own.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, at)), F.col("_m")).alias("q"))
    places = sizes.select(*keys, F.posexplode(F.array(*(F.lit(float(p)) * (F.col("_n") - 1) for p in at))).alias("_k", "_x"))
    asked = places.select(*keys, "_k", "_x", F.explode(F.array_distinct(F.array(F.floor("_x"), F.ceil("_x")))).alias("at"))
    found = nth_values(own, keys, "_v", asked.select(*keys, "at"), "_m")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = asked.alias("a").join(found.alias("b"), reduce(and_, [F.col("a.at") == F.col("b.at"), *same])).select(*(f"a.{k}" for k in keys), "_k", "_x", "a.at", F.col("b.value").alias("_v"))
    low = F.min(F.struct("at", "_v"))["_v"]
    high = F.max(F.struct("at", "_v"))["_v"]
    each = met.groupBy(*keys, "_k").agg((low + (high - low) * (F.max("_x") - F.floor(F.max("_x")))).alias("_q"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_q"))), lambda s: s["_q"]).alias("q"))
