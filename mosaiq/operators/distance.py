"""Exact Euclidean distance transform: the nearest source cell of each cell, however far, in two passes over strips.

Along rows: a task holds a band of rows of one key and gives, for each row with a source and each column asked for, the
nearest source column. Down columns: a task holds a strip of columns with all rows that have a source, and keeps for each
column the lower envelope of the parabolas (r - row)^2 + offset^2; a query reads its place on the envelope. Bounds of the
envelope are whole numbers, so ties are exact: they go to the smaller row, then to the smaller column.

Work and shuffled data grow with rows that have sources times columns that are asked for, not with any distance. Bands and
strips are cut so that a task holds about CELLS cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.session import ship

#: Cells of a band or a strip, roughly.
CELLS = 1 << 20
#: Columns of a strip at most.
WIDTH = 512


def nearest_columns(sources: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each of columns the nearest of the sorted sources, the smaller one if two are as near."""
    at = np.searchsorted(sources, columns)
    right = sources[np.minimum(at, len(sources) - 1)]
    left = sources[np.maximum(at - 1, 0)]
    return np.where(np.abs(columns - left) <= np.abs(right - columns), left, right)


def envelope(rows: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower envelopes of the parabolas (x - rows[i])^2 + offset[i, c]^2, one for each column c; rows ascend.

    Gives kept (indices i by place and column), start (place k holds for whole x above start[k], up to start[k + 1]) and
    the number of places of each column.
    """
    n, w = offset.shape
    height = offset.astype(np.int64) ** 2 + (rows.astype(np.int64) ** 2)[:, None]
    kept, start = np.zeros((n, w), np.int32), np.full((n + 1, w), np.iinfo(np.int64).min, np.int64)
    top = np.full(w, -1)
    every = np.arange(w)
    for q in range(n):
        open_ = every[top >= 0]
        begin = np.full(w, np.iinfo(np.int64).min, np.int64)
        while len(open_):
            last = kept[top[open_], open_]
            meet = (height[q, open_] - height[last, open_]) // (2 * (rows[q] - rows[last]))  # up to here the earlier one is as near
            gone = meet <= start[top[open_], open_]
            begin[open_] = meet
            open_ = open_[gone]
            top[open_] -= 1
            begin[open_[top[open_] < 0]] = np.iinfo(np.int64).min
            open_ = open_[top[open_] >= 0]
        top += 1
        kept[top, every] = q
        start[top, every] = begin
    return kept, start, top + 1


def _along_rows(keys: list[str], width: int):
    def run(sources: pa.Table, strips: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in (*keys, "_strip", "_rows", "_columns")}
        if sources.num_rows and strips.num_rows:
            r, c = (np.asarray(sources.column(x).to_numpy(), np.int64) for x in ("_r", "_c"))
            by = np.lexsort((c, r))
            r, c = r[by], c[by]
            rows, first = np.unique(r, return_index=True)
            ends = [*first[1:].tolist(), len(r)]
            for s in strips.column("_strip").to_pylist():
                columns = np.arange(s * width, (s + 1) * width)
                near = np.stack([nearest_columns(c[a:b], columns) for a, b in zip(first.tolist(), ends, strict=True)])
                for k in keys:
                    out[k].append(sources.column(k)[0])
                out["_strip"].append(s)
                out["_rows"].append(rows.tobytes())
                out["_columns"].append(near.tobytes())
        types = {"_strip": pa.int64(), "_rows": pa.binary(), "_columns": pa.binary()} | {k: sources.schema.field(k).type for k in keys}
        return pa.table({k: pa.array([x.as_py() if k in keys else x for x in v], types[k]) for k, v in out.items()})

    return run


def _down_columns(keys: list[str], width: int):
    def run(tiles: pa.Table, asked: pa.Table) -> pa.Table:
        r, c = (np.asarray(asked.column(x).to_numpy(), np.int64) for x in ("_r", "_c"))
        near_r = near_c = d2 = None
        if tiles.num_rows and len(r):
            rows = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in tiles.column("_rows").combine_chunks()])
            columns = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width) for x in tiles.column("_columns").combine_chunks()])
            by = np.argsort(rows)
            rows, columns = rows[by], columns[by]
            base = int(c[0]) // width * width
            kept, start, many = envelope(rows, columns - (base + np.arange(width)))
            near_r, near_c = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            order = np.argsort(c, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
                k = int(c[part[0]]) - base
                at = np.searchsorted(start[: many[k], k], r[part], side="left") - 1
                i = kept[np.maximum(at, 0), k]
                near_r[part], near_c[part] = rows[i], columns[i, k]
            d2 = (r - near_r) ** 2 + (c - near_c) ** 2
        found = [pa.nulls(len(r), pa.int64()) if x is None else pa.array(x) for x in (near_r, near_c, d2)]
        return pa.table([*(asked.column(k) for k in keys), pa.array(r), pa.array(c), *found], [*keys, "_r", "_c", "near_r", "near_c", "d2"])

    return run


def nearest_source(cells: DataFrame, sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, r, c of the distinct cells with near_r, near_c, the nearest source of the same keys, and d2, its squared distance.

    Cells and sources hold whole r and c; distances are exact whatever their size. Ties go to the smaller row, then the
    smaller column. Without a source the three are null. Rows with null keys or places are left out.
    """
    named = keys or []
    keys = [f"_k{i}" for i in range(len(named))] or ["_k"]

    def own(df: DataFrame) -> DataFrame:
        values = [F.col(k).alias(f"_k{i}") for i, k in enumerate(named)] or [F.lit(0).alias("_k")]
        return df.select(*values, F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c")).dropna().distinct()

    asked, given = own(cells), own(sources)
    low, high, top, bottom = given.agg(F.min("_c"), F.max("_c"), F.min("_r"), F.max("_r")).first()
    types = {f.name: f.dataType.simpleString() for f in asked.schema}
    if low is None:
        none = [F.lit(None).cast("long").alias(x) for x in ("near_r", "near_c", "d2")]
        return asked.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(named)), F.col("_r").alias("r"), F.col("_c").alias("c"), *none)
    band = max(1, CELLS // (high - low + 1))
    width = max(1, min(WIDTH, CELLS // (bottom - top + 1)))
    asked = asked.withColumn("_strip", F.floor(F.col("_c") / width).cast("long"))
    given = given.withColumn("_band", F.floor(F.col("_r") / band).cast("long"))
    tiles = given.select(*keys, "_band").distinct().join(asked.select(*keys, "_strip").distinct(), keys)
    tiles, asked = tiles.toDF(*tiles.columns), asked.toDF(*asked.columns)  # new columns, as each is grouped with its own source
    ship(cells.sparkSession)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    near = given.groupBy(*keys, "_band").cogroup(tiles.groupBy(*keys, "_band")).applyInArrow(_along_rows(keys, width), f"{schema}, _strip long, _rows binary, _columns binary")
    found = near.groupBy(*keys, "_strip").cogroup(asked.groupBy(*keys, "_strip")).applyInArrow(_down_columns(keys, width), f"{schema}, _r long, _c long, near_r long, near_c long, d2 long")
    return found.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(named)), F.col("_r").alias("r"), F.col("_c").alias("c"), "near_r", "near_c", "d2")

