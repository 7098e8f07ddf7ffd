"""Polygons of labelled cells: directed border edges, rings traced inside tiles, joined across them by pointer jumping.

A border edge is a side of a cell whose other side has another label or none. It runs clockwise around its cell (rows grow
downwards), and its successor follows from the labels around its end alone: the next side of the same cell, the same side
of the next cell, or a side of the cell diagonally ahead. So parts that only touch at a corner are parts of their own.
Chains that begin and end at a tile's border are put together afterwards, a row a chain. A ring's signed area tells outer
rings from holes; a polygon is the rings of one 4-connected part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import regions, tiles
from mosaiq.session import ship
from mosaiq.sources.stage import stage

#: Keys of cells leave so much room for a column.
ROW = 1 << 31
# sides of a cell: steps to its neighbour there and to the cell that the side runs towards, and its first corner
_OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])
_AHEAD = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
_CORNER = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])


def trace(r: np.ndarray, c: np.ndarray, label: np.ndarray, own: np.ndarray) -> list[tuple]:
    """Rings and chains of the border edges of own cells: (label index, cell index, closed, edge, next edge, points).

    Cells that aren't own are the halo. An edge is named ((r * ROW + c) * 4 + side); points are corners as (row, column),
    without those where the direction doesn't change inside the chain.
    """
    if not own.any():
        return []
    top, left = r.min() - 1, c.min() - 1
    at = np.full((r.max() - top + 2, c.max() - left + 2), -1)
    at[r - top, c - left] = np.arange(len(r))
    cells = np.flatnonzero(own)

    def neighbour(i: np.ndarray, step: np.ndarray) -> np.ndarray:
        return at[r[i] - top + step[:, 0], c[i] - left + step[:, 1]]

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (j >= 0) & (label[np.maximum(j, 0)] == label[i])

    i, side = np.repeat(cells, 4), np.tile(np.arange(4), len(cells))
    border = ~same(i, neighbour(i, _OUT[side]))
    i, side = i[border], side[border]
    ahead, corner = neighbour(i, _AHEAD[side]), neighbour(i, _AHEAD[side] + _OUT[side])
    go, turn = same(i, ahead), same(i, ahead) & same(i, corner)
    to = np.where(turn, corner, np.where(go, ahead, i))
    to_side = np.where(turn, (side + 3) % 4, np.where(go, side, (side + 1) % 4))
    name = (r[i] * ROW + c[i]) * 4 + side
    next_name = (r[to] * ROW + c[to]) * 4 + to_side
    order = np.argsort(name)
    place = np.minimum(np.searchsorted(name[order], next_name), len(name) - 1)
    follows = np.where(own[to] & (name[order][place] == next_name), order[place], -1)
    led = np.zeros(len(name), bool)
    led[follows[follows >= 0]] = True
    points = np.stack([r[i], c[i]], axis=1) + _CORNER[side]
    follow, sides, corners = follows.tolist(), side.tolist(), points.tolist()
    seen = [False] * len(follow)
    out = []
    for closed, starts in ((False, np.flatnonzero(~led)), (True, np.argsort(name))):
        for s in starts.tolist():
            if seen[s]:
                continue
            path, e = [], s
            while e >= 0 and not seen[e]:
                seen[e] = True
                path.append(e)
                e = follow[e]
            turns = [e for k, e in enumerate(path) if sides[path[k - 1]] != sides[e] or (not closed and k == 0)]
            out.append((int(i[s]), closed, int(name[s]), int(next_name[path[-1]]), [x for e in turns for x in corners[e]]))
    return out


def _traced(table: pa.Table) -> pa.Table:
    r, c, label = (np.asarray(table.column(x).to_numpy(), np.int64) for x in ("r", "c", "label"))
    own = np.asarray(table.column("_own").to_numpy(zero_copy_only=False), bool)
    found = trace(r, c, label, own)
    cell, closed, first, after, points = zip(*found, strict=True) if found else ((),) * 5
    at = np.array(cell, np.int64)
    return pa.table(
        [pa.array(label[at]), pa.array(r[at] * ROW + c[at]), pa.array(closed, pa.bool_()), pa.array(first, pa.int64()), pa.array(after, pa.int64()), pa.array(points, pa.list_(pa.int64()))],
        ["label", "cell", "closed", "edge", "after", "points"],
    )


def _closed_chains(chains: DataFrame) -> DataFrame:
    """label, cell, points of the rings that chains (edge, after, points) make: the least edge of a ring is its head."""
    chains = stage(chains, "chains")
    links = stage(chains.select("edge", F.col("after").alias("to"), F.col("edge").alias("head")), "links")
    while True:  # the least edge ahead, over twice as many chains each time
        far = links.select(F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("head").alias("_head"))
        new = links.join(far, "to").select("edge", F.col("_to").alias("to"), F.least("head", "_head").alias("head"), (F.col("_head") < F.col("head")).alias("moved"))
        new = stage(new, "links")
        links = new.drop("moved")
        if not new.where("moved").head(1):
            break
    heads = links.select("edge", "head")
    is_head = F.col("edge") == F.col("head")
    left = chains.select("edge", "after").join(heads, "edge").select("edge", "head", F.when(is_head, F.col("edge")).otherwise(F.col("after")).alias("to"), F.when(is_head, 0).otherwise(1).cast("long").alias("left"))
    left = stage(left, "steps")
    while True:  # chains left to the head, which stands still
        far = left.select(F.col("edge").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        new = stage(left.join(far, "to").select("edge", "head", F.col("_to").alias("to"), (F.col("left") + F.col("_left")).alias("left"), (F.col("_left") > 0).alias("moved")), "steps")
        left = new.drop("moved")
        if not new.where("moved").head(1):
            break
    own = chains.join(left.select("edge", "head", "left"), "edge")
    place = F.when(F.col("left") == 0, F.lit(0)).otherwise(F.lit(1 << 62) - F.col("left"))  # the head, then from the farthest on
    ring = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "points"))), lambda x: x["points"]))
    return own.groupBy("head").agg(F.first("label").alias("label"), F.min("cell").alias("cell"), ring.alias("points"))


def _measured(batches):
    """label, cell, area (positive for outer rings), points without those in the middle of a side."""
    for b in batches:
        areas, rings = [], []
        for flat in b.column("points"):
            p = np.asarray(flat.values.to_numpy(), np.int64).reshape(-1, 2)
            step = np.sign(np.roll(p, -1, axis=0) - p)
            p = p[(step != np.roll(step, 1, axis=0)).any(axis=1)]
            q = np.roll(p, -1, axis=0)
            areas.append(int((p[:, 1] * q[:, 0] - q[:, 1] * p[:, 0]).sum()) // 2)
            rings.append(p.reshape(-1))
        yield pa.RecordBatch.from_arrays([b.column("label"), b.column("cell"), pa.array(areas, pa.int64()), pa.array(rings, pa.list_(pa.int64()))], ["label", "cell", "area", "points"])


def rings(labels: DataFrame) -> DataFrame:
    """label, cell (one of the ring's), area and points (row, column, row, ...) of all border rings of cells (r, c, label).

    area is positive for outer rings and negative for holes, in cells. Cells with a null label or place don't count; a
    cell has one label.
    """
    ship(labels.sparkSession)
    own = labels.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("label").cast("long").alias("label")).dropna()
    move = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
    placed = tiles.tiled(own)
    next_to = lambda x, d: F.floor((F.col(x) + F.col(f"_o.{d}")) / tiles.SIDE).cast("long")
    halo = placed.where(tiles.on_border()).select("*", move.alias("_o")).select("r", "c", "label", "_tr", "_tc", next_to("r", "a").alias("_nr"), next_to("c", "b").alias("_nc"))
    halo = halo.where("_nr != _tr or _nc != _tc").select("r", "c", "label", F.col("_nr").alias("_tr"), F.col("_nc").alias("_tc"), F.lit(False).alias("_own")).distinct()
    both = placed.withColumn("_own", F.lit(True)).unionByName(halo)
    found = stage(both.groupBy("_tr", "_tc").applyInArrow(_traced, "label long, cell long, closed boolean, edge long, after long, points array<bigint>"), "traced")
    whole = found.where("closed").select("label", "cell", "points")
    open_ = found.where("not closed")
    if open_.head(1):
        whole = whole.unionByName(_closed_chains(open_.drop("closed")).select("label", "cell", "points"))
    return whole.mapInArrow(_measured, "label long, cell long, area long, points array<bigint>")


def _ring_text(points) -> F.Column:
    """(x y, x y, ...) closed; x is the column, y the row."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(points) - 1, F.lit(2)), lambda k: F.concat_ws(" ", F.get(points, k + 1).cast("string"), F.get(points, k).cast("string")))
    return F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(", "), F.get(pairs, F.lit(0)), F.lit(")"))


def polygons(labels: DataFrame) -> DataFrame:
    """Per label of cells (r, c, label): parts, holes, area and perimeter in cells, and wkt, a MULTIPOLYGON.

    A part is a 4-connected piece of a label with its holes; parts are ordered by their first cell, holes by theirs.
    """
    own = labels.select("r", "c", F.col("label").cast("long").alias("label")).dropna()
    pieces = regions.connected(own.withColumn("cell", F.col("r").cast("long") * ROW + F.col("c").cast("long")), ["label"]).select("cell", "region")
    placed = stage(rings(labels).join(pieces, "cell"), "rings")
    points = F.col("points")
    length = F.aggregate(
        F.sequence(F.lit(0), F.size(points) - 1, F.lit(2)),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.abs(F.get(points, k) - F.get(points, F.pmod(k + 2, F.size(points)))) + F.abs(F.get(points, k + 1) - F.get(points, F.pmod(k + 3, F.size(points)))),
    )
    texts = placed.select("label", "region", "cell", "area", length.alias("length"), _ring_text(points).alias("ring"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "cell", "ring"))), lambda x: x["ring"]), ", ")
    parts = texts.groupBy("label", "region").agg(F.concat(F.lit("("), joined, F.lit(")")).alias("text"), F.sum("area").alias("area"), F.sum("length").alias("length"), F.count_if(F.col("area") < 0).alias("holes"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "text"))), lambda x: x["text"]), ", ")
    return parts.groupBy("label").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("holes").alias("holes"),
        F.sum("area").alias("area"),
        F.sum("length").alias("perimeter"),
        F.concat(F.lit("MULTIPOLYGON ("), whole, F.lit(")")).alias("wkt"),
    )


def stacked(labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Grids of several runs as one grid, below each other with a free row between: r, c, label; and the table that
    tells them apart again: label, key, own (the label in its run), shift (rows above it)."""
    height = (labels.agg(F.max("r")).first()[0] or 0) + 2
    runs = labels.select(key).distinct().orderBy(key)  # a row a run
    order = {r[key]: k for k, r in enumerate(runs.collect())}
    index = F.broadcast(labels.sparkSession.createDataFrame([(k, v * height) for k, v in order.items()], f"{key} {dict(labels.dtypes)[key]}, shift long"))
    own = labels.join(index, key).where(F.col("label") > 0)
    numbers = stage(own.select(key, "shift", F.col("label").alias("own")).distinct().withColumn("label", F.monotonically_increasing_id()), "numbers")
    cells = own.select(key, "r", "c", "shift", F.col("label").alias("own")).join(numbers.drop("shift"), [key, "own"])
    return cells.select((F.col("r") + F.col("shift")).cast("long").alias("r"), F.col("c").cast("long").alias("c"), "label"), numbers
