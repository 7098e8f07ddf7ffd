"""Square tiles of a grid, each worked on in one Arrow pass: local components, steps of a spanning forest, rounds of merging.

What lies inside a tile is settled there with arrays; only what touches its border is left for joins between tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.session import ship

#: Rows and columns of a tile.
SIDE = 256


def tiled(cells: DataFrame, side: int | None = None) -> DataFrame:
    """cells with _tr and _tc, the row and column of their tile."""
    side = side or SIDE
    return cells.withColumns({"_tr": F.floor(F.col("r") / side).cast("long"), "_tc": F.floor(F.col("c") / side).cast("long")})


def on_border(side: int | None = None):
    """Whether a cell is in the first or last row or column of its tile."""
    side = side or SIDE
    r, c = F.pmod(F.col("r").cast("long"), F.lit(side)), F.pmod(F.col("c").cast("long"), F.lit(side))
    return (r == 0) | (r == side - 1) | (c == 0) | (c == side - 1)


def follow(pointers: np.ndarray) -> np.ndarray:
    """Pointers to the ends of their chains; an end points to itself."""
    while True:
        far = pointers[pointers]
        if (far == pointers).all():
            return far
        pointers = far


def places(r: np.ndarray, c: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices of cells one of steps apart."""
    if not len(r):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    r, c = r - r.min() + 1, c - c.min() + 1
    at = np.full((r.max() + 2, c.max() + 2), -1)
    at[r, c] = np.arange(len(r))
    found = [(np.arange(len(r)), at[r + a, c + b]) for a, b in steps]
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return u[v >= 0], v[v >= 0]


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each one's component under the edges u, v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        hook = np.arange(n)
        np.minimum.at(hook, np.maximum(a, b), np.minimum(a, b))
        label = follow(hook)[label]


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each combination of values; -1 where one is null."""
    codes = np.zeros(table.num_rows, np.int64)
    for name in names:
        column = table.column(name).combine_chunks().dictionary_encode()
        part = column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(np.where((part < 0) | (codes < 0), -1, codes * (len(column.dictionary) + 1) + part), return_inverse=True)[1] - int(((part < 0) | (codes < 0)).any())
    return codes


def _components(same: list[str], steps):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cell, r, c = (np.asarray(table.column(x).to_numpy(), np.int64) for x in ("cell", "r", "c"))
        code = _codes(table, same)
        u, v = places(r, c, steps)
        alike = (code[u] == code[v]) & (code[u] >= 0)
        label = least_labels(len(cell), u[alike], v[alike])
        return pa.table([pa.array(cell), pa.array(cell[label])], ["cell", "region"])

    return run


def local_components(cells: DataFrame, same: list[str], steps) -> DataFrame:
    """cell and region, the least cell of its component inside its tile, of cells (cell, r, c, same)."""
    ship(cells.sparkSession)
    own = tiled(cells.select("cell", "r", "c", *same))
    return own.groupBy("_tr", "_tc").applyInArrow(_components(same, steps), "cell long, region long")


def contract(n: int, rooted: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Representative of each of n cells after all steps of a spanning forest that a tile can take by itself.

    u and v: ends of edges in ascending order; v of n or more lies in another tile. rooted: cells in a component that has
    a root. A component without one takes its first edge; the step is made if the edge ends inside the tile.
    """
    comp, rooted = np.arange(n), rooted.copy()
    while True:
        a, b = comp[u], np.where(v < n, comp[np.minimum(v, n - 1)], -1)
        alive = a != b
        u, v, a, b = u[alive], v[alive], a[alive], b[alive]
        first = np.full(n, len(u))
        place = np.arange(len(u))
        np.minimum.at(first, a, place)
        np.minimum.at(first, b[b >= 0], place[b >= 0])
        own = np.flatnonzero((first < len(u)) & ~rooted & (comp == np.arange(n)))
        e = first[own]
        own, e = own[b[e] >= 0], e[b[e] >= 0]
        if not len(own):
            return comp
        pointer = np.arange(n)
        pointer[own] = np.where(a[e] == own, b[e], a[e])
        back = pointer[pointer] == np.arange(n)
        pointer[back & (np.arange(n) < pointer)] = np.flatnonzero(back & (np.arange(n) < pointer))
        comp = follow(pointer)[comp]


def _forest(bands: tuple[str, ...]):
    names = ["kind", "cell", "comp", "label", "other", "other_comp", "other_label", "w"]

    def run(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("_own").to_numpy(zero_copy_only=False), bool)
        cell = np.asarray(table.column("cell").to_numpy(), np.int64)
        order = np.lexsort((cell, ~own))
        table, own, cell = table.take(pa.array(order)), own[order], cell[order]
        r, c = (np.asarray(table.column(x).to_numpy(), np.int64) for x in ("r", "c"))
        x = np.stack([np.asarray(table.column(b).to_numpy(zero_copy_only=False), np.float64) for b in bands], axis=1)
        label = table.column("label").combine_chunks()
        has = label.is_valid().to_numpy(zero_copy_only=False)
        label = label.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = int(own.sum())
        u, v = places(r, c, ((0, 1), (1, 0)))
        u, v = np.minimum(u, v), np.maximum(u, v)
        u, v = u[u < n], v[u < n]
        w = ((x[u] - x[v]) ** 2).sum(axis=1)
        known = ~np.isnan(w)
        u, v, w = u[known], v[known], w[known]
        by = np.lexsort((np.maximum(cell[u], cell[v]), np.minimum(cell[u], cell[v]), w))
        u, v, w = u[by], v[by], w[by]
        comp = contract(n, has[:n], u, v)
        rooted = np.zeros(n, bool)
        owner = np.zeros(n, np.int64)
        rooted[comp[has[:n]]] = True
        owner[comp[has[:n]]] = label[:n][has[:n]]
        name = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(name, comp, cell[:n])
        comp_of, root_of, label_of = name[comp], rooted[comp], owner[comp]
        inside = v < n
        left = np.where(inside, (comp[u] != comp[np.minimum(v, n - 1)]) & ~(root_of[u] & root_of[np.minimum(v, n - 1)]), cell[u] < cell[v])
        u, v, w, inside = u[left], v[left], w[left], inside[left]
        at = np.minimum(v, n - 1)
        none = lambda k: pa.nulls(k, pa.int64())
        cells = [pa.array(np.zeros(n, np.int32)), pa.array(cell[:n]), pa.array(comp_of), pa.array(label_of, mask=~root_of), none(n), none(n), none(n), pa.nulls(n, pa.float64())]
        edges = [pa.array(np.where(inside, 1, 2).astype(np.int32)), pa.array(cell[u]), pa.array(comp_of[u]), pa.array(label_of[u], mask=~root_of[u]), pa.array(cell[v]), pa.array(comp_of[at], mask=~inside), pa.array(label_of[at], mask=~(inside & root_of[at])), pa.array(w)]
        return pa.table([pa.concat_arrays(x) for x in zip(cells, edges, strict=True)], names)

    return run


def local_forest(cells: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """One table for cells (cell, r, c, bands, label, null where no seed is) after the steps that tiles take alone.

    Rows of kind 0: cell, comp (its least cell), label. Kind 1: an edge that is left inside a tile between cell and other,
    with both comps and labels, and its weight w. Kind 2: an edge to another tile, whose other side is known there.
    """
    ship(cells.sparkSession)
    own = tiled(cells.select("cell", "r", "c", *bands, "label"))
    move = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))))
    side = SIDE
    next_to = lambda x, d: F.floor((F.col(x) + F.col(f"_o.{d}")) / side).cast("long")
    halo = own.where(on_border()).select("*", move.alias("_o")).select("cell", "r", "c", *bands, "label", next_to("r", "a").alias("_nr"), next_to("c", "b").alias("_nc"), "_tr", "_tc")
    halo = halo.where("_nr != _tr or _nc != _tc").select("cell", "r", "c", *bands, F.lit(None).cast("long").alias("label"), F.col("_nr").alias("_tr"), F.col("_nc").alias("_tc"), F.lit(False).alias("_own"))
    both = own.withColumn("_own", F.lit(True)).unionByName(halo)
    return both.groupBy("_tr", "_tc").applyInArrow(_forest(bands), "kind int, cell long, comp long, label long, other long, other_comp long, other_label long, w double")


def sure_matching(n: int, u: np.ndarray, v: np.ndarray, exposed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a greedy pass over edges u, v in their order takes, as far as it is sure: places of taken edges, vertices in doubt.

    exposed: vertices that may have other edges, of any rank. An edge is taken if all before it at its ends aren't; it is
    not taken if one before it is. The rest, and what hangs on it, is in doubt.
    """
    place, taken = np.arange(len(u)), []
    while True:
        first = np.full(n, len(exposed) + len(u) + 1)
        np.minimum.at(first, u[place], place)
        np.minimum.at(first, v[place], place)
        won = place[(first[u[place]] == place) & (first[v[place]] == place) & ~exposed[u[place]] & ~exposed[v[place]]]
        if not len(won):
            break
        taken.append(won)
        gone = np.zeros(n, bool)
        gone[u[won]] = gone[v[won]] = True
        place = place[~gone[u[place]] & ~gone[v[place]]]
    won = np.concatenate(taken) if taken else np.empty(0, np.int64)
    doubt = exposed.copy()
    doubt[u[place]] = doubt[v[place]] = True
    return won, doubt


def _merging(bands: tuple[str, ...], limit: float, spatial_limit: float | None, bounds: tuple[int, int, int, int], halo: int, side: int):
    top, bottom, left, right = bounds

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("_tr")[0].as_py(), table.column("_tc")[0].as_py()
        r, c, size = (np.asarray(table.column(x).to_numpy(), np.int64) for x in ("r", "c", "_n"))
        names, own = np.unique(table.column("region").to_numpy(), return_inverse=True)
        x = [np.asarray(table.column(b).to_numpy(), np.float64) for b in bands]
        m = len(names)
        total = lambda values: np.bincount(own, values, m)
        y, z = r.astype(np.float64), c.astype(np.float64)
        # rows: n, bands, squares of bands, r, c, squares of places
        sums = np.stack([total(np.ones(len(r))), *(total(b) for b in x), total(sum(b * b for b in x)), total(y), total(z), total(y * y + z * z)])
        k = len(bands)
        # in doubt from the start: what isn't whole in here, or has neighbours outside
        edge = (r == tr * side - halo) & (r > top) | (r == (tr + 1) * side + halo - 1) & (r < bottom) | (c == tc * side - halo) & (c > left) | (c == (tc + 1) * side + halo - 1) & (c < right)
        doubt = np.zeros(m, bool)
        doubt[own[edge]] = True
        whole = np.zeros(m, np.int64)
        whole[own] = size
        doubt |= sums[0] < whole
        core = (r // side == tr) & (c // side == tc)
        anchor = np.full(m, len(r))
        by = np.lexsort((c, r))
        np.minimum.at(anchor, own[by], np.arange(len(r)))
        mine = core[by][anchor]  # regions whose first cell lies in the tile
        inside = np.zeros(m, bool)
        inside[own[core]] = True
        mine |= doubt & inside
        u, v = places(r, c, ((0, 1), (1, 0)))
        pair = np.unique(np.minimum(own[u], own[v]) * m + np.maximum(own[u], own[v]))
        u, v = pair // m, pair % m
        u, v = u[u != v], v[u != v]
        root, now, out = np.arange(m), 0, []
        least = np.iinfo(np.int32).max

        def rms(both: np.ndarray, parts: range, squares: int) -> np.ndarray:
            means = sum(both[p] * both[p] for p in parts) / both[0]
            return np.sqrt(np.maximum(0.0, both[squares] - means) / both[0])

        while not (doubt[root] & mine).any():
            sure = now
            a, b = doubt[u], doubt[v]
            exposed = np.zeros(m, bool)
            exposed[u[b & ~a]] = exposed[v[a & ~b]] = True
            u, v = u[~(a & b)], v[~(a & b)]
            known = ~doubt[u] & ~doubt[v]
            p, q = u[known], v[known]
            both = sums[:, p] + sums[:, q]
            value = rms(both, range(1, k + 1), k + 1)
            cost, good = value / limit, value <= limit
            if spatial_limit is not None:
                value = rms(both, range(k + 2, k + 4), k + 4)
                cost, good = np.maximum(cost, value / spatial_limit), good & (value <= spatial_limit)
            p, q, cost = p[good], q[good], cost[good]
            if not len(p) and not exposed.any():
                sure = least
                break
            order = np.lexsort((q, p, cost))
            p, q = p[order], q[order]
            won, next_doubt = sure_matching(m, p, q, exposed)
            doubt |= next_doubt
            now += 1
            move = np.arange(m)
            move[q[won]] = p[won]
            sums[:, p[won]] += sums[:, q[won]]
            moved = (move[root] != root) & mine
            root = move[root]
            out.append((np.flatnonzero(moved), now, root[moved]))
            pair = np.unique(np.minimum(move[u], move[v]) * m + np.maximum(move[u], move[v]))
            u, v = pair // m, pair % m
            u, v = u[u != v], v[u != v]
        else:
            sure = now - 1 if now else 0
        out = [x for x in out if x[1] <= sure]
        at, to = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in (0, 2))
        rounds = np.concatenate([np.full(len(x[0]), x[1]) for x in out]) if out else np.empty(0, np.int64)
        region = pa.concat_arrays([pa.array(names[at].astype(np.int64)), pa.nulls(1, pa.int64())])
        return pa.table([region, pa.array(np.append(rounds, sure).astype(np.int32)), pa.concat_arrays([pa.array(names[to].astype(np.int64)), pa.nulls(1, pa.int64())])], ["region", "round", "to"])

    return run


def local_merges(cells: DataFrame, bands: tuple[str, ...], limit: float, spatial_limit: float | None, bounds: tuple[int, int, int, int], halo: int) -> DataFrame:
    """Rounds of merging (`regions.merge_regions`) that tiles are sure of, for cells (r, c, bands, region, _n, the region's cells).

    A tile sees its cells and those up to `halo` around them. Regions that reach beyond are in doubt; each round what
    they could touch is in doubt as well. bounds: least and greatest r and c of all cells. Rows: region, round and to, the
    region that it belongs to after this round, where that changes, from the tile with the region's first cell; and for
    each tile one without a region, with the number of rounds that it is sure of.
    """
    ship(cells.sparkSession)
    side = SIDE
    top, bottom, left, right = (x // side for x in bounds)
    tile = lambda x: F.floor(x / side).cast("long")
    reach = lambda x, low, high: F.explode(F.sequence(F.greatest(F.lit(low), tile(F.col(x) - halo)), F.least(F.lit(high), tile(F.col(x) + halo))))
    sent = cells.select("r", "c", *bands, "region", "_n").select("*", reach("r", top, bottom).alias("_tr")).select("*", reach("c", left, right).alias("_tc"))
    return sent.groupBy("_tr", "_tc").applyInArrow(_merging(bands, limit, spatial_limit, bounds, halo, side), "region long, round int, to long")
