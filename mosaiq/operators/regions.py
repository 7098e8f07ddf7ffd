"""Regions of cells: connected components, merging by mergeable statistics, seeded growing.

Components, growing and merging settle tiles by themselves (`tiles`); what is left are rounds of joins over tables that are
written between rounds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import tiles
from mosaiq.operators.order import quantiles
from mosaiq.sources.stage import stage

STEPS4 = ((0, 1), (1, 0))
STEPS8 = ((0, 1), (1, 0), (1, 1), (1, -1))


def neighbour_edges(cells: DataFrame, key: str, same: list[str], steps=STEPS4) -> DataFrame:
    """Edges (u, v), u < v by place, between neighbouring cells that agree in the columns `same`."""
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    sent = cells.select(F.col(key).alias("u"), *same, "r", "c", offsets.alias("o")).select("u", *same, (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"))
    return sent.join(cells.select(F.col(key).alias("v"), *same, "r", "c"), [*same, "r", "c"]).select("u", "v")


def connected(cells: DataFrame, same: list[str], steps=STEPS4) -> DataFrame:
    """cells (with a long `cell` key) and `region`, the smallest cell of their component.

    Tiles settle their own components in one pass; what is joined afterwards are the labels that meet at their borders.
    Cells with a null in `same` stand alone.
    """
    local = stage(tiles.local_components(cells, same, steps), "local-regions")
    border = tiles.tiled(cells.select("cell", "r", "c", *same)).where(tiles.on_border()).join(local, "cell")
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    sent = border.select("*", offsets.alias("_o")).select(F.col("region").alias("u"), *same, (F.col("r") + F.col("_o.a")).alias("r"), (F.col("c") + F.col("_o.b")).alias("c"), F.col("_tr").alias("_ur"), F.col("_tc").alias("_uc"))
    met = sent.join(border.select(F.col("region").alias("v"), *same, "r", "c", "_tr", "_tc"), [*same, "r", "c"]).where("_ur != _tr or _uc != _tc")
    joined = join_labels(met.select("u", "v").distinct())
    whole = local if joined is None else local.join(joined, "region", "left").select("cell", F.coalesce("to", "region").alias("region"))
    return cells.join(whole, "cell")


def _ends(pointers: DataFrame) -> DataFrame:
    """pointers (region, to) to the ends of their chains, in rounds that each follow twice as many."""
    while True:
        far = pointers.select(F.col("region").alias("to"), F.col("to").alias("far"))
        new = stage(pointers.join(far, "to", "left").select("region", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "jumps")
        pointers = new.drop("moved")
        if not new.where("moved").head(1):
            return pointers


def join_labels(edges: DataFrame) -> DataFrame | None:
    """region and to, the smallest label that it reaches over edges (u, v), of each that isn't its own; None without edges.

    Hook and jump: a label takes the least one next to it, then labels follow their own pointers to the end, so rounds grow
    with the logarithm of a component's width, roughly. A label with a pointer is in no edge afterwards, so it has one row.
    """
    edges, now = stage(edges.where("u != v"), "edges"), None
    while True:
        hooks = stage(edges.select(F.greatest("u", "v").alias("region"), F.least("u", "v").alias("to")).groupBy("region").agg(F.min("to").alias("to")), "hooks")
        if not hooks.head(1):
            return now
        jump = _ends(hooks)
        if now is not None:
            moved = now.join(jump.select(F.col("region").alias("to"), F.col("to").alias("_to")), "to", "left").select("region", F.coalesce("_to", "to").alias("to"))
            now = stage(moved.unionByName(jump), "labels")
        else:
            now = jump
        for side in ("u", "v"):
            edges = edges.join(jump.select(F.col("region").alias(side), F.col("to").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        edges = stage(edges.where("u != v").select("u", "v").distinct(), "edges")


def patches(cells: DataFrame, same: list[str], pixel: float = 1.0, least: int = 1) -> DataFrame:
    """The 8-connected patches of at least so many pixels: region, pixels, radius (equivalent, in metres)."""
    counted = connected(cells, same, STEPS8).groupBy("region").agg(F.count(F.lit(1)).alias("pixels")).where(F.col("pixels") >= least)
    return counted.withColumn("radius", F.sqrt(F.col("pixels") / math.pi) * pixel)


def patch_radii(cells: DataFrame, same: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of the equivalent radii of the 8-connected patches."""
    sizes = stage(patches(cells, same), "patches")
    found = quantiles(sizes, [], "radius", list(at)).select(*(F.get("q", F.lit(k)).alias(f"p{round(p * 100)}") for k, p in enumerate(at)))
    return sizes.agg(F.count(F.lit(1)).alias("patches")).join(found, how="left")  # one row each


def patch_scales(radii: DataFrame, at: tuple[float, ...], pixel: float, count: int, most: int = 30) -> DataFrame:
    """Scales from quantiles of patch radii (column radius, metres): index, spatialr, minsize.

    Equal quantiles count once; spatialr is the radius in pixels, halves to even, from 1 to `most`, minsize the pixels of
    a patch of that radius; the last scale is repeated up to `count` rows, and what is beyond them goes.
    """
    q = F.array_distinct(F.get(F.collect_list("q"), F.lit(0)))
    one = quantiles(radii, [], "radius", list(at)).agg(q.alias("q")).where(F.size("q") > 0)
    long = F.slice(F.concat("q", F.array_repeat(F.element_at("q", -1), count)), 1, count)
    rows = one.select(F.posexplode(long).alias("index", "radius"))
    size = lambda x, low: F.greatest(F.lit(low), F.rint(x).cast("int"))
    return rows.select("index", F.least(F.lit(most), size(F.col("radius") / pixel, 1)).alias("spatialr"), size(math.pi * F.col("radius") * F.col("radius") / (pixel * pixel), 1).alias("minsize"))


def region_statistics(cells: DataFrame, bands: tuple[str, ...], key: str = "region") -> DataFrame:
    """Count, sums of each band and of both places, and their summed squares: parts that merge by adding.

    n, {band}_1, square (of all bands), r_1, c_1, place (squares of both places).
    """
    value = lambda x: F.col(x).cast("double")
    return cells.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *(F.sum(value(b)).alias(f"{b}_1") for b in (*bands, "r", "c")),
        F.sum(reduce(lambda x, y: x + y, (value(b) * value(b) for b in bands))).alias("square"),
        F.sum(value("r") * value("r") + value("c") * value("c")).alias("place"),
    )


def _rms(parts: tuple[str, ...], squares: str, *sides: str):
    """Root mean square distance to the mean of the union of the regions at these aliases."""
    total = lambda x: reduce(lambda a, b: a + b, (F.col(f"{s}.{x}") for s in sides))
    sums = reduce(lambda a, b: a + b, (total(f"{p}_1") * total(f"{p}_1") for p in parts))
    return F.sqrt(F.greatest(F.lit(0.0), total(squares) - sums / total("n")) / total("n"))


def initial_regions(cells: DataFrame, bands: tuple[str, ...], block: int, limit: float) -> DataFrame:
    """4-connected pieces of block x block squares whose RMS is within the limit; their cells one by one otherwise."""
    own = cells.withColumns({"cell": F.col("r").cast("long") * 1_000_000_000 + F.col("c"), "_br": F.floor(F.col("r") / block), "_bc": F.floor(F.col("c") / block)})
    found = connected(own, ["_br", "_bc"]).drop("_br", "_bc")
    good = region_statistics(found, bands).alias("a").select("region", (_rms(bands, "square", "a") <= limit).alias("_good"))
    return found.join(good, "region").withColumn("region", F.when(F.col("_good"), F.col("region")).otherwise(F.col("cell"))).drop("_good")


def greedy_matching(edges: DataFrame, key: str) -> DataFrame | None:
    """The edges (x, y) that a pass in ascending order of `key` takes, no two of which share an end.

    The same set as the sequential pass, in rounds: an edge whose key is the least at both of its ends is taken, and the
    other edges at these ends go. Keys must differ. None without edges.
    """
    open_, taken = stage(edges.select("x", "y", key), "open-edges"), None
    while open_.head(1):
        ends = open_.select(F.explode(F.array("x", "y")).alias("e"), key).groupBy("e").agg(F.min(key).alias("best"))
        won = open_.join(ends.select(F.col("e").alias("x"), F.col("best").alias("bx")), "x").join(ends.select(F.col("e").alias("y"), F.col("best").alias("by")), "y")
        won = stage(won.where((F.col(key) == F.col("bx")) & (F.col(key) == F.col("by"))).select("x", "y"), "taken-edges")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("x", "y")).alias("e"))
        open_ = stage(open_.join(used.select(F.col("e").alias("x")), "x", "left_anti").join(used.select(F.col("e").alias("y")), "y", "left_anti"), "open-edges")
    return taken


#: Rows and columns around a tile that merging looks at; doubled where they don't do for a round, up to the second figure.
MERGE_HALO, MOST_HALO = 64, 512


def merge_regions(cells: DataFrame, bands: tuple[str, ...], limit: float, spatial_limit: float | None = None) -> DataFrame:
    """cells (cell, r, c, bands, region) with neighbouring regions merged, round by round.

    A round prices every pair of neighbours by the regions as they are: the greater of its union's RMS over the limit
    and, if there is a spatial limit, of its spatial RMS over that. Pairs within the limits are matched greedily, the
    cheapest first, then by the smaller first and second region; the matched pairs merge under the smaller region. Ends
    when no pair is left within the limits.

    Tiles with a halo take many rounds in one pass (`tiles.local_merges`), each as many as it is sure of; the least such
    number holds for all, and the next pass goes on from there. What they can't settle, because regions or chains of
    choices are wider than the greatest halo or a band has nulls, goes by rounds of joins.
    """
    top, bottom, left, right, odd = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.count_if(reduce(lambda a, b: a | b, (F.col(b).isNull() | F.isnan(F.col(b).cast("double")) for b in bands)))).first()
    if top is None:
        return cells
    if odd:
        return _merge_by_joins(cells, bands, limit, spatial_limit)
    now, halo = stage(cells.select("r", "c", *bands, "region", "cell"), "merging"), MERGE_HALO
    while halo <= MOST_HALO:
        sizes = now.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
        found = stage(tiles.local_merges(now.join(sizes, "region"), bands, limit, spatial_limit, (top, bottom, left, right), halo), "merges")
        sure = found.where("region is null").agg(F.min("round")).first()[0]  # a row a tile
        if not sure:
            halo *= 2
            continue
        moves = found.where((F.col("region").isNotNull()) & (F.col("round") <= sure))
        last = moves.agg(F.max("round")).first()[0]
        if last is not None:
            to = moves.groupBy("region").agg(F.max_by("to", "round").alias("_to"))
            now = stage(now.join(to, "region", "left").withColumn("region", F.coalesce("_to", "region")).drop("_to"), "merging")
        if last is None or last < sure:  # a round in which nothing merged
            return cells.drop("region").join(now.select("cell", "region"), "cell")
    return cells.drop("region").join(_merge_by_joins(now, bands, limit, spatial_limit).select("cell", "region"), "cell")


def _merge_by_joins(cells: DataFrame, bands: tuple[str, ...], limit: float, spatial_limit: float | None) -> DataFrame:
    """merge_regions by joins: a row a region and an edge a pair in each round, cells only at the end."""
    of = cells.select("cell", "region")
    adjacent = neighbour_edges(cells, "cell", [])
    ends = adjacent.join(of.withColumnsRenamed({"cell": "u", "region": "ru"}), "u").join(of.withColumnsRenamed({"cell": "v", "region": "rv"}), "v")
    edges = stage(ends.where("ru != rv").select(F.least("ru", "rv").alias("x"), F.greatest("ru", "rv").alias("y")).distinct(), "edges")
    stats = stage(region_statistics(cells, bands), "statistics")
    now = stage(cells.select("region").distinct().withColumn("to", F.col("region")), "pointers")
    while True:
        priced = edges.join(stats.alias("a"), F.col("x") == F.col("a.region")).join(stats.alias("b"), F.col("y") == F.col("b.region"))
        rms, spatial = _rms(bands, "square", "a", "b"), _rms(("r", "c"), "place", "a", "b")
        priced = priced.select("x", "y", rms.alias("rms"), spatial.alias("spatial"))
        cost = F.col("rms") / limit
        good = F.col("rms") <= limit
        if spatial_limit is not None:
            cost, good = F.greatest(cost, F.col("spatial") / spatial_limit), good & (F.col("spatial") <= spatial_limit)
        won = greedy_matching(priced.where(good).select("x", "y", F.struct(cost.alias("cost"), "x", "y").alias("k")), "k")
        if won is None:
            break
        move = won.select(F.col("y").alias("region"), F.col("x").alias("_to"))
        now = stage(now.join(move.withColumnRenamed("region", "to"), "to", "left").select("region", F.coalesce("_to", "to").alias("to")), "pointers")
        sums = [c for c in stats.columns if c != "region"]
        stats = stage(stats.join(move, "region", "left").withColumn("region", F.coalesce("_to", "region")).groupBy("region").agg(*(F.sum(c).alias(c) for c in sums)), "statistics")
        for side in ("x", "y"):
            edges = edges.join(move.withColumnRenamed("region", side), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        edges = stage(edges.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    return cells.join(now, "region").drop("region").withColumnRenamed("to", "region")


def merge_in_window(cells: DataFrame, bands: tuple[str, ...], block: int, limit: float, spatial_limit: float | None, top: int, left: int, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Initial regions and their merging inside a window of the grid: the labelled cells, and a report of one row.

    The report: cells, initial_regions, final_regions and the greatest RMS of a final region.
    """
    inside = cells.where((F.col("r") >= top) & (F.col("r") < top + height) & (F.col("c") >= left) & (F.col("c") < left + width))
    first = stage(initial_regions(inside, bands, block, limit), "initial")
    merged = stage(merge_regions(first, bands, limit, spatial_limit), "merged")
    before = first.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("region").alias("initial_regions"))
    after = region_statistics(merged, bands).alias("a").agg(F.count(F.lit(1)).alias("final_regions"), F.max(_rms(bands, "square", "a")).alias("greatest_rms"))
    return merged, before.join(after)  # one row each


def _follow(pointers: DataFrame) -> DataFrame:
    """comp, to, label at the ends of chains of comp -> to; a chain ends where label is known or nothing follows."""
    while True:
        far = pointers.select(F.col("comp").alias("to"), F.col("to").alias("_to"), F.col("label").alias("_label"))
        moved = pointers.join(far, "to", "left").select("comp", F.when(F.col("label").isNull(), F.coalesce("_to", "to")).otherwise(F.col("to")).alias("to"), F.coalesce("label", "_label").alias("label"), (F.col("label").isNull() & F.col("_to").isNotNull()).alias("_moved"))
        moved = stage(moved, "pointers")
        pointers = moved.drop("_moved")
        if not moved.where("_moved").head(1):
            return pointers


def grow_regions(cells: DataFrame, seeds: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """cells with `label`: the seed that reaches them first over 4-neighbours, in order of priority; null if none does.

    Of all edges between a labelled and a free cell the one of least squared distance in feature space is taken next, then
    that of the smaller cell, then of the smaller other one, in row order, until none is left. That is a spanning forest
    with the seeds as roots, so no queue is needed: a component without a seed takes its first edge, whatever others do.
    Tiles take all such steps that end inside them; the components left are joined in rounds that grow with the logarithm
    of their number. Seeds: rank, r, c; the smallest rank of a cell counts. Edges to a cell with a null band are not taken.
    """
    keyed = cells.withColumn("cell", F.col("r").cast("long") * 1_000_000_000 + F.col("c"))
    own = seeds.groupBy("r", "c").agg(F.min("rank").cast("long").alias("label"))
    local = stage(tiles.local_forest(keyed.join(own, ["r", "c"], "left"), bands), "forest")
    of = local.where("kind = 0").select("cell", "comp", "label")
    crossing = local.where("kind = 2").drop("other_comp", "other_label").join(of.select(F.col("cell").alias("other"), F.col("comp").alias("other_comp"), F.col("label").alias("other_label")), "other")
    edges = local.where("kind = 1").unionByName(crossing)
    order = F.struct("w", F.least("cell", "other").alias("u"), F.greatest("cell", "other").alias("v"))
    edges = edges.select(order.alias("k"), F.col("comp").alias("a"), F.col("label").alias("la"), F.col("other_comp").alias("b"), F.col("other_label").alias("lb"))
    found = None
    while True:
        edges = stage(edges.where("a != b and (la is null or lb is null)"), "open-edges")
        turned = edges.select("k", F.col("b").alias("a"), F.col("lb").alias("la"), F.col("a").alias("b"), F.col("la").alias("lb"))
        first = edges.unionByName(turned).where("la is null").groupBy("a").agg(F.min(F.struct("k", "b", "lb")).alias("m")).select(F.col("a").alias("comp"), F.col("m.b").alias("to"), F.col("m.lb").alias("label"))
        first = stage(first, "first-edges")
        if not first.head(1):
            break
        pairs = first.select(F.col("to").alias("comp"), F.col("comp").alias("to")).where("comp < to")
        taken = _follow(first.join(pairs, ["comp", "to"], "left_anti"))  # of two that take each other the smaller one ends the chain
        if found is not None:
            met = found.join(taken.select(F.col("comp").alias("to"), F.col("to").alias("_to"), F.col("label").alias("_label")), "to", "left")
            found = met.select("comp", F.when(F.col("label").isNull(), F.coalesce("_to", "to")).otherwise(F.col("to")).alias("to"), F.coalesce("label", "_label").alias("label")).unionByName(taken)
        else:
            found = taken
        found = stage(found, "found")
        for side, known in (("a", "la"), ("b", "lb")):
            move = taken.select(F.col("comp").alias(side), F.col("to").alias("_to"), F.col("label").alias("_label"))
            edges = edges.join(move, side, "left").withColumns({side: F.coalesce("_to", side), known: F.coalesce(known, "_label")}).drop("_to", "_label")
    if found is not None:
        of = of.join(found.select("comp", F.col("label").alias("_label")), "comp", "left").select("cell", F.coalesce("label", "_label").alias("label"))
    return keyed.join(of.select("cell", "label"), "cell", "left").drop("cell")
