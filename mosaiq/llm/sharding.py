"""Sharding by balanced label propagation.

Links join documents of one group (equal texts, by default). A group's documents in one shard are one cell
(group, shard, n): they have the same neighbours, so they take the same step, and the work is on cells. In even rounds
a group's cells wish for its heaviest shard, in odd ones for its heaviest shard with quota left. They move there, whole
or in part, as far as wishes the other way make room (swaps) and the target's quota of linked documents goes, the
largest gains first. No cell moves to a lighter one, so the sum of n * n grows with each move; rounds end once all groups
are whole, or once IDLE of them in a row have moved nothing (two, if no group has a tie to fall anew). Documents without links are filler: they take the places that are left, so shard
counts end at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import chunk_count, discard, hot_keys, materialise, meet, running_total

SHARDS = 8
#: Rounds in a row without a move that end the propagation: two of each kind, as ties fall anew.
IDLE = 4


def _clamp(n, room) -> F.Column:
    return F.greatest(F.lit(0), F.least(n, room)).cast("long")


def _propagate(cells: DataFrame, quota: DataFrame, turn: int) -> DataFrame | None:
    """One round over cells (g1, g2, shard, n), None if nothing moves; quota (shard, quota) has one row a shard.

    Ties fall anew each turn. Each part is written, as plans that hold it many times fill the driver.
    """
    group = ["g1", "g2"]
    load = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    free = materialise(quota.join(load, "shard", "left").select(F.col("shard").alias("target"), F.greatest(F.lit(0), F.col("quota") - F.coalesce("load", F.lit(0))).alias("free")), "free")
    offered = cells.join(F.broadcast(free.where("free > 0").select(F.col("target").alias("shard"))), "shard") if turn % 2 else cells
    best = offered.groupBy(*group).agg(F.max_by("shard", F.struct("n", F.xxhash64(F.lit(turn), "g1", "shard"))).alias("target"), F.max("n").alias("top"))
    wish = materialise(cells.join(best, group, "left").withColumn("moves", F.coalesce((F.col("shard") != F.col("target")) & (F.col("n") <= F.col("top")), F.lit(False))), "wish")
    ways = materialise(wish.where("moves").groupBy("shard", "target").agg(F.sum("n").alias("there")), "ways")  # a row for each two shards
    back = ways.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("there").alias("back"))
    swaps = ways.join(back, ["shard", "target"]).select("shard", "target", F.least("there", "back").alias("swap"))
    rooms = materialise(ways.select("shard", "target").join(swaps, ["shard", "target"], "left").join(free, "target").select("shard", "target", F.coalesce("swap", F.lit(0)).alias("swap"), "free"), "rooms")
    if rooms.where("swap > 0 or free > 0").isEmpty():
        discard(free, wish, ways, rooms)
        return None
    # an edge is gained for each pair of a mover and a neighbour there; classes of powers of two order the gains
    movers = wish.where("moves").withColumn("class", -F.floor(F.log2(F.col("top"))).cast("int"))
    movers = running_total(movers, ["shard", "target"], ["class"], group, F.col("n"), "before", 64).join(F.broadcast(rooms), ["shard", "target"])
    movers = materialise(movers.select(*group, "shard", "target", "class", "n", "free", _clamp(F.col("n"), F.col("swap") - F.col("before")).alias("swapped")), "movers")
    after = running_total(movers, ["target"], ["class"], ["g1", "g2", "shard"], F.col("n") - F.col("swapped"), "before", 64)
    taken = after.withColumn("taken", F.col("swapped") + _clamp(F.col("n") - F.col("swapped"), F.col("free") - F.col("before")))
    moved = taken.select(*group, F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("taken")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("taken").alias("n")))).alias("c")).select(*group, "c.*")
    out = materialise(wish.where(~F.col("moves")).select(*group, "shard", "n").unionByName(moved).where("n > 0").groupBy(*group, "shard").agg(F.sum("n").alias("n")), "cells")
    discard(free, wish, ways, rooms, movers)
    return out


def _unsettled(cells: DataFrame) -> tuple[int, int]:
    """Groups that lie in two shards or more, and those of them whose heaviest shard is a tie; a list holds a group's shards."""
    n = F.sort_array(F.collect_list("n"), asc=False)
    lists = cells.groupBy("g1", "g2").agg(n.alias("n")).where(F.size("n") > 1)
    return tuple(lists.agg(F.count(F.lit(1)), F.count_if(F.col("n")[0] == F.col("n")[1])).first())


def shard_documents(documents: DataFrame, shards: int = SHARDS, group=None) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, size, text_crc32, g1, g2, shard, slot.

    size: UTF-8 bytes of the text plus 1. group: a column whose equal values link documents; the text by default.
    Shard counts are at most one apart, in any table: rows of a group that is larger than a shard's quota are cut
    at the quota, all others stay together unless quotas are full. slot: gapless from 0 in each shard. Null text is a
    text of its own without bytes; null doc_id is an id like any other; repeated rows are counted one by one;
    ties go by hash; other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    value = (F.col("text") if group is None else group).cast("string")
    key = F.struct(value.isNull(), F.coalesce(value, F.lit("")))  # no text equals a null
    rows = materialise(
        documents.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(key).alias("g1"),
            F.xxhash64(F.lit(7), key).alias("g2"),
        ),
        "shard-rows",
    )
    n = rows.count()
    quota = materialise(spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(n // shards) + (F.col("id") < n % shards).cast("long")).alias("quota")), "quota")
    chunks = chunk_count(n)
    start = F.pmod(F.xxhash64("doc_id", "g1"), F.lit(shards)).cast("int")
    cells = rows.groupBy("g1", "g2", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    groups = materialise(cells.groupBy("g1", "g2").agg(F.sum("n").alias("all")).where("all > 1"), "groups")
    cells = materialise(cells.join(groups.drop("all"), ["g1", "g2"]), "cells")
    # no cell of a whole group moves; without ties, a still round of each kind is like all that would come
    turn, idle, (split, tied) = 0, 0, _unsettled(cells)
    while split and idle < (IDLE if tied else 2):
        new = _propagate(cells, quota, turn)
        turn, idle = turn + 1, idle + 1 if new is None else 0
        if new is not None:
            discard(cells)
            cells, (split, tied) = new, _unsettled(new)
    # cut what a shard holds beyond its quota, smallest cells first to go, and hand it to the filler
    ordered = running_total(cells.withColumn("class", -F.floor(F.log2("n")).cast("int")), ["shard"], ["class"], ["g1", "g2"], F.col("n"), "before", 64)
    kept = materialise(ordered.join(F.broadcast(quota), "shard").select("g1", "g2", "shard", "n", _clamp(F.col("n"), F.col("quota") - F.col("before")).alias("kept")), "held")
    held = kept.where("kept > 0").select("g1", "g2", "shard", F.col("kept").alias("n"))
    cut = kept.where("kept < n").select("g1", "g2").distinct().withColumn("unit", F.col("g1"))
    inside = Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = held.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).groupBy("g1", "g2").agg(F.collect_list(F.struct("first", "n", "shard")).alias("spans"))
    ranked = running_total(rows, ["g1", "g2"], [], ["doc_id", "size"], 1, "nth", chunks)
    placed = meet(ranked, spans, ["g1", "g2"], hot_keys(groups, ["g1", "g2"], "all"), ["doc_id", "nth"], "left").withColumn("hit", F.filter("spans", lambda s: (s["first"] <= F.col("nth")) & (F.col("nth") < s["first"] + s["n"])))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "g1", "g2", F.get("hit", F.lit(0))["shard"].alias("shard"), "nth"), "placed")
    discard(rows, cells, groups)
    # the filler takes the places that are left
    room = quota.join(held.groupBy("shard").agg(F.sum("n").alias("load")), "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room")).where("room > 0")
    spans = room.select("shard", "room", F.coalesce(F.sum("room").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    spans = spans.agg(F.collect_list(F.struct("first", "room", "shard")).alias("spans"))  # one row a shard
    # groups that were cut stay together here; what was never linked is one unit
    filler = placed.where("shard is null").drop("shard").join(cut, ["g1", "g2"], "left").withColumn("unit", F.coalesce("unit", F.lit(0)))
    filler = running_total(filler, [], ["unit"], ["g1", "doc_id", "nth"], 1, "place", chunks)
    filler = filler.join(F.broadcast(spans)).withColumn("shard", F.get(F.filter("spans", lambda s: (s["first"] <= F.col("place")) & (F.col("place") < s["first"] + s["room"])), F.lit(0))["shard"])
    columns = ["doc_id", "size", "text_crc32", "g1", "g2", "shard", "nth"]
    done = materialise(placed.where("shard is not null").select(columns).unionByName(filler.select(columns)), "shards")
    return running_total(done, ["shard"], [], ["doc_id", "g1", "nth"], 1, "slot", chunks).drop("nth")


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: links, pairs of rows of one group (g1, g2), and cut, those of them that lie in different shards."""
    pairs = lambda n: F.coalesce(F.sum((F.col(n) * (F.col(n) - 1) / 2).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    cells = sharded.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    groups = cells.groupBy("g1", "g2").agg(F.sum("n").alias("all"), pairs("n").alias("__kept"))
    return groups.agg(pairs("all").alias("links"), F.coalesce(F.sum("__kept"), F.lit(0)).alias("__kept")).select("links", (F.col("links") - F.col("__kept")).alias("cut"))


def digest(documents: DataFrame) -> DataFrame:
    """What op8 returns; law `rows`: shard counts at most one apart."""
    out = shard_documents(documents)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
