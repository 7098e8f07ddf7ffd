"""Exact n-gram Jaccard join of whole texts: a size-aware heavy-light join.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets are one class. Classes
with sets A and B link when ``100 |A & B| >= 80 |A | B|``, that is ``|A & B| >= 4 (|A| + |B|) / 9``.

Small sets (up to a boundary): all subsets of the size that a partner's size asks for are enumerated; two sets that
share one are linked, with nothing left to verify. Sets just above the boundary join in for their small partners.

Large sets: inverted lists over the e(n) smallest hashes of each set, e(n) = 0.4 n + 1. Two linked sets share at least
min(L(n_A), L(n_B)) of these, L(n) = e(n) - (n - ceil(0.8 n)); shingles that only one class has are dropped while the
lists are sorted. Sets with too few entries left for any partner go. Of the others whole sets are compared with each
other in the same way, which counts how many of a set's shingles any other has: with less than 0.8 n the set goes, and
no partner can share more than that count. A shingle of HOT or more classes is left out of a set's lists unless the set
has so many hot ones that these alone could be what a partner shares. Each list is scanned twice: once against one
leader, which finds most links, then members of different components against each other. Two sets that both use hot
ones either share nothing else, and need enough hot shingles each, or meet in the lists of their other shingles. Pairs
that reach these bounds are verified on whole sets.

A shingle that very many texts share is known beforehand, from a count over the classes whose hash ends in PROBE_BITS
zero bits; its list is dealt over salts while it is sorted. That count only routes rows: it decides nothing else but
that the shingle is hot, which any shingle may be called. Joins over long lists and over pairs of one leader deal the
many rows of a key over salts as well (`common.meet`).

The boundary is the one of least cost: subsets of each small set against list entries of each large one, over the
corpus's own set sizes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import BROADCAST_IDS, HOT_KEYS, discard, hot_keys, materialise, meet, without_ids
from mosaiq.llm.components import components

WORDS = 5
#: Classes that make a shingle hot.
HOT = 24
#: No boundary above this is considered: subsets of larger sets are too many at any cost.
MOST_SMALL = 14
#: Cost of a list entry, in subsets: it is sorted, shuffled and may lead to verifications.
ENTRY_COST = 3
#: Classes whose hash ends in so many zero bits are counted beforehand, and those that a shingle known to be hot has at least.
PROBE_BITS, PROBE_LEAST = 6, 32
#: List entries of one salt, and bytes of the entries that one task sorts, on average.
SALT_ROWS, SORT_BYTES = 50_000, 1 << 26
#: Subsets that a task holds at once.
SUBSETS = 20_000
#: Digests that a task remembers, to tell each class once.
REMEMBER = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; the whole sequence is one if it has fewer words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h += (w[k : len(w) - n + 1 + k] ^ (w[k : len(w) - n + 1 + k] >> np.uint64(29))) * _FACTORS[k % 5]
        h = (h << np.uint64(23) | h >> np.uint64(41)) * _FACTORS[(k + 1) % 5]
    h ^= h >> np.uint64(31)
    h *= _FACTORS[1]
    h ^= h >> np.uint64(29)
    if n < size:
        h += np.uint64(n)
    return np.unique(h.view(np.int64))


def least_overlap(total: int) -> int:
    """Shingles that linked sets with so many shingles together must share."""
    return -(-4 * total // 9)


def partners(n: int) -> range:
    """Sizes of sets that a set of n shingles can link with."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def entries(n: int) -> int:
    return min(n, 2 * n // 5 + 1)


def subset_count(n: int, boundary: int) -> int:
    """Subsets that a set of n shingles enumerates."""
    return sum(comb(n, least_overlap(n + m)) for m in partners(n) if least_overlap(n + m) <= n and (n <= boundary or m <= boundary))


def boundary(sizes: dict[int, int]) -> int:
    """The boundary of least cost for so many sets of each size up to 5 / 4 MOST_SMALL."""
    cost = {b: sum(c * ((subset_count(n, b) if n <= b or 4 * n <= 5 * b else 0) + (ENTRY_COST * entries(n) if n > b else 0)) for n, c in sizes.items()) for b in range(MOST_SMALL + 1)}
    return min(cost, key=lambda b: (cost[b], b))


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
    return int(d[0]), int(d[1])


class _Seen(set):
    """Digests that were told; forgets all when there are too many, so a digest may be told again."""

    def new(self, mark: int) -> bool:
        if mark in self:
            return False
        if len(self) >= REMEMBER:
            self.clear()
        self.add(mark)
        return True


def _sets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ends = _Seen(), (1 << bits) - 1
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0)]
            marks = [_digest(s) for s in found]
            small = [s.tobytes() if len(s) <= 5 * MOST_SMALL // 4 else None for s in found]
            probe = [s.tobytes() if not m[0] & ends and seen.new(m[0]) else None for s, m in zip(found, marks, strict=True)]
            numbers = ([len(s) for s in found], [m[0] for m in marks], [m[1] for m in marks])
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x, pa.int64()) for x in numbers), pa.array(small, pa.binary()), pa.array(probe, pa.binary())], ["doc_id", "n", "c", "c2", "small", "probe"])

    return run


def _subsets(bound: int):
    """(k1, k2, total, n, node) for each subset; batches of about SUBSETS rows, however many a set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int]] = []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["k1", "k2", "total", "n", "node"])
            held.clear()
            return out

        for b in batches:
            for own, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = np.frombuffer(raw.as_py(), dtype=np.int64)
                n = len(s)
                for m in partners(n):
                    c = least_overlap(n + m)
                    if c > min(n, m) or n > bound and m > bound:
                        continue
                    for part in itertools.combinations(s.tolist(), c):
                        held.append((*_digest(np.array(part, dtype=np.int64)), n + m, n, own))
                        if len(held) >= SUBSETS:
                            yield rows()
        if held:
            yield rows()

    return run


class _Salts:
    """Shingles known to be hot, sorted, and over how many salts the list of each is dealt."""

    def __init__(self, rows: list[tuple[int, int]], bits: int):
        rows, self.bits = sorted(rows), np.uint64(bits)
        self.h, self.salts = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))

    def of(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """0 for other shingles, else a salt from 1 by the class."""
        out = np.zeros(len(h), dtype=np.int32)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = self.h[at] == h
            out[known] = 1 + (c[known].view(np.uint64) >> self.bits) % self.salts[at[known]].astype(np.uint64)
        return out


def _listed(h: np.ndarray, c: np.ndarray, salts: _Salts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(salts.of(h, c))], ["h", "c", "salt"])


def _lists(bound: int, shared):
    """(h, c, salt) for the entries of each large set, about once for each class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            h, c = [], []
            for t in b.column(0):
                s = shingles(t.as_py())
                if len(s) <= bound or not seen.new(mark := _digest(s)[0]):
                    continue
                h.append(s[: entries(len(s))])
                c.append(np.full(len(h[-1]), mark, dtype=np.int64))
            if h:
                yield _listed(np.concatenate(h), np.concatenate(c), shared.value)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by (h, c), of each h that has two or more c or is salted; each (h, c) once. Holds one batch and one row."""
    held: tuple[int, int, int] | None = None  # the last row
    told = False  # whether it was given out
    for b in batches:
        h, c, salt = (b.column(k).to_numpy() for k in range(3))
        if held:
            h, c, salt = (np.concatenate([[x], y]) for x, y in zip(held, (h, c, salt), strict=True))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, salt = h[new], c[new], salt[new]
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        keep = salt > 0
        keep[1:] |= same
        keep[:-1] |= same
        give = keep.copy()
        if held and told:
            give[0] = False
            keep[0] = True
        held, told = (int(h[-1]), int(c[-1]), int(salt[-1])), bool(keep[-1])
        if give.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[give]), pa.array(c[give]), pa.array(salt[give].astype(np.int32))], ["h", "c", "salt"])


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h with `hot`: whether their h is salted or has HOT rows or more. Holds one batch and fewer than HOT rows."""
    h, c, told = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None  # held rows of the last h; the last h if it is hot
    known = np.empty(0, dtype=bool)
    names = ["h", "c", "hot"]
    for b in batches:
        h, c = np.concatenate([h, b.column(0).to_numpy()]), np.concatenate([c, b.column(1).to_numpy()])
        known = np.concatenate([known, b.column(2).to_numpy() > 0])
        if not len(h):
            continue
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(h)]]))
        hot = (sizes >= HOT) | known[starts]
        hot[0] |= h[0] == told
        told = int(h[-1]) if hot[-1] else None
        end = len(h) if hot[-1] else starts[-1]
        if end:
            yield pa.RecordBatch.from_arrays([pa.array(h[:end]), pa.array(c[:end]), pa.array(np.repeat(hot, sizes)[:end])], names)
        h, c, known = h[end:], c[end:], known[end:]
    if len(h):
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(np.zeros(len(h), dtype=bool))], names)


def _shared_flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _flagged(_shared(batches))


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([shingles(t.as_py()).tobytes() for t in b.column(0)], pa.binary())], ["node", "s"])


def _entries(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in b.column(1)]
            for i in range(0, len(found), 200):
                part = found[i : i + 200]
                yield _listed(np.concatenate(part), np.repeat(b.column(0).to_numpy()[i : i + 200], [len(s) for s in part]), shared.value)

    return run


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in b.column(1)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(b.column(0).to_numpy(), [len(s) for s in found]))], ["h", "c"])


def _known_hot(base: DataFrame) -> _Salts:
    """Shingles that more than max(PROBE_LEAST, total / HOT_KEYS) of the probed classes have: at most HOT_KEYS of them."""
    counts = base.where("length(probe) > 0").select("c", "probe").mapInArrow(_probed, "h long, c long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(F.col("n") > 1), "probed")
    least = max(PROBE_LEAST, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    rows = [(r["h"], -(-(r["n"] << PROBE_BITS) // SALT_ROWS)) for r in counts.where(F.col("n") > least).collect()]
    discard(counts)
    return _Salts(rows, PROBE_BITS)


def _sorted_lists(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "h", "salt").sortWithinPartitions("h", "c")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = [], []
        for x, y, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            a, d = np.frombuffer(s.as_buffer(), dtype=np.int64), np.frombuffer(t.as_buffer(), dtype=np.int64)
            if len(np.intersect1d(a, d, assume_unique=True)) >= least_overlap(len(a) + len(d)):
                u.append(x)
                v.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _spare(n: Column) -> Column:
    """L(n) in SQL."""
    return F.least(n, F.floor(2 * n / 5) + 1) - (n - F.ceil(4 * n / 5))


def _small_links(classes: DataFrame, bound: int) -> DataFrame:
    """Links among sets of which one has at most `bound` shingles: in a list, each size goes to the first of its partner's."""
    own = classes.where((F.col("n") >= 1) & (F.col("n") * 4 <= 5 * bound)).select("node", "small")
    rows = materialise(own.mapInArrow(_subsets(bound), "k1 long, k2 long, total long, n long, node long"), "subsets")
    key = ["k1", "k2", "total", "n"]
    first = materialise(rows.groupBy(*key).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")), "first-subsets")
    other = first.select("k1", "k2", "total", (F.col("total") - F.col("n")).alias("n"), "first")
    met = meet(rows, other, key, hot_keys(first, key, "members"), ["node"])
    links = materialise(met.select(F.col("node").alias("u"), F.col("first").alias("v")).where("u != v").distinct(), "small-links")
    discard(rows, first)
    return links


def _apart(lists: DataFrame, found: DataFrame, fields: list[str], able: Column, only_able: bool = False) -> DataFrame:
    """Pairs of members of one list (h, node, n, fields) in different components and of sizes that can link: u, v, both fields.

    In each list one side is the members outside its largest component that are `able` to link with the list's smallest
    member (column `least`), the other side all members (or all able ones); a pair of two outsiders comes once.
    """
    placed = lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    largest = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("m")).groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.min("m").alias("least"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("members")).where("parts > 1").drop("parts")
    largest = materialise(largest, "open-lists")
    hot = hot_keys(largest, ["h"], "members")
    open_ = meet(placed, largest.drop("members"), ["h"], hot, ["node"])
    open_ = open_.where(able) if only_able else open_
    names = ["node", "n", "component", *fields]
    outside = open_.where((F.col("component") != F.col("major")) & able).select("h", "major", *names)
    every = open_.withColumn("able2", able).select("h", "able2", *(F.col(c).alias(f"{c}2") for c in names))
    once = (F.col("component2") == F.col("major")) | ~F.col("able2") | (F.col("node") < F.col("node2"))
    near = (F.col("n") * 5 >= F.col("n2") * 4) & (F.col("n2") * 5 >= F.col("n") * 4)
    met = meet(every, outside, ["h"], hot, ["node2"]).where((F.col("component") != F.col("component2")) & once & near)
    return met.withColumns({"u": F.least("node", "node2"), "v": F.greatest("node", "node2")})


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that link."""
    pairs = materialise(pairs, "pairs")
    hot = {k: hot_keys(materialise(pairs.groupBy(k).agg(F.count(F.lit(1)).alias("n")), "pair-counts"), [k], "n") for k in ("u", "v")}
    left = meet(pairs, sets.withColumnsRenamed({"node": "v", "s": "t"}), ["v"], hot["v"], ["u"])
    both = meet(left, sets.withColumnRenamed("node", "u"), ["u"], hot["u"], ["v"])
    return both.select("u", "v", "s", "t").mapInArrow(_linked, "u long, v long")


def join_documents(documents: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Null and empty texts, and texts without words, have an empty set and link with nothing. Rows with one doc_id
    are one document: their links count together. Rows with a null doc_id get a null component and take no part. Other
    columns are ignored; an empty table gives no rows; repeated rows give repeated results.
    """
    texts = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    base = materialise(texts.mapInArrow(_sets(PROBE_BITS), "doc_id long, n long, c long, c2 long, small binary, probe binary"), "sets")
    classes = base.where("n > 0 and doc_id is not null").groupBy("c", "c2", "n").agg(F.min("doc_id").alias("node"), F.first("small").alias("small"))
    classes = materialise(classes, "classes")
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 5 * MOST_SMALL // 4).groupBy("n").count().collect()}  # a row a size
    bound = boundary(sizes)
    small = _small_links(classes, bound)
    # documents with several rows: their classes link
    of_rows = base.where("n > 0 and doc_id is not null").join(classes.drop("small"), ["c", "c2", "n"]).groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("top"), F.collect_set("node").alias("all")).where("v != top")
    links = [small, materialise(of_rows.select(F.explode("all").alias("u"), "v"), "row-links")]

    spark = documents.sparkSession
    known_hot = spark.sparkContext.broadcast(_known_hot(base))  # at most HOT_KEYS pairs of numbers
    rows = texts.where("text is not null and doc_id is not null").select("text").mapInArrow(_lists(bound, known_hot), "h long, c long, salt int")
    width = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-20 * width // SORT_BYTES))
    shared = materialise(_sorted_lists(rows, parts).mapInArrow(_shared, "h long, c long, salt int").drop("salt"), "lists")
    # sets whose entries here are too few for any partner go
    need = _spare(F.ceil(4 * F.col("n") / 5))
    few = shared.groupBy("c").agg(F.count(F.lit(1)).alias("many")).join(classes.where(F.col("n") > bound).select("c", "node", "n"), "c").withColumn("need", need).where("many >= need")
    few = materialise(few, "few")
    candidates = few.select("node")
    ids = F.broadcast(candidates) if few.count() <= BROADCAST_IDS else candidates
    sets = materialise(texts.join(ids, F.col("doc_id") == F.col("node"), "left_semi").select("text", "doc_id").mapInArrow(_full, "node long, s binary").where("length(s) > 0"), "full")
    # whole sets of what is left: a link needs four fifths of a set's shingles, so at least as many must be in some other set
    whole = _sorted_lists(sets.mapInArrow(_entries(known_hot), "h long, c long, salt int"), parts).mapInArrow(_shared_flagged, "h long, c long, hot boolean")
    whole = materialise(whole.withColumnRenamed("c", "node"), "whole-lists")
    known = whole.groupBy("node").agg(F.count(F.lit(1)).alias("common"), F.count_if("hot").alias("warm"))
    few = materialise(few.join(known, "node").where("5 * common >= 4 * n"), "fewer")
    hot = materialise(whole.where("hot").groupBy("h").agg(F.first("hot").alias("hot"), F.count(F.lit(1)).alias("k")), "hot")
    side = F.broadcast(few) if few.count() <= BROADCAST_IDS else few
    entry = shared.join(side, "c").select("h", "node", "n", "many", "need", "common", "warm")
    entry = entry.join(F.broadcast(hot.drop("k")), "h", "left") if hot.count() <= BROADCAST_IDS else meet(entry, hot.drop("k"), ["h"], hot_keys(hot, ["h"], "k"), ["node"], "left")
    entry = entry.withColumn("hot", F.coalesce("hot", F.lit(False)))
    entry = materialise(entry, "entries")
    stats = entry.groupBy("node").agg(F.count_if("hot").alias("hots"))
    key = entry.join(stats, "node").withColumn("uses_hot", F.col("hots") >= F.col("need")).where(~F.col("hot") | F.col("uses_hot"))
    key = materialise(key, "keys")
    mixed = key.where("uses_hot").select("node", "n", "warm").distinct()
    discard(shared, entry)

    # first scan: each list against its leader, the member that shares the greatest part of its entries
    lead = key.groupBy("h").agg(F.max_by(F.struct(F.col("node").alias("v"), F.col("n").alias("m")), F.struct(F.col("many") / F.col("n"), -F.col("node"))).alias("l"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "l.v", "l.m", F.col("k").alias("members"))
    lead = materialise(lead, "leaders")
    close = (F.col("n") * 5 >= F.col("m") * 4) & (F.col("m") * 5 >= F.col("n") * 4)
    led = meet(key, lead.drop("members"), ["h"], hot_keys(lead, ["h"], "members"), ["node"])
    pairs = led.where((F.col("node") != F.col("v")) & close).groupBy(F.col("node").alias("u"), "v").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need")).where(F.col("k") * 4 >= F.col("need"))
    links.append(materialise(_verify(pairs.select("u", "v"), sets), "leader-links"))

    # second scan: what is still apart
    found = materialise(components(_all(links)), "components")
    least = 4 * (F.col("n") + F.greatest(F.col("least"), F.ceil(4 * F.col("n") / 5)))  # ninths of what the smallest member must share
    n2 = 4 * (F.col("n") + F.col("n2"))
    listed = key.select("h", "node", "n", "hot", "hots", "uses_hot", "common", "warm")
    # lists that aren't hot, and pairs of which one set doesn't use hot ones
    met = _apart(listed.where("not hot"), found, ["hots", "uses_hot", "common"], 9 * F.col("common") >= least)
    met = met.where(~(F.col("uses_hot") & F.col("uses_hot2")) & (9 * F.least("common", "common2") >= n2))
    met = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.first(F.least("hots", "hots2")).alias("unseen"), F.first(F.least(_spare(F.col("n")), _spare(F.col("n2")))).alias("need")).where(F.col("k") + F.col("unseen") >= F.col("need"))
    # two sets that use hot ones and share nothing else: both have enough hot shingles for a link
    # and the first of these that they share is among the first warm - needed + 1 of both
    placed = listed.where("hot").withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("h")))
    hot_met = _apart(placed, found, ["warm"], 9 * (F.col("warm") - F.col("pos") + 1) >= least, True).where(9 * F.least("warm", "warm2") >= n2)
    # or share something else in their whole sets: all of that and the hot ones must be enough
    rare = whole.where("not hot").drop("hot").join(mixed, "node")
    rare_met = _apart(rare, found, ["warm"], F.lit(True)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.first(F.least("warm", "warm2")).alias("unseen"), F.first(n2).alias("ninths")).where(9 * (F.col("k") + F.col("unseen")) >= F.col("ninths"))
    pairs = met.select("u", "v").unionByName(hot_met.select("u", "v")).unionByName(rare_met.select("u", "v")).distinct()
    links.append(materialise(_verify(pairs, sets), "other-links"))
    discard(key, sets, whole)
    found = components(_all(links))
    own = base.join(classes.drop("small"), ["c", "c2", "n"], "left").join(found, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0].select("u", "v")
    for x in links[1:]:
        out = out.unionByName(x.select("u", "v"))
    return out


def keep_one_each(documents: DataFrame) -> DataFrame:
    """documents but those that link, over any chain, with one of a smaller doc_id. Rows of one doc_id stay together."""
    found = join_documents(documents)
    return without_ids(documents, found.where("component_id != doc_id").select("doc_id"))
