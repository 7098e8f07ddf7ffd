"""Merkle manifest of a data set: a trie of digests over its documents, source by source, with a proof for each row.

A leaf is the digest of a row. Leaves of one source are ordered by doc_id (null first), those of one doc_id by digest;
FANOUT consecutive nodes become one until one is left, the source's subroot; the subroots, ordered by source (null
first), become the root in the same way.

Ranks need no sort of all rows. A leaf's place in the order is a string of hexadecimal digits: doc_id, then digest.
Rows are counted by leading digits; digits are added where a count is large, as many as its own range calls for. Sums
over coarser and coarser prefixes give the rows before each bucket, and only rows of one bucket are ordered together.
The rank's digits to the base FANOUT are a leaf's key in the trie: nodes that share all but the last digit become their
parent, longest keys first, one shuffle of a sixteenth of the rows a level. Proofs come down the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import FEW_ROWS, HOT_KEYS, ROWS_PER_CHUNK, materialise
from mosaiq.operators.order import index_of

#: Children of a node.
FANOUT = 16
#: Rows that a bucket of leading digits should hold about.
BUCKET_ROWS = 512
#: Copies of one row that are given places at once.
COPIES = 4_096
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row: each of COLUMNS as byte count, colon and value, or a dash for null. text replaces the column."""
    return F.sha2(F.concat(*(_field(F.col(c) if c != "text" or text is None else text) for c in COLUMNS)), 256)


def tampered_digest() -> Column:
    """Digest of a row whose text's A-Z were lower-cased, where 5 divides crc32 of its decimal doc_id; null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf_digest(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _bucket_digits(rows: Column) -> Column:
    """Digits that cut so many rows into buckets of about BUCKET_ROWS."""
    return F.greatest(F.lit(1), F.ceil(F.log(16.0, rows / BUCKET_ROWS))).cast("int")


def _shared(low: str, high: str) -> Column:
    """Length of the common prefix of two places."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(low)), lambda k: F.substring(F.col(low), F.lit(1), k) == F.substring(F.col(high), F.lit(1), k)))


def _buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (sid, place, copies) with pre, the leading digits that name their bucket, and sid, pre, copies of all buckets.

    A bucket keeps at most max(FEW_ROWS, rows / HOT_KEYS) rows, as equal rows are one row here; those above it, at most
    HOT_KEYS whatever the input, get more digits, until there are none.
    """
    seen = rows.agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("n"))
    first = seen.select("n", (_shared("low", "high") + _bucket_digits(F.col("n"))).alias("digits")).first()
    rows = rows.withColumn("pre", F.substring("place", 1, first["digits"] or 1))
    most = max(FEW_ROWS, first["n"] // HOT_KEYS)
    while True:
        counts = materialise(rows.groupBy("sid", "pre").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.min("place").alias("low"), F.max("place").alias("high")), "buckets")
        heavy = counts.where(F.col("n") > most)
        if heavy.isEmpty():
            return rows, counts.select("sid", "pre", "copies")
        longer = heavy.select("sid", "pre", (_shared("low", "high") + _bucket_digits(F.col("n"))).alias("digits"))
        rows = rows.join(F.broadcast(longer), ["sid", "pre"], "left").withColumn("pre", F.when(F.col("digits").isNull(), F.col("pre")).otherwise(F.substring(F.col("place"), F.lit(1), F.col("digits")))).drop("digits")
        rows = materialise(rows.select("sid", "pre", *[c for c in rows.columns if c not in ("sid", "pre")]), "rows")


def _starts(buckets: DataFrame) -> DataFrame:
    """sid, pre, before, total: rows of the source before each bucket, and all of them; sums over shorter prefixes first."""
    levels = [(buckets, 0)]
    width = buckets.agg(F.max(F.length("pre"))).first()[0] or 0
    while levels[-1][0].count() > ROWS_PER_CHUNK and width > 2:
        width -= 2
        shorter = levels[-1][0].groupBy("sid", F.substring("pre", 1, width).alias("pre")).agg(F.sum("copies").alias("copies"))
        levels.append((materialise(shorter, "prefixes"), width))

    def ahead(*keys: str) -> Column:
        return F.coalesce(F.sum("copies").over(Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    out = levels[-1][0].select("sid", "pre", ahead("sid").alias("before"), F.sum("copies").over(Window.partitionBy("sid")).alias("total"))
    for (fine, _), (_, cut) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        inside = fine.withColumn("parent", F.substring("pre", 1, cut)).withColumn("inside", ahead("sid", "parent"))
        out = inside.join(out.withColumnRenamed("pre", "parent"), ["sid", "parent"]).select("sid", "pre", (F.col("before") + F.col("inside")).alias("before"), "total")
    return out


def rank_leaves(leaves: DataFrame) -> DataFrame:
    """leaves (sid, doc_id, hash, other) with idx, the place in the source from 0, and n, the source's leaves."""
    own = leaves.groupBy("sid", "doc_id", "hash", "other").agg(F.count(F.lit(1)).alias("copies"))
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    place = F.concat(F.when(F.col("doc_id").isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), number)), "hash")
    own = materialise(own.withColumn("place", place), "leaves")
    rows, buckets = _buckets(own)
    inside = Window.partitionBy("sid", "pre").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(_starts(buckets), ["sid", "pre"]).withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    parts = placed.select("sid", "doc_id", "hash", "other", "copies", "first", F.col("total").alias("n"), F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("part"))
    if (own.agg(F.max("copies")).first()[0] or 0) > COPIES:
        parts = parts.repartition("sid", "first", "part")
    idx = F.explode(F.expr(f"sequence(first + part * {COPIES}, first + least(copies, (part + 1) * {COPIES}) - 1)"))
    return parts.select("sid", idx.alias("idx"), "n", "hash", "doc_id", "other")


def tree(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Levels of the trie over nodes (sid, idx, n, hash, doc_id, other); the first is nodes, the n of a source's last is 1.

    Rows of the further levels have kids, an array of the FANOUT nodes below at most, in order. most: the largest n.
    """
    levels = [nodes]
    for _ in range(math.ceil(math.log(most, FANOUT) - 1e-12) if most > 1 else 0):
        kid = F.struct((F.col("idx") % FANOUT).cast("int").alias("at"), "hash", "doc_id", "other")
        up = levels[-1].where("n > 1").groupBy("sid", F.expr(f"idx div {FANOUT}").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
        up = up.agg(F.array_sort(F.collect_list(kid)).alias("kids"))  # FANOUT at most
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        up = up.select("sid", "idx", "n", F.sha2(joined, 256).alias("hash"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("other"), "kids")
        levels.append(materialise(up, "nodes"))
    return levels


def _down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """sid, doc_id, hash, other and proof of all nodes of the first level; above: sid, subroot, proof of the sources.

    proof: left and right, the joined digests of a node's siblings before and after it, from its own run to the root.
    """
    here = None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].where("n = 1").join(above, "sid").select("sid", "idx", "proof", "subroot", "hash", "doc_id", "other")
        here = own if here is None else here.unionByName(own)
        if not k:
            return here
        at = F.col("kid.at")
        kid = levels[k].select("sid", "idx", "kids").join(here.select("sid", "idx", "proof", "subroot"), ["sid", "idx"]).select("*", F.explode("kids").alias("kid"))
        side = lambda first, many: F.array_join(F.transform(F.slice("kids", first, many), lambda x: x["hash"]), "")
        step = F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(FANOUT)).alias("right"))
        here = kid.select("sid", (F.col("idx") * FANOUT + at).alias("idx"), F.concat(F.array(step), "proof").alias("proof"), "subroot", "kid.hash", "kid.doc_id", "kid.other")
    raise AssertionError("a tree has a level at least")


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(proof, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def _source(sid: Column) -> Column:
    return F.when(sid != "0", F.expr("substring(sid, 2)"))


def _trees(documents: DataFrame, other: Column) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Levels of the sources' trees and of the tree over their subroots; None for an empty table."""
    sid = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = documents.select(sid.alias("sid"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("hash"), other.alias("other"))
    ranked = materialise(rank_leaves(leaves), "ranked")
    most = ranked.agg(F.max("n")).first()[0]
    if not most:
        return None
    levels = tree(ranked, most)
    tops = [x.where("n = 1").select("sid", "hash") for x in levels]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = materialise(subroots, "subroots")
    many = subroots.count()
    nodes = index_of(subroots, ["sid"], "idx").select(F.lit("").alias("sid"), "idx", F.lit(many).cast("long").alias("n"), "hash", F.lit(None).cast("long").alias("doc_id"), F.col("sid").alias("other"))
    return levels, tree(materialise(nodes, "subroots"), many)


def manifest(documents: DataFrame) -> DataFrame:
    """The manifest's nodes: source, level (0: rows, null source and level for those above the subroots), idx, digest.

    Levels above the sources are counted on in `above`, from 1; its last node is the root. An empty table has none.
    """
    trees = _trees(documents, F.lit(None).cast("string"))
    if trees is None:
        return documents.sparkSession.createDataFrame([], "source string, level int, above int, idx long, digest string")
    none = F.lit(None).cast("int")
    out = [x.select(_source(F.col("sid")).alias("source"), F.lit(k).alias("level"), none.alias("above"), "idx", F.col("hash").alias("digest")) for k, x in enumerate(trees[0])]
    out += [x.select(F.lit(None).cast("string").alias("source"), none.alias("level"), F.lit(k).alias("above"), "idx", F.col("hash").alias("digest")) for k, x in enumerate(trees[1]) if k]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def prove(documents: DataFrame, other: Column | None = None) -> DataFrame:
    """Per row of documents: doc_id, source, leaf, other, subroot, root and proof, the siblings' digests up to the root.

    other: a digest to verify in place of the row's own; null means its own. Nulls in any column are hashed as a dash
    and a null text differs from an empty one; null doc_ids come first in their source, a null source is a source of its
    own; rows with one doc_id are ordered by digest, repeated rows are leaves of their own with equal digests; columns
    other than COLUMNS are ignored; an empty table gives no rows.
    """
    trees = _trees(documents, F.lit(None).cast("string") if other is None else other)
    if trees is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, source string, leaf string, other string, subroot string, root string, proof array<struct<left:string,right:string>>")
    levels, over = trees
    root = over[-1].select("hash").first()[0]
    step = "array<struct<left:string,right:string>>"
    start = over[-1].select("sid", F.lit("").alias("subroot"), F.array().cast(step).alias("proof"))
    sources = _down(over, start).select(F.col("other").alias("sid"), F.col("hash").alias("subroot"), "proof")
    rows = _down(levels, materialise(sources, "sources"))
    return rows.select("doc_id", _source(F.col("sid")).alias("source"), F.col("hash").alias("leaf"), "other", "subroot", F.lit(root).alias("root"), "proof")


def digest(documents: DataFrame) -> DataFrame:
    """What op11 returns."""
    rows = prove(documents, tampered_digest())
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = rows.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(depth: int = 5) -> str:
    """SQL for up to FANOUT ** depth rows a source and as many sources."""
    field = lambda c: f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c if c != 'text' else text) for c in COLUMNS)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
with crc as (select list(v order by i) as t from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v from range(256) r(i))),
d as (select *, cast(doc_id as varchar) as s from documents),
h as (select doc_id, source, xor(list_reduce([4294967295::bigint] || list_transform(range(length(s)), lambda i: ascii(s[i + 1])::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc, {leaf("text")} as leaf, {leaf(lower)} as low from d, crc),
a0 as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i0, count(*) over (partition by source) as n from h)"""

    def climb(name: str, keys: str, first: str) -> str:
        out, eq = "", " and ".join(f"x.{k} is not distinct from y.{k}" for k in keys.split(", ") if k)
        own = f"{keys}, " if keys else ""
        out += f",\n{name}n0 as (select {own}i0 as i, n, {first} as hash from {name}0)"
        for k in range(1, depth + 1):
            out += f",\n{name}n{k} as (select {own}i // {FANOUT} as i, (any_value(n) + {FANOUT - 1}) // {FANOUT} as n, sha256(string_agg(hash, '' order by i)) as hash from {name}n{k - 1} where n > 1 group by {own}i // {FANOUT})"
            out += f",\n{name}s{k} as (select {', '.join(f'x.{c}' for c in [*[c for c in keys.split(', ') if c], 'i'])}, coalesce(string_agg(y.hash, '' order by y.i) filter (where y.i < x.i), '') as l, coalesce(string_agg(y.hash, '' order by y.i) filter (where y.i > x.i), '') as r from {name}n{k - 1} x join {name}n{k - 1} y on {eq + ' and ' if eq else ''}x.i // {FANOUT} = y.i // {FANOUT} where x.n > 1 group by all)"
        return out

    sql += climb("a", "source", "leaf")
    sql += ",\ntops as (" + " union all ".join(f"select source, hash from an{k} where n = 1" for k in range(depth + 1)) + ")"
    sql += ",\nb0 as (select source, hash as subroot, row_number() over (order by source nulls first) - 1 as i0, count(*) over () as n from tops)"
    sql += climb("b", "", "subroot")
    sql += ",\nroots as (" + " union all ".join(f"select hash as root from bn{k} where n = 1" for k in range(depth + 1)) + ")"
    joins, proof, folded = "", [], "case when crc % 5 = 0 then low else leaf end"
    for name, place in (("a", "a0.i0"), ("b", "b0.i0")):
        for k in range(1, depth + 1):
            t = f"{name}s{k}"
            joins += f" left join {t} on {'a0.source is not distinct from ' + t + '.source and ' if name == 'a' else ''}{place} // {FANOUT ** (k - 1)} = {t}.i"
            proof += [f"coalesce({t}.l || {t}.r, '')"]
    sql += f",\nj as (select a0.doc_id, a0.leaf, subroot, root, {folded} as f0, {' || '.join(proof)} as proof, "
    sql += ", ".join(f"{n}s{k}.l as {n}l{k}, {n}s{k}.r as {n}r{k}" for n in "ab" for k in range(1, depth + 1))
    sql += f" from a0 join b0 on a0.source is not distinct from b0.source cross join roots{joins})"
    last = "j"
    for m, (n, k) in enumerate((n, k) for n in "ab" for k in range(1, depth + 1)):
        sql += f",\nf{m} as (select *, case when {n}l{k} is null then f{m} else sha256({n}l{k} || f{m} || {n}r{k}) end as f{m + 1} from {last})"
        last = f"f{m}"
    end = f"f{2 * depth}"
    return sql + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, {end} as folded_root, {end} = root as verified from {last}"
