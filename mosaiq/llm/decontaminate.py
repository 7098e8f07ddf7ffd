"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

A window is a run of 10 words of an item, or the whole of a shorter item. Its tokens are ordered by rarity, counted
over all documents; containment of the whole window asks for every token, so its rarest one is the prefix that a
document must share. Document words meet these prefix tokens in a hash join; the window's start and length must lie
inside the document (positional and length bounds), and the words there must equal the window's.

The windows' side of each join is broadcast in parts of about PART_ROWS rows and PART_BYTES bytes, so its size is
bounded; a benchmark with more windows is joined part by part, and so are the counts of words. The words of a document
are never shuffled. Windows and items are joined last, by the number of the window, so a passage that all items share
is one row until a document holds it. Where an item has a word of more than LONG bytes, such words are compared by their
SHA-256, so every window is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import discard, hot_keys, materialise, meet, without_ids

WORDS = 10
#: Bytes of the longest word that stands for itself; longer ones go by their digest.
LONG = 1 << 10
#: Rows and bytes of a broadcast part.
PART_ROWS, PART_BYTES = 200_000, 1 << 25
#: All that no word holds: ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _shortened(words: Column) -> Column:
    """Words of more than LONG bytes as digests after a sign that no word has, so a window has a bounded size."""
    return F.transform(words, lambda x: F.when(F.octet_length(x) > LONG, F.concat(F.lit("#"), F.sha2(x, 256))).otherwise(x))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _in_parts(table: DataFrame, key: str, size: Column, label: str) -> list[DataFrame]:
    """The table, written, in pieces that may be broadcast: about PART_ROWS rows of about PART_BYTES bytes by `size`."""
    one = materialise(table, label)
    rows, size_of = one.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= PART_ROWS and size_of <= PART_BYTES:
        return [F.broadcast(one)] if rows else []
    n = max(-(-2 * rows // PART_ROWS), -(-2 * size_of // PART_BYTES))
    parts = materialise(one.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), label)
    discard(one)
    return [F.broadcast(parts.where(F.col("part") == k).drop("part")) for k in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_words, hits, items.

    hits: array<struct<start, length>> of the window occurrences, starts from 0; items: sorted array of the item ids
    (as strings) with a window that occurs. Null and empty texts have no words; items without words have no window.
    Items with one text share their windows; a repeated item id counts once; a null one is an empty string. Rows of
    documents with one doc_id and text get equal results. Other columns are ignored; empty tables are fine.
    """
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    # a document's long words matter only if an item has one
    longest = own.select(F.explode("w").alias("word")).agg(F.max(F.octet_length("word"))).first()[0] or 0
    shown = _shortened if longest > LONG else lambda w: w
    own = own.withColumn("w", shown(F.col("w")))
    length = F.least(F.lit(size), F.size("w"))
    runs = own.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("window"))
    runs = materialise(runs.withColumn("id", F.sha2(F.concat_ws(" ", "window"), 256)), "windows")
    windows, owners = runs.select("id", "window").distinct(), materialise(runs.select("id", "item").distinct(), "window-items")
    docs = documents.select(F.col("doc_id").alias("d"), _text_hash(F.col("text")).alias("t"), shown(words_of(F.col("text"))).alias("w"))
    # rarity of the benchmark's words, over all documents
    word_bytes = F.octet_length("word") + 16
    vocabulary = _in_parts(windows.select(F.explode("window").alias("word")).distinct(), "word", word_bytes, "vocabulary")
    # the outer forms keep Catalyst from adding a filter that would split every text once more
    spread = docs.select(F.explode_outer("w").alias("word"))
    counted = _union([p.join(spread.join(p, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")) for p in vocabulary])
    found = []
    if counted is not None:
        places = windows.select("id", F.posexplode("window").alias("at", "word"))
        placed = _union([places.join(p, "word") for p in _in_parts(counted, "word", word_bytes, "word-counts")])
        rarest = placed.groupBy("id").agg(F.min_by(F.struct("word", "at"), F.struct("n", "word", "at")).alias("p"))
        prefix = windows.join(rarest, "id").select("id", F.col("p.word").alias("word"), F.col("p.at").alias("at"), "window")
        tokens = docs.select("d", "t", "w", F.posexplode_outer("w").alias("pos", "word"))
        for p in _in_parts(prefix, "id", F.octet_length(F.concat_ws(" ", "window")) + 128, "prefix"):
            start = F.col("pos") - F.col("at")
            inside = (start >= 0) & (start + F.size("window") <= F.size("w"))
            hit = tokens.join(p, "word").where(inside).where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
            found.append(hit.select("d", "t", F.struct(start.alias("start"), F.size("window").alias("length")).alias("hit"), "id"))
    sizes = documents.select(F.col("doc_id"), _text_hash(F.col("text")).alias("__t"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    hits = _union(found)
    no_hits, no_items = F.array().cast("array<struct<start:int,length:int>>"), F.array().cast("array<string>")
    if hits is None:
        return sizes.select("doc_id", "n_words", no_hits.alias("hits"), no_items.alias("items"))
    hits = materialise(hits, "hits")
    seen = hits.select("d", "t", "id").distinct()
    often = materialise(seen.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "window-hits")
    named = meet(seen, owners, ["id"], hot_keys(often, ["id"], "n"), ["d", "t"]).groupBy("d", "t").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = hits.groupBy("d", "t").agg(F.collect_set("hit").alias("hits"))
    same = (F.col("d").eqNullSafe(F.col("d2"))) & (F.col("t") == F.col("t2"))
    by_doc = by_doc.join(named.withColumnsRenamed({"d": "d2", "t": "t2"}), same).select(F.col("d").alias("__d"), F.col("t").alias("__u"), "hits", "items")
    out = sizes.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__u")), "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", no_hits).alias("hits"), F.coalesce("items", no_items).alias("items"))


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What op6 returns."""
    out = decontaminate(documents, benchmark)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    n_hit = F.when(F.size("hits") > 0, F.size(covered)).otherwise(0).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
with iw as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as run from (select item, w, unnest(range(len(w) - least(10, len(w)) + 1)) as i from iw where len(w) > 0)),
dw as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dp as (select r, w, n, unnest(range(len(w) - n + 1)) as i from dw, (select distinct n from win) where len(w) >= n),
hit as (select distinct dp.r, i, dp.n, item from dp join win on win.n = dp.n and win.run = array_to_string(w[i + 1 : i + dp.n], ' ')),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hit)) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (r) left join items using (r)
"""


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """documents but those in which a window of a benchmark item occurs; another row with that doc_id goes as well."""
    found = decontaminate(documents, benchmark, size)
    return without_ids(documents, found.where(F.size("hits") > 0).select("doc_id"))
