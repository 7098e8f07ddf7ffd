"""Phrase collocation mining: Apriori passes over word sequences, scores of cuts from the tables of the levels.

Level 1 counts words, level k the runs of k words. Frequent words get numbers, and texts are written once as sequences
of them, with a break where a piece ends or a word is rare. From level 2 on the frequent (k-1)-grams are broadcast, as
sorted pairs of numbers of the level below; a position names its (k-1)-gram by a lookup, and a k-gram is emitted only
where this one and the next position's are both frequent, as the pair of their numbers. A task adds its counts up before
they are shuffled, so a hot phrase or language costs a row a task.

Frequent words and grams grow with the corpus, so their number and size is checked before each broadcast; a level whose
table below is larger counts all its k-grams by one aggregate instead, which gives the same rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import discard, materialise

#: Least count of a candidate, words of the longest, rows a language, factor of scores, share that hides a shorter phrase.
LEAST, LONGEST, TOP, SCALE, COVER = 30, 4, 2_000, 2_000_000, 80
#: Frequent words (rows, bytes) and grams of a level (8 bytes each) that may be broadcast.
MOST_WORDS, MOST_WORD_BYTES, MOST_GRAMS = 1 << 20, 1 << 25, 1 << 22
#: Distinct words, or positions, that a task gathers before it gives its counts out.
HELD = 1 << 17
#: Positions of the corpus for each bucket of pairs, which one task adds up, and buckets in a batch.
POSITIONS, BLOBS = 1 << 20, 8
#: Numbers of a written sequence, roughly: a batch of BATCH_ROWS of them is held by the JVM and a Python worker.
SEQUENCE = 1 << 12
#: Bytes of a text that are split at once, roughly; texts stay whole.
SLICE = 1 << 20
#: Rows that are ranked together in the first round.
RANKED = 50_000
BREAK = b"\xff"  # never in UTF-8
_FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_PAIR = np.int64(32)


def _tokens(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, BREAK between its pieces, in slices."""
    text = raw.translate(_FOLD).replace(BREAK, b" \xff ")
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + SLICE)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
            yield lang.as_py(), text.as_py()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n; the empty word stands for all words."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        for c in counts.values():
            c.pop(BREAK, None)
            c[b""] = c.total()
        parts = [[pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())] for lang, c in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], ["lang", "word", "n"])

    seen = 0
    for lang, raw in _rows(batches):
        for words in _tokens(raw):
            counts[lang].update(words)
            seen += len(words)
        if seen >= HELD:
            seen = 0
            if sum(map(len, counts.values())) >= HELD:
                yield out()
    if counts:
        yield out()


def _number(vocabulary: Broadcast):
    """Sequences of numbers, -1 for breaks and rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = done = 0
        end = np.array([-1], dtype=np.int32)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["ids"])

        for lang, raw in _rows(batches):
            get = vocabulary.value.get(lang, {}).get
            held += [np.array(list(map(get, words, repeat(-1))), dtype=np.int32) for words in _tokens(raw)]
            held.append(end)
            size += sum(map(len, held[done:]))
            done = len(held)
            if size >= SEQUENCE:
                yield out()
                held.clear()
                size = done = 0
        if held:
            yield out()

    return run


def _pairs(ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Pairs of neighbouring (k-1)-grams, both frequent, over word numbers ids; tables: sorted pairs of levels 2 to k-1."""
    at = np.flatnonzero(ids >= 0)
    gram = ids[at].astype(np.int64)
    for table in [*tables, None]:
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        pair = gram[follows] << _PAIR | gram[follows + 1]
        if table is None:
            return pair
        place = np.searchsorted(table, pair)
        known = np.flatnonzero(table[np.minimum(place, len(table) - 1)] == pair) if len(table) else np.empty(0, np.int64)
        at, gram = at[follows[known]], place[known]
    raise AssertionError


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    key, n = key[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs dealt by a hash: the upper half of a product with an odd number."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)


def _count_pairs(tables: list[Broadcast], buckets: int):
    """bucket, keys, counts: the task's own counts of pairs, a bucket's in one row of packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [t.value for t in tables]
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def gather() -> None:
            nonlocal keys, counts
            new, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keys, counts = _added([keys, new], [counts, n.astype(np.int64)])

        def out() -> Iterator[pa.RecordBatch]:
            bucket = _bucket(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
            own = [(i, order[e - n : e]) for i, (e, n) in enumerate(zip(ends, np.diff(ends, prepend=0), strict=True)) if n]
            for at in range(0, len(own), BLOBS):
                some = own[at : at + BLOBS]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), *(pa.array([x[o].tobytes() for _, o in some], pa.binary()) for x in (keys, counts))], ["bucket", "keys", "counts"])

        size = 0
        for b in batches:
            for cell in b.column(0):
                held.append(_pairs(np.frombuffer(cell.as_buffer(), dtype=np.int32), below))
                size += len(held[-1])
                if size >= 4 * HELD:
                    gather()
                    size = 0
                    if len(keys) >= 8 * HELD:
                        yield from out()
                        keys, counts = keys[:0], counts[:0]
        if held:
            gather()
        if len(keys):
            yield from out()

    return run


def _add_pairs(least: int):
    """key, f of the pairs of a partition's buckets that occur least times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for b in batches:
            for k, n in zip(b.column(1), b.column(2), strict=True):
                keys.append(np.frombuffer(k.as_py(), np.int64))
                counts.append(np.frombuffer(n.as_py(), np.int64))
                size += len(keys[-1])
                if size >= max(8 * HELD, len(keys[0])):  # what was added so far is sorted again only with as many new ones
                    key, n = _added(keys, counts)
                    keys, counts, size = [key], [n], 0
        key, f = _added(keys, counts)
        often = np.flatnonzero(f >= least)
        for at in range(0, len(often), HELD):
            rows = often[at : at + HELD]
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(f[rows])], ["key", "f"])

    return run


def _words(keys: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Word numbers (rows, k) of pairs; tables: sorted pairs of the levels below, from 2."""
    first, last = keys >> _PAIR, keys & 0xFFFFFFFF
    if not tables:
        return np.stack([first, last], axis=1)
    below = tables[-1]
    return np.concatenate([_words(below[first], tables[:-1]), _words(below[last], tables[:-1])[:, -1:]], axis=1)


def _spell(words: Broadcast, tables: list[Broadcast]):
    """lang, phrase, f of rows (key, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts = words.value
        for b in batches:
            ids = _words(b.column(0).to_numpy(), [t.value for t in tables]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([langs[i[0]] for i in ids], pa.string()), pa.array([b" ".join([texts[x] for x in i]) for i in ids], pa.binary()), b.column(1)], ["lang", "phrase", "f"])

    return run


def _plain(texts: DataFrame, k: int) -> DataFrame:
    """lang, phrase, f of the frequent k-grams by one aggregate over all of them: no table of a level is needed."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = texts.select("lang", F.explode(F.split(folded, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = pieces.select("lang", F.filter(F.split("piece", r"[\x20\x09]+"), lambda w: w != "").alias("w")).where(F.size("w") >= k)
    grams = words.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))).alias("phrase"))
    return grams.groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= LEAST)


def count_phrases(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, n (all words), and lang, phrase, k, f of all phrases of 1 to LONGEST words that occur LEAST times or more."""
    spark, sc = documents.sparkSession, documents.sparkSession.sparkContext
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(counted.where((F.col("n") >= LEAST) | (F.length("word") == 0)), "words")
    totals = words.where(F.length("word") == 0).select("lang", "n")
    frequent = words.where((F.length("word") > 0) & (F.col("n") >= LEAST))
    out = frequent.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("f"))
    rows, size = frequent.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word") + F.octet_length("lang")), F.lit(0))).first()
    pruned = 0 < rows <= MOST_WORDS and size <= MOST_WORD_BYTES
    shared: list[Broadcast] = []
    numbers = None
    if pruned:
        buckets = max(12, -(-(totals.agg(F.sum("n")).first()[0] or 0) // POSITIONS))
        known = frequent.select("lang", "word").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])  # at most MOST_WORDS rows
        langs, spelled = known.column(0).to_pylist(), known.column(1).to_pylist()
        vocabulary: dict[str, dict[bytes, int]] = defaultdict(dict)
        for i, (lang, word) in enumerate(zip(langs, spelled, strict=True)):
            vocabulary[lang][word] = i
        by_number = sc.broadcast((langs, spelled))
        numbers = materialise(texts.mapInArrow(_number(sc.broadcast(dict(vocabulary))), "ids binary"), "numbers")
    for k in range(2, LONGEST + 1):
        if pruned:
            packed = numbers.mapInArrow(_count_pairs(shared, buckets), "bucket int, keys binary, counts binary")
            pairs = materialise(packed.repartition(buckets, "bucket").mapInArrow(_add_pairs(LEAST), "key long, f long"), f"pairs-{k}")
            level = pairs.mapInArrow(_spell(by_number, list(shared)), "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))
            pruned = k < LONGEST and pairs.count() <= MOST_GRAMS
            if pruned:
                keys = pairs.select("key").toArrow().column(0).to_numpy()  # at most MOST_GRAMS numbers
                shared = [*shared, sc.broadcast(np.sort(keys))]
        elif rows:
            level = materialise(_plain(texts, k), f"grams-{k}")
        else:
            break
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    out = materialise(out, "levels")
    if numbers is not None:
        discard(numbers)
    return totals, out


def score_phrases(levels: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates in levels (lang, phrase, k, f) that no longer phrase covers."""
    long = levels.where("k > 1").withColumnRenamed("f", "a")
    cuts = long.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    parts = levels.select("lang", "phrase", "f")
    for part, out in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.toDF("lang", part, out), ["lang", part])
    wide = "cast({} as decimal(20,0))"
    score = F.expr(f"{wide.format('a')} * {SCALE} div ({wide.format('l')} + {wide.format('r')})")  # exact, beyond 64 bits
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("k") - m), lambda i: F.array_join(F.slice(w, i + 1, m), " "))))
    cover = long.where("k > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(cover, ["lang", "phrase"], "left").where(F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {COVER}"))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def mine(documents: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language of documents (lang, text): lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is und; empty texts have no words; repeated rows count one by one; ties in
    score and count go by the phrase's bytes; other columns are ignored; an empty table, or one without a word that
    occurs LEAST times, gives no rows.
    """
    totals, levels = count_phrases(documents)
    scored = materialise(score_phrases(levels), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salts = max(1, scored.count() // RANKED)
    first = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    best = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) as p from d),
w as (select lang, regexp_extract_all(p, '[^ 	]+') as w from p),
t as (select lang, cast(sum(len(w)) as bigint) as n from w group by 1),
c as (select lang, w, unnest(range(1, {LONGEST + 1})) as k from w where len(w) > 0),
g as (select lang, k, unnest(list_transform(range(greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1 : i + k], ' '))) as phrase from c),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= {LEAST}),
q as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1),
u as (select *, unnest(range(1, k)) as cut from q),
s as (select u.lang, u.phrase, u.k, u.a, cut, x.f as l, y.f as r, cast((u.a::hugeint * {SCALE}) // (x.f + y.f) as bigint) as score from u
  join f x on x.lang = u.lang and x.phrase = array_to_string(u.w[1 : cut], ' ') join f y on y.lang = u.lang and y.phrase = array_to_string(u.w[cut + 1 :], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
m as (select *, unnest(range(2, k)) as m from q where k > 2),
i as (select lang, a, unnest(list_transform(range(k - m + 1), lambda j: array_to_string(w[j + 1 : j + m], ' '))) as phrase from m),
v as (select lang, phrase, max(a) as longer from i group by all),
o as (select b.* from b left join v using (lang, phrase) where longer is null or 100 * longer::hugeint < {COVER} * a::hugeint),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select lang, rank, phrase, a, l, r, n, score from r join t using (lang) where rank <= {TOP}
"""
