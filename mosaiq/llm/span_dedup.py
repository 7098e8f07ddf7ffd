"""Substring dedup by sliding sentence spans.

A text is cut into sentences: runs that end with marks out of ``.!?`` or line ends. Sentences without words are not
counted. A run begins at every sentence and takes the next ones, two sentences at least, until it holds LEAST words;
short sentences make a run longer, none is passed over, so long blocks of short lines are seen as well. Where the text
ends before that, the run ends with it and holds ENDING sentences at least, or the whole of a short text of two or more;
so endings and short texts have runs of their own. A text of one sentence has none. Runs are compared without case and with white space collapsed. Where a run occurs more
than once in the corpus, the first occurrence (by doc_id, then text hash, then place) stays and all sentences that
another one covers go.

Two shuffles find the repeats: one counts 64-bit hashes, summed in each task before; the other brings only
runs whose hash occurred twice together, where 32 more bits must agree. Runs that a great many documents share are
dealt over salts in both. The texts move once, to meet their places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from mosaiq.llm.common import discard, hot_keys, materialise, meet

#: Sentences and words that a run holds at least; sentences of a run that ends with its text before that many words.
SENTENCES, LEAST, ENDING = 2, 12, 3
#: A place is PLACE * first sentence + sentences; a run has LEAST sentences at most.
PLACE = 16
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z")


def sentences(text: str) -> list[str]:
    """Pieces that give the text when joined; each ends with its marks and line ends."""
    return _SENTENCE.findall(text)


def _runs(pieces: list[str]) -> Iterator[tuple[int, str]]:
    """Place and normal form of each run; the first sentence is counted among those with words."""
    norm = [w for w in (p.lower().split() for p in pieces) if w]
    lines = [" ".join(w) for w in norm]
    total = [0]
    for w in norm:
        total.append(total[-1] + len(w))
    end, n = 0, len(norm)
    for at in range(n - SENTENCES + 1):
        end = max(end, at + SENTENCES)
        while total[end] - total[at] < LEAST and end < n:
            end += 1
        if total[end] - total[at] < LEAST and 0 < at > n - ENDING:
            return
        yield PLACE * at + end - at, "\n".join(lines[at:end])


def _hash(run: str) -> tuple[int, int]:
    """64 and 32 bits, signed."""
    h = xxhash.xxh3_128_intdigest(run.encode("utf-8", "replace"))
    low, high = h & 0xFFFFFFFFFFFFFFFF, h >> 64 & 0xFFFFFFFF
    return low - (low >> 63 << 64), high - (high >> 31 << 32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[int] = []

    def summed() -> pa.RecordBatch:
        h, n = np.unique(np.array(held, dtype=np.int64), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    for b in batches:
        for text in b.column(0):
            held += [_hash(r)[0] for _, r in _runs(sentences(text.as_py()))]
            if len(held) >= 500_000:
                yield summed()
    if held:
        yield summed()


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def rows() -> pa.RecordBatch:
        h, h2, d, t, at = zip(*held, strict=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(h2, pa.int32()), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(at, pa.int32())], ["h", "h2", "d", "t", "at"])

    for b in batches:
        for text, d, t in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            held += [(*_hash(r), d, t, at) for at, r in _runs(sentences(text.as_py()))]
            if len(held) >= 50_000:
                yield rows()
    if held:
        yield rows()


def _cut(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the sentences of the runs at these places; sentences before; sentences removed."""
    pieces = sentences(text or "")
    if not places:
        return text, sum(bool(p.split()) for p in pieces), 0
    gone = {p // PLACE + k for p in places for k in range(p % PLACE)}
    kept, at, removed = [], -1, 0
    drop = False
    for p in pieces:
        if p.split():
            at += 1
            drop = at in gone
            removed += drop
        if not drop:  # a piece without words goes with the sentence before it
            kept.append(p)
    return "".join(kept), at + 1, removed


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def dedup_spans(documents: DataFrame) -> DataFrame:
    """documents with repeated runs cut out of `text`, and two more columns: n_sentences, n_removed.

    Null texts stay null and have no sentences; empty texts stay. Rows with equal doc_id and text count as one document:
    none is a repeat of the other and both keep the same sentences. A null doc_id comes before all others. Other
    columns stay as they are; columns named n_sentences or n_removed are replaced. An empty table gives no rows.
    """
    columns = [c for c in documents.columns if c not in ("n_sentences", "n_removed")]
    own = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("d"), text_hash(F.col("text")).alias("t")).where("text is not null and text != ''")
    repeated = materialise(own.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    hot = hot_keys(repeated, ["h"], "n")
    spans = own.mapInArrow(_spans, "h long, h2 int, d long, t long, at int")
    found = materialise(meet(spans, repeated.select("h"), ["h"], hot, ["d", "t", "at"], "left_semi"), "spans")
    first = found.groupBy("h", "h2").agg(F.min(F.struct("d", "t", "at")).alias("first"), F.max(F.struct("d", "t", "at")).alias("last"), F.count(F.lit(1)).alias("n")).where("first != last")
    first = materialise(first.drop("last"), "first-spans")
    later = meet(found, first.drop("n"), ["h", "h2"], hot_keys(first, ["h", "h2"], "n"), ["d", "t", "at"]).where(~F.struct("d", "t", "at").eqNullSafe(F.col("first")))
    places = materialise(later.groupBy("d", "t").agg(F.collect_set("at").alias("__places")), "places")
    discard(repeated, first)
    discard(found)
    # the columns go under numbers, so that none of them can clash with the names used here
    numbered = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(columns)]
    keyed = documents.select(*numbered, F.col("doc_id").cast("long").alias("__id"), text_hash(F.col("text")).alias("__t"))
    joined = keyed.join(places.withColumnsRenamed({"d": "__d", "t": "__u"}), F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__u")), "left")
    schema = documents.select(*columns).schema
    field = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_cut(x.as_py(), p) for x, p in zip(b.column(field), b.column(len(columns)).to_pylist(), strict=True)]
            text, n, gone = zip(*done, strict=True) if done else ((), (), ())
            arrays = [pa.array(text, pa.string()) if k == field else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int32()), pa.array(gone, pa.int32())], [*columns, "n_sentences", "n_removed"])

    out = joined.select(*(f"__{k}" for k in range(len(columns))), "__places")
    return out.mapInArrow(cut, schema.add("n_sentences", IntegerType()).add("n_removed", IntegerType()))


def digest(documents: DataFrame) -> DataFrame:
    """What op5 returns: the texts that stay, and how many sentences went."""
    return dedup_spans(documents.select("doc_id", "text"))


#: The same in SQL; texts stand for their hashes.
ORACLE = r"""
with d as (select distinct doc_id, text from documents where text is not null and text != ''),
p as (select doc_id, text, unnest(s) as piece, unnest(range(len(s))) as k from (select doc_id, text, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+$') as s from d)),
q as (select *, sum(cast(regexp_matches(piece, '[^\s]') as int)) over (partition by doc_id, text order by k) - 1 as pos,
  regexp_matches(piece, '[^\s]') as own, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) as line from p),
w as (select doc_id, text, cast(pos as int) as pos, line, len(string_split(line, ' ')) as words from q where own),
v as (select *, sum(words) over (partition by doc_id, text order by pos) as total from w),
u as (select *, max(pos) over (partition by doc_id, text) as final from v),
z as (select a.doc_id, a.text, a.pos, b.pos as last from u a join u b on a.doc_id = b.doc_id and a.text = b.text and b.pos between a.pos + 1 and a.pos + 11
  where (b.total - a.total + a.words >= 12 and (b.pos = a.pos + 1 or b.total - b.words - a.total + a.words < 12))
    or (b.total - a.total + a.words < 12 and b.pos = a.final and (a.pos = 0 or b.pos - a.pos >= 2))),
runs as (select z.doc_id, z.text, z.pos, last - z.pos + 1 as k, string_agg(line, chr(10) order by v.pos) as run from z join v on v.doc_id = z.doc_id and v.text = z.text and v.pos between z.pos and last group by all),
firsts as (select run, first(struct_pack(d := doc_id, t := text, a := pos) order by doc_id, text, pos) as f from runs group by run having count(*) > 1),
gone as (select distinct doc_id, text, pos + unnest(range(k)) as pos from runs join firsts using (run) where not (f.d = doc_id and f.t = text and f.a = pos)),
cut as (select q.doc_id, q.text, string_agg(case when g.pos is null then piece else '' end, '' order by k) as kept,
    cast(max(q.pos) + 1 as int) as n_sentences, cast(count(distinct g.pos) as int) as n_removed
  from q left join gone g on g.doc_id = q.doc_id and g.text = q.text and g.pos = q.pos group by 1, 2)
select o.doc_id, coalesce(cut.kept, o.text) as text, coalesce(n_sentences, 0) as n_sentences, coalesce(n_removed, 0) as n_removed
from documents o left join cut on cut.doc_id = o.doc_id and cut.text = o.text
"""
