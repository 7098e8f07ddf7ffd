"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are small integers, so the plan is made on the histogram of piece lengths (at most `capacity` rows, whatever
the corpus) instead of on documents: which lengths share a sequence, how often, at which offset. Pieces of one
length are interchangeable; each takes the place that its rank among them names. The rank comes from a counter
kept while a task tokenises, plus the counts of the tasks before it, so no token is ever shuffled.

Plan: pieces above a third of the capacity pair greedily, each longest one with the longest that still fits, at
most two to a sequence; pieces up to a third then go, longest first, where they leave the smallest gap.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise
from mosaiq.llm.tokens import default_path, encoder

CAPACITY = 1024
END_ID = 2
#: Rows of the rank offsets that may be broadcast (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pieces that one Arrow batch of the tokeniser holds, at most 4 KB each.
PIECES_PER_BATCH = 2_000
_PIECES = "doc_id long, piece int, start long, length long, input_ids binary, task long, nth long"


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, first_sequence, offset) for so many pieces of each length.

    The pieces of that length with ranks first_rank..last_rank lie, one each, in the sequences from first_sequence
    on, at that offset. Sequences that are filled alike are one group with a count, so the work depends on the
    lengths that occur, not on how often they do.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(what: tuple[int, ...], many: int) -> None:
        gap = capacity - sum(what)
        if gap not in room:
            room[gap] = []
            bisect.insort(gaps, gap)
        room[gap].append((what, many))

    def take(gap: int, most: int) -> tuple[tuple[int, ...], int]:
        what, have = room[gap].pop()
        if have > most:
            room[gap].append((what, have - most))
        if not room[gap]:
            del room[gap]
            gaps.remove(gap)
        return what, min(have, most)

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fits = large[: bisect.bisect_right(large, capacity - n)]
        if fits and fits[-1] == n and left[n] == 1:
            fits.pop()
        if not fits:
            pair, many = (n,), left[n]
        else:
            pair = (n, fits[-1])
            many = left[n] // 2 if fits[-1] == n else min(left[n], left[fits[-1]])
        for x in pair:
            left[x] -= many
        for x in {*pair}:
            if not left[x]:
                large.remove(x)
        put(pair, many)
    for n in sorted((x for x in left if left[x]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            gap = gaps[at] if at < len(gaps) else capacity
            each = min(gap // n, left[n])
            old, many = take(gap, left[n] // each) if at < len(gaps) else ((), left[n] // each)
            left[n] -= each * many
            put(old + (n,) * each, many)
    rows, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for what, many in (g for gap in gaps for g in room[gap]):
        offset = 0
        for n in what:
            rows.append((n, ranks[n], ranks[n] + many - 1, sequence, offset))
            ranks[n] += many
            offset += n
        sequence += many
    return rows


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        names = ["doc_id", "piece", "start", "length", "input_ids", "task", "nth"]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, pieces, starts, lengths, tokens, nth = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(tokens, pa.binary()), pa.array([task] * len(ids), pa.int64()), pa.array(nth, pa.int64())], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                start = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    length = stop - start
                    rows.append((doc_id, k, start, length, ids[4 * start : 4 * stop], int(seen[length])))
                    seen[length] += 1
                    start = stop
                    if len(rows) >= PIECES_PER_BATCH:
                        yield batch()
        if rows:
            yield batch()

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Per piece of documents (doc_id, text): doc_id, piece, start, length, input_ids, sequence_id, offset.

    input_ids: little-endian unsigned 32-bit ids, end_id after each document. Only documents longer than the
    capacity are cut; their first piece may be shorter, all others are full. Null text counts as empty and gives the
    end id alone. Repeated rows and rows with one doc_id are packed one by one; ties in length keep no promised order;
    doc_id may be null; other columns are ignored; an empty table gives no rows.
    """
    pieces = materialise(
        documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenise(vocabulary or default_path(), capacity, end_id), _PIECES),
        "pieces",
    )
    return _place(pieces, capacity)


def _place(pieces: DataFrame, capacity: int) -> DataFrame:
    spark = pieces.sparkSession
    counts = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = np.array(sorted(best_fit_plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4]))  # its size depends on the capacity only

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = shared.value
        at = np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = pieces.join(offsets, ["length", "task"]).withColumn("place", place("length", F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "input_ids", "place.sequence_id", "place.offset")


def digest(documents: DataFrame) -> DataFrame:
    """What op1 returns."""
    return pack_documents(documents).select("doc_id", "piece", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "sequence_id", "offset")
