"""LM scoring: cross-entropy difference between a target and a background n-gram model.

Both models are byte n-gram models over the lower-cased corpus, without a cut of bytes or n-grams: 6-grams in op2,
4-grams by default. Counts cover every byte of every document: the target counts the documents labelled as good, the
background all others, so no text is in both. Order, vocabulary and smoothing are the same for both: each order is drawn towards the next shorter one by a Dirichlet
prior, the shortest towards equal shares of all bytes that occur and one more (of 48 at least). A document's score is
the mean over its bytes of target loss minus background loss; lower is closer to the target.

The n-grams are a distributed table with a row for each that occurs, so it grows with the corpus. Documents are dealt
into blocks of about BLOCK bytes; each block counts its own n-grams, and is sent the losses of just these, so no model
is ever held whole. Shuffled are the texts (twice) and the distinct n-grams of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import common
from mosaiq.llm.common import BROADCAST_IDS, discard, hot_keys, materialise, meet

ORDER = 4
#: Order of op2; also the most that a 64-bit key holds beside a document's place.
LONGEST = 6
PRIOR = 8.0
#: Bytes of text in a block on average, and bytes that are counted or scored at once.
BLOCK = 1 << 24
SLICE = 1 << 22
#: Documents in a slice at most: 16 bits of the key.
SLICE_ROWS = 1 << 16
#: Begins a text; UTF-8 never has this byte.
PAD = b"\xff"


def _slices(texts: pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """First row and lower-cased bytes of about SLICE bytes of text at once; a long text is a slice of its own."""
    first, got, size = 0, [], 0
    for k, text in enumerate(texts):
        got.append((text.as_py() or "").encode("utf-8", "replace").lower())
        size += len(got[-1])
        if size >= SLICE or len(got) == SLICE_ROWS:
            yield first, got
            first, got, size = k + 1, [], 0
    if got:
        yield first, got


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the order - 1 before it as a number, and the texts' lengths; a text begins after PAD."""
    lengths = np.array([len(t) for t in texts])
    raw = np.frombuffer((PAD * (order - 1)).join([b"", *texts]), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths + order - 1)
    own = np.ones(len(raw), dtype=bool)
    grams = raw.copy()
    for k in range(1, order):
        own[ends - lengths - k] = False
        grams[k:] |= raw[:-k] << np.uint64(8 * k)
    return grams[own], lengths


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]])[: len(ordered)])


def _count(order: int):
    def run(table: pa.Table) -> pa.Table:
        targets = np.array(table.column("target").to_pylist(), dtype=bool)
        keys, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        for first, texts in _slices(table.column("text")):
            grams, lengths = _grams(texts, order)
            k = np.sort(grams << np.uint64(1) | np.repeat(targets[first : first + len(texts)], lengths).astype(np.uint64))
            at = _starts(k)
            keys.append(k[at])
            counts.append(np.diff(np.append(at, len(k))))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        grams = keys >> np.uint64(1)
        at = _starts(grams)
        n = np.add.reduceat(counts, at) if len(at) else counts
        hits = np.add.reduceat(np.where(keys & np.uint64(1), counts, 0), at) if len(at) else counts
        n = n - hits
        block = np.full(len(at), table.column("block")[0].as_py(), dtype=np.int64)
        return pa.table([pa.array(block), pa.array(grams[at].astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(hits.astype(np.int64))], ["block", "gram", "background", "target"])

    return run


def _blocks(documents: DataFrame) -> tuple[DataFrame, int]:
    """documents as doc_id, text and block, and the number of blocks; equal rows share a block."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(8, -(-size // BLOCK))
    return d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many))), many


def count_grams(blocks: DataFrame, targets: DataFrame, order: int) -> DataFrame:
    """block, gram, background, target: how often each n-gram of a block occurs in its other texts and in target texts.

    targets: doc_id of the documents of the target corpus; repeats count once, unknown ids and nulls not at all.
    """
    flags = targets.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().withColumn("__target", F.lit(True))
    flags = F.broadcast(flags) if flags.count() <= BROADCAST_IDS else flags  # else the texts are shuffled to their ids
    flagged = blocks.join(flags, F.col("doc_id") == F.col("__id"), "left").select("block", "text", F.coalesce("__target", F.lit(False)).alias("target"))
    return flagged.groupBy("block").applyInArrow(_count(order), "block long, gram long, background long, target long")


def losses(counts: DataFrame, order: int) -> DataFrame:
    """gram and delta, target loss minus background loss, of each n-gram in counts (gram, background, target)."""
    sums = [F.sum(c).alias(c) for c in ("background", "target")]
    tables = {order: materialise(counts.groupBy("gram").agg(*sums), "grams")}
    for k in range(order - 1, 0, -1):
        tables[k] = materialise(tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(*sums), "grams")
    shorter = tables[1].agg((1 / F.greatest(F.lit(48), F.count(F.lit(1)) + 1)).alias("p_background")).select(F.lit(0).cast("long").alias("suffix"), "p_background", F.col("p_background").alias("p_target"))
    for k in range(1, order + 1):
        prefix, suffix = F.shiftright("gram", 8), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
        rows = tables[k].withColumn("prefix", prefix).withColumn("suffix", suffix)
        contexts = rows.groupBy("prefix").agg(F.sum("background").alias("all_background"), F.sum("target").alias("all_target"))
        p = [((F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col(f"all_{c}") + PRIOR)).alias(f"p_{c}") for c in ("background", "target")]
        shorter = rows.join(contexts, "prefix").join(shorter, "suffix").select(F.col("gram").alias("suffix"), *p)
    out = materialise(shorter.select(F.col("suffix").alias("gram"), (F.log("p_background") - F.log("p_target")).alias("delta")), "losses")
    discard(*tables.values())
    return out


def _score(order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, delta = np.empty(0, dtype=np.uint64), np.empty(0)
        if right.num_rows:
            known, delta = right.column("gram").to_numpy().astype(np.uint64), right.column("delta").to_numpy()
            by = np.argsort(known)
            known, delta = known[by], delta[by]
        sizes, scores = [], []
        for _, texts in _slices(left.column("text")) if left.num_rows else ():
            grams, lengths = _grams(texts, order)
            place = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
            keys = np.sort(grams << np.uint64(16) | place)
            grams = keys >> np.uint64(16)
            at = _starts(grams)
            found = np.searchsorted(known, grams[at])
            if len(at) and (found[-1] >= len(known) or (known[found] != grams[at]).any()):
                raise ValueError("an n-gram was not counted: documents must give the same rows whenever they are read")
            each = np.repeat(delta[found], np.diff(np.append(at, len(keys))))
            sums = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), weights=each, minlength=len(texts))
            sizes += lengths.tolist()
            scores += [s / n if n else None for s, n in zip(sums.tolist(), lengths.tolist(), strict=True)]
        ids = left.column("doc_id").cast(pa.int64()) if left.num_rows else pa.array([], pa.int64())
        return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_symbols", "score"])

    return run


def score_documents(documents: DataFrame, targets: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_symbols, score (target minus background cross-entropy, nats).

    Null and empty texts have no symbols and a null score. Rows with a null doc_id belong to the background. Repeated rows count and are scored one by one; other columns
    are ignored; an empty table gives no rows; without targets the target model is uniform. order: 1 to LONGEST bytes.
    """
    if not 1 <= order <= LONGEST:
        raise ValueError(f"order must be 1 to {LONGEST}")
    blocks, many = _blocks(documents)
    counts = materialise(count_grams(blocks, targets, order), "block-grams")
    hot = None
    if many > common.FEW_ROWS:  # an n-gram has a row in each block at most
        often = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > common.FEW_ROWS)
        hot = hot_keys(materialise(often, "common-grams"), ["gram"], "n")
    answers = meet(counts, losses(counts, order), ["gram"], hot, ["block"]).select("block", "gram", "delta")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order), "doc_id long, n_symbols long, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What op2 returns: the target corpus is the documents labelled with quality 1 and not toxic."""
    return score_documents(documents, labels.where("quality = 1 and toxic = 0"), LONGEST)
