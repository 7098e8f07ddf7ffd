"""Quality classifier: a byte-level convolutional network, trained and applied with numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned
filters over 8 bytes run along a chunk and are max-pooled to one value each. A document's features are the mean and
the maximum of these values over its chunks; a logistic unit turns them into the probability of label 1.

Training takes whole labelled rows in order of a hash of doc_id, until there are MAX_ROWS of them or the next one would
bring their texts above MAX_BYTES: both bound what the driver holds. Training and scoring use every chunk of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: rows, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 4_000, 1 << 25
CHUNK, STEP = 256, 224
DIMS, WIDTH, HOP, FILTERS = 4, 8, 4, 24
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Steps that a small training set gets at least.
LEAST_STEPS = 800
THRESHOLD = 0.3
#: Chunks that are scored at once.
AT_ONCE = 1024


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; 0 marks held-out rows. Null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks (n, CHUNK) that cover all bytes; zeros after the end; one chunk of zeros for no bytes."""
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {
            "bytes": r.normal(0, 0.5, (256, DIMS)).astype(np.float32),
            "filters": r.normal(0, 1 / np.sqrt(WIDTH * DIMS), (WIDTH * DIMS, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "weights": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def windows(self, x: np.ndarray) -> np.ndarray:
        hop = self.p["bytes"][x].reshape(len(x), CHUNK // HOP, HOP * DIMS)
        return np.concatenate([hop[:, :-1], hop[:, 1:]], axis=2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((self.windows(x) @ self.p["filters"]).max(axis=1) + self.p["shift"], 0)

    def probability(self, pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(pooled, starts, axis=0) / counts[:, None]
        top = np.maximum.reduceat(pooled, starts, axis=0)
        z = np.concatenate([mean, top], axis=1) @ self.p["weights"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Network:
        """Adam on the mean logistic loss over documents, each an array of chunks."""
        r = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t = 0
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(docs)))
        steps = epochs * -(-len(docs) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                grads = self._gradients([docs[k] for k in own], y[own])
                t += 1
                rate = RATE * (1 - (t - 1) / steps)
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate(docs)
        counts = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        owner = np.repeat(np.arange(len(docs)), counts)
        parts = [slice(i, i + AT_ONCE) for i in range(0, len(x), AT_ONCE)]  # a long text has many chunks
        best, at = [], []
        for part in parts:
            z = self.windows(x[part]) @ self.p["filters"]
            at.append(z.argmax(axis=1))  # (chunks, filters)
            best.append(np.take_along_axis(z, at[-1][:, None, :], axis=1)[:, 0])
        raw = np.concatenate(best) + self.p["shift"]
        pooled = np.maximum(raw, 0)
        mean = np.add.reduceat(pooled, starts, axis=0) / counts[:, None]
        top = np.maximum.reduceat(pooled, starts, axis=0)
        both = np.concatenate([mean, top], axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["weights"] + self.p["bias"], -30, 30)))
        d = ((p - y) / len(docs)).astype(np.float32)
        d_both = d[:, None] * self.p["weights"]
        first = pooled == top[owner]
        share = first / np.maximum(np.add.reduceat(first, starts, axis=0, dtype=np.float32), 1)[owner]
        d_raw = (d_both[:, :FILTERS] / counts[:, None])[owner] + d_both[:, FILTERS:][owner] * share
        d_raw = (d_raw * (raw > 0)).astype(np.float32)
        d_vectors, d_filters = np.zeros((256, DIMS)), np.zeros_like(self.p["filters"])
        for part, own in zip(parts, at, strict=True):
            rows, g = np.arange(len(own))[:, None], d_raw[part]
            d_filters += np.einsum("nf,nfk->kf", g, self.windows(x[part])[rows, own])
            d_bytes = (g[:, :, None] * self.p["filters"].T[None]).reshape(-1, DIMS)
            where = x[part][rows[:, :, None], own[:, :, None] * HOP + np.arange(WIDTH)].reshape(-1)
            d_vectors += np.stack([np.bincount(where, weights=d_bytes[:, k], minlength=256) for k in range(DIMS)], axis=1)
        return {
            "bytes": d_vectors.astype(np.float32),
            "filters": d_filters,
            "shift": d_raw.sum(axis=0),
            "weights": (d[:, None] * both).sum(axis=0),
            "bias": d.sum(keepdims=True),
        }


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Network | None:
    """A network fitted to labels.quality (0 or 1) of rows whose remainder isn't 0; None if there are none.

    Labels without doc_id or quality are left out; of several for one doc_id the greatest counts. Repeated rows of a
    document are trained on one by one, null text as an empty one. max_rows and max_bytes bound the sample, in whole rows.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    own = own.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("__y")).withColumn("__place", F.xxhash64("__id"))
    ids = own.orderBy("__place", "__id").limit(max_rows)  # at most max_rows rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").alias("__doc"), text.alias("__text")).join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    key = ["__place", "__id", "__size", "__crc"]
    rows = rows.select("__place", "__id", F.octet_length("__text").alias("__size"), F.crc32(F.col("__text").cast("binary")).alias("__crc"), "__text", "__y").where(F.col("__size") <= max_bytes)
    sizes = rows.select(*key).orderBy(*key).limit(max_rows).collect()  # at most max_rows rows of four numbers
    total = np.cumsum([r["__size"] for r in sizes])
    many = int(np.searchsorted(total, max_bytes, side="right"))
    if not many:
        return None
    bound = F.struct(*(F.lit(v).cast(t) for v, t in zip(sizes[many - 1], ("long", documents.schema["doc_id"].dataType, "int", "long"), strict=True)))
    rows = rows.where(F.struct(*(F.col(c).cast(t) for c, t in zip(key, ("long", documents.schema["doc_id"].dataType, "int", "long"), strict=True))) <= bound)
    rows = rows.orderBy(*key).limit(many).select("__text", "__y").collect()  # at most max_bytes bytes
    docs = [chunks(r["__text"].encode("utf-8", "replace")) for r in rows]
    return Network().fit(docs, np.array([r["__y"] for r in rows], dtype=np.float32))


def score_documents(documents: DataFrame, network: Network | None) -> DataFrame:
    """documents with two more columns: score (probability of label 1) and predicted (1 if score >= THRESHOLD, else 0).

    Null text counts as empty and gets the score of a chunk of zeros. Repeated rows get equal scores. Other columns
    stay; columns named score or predicted are replaced. Without a network every score is 0.5.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    parameters = network and network.p

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network.__new__(Network)
        net.p = parameters
        for series in texts:
            out: list[float] = []
            held: list[np.ndarray] = []

            def flush(held: list[np.ndarray] = held, out: list[float] = out) -> None:
                if held:
                    counts = np.array([len(c) for c in held])
                    x = np.concatenate(held)
                    pooled = np.concatenate([net.pooled(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)])
                    out.extend(net.probability(pooled, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts).tolist())
                    held.clear()

            size = 0
            for t in series:
                held.append(chunks((t or "").encode("utf-8", "replace")))
                size += len(held[-1])
                if size >= 4 * AT_ONCE:
                    flush()
                    size = 0
            flush()
            yield pd.Series(out, dtype="float64")

    value = score(F.coalesce(F.col("text").cast("string"), F.lit(""))) if parameters else F.lit(0.5)
    return documents.select(*kept).withColumn("score", value).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What op9 returns."""
    scored = score_documents(documents.select(F.col("doc_id"), "text"), train(documents, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that the classifier, trained on labelled documents, doesn't reject; all their columns as they are.

    Null and empty texts are scored like any other, repeated rows stay or go together, and without labels to learn
    from every document stays. Columns named score or predicted would be lost, so they are carried under other names.
    """
    columns = documents.columns
    own = documents.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)), F.col("text"))
    kept = score_documents(own, train(labelled, labels)).where("predicted = 1")
    return kept.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(columns)))
