"""Toxicity: gradient-boosted trees over dense features of a whole text, calibrated by isotonic regression.

Features: densities and counts of lexicon words, their closeness to words of the second person, capitals, punctuation
and obfuscation. The lexicon is learned: beginnings of words (and whole words) that stand in far more toxic than other
texts of the training sample, besides the plain insults of SEED. Look-alike characters (1d10t), stretched letters
(idiooot) and marks inside words (i.d.i.o.t) are undone before a word is looked up a second time; a hit of this kind
only counts as obfuscated.

The sample is dealt into FOLDS by a hash. A fold's features come from the lexicon of the others, so that the trees don't
trust words that only their own rows made look toxic, and its scores from trees of the others fit the isotonic steps.

Training takes whole labelled rows in order of a hash of doc_id, at most MAX_ROWS of them and MAX_BYTES of text, on the
driver; every whole text is scored on the executors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: rows, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 4_000, 1 << 24
THRESHOLD = 0.7
FOLDS = 4
#: Trees: number, depth, bins of a feature, rate, weight of the prior, least weight of a leaf.
TREES, DEPTH, BINS, RATE, PRIOR, LEAF = 80, 3, 64, 0.1, 1.0, 2.0
#: Lexicon: characters of the beginnings that are looked at, entries at most, toxic texts that an entry needs.
STEMS, ENTRIES, SUPPORT = range(3, 10), 4_000, 3
#: Entries from this log-odds on are strong, from the second one on very strong.
STRONG, VERY = 1.5, 3.0
#: Words between a lexicon word and one of the second person that still count as close.
NEAR = 6
#: Characters of a text that are looked at once, and words that a task remembers.
SLICE, REMEMBERED = 1 << 18, 1 << 17

# fixed values: plain insults, words of the second person, look-alike characters
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "fool", "filth", "vermin", "hate", "kill")
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "vosotros")
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

WORD = re.compile(r"[^\W_]+")
MARKED = re.compile(r"[$@]?[^\W_]+(?:[@$!|+*._&%#-]+[^\W_]+)+|[$@|!][^\W_]+")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_TRANSLATE = str.maketrans(LOOKALIKES)
_MARKS = re.compile(r"[\W_]+")
_RUNS = re.compile(r"(.)\1{2,}")
#: Characters are told apart below this code; those from it on count as letters without case.
_CODES = 0x250
_UPPER, _ALPHA = (np.array([f(chr(c)) for c in range(_CODES)] + [last]) for f, last in ((str.isupper, False), (str.isalpha, True)))
_MARK = np.array([chr(c) in "@$!|+*._&%#-" for c in range(_CODES)] + [False])
_PUNCT = {"exclamation": "!", "question": "?", "asterisk": "*", "symbols": "@#$%^&"}
NAMES = ("per_word", "strong_per_word", "very_per_word", "weight_per_word", "log_hits", "log_strong", "log_very", "largest", "distinct", "seed_per_word", "seed_hits", "near_per_hit", "near_hits", "second_per_word", "capitals", "shouted", "exclamation", "question", "asterisk", "symbols", "stretched", "hidden_per_word", "hidden_hits", "digits_inside", "log_words", "mean_length", "variety")


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; 1 marks held-out rows. Null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def slices(text: str) -> Iterator[str]:
    """text in parts of about SLICE characters, cut at blanks."""
    at = 0
    while at < len(text):
        stop = at + SLICE
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield text[at:stop]
        at = stop


def plain_word(token: str) -> str:
    """token without look-alikes, stretched letters and marks."""
    return _RUNS.sub(r"\1", _MARKS.sub("", token.strip(".,;:!?\"'()").lower().translate(_TRANSLATE)))


def stems(word: str) -> Iterator[str]:
    """The entries that a word can meet: its beginnings, and itself marked as whole."""
    for n in STEMS:
        if n <= len(word):
            yield word[:n]
    yield word + "$"


@dataclass
class Lexicon:
    weights: dict[str, float]

    def __post_init__(self):
        self.begins = {s[:n] for s in self.weights for n in range(STEMS[0], len(s))}

    def weight(self, word: str) -> float:
        """The largest weight among a word's beginnings and itself; 0 for none."""
        best = self.weights.get(word + "$", 0.0)
        for n in range(STEMS[0], min(len(word), STEMS[-1]) + 1):
            begin = word[:n]
            best = max(best, self.weights.get(begin, 0.0))
            if begin not in self.begins:
                break
        return best


def learn_lexicon(words: list[set[str]], toxic: np.ndarray) -> Lexicon:
    """Entries with smoothed log-odds above 1 among texts, given as sets of words; the ENTRIES with most evidence."""
    hits, others = Counter(), Counter()
    for own, y in zip(words, toxic, strict=True):
        (hits if y else others).update({s for w in own for s in stems(w)})
    n, m = max(1, int(toxic.sum())), max(1, len(toxic) - int(toxic.sum()))
    odds = {}
    for s, k in hits.items():
        w = float(np.log((k + 0.25) / (n + 0.5)) - np.log((others[s] + 0.5) / (m + 1.0)))
        if k >= SUPPORT and w > 1:
            odds[s] = (w * k, w)
    best = sorted(odds, key=lambda s: (-odds[s][0], s))[:ENTRIES]
    return Lexicon({s: odds[s][1] for s in best})


def text_words(text: str) -> set[str]:
    return {w for part in slices(text) for w in WORD.findall(part.lower())}


class Memory(dict):
    """Words met before: -1 for the second person, the lexicon's weight for others, more by _SEEDED for SEED."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        v = -1.0 if word in SECOND else self.lexicon.weight(word) + (_SEEDED if word in SEED else 0.0)
        self[word] = v
        return v

    def hidden(self, token: str) -> bool:
        """Whether a token is a plain insult, or a very strong word, once it is undone, and not as it stands."""
        word = plain_word(token)
        return len(word) > 2 and word != token and (word in SEED or self.lexicon.weight(word) >= VERY)


_SEEDED = 1000.0


def features(text: str, memory: Memory) -> list[float]:
    """NAMES of a text."""
    n = strong = very = seeds = near = hidden = inside = length = shouted = stretched = 0
    total = largest = 0.0
    codes = np.zeros(_CODES + 1, np.int64)
    seen: set[str] = set()
    found: set[str] = set()
    hits: list[int] = []
    second: list[int] = []
    for part in slices(text):
        low = part.lower()
        words = WORD.findall(low)
        if len(memory) > REMEMBERED:
            memory.clear()
        for i, v in enumerate(map(memory.__getitem__, words)):
            if v:
                if v < 0:
                    second.append(n + i)
                    continue
                hits.append(n + i)
                if v >= _SEEDED:
                    seeds += 1
                    v -= _SEEDED
                total += v
                strong += v >= STRONG
                very += v >= VERY
                largest = max(largest, v)
                if len(found) < 1000:
                    found.add(words[i])
        n += len(words)
        if len(seen) < 4096:
            seen.update(words)
        length += sum(map(len, words))
        shouted += len(SHOUTED.findall(part))
        c = np.minimum(np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32), _CODES)
        codes += np.bincount(c, minlength=_CODES + 1)
        alpha = np.concatenate([[False], _ALPHA[c], [False]])
        same = (c[1:] == c[:-1]) & alpha[2:-1]
        run = same[1:] & same[:-1]
        stretched += int(run.sum()) - int((run[1:] & run[:-1]).sum())
        marked = np.concatenate([[False], _MARK[c], [False]])
        if (marked[1:-1] & alpha[2:]).any():  # else no pattern below can match
            hidden += sum(map(memory.hidden, MARKED.findall(low)))
        alone = alpha[1:-1] & ~alpha[:-2] & ~alpha[2:]
        if (alone[2:] & alone[:-2]).any():
            hidden += sum(map(memory.hidden, SPACED.findall(low)))
        digit = np.concatenate([[False], (c >= 48) & (c <= 57), [False]])
        if (digit[1:] & alpha[:-1]).any() or (digit[:-1] & alpha[1:]).any():
            for w in words:
                if not w.isalpha() and not w.isdigit():
                    inside += 1
                    hidden += memory.hidden(w)
    if hits and second:
        at, who = np.array(hits), np.array(second)
        place = np.searchsorted(who, at)
        gap = np.minimum(np.abs(at - who[np.minimum(place, len(who) - 1)]), np.abs(at - who[np.maximum(place - 1, 0)]))
        near = int((gap <= NEAR).sum())
    per, letters = 1 / max(1, n), 1 / max(1, int(codes @ _ALPHA))
    marks = [sum(int(codes[ord(x)]) for x in chars) * per for chars in _PUNCT.values()]
    return [
        len(hits) * per, strong * per, very * per, total * per, np.log1p(len(hits)), np.log1p(strong), np.log1p(very), largest, len(found), seeds * per, seeds,
        near / max(1, len(hits)), near, len(second) * per, int(codes @ _UPPER) * letters, shouted * per, *marks, stretched * per, hidden * per, hidden, inside * per, np.log1p(n), length * per, min(len(seen), 4096) / max(1, min(n, 4096)),
    ]


class Trees:
    """Boosted trees of a fixed depth on the logistic loss, by histograms of quantile bins."""

    def __init__(self) -> None:
        self.feature = self.cut = self.leaf = np.empty(0)
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        grid = np.arange(1, BINS) / BINS
        edges = [np.unique(np.quantile(x[:, j], grid)) for j in range(d)]
        bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        rate = (y.sum() + 0.5) / (n + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(n, self.base)
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        self.feature, self.cut, self.leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
        columns = np.arange(d) * BINS
        for t in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                many = 2**level
                at = ((node * d * BINS)[:, None] + columns[None] + bins).reshape(-1)
                sums = [np.bincount(at, weights=np.repeat(v, d), minlength=many * d * BINS).reshape(many, d, BINS) for v in (g, h)]
                left_g, left_h = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=2, keepdims=True) for s in sums)
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + PRIOR) + right_g**2 / (right_h + PRIOR) - all_g**2 / (all_h + PRIOR)
                gain[(left_h < LEAF / 4) | (right_h < LEAF / 4)] = 0
                flat = gain.reshape(many, -1)
                best = flat.argmax(axis=1)
                split_at = np.zeros(many, np.int64)
                for k in range(many):
                    j, b = divmod(int(best[k]), BINS - 1)
                    if flat[k, best[k]] > 1e-9 and b < len(edges[j]):
                        self.feature[t, many - 1 + k], self.cut[t, many - 1 + k], split_at[k] = j, edges[j][b], b
                    else:
                        split_at[k] = BINS
                    self.feature[t, many - 1 + k] = j
                j = self.feature[t, many - 1 + node]
                node = 2 * node + (bins[np.arange(n), j] > split_at[node])
            sums = [np.bincount(node, weights=v, minlength=leaves) for v in (g, h)]
            self.leaf[t] = -RATE * sums[0] / (sums[1] + PRIOR)
            z += self.leaf[t][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            z += leaf[node]
        return z


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending margins and probabilities: pooled neighbours of the sample, each drawn a little towards its mean."""
    order = np.argsort(margin, kind="stable")
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    blocks: list[list[float]] = []  # sum, weight, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    s, w, m = (np.array(c) for c in zip(*blocks, strict=True))
    return m / w, np.maximum.accumulate((s + rate) / (w + 1.0))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), self.at, self.probability)


def fit(texts: list[str], y: np.ndarray) -> Model:
    """A model of texts with labels y (0 or 1); texts are dealt into folds by their bytes, so equal texts share one."""
    fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for t in texts])
    words = [text_words(t) for t in texts]
    x = np.zeros((len(texts), len(NAMES)))
    for k in range(FOLDS):
        rest = fold != k
        lexicon = learn_lexicon([w for w, r in zip(words, rest, strict=True) if r], y[rest])
        memory = Memory(lexicon)
        for i in np.flatnonzero(~rest):
            x[i] = features(texts[i], memory)
    margin = np.zeros(len(texts))
    for k in range(FOLDS):
        if (fold == k).any():
            margin[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k]) if (fold != k).any() else 0
    return Model(learn_lexicon(words, y), Trees().fit(x, y), *isotonic(margin, y))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model of labels.toxic (0 or 1) fitted to rows whose remainder isn't 1; None if there are none.

    Labels without doc_id or toxic are left out; of several for one doc_id the greatest counts. Repeated rows of a
    document are trained on one by one, null text as an empty one. max_rows and max_bytes bound the sample, in whole rows.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    own = own.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("__y")).withColumn("__place", F.xxhash64("__id"))
    ids = own.orderBy("__place", "__id").limit(max_rows)  # at most max_rows rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").alias("__doc"), text.alias("__text")).join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    key = ["__place", "__id", "__size", "__crc"]
    rows = rows.select("__place", "__id", F.octet_length("__text").alias("__size"), F.crc32(F.col("__text").cast("binary")).alias("__crc"), "__text", "__y").where(F.col("__size") <= max_bytes)
    sizes = rows.select(*key).orderBy(*key).limit(max_rows).collect()  # at most max_rows rows of four numbers
    many = int(np.searchsorted(np.cumsum([r["__size"] for r in sizes]), max_bytes, side="right"))
    if not many:
        return None
    types = ("long", documents.schema["doc_id"].dataType, "int", "long")
    bound = F.struct(*(F.lit(v).cast(t) for v, t in zip(sizes[many - 1], types, strict=True)))
    rows = rows.where(F.struct(*(F.col(c).cast(t) for c, t in zip(key, types, strict=True))) <= bound)
    rows = rows.orderBy(*key).limit(many).select("__text", "__y").collect()  # at most max_bytes bytes
    return fit([r["__text"] for r in rows], np.array([r["__y"] for r in rows], dtype=np.float64))


def score_documents(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with two more columns: score (probability of label 1) and predicted (1 if score >= THRESHOLD, else 0).

    Null text counts as empty, which is scored like any other; repeated rows get equal scores. Other columns stay;
    columns named score or predicted are replaced. Without a model every score is 0.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Memory(model.lexicon)
        for texts in batches:
            x = np.array([features(t or "", memory) for t in texts]).reshape(len(texts), len(NAMES))
            yield pd.Series(model.score(x))

    value = score(F.coalesce(F.col("text").cast("string"), F.lit(""))) if model else F.lit(0.0)
    return documents.select(*kept).withColumn("score", value).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What op12 returns."""
    scored = score_documents(documents.select(F.col("doc_id"), "text"), train(documents, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
