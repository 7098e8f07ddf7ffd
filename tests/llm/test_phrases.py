"""Phrases against a plain count of all n-grams; pruned and unpruned levels give the same rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from mosaiq.llm import phrases

SCHEMA = "doc_id long, lang string, text string, phrase string, k int, n long"


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= least}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if not any(x == lang and len(v) > len(w) and 100 * c >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), c in f.items()):
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, got = Counter(), []
    for lang, phrase, a, left, right, total, score in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase, a, left, right, total, score))
    return got


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["A", "b", "C'd", "ä", "ÄÖ", "e\x00f", "g|h", " ", "i-j"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "\x0b", "\x1c"]) for _ in range(r.randrange(60)))
    rows = [(r.choice(["en", "de", None, "und"]), text()) for _ in range(n)]
    return rows + [("hot", "new york city hall! New York City Hall"), (None, None), ("en", ""), ("en", " .,"), ("de", "x " * 300)] * 9


@pytest.mark.parametrize("limits", [{}, {"MOST_WORDS": 0}, {"MOST_WORD_BYTES": 3}, {"MOST_GRAMS": 2}, {"RANKED": 7, "TOP": 5}])
def test_phrases_equal_plain_counts(spark, monkeypatch, limits):
    monkeypatch.setattr(phrases, "LEAST", 8)
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(1)
    df = spark.createDataFrame([(i, *r, "x", i, None) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    top = limits.get("TOP", 2000)
    got = [tuple(r) for r in phrases.mine(df, top).orderBy("lang", "rank").collect()]
    want = plain(rows, 8, top)
    assert got == want and len({r[0] for r in got}) == 4 and any(r[2] == "new york city hall" for r in got)
    assert not any(r[2] in ("new york", "york city", "new york city") for r in got)


def test_little_or_no_text(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None), (2, "en", "a b a b", None, None, None)], SCHEMA)
    out = phrases.mine(df)
    assert out.count() == 0 and dict(out.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")
    assert phrases.mine(df.limit(0)).count() == 0


def test_long_texts_are_split_between_words(monkeypatch):
    text = ("wört Two,three.\tfour " * 200).encode()
    whole = next(phrases._tokens(text))
    monkeypatch.setattr(phrases, "SLICE", 7)
    parts = list(phrases._tokens(text))
    assert len(parts) > 100 and sum(parts, []) == whole
    assert list(phrases._tokens(b"x" * 50)) == [[b"x" * 50]] and list(phrases._tokens(b"")) == []


def test_scores_beyond_64_bits(spark):
    levels = spark.createDataFrame([("en", "a", 1, 9 * 10**18), ("en", "b", 1, 8 * 10**18 + 7), ("en", "a b", 2, 7 * 10**18 + 3)], "lang string, phrase string, k int, f long")
    assert [r["score"] for r in phrases.score_phrases(levels).collect()] == [2_000_000 * (7 * 10**18 + 3) // (17 * 10**18 + 7)]


def test_pairs_need_both_grams():
    ids = np.array([0, 1, 2, -1, 0, 1, 2, 0], dtype=np.int32)
    pair = lambda a, b: a << 32 | b
    assert phrases._pairs(ids, []).tolist() == [pair(0, 1), pair(1, 2), pair(0, 1), pair(1, 2), pair(2, 0)]
    table = np.array([pair(0, 1), pair(1, 2)])
    assert phrases._pairs(ids, [table]).tolist() == [pair(0, 1)] * 2
    assert phrases._words(np.array([pair(0, 1)]), [table]).tolist() == [[0, 1, 2]]
    assert phrases._pairs(ids, [np.empty(0, np.int64)]).tolist() == []


def test_pairs_are_packed_by_bucket(monkeypatch):
    """A task gives a row for each bucket, not for each pair, and sums over tasks keep all frequent pairs."""
    monkeypatch.setattr(phrases, "HELD", 50)
    r = np.random.default_rng(0)
    cells = [r.integers(-1, 40, 900).astype(np.int32) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells[i : i + 5]], pa.binary())], ["ids"]) for i in range(0, 40, 5)]
    packed = [*phrases._count_pairs([], 7)(iter(batches[:4])), *phrases._count_pairs([], 7)(iter(batches[4:]))]
    want = Counter(int(x) for c in cells for x in phrases._pairs(c, []))
    assert sum(b.num_rows for b in packed) < len(want) / 5 and all(b.num_rows <= phrases.BLOBS for b in packed)
    got = []
    for bucket in range(7):
        own = [b.filter(pc.equal(b.column(0), bucket)) for b in packed]
        got += [x for b in phrases._add_pairs(3)(iter(own)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(got) == sorted((k, n) for k, n in want.items() if n >= 3)
    assert list(phrases._add_pairs(3)(iter([]))) == []


def test_sequences_are_short(spark):
    """Rows of sequences go to Python a thousand at a time, so a row holds few numbers and, beyond that, one text's."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 500), pa.array(["a b a " * 100] * 500)], ["lang", "text"])
    held = spark.sparkContext.broadcast({"en": {b"a": 0, b"b": 1}})
    out = [np.frombuffer(c.as_py(), np.int32) for b in phrases._number(held)(iter([batch])) for c in b.column(0)]
    assert sum(map(len, out)) == 500 * 301 and max(map(len, out)) < phrases.SEQUENCE + 301
    assert max(map(len, out)) <= 1 << 13
