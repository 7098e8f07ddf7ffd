"""Exact top-k search and LM scoring against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from mosaiq.llm import lm_score, topk

VECTORS = "vec_id long, embedding array<float>, score long"


def brute(rows, k=10):
    data = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    end = (1 << 63) - 1
    for q, v in sorted({(i, tuple(v)) for i, v in data if i % 100 == 0}):
        scored = sorted((-max(-end, min(end, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in data if j != q and len(w) == len(v))
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "ties", "few", "none"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 256)
    r = np.random.default_rng(3)
    n = {"few": 4, "none": 0}.get(kind, 900)
    x = r.normal(size=(n, 8))
    if kind == "clustered":
        x = x * 0.05 + r.normal(size=(6, 8))[r.integers(0, 6, n)]
    if kind == "ties":
        x = np.round(x[r.integers(0, 5, n)], 1)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    if kind == "random":
        rows += [(1000, None, 1), (1100, [None] + [0.0] * 7, 1), (1200, [math.nan] + [0.0] * 7, 1), (1300, [math.inf] * 8, 1), (None, [0.0] * 8, 1), rows[7], rows[7]]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)


def gap(a, b):
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


@pytest.mark.parametrize("leaf", [1, 24])
def test_cover_tree_covers_and_separates(leaf):
    x = np.round(np.random.default_rng(0).normal(size=(700, 5)) * 1000).astype(np.int64)
    x[300:340] = x[0]
    t = topk.CoverTree.build(np.arange(700), x, leaf)
    assert sorted(t.ids.tolist()) == list(range(700)) and (t.x == x[t.ids]).all()
    for at, (centre, lo, hi, first, last) in enumerate(t.nodes.tolist()):
        assert gap(t.f[lo:hi], t.f[centre]).max() <= t.radius[at] + 1e-9 and lo <= centre < hi
        if last > first:
            own = t.nodes[first:last]
            assert own[0, 1] == lo and own[-1, 2] == hi and (own[1:, 1] == own[:-1, 2]).all()
            assert (t.radius[first:last] <= t.radius[at] / 2 + 1e-9).all()
            centres = t.f[own[:, 0]]
            assert all(gap(centres[:i], centres[i]).min(initial=np.inf) > t.radius[at] / 2 for i in range(len(own)))
        else:
            assert hi - lo <= leaf or t.radius[at] == 0


def test_node_pairs_are_pruned():
    r = np.random.default_rng(2)
    at = r.normal(size=(50, 8)) * 4
    x = np.floor((at[r.integers(0, 50, 2000)] + r.normal(size=(2000, 8)) * 0.02) * 1024).astype(np.int64)
    ids = np.arange(2000)
    s = topk.Search(topk.CoverTree.build(ids[::100], x[::100], 1), 10)
    s.over(topk.CoverTree.build(ids, x))
    assert s.scanned < 0.25 * 20 * 2000
    for q, found in zip(s.tree.ids.tolist(), s.best, strict=True):
        scored = sorted((-int(x[q] @ x[j]), j) for j in range(2000) if j != q)[:10]
        assert [(-a, j) for a, j in found.tolist()] == scored


def test_vectors_of_any_size(spark):
    r = np.random.default_rng(7)
    x = [*r.normal(size=(150, 4)), *(r.normal(size=(60, 4)) * 1e4), *(r.normal(size=(40, 4)) * 1e9), *(r.normal(size=(30, 4)) + 3e7), [3e38] * 4, [-3e38] * 4, [3e38, 1, 1, 1]]
    rows = [(int(i), [float(np.float32(v)) for v in x[k]], 1) for k, i in enumerate(r.permutation(len(x)))]
    rows += [(500, [2000.0], 1), (501, [0.5], 1)] + [(600 + i, [float(v) for v in r.normal(size=5000)], 1) for i in range(4)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)
    assert len(got) == 10 * sum(q % 100 == 0 for q in range(len(x))) + 1 + 3
    assert max(r["score"] for r in got) == topk.MOST_SCORE or all(abs(v) < 1e30 for q, v4, _ in rows if q % 100 == 0 for v in v4)


def lm_brute(texts, targets):
    raw = [(t or "").encode().lower() for t in texts]
    common = sorted(Counter(b for t in raw for b in t).items(), key=lambda x: (-x[1], x[0]))[:47]
    symbol = {b: i + 1 for i, (b, _) in enumerate(common)}
    coded = [[0, 0, 0] + [symbol.get(b, 0) for b in t] for t in raw]

    def model(chosen):
        counts = [defaultdict(Counter) for _ in range(4)]
        for s in chosen:
            for i in range(3, len(s)):
                for n in range(4):
                    counts[n][tuple(s[i - n : i])][s[i]] += 1

        def p(context, x):
            out = 1 / 48
            for n in range(4):
                c = counts[n][tuple(context[3 - n :])]
                out = (c[x] + 8 * out) / (sum(c.values()) + 8)
            return out

        return p

    a, b = model([s for s, t in zip(coded, targets, strict=True) if t]), model([s for s, t in zip(coded, targets, strict=True) if not t])
    return [sum(math.log(a(s[i - 3 : i], s[i])) - math.log(b(s[i - 3 : i], s[i])) for i in range(3, len(s))) / (len(s) - 3) if len(s) > 3 else None for s in coded]


def test_scores_equal_brute_force(spark):
    texts = ["the cat sat on the mat", "The dog sat", None, "", "zzz qqq 123 éà", "the cat", "x" * 500, "the cat sat on the mat"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    targets = spark.createDataFrame([(0,), (1,), (1,), (99,), (None,)], "doc_id long")
    want = lm_brute(texts, [i in (0, 1) for i in range(len(texts))])
    got = {r["doc_id"]: -r["score"] if r["score"] is not None else None for r in lm_score.score_documents(docs, targets).collect()}
    for i, w in enumerate(want):
        # the model adds log P of the target minus log P of the background; the score is the difference of losses
        assert (got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-5)
    assert lm_score.score_documents(docs.limit(0), targets).count() == 0
    assert got[0] > got[4]


def test_grams_that_all_blocks_hold(spark, monkeypatch):
    r = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["the", "cat", "sat", "on"], 12))) for i in range(60)], "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    want = sorted(map(tuple, lm_score.score_documents(docs, targets).collect()))
    monkeypatch.setattr(lm_score, "BLOCK", 40)
    monkeypatch.setattr(lm_score.common, "FEW_ROWS", 9)
    got = sorted(map(tuple, lm_score.score_documents(docs, targets).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 1e-9


def test_no_byte_or_long_gram_is_folded(spark):
    r = np.random.default_rng(5)
    texts = ["".join(chr(int(c)) for c in r.integers(33, 127, 60)) for _ in range(40)] + ["order 66", "order 77", "Größe í", "Größe ï", None, "", "same start a", "same start b"] * 2
    raw = [(t or "").encode().lower() for t in texts]
    assert len({b for t in raw for b in t}) > 60
    targets = {0, 1, 2, 40, 42, 46}
    ids = [None if i == 5 else i for i in range(len(texts))]  # one without an id
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    v = len({b for t in raw for b in t}) + 1

    def model(chosen):
        counts = [defaultdict(Counter) for _ in range(6)]
        for s in chosen:
            for i in range(5, len(s)):
                for n in range(6):
                    counts[n][s[i - n : i]][s[i]] += 1

        def loss(context, x):
            p = 1 / v
            for n in range(6):
                c = counts[n][context[5 - n :]]
                p = (c[x] + 8 * p) / (sum(c.values()) + 8)
            return -math.log(p)

        return loss

    coded = [b"\xff" * 5 + t for t in raw]
    a, b = model([s for i, s in enumerate(coded) if i in targets]), model([s for i, s in enumerate(coded) if i not in targets])
    labels = spark.createDataFrame([(i, 1, 0) for i in targets] + [(3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm_score.digest(docs, labels).collect()}
    got[5] = got.pop(None)
    assert len(got) == len(texts)
    for i, s in enumerate(coded):
        want = sum(a(s[k - 5 : k], s[k]) - b(s[k - 5 : k], s[k]) for k in range(5, len(s))) / len(raw[i]) if raw[i] else None
        assert got[i]["n_symbols"] == len(raw[i]) and (got[i]["score"] is None) == (want is None) and (want is None or abs(got[i]["score"] - want) < 1e-9)
    assert got[40]["score"] < got[41]["score"] and got[42]["score"] < got[43]["score"]
