"""Toxicity: held-out accuracy, the parts against plain versions, odd rows."""

import random

import numpy as np
import pytest

from mosaiq.llm import toxicity as tox
from mosaiq.llm.common import read_table


def test_held_out_rows_of_the_documents(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = tox.digest(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted", "score"))
    assert len(rows) > 1000 and ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.7)).all()
    assert (p & y).sum() / y.sum() > 0.85 and (p & y).sum() / p.sum() > 0.95
    assert np.mean((s - y) ** 2) < 0.03  # calibrated


def test_odd_rows(spark):
    r = random.Random(0)
    good = [" ".join(r.choice(["The", "house", "is", "blue", "today", "and", "warm."]) for _ in range(30)) for _ in range(300)]
    bad = [g.replace("house", "moron") + " you idiot" for g in good[:100]]
    texts = [*good, *bad, None, "", None, "x" * 600_000, "y " * 300_000, "you idiot", "you idiot"]
    df = spark.createDataFrame([(i if i != 402 else None, t, 0.5, i, "en") for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int, lang string").repartition(3)
    labels = spark.createDataFrame([*((i, 1, int(300 <= i < 400)) for i in range(400)), (None, 1, 1), (5, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = tox.train(df, labels)
    got = {r["doc_id"]: r for r in tox.score_documents(df, model).collect()}
    assert len(got) == len(texts) and got[0]["lang"] == "en"
    assert got[400]["score"] == got[401]["score"] == got[None]["score"]  # null and empty texts
    assert got[405]["score"] == got[406]["score"] and 0 <= min(r["score"] for r in got.values()) and max(r["score"] for r in got.values()) <= 1
    held = [i for i in range(400) if tox.zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["predicted"] == int(i >= 300) for i in held)
    out = tox.digest(df, labels)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert {r["doc_id"] for r in out.where("held_out").collect()} >= set(held)
    assert tox.train(df, labels.limit(0)) is None and tox.score_documents(df, None).where("score != 0 or predicted != 0").count() == 0
    assert tox.digest(df.limit(0), labels).count() == 0
    flipped = labels.withColumn("toxic", tox.F.when(tox.remainder(tox.F.col("doc_id")) == 1, 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    again = tox.train(df, flipped)
    assert again.lexicon.weights == model.lexicon.weights and (again.trees.leaf == model.trees.leaf).all()  # held-out labels don't matter
    small = tox.train(df, labels, max_rows=90)
    assert small is not None and not np.array_equal(small.trees.leaf, model.trees.leaf)


def test_isotonic_steps_are_the_best_monotone_fit():
    r = np.random.default_rng(1)
    m = r.normal(size=60).round(1)
    y = (r.random(60) < 1 / (1 + np.exp(-m))).astype(float)
    at, p = tox.isotonic(m, y)
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] and p[-1] < 1
    order = np.argsort(m, kind="stable")
    v = y[order]
    best = [max(min(v[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]  # min-max formula
    assert len(at) == len(set(best))


def test_trees_find_a_conjunction():
    r = np.random.default_rng(2)
    x = r.random((800, 5))
    y = ((x[:, 1] > 0.6) & (x[:, 3] < 0.5)).astype(float)
    z = tox.Trees().fit(x[:600], y[:600]).margin(x[600:])
    assert ((z > 0) == (y[600:] > 0)).mean() > 0.95
    same = tox.Trees().fit(np.ones((10, 3)), np.ones(10))
    assert np.isfinite(same.margin(np.ones((2, 3)))).all()


@pytest.mark.parametrize("text, hidden", [("what an 1d10t he is", 1), ("an i.d.i.o.t here", 1), ("an i d i o t here", 1), ("$tupid", 1), ("the house. and&&& more", 0), ("an idiot, really", 0), ("tw0 w0rds", 0)])
def test_obfuscated_words(text, hidden):
    x = dict(zip(tox.NAMES, tox.features(text, tox.Memory(tox.Lexicon({"idiot": 4.0}))), strict=True))
    assert x["hidden_hits"] == hidden


def test_features_follow_a_plain_count():
    lexicon = tox.Lexicon({"foo": 2.0, "foob": 3.5, "xa$": 1.0})
    for w in ("foo", "foobar", "fo", "xa", "xab", "fooxyzzz"):
        assert lexicon.weight(w) == max((lexicon.weights.get(s, 0.0) for s in tox.stems(w)), default=0.0)
    text = "You FOO bar foobar! Xa xab " + "word " * 20 + "Sooo foo"
    x = dict(zip(tox.NAMES, tox.features(text, tox.Memory(lexicon)), strict=True))
    assert x["log_hits"] == pytest.approx(np.log1p(4)) and x["near_hits"] == 3 and x["largest"] == 3.5 and x["distinct"] == 3
    assert x["shouted"] == pytest.approx(1 / 28) and x["stretched"] == pytest.approx(1 / 28) and x["second_per_word"] == pytest.approx(1 / 28)
    assert x["capitals"] == pytest.approx(6 / sum(map(str.isalpha, text)))


def test_slices_keep_words_and_features(monkeypatch):
    text = "Foo bar. You moron are 1d10t foo! " * 40
    lexicon = tox.Lexicon({"foo": 2.0})
    whole = tox.features(text, tox.Memory(lexicon))
    monkeypatch.setattr(tox, "SLICE", 9)
    assert "".join(tox.slices(text)) == text and tox.features(text, tox.Memory(lexicon)) == pytest.approx(whole)
