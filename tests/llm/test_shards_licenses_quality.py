"""Sharding laws, licence digests, quality scores."""

import itertools
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from mosaiq.llm import license_scan, quality, sharding
from mosaiq.llm.common import read_table
from mosaiq.llm.license_texts import TEXTS


def test_counts_are_even_and_groups_stay_together(spark):
    texts = ["hot"] * 150 + ["warm"] * 30 + [f"pair {i // 2}" for i in range(80)] + [f"one {i}" for i in range(70)] + [None, None, "", "\x00null"]
    df = spark.createDataFrame([(i % 300, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard int, nth string").repartition(5)
    got = sharding.shard_documents(df).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    groups = defaultdict(set)
    for r in got:
        groups[r["g1"], r["g2"]].add(r["shard"])
    split = [g for g, s in groups.items() if len(s) > 1]
    assert len(split) <= 6  # the hot group, and what full quotas cut
    sizes = Counter((i % 300, len((t or "").encode()) + 1) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes  # doc_id 0 is on two rows, "hot" and "one 40"
    by_text = defaultdict(set)
    for r in got:
        by_text[r["size"], r["text_crc32"]].add((r["g1"], r["g2"]))
    assert len(by_text[1, 0]) == 2  # null and "" have equal sizes, but are two texts
    assert len(by_text[6, zlib.crc32(b"\x00null")]) == 1 and not by_text[6, zlib.crc32(b"\x00null")] & by_text[1, 0]
    empty = sharding.shard_documents(df.limit(0))
    assert empty.count() == 0 and sharding.digest(df.limit(0)).count() == 0
    assert tuple(sharding.cut_edges(empty).first()) == (0, 0)


def least_cut(groups, quotas):
    """The fewest pairs of one group that lie apart, over all ways to fill the shards: brute force over counts."""
    best = {(0,) * len(quotas): 0}
    for n in groups:
        new = {}
        for filled, cut in best.items():
            for parts in itertools.product(*(range(min(n, q - f) + 1) for f, q in zip(filled, quotas, strict=True))):
                if sum(parts) == n:
                    at = tuple(f + x for f, x in zip(filled, parts, strict=True))
                    c = cut + (n * n - sum(x * x for x in parts)) // 2
                    new[at] = min(c, new.get(at, c))
        best = new
    return min(best.values())


@pytest.mark.parametrize("groups", [[4, 1, 1, 1, 1], [3, 3, 2, 2, 1, 1], [2, 2, 2, 2, 2, 2], [8, 2, 1, 1], [1] * 9, [5, 1, 1, 1, 1, 1, 1, 1]])
def test_cut_edges_equal_brute_force(spark, groups):
    texts = [f"text {g}" for g, n in enumerate(groups) for _ in range(n)]
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=2)
    n = len(texts)
    links, cut = sharding.cut_edges(got).first()
    assert links == sum(k * (k - 1) // 2 for k in groups)
    assert cut == least_cut(groups, (n // 2 + n % 2, n // 2))


def plain_score(net, text):
    """The network without a vectorised step: chunk by chunk, place by place, filter by filter."""
    raw, values = (text or "").encode(), []
    at = 0
    while True:
        own = raw[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        peaks = []
        for f in range(quality.FILTERS):
            seen = [sum(float(net.p["bytes"][own[s + w], d]) * float(net.p["filters"][w * quality.DIMS + d, f]) for w in range(quality.WIDTH) for d in range(quality.DIMS)) for s in range(0, quality.CHUNK - quality.WIDTH + 1, quality.HOP)]
            peaks.append(max(max(seen) + float(net.p["shift"][f]), 0))
        values.append(peaks)
        if at + quality.CHUNK >= len(raw):
            break
        at += quality.STEP
    pooled = [sum(v[f] for v in values) / len(values) for f in range(quality.FILTERS)] + [max(v[f] for v in values) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(pooled, net.p["weights"], strict=True)) - float(net.p["bias"][0])))


def test_scores_equal_the_plain_network(spark):
    r = np.random.default_rng(8)
    net = quality.Network(3)
    net.p["shift"] = r.normal(0, 0.3, quality.FILTERS).astype(np.float32)
    texts = ["", None, "short", "é" * 200, "x" * 256, "ab c" * 120, "".join(chr(int(c)) for c in r.integers(32, 300, 900)), "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in quality.score_documents(docs, net).collect()}
    assert got[2] == got[7]
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(net, t)) < 1e-4


def test_training_takes_whole_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Network, "fit", lambda self, docs, y: seen.append((docs, y)) or self)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts = {i: f"{i} " * 300 * (1 + i % 3) for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (1, None), (2, texts[2])], "doc_id long, text string")
    quality.train(docs, labels)
    chosen = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0][0]) == len(chosen) + sum(i in chosen for i in (1, 2))
    assert sum(len(c) for c in seen[0][0]) == sum(len(quality.chunks(texts[i].encode())) for i in chosen) + (1 in chosen) + (2 in chosen) * len(quality.chunks(texts[2].encode()))
    quality.train(docs, labels, max_bytes=5000)
    assert 0 < sum(len(c) * quality.STEP for c in seen[1][0]) < 5000 + 300 * len(seen[1][0])
    assert quality.train(docs, labels, max_bytes=10) is None or len(seen) == 3


def test_groups_gather_until_nothing_moves(spark):
    def shards_of(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        at, counts = defaultdict(set), Counter()
        for r in sharding.shard_documents(df).collect():
            at[texts[r["doc_id"]]].add(r["shard"])
            counts[r["shard"]] += 1
        assert sum(counts.values()) == len(texts) and max(counts.values()) - min(counts.values()) <= 1
        return at

    # a third of all rows needs three shards of an eighth each
    assert len(shards_of(["hot"] * 3000 + [f"one {i}" for i in range(6000)])["hot"]) == 3
    # all rows are linked, so pairs must swap; only the borders of quotas may split one
    at = shards_of([f"pair {i // 2}" for i in range(4000)])
    assert sum(len(s) > 1 for s in at.values()) <= 16


@pytest.mark.parametrize(("texts", "still"), [([f"pair {i // 2}" for i in range(40)] + [f"one {i}" for i in range(40)], 0), (["hot"] * 18 + ["two"] * 2 + [f"one {i}" for i in range(76)], 2)])
def test_rounds_end_once_nothing_can_move(spark, monkeypatch, texts, still):
    """None where all groups are whole; where one has to stay cut and no group has a tie, one still round of each kind."""
    went, written = [], []
    propagate, materialise = sharding._propagate, sharding.materialise

    def write(df, label):
        written.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return materialise(df, label)

    def go(cells, quota, turn):
        monkeypatch.setattr(sharding, "materialise", write)
        went.append(propagate(cells, quota, turn))
        monkeypatch.setattr(sharding, "materialise", materialise)
        return went[-1]

    monkeypatch.setattr(sharding, "_propagate", go)
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts.values()) == {len(texts) // 8} and len(went) > 1
    assert len(list(itertools.takewhile(lambda r: r is None, reversed(went)))) == still
    assert max(written) <= 6  # tables that one plan of a round reads


def test_digest_columns(spark):
    got = sharding.digest(spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 3, 2: 1} and {r["law"] for r in got} == {"rows"}
    assert len({r["shard"] for r in got}) == 2


MIT_HEAD = "MIT License\n\nCopyright (c) 2024 The authors\n\n"


def test_licences(spark):
    mit, body = MIT_HEAD + TEXTS["MIT"][0], TEXTS["MIT"][0]
    bsd = TEXTS["BSD-3-Clause"][0]
    rows = [
        (1, mit, "MIT"),
        (2, mit.upper().replace("COPYRIGHT (C) 2024 THE AUTHORS", "Copyright 1999 Someone Else, Inc."), "MIT"),
        (3, mit.replace("Copyright (c) 2024 The authors\n", "// (c) 2001-2005 A\n# Copyright (C) 2007 B\n").replace(" to ", "\n  to "), "MIT"),
        (4, mit.replace("License", "Licence").replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "MIT"),
        (5, mit + " and more", None),
        (6, bsd.replace('"', "\u201d").replace("-", "\u2010"), "BSD-3-Clause"),
        (7, None, None),
        (8, "", None),
        (9, "Copyright (c) 2020 X", None),
        (10, body, "MIT"),
        (11, "The MIT License (MIT)\n\nCopyright The authors 2024\n" + body, "MIT"),
        (12, "BSD 3-Clause License\n\nCopyright (c) 2019, A\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"),
        (13, bsd.replace("1. ", "* ").replace("2. ", " * ").replace("3. ", " - "), "BSD-3-Clause"),
        (14, "/*\n * " + TEXTS["Apache-2.0"][0].replace("\n", "\n * ").replace("http:", "https:") + "\n */", "Apache-2.0"),
        (15, "Copyright © A\n" + TEXTS["GPL-3.0-or-later"][0], "GPL-3.0-or-later"),
        (16, TEXTS["BSD-2-Clause"][0], "BSD-2-Clause"),
        (17, "The Unlicense\n\n" + TEXTS["Unlicense"][1], "Unlicense"),
        (20, "MIT License\n\nCopyright Jane Doe\n\n" + body, "MIT"),
        (21, "Copyright (c) 2020 Jane Doe\n  and contributors\n\n" + body, "MIT"),
        (22, "SPDX-License-Identifier: MIT\nSPDX-FileCopyrightText: 2020 Jane\n\n" + body, "MIT"),
        (23, "# Copyright Jane Doe and\n#\n\nCopyright\tThe Others\n\tof Somewhere\n" + bsd, "BSD-3-Clause"),
        (24, body.replace("The above copyright notice", "The above\ncopyright notice"), "MIT"),
        (25, body.replace("The above copyright notice", "The above"), None),
        (18, "This project is under the MIT License.", None),
        (None, "ISC License\n\n" + TEXTS["ISC"][0], "ISC"),
        (1, mit, "MIT"),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, license_id string")
    got = license_scan.scan_licenses(df).collect()
    assert Counter((r["doc_id"], r["license_id"]) for r in got) == Counter((i, k) for i, _, k in rows)
    known = spark.createDataFrame([("b", "some words"), ("a", "Some  Words!"), ("c", None), ("d", "...")], "license_id string, text string")
    assert {r["license_id"] for r in license_scan.scan_licenses(spark.createDataFrame([(1, "SOME WORDS"), (2, "")], "doc_id long, text string"), known).collect()} == {"a", None}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_long_licences_by_their_files(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(k, (folder / f).read_text()) for f, k in files.items() if (folder / f).exists()]
    rows = [(k, v) for k, t in texts for v in (t, t.upper(), "\n".join("// " + x for x in t.splitlines()), t.split("END OF TERMS AND CONDITIONS")[0], t.replace("https:", "http:"))]
    if not rows:
        pytest.skip("no licence files on this machine")
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["doc_id"] for r in got)


def test_chunks_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 480, 481, 1000, 5000):
        raw = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        c = quality.chunks(raw)
        joined = c[0].tobytes() + b"".join(x.tobytes()[quality.CHUNK - quality.STEP :] for x in c[1:])
        assert joined.rstrip(b"\0") == raw and len(joined) >= n


def test_gradients():
    r = np.random.default_rng(0)
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = [r.integers(0, 256, (n, quality.CHUNK), dtype=np.uint8) for n in (1, 3)]
    y = np.array([0.0, 1.0])

    def loss():
        x = np.concatenate(docs)
        p = net.probability(net.pooled(x), np.array([0, 1]), np.array([1, 3]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net._gradients(docs, y)
    for name, at in (("filters", (3, 5)), ("shift", (2,)), ("weights", (30,)), ("bias", (0,)), ("bytes", (int(docs[0][0, 7]), 1))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = quality.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "### &&& %%%", 9.0) for i in range(60)] + [(None, None, 1.0), (61, "", 2.0), (62, "x" * 100_000, 3.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["score"] == got[61]["score"]
    assert got[1]["score"] > got[2]["score"]
    assert quality.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score_documents(docs, None).collect()} == {0.5}
    assert quality.digest(docs.limit(0), labels).count() == 0
