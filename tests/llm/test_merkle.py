"""The manifest against a plain version that builds every tree and folds every proof by itself."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from mosaiq.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, hash string, place string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """Rows of op11 as sorted tuples."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def climb(nodes):
        """The last node, and the (left, right) steps of each first one."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, i in enumerate(at):
                steps[k].append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
            nodes, at = [h("".join(r)) for r in runs], [i // 16 for i in at]
        return nodes[0], steps

    by = defaultdict(list)
    for doc_id, source, lang, n_chars, text, *_ in rows:
        leaf = h("".join(map(field, (doc_id, source, lang, n_chars, text))))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        other = h("".join(map(field, (doc_id, source, lang, n_chars, text and text.translate(low))))) if bad else leaf
        by[source].append((doc_id is not None, doc_id or 0, leaf, other))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in order}
    root, over = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, over, strict=True):
        for (has, doc_id, leaf, other), own in zip(sorted(by[s]), trees[s][1], strict=True):
            folded = other
            for a, b in own + up:
                folded = h(a + folded + b)
            out.append((doc_id if has else None, leaf, trees[s][0], root, h("".join(a + b for a, b in own + up)), folded, folded == root))
    return sorted(out, key=repr)


def sample(n, sources, seed):
    r = random.Random(seed)
    rows = [(r.choice([i, i * i * 977, -i]), r.choice(sources), r.choice(["en", None, ""]), r.choice([None, i]), r.choice([None, "", f"Text {i}", "ÄB " * 50]), "x", None) for i in range(n)]
    return rows + [(None, None, None, None, None, None, "p")] * 3 + [(7, "hot", "en", 1, "Same", None, None)] * 40 + [(8, "hot", "en", 1, f"Tie {i % 5}", None, None) for i in range(20)]


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (1, ["a"]), (700, ["a", None, "", "ä", "Z"]), (300, [f"s{i}" for i in range(40)])])
def test_manifest_equals_a_plain_one(spark, n, sources):
    rows = sample(n, sources, n) if n != 1 else [(5, "a", "en", 1, "One", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, merkle.digest(df).collect()), key=repr)
    want = plain(rows)
    assert got == want
    assert {r[6] for r in got if r[0] is None} <= {True} and any(not r[6] for r in got) == any(r[5] != r[3] for r in want)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "source", "lang", "n_chars", "text").toPandas().astype({"n_chars": "Int64", "doc_id": "Int64"}))
    assert sorted(con.sql(merkle.oracle(3)).fetchall(), key=repr) == want


def test_hot_buckets_and_long_histograms(spark, monkeypatch):
    rows = sample(500, ["a", "b", None], 3) + [(11, "hot", "en", i, f"One id {i}", None, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, value in (("BUCKET_ROWS", 2), ("FEW_ROWS", 6), ("ROWS_PER_CHUNK", 10), ("COPIES", 7)):
        monkeypatch.setattr(merkle, name, value)
    assert sorted(map(tuple, merkle.digest(df).collect()), key=repr) == plain(rows)


def test_empty_table_and_nodes(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.digest(df).count() == 0 and merkle.manifest(df).count() == 0
    assert merkle.digest(df).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [(i, f"s{i % 20}", "en", i, f"T {i}", None, None) for i in range(400)]
    nodes = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain(rows)
    assert Counter((r["level"], r["above"]) for r in nodes) == {(0, None): 400, (1, None): 40, (2, None): 20, (None, 1): 2, (None, 2): 1}
    assert [r["digest"] for r in nodes if r["above"] == 2] == [want[0][3]]
    assert {r["digest"] for r in nodes if r["level"] == 2} == {r[2] for r in want} and {r["source"] for r in nodes} == {f"s{i}" for i in range(20)} | {None}
