"""The n-gram Jaccard join against brute force."""

import random
import re

import pytest

from mosaiq.llm import common, jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) if d is not None else (-1, len(s), None) for (d, _), s in zip(rows, sets, strict=True))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, c string").repartition(4)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_documents(df).collect())


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        k = r.randrange(len(out))
        out[k : k + r.randrange(2)] = [f"e{r.random()}"] if r.random() < 0.7 else []
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 6)
    r = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(40)]
    for _ in range(14):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 4, 5, 6, 8, 9, 10, 12, 14, 15, 17, 20, 30, 60, 200]))]
        for _ in range(r.choice([1, 2, 3, 20])):
            rows.append(edited(r, base, r.choice([0, 0, 1, 1, 2, len(base) // 30 + 1])))
        rows.append(passage + base)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)) for i, w in enumerate(rows)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n "), (len(rows) + 3, "Éa"), (len(rows) + 4, "éa")]
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_lists_and_leaders_that_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 6)
    monkeypatch.setattr(jaccard, "PROBE_BITS", 0)
    monkeypatch.setattr(jaccard, "PROBE_LEAST", 8)
    monkeypatch.setattr(jaccard, "SALT_ROWS", 4)
    monkeypatch.setattr(jaccard, "REMEMBER", 3)
    monkeypatch.setattr(common, "FEW_ROWS", 4)
    r = random.Random(11)
    template, group = [f"t{i}" for i in range(40)], [f"g{i}" for i in range(60)]
    rows = [template + [f"o{k}x{i}" for i in range(r.choice([4, 8, 12, 40]))] for k in range(30)] + [edited(r, group, r.choice([0, 1, 2, 3, 5])) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(100 + i, " ".join(group)) for i in range(10)]
    assert run(spark, rows) == brute(rows)


def test_small_sets(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 16)))) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_hot_subsets_and_hot_smaller_ends(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 4)
    r = random.Random(6)
    base = [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(edited(r, base, r.choice([0, 1])) + [f"x{r.randrange(30)}"])) for i in range(60)] + [(90 + i, " ".join(base)) for i in range(20)]
    assert run(spark, rows) == brute(rows)
    numbers = lambda i, n: " ".join(f"{i}y{k}" for k in range(n))
    sets = spark.createDataFrame([(i, jaccard.shingles(" ".join(f"same{k}" for k in range(40)) + " " + numbers(i, 1 if i % 3 or i in (0, 39) else 12)).tobytes()) for i in range(40)], "node long, s binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, 39) for i in range(1, 39)], "u long, v long")
    whole = {x["node"]: set(jaccard.np.frombuffer(x["s"], dtype="int64").tolist()) for x in sets.collect()}
    want = sorted((x["u"], x["v"]) for x in pairs.collect() if 100 * len(whole[x["u"]] & whole[x["v"]]) >= 80 * len(whole[x["u"]] | whole[x["v"]]))
    assert sorted(map(tuple, jaccard._verify(pairs, sets).collect())) == want and 0 < len(want) < 77


def test_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    assert run(spark, [(None, text), (3, text), (3, text), (1, text + " more")]) == [(-1, 46, None), (1, 47, 1), (3, 46, 1), (3, 46, 1)]
    assert run(spark, []) == []
    kept = jaccard.keep_one_each(spark.createDataFrame([(5, text, "a"), (2, text + " z", "b"), (None, text, "c"), (9, "", "d")], "doc_id long, text string, node string"))
    assert sorted((r["node"] for r in kept.collect())) == ["b", "c", "d"]


def test_one_document_on_several_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    assert run(spark, [(1, a), (7, a), (7, b), (9, b)]) == [(1, 36, 1), (7, 36, 1), (7, 36, 1), (9, 36, 1)]


def test_boundary_follows_cost():
    assert jaccard.boundary({}) == 0
    assert jaccard.boundary({8: 100}) >= 8
    assert jaccard.boundary({14: 1000}) < 14


def test_bounds():
    for n in range(1, 400):
        spare = [jaccard.entries(m) - (m - -(-4 * m // 5)) for m in jaccard.partners(n)]
        assert spare == sorted(spare) and spare[0] >= 1
