"""The distance transform against brute force over all sources."""

import random

import pytest

from mosaiq.operators import boundary, distance


def brute(cells, sources):
    out = []
    for k, r, c in set(cells):
        own = [((r - a) ** 2 + (c - b) ** 2, a, b) for j, a, b in sources if j == k]
        d2, a, b = min(own) if own else (None, None, None)
        out.append((k, r, c, a, b, d2))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, cells", [(1 << 20, 512), (40, 512), (7, 3)])
def test_nearest_source_equals_brute_force(spark, monkeypatch, size, cells):
    monkeypatch.setattr(distance, "CELLS", size)
    monkeypatch.setattr(distance, "WIDTH", cells)
    r = random.Random(size)
    place = lambda n: (r.randrange(-n, n), r.randrange(-n, n))
    sources = [(k, *place(n)) for k, n, many in (("a", 12, 20), ("b", 30, 5), ("c", 4, 60)) for _ in range(many)] + [("far", 500, -700)]
    asked = [(k, *place(25)) for k in ("a", "b", "c", "d") for _ in range(150)] + [("far", 0, 0), ("far", 0, 0)]
    df = lambda rows: spark.createDataFrame(rows, "run string, r int, c int").repartition(3)
    got = distance.nearest_source(df(asked), df(sources), ["run"])
    assert sorted(map(tuple, got.collect()), key=repr) == brute(asked, sources)
    one = distance.nearest_source(df([("x", 3, 3), ("x", 0, 0)]).drop("run"), df([("y", 0, 6), ("y", 6, 0), ("y", 3, 0)]).drop("run"))
    assert sorted(map(tuple, one.collect())) == [(0, 0, 3, 0, 9), (3, 3, 3, 0, 9)]


def test_ties_and_empty_tables(spark):
    cells = spark.createDataFrame([(5, 5), (0, 5)], "r int, c int")
    ring = spark.createDataFrame([(9, 8), (8, 9), (2, 1), (1, 2), (5, 10), (10, 5), (5, 0), (0, 5)], "r int, c int")
    got = {(x["r"], x["c"]): (x["near_r"], x["near_c"], x["d2"]) for x in distance.nearest_source(cells, ring).collect()}
    assert got == {(5, 5): (0, 5, 25), (0, 5): (0, 5, 0)}
    assert [x["d2"] for x in distance.nearest_source(cells, ring.limit(0)).collect()] == [None, None]
    assert distance.nearest_source(cells.limit(0), ring).count() == 0
    nulls = spark.createDataFrame([(None, 1), (4, 4)], "r int, c int")
    assert [x["d2"] for x in distance.nearest_source(cells.limit(1), nulls).collect()] == [2]


def test_boundaries_have_no_reach(spark):
    edges = spark.createDataFrame([("a", 0, 0), ("b", 0, 40)], "run_id string, r int, c int")
    cells = spark.createDataFrame([("a", 30, 40), ("b", 0, 0)], "run_id string, r int, c int")
    assert {x["run_id"]: x["d2"] for x in boundary.nearest_boundary(cells, edges).collect()} == {"a": 2500, "b": 1600}
