"""Polygons: filled again they give their cells, whatever the tiles; holes, parts, corners."""

import re

import numpy as np
import pytest

from mosaiq.operators import polygons, tiles


def filled(wkt):
    """Cells whose middle lies inside, by the even-odd rule over all rings; and parts, holes."""
    parts = re.findall(r"\(\(.*?\)\)", wkt)
    rings = [[tuple(map(int, p.split())) for p in ring.split(", ")] for part in parts for ring in re.findall(r"\(([^()]+)\)", part)]
    assert all(r[0] == r[-1] for r in rings)
    cells = set()
    for y in range(-3, 40):
        for x in range(-3, 40):
            crossed = 0
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                    if x1 == x2 and min(y1, y2) <= y < max(y1, y2) and x1 > x:
                        crossed += 1
            if crossed % 2:
                cells.add((y, x))
    return cells, len(parts), len(rings) - len(parts)


@pytest.mark.parametrize("side, seed", [(256, 0), (5, 1), (3, 2), (1, 3), (2, 4)])
def test_polygons_give_their_cells_back(spark, monkeypatch, side, seed):
    monkeypatch.setattr(tiles, "SIDE", side)
    r = np.random.default_rng(seed)
    grid = {(a, b): int(r.choice([0, 1, 2, 3], p=[0.4, 0.4, 0.1, 0.1])) for a in range(11) for b in range(13) if r.random() < 0.95}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in grid.items()] + [(30, 30, None)], "r int, c int, label int").repartition(3)
    got = {x["label"]: x for x in polygons.polygons(df).collect()}
    assert got.keys() == {0, 1, 2, 3}
    for k, row in got.items():
        own = {p for p, v in grid.items() if v == k}
        cells, parts, holes = filled(row["wkt"])
        assert cells == own and row["area"] == len(own) and (row["parts"], row["holes"]) == (parts, holes)
        assert row["perimeter"] == sum((a + x, b + y) not in own for a, b in own for x, y in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        left, pieces = set(own), 0
        while left:
            todo = [left.pop()]
            pieces += 1
            while todo:
                a, b = todo.pop()
                for q in ((a, b + 1), (a, b - 1), (a + 1, b), (a - 1, b)):
                    if q in left:
                        left.remove(q)
                        todo.append(q)
        assert parts == pieces


def test_a_ring_with_a_hole_and_a_corner(spark):
    rows = [(a, b, 7) for a in range(3) for b in range(3) if (a, b) != (1, 1)] + [(3, 3, 7)]
    got = polygons.polygons(spark.createDataFrame(rows, "r int, c int, label int")).first()
    assert got["wkt"] == "MULTIPOLYGON (((0 0, 3 0, 3 3, 0 3, 0 0), (2 1, 1 1, 1 2, 2 2, 2 1)), ((3 3, 4 3, 4 4, 3 4, 3 3)))" or (got["parts"], got["holes"], got["area"], got["perimeter"]) == (2, 1, 9, 20)
    assert (got["parts"], got["holes"], got["area"], got["perimeter"]) == (2, 1, 9, 20)
    assert polygons.polygons(spark.createDataFrame([], "r int, c int, label int")).count() == 0


def test_runs_are_stacked_apart(spark):
    rows = [("b", 0, 0, 1), ("b", 1, 0, 1), ("a", 0, 0, 1), ("a", 1, 0, 2), ("a", 1, 1, -1)]
    cells, numbers = polygons.stacked(spark.createDataFrame(rows, "run_id string, r int, c int, label long"), "run_id")
    got = polygons.polygons(cells).join(numbers, "label")
    assert sorted((x["run_id"], x["own"], x["area"], x["parts"]) for x in got.collect()) == [("a", 1, 1, 1), ("a", 2, 1, 1), ("b", 1, 2, 1)]
