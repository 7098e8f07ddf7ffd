"""Gaussian peaks against a plain version with explicit sums over the whole grid."""

import numpy as np
import pytest

from mosaiq.operators import seeds


def plain(points, height, width, radius):
    counts = np.zeros((height, width), np.float32)
    place = lambda v, n: min(max(round(v), 0), n - 1)
    for _, r, c in {(run, place(y, height), place(x, width)) for run, y, x in points}:
        counts[r, c] += 1
    sigma = max(1.0, radius / 2)
    reach = int(4 * sigma + 0.5)
    w = [np.exp(-0.5 / sigma**2 * k * k) for k in range(-reach, reach + 1)]
    w = [x / sum(w) for x in w]
    for turn in (False, True):
        grid = counts.T if turn else counts
        new = np.zeros_like(grid)
        for a in range(grid.shape[0]):
            for b in range(grid.shape[1]):
                get = lambda k, a=a, b=b, grid=grid: float(grid[k, b]) if 0 <= k < grid.shape[0] else 0.0
                total = get(a) * w[reach]
                for k in range(reach, 0, -1):
                    total += (get(a - k) + get(a + k)) * w[reach - k]
                new[a, b] = total
        counts = new.T if turn else new
    box = max(1, radius)
    top = {(a, b) for a in range(height) for b in range(width) if counts[a, b] > 0 and counts[a, b] >= counts[max(0, a - box) : a + box + 1, max(0, b - box) : b + box + 1].max()}
    out = []
    while top:
        todo = [top.pop()]
        plateau = set(todo)
        while todo:
            a, b = todo.pop()
            for q in ((a, b + 1), (a, b - 1), (a + 1, b), (a - 1, b)):
                if q in top:
                    top.remove(q)
                    plateau.add(q)
                    todo.append(q)
        out.append((*min(plateau), float(counts[min(plateau)])))
    return sorted(out)


@pytest.mark.parametrize("side, radius", [(512, 2), (7, 2), (5, 5), (9, 1)])
def test_peaks_equal_plain_sums(spark, monkeypatch, side, radius):
    monkeypatch.setattr(seeds, "PEAK_SIDE", side)
    monkeypatch.setattr(seeds.connected.__globals__["tiles"], "SIDE", 6)
    r = np.random.default_rng(radius)
    rows = [(g, f"run{k}", float(y), float(x)) for g in (4, 6) for k in range(3) for y, x in r.uniform(-2, 25, (6, 2)).round(1)]
    rows += [(9, "a", 5.0, 5.0), (9, "a", 5.0, 6.0), (9, "b", 20.5, 3.0), (9, "b", 20.5, 3.2), (9, None, None, 1.0)]  # a plateau of two cells
    df = spark.createDataFrame(rows, "spatialr int, run_id string, y double, x double").repartition(3)
    got = seeds.gaussian_peaks(df, 24, 22, radius).collect()
    for g in (4, 6, 9):
        own = [(k, y, x) for s, k, y, x in rows if s == g and y is not None]
        assert sorted((x["r"], x["c"], x["density"]) for x in got if x["spatialr"] == g) == plain(own, 24, 22, radius)
    assert seeds.gaussian_peaks(df.limit(0), 24, 22, radius).count() == 0
