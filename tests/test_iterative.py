"""Iterative operators against plain NumPy twins on small random grids, and worked counterexamples."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import checks, ledger, order, partitions, prescreen, regions, seeds, tiles


def grid(spark, values, regions_of):
    rows = [(int(r * 1_000_000 + c), r, c, float(v), int(regions_of[r][c])) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "cell long, r int, c int, m1 double, region long")


def merge_twin(values, labels, limit, spatial):
    labels = np.array(labels)
    values = np.array(values, dtype=float)
    while True:
        pairs = set()
        for a, b in ((labels[:, :-1], labels[:, 1:]), (labels[:-1], labels[1:])):
            pairs |= {(min(x, y), max(x, y)) for x, y in zip(a.ravel().tolist(), b.ravel().tolist(), strict=True) if x != y}
        priced = []
        for x, y in pairs:
            at = np.argwhere((labels == x) | (labels == y))
            v = values[at[:, 0], at[:, 1]]
            rms, far = math.sqrt(v.var()), math.sqrt(at.var(axis=0).sum())
            if rms <= limit + 1e-12 and far <= spatial + 1e-12:
                priced.append((round(max(rms / limit, far / spatial), 12), x, y))
        used, won = set(), []
        for _, x, y in sorted(priced):
            if x not in used and y not in used:
                used |= {x, y}
                won.append((x, y))
        if not won:
            return labels.tolist()
        for x, y in won:
            labels[labels == y] = x


def test_merge_takes_a_whole_matching_a_round(spark):
    got = regions.merge_regions(grid(spark, [[0, 2, 6, 12]], [[0, 1, 2, 3]]), ("m1",), 3.2)
    assert {r["c"]: r["region"] for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_merge_equals_the_plain_loop(spark):
    r = np.random.default_rng(5)
    values = np.round(r.normal(size=(6, 6)) * 3, 2)
    labels = np.arange(36).reshape(6, 6)
    got = regions.merge_regions(grid(spark, values, labels), ("m1",), 2.0, 1.3)
    found = np.empty((6, 6), dtype=int)
    for x in got.collect():
        found[x["r"], x["c"]] = x["region"]
    assert found.tolist() == merge_twin(values, labels, 2.0, 1.3)
    assert len(np.unique(found)) < 30


def test_merge_of_tiles_equals_rounds_of_joins(spark, monkeypatch):
    """Tiles settle rounds with a halo; one too small grows, and beyond the greatest rounds go by joins."""
    values = np.random.default_rng(9).integers(0, 12, size=(22, 27))  # whole, so that sums are the same in any order
    labels = np.arange(22 * 27).reshape(22, 27)
    names, plain = [], regions.stage
    monkeypatch.setattr(regions, "stage", lambda df, label: names.append(label) or plain(df, label))
    monkeypatch.setattr(tiles, "SIDE", 8)
    results = []
    for halo, most in ((2, 1), (2, 64), (8, 64)):
        monkeypatch.setattr(regions, "MERGE_HALO", halo)
        monkeypatch.setattr(regions, "MOST_HALO", most)
        names.clear()
        results.append({(x["r"], x["c"]): x["region"] for x in regions.merge_regions(grid(spark, values, labels), ("m1",), 2.5, 1.6).collect()})
        assert ("open-edges" in names) == (most < halo)  # no table a round of joins where tiles do
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 22 * 27 and len({*results[0].values()}) < 300


def coverage_twin(cells, own, limit):
    far = sorted((-min((r - a) ** 2 + (c - b) ** 2 for _, a, b in own), r, c) for r, c in cells)
    more = []
    for d, r, c in far:
        if -d > limit * limit and all((r - a) ** 2 + (c - b) ** 2 > limit * limit for _, a, b in more):
            more.append((max(k for k, *_ in own) + 1 + len(more), r, c))
    return sorted([*own, *more])


def test_coverage_begins_with_the_farthest_cell(spark):
    cells = spark.createDataFrame([(0, c) for c in range(21)], "r int, c int")
    got = seeds.complete_coverage(cells, spark.createDataFrame([(7, 0, 0)], "rank long, r int, c int"), 2)
    assert sorted((r["rank"], r["c"]) for r in got.collect()) == [(7, 0), (8, 20), (9, 17), (10, 14), (11, 11), (12, 8), (13, 5)]


def test_coverage_equals_the_plain_loop(spark):
    r = np.random.default_rng(1)
    cells = [(a, b) for a in range(17) for b in range(14) if r.random() < 0.8]
    own = [(3, *cells[5]), (9, *cells[40])]
    got = seeds.complete_coverage(spark.createDataFrame(cells, "r int, c int"), spark.createDataFrame(own, "rank long, r int, c int"), 4)
    assert sorted(tuple(x) for x in got.select("rank", "r", "c").collect()) == coverage_twin(cells, own, 4)
    assert seeds.complete_coverage(spark.createDataFrame(cells[:3], "r int, c int"), spark.createDataFrame([], "rank long, r int, c int"), 4).count() == 0


def test_seeds_move_to_the_nearest_valid_cell_however_far(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 50, 50), (3, 9, 40)], "rank long, r int, c int")
    valid = spark.createDataFrame([(0, 3), (3, 0), (49, 51)], "r int, c int")
    got = {x["rank"]: (x["r"], x["c"]) for x in checks.snap_to_valid(points, valid).collect()}
    assert got == {1: (0, 3), 2: (49, 51), 3: (0, 3)}
    assert checks.snap_to_valid(points, valid.limit(0)).count() == 0 and checks.snap_to_valid(points.limit(0), valid).count() == 0


def test_quantiles_over_ranges_equal_those_of_groups(spark):
    r = np.random.default_rng(0)
    rows = [(k, float(v)) for k, n in (("a", 101), ("b", 1), ("c", 40)) for v in np.round(r.normal(size=n), 1)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.05, 0.5, 0.951, 1.0]
    one, two = ({x["k"]: x["q"] for x in order.quantiles(df, ["k"], "v", at, n).collect()} for n in (1000, 10))
    assert one.keys() == two.keys() == {"a", "b", "c"}
    for k in one:
        want = np.quantile([v for g, v in rows if g == k and v is not None], at)
        assert one[k] == pytest.approx(want) and two[k] == pytest.approx(want)
    placed = order.sum_before(spark.range(50).repartition(7), ["id"], F.col("id"), "before").collect()
    assert all(x["before"] == x["id"] * (x["id"] - 1) // 2 for x in placed)


def test_nearest_neighbours_in_waves(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(60, 3)), 1)
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, [1.0]), (101, [3.0]), (102, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    monkeypatch.setattr(prescreen, "WAVE_BYTES", 800)
    got = {(y["vec_id"], y["k"]): y["distance"] for y in prescreen.knn_distances(df, [1, 5]).collect()}
    for i in range(60):
        d = sorted(math.dist(x[i], x[j]) for j in range(60) if j != i)
        assert got[i, 1] == pytest.approx(d[0], abs=1e-9) and got[i, 5] == pytest.approx(d[4], abs=1e-9)
    assert got[100, 1] == 2.0 and (100, 5) not in got and (102, 1) not in got
    assert prescreen.knn_distances(df, [1], 10).count() <= 10


def test_sampled_variogram_and_stable_seeds(spark):
    cells = spark.createDataFrame([(r, c, float(r * c % 7), 0.0, 1.0) for r in range(9) for c in range(9)], "r int, c int, m1 double, m2 double, m3 double")
    whole = {(x["lag"], x["direction"]): x for x in prescreen.variogram(cells, [1, 2]).collect()}
    part = {(x["lag"], x["direction"]): x for x in prescreen.sampled_variogram(cells, [1, 2], 10).collect()}
    every = {(x["lag"], x["direction"]): x for x in prescreen.sampled_variogram(cells, [1, 2], 1000).collect()}
    assert all(x["pairs"] == 10 for x in part.values()) and {k: v["semivariance"] for k, v in every.items()} == {k: v["semivariance"] for k, v in whole.items()}
    tracks = spark.createDataFrame([(1, 5, 5, 2, 3), (1, 7, 5, 2, 4), (2, 6, 6, 2, 9), (3, 30, 30, 3, 1)], "track long, r int, c int, scales int, runs int")
    got = [(x["rank"], x["r"], x["c"]) for x in seeds.stable_seeds(tracks, "runs", 16).orderBy("rank").collect()]
    assert got == [(1, 30, 30), (2, 6, 6)]


def growth_twin(values, starts):
    """A queue in order of priority: least squared distance, then the edge's smaller and greater cell."""
    label, queue = {}, []

    def take(p, k):
        label[p] = k
        for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)):
            if q in values and values[p] is not None and values[q] is not None:
                heapq.heappush(queue, ((values[p] - values[q]) ** 2, min(p, q), max(p, q), q, k))

    for k, p in sorted(starts.items()):
        if p in values and p not in label:
            label[p] = k
    for p, k in list(label.items()):
        take(p, k)
    while queue:
        *_, q, k = heapq.heappop(queue)
        if q not in label:
            take(q, k)
    return label


@pytest.mark.parametrize("side, seed", [(256, 0), (4, 1), (2, 2), (1, 3), (3, 4)])
def test_growing_equals_a_queue(spark, monkeypatch, side, seed):
    monkeypatch.setattr(tiles, "SIDE", side)
    r = np.random.default_rng(seed)
    values = {(a, b): None if r.random() < 0.03 else float(np.round(r.normal() * 2)) for a in range(9) for b in range(11) if r.random() < 0.85}
    places = sorted(values)
    starts = {3: places[4], 8: places[-6], 5: places[30], 6: places[30], 9: (50, 50)}
    cells = spark.createDataFrame([(a, b, v) for (a, b), v in values.items()], "r int, c int, m1 double")
    got = regions.grow_regions(cells, spark.createDataFrame([(k, *p) for k, p in starts.items()], "rank long, r int, c int"), ("m1",)).collect()
    assert len(got) == len(values) and {(x["r"], x["c"]): x["label"] for x in got if x["label"] is not None} == growth_twin(values, starts)
    none = regions.grow_regions(cells, spark.createDataFrame([], "rank long, r int, c int"), ("m1",))
    assert none.count() == len(values) and none.where("label is not null").count() == 0


def test_a_long_way_grows_whole(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SIDE", 50)
    cells = spark.range(3000).selectExpr("0 as r", "cast(id as int) as c", "cast(id as double) as m1")
    got = regions.grow_regions(cells, spark.createDataFrame([(7, 0, 0)], "rank long, r int, c int"), ("m1",))
    assert got.where("label = 7").count() == 3000


@pytest.mark.parametrize("side, steps", [(256, regions.STEPS4), (3, regions.STEPS4), (2, regions.STEPS8), (4, regions.STEPS8)])
def test_components_by_tiles(spark, monkeypatch, side, steps):
    monkeypatch.setattr(tiles, "SIDE", side)
    r = np.random.default_rng(side)
    cells = {(a - 5, b - 4): (int(r.integers(0, 2)), r.choice(["x", "y", None], p=[0.6, 0.3, 0.1])) for a in range(12) for b in range(13) if r.random() < 0.9}
    key = {p: (p[0] + 20) * 1000 + p[1] + 20 for p in cells}
    region = dict(key)
    while True:
        before = dict(region)
        for (a, b), v in cells.items():
            for x, y in steps:
                q = (a + x, b + y)
                if None not in v and cells.get(q) == v:
                    region[a, b] = region[q] = min(region[a, b], region[q])
        if before == region:
            break
    df = spark.createDataFrame([(key[p], *p, int(v[0]), None if v[1] is None else str(v[1])) for p, v in cells.items()], "cell long, r int, c int, s int, t string").repartition(3)
    got = regions.connected(df, ["s", "t"], steps)
    assert {(x["r"], x["c"]): x["region"] for x in got.collect()} == region and got.columns[0] == "cell"
    assert regions.connected(df.limit(0), ["s"], steps).count() == 0


def test_selection_of_places(spark):
    odd = [0.0, -0.0, 1e-310, -1e-310, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), 3.5, 3.5, -2.0]
    r = np.random.default_rng(4)
    rows = [("odd", v) for v in odd] + [(None, v) for v in (2.0, 1.0, None)] + [("hot", 7.25)] * 990 + [("hot", float(v)) for v in r.normal(size=10) * 1e5] + [("wide", float(v)) for v in r.normal(size=300) * 10.0 ** r.integers(-300, 300, 300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    counts = {k: sum(g == k and v is not None for g, v in rows) for k in ("odd", "hot", "wide", None)}
    asked = [(k, i) for k, n in counts.items() for i in {0, 1, n // 3, n // 2, n - 2, n - 1}] + [("none", 0), ("odd", 99)]
    got = {(x["k"], x["at"]): x["value"] for x in order.nth_values(df, ["k"], "v", spark.createDataFrame(asked, "k string, at long")).collect()}
    for k, n in counts.items():
        want = np.sort(np.array([v for g, v in rows if g == k and v is not None]))  # NaN last
        for i in {0, 1, n // 3, n // 2, n - 2, n - 1}:
            assert got.pop((k, i)) == pytest.approx(want[i], rel=0, abs=0, nan_ok=True)
    assert not got
    one = order.nth_values(df.where("k = 'hot'"), [], "v", spark.createDataFrame([(500,)], "at long"))
    assert [x["value"] for x in one.collect()] == [7.25]


def test_percentile_cut_with_one_hot_value(spark):
    df = spark.createDataFrame([("a", 1.0)] * 99 + [("a", 5.0)] + [("b", float(i)) for i in range(10)] + [("c", None)], "k string, v double")
    got = {x["k"]: (x["threshold"], x["n"]) for x in checks.percentile_cut(df, "v", 20.0, 0.5, ("k",)).collect()}
    assert got == {"a": (1.0, 100), "b": (8.0, 10)}


def test_rand_index_leaves_incomplete_pairs_out(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), (None, "x"), ("a", None), (None, None)], "a string, b string")
    whole = partitions.adjusted_rand(df).first()
    assert whole["items"] == 4 and whole["ari"] == partitions.adjusted_rand(df.dropna()).first()["ari"]
    assert partitions.hoover_scores(df).first() == partitions.hoover_scores(df.dropna()).first()


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e8, 1e12])
def test_nearest_neighbours_far_from_the_origin(spark, offset):
    x = np.random.default_rng(8).normal(size=(200, 4)) + offset
    got = {(y["vec_id"], y["k"]): y["distance"] for y in prescreen.knn_distances(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, v array<double>"), [1, 3]).collect()}
    for i in range(200):
        d = sorted(math.dist(x[i], x[j]) for j in range(200) if j != i)
        assert got[i, 1] == pytest.approx(d[0], rel=1e-12) and got[i, 3] == pytest.approx(d[2], rel=1e-12)


def test_resuming_needs_filled_fields_and_levels_come_from_tables(spark):
    planned = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "variant_id string, replicate string")
    row = lambda v, status, log: (v, "1", status, 1, "c", "p", "o", "f", log)
    done = spark.createDataFrame([row("a", "ok", "log"), row("b", "ok", " "), row("c", "failed", "log"), row("d", "ok_no_ortho", None)], "variant_id string, replicate string, status string, attempt_seq int, " + ", ".join(f"{c} string" for c in ledger.KEPT))
    assert sorted(r["variant_id"] for r in ledger.resume_plan(planned, done, filled=ledger.KEPT).collect()) == ["b", "c", "d"]
    assert [r["variant_id"] for r in ledger.resume_plan(planned, done).collect()] == ["c"]
    levels = spark.createDataFrame([(1, "u"), (2, "v"), (1, None)], "x int, y string")
    grid = ledger.factor_grid(spark, {"x": levels, "y": levels.select("y")})
    assert sorted(r["variant_id"] for r in grid.collect()) == ["x-1_y-u", "x-1_y-v", "x-2_y-u", "x-2_y-v"]
    with pytest.raises(ValueError, match="budget"):
        ledger.candidate_population(levels.select(F.col("x").alias("spatialr")), levels.select(F.col("x").alias("ranger")), levels.select(F.col("x").alias("phase")), 26)


def test_labels_in_long_chains_have_one_row(spark):
    edges = [(i, i + 1) for i in range(1, 13)] + [(0, 13), (20, 21), (21, 22), (22, 23), (19, 22)]
    got = sorted(map(tuple, regions.join_labels(spark.createDataFrame(edges, "u long, v long")).select("region", "to").collect()))
    assert got == [(i, 0) for i in range(1, 14)] + [(i, 19) for i in range(20, 24)]
