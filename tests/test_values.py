"""Values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import exprs
from mosaiq.operators import boundary, features, flight, ledger, partitions, prescreen, regions, response, seeds, segments, stability, study
from mosaiq.plans.queries import KS, QUERIES


def labels(spark, grid, run="a", spatialr=1, ranger=1, phase=0):
    rows = [(run, spatialr, ranger, phase, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "run_id string, spatialr int, ranger int, phase int, r int, c int, label long")


def one(df, column):
    return df.select(column).first()[0]


def test_segment_sizes_and_radii(spark):
    got = segments.segment_sizes(labels(spark, [[0, 5, 5], [1000, 1000, 0]])).collect()
    assert {r["label"]: r["pixels"] for r in got} == {5: 2, 1000: 2}
    areas = spark.createDataFrame([(math.pi,), (4 * math.pi,)], "a double").select(exprs.equivalent_radius(F.col("a")).alias("r"))
    assert [r[0] for r in areas.collect()] == pytest.approx([1, 2])


def test_scale_match_and_classes(spark):
    df = spark.createDataFrame([("x", 1, 1.0, 2.0), ("x", 1, 0.5, 1.0), ("x", 1, 2.0, 1.0)], "run_id string, spatialr int, q double, area double")
    assert one(segments.scale_match(df), "scale_match") == pytest.approx(0.75)
    q = spark.createDataFrame([(0.1,), (0.3,), (1.0,), (3.0,), (5.0,), (0.25,), (0.5,), (2.0,), (4.0,)], "q double")
    assert [r[0] for r in q.select(segments.size_class(F.col("q"))).collect()] == ["micro", "small", "in_scale", "large", "oversize", "small", "in_scale", "in_scale", "large"]


def test_robust_lower_support(spark):
    df = spark.createDataFrame([([0.7, 0.8, 0.9],), ([],)], "v array<double>").select(response.robust_lower_support(F.col("v")).alias("s"))
    got = [r[0] for r in df.collect()]
    assert got[0] == pytest.approx(0.8 - 1.4826 * 0.1) and got[1] is None


def test_ordinal_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert one(df.select(response.ordinal_distance(F.col("a"), F.col("b")).alias("d")), "d") == 2.0


@pytest.mark.parametrize(("reach", "want"), [(2.0, 0.5), (4.0, 0.75)])
def test_boundary_support(spark, reach, want):
    edges = spark.createDataFrame([("a", r, 2) for r in range(7)] + [("b", r, 3) for r in range(7)], "run_id string, r int, c int")
    pairs = spark.createDataFrame([("a", "b", reach), ("a", "none", reach)], "left_run string, right_run string, reach double")
    got = {r["right_run"]: r["support"] for r in boundary.pair_support(edges, pairs).collect()}
    assert got["b"] == pytest.approx(want) and got["none"] == 0


def test_gain_share(spark):
    rows = [(1, 1.0, 0.0, 0.5001), (2, 1.0, 0.0, 0.5), (3, 1.0, 0.0, 0.4999), (4, 0.5, 0.5, 0.7), (5, 0.3218860997478801, -0.1827726228748731, 0.26015553095917726)]
    got = boundary.gain_share(spark.createDataFrame(rows, "k int, s1 double, s2 double, sm double")).orderBy("k").collect()
    assert [r["handoff"] for r in got] == ["midpoint", "first", "first", "first", "midpoint"]
    assert got[3]["warning"] and got[4]["gain_share"] == pytest.approx(0.8776785855045091)


def test_half_sample_mode(spark):
    rows = [([10.0, 11.0, 12.0, 13.0],), ([1.0, 10.0, 11.0, 12.0, 13.0, 100.0],), ([0.0, 0.0, 1.0],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(prescreen.half_sample(F.col("v")).alias("m")).collect()]
    assert got[0]["mode"] == 10.5 and got[1]["mode"] == 10.5
    assert (got[2]["mode"], got[2]["dropped"]) == (1.0, 2) and got[3]["mode"] is None


def plain_mode(values):
    a = first = sorted(x for x in values if x > 0)
    while len(a) > 2:
        h = (len(a) + 1) // 2
        i = min(range(len(a) - h + 1), key=lambda i: (a[i + h - 1] - a[i], i))
        first, a = (a[i : i + h] if first is a else first), a[i : i + h]
    return (a[0] + a[-1]) / 2, first[0], first[-1]


@pytest.mark.parametrize("held", [2, 7, 1 << 16])
def test_modes_of_any_size(spark, monkeypatch, held):
    monkeypatch.setattr(prescreen, "MODE_VALUES", held)
    r = np.random.default_rng(0)
    own = {2: r.normal(size=150) * 3, 4: np.round(r.gamma(2, size=101), 1), 8: r.uniform(size=5), 16: np.array([0.0, -1.0]), 32: np.array([2.0, 5.0, 0.0])}
    rows = [(i, k, float(x)) for k, values in own.items() for i, x in enumerate(values)]
    got = {x["k"]: x for x in prescreen.modes_by_k(spark.createDataFrame([*rows, (900, 2, None)], "vec_id long, k int, distance double")).collect()}
    assert got.keys() == own.keys() and tuple(got[16])[1:] == (None, None, None, 0, 2)
    for k in (2, 4, 8, 32):
        assert tuple(got[k])[1:] == (*plain_mode(own[k].tolist()), (own[k] > 0).sum(), (own[k] <= 0).sum())


def test_modes_of_all_vectors(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(15_400, 2)).round(3)
    x = x.astype(np.float32).astype(np.float64)
    spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = np.concatenate([np.sqrt(np.partition(((x[i : i + 200, None] - x[None]) ** 2).sum(axis=2), range(33), axis=1)[:, :33]) for i in range(0, len(x), 200)])
    modes = [plain_mode(near[:, k].tolist()) for k in KS]  # place 0 is the vector itself
    spans = [(max(m) - min(m)) / sorted(m)[1] for m in ([y[0] for y in modes[i : i + 3]] for i in range(len(KS) - 2))]
    at = next((i for i, s in enumerate(spans) if s <= 0.1), int(np.argmin(spans)))
    plateau = QUERIES["hsm_plateau"](spark, str(tmp_path)).first()
    assert plateau["k"] == KS[at + 1] and [plateau[c] for c in ("mode", "low", "high")] == pytest.approx([v * 1e6 for v in modes[at + 1]], abs=1)
    levels = {y["level"]: y["ranger"] for y in QUERIES["ranger_levels"](spark, str(tmp_path)).collect()}
    assert [levels[i] for i in range(3)] == pytest.approx([v * 1e6 for v in modes[at + 1]], abs=1)


def test_knn_and_plateau(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 3, 6, 10))], "vec_id long, v array<double>")
    got = {r["vec_id"]: r["distance"] for r in prescreen.knn_distances(v, [2]).collect()}
    assert [got[i] for i in range(5)] == [3, 2, 3, 4, 7]
    m = prescreen.modes_by_k(prescreen.knn_distances(v, [2])).first()
    assert (m["mode"], m["low"], m["high"]) == (3.0, 2.0, 3.0)
    modes = spark.createDataFrame([(2 ** i, x, x, x) for i, x in enumerate((1.00, 1.05, 1.09, 1.40, 1.80))], "k int, mode double, low double, high double")
    p = prescreen.plateau(modes).first()
    assert (p["first_k"], p["last_k"], p["fallback"]) == (1, 4, False)


def test_technical_minsize_and_lags():
    assert prescreen.technical_minsize(0.1, 0.05) == (2, 4, 16)
    assert prescreen.technical_minsize(0.1, 0.025) == (4, 8, 64)
    assert prescreen.lag_ladder(1, 8, 4, 1.0) == [1, 2, 4, 8]


def test_sill_crossings(spark):
    curve = spark.createDataFrame([(i + 1, x) for i, x in enumerate((0.10, 0.30, 0.60, 0.90, 1.0, 1.0))], "lag int, semivariance double")
    sill = spark.createDataFrame([(1.0,)], "sill double")
    got = {r["target"]: r["lag"] for r in prescreen.sill_crossings(curve, sill, [0.25, 0.5, 0.75, 0.95]).collect()}
    assert got == {0.25: 2, 0.5: 3, 0.75: 4, 0.95: 5}


def test_region_merge(spark):
    def run(values, limit, spatial):
        cells = spark.createDataFrame([(c, 0, c, float(v), c) for c, v in enumerate(values)], "cell long, r int, c int, m1 double, region long")
        return {r["c"]: r["region"] for r in regions.merge_regions(cells, ("m1",), limit, spatial).collect()}

    assert len(set(run([0.0, 0.2, 0.4], 0.11, 10.0).values())) == 2
    assert len(set(run([1.0] * 6, 0.1, 0.6).values())) == 3


def test_minimum_distance(spark):
    points = [(i, r, c) for i, (r, c) in enumerate((r, c) for r in range(0, 20, 2) for c in range(0, 20, 3))]
    got = sorted((r["rank"], r["r"], r["c"]) for r in seeds.accept_in_order(spark.createDataFrame(points, "rank long, r int, c int"), 16).collect())
    want = []
    for i, r, c in points:
        if all((r - a) ** 2 + (c - b) ** 2 >= 16 for _, a, b in want):
            want.append((i, r, c))
    assert got == want


def test_tracks(spark):
    peaks = [(1, 0, 10, 10), (2, 0, 60, 60), (11, 1, 11, 10), (12, 1, 60, 61), (21, 2, 40, 40)]
    got = {r["node"]: r["track"] for r in seeds.scale_tracks(spark.createDataFrame(peaks, "node long, step int, r int, c int"), 4.0).collect()}
    assert got == {1: 1, 11: 1, 2: 2, 12: 2}


def test_flight_lines(spark):
    rows = [(line * 100 + i, (line * 40 + 2 * i) * 1_000_000, 0.0, 0.0, 0.0 if line % 2 == 0 else 180.0) for line in range(9) for i in range(11)]
    images = spark.createDataFrame(rows, "image_id long, t_us long, lat double, lon double, yaw double")
    lines = flight.flight_lines(flight.sorties(images, 300), 0.0)
    got = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.first("direction").alias("d")).orderBy("line").collect()
    assert [(r["n"], r["d"]) for r in got] == [(11, 1 if k % 2 == 0 else -1) for k in range(9)]
    placed = lines.withColumns({"along_m": (F.col("image_id") % 100 - 5) * 20.0, "cross_m": (F.floor(F.col("image_id") / 100) - 4) * 30.0})
    block = flight.grid_block(flight.centred_windows(placed, 7), 7).first()
    assert len(block["lines"]) == 7 and block["centre"] < 1e-6


def test_sorties_break_strictly_above_the_gap(spark):
    rows = [(1, 0), (2, 300_000_000), (3, 601_000_001), (4, 86_400_000_000 * 3)]
    images = spark.createDataFrame(rows, "image_id long, t_us long")
    assert [r["sortie"] for r in flight.sorties(images, 300).orderBy("image_id").collect()] == [1, 1, 2, 3]


def test_pixel_stability_and_masks(spark):
    rows = [("v", k, 0, 0, float(x), float(x), float(x)) for k, x in enumerate((1, 2, 4))] + [("v", 0, 0, 1, 0.0, 0.0, 0.0), ("v", 1, 0, 1, 5.0, 0.0, 0.0)]
    obs = spark.createDataFrame(rows, "variant_id string, replicate int, r int, c int, b1 double, b2 double, b3 double")
    got = {r["c"]: r for r in stability.masks(stability.pixel_stability(obs), 3, 2.0).collect()}
    assert (got[0]["valid_count"], got[0]["med_b1"], got[0]["mad"], got[0]["quality"]) == (3, 2.0, 1.0, 1)
    assert got[0]["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert (got[1]["valid_count"], got[1]["stable"], got[1]["quality"]) == (1, 255, 0)


def test_ledger(spark):
    df = spark.createDataFrame([("a", "r1", "failed", 1), ("a", "r1", "ok", 2), ("a", "r2", "ok", 3), ("a", "r2", "failed", 4)], "variant_id string, replicate string, status string, attempt_seq long")
    assert {(r["replicate"], r["status"], r["attempts"]) for r in ledger.latest_attempts(df).collect()} == {("r1", "ok", 2), ("r2", "failed", 2)}
    planned = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r1")], "variant_id string, replicate string")
    assert sorted(tuple(r) for r in ledger.resume_plan(planned, df).collect()) == [("a", "r2"), ("b", "r1")]
    with pytest.raises(Exception, match="unknown status"):
        ledger.check_status(df.withColumn("status", F.lit("odd"))).collect()
    with pytest.raises(ValueError, match="budget"):
        ledger.candidate_population(spark.createDataFrame([(4,)], "spatialr int"), spark.createDataFrame([(1,)], "ranger int"), spark.createDataFrame([(0,), (1,)], "phase int"), 1)


def test_study(spark):
    rows = [("x", "hi", 3.0), ("x", "lo", 1.0), ("y", "hi", 6.0), ("y", "lo", 2.0), ("z", "hi", 9.0)]
    got = study.factor_effects(spark.createDataFrame(rows, "other string, f string, m double"), "f", ["other"], ["m"]).first()
    assert (got["pairs"], got["mean_difference"], got["low_level"]) == (2, -3.0, "hi")
    c = study.correlations(spark.createDataFrame([(float(i), float(i * i)) for i in range(5)], "a double, b double"), ["a", "b"], "spearman").first()
    assert c["r"] == pytest.approx(1.0)


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i, i % 3, i % 3) for i in range(12)], "item long, a int, b int")
    assert one(partitions.adjusted_rand(same), "ari") == pytest.approx(1.0)
    single = spark.createDataFrame([(1, 1, 1)], "item long, a int, b int")
    assert one(partitions.adjusted_rand(single), "ari") is None


def test_valid_mask_and_component(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (255.0, 255.0, 255.0), (0.0, 0.0, 1.0)], "b1 double, b2 double, b3 double")
    assert [r["valid"] for r in features.valid_mask(df, ((0, 0, 0), (255, 255, 255))).collect()] == [False, False, True]
    with pytest.raises(ValueError, match="at least one rule"):
        features.valid_mask(df, ())
    cells = spark.createDataFrame([(0, i, float(i), 2.0 * i, 0.0) for i in range(5)], "r int, c int, m1 double, m2 double, m3 double")
    got = [r["pc1"] for r in features.first_component(cells).orderBy("c").collect()]
    assert got == pytest.approx([(i - 2) * math.sqrt(5) for i in range(5)])


def test_weighted_quantiles_are_steps(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0)], "k string, q double, w double")
    got = segments.weighted_quantiles(df, ["k"], "q", "w", (0.25, 0.5, 0.9)).first()
    assert (got["q25"], got["q50"], got["q90"]) == (1.0, 2.0, 3.0)


def test_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [tuple(r) for r in df.select(exprs.half_up(F.col("x")), exprs.half_even(F.col("x"))).collect()] == [(1, 0), (2, 2), (3, 2)]
