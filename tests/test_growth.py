"""How much of the rows an operator shuffles, reads or holds, where that decides what it costs at size."""

import pytest

from pyspark.sql import functions as F

from mosaiq.operators import boundary, order, partitions, seeds, segments, study
from mosaiq.plans import queries
from mosaiq.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """Rows that the jobs of run() write to shuffles, and its result."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        rows, it = {}, store.stageList(None, False, False, none, None).iterator()
        while it.hasNext():
            x = it.next()
            rows[x.stageId()] = x.shuffleWriteRecords()
        return rows

    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before), out


def ensemble(spark, many=6, side=40):
    rows = [(f"r{k}", 3, 1, k, r - 20, c - 20) for k in range(many) for r in range(side) for c in range(side) if (r * 7 + c * 13 + k * 5) % 11 < 3]
    return spark.createDataFrame(rows, "run_id string, spatialr int, ranger int, phase int, r int, c int")


def test_pair_support_shuffles_boundaries_once(spark):
    edges = ensemble(spark).localCheckpoint()
    pairs = spark.createDataFrame([(f"r{a}", f"r{b}", 3.0) for a in range(6) for b in range(a + 1, 6)], "left_run string, right_run string, reach double").localCheckpoint()
    rows, got = shuffled(spark, lambda: boundary.pair_support(edges, pairs).collect())
    assert len(got) == 15 and rows < 1.5 * edges.count()


@pytest.mark.parametrize(("reach", "cells"), [(2.5, 1), (3.0, 1 << 23)])
def test_pair_support_by_tiles_and_by_distances(spark, monkeypatch, reach, cells):
    edges = ensemble(spark)
    pairs = spark.createDataFrame([("r0", "r1", reach), ("r1", "r5", reach / 2), ("r2", "none", reach), ("none", "nor", reach)], "left_run string, right_run string, reach double")
    monkeypatch.setattr(boundary, "CELLS", cells)
    near = sorted(boundary.pair_support(edges, pairs).collect())
    monkeypatch.setattr(boundary, "REACH", 0)
    assert near == sorted(boundary.pair_support(edges, pairs).collect())
    assert [x["support"] for x in near if x["left_run"] == "none"] == [1.0]


def test_boundary_pixels_between_bands(spark):
    rows = [("a", 1, 1, 0, r, c, 1 if r < 64 else 2 + (c > 0)) for r in (-1, 0, 62, 63, 64, 65) for c in range(2)]
    labels = spark.createDataFrame(rows, "run_id string, spatialr int, ranger int, phase int, r int, c int, label long")
    count, got = shuffled(spark, lambda: sorted((x["r"], x["c"]) for x in boundary.boundary_pixels(labels).collect()))
    assert got == [(63, 0), (63, 1), (64, 0), (65, 0)]
    assert count <= len(rows) + 4  # every row once, the first of a band twice


def test_group_scores_scores_pairs_once(spark, monkeypatch):
    calls, real = [], boundary.pair_support
    monkeypatch.setattr(boundary, "pair_support", lambda *a: calls.append(1) or real(*a))
    QUERIES["group_scores"](spark, SF).collect()
    assert len(calls) == 2  # all pairs, and the medoids of neighbouring scales


def test_numeric_summary_goes_by_distinct_values(spark, monkeypatch):
    rows = [("a", float(i % 5), None) for i in range(2000)] + [(None, 1.0, 3.0), (None, 2.0, 5.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    written, real = [], order.stage
    monkeypatch.setattr(order, "stage", lambda t, label: (written.append(t.count()), real(t, label))[1])
    monkeypatch.setattr(order, "GROUP_ROWS", 3)  # selection by bits
    got = {(x["k"], x["metric"]): x for x in study.numeric_summary(df, ["k"], ["x", "y"]).collect()}
    assert max(written) < 50
    a, none, b = got["a", "x"], got[None, "y"], got["b", "x"]
    assert (a["n"], a["mean"], a["median"], a["mad"], a["min"], a["max"]) == (2000, 2.0, 2.0, 1.0, 0.0, 4.0) and a["sd"] == pytest.approx((2 * 2000 / 1999) ** 0.5)
    assert (none["n"], none["mean"], none["median"], none["mad"]) == (2, 4.0, 4.0, 1.0) and none["sd"] == pytest.approx(2**0.5)
    assert (b["n"], b["mean"], b["sd"], b["median"]) == (0, None, None, None) and got["b", "y"]["sd"] is None


def test_equal_lines_are_read_once(spark, monkeypatch):
    rows = [("a", "  RC score: 0.5"), ("a", "RC score: 1.5"), (None, "x = 2"), ("a", "nothing")] * 500 + [("b", "x = 3"), ("b", "x = 1e999")]
    written, real = [], partitions.stage
    monkeypatch.setattr(partitions, "stage", lambda t, label: (written.append(t.count()), real(t, label))[1])
    lines = spark.createDataFrame(rows, "k string, line string")
    got = {(x["k"], x["metric"]): (x["n"], x["mean"], x["sd"]) for x in partitions.printed_spread(lines, ["k"]).collect()}
    want = {(x["k"], x["metric"]): (x["n"], x["mean"], x["sd"]) for x in partitions.metric_spread(partitions.printed_metrics(lines, ["k"]), ["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and written[0] == 6


def test_zonal_stats_count_values_once_a_band(spark):
    labels = spark.createDataFrame([("a", 1 + c // 4, 0, c) for c in range(8)], "run_id string, label long, r int, c int")
    cells = spark.createDataFrame([(0, c, float(c), None if c == 1 else 1.0) for c in range(8)], "r int, c int, m1 double, m2 double")
    stats = segments.zonal_stats(labels, cells, ("m1", "m2"))
    got = {(x["label"], x["band"]): x for x in stats.collect()}
    assert len(got) == 4 and (got[1, "m1"]["median"], got[1, "m1"]["q25"], got[1, "m2"]["n"], got[2, "m1"]["max"]) == (1.5, 0.75, 3, 7.0)
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 2  # one a band


@pytest.mark.parametrize("name", ["seed_coverage", "density_peaks", "region_growing"])
def test_cells_are_made_once(spark, monkeypatch, name):
    """However often a query's steps read the cells, the observations are only aggregated once."""
    made, plain = spark.sparkContext.accumulator(0), queries._cells

    def counted(spark, d):
        def seen(r):
            made.add(1)
            return r

        return plain(spark, d).withColumn("r", F.udf(seen, "int").asNondeterministic()("r"))

    monkeypatch.setattr(queries, "_cells", counted)
    assert QUERIES[name](spark, SF).collect()
    assert made.value == plain(spark, SF).count()


def test_tracks_read_peaks_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(r):
        made.add(1)
        return r

    peaks = spark.createDataFrame([(k * 1000 + i, k, i * 20, i * 20 + k) for k in range(3) for i in range(10)], "node long, step int, r int, c int")
    tracks = seeds.scale_tracks(peaks.withColumn("r", F.udf(seen, "int").asNondeterministic()("r")), 4.0)
    assert {x["track"] for x in tracks.collect()} == {*range(10)}
    assert made.value == 30
