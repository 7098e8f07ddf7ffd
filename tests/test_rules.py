"""Rules, texts, files and studies on worked cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import cli
from mosaiq.functions import exprs
from mosaiq.operators import checks, control_points, features, flight, groups, ledger, partitions, prescreen, regions, segments, study
from mosaiq.plans import config, more_queries
from mosaiq.sources import grids, tables


def one(df):
    return df.first()


def test_refinement_cases(spark):
    good = {"status": groups.ADJACENT, "adjacent": True, "first": "a", "second": "b", "lower": "a", "upper": "b", "field": "radius", "lower_value": 1.0, "upper_value": 3.0, "local_values": [1.0, 2.0, 3.0]}
    cases = [
        ({}, groups.READY), ({"status": groups.APART}, groups.CHOICE), ({"status": groups.NO_FIELD}, groups.UNKNOWN_PAIR), ({"adjacent": False}, groups.NO_NAMES), ({"upper": " "}, groups.NO_NAMES), ({"status": None}, groups.NO_NAMES),
        ({"upper_value": 1.0}, groups.BAD_BOUNDS), ({"lower_value": None}, groups.BAD_BOUNDS), ({"local_values": []}, groups.NO_VALUES), ({"local_values": None}, groups.NO_VALUES), ({"local_values": [1.0, None, 3.0]}, groups.UNORDERED),
        ({"local_values": [1.0, 2.0, 2.0, 3.0]}, groups.REPEATED), ({"local_values": [1.0, 3.0, 2.0]}, groups.UNORDERED), ({"local_values": [1.0, 4.0]}, groups.OUTSIDE), ({"local_values": [1.5, 3.0]}, groups.NO_VALUES), ({"local_values": [1.0, 3.0]}, groups.READY),
    ]
    schema = "i int, status string, adjacent boolean, first string, second string, lower string, upper string, field string, lower_value double, upper_value double, local_values array<double>"
    df = spark.createDataFrame([(i, *(good | c).values()) for i, (c, _) in enumerate(cases)], schema)
    got = {r["i"]: (r["refinement"], r["plan_size"]) for r in groups.refinement_status(df).collect()}
    assert [got[i][0] for i in range(len(cases))] == [w for _, w in cases]
    assert got[0][1] == 3 and got[1][1] == 0 and got[15][1] == 2


def test_top_pair_cases(spark):
    ladder = [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    rows = [(case, g, v, v if case != "odd" else -v) for case in ("near", "far", "odd", "few") for g, v in ladder] + [("none", "a", None, None), ("none", "b", None, 1.0)]
    rows += [("near", "a", 1.0, 1.0)]
    ranked = [("near", "b", 1), ("near", "a", 2), ("near", "c", 3), ("far", "c", 1), ("far", "a", 2), ("far", "b", 3), ("odd", "a", 1), ("odd", "b", 2), ("odd", "c", 3), ("few", "a", 1), ("none", "a", 1), ("none", "b", 2)]
    got = {r["case_id"]: r for r in groups.top_pair(spark.createDataFrame(rows, "case_id string, group_id string, x double, y double"), spark.createDataFrame(ranked, "case_id string, group_id string, rank int"), ("x", "y")).collect()}
    assert (got["near"]["status"], got["near"]["lower"], got["near"]["boundary_side"], got["near"]["lower_value"]) == (groups.ADJACENT, "a", "none", 1.0)
    assert (got["far"]["status"], got["far"]["between"], got["far"]["boundary_side"]) == (groups.APART, ["b"], "upper")
    assert got["odd"]["status"] == groups.DISAGREE and got["odd"]["field"] is None
    assert got["few"]["status"] == groups.NO_PAIR and got["none"]["status"] == groups.NO_FIELD and got["none"]["boundary_side"] == "cannot_determine"


def test_groups_of_a_case_are_ranked_by_their_mean(spark):
    _, ranked = more_queries._ranked(spark, "/root/testdata/sf0.001")
    by_case = {}
    for r in ranked.collect():
        by_case.setdefault(r["case_id"], []).append((r["rank"], -np.floor(r["m"] * 1e9 + 0.5), r["group_id"]))
    assert by_case
    for rows in by_case.values():
        assert [r[0] for r in sorted(rows)] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)


def test_handoff_sources(spark):
    rows = [("a", "a", "b", "m", 1.0, 0.0, 0.7), ("a", "a", "b", "m", 1.0, 0.0, 0.5), ("b", "a", "b", "m", 0.0, 1.0, 0.5), ("a", "a", "b", "m", 1.0, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "first string, lower string, upper string, midpoint string, s1 double, s2 double, sm double")
    assert [r["source"] for r in groups.selected_source(groups.gain_handoff(df)).collect()] == ["midpoint", "lower_bound", "upper_bound", "lower_bound"]
    with pytest.raises(Exception, match="not a candidate"):
        groups.selected_source(df.withColumn("selected", F.lit("z"))).collect()


def test_phases_must_be_equal_with_one_origin(spark):
    runs = [("a", "p0", 0.0, 0.0), ("a", "p1", 0.5, 0.0), ("b", "p0", 0.0, 0.0), ("b", "p1", 0.5, 0.0), ("b", "p1", 0.5, 0.0), ("c", "p0", 0.5, 0.5), ("d", "p0", 0.0, 0.0), ("d", "p0", 0.1, 0.0)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "c"), ("d", "d"), ("a", "z")], "lower string, upper string")
    got = {(r["lower"], r["upper"]): r["phases_equal"] for r in groups.same_phases(spark.createDataFrame(runs, "group_id string, phase_id string, u double, v double"), pairs).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("c", "c"): False, ("d", "d"): False, ("a", "z"): False}


def test_hoover(spark):
    parts = [("whole", "x", 10), ("cut", "y1", 5), ("cut", "y2", 5), ("m1", "z", 6), ("m2", "z", 6), ("lost", "w1", 3), ("lost", "w2", 3), ("big", "w1", 30), ("big", "w2", 30)]
    df = spark.createDataFrame([(a, b) for a, b, n in parts for _ in range(n)], "a string, b string")
    r = one(partitions.hoover_scores(df))
    total = 10 + 10 + 12 + 6 + 60
    assert r["parts"] == 6 and r["matched"] == pytest.approx(10 / total) and r["split"] == pytest.approx((10 + 60) / total) and r["merged"] == pytest.approx(12 / total) and r["missed"] == pytest.approx(6 / total)


def test_p_values_and_pairwise_ranks(spark):
    assert study._tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-9) and study._tail(0.0, 5) == pytest.approx(1.0) and study._tail(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    rows = [(1.0, 10.0, 5.0), (2.0, None, 4.0), (3.0, 30.0, 3.0), (4.0, 20.0, None), (None, 5.0, 1.0), (6.0, 60.0, 0.0), (100.0, 50.0, -7.0)]
    got = {(r["left_metric"], r["right_metric"]): r for r in study.with_p_values(study.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], "spearman")).collect()}
    x = [(a, b) for a, b, _ in rows if a is not None and b is not None]
    ranks = [np.argsort(np.argsort([p[k] for p in x])) for k in (0, 1)]
    assert got["a", "b"]["n"] == 5 and got["a", "b"]["r"] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert got["a", "c"]["r"] == pytest.approx(-1) and got["a", "c"]["p_value"] == pytest.approx(0, abs=1e-6) and 0 < got["a", "b"]["p_value"] < 1


def test_flight_across_the_date_line(spark):
    images = spark.createDataFrame([(0.0, 179.9995), (0.0, -179.9995), (0.0, 179.999)], "lat double, lon double")
    got = flight.local_metres(images, 90.0).collect()
    assert max(r["along_m"] for r in got) - min(r["along_m"] for r in got) < 200


def test_jump_cutoff(spark):
    rows = [("a", v) for v in (1, 1, 1, 2, 2, 2, 3, 3, 50, 60, 70, 80)] + [("b", 5)]
    got = {r["k"]: r["cutoff"] for r in checks.jump_cutoff(spark.createDataFrame(rows, "k string, n int"), "n", ("k",), 1, 1).collect()}
    assert got == {"a": 3, "b": 1}


def test_duplicates_and_stacks_fail(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert ledger.unique_keys(df, "k", "v").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        ledger.unique_keys(df, "k").collect()
    stack = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "r int, c int, b1 double")
    mask = spark.createDataFrame([(0, 0, True), (0, 1, False)], "r int, c int, valid boolean")
    assert {r["c"]: r["b1"] for r in features.masked(features.stack_with_mask(stack, mask, ("b1",)), ("b1",), background=-1.0).collect()} == {0: 1.0, 1: -1.0}
    with pytest.raises(Exception, match="differ at row 0, column 1"):
        features.stack_with_mask(stack, mask.limit(1), ("b1",)).collect()
    with pytest.raises(ValueError, match="no bands b2"):
        features.stack_with_mask(stack, mask, ("b2",))


def test_states_and_omitted_rows(spark):
    rows = spark.createDataFrame([(g, i) for g in "abc" for i in range(4)], "g string, run_id int")
    planned = groups.limited(rows, "g", 2, 3, "run_id")
    got = {(r["g"], r["run_id"]): r["state"] for r in planned.collect()}
    assert len(got) == 12 and got["c", 0] == "omitted: group limit" and got["a", 3] == "omitted: row limit" and got["b", 2] == "planned"
    report = {r["candidate_id"]: r["state"] for r in groups.candidate_report(spark.createDataFrame([("x", "ok"), ("x", "failed"), ("y", "ok"), ("z", None)], "candidate_id string, status string")).collect()}
    assert report == {"x": "partial", "y": "ok", "z": "failed"}


def test_texts(spark):
    df = spark.createDataFrame([(2024.0, "2024:05:01 10:20:30.55", 4500)], "x double, t string, n int")
    r = one(df.select(exprs.fixed4(F.col("x")).alias("f"), exprs.iso_time(exprs.exif_time(F.col("t"))).alias("t"), exprs.rendered("n{n:k}-{x}", n=F.lit(4000), x=F.col("n")).alias("n"), exprs.failures(big=F.col("n") > 5000, small=F.col("n") < 5000, known=F.lit(None).cast("boolean")).alias("bad")))
    assert (r["f"], r["t"], r["n"], r["bad"]) == ("2024.0000", "2024-05-01T10:20:30", "n4k-4500", ["big", "known"])
    with pytest.raises(ValueError, match="unknown field"):
        exprs.rendered("{zz}")
    lines = spark.createDataFrame([("k", " RC score (a): 0.5"), ("k", "x = -1e3"), ("k", "no"), ("k", "1x: 2")], "k string, line string")
    assert {r["metric"]: r["value"] for r in partitions.printed_metrics(lines, ["k"]).collect()} == {"rc_score_a": 0.5, "x": -1000.0}


def test_settings():
    assert config.parse_thresholds("5, 2.5") == [5.0, 2.5] and config.parse_thresholds("none") == [] and config.parse_thresholds(None) == []
    assert config.domain_failures({"a": {"b": 3}, "c": "x"}, {"a.b": lambda v: v > 2, "c": lambda v: v > 2, "d": lambda v: True}) == ["c", "d"]
    assert len(config.preset_variants("blending")) == 4
    config.register_preset("test", {"a.b": [1, 2]}, {"a": {"b": 0, "c": 5}})
    assert config.preset_variants("test") == [{"a": {"b": 1, "c": 5}}, {"a": {"b": 2, "c": 5}}]
    with pytest.raises(ValueError, match="there already"):
        config.register_preset("test", {"a": [1]})


def test_usable_ledger(spark, tmp_path):
    for place, size in (("out/v1", 3), ("out/v2", 0), ("elsewhere", 4)):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "ortho.tif").write_bytes(b"x" * size)
    row = lambda v, rep, status, ortho: ["e", v, rep, status, "0", "c", "p", "o", "f", ortho, "log", "1"]
    rows = [row("v1", "r1", "ok", str(tmp_path / "out/v1/ortho.tif")), row("v2", "r1", "ok", str(tmp_path / "out/v2/ortho.tif")), row("v3", "r1", "ok", str(tmp_path / "out/v3/ortho.tif")), row("v1", "r2", "failed", "NA")]
    schema = ", ".join(f"{c} string" for c in tables.LEDGER)
    tables.write_ledger(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "ledger"))
    got = tables.read_usable(spark, str(tmp_path / "ledger"), str(tmp_path / "out"))
    assert [r["variant_id"] for r in got.collect()] == ["v1"]  # a file of that name in another folder doesn't count
    with pytest.raises(ValueError, match="no usable rows"):
        tables.read_usable(spark, str(tmp_path / "ledger"), str(tmp_path / "elsewhere"))
    with pytest.raises(ValueError, match="not columns"):
        tables.write_ledger(spark.createDataFrame(rows, schema).withColumn("more", F.lit(1)), str(tmp_path / "l2"))
    tables.append_ledger(spark.createDataFrame([row("v9", "r", "odd", "x")], schema), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="unknown status"):
        tables.read_ledger(spark, str(tmp_path / "bad")).collect()
    assert tables.count_inputs(spark, str(tmp_path / "out"), (".TIF",)) == 1  # the empty one is no image
    assert one(tables.newest_file(spark, str(tmp_path / "out"), "*.tif"))["path"].endswith("ortho.tif")


def test_grids_manifests_and_positions(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5), (1, 2, -3.0), (2, 1, None)], "r int, c int, value double")
    grids.write_grid(cells, str(tmp_path / "g.sgrd"), 3, 3)
    assert sorted(tuple(r) for r in grids.read_grid(spark, str(tmp_path / "g.sgrd")).collect()) == [(0, 0, 1.5), (1, 2, -3.0)]
    step = spark.createDataFrame([("a", "ok", {"i": "x"}, {}, {"v": "1"})], tables.STEP)
    tables.write_step_manifest(step, str(tmp_path / "m"))
    assert one(tables.read_step_manifest(spark, str(tmp_path / "m")))["inputs"] == {"i": "x"}
    with pytest.raises(ValueError, match="has the keys"):
        tables.write_step_manifest(step.drop("status"), str(tmp_path / "n"))
    with pytest.raises(Exception, match="without step or status"):
        tables.write_step_manifest(step.withColumn("status", F.lit(" ")), str(tmp_path / "o"))
    tags = [{"SourceFile": "b.jpg", "GPSLatitude": 50.1, "GPSLongitude": 8.0, "DateTimeOriginal": "2024:05:01 10:00:02", "FlightYawDegree": "+90.0"}, {"SourceFile": "a.jpg", "GPSLatitude": 99, "GPSLongitude": 8.0}, {"SourceFile": "c.jpg", "GPSLatitude": 50.0, "GPSLongitude": 8.0, "DateTimeOriginal": "2024:05:01 10:00:00", "FlightYawDegree": 1}]
    (tmp_path / "tags.json").write_text(json.dumps(tags))
    got = tables.read_exif_positions(spark, str(tmp_path / "tags.json")).collect()
    assert [r["source_path"] for r in got] == ["c.jpg", "b.jpg", "a.jpg"] and got[0]["reasons"] == "" and "out of range" in got[2]["reasons"]
    tables.write_json_rows(spark.createDataFrame([("x", 1)], "k string, n int").coalesce(1), str(tmp_path / "j"))
    assert one(tables.read_json_rows(spark, str(tmp_path / "j")))["k"] == "x"


def test_labels_by_mask(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0, 0, 0, -1), ("a", 1, 1, 0, 0, 1, 0), ("a", 1, 1, 0, 1, 0, 4)], "run_id string, spatialr int, ranger int, phase int, r int, c int, label long")
    valid = spark.createDataFrame([(0, 0), (0, 1)], "r int, c int")
    assert {(r["r"], r["c"]): r["label"] for r in segments.exported_labels(rows, valid).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 0}


def test_grid_block_takes_the_middle(spark):
    rows = [(1, line, float(20 * line - 80), 0.0, 10.0 + abs(20 * line - 80)) for line in range(9)] + [(2, 1, 5.0, 300.0, 300.0)]
    got = one(flight.grid_block(spark.createDataFrame(rows, "sortie int, line int, cross_m double, along_m double, radial double"), 3))
    assert (got["first_line"], got["last_line"], got["centre"], got["lines"]) == (3, 5, 0.0, [3, 4, 5])


def test_finalists_and_preflight(spark):
    hand = spark.createDataFrame([("m", "m", "a", "b", 0.7)], "selected string, midpoint string, lower string, upper string, gain_share double")
    got = groups.finalists(hand, spark.createDataFrame([("m", 0.9), ("a", 0.4)], "candidate_id string, score double")).collect()
    assert {(r["role"], r["candidate_id"], r["score"]) for r in got} == {("selected", "m", 0.9), ("midpoint", "m", 0.9), ("lower_bound", "a", 0.4), ("upper_bound", "b", None)}
    assert json.loads(next(r["evidence"] for r in got if r["role"] == "lower_bound")) == {"gain_share": 0.7, "score": 0.4}
    assert tables.preflight({"t": hand}, {"t": {"selected": "string", "gain_share": "int", "z": ""}, "u": {}}) == ["t.gain_share: double in place of int", "t.z: missing", "u: no such table"]


def test_study_commands(spark, tmp_path, capsys):
    assert cli.main(["plan", "blending", str(tmp_path / "plan.json"), "--replicates", "2"]) == 0
    assert len(json.loads((tmp_path / "plan.json").read_text())) == 8
    row = lambda v, s: ["e", v, "1", s, "0", "c", "p", "o", "f", "x", "log", "1"]
    schema = ", ".join(f"{c} string" for c in tables.LEDGER)
    tables.write_ledger(spark.createDataFrame([row("v1", "failed"), row("v1", "ok"), row("v2", "failed")], schema).coalesce(1), str(tmp_path / "l"))
    from mosaiq.cli import ledger_state

    assert [tuple(r) for r in ledger_state(spark, str(tmp_path / "l")).collect()] == [("v1", "1", "ok", 2), ("v2", "1", "failed", 1)]


def test_scores_fall_back(spark):
    rows = [(1, 0.4, 0.9, 1.3), (2, 0.4, 0.9, 1.3), (3, 0.4, 0.9, 1.3), (4, None, 0.9, 1.3), (5, None, 0.9, -0.2), (6, None, 0.9, 0.6)]
    flags = ", ".join(f"false as {c}" for c in ("scale_jump", "spatial_jump", "flutter_flag", "edge_loaded"))
    own = spark.createDataFrame(rows, "spatialr int, match_support double, x double, legacy_score double").selectExpr("*", flags.split(", ")[0], *flags.split(", ")[1:], "true as centered", "0.0 as score", "'x' as outcome")
    ensemble = spark.createDataFrame([(1, 0.7, True), (2, 0.7, False)], "spatialr int, score double, evaluable boolean")
    boundary = spark.createDataFrame([(4, 0.5), (5, 0.5)], "spatialr int, support double")
    got = {r["spatialr"]: (r["method"], round(r["score"], 9), r["outcome"]) for r in groups.group_scores(own, ensemble, boundary).collect()}
    assert got == {
        1: ("ensemble", 0.7, "ensemble_support_evaluable"),
        2: ("ensemble", 0.0, "ensemble_support_not_evaluable"),
        3: ("scale_match", 0.4, "stable_with_warnings"),
        4: ("legacy_by_boundary", 0.5, "stable_with_warnings"),
        5: ("legacy_by_boundary", 0.0, "stable_with_warnings"),
        6: ("legacy", 0.6, "stable_with_warnings"),
    }


def test_headings_that_cancel(spark):
    images = spark.createDataFrame([(1, 0.0), (1, 90.0), (2, 10.0)], "sortie int, yaw double")
    assert {r["sortie"]: r["axis"] is None for r in flight.dominant_axis(images, "sortie").collect()} == {1: True, 2: False}
    with pytest.raises(Exception, match="headings cancel"):
        flight.dominant_axis(images, "sortie", strict=True).collect()


def test_profiles_as_wide_rows(spark):
    design = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "run_id string, k int")
    chain = spark.createDataFrame([("a", '{"status": "done", "n": "x"}'), ("b", "{")], "run_id string, json string")
    got = {r["run_id"]: tuple(r)[1:] for r in study.wide_profiles(design, {"chain": chain}, {"n": ("chain", "$.n", "int"), "s": ("chain", "$.status", "string")}, report="chain").collect()}
    assert got == {"a": (1, None, "done", "done"), "b": (2, None, None, "invalid_or_empty_report"), "c": (3, None, None, "not_run")}


def test_jumps_among_many_equal_sizes(spark):
    r = np.random.default_rng(3)
    rows = [(k, int(v)) for k in range(12) for v in np.sort(r.choice([1, 2, 3, 5, 8, 40, 41, 300], 9 + 4 * k))]
    got = {x["k"]: (x["cutoff"], x["n"]) for x in checks.jump_cutoff(spark.createDataFrame(rows, "k int, v int"), "v", ("k",), 5, 2).collect()}
    for k in range(12):
        x = np.array([v for g, v in rows if g == k], dtype=float)
        logs = np.log(x)
        smooth = [np.median(logs[i - min(i, len(x) - 1 - i, 2) : i + min(i, len(x) - 1 - i, 2) + 1]) for i in range(len(x))] if len(x) > 5 else logs
        bends = [np.floor((smooth[i + 1] - 2 * smooth[i] + smooth[i - 1]) * 1e9 + 0.5) for i in range(1, len(x) - 1)]
        assert got[k] == (max(2, round(x[1 + int(np.argmax(bends))])) if len(x) >= 10 else 2, len(x))


def test_scales_and_samples(spark):
    scales = prescreen.scales_frame(spark, [0.04, 1.0, 2.5], 0.5)
    assert [tuple(r)[3:] for r in scales.collect()] == [(1, 1), (2, 13), (5, 79)]
    ranger = spark.createDataFrame([(0.7,)], "ranger double")
    assert {r["ranger"] for r in prescreen.with_scene_ranger(scales, ranger).collect()} == {0.7}
    with pytest.raises(ValueError, match="one ranger"):
        prescreen.with_scene_ranger(scales, ranger.limit(0))
    rows = spark.range(100).select(F.col("id").alias("k"))
    some = {r["k"] for r in ledger.hash_sample(rows, 7, "k").collect()}
    assert len(some) == 7 and some == {r["k"] for r in ledger.hash_sample(rows.repartition(5), 7, "k").collect()}


def test_one_resolution(spark):
    heads = lambda rows: spark.createDataFrame(rows, "xres double, yres double")
    assert checks.one_resolution(heads([(0.5, -0.5), (0.5 + 1e-9, -0.5)])).first()["resolution"] == pytest.approx(0.5)
    for rows in ([(0.5, 0.5), (0.7, 0.5)], []):
        with pytest.raises(Exception, match="no or several"):
            checks.one_resolution(heads(rows)).collect()


def test_merging_inside_a_window(spark):
    cells = spark.createDataFrame([(r, c, float(10 * (c // 2))) for r in range(6) for c in range(6)], "r int, c int, m1 double")
    merged, report = regions.merge_in_window(cells, ("m1",), 2, 1.0, None, 1, 0, 4, 4)
    rows = merged.collect()
    assert len(rows) == 16 and {r["r"] for r in rows} == {1, 2, 3, 4}
    assert len({r["region"] for r in rows}) == 2 and all(len({r["m1"] for r in rows if r["region"] == k}) == 1 for k in {r["region"] for r in rows})
    assert tuple(report.first()) == (16, report.first()["initial_regions"], 2, 0.0) and report.first()["initial_regions"] >= 4


def test_control_points(spark):
    surface = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "r int, c int, z double")
    points = spark.createDataFrame([(1, 1.5, 2.25, 100.0, 200.0), (2, 9.0, 0.0, 1.0, 2.0)], "gcp_id int, row double, column double, x double, y double")
    table = control_points.control_points(points, surface, "z")
    assert sorted(map(tuple, table.collect())) == [("point1", 100.0, 200.0, 17.25), ("point2", 1.0, 2.0, None)]
    marks = spark.createDataFrame([(3, 1, 100, 12, 5.0, 6.0), (1, 12, 101, 12345, 1.0, 2.0), (1, 2, 100, 7, None, None)], "gcp int, part_folder int, media_folder int, image_file int, x double, y double")
    shown = control_points.image_points(marks)
    assert [r["image_path"] for r in shown.collect()] == ["PART_12/101MEDIA/DJI_12345.JPG", "PART_01/100MEDIA/DJI_0012.JPG"]
    assert sorted(map(tuple, control_points.unmatched_points(table, shown).collect())) == [("point2", "marks"), ("point3", "points")]


def test_one_baseline_moves_rows_once(spark):
    base = spark.range(4).selectExpr("id as candidate_id", "5 as spatialr", "1.0D as ranger", "8 as minsize")
    grid = checks.one_baseline(checks.perturbation_grid(base, 0.1, 5, 1))
    assert grid.count() == 4 * 27
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="not one baseline: 1"):
        checks.one_baseline(grid.unionByName(grid.where("candidate_id = 1"))).count()


def test_half_sample_sorts_once(spark):
    one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda x: x.cast("double") * x).alias("v"))
    found = one.select(prescreen.half_sample(F.col("v")).alias("m"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") == 1
    assert tuple(found.first()["m"]) == (2.5, 1.0, 25.0, 9, 0)


def test_flat_curves_have_no_knee(spark):
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "lag int, semivariance double")
    assert tuple(prescreen.knee(flat).first()) == (1, 5.0, None)
    assert tuple(prescreen.knee(flat.where("lag = 2")).first()) == (2, 5.0, None)
    assert tuple(prescreen.sill(flat.withColumn("semivariance", F.lit(0.0))).first()) == (0.0, None)


def test_mean_position_in_any_order(spark):
    rows = [(50 + (i * 7 % 97) / 10000, 8 + (i * 5 % 89) / 10000) for i in range(3000)]
    found = set()
    for order in (rows, rows[::-1], sorted(rows)):
        own = spark.createDataFrame([*order, (60.0, 9.0)], "lat double, lon double").coalesce(1)
        found.add(tuple(flight.local_metres(own, 45.0).where("lat = 60").select("along_m", "cross_m").first()))
    assert len(found) == 1


def test_one_sortie_is_several_tasks(spark):
    rows = [(1, i, i * 2_000_000 + (60_000_000 if i > 1500 else 0), float(0 if i // 100 % 2 else 180) if i % 50 else 90.0) for i in range(3000)]
    images = spark.createDataFrame(rows, "sortie int, image_id long, t_us long, yaw double")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = flight.flight_lines(images, 0.0).select("image_id", "direction", "line", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset(setting)
    assert len({r["task"] for r in found}) > 1
    line, off, last, want = 0, True, None, []
    for _, i, t, yaw in rows:
        way = 1 if yaw <= 90 else -1
        if yaw != 90.0:
            line += off or way != last[1] or t - last[0] > 10_000_000
            want.append((i, way, line))
        off, last = yaw == 90.0, (t, way)
    assert sorted((r["image_id"], r["direction"], r["line"]) for r in found) == want


def test_grid_block_has_no_window_of_a_sortie(spark):
    windows = spark.createDataFrame([(s, k, float(k), 0.0, 1.0) for s in (1, 2) for k in range(-2, 3)], "sortie int, line int, cross_m double, along_m double, radial double")
    found = flight.grid_block(windows, 4)
    assert "windowspecdefinition(sortie" not in found._jdf.queryExecution().analyzed().toString()
    assert (found.first()["sortie"], found.first()["lines"]) == (1, [-2, -1, 0, 1])


def test_ari_counts_cells_that_agree_once(spark, monkeypatch):
    staged = {}

    def spy(df, label):
        staged[label] = df.localCheckpoint()
        return staged[label]

    monkeypatch.setattr(partitions, "stage", spy)
    rows = [(4, f"run{k}", r, c, 1 + r // 8 + (c // 8) * 10 + k * (c == 0)) for k in range(3) for r in range(16) for c in range(16)]
    got = one(partitions.ari_stability(spark.createDataFrame(rows, "spatialr int, run_id string, r int, c int, label long")))
    assert got["pairs"] == 3 and 0 < got["mean"] < 1
    assert staged["alike"].count() == 6  # of 256 cells
