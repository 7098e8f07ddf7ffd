"""What a group of runs says as a whole: response summary, candidate space, top pair, refinement of the interval between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.exprs import array_median, clip, legacy_score
from mosaiq.operators.response import LIMITS, above, both_ways, dominance_pairs, group_diagnostics, ordinal_distance, robust_lower_support, run_pairs, spatial_stability
from mosaiq.operators.segments import regime
from mosaiq.sources.stage import stage

#: Outcomes of the older ladder of rules.
OUTCOMES = ("scale_jump_detected", "unstable_spatial_response", "unstable_distribution_response", "stable_representative_candidate", "stable_with_warnings")
#: What is known of the two best scales.
ADJACENT, APART = "adjacent_top_pair_confirmed", "non_adjacent_top_pair_possible_bimodal_or_multimodal"
NO_PAIR, NO_FIELD, DISAGREE = "cannot_determine_missing_top_pair", "cannot_determine_no_explicit_scale_coordinate", "cannot_determine_scale_order_disagreement"

#: States of the interval between the two best scales, and of the handoff.
CHOICE, UNKNOWN_PAIR = "step9b_user_choice_required_bimodal_or_multimodal", "step9b_blocked_cannot_determine_scale_continuity"
NO_NAMES, BAD_BOUNDS = "step9b_blocked_missing_top_pair_metadata", "step9b_blocked_invalid_interval_bounds"
NO_VALUES, REPEATED = "step9b_blocked_missing_explicit_local_scale_coordinates", "step9b_blocked_local_coordinate_duplicate"
UNORDERED, OUTSIDE = "step9b_blocked_local_coordinate_not_strictly_ordered", "step9b_blocked_local_coordinate_outside_interval"
READY = "step9b_ready_adjacent_interval"
NO_GAIN, NO_MIDPOINT = "step9b_no1_retained_invalid_reference_gain", "step9b_no1_retained_midpoint_uninterpretable"
MIDPOINT, RETAINED = "step9b_midpoint_gain_share_handoff", "step9b_no1_retained_gain_share"


def weighted_medoids(pairs: DataFrame, spatial: DataFrame, group: str = "spatialr", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The run of each group with the least mean distance to the others: group, medoid_run, medoid_mean, medoid_max.

    Distances are weighted sums of the ordinal, the histogram and the spatial one; ties at 1e-9 go to the smaller run_id.
    """
    both = pairs.join(spatial, [group, "left_run", "right_run"], "left")
    distance = weights[0] * F.col("ordinal") + weights[1] * F.col("histogram") + weights[2] * F.coalesce("spatial", F.lit(0.0))
    mean = both_ways(both.withColumn("_d", distance), group, "_d").groupBy(group, "run_id").agg(F.avg("v").alias("mean"), F.max("v").alias("most"))
    key = F.struct(F.floor(F.col("mean") * 1e9 + 0.5), F.col("run_id"))
    best = mean.groupBy(group).agg(F.min_by(F.struct("run_id", "mean", "most"), key).alias("x"))
    return best.select(group, F.col("x.run_id").alias("medoid_run"), F.col("x.mean").alias("medoid_mean"), F.col("x.most").alias("medoid_max"))


def legacy_outcome(jump: Column, spatial: Column, flutter: Column, edge: Column, centered: Column, score: Column) -> Column:
    """The older ladder of rules, kept as a diagnostic."""
    return F.when(jump, OUTCOMES[0]).when(spatial, OUTCOMES[1]).when(flutter | edge, OUTCOMES[2]).when(centered & (score >= 0.75), OUTCOMES[3]).when(centered, OUTCOMES[4]).otherwise(OUTCOMES[2])


def current_score(ensemble: Column, match: Column, legacy: Column, boundary: Column) -> Column:
    """Ensemble support where there is one, else the clipped scale match, else the older score, by the boundary's if known."""
    one = lambda x: clip(x, 0.0, 1.0)
    return F.coalesce(ensemble, F.when(match.isNotNull(), one(match)), F.when(boundary.isNull(), legacy).otherwise(one(legacy) * one(boundary)))


def group_response(runs: DataFrame, dominance: DataFrame, group: str = "spatialr", limits: dict[str, float | None] = LIMITS, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row a group: diagnostics, distances, spatial stability, medoid, flutter, jumps, compatible runs, scores.

    runs: one row a run as run_summary gives it; dominance: one row a run as spatial_dominance gives it. Both are
    summaries, so pairs within a group are few.
    """
    runs, dominance = stage(runs, "runs"), stage(dominance, "dominance")
    pairs, spatial = stage(run_pairs(runs, group), "run-pairs"), dominance_pairs(dominance, group)
    far = pairs.groupBy(group).agg(F.avg("combined").alias("pair_distance_mean"), F.max("combined").alias("pair_distance_max"))
    medoid = stage(weighted_medoids(pairs, spatial, group, weights), "medoids")
    regimes = runs.withColumn("_regime", regime(F.col("lower_tail"), F.col("central"), F.col("upper_tail")))
    values = F.collect_list("scale_match")
    support = regimes.groupBy(group).agg(
        F.count("scale_match").alias("match_count"),
        array_median(values).alias("match_median"),
        robust_lower_support(values).alias("match_support"),
        (F.count_distinct("_regime") - 1).alias("regime_switches"),
        (F.count_distinct("dominant_class") - 1).alias("class_switches"),
        values.alias("_values"),
    )
    support = support.withColumn("match_mad", array_median(F.transform("_values", lambda x: F.abs(x - F.col("match_median"))))).drop("_values")
    centre = runs.select(F.col("run_id").alias("medoid_run"), F.col("classes").alias("_centre"))
    near = runs.join(medoid.join(centre, "medoid_run"), group, "left").withColumn("_d", F.coalesce(ordinal_distance(F.col("classes"), F.coalesce("_centre", "classes")), F.lit(0.0)))
    within = F.lit(True) if limits["max_flutter"] is None else F.col("_d") <= limits["max_flutter"]
    counted = near.groupBy(group).agg(F.count_if(within).alias("compatible"), F.count_if(~within).alias("incompatible"))
    out = group_diagnostics(runs, group, limits).join(spatial_stability(dominance, group, limits), group, "left").join(support, group).join(counted, group)
    out = out.join(far, group, "left").join(medoid, group, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("pair_distance_mean", "pair_distance_max", "medoid_mean", "medoid_max")})
    out = out.withColumn("flutter", F.col("pair_distance_mean") + 0.5 * F.col("class_switches") + 0.5 * F.col("regime_switches"))
    out = out.withColumns({"match_uncertainty": 1.4826 * F.col("match_mad"), "flutter_flag": above(F.col("flutter"), limits["max_flutter"]), "spatial_jump": F.coalesce("spatial_jump", F.lit(False))})
    out = out.withColumn("scale_jump", F.col("missing_central") | F.col("multimodal") | above(F.col("pair_distance_max"), limits["max_jump"]) | F.col("spatial_jump"))
    number = lambda c: F.col(c).cast("int").cast("double")
    legacy = legacy_score(number("edge_loaded"), number("scale_jump"), number("flutter_flag"), number("spatial_jump"), F.col("central_mean"), F.col("spread"))
    out = out.withColumns({"flurry_like": F.col("flutter_flag") & (F.col("class_switches") > 0), "legacy_score": legacy})
    none = F.lit(None).cast("double")
    out = out.withColumn("score", clip(current_score(none, F.col("match_support"), F.col("legacy_score"), none), 0.0, 1.0))
    return out.withColumn("outcome", legacy_outcome(F.col("scale_jump"), F.col("spatial_jump"), F.col("flutter_flag"), F.col("edge_loaded"), F.col("centered"), F.lit(0.0)))


def group_scores(groups: DataFrame, ensemble: DataFrame, boundary: DataFrame, group: str = "spatialr") -> DataFrame:
    """groups (as group_response gives them) with raw, score, method and outcome by what is known of each group.

    ensemble: group, score and evaluable; a group that is there has that score, 0 if it isn't evaluable, and its outcome
    says whether it is. boundary: group and support. Without an ensemble the clipped scale match counts, without that the
    older score, by the boundary's support if known; the outcome follows the older rules.
    """
    own = ensemble.select(group, F.coalesce(F.when(F.col("evaluable"), F.col("score")), F.lit(0.0)).alias("_ensemble"), F.coalesce("evaluable", F.lit(False)).alias("_evaluable"))
    met = groups.drop("score", "outcome").join(own, group, "left").join(boundary.select(group, F.col("support").alias("_boundary")), group, "left")
    method = F.when(F.col("_ensemble").isNotNull(), "ensemble").when(F.col("match_support").isNotNull(), "scale_match").when(F.col("_boundary").isNotNull(), "legacy_by_boundary").otherwise("legacy")
    out = met.withColumns({"method": method, "raw": current_score(F.col("_ensemble"), F.col("match_support"), F.col("legacy_score"), F.col("_boundary"))})
    out = out.withColumn("score", clip(F.col("raw"), 0.0, 1.0))
    older = legacy_outcome(F.col("scale_jump"), F.col("spatial_jump"), F.col("flutter_flag"), F.col("edge_loaded"), F.col("centered"), F.col("score"))
    outcome = F.when(F.col("_evaluable"), "ensemble_support_evaluable").when(~F.col("_evaluable"), "ensemble_support_not_evaluable").otherwise(older)
    return out.withColumn("outcome", outcome).drop("_ensemble", "_evaluable", "_boundary")


def five_numbers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per name of a column: count, least, q25, median, q75 and greatest of its finite values; 0 without any."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in columns.items()))).alias("x")).select("x.*")
    finite = F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    parts = {"least": F.min(finite), "q25": F.percentile(finite, F.lit(0.25)), "median": F.median(finite), "q75": F.percentile(finite, F.lit(0.75)), "greatest": F.max(finite)}
    return rows.groupBy("name").agg(F.count(finite).alias("count"), *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()))


def candidate_space(groups: DataFrame, runs: DataFrame, group: str = "spatialr", radius: str = "spatialr") -> tuple[DataFrame, DataFrame]:
    """All groups at once: five numbers of radii, scores, centres, spreads, central and tail shares; and flags a group.

    Flags: outlier (its centre lies 1.5 interquartile ranges of the runs' radii outside of these, with three groups or
    more), unstable (by its outcome or a scale jump), flurry_like and scale_jump.
    """
    own = groups.withColumn("_tail", F.col("lower_tail_mean") + F.col("upper_tail_mean"))
    numbers = five_numbers(runs, {"radius": radius}).unionByName(five_numbers(own, {"score": "score", "centre": "centre", "spread": "spread", "central": "central_mean", "tail": "_tail"}))
    ends = runs.agg(F.percentile(F.when(F.col(radius) > 0, F.col(radius)), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    all_ = groups.agg(F.count(F.lit(1)).alias("_groups"))
    both = groups.join(F.broadcast(ends)).join(F.broadcast(all_))  # one row each
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    outside = (F.col("centre") < low - 1.5 * (high - low)) | (F.col("centre") > high + 1.5 * (high - low))
    outlier = (F.col("_groups") >= 3) & (F.col("centre") > 0) & outside
    unstable = F.col("outcome").startswith("unstable") | F.col("scale_jump")
    return numbers, both.select(group, "score", "outcome", F.coalesce(outlier, F.lit(False)).alias("outlier"), unstable.alias("unstable"), "scale_jump", "flurry_like")


def scale_ladders(runs: DataFrame, ranked: DataFrame, fields: tuple[str, ...], case: str = "case_id") -> DataFrame:
    """Which column of the runs orders the groups of each case: case, usable (array), field, orders_agree, ladder.

    A field is usable if every run has a finite value, each group one (within 1e-12), no two groups the same, and the
    groups are those that are ranked. The first usable one orders the ladder, array<struct<value, group_id>>; orders_agree
    says whether all usable ones order the groups alike.
    """
    rows = runs.select(case, "group_id", F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for i, f in enumerate(fields)))).alias("x")).select(case, "group_id", "x.*")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    each = rows.groupBy(case, "at", "field", "group_id").agg(F.first("value").alias("value"), (F.count_if(bad) + (F.max("value") - F.min("value") > 1e-12).cast("int")).alias("_bad"))
    named = ranked.where("group_id is not null and group_id != ''").groupBy(case).agg(F.array_sort(F.collect_set("group_id")).alias("_named"))
    whole = each.groupBy(case, "at", "field").agg(F.sum("_bad").alias("_bad"), F.array_sort(F.collect_list(F.struct("value", "group_id"))).alias("ladder"), F.array_sort(F.collect_set("group_id")).alias("_groups"), F.count_distinct("value").alias("_values"), F.count(F.lit(1)).alias("_n"))
    good = whole.join(named, case).where("_bad = 0 and _values = _n and _groups = _named")
    order = F.transform("ladder", lambda s: s["group_id"])
    return good.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("at", "field"))).alias("usable"), F.min_by("field", "at").alias("field"), (F.count_distinct(F.to_json(order)) == 1).alias("orders_agree"), F.min_by("ladder", "at").alias("ladder")).withColumn("usable", F.transform("usable", lambda s: s["field"]))


def top_pair(runs: DataFrame, ranked: DataFrame, fields: tuple[str, ...], case: str = "case_id") -> DataFrame:
    """Where the two best groups of each case lie on the scale ladder.

    runs: case, group_id and the fields; ranked: case, group_id, rank. Returns case, status, field, first, second, lower,
    upper, lower_value, upper_value, between (groups in the middle) and boundary_side of the best: lower, upper, none or
    cannot_determine.
    """
    ids = F.array_sort(F.collect_list(F.struct("rank", "group_id")))
    best = ranked.groupBy(case).agg(ids.alias("_r")).withColumn("_r", F.filter("_r", lambda s: s["group_id"].isNotNull() & (s["group_id"] != "")))
    at = lambda i: F.get("_r", F.lit(i))["group_id"]
    both = best.select(case, at(0).alias("first"), at(1).alias("second")).join(scale_ladders(runs, ranked, fields, case), case, "left")
    names = F.transform("ladder", lambda s: s["group_id"])
    both = both.withColumns({"_a": F.array_position(names, F.col("first")), "_b": F.array_position(names, F.col("second"))})
    status = F.when(F.col("second").isNull(), NO_PAIR).when(F.col("field").isNull(), NO_FIELD).when(~F.col("orders_agree"), DISAGREE).when((F.col("_a") == 0) | (F.col("_b") == 0), NO_PAIR).when(F.abs(F.col("_a") - F.col("_b")) == 1, ADJACENT).otherwise(APART)
    both = both.withColumn("status", status)
    known = F.col("status").isin(ADJACENT, APART)
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    rung = lambda i: F.get("ladder", (i - 1).cast("int"))
    between = F.transform(F.filter("ladder", lambda s, i: (i + 1 > low) & (i + 1 < high)), lambda s: s["group_id"])
    side = F.when(F.col("_a") == 1, "lower").when(F.col("_a") == F.size("ladder"), "upper").otherwise("none")
    return both.select(
        case, "status", F.when(known, F.col("field")).alias("field"), "first", "second",
        *(F.when(known, v).alias(n) for n, v in (("lower", rung(low)["group_id"]), ("upper", rung(high)["group_id"]), ("lower_value", rung(low)["value"]), ("upper_value", rung(high)["value"]))),
        F.when(known, between).otherwise(F.array().cast("array<string>")).alias("between"),
        F.when(known, side).otherwise("cannot_determine").alias("boundary_side"),
    )


def refinement_status(cases: DataFrame) -> DataFrame:
    """cases with `refinement`: what may be done with the interval between the two best scales, and `plan_size`.

    cases: status, adjacent, first, second, lower, upper, field, lower_value, upper_value and local_values, the scales to
    try in between (array<double>). The rules are tried in this order: two scales that aren't neighbours are the user's
    choice; an unknown pair, missing names, bad bounds, missing values, values that aren't numbers, repeated ones, ones out
    of order or outside, and missing ends block it.
    """
    local = F.col("local_values")
    none = local.isNull() | (F.size(local) == 0)
    odd = F.exists(local, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    falls = F.exists(F.sequence(F.lit(1), F.size(local) - 1), lambda i: F.get(local, i) <= F.get(local, i - 1))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    missing = ~F.coalesce(F.col("status") == ADJACENT, F.lit(False)) | ~F.coalesce("adjacent", F.lit(False)) | blank("first") | blank("second") | blank("lower") | blank("upper") | blank("field")
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bounds = number("lower_value") & number("upper_value") & (F.col("lower_value") < F.col("upper_value"))
    first, last = F.get(local, F.lit(0)), F.element_at(local, -1)
    ladder = (
        F.when(F.col("status") == APART, CHOICE)
        .when(F.col("status").isin(NO_PAIR, NO_FIELD, DISAGREE), UNKNOWN_PAIR)
        .when(missing, NO_NAMES)
        .when(~bounds, BAD_BOUNDS)
        .when(none, NO_VALUES)
        .when(odd, UNORDERED)
        .when(F.size(F.array_distinct(local)) != F.size(local), REPEATED)
        .when((F.size(local) > 1) & falls, UNORDERED)
        .when(F.exists(local, lambda x: (x < F.col("lower_value")) | (x > F.col("upper_value"))), OUTSIDE)
        .when((first != F.col("lower_value")) | (last != F.col("upper_value")), NO_VALUES)
        .otherwise(READY)
    )
    return cases.withColumn("refinement", ladder).withColumn("plan_size", F.when(F.col("refinement") == READY, F.size(local)).otherwise(0))


def gain_handoff(scores: DataFrame) -> DataFrame:
    """scores (first, midpoint, s1, s2, sm) with total_gain, gain_share, gain_status and the candidate that goes on.

    The midpoint goes on if it delivers more than half of the gain of the best over the second, else the best does.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    gain = finite("s1") - finite("s2")
    share = F.when(gain > 0, (finite("sm") - finite("s2")) / gain)
    status = F.when(gain.isNull() | (gain <= 0), NO_GAIN).when(finite("sm").isNull(), NO_MIDPOINT).when(share > 0.5, MIDPOINT).otherwise(RETAINED)
    return scores.withColumns({"total_gain": gain, "gain_share": share, "gain_status": status, "gain_warning": gain.isNull() | (gain <= 0) | finite("sm").isNull(), "selected": F.when(share > 0.5, F.col("midpoint")).otherwise(F.col("first"))})


def selected_source(handoffs: DataFrame) -> DataFrame:
    """handoffs (selected, midpoint, lower, upper) with `source`; reading it fails if the selected one is none of these."""
    source = F.when(F.col("selected") == F.col("midpoint"), "midpoint").when(F.col("selected") == F.col("lower"), "lower_bound").when(F.col("selected") == F.col("upper"), "upper_bound")
    return handoffs.withColumn("source", F.coalesce(source, F.raise_error(F.concat(F.lit("not a candidate of the interval: "), F.coalesce("selected", F.lit("null")))).cast("string")))


def finalists(handoffs: DataFrame, summaries: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row for each candidate with a part in the decision: role (selected, midpoint, lower_bound, upper_bound), its
    summary columns, and the evidence as JSON. A candidate without a summary stays, with nulls.
    """
    roles = handoffs.select(F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias(key)) for role, c in (("selected", "selected"), ("midpoint", "midpoint"), ("lower_bound", "lower"), ("upper_bound", "upper")))), ).alias("x"), *[c for c in ("gain_share", "gain_status") if c in handoffs.columns])
    rows = roles.select("x.role", f"x.{key}", *[c for c in roles.columns if c != "x"]).where(F.col(key).isNotNull())
    joined = rows.join(summaries, key, "left")
    return joined.withColumn("evidence", F.to_json(F.struct(*[c for c in joined.columns if c not in (key, "role")])))


def same_phases(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (lower, upper) with phases_equal: whether both groups have the same seed phases, one of them (0, 0).

    runs: group_id, phase_id, u, v. A phase_id with two places in a group makes it unequal.
    """
    each = runs.groupBy("group_id").agg(F.array_sort(F.collect_set(F.struct("phase_id", "u", "v"))).alias("p"), F.count_distinct("phase_id").alias("n"))
    good = (F.col("n") == F.size("p")) & (F.size(F.filter("p", lambda s: (s["u"] == 0) & (s["v"] == 0))) == 1)
    each = each.select("group_id", F.when(good, F.col("p")).alias("p"))
    out = pairs.join(each.withColumnsRenamed({"group_id": "lower", "p": "_a"}), "lower", "left").join(each.withColumnsRenamed({"group_id": "upper", "p": "_b"}), "upper", "left")
    return out.withColumn("phases_equal", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b").select(*pairs.columns, "phases_equal")


def central_rows(rows: DataFrame) -> DataFrame:
    """Per group the state of its baseline: ok, conflicting (two flags of one row differ) or missing (not exactly one).

    rows: group_id, own_flag and metadata_flag (either may be null; metadata comes first).
    """
    clash = F.col("own_flag").isNotNull() & F.col("metadata_flag").isNotNull() & (F.col("own_flag") != F.col("metadata_flag"))
    one = rows.groupBy("group_id").agg(F.count_if(clash).alias("_clash"), F.count_if(F.coalesce("metadata_flag", "own_flag", F.lit(False))).alias("baselines"))
    return one.select("group_id", "baselines", F.when(F.col("_clash") > 0, "conflicting").when(F.col("baselines") != 1, "missing").otherwise("ok").alias("state"))


def analysis_cell(radius: Column, support: Column, least: float = 5.0, factor: float = 4.0, most: float | None = None, fixed: float | None = None) -> Column:
    """Side of an analysis cell: the greatest of a least size, a factor times the radius and the structure's support, capped."""
    cell = F.lit(float(fixed)) if fixed is not None else F.greatest(F.lit(least), factor * radius, F.when((support > 0) & (support < float("inf")), support))
    return cell if most is None else F.least(cell, F.lit(float(most)))


def limited(rows: DataFrame, group: str, most_groups: int | None, most_rows: int | None, order: str) -> DataFrame:
    """rows with `state`: planned, or omitted for one of two reasons; nothing is dropped without a record.

    The first groups by name stay, and of each the first rows by `order`.
    """
    groups = rows.select(group).distinct().withColumn("_g", F.row_number().over(Window.orderBy(group)))  # one row a group
    placed = rows.join(groups, group).withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    over = lambda c, n: F.lit(False) if n is None else F.col(c) > n
    state = F.when(over("_g", most_groups), "omitted: group limit").when(over("_i", most_rows), "omitted: row limit").otherwise("planned")
    return placed.withColumn("state", state).drop("_g", "_i")


def run_states(planned: DataFrame, done: DataFrame, key: str = "run_id") -> DataFrame:
    """planned with a state each: omitted ones keep theirs, others are ok, failed or missing by `done` (key, status)."""
    last = done.groupBy(key).agg(F.max(F.when(F.col("status") == "ok", 2).otherwise(1)).alias("_s"))
    found = F.when(F.col("_s") == 2, "ok").when(F.col("_s") == 1, "failed").otherwise("missing")
    return planned.join(last, key, "left").withColumn("state", F.when(F.col("state") != "planned", F.col("state")).otherwise(found)).drop("_s")


def candidate_report(statuses: DataFrame, group: str = "candidate_id") -> DataFrame:
    """Per candidate: runs, ok, failed, and ok, partial or failed as a whole."""
    one = statuses.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("failed"))
    return one.withColumn("state", F.when(F.col("failed") == 0, "ok").when(F.col("ok") > 0, "partial").otherwise("failed"))
