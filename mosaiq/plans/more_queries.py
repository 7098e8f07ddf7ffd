"""Further queries of the registry: populations, group responses, the gate, features, study tables, ledgers and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.functions import exprs
from mosaiq.operators import boundary, checks, features, flight, groups, ledger, partitions, prescreen, regions, response, segments, study
from mosaiq.plans import queries as base
from mosaiq.plans.oracle_views import micro, milli, sql
from mosaiq.plans.queries import BANDS, out, query
from mosaiq.sources import adapters
from mosaiq.sources.stage import stage

CLASSES, PERCENTS = segments.CLASSES, segments.PERCENTS


def _named(*pairs: tuple[str, str]) -> str:
    """Expressions in millionths under names."""
    return ",\n  ".join(micro(x, n) for x, n in pairs)


# populations

_POPULATION = [
    ("sum(area)", "area"), ("count(*) / (sum(area) / 10000)", "per_hectare"), ("avg(area)", "area_mean"), ("avg(radius)", "radius_mean"), ("sum(q * area) / sum(area)", "q_mean"),
    *((f"quantile_cont({c}, {p / 100})", f"{c}_p{p}") for c in ("area", "radius") for p in PERCENTS),
    *((f"coalesce(sum(area) filter (size_class = '{k}'), 0) / sum(area)", f"{k}_share") for k in CLASSES),
    *((f"coalesce(quantile_cont(radius, {p / 100}) filter (size_class = '{k}'), 0)", f"{k}_radius_p{p}") for k in CLASSES for p in (50, 90)),
    *((f"any_value(wq.q{p})", f"q{p}") for p in PERCENTS),
    *((f"coalesce(sum(area) filter (size_class = '{k}'), 0)", f"{k}_area") for k in CLASSES),
    *((f"coalesce(sum(area) filter (q >= {a} and q < {b}), 0) / sum(area)", f"h{k}") for k, (a, b) in enumerate([(0.0, 0.25), (0.25, 0.5), (0.5, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, 8.0), (8.0, 1e300)])),
    ("any_value(wq.q50)", "q_run_p50"),
    ("any_value(low)", "lower_tail"), ("any_value(mid)", "central"), ("any_value(up)", "upper_tail"), ("any_value(low) + any_value(up)", "edge_loaded"), ("any_value(scale_match)", "scale_match"),
]
_REGIME = "case when low >= mid and low >= up then 'lower_tail' when mid >= up then 'central' else 'upper_tail' end"


@query(
    sql(
        "tails wq match",
        f"""select seg.run_id, count(*) as segments, max(label) as max_label, any_value(dominant) as dominant_class, any_value({_REGIME}) as regime,
  {", ".join(f"count(*) filter (size_class = '{k}') as {k}_segments" for k in CLASSES)},
  {_named(*_POPULATION)}
from seg join tails using (run_id) join wq using (run_id) join match using (run_id) group by 1""",
    )
)
def population_summary(spark, d):
    spec = "run_id segments:i max_label:i dominant_class regime " + " ".join(f"{k}_segments:i" for k in CLASSES) + " " + " ".join(f"{n}:m" for _, n in _POPULATION)
    return out(segments.population_summary(base._segments(spark, d)), spec)


@query(
    sql(
        "seg",
        f""", q as (select run_id, {", ".join(f"quantile_cont(q, {p / 100}) as q_p{p}" for p in (10, 25, 50, 75, 90))} from seg group by 1),
t as (select run_id, size_class, count(*) as n, sum(area) as a from seg group by 1, 2)
select run_id, size_class, {_named(("n / sum(n) over (partition by run_id)", "segment_share"), ("a / sum(a) over (partition by run_id)", "area_share"), *((f"q_p{p}", f"q_p{p}") for p in (10, 25, 50, 75, 90)))}
from t join q using (run_id)""",
    )
)
def class_table(spark, d):
    return out(segments.class_table(base._segments(spark, d)), "run_id size_class segment_share:m area_share:m q_p10:m q_p25:m q_p50:m q_p75:m q_p90:m")


@query(sql("label_px", "select run_id, label, count(*) as pixels, min(r)::bigint as top, min(c)::bigint as \"left\", max(r) + 1::bigint as bottom, max(c) + 1::bigint as \"right\", " + _named(("avg(r)", "y"), ("avg(c)", "x"), ("count(*)", "area")) + " from label_px where label > 0 group by 1, 2"))
def segment_attributes(spark, d):
    return out(segments.segment_attributes(base._labels(spark, d)), "run_id label:i pixels:i top:i left:i bottom:i right:i y:m x:m area:m")


@query(sql("segment", ", small as (select run_id, label from segment where pixels < 3) select run_id, label, r::bigint as r, c::bigint as c from label_px anti join small using (run_id, label)"))
def mask_small(spark, d):
    return out(segments.mask_small(base._labels(spark, d), 3), "run_id label:i r:i c:i")


@query(sql("label_px", "select run_id, r::bigint as r, c::bigint as c, case when m1 > 20 then label + 1 else 0 end as label from label_px join cell using (r, c)"))
def exported_labels(spark, d):
    cells = base._cells(spark, d)
    return out(segments.exported_labels(adapters.label_px(cells), cells.where("m1 > 20")), "run_id r:i c:i label:i")


# groups

_GROUPS = f"""
, diag as (select t.spatialr, count(*) as runs, median(q50) as centre, median(q90 - q10) as spread, avg(q90 + q10 - 2 * q50) as skew, avg(low) as lo, avg(mid) as mi, avg(up) as up,
    count(distinct dominant) as classes, count(distinct dominant) >= 3 or (max((dominant = 'small')::int) = 1 and max((dominant = 'large')::int) = 1) as multimodal, count(distinct {_REGIME}) as regimes,
    median(scale_match) as match_median from tails t join wq using (run_id) join match using (run_id) group by 1),
dev as (select spatialr, median(abs(scale_match - match_median)) as match_mad from match join diag using (spatialr) group by 1),
dpair as (select a.spatialr, a.run_id as left_run, b.run_id as right_run, {" + ".join(f"abs(a.{c} - b.{c})" for c in base._V)} as spatial from dominance a join dominance b on a.spatialr = b.spatialr and a.run_id < b.run_id),
spat as (select spatialr, greatest({", ".join(f"avg({c})" for c in CLASSES)}) as agreement, greatest(avg(lower_cells), avg(central_cells), avg(upper_cells)) as tail_agreement,
    max(lower_cells) - min(lower_cells) as lower_range, max(central_cells) - min(central_cells) as central_range, max(upper_cells) - min(upper_cells) as upper_range, max(problem_area) - min(problem_area) as problem_range,
    avg(lower_cells) as lower_persistence, avg(upper_cells) as upper_persistence from dominance group by 1),
apart as (select spatialr, avg(spatial) as distance_mean, max(spatial) as distance_max from dpair group by 1),
fars as (select spatialr, avg(ordinal + histogram + tail) as pair_mean, max(ordinal + histogram + tail) as pair_max from dist group by 1),
wp as (select spatialr, left_run, right_run, ordinal, ordinal + histogram + spatial as v from dist join dpair using (spatialr, left_run, right_run)),
ways as (select spatialr, left_run as run_id, right_run as other, ordinal, v from wp union all select spatialr, right_run, left_run, ordinal, v from wp),
mean as (select spatialr, run_id, avg(v) as m, max(v) as most from ways group by 1, 2),
mid_ as (select * from (select *, row_number() over (partition by spatialr order by floor(m * 1e9 + 0.5), run_id) as i from mean) where i = 1),
near_ as (select spatialr, count(*) filter (ordinal <= 1) + 1 as compatible, count(*) filter (ordinal > 1) as incompatible from ways join mid_ m using (spatialr, run_id) group by 1),
g0 as (select *, pair_mean + 0.5 * (classes - 1) + 0.5 * (regimes - 1) as flutter, distance_max > 1 or agreement < 0.6::double as spatial_jump, mi < 0.5 as missing_central, lo + up > 0.5 as edge
    from diag join dev using (spatialr) join spat using (spatialr) join apart using (spatialr) join fars using (spatialr) join near_ using (spatialr) join mid_ using (spatialr)),
g1 as (select *, missing_central or multimodal or pair_max > 1.5 or spatial_jump as scale_jump, flutter > 1 as flutter_flag, greatest(0, least(1, match_median - 1.4826::double * match_mad)) as score from g0),
grp as (select *, 1 - 0.35::double * edge::int - 0.35::double * scale_jump::int - 0.2::double * flutter_flag::int - 0.2::double * spatial_jump::int + 0.5 * mi - 0.1::double * spread as legacy,
    case when scale_jump then 'scale_jump_detected' when spatial_jump then 'unstable_spatial_response' when flutter_flag or edge then 'unstable_distribution_response'
      when centre >= 0.5 and centre <= 2 and mi >= 0.5 then 'stable_with_warnings' else 'unstable_distribution_response' end as outcome from g1)
"""
_GROUP_VALUES = [("centre", "centre"), ("spread", "spread"), ("skew", "skew"), ("lo", "lower_tail_mean"), ("mi", "central_mean"), ("up", "upper_tail_mean"), ("match_median", "match_median"), ("match_mad", "match_mad"), ("score", "match_support"), ("1.4826::double * match_mad", "match_uncertainty")]
_GROUP_VALUES += [("pair_mean", "pair_distance_mean"), ("pair_max", "pair_distance_max"), ("flutter", "flutter"), ("m", "medoid_mean"), ("most", "medoid_max"), ("legacy", "legacy_score"), ("score", "score")]
_GROUP_VALUES += [(c, c) for c in ("agreement", "tail_agreement", "lower_range", "central_range", "upper_range", "problem_range", "lower_persistence", "upper_persistence", "distance_mean", "distance_max")]


def _responses(spark, d, labels=None):
    labels = stage(base._labels(spark, d), "labels") if labels is None else labels
    own = stage(segments.segment_sizes(labels), "segments")
    runs = segments.run_summary(own)
    return runs, groups.group_response(runs, response.spatial_dominance(response.analysis_matrix(labels, own, 8)))


@query(
    sql(
        "dist match dominance",
        _GROUPS
        + f"""select spatialr::bigint as spatialr, runs, run_id as medoid_run, classes - 1 as class_switches, regimes - 1 as regime_switches, compatible, incompatible, flutter_flag, spatial_jump, scale_jump,
  flutter_flag and classes > 1 as flurry_like, outcome, {_named(*_GROUP_VALUES)} from grp""",
    )
)
def group_response(spark, d):
    spec = "spatialr:i runs:i medoid_run class_switches:i regime_switches:i compatible:i incompatible:i flutter_flag spatial_jump scale_jump flurry_like outcome " + " ".join(f"{n}:m" for _, n in _GROUP_VALUES)
    return out(_responses(spark, d)[1], spec)


@query(
    sql(
        "dist match dominance",
        _GROUPS
        + """, v as (select 'radius' as name, spatialr::double as v from match union all select name, v from (select score, centre, spread, mi as central, lo + up as tail from grp) unpivot (v for name in (score, centre, spread, central, tail)))
select name, count(*) as "count", """
        + _named(("min(v)", "least"), ("quantile_cont(v, 0.25)", "q25"), ("median(v)", "median"), ("quantile_cont(v, 0.75)", "q75"), ("max(v)", "greatest"))
        + " from v group by 1".replace("as least", "as least"),
    )
)
def candidate_space(spark, d):
    runs, found = _responses(spark, d)
    return out(groups.candidate_space(found, runs)[0], "name count:i least:m q25:m median:m q75:m greatest:m")


@query(
    sql(
        "dist match dominance",
        _GROUPS
        + """, e as (select quantile_cont(spatialr, 0.25) as a, quantile_cont(spatialr, 0.75) as b from match)
select spatialr::bigint as spatialr, outcome, centre > 0 and (centre < a - 1.5 * (b - a) or centre > b + 1.5 * (b - a)) and (select count(*) from grp) >= 3 as outlier, outcome like 'unstable%' or scale_jump as unstable, scale_jump,
  flutter_flag and classes > 1 as flurry_like, """
        + micro("score", "score")
        + " from grp cross join e",
    )
)
def candidate_flags(spark, d):
    runs, found = _responses(spark, d)
    return out(groups.candidate_space(found, runs)[1], "spatialr:i outcome outlier unstable scale_jump flurry_like score:m")


def _ranked(spark, d):
    """Runs and ranked groups of a case for each ranger; groups are the scales, ranked by their mean scale match."""
    runs = segments.run_summary(base._segments(spark, d)).select(F.concat(F.lit("g"), F.col("ranger").cast("string")).alias("case_id"), F.concat(F.lit("s"), F.col("spatialr").cast("string")).alias("group_id"), "phase", F.col("spatialr").cast("double").alias("radius_m"), (F.col("spatialr") * 2).alias("span_px"), "scale_match")
    mean = runs.groupBy("case_id", "group_id").agg(F.avg("scale_match").alias("m"))
    by = F.row_number().over(Window.partitionBy("case_id").orderBy(F.floor(F.col("m") * 1e9 + 0.5).desc(), "group_id"))
    return runs, mean.withColumn("rank", by)


@query(
    sql(
        "match",
        """, run_ as (select distinct run_id, spatialr, ranger from seg), m as (select 'g' || ranger as case_id, spatialr as s, avg(scale_match) as m from match join run_ using (run_id, spatialr) group by 1, 2),
k as (select *, row_number() over (partition by case_id order by floor(m * 1e9 + 0.5) desc, 's' || s) as rank, dense_rank() over (partition by case_id order by s) as step, count(*) over (partition by case_id) as n from m),
p as (select case_id, max(s) filter (rank = 1) as f, max(s) filter (rank = 2) as g, max(step) filter (rank = 1) as a, max(step) filter (rank = 2) as b, max(n) as n from k group by 1)
select case_id, case when abs(a - b) = 1 then 'adjacent_top_pair_confirmed' else 'non_adjacent_top_pair_possible_bimodal_or_multimodal' end as status, 'radius_m' as field, 's' || f as first, 's' || g as second, 's' || least(f, g) as lower,
  's' || greatest(f, g) as upper, least(f, g)::bigint as lower_value, greatest(f, g)::bigint as upper_value, greatest(abs(a - b) - 1, 0) as n_between, case when a = 1 then 'lower' when a = n then 'upper' else 'none' end as boundary_side from p""",
    )
)
def top_pair(spark, d):
    runs, ranked = _ranked(spark, d)
    pair = groups.top_pair(runs, ranked, ("phase", "radius_m", "span_px"))
    return out(pair.withColumn("n_between", F.size("between")), "case_id status field first second lower upper lower_value:i upper_value:i n_between:i boundary_side")


@query("""with c as (select o_orderkey, case o_orderstatus when 'F' then 'adjacent_top_pair_confirmed' when 'O' then case when o_orderkey % 5 = 0 then 'non_adjacent_top_pair_possible_bimodal_or_multimodal' else 'adjacent_top_pair_confirmed' end else 'cannot_determine_missing_top_pair' end as status,
  (o_custkey % 7)::double as lo, (o_custkey % 7 + o_orderkey % 4)::double as hi, o_orderkey % 8 as kind from orders),
l as (select *, case kind when 0 then null when 1 then [lo, hi] when 2 then [lo, lo, hi] when 3 then [lo, (lo + hi) / 2, hi] when 4 then [hi, lo] when 5 then [lo, hi, hi + 1] when 6 then [lo, 'nan'::double, hi] else [lo] end as local from c),
s as (select o_orderkey, case when status like 'non_%' then 'step9b_user_choice_required_bimodal_or_multimodal' when status like 'cannot%' then 'step9b_blocked_cannot_determine_scale_continuity' when hi <= lo then 'step9b_blocked_invalid_interval_bounds'
  when kind = 0 or kind = 7 then 'step9b_blocked_missing_explicit_local_scale_coordinates' when kind = 6 or kind = 4 then 'step9b_blocked_local_coordinate_not_strictly_ordered' when kind = 2 then 'step9b_blocked_local_coordinate_duplicate'
  when kind = 5 then 'step9b_blocked_local_coordinate_outside_interval' else 'step9b_ready_adjacent_interval' end as refinement, local from l)
select o_orderkey as case_id, refinement, (case when refinement like '%ready%' then len(local) else 0 end)::bigint as plan_size from s""")
def refinement_status(spark, d):
    o = adapters.table(spark, d, "orders")
    number = lambda x: x.cast("double")
    status = F.when(F.col("o_orderstatus") == "F", groups.ADJACENT).when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 5 == 0, groups.APART).otherwise(groups.ADJACENT)).otherwise(groups.NO_PAIR)
    cases = o.select(F.col("o_orderkey").alias("case_id"), status.alias("status"), number(F.col("o_custkey") % 7).alias("lower_value"), number(F.col("o_custkey") % 7 + F.col("o_orderkey") % 4).alias("upper_value"), (F.col("o_orderkey") % 8).alias("kind"))
    lo, hi, k = F.col("lower_value"), F.col("upper_value"), F.col("kind")
    lists = ((1, F.array(lo, hi)), (2, F.array(lo, lo, hi)), (3, F.array(lo, (lo + hi) / 2, hi)), (4, F.array(hi, lo)), (5, F.array(lo, hi, hi + 1)), (6, F.array(lo, F.lit(float("nan")), hi)), (7, F.array(lo)))
    local = F.when(k == 0, F.lit(None).cast("array<double>"))
    for n, v in lists:
        local = local.when(k == n, v)
    cases = cases.withColumns({"local_values": local, "adjacent": F.col("status") == groups.ADJACENT, "first": F.lit("a"), "second": F.lit("b"), "lower": F.lit("a"), "upper": F.lit("b"), "field": F.lit("radius_m")})
    return out(groups.refinement_status(cases), "case_id refinement plan_size:i")


@query("with c as (select o_orderkey as case_id, (o_orderkey % 11) / 10 as s1, (o_custkey % 7) / 10 as s2, case when o_orderkey % 17 = 0 then null else (o_orderkey % 13) / 10 end as sm from orders), g as (select *, s1 - s2 as gain, case when s1 > s2 then (sm - s2) / (s1 - s2) end as share from c) select case_id, " + micro("gain", "total_gain") + ", " + micro("share", "gain_share") + ", case when gain <= 0 then 'step9b_no1_retained_invalid_reference_gain' when sm is null then 'step9b_no1_retained_midpoint_uninterpretable' when share > 0.5 then 'step9b_midpoint_gain_share_handoff' else 'step9b_no1_retained_gain_share' end as gain_status, gain <= 0 or sm is null as gain_warning, case when share > 0.5 then 'midpoint' else 'lower_bound' end as source from g")
def gain_handoff(spark, d):
    o = adapters.table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("case_id"), F.lit("a").alias("first"), F.lit("a").alias("lower"), F.lit("b").alias("upper"), F.lit("m").alias("midpoint"), ((F.col("o_orderkey") % 11) / 10).alias("s1"), ((F.col("o_custkey") % 7) / 10).alias("s2"), F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_orderkey") % 13) / 10).alias("sm"))
    return out(groups.selected_source(groups.gain_handoff(rows)), "case_id total_gain:m gain_share:m gain_status gain_warning source")


@query(sql("label_px", ", g as (select spatialr, ranger, count(distinct phase) as n from label_px group by 1, 2) select 's4_g' || ranger as lower, 's6_g' || ranger as upper, max(n) = 4 as phases_equal from g group by ranger"))
def same_phases(spark, d):
    runs = base._labels(spark, d).select("spatialr", "ranger", "phase").distinct()
    own = runs.select(F.format_string("s%d_g%d", "spatialr", "ranger").alias("group_id"), F.format_string("phase_%02d", "phase").alias("phase_id"), ((F.col("phase") % 2) * 0.5).alias("u"), (F.floor(F.col("phase") / 2) * 0.5).alias("v"))
    pairs = runs.select("ranger").distinct().select(F.format_string("s4_g%d", "ranger").alias("lower"), F.format_string("s6_g%d", "ranger").alias("upper"))
    return groups.same_phases(own, pairs)


@query("with r as (select o_custkey as group_id, o_orderkey % 6 = 0 as own, case when o_orderkey % 4 = 0 then o_orderkey % 12 = 0 end as meta from orders), c as (select group_id, count(*) filter (own != meta) as clash, count(*) filter (coalesce(meta, own)) as n from r group by 1) select group_id, n as baselines, case when clash > 0 then 'conflicting' when n != 1 then 'missing' else 'ok' end as state from c")
def central_rows(spark, d):
    o = adapters.table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 6 == 0).alias("own_flag"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 12 == 0).alias("metadata_flag"))
    return out(groups.central_rows(rows), "group_id baselines:i state")


_LIMITED = "with g as (select distinct o_orderpriority as p from orders), h as (select p, row_number() over (order by p) as g from g), r as (select o_orderkey, o_orderpriority, o_orderstatus, g, row_number() over (partition by o_orderpriority order by o_orderkey) as i from orders join h on p = o_orderpriority), s as (select *, case when g > 4 then 'omitted: group limit' when i > 1000 then 'omitted: row limit' else 'planned' end as state from r)"


def _limited(spark, d):
    o = adapters.table(spark, d, "orders")
    return groups.limited(o.select(F.col("o_orderpriority").alias("candidate_id"), F.col("o_orderkey").alias("run_id"), "o_orderstatus"), "candidate_id", 4, 1000, "run_id")


@query(_LIMITED + " select o_orderpriority as candidate_id, o_orderkey as run_id, case when state != 'planned' then state when o_orderstatus = 'F' then 'ok' when o_orderstatus = 'P' then 'failed' else 'missing' end as state from s")
def run_states(spark, d):
    planned = _limited(spark, d)
    done = planned.where("o_orderstatus != 'O'").select("run_id", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    return groups.run_states(planned, done).select("candidate_id", "run_id", "state")


@query("select o_orderpriority as candidate_id, count(*) as runs, count(*) filter (o_orderstatus = 'F') as ok, count(*) filter (o_orderstatus != 'F') as failed, case when count(*) filter (o_orderstatus != 'F') = 0 then 'ok' when count(*) filter (o_orderstatus = 'F') > 0 then 'partial' else 'failed' end as state from orders group by 1")
def candidate_report(spark, d):
    o = adapters.table(spark, d, "orders")
    return groups.candidate_report(o.select(F.col("o_orderpriority").alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")))


@query("select p_partkey, " + micro("least(60.0, greatest(5.0, 4 * p_size / 5.0, case when p_retailprice > 950 then p_retailprice / 50 else 5.0 end))", "cell") + " from part")
def analysis_cell(spark, d):
    p = adapters.table(spark, d, "part")
    cell = groups.analysis_cell(F.col("p_size") / 5.0, F.when(F.col("p_retailprice") > 950, F.col("p_retailprice") / 50), most=60.0)
    return out(p.select("p_partkey", cell.alias("cell")), "p_partkey cell:m")


@query(sql("run", ", m as (select distinct spatialr as s from run) select a.s::bigint as low, b.s::bigint as high, case when floor((a.s + b.s) / 2 + 0.5) > a.s and floor((a.s + b.s) / 2 + 0.5) < b.s then floor((a.s + b.s) / 2 + 0.5)::bigint end as mid from m a join m b on a.s < b.s"))
def midpoints(spark, d):
    scales = base._labels(spark, d).select("spatialr").distinct()
    pairs = scales.alias("a").join(scales.alias("b"), F.col("a.spatialr") < F.col("b.spatialr")).select(F.col("a.spatialr").alias("low"), F.col("b.spatialr").alias("high"))  # scales of one design
    return out(pairs.withColumn("mid", boundary.midpoint_px(F.col("low"), F.col("high"))), "low:i high:i mid:i")


# features

_SIX = [("2 * m2 - m1 - m3 - (1.4::double * m1 - m3)", "f1"), ("1.4::double * m1 - m3", "f2"), ("(m1 + m2 + m3) / 3", "f3"), ("m2", "f4"), ("m3", "f5"), ("m2 / (m3 + 1e-6)", "f6")]


@query(sql("cell", "select r::bigint as r, c::bigint as c, " + _named(*((f"case when m1 > 20 then {x} else 0 end", n) for x, n in _SIX)) + " from cell"))
def feature_stack(spark, d):
    cells = base._cells(spark, d)
    six = tuple(n for _, n in _SIX)
    stack = features.feature_bands(cells, "m2", "m3").select("r", "c", *six)
    both = features.stack_with_mask(stack, cells.select("r", "c", (F.col("m1") > 20).alias("valid")), six)
    return out(features.masked(both, six), "r:i c:i " + " ".join(f"{n}:m" for n in six))


@query(sql("cell", ", p as (select " + ", ".join(f"avg({b}) as {b}_m, stddev_pop({b}) as {b}_s" for b in BANDS) + " from cell) select r::bigint as r, c::bigint as c, " + _named(*((f"case when {b}_s > 0 then ({b} - {b}_m) / {b}_s else 0 end", b) for b in BANDS)) + " from cell cross join p"))
def standardised(spark, d):
    return out(features.standardised(base._cells(spark, d), BANDS), "r:i c:i m1:m m2:m m3:m")


@query(sql("obs", ", e as (select variant_id, replicate, min(b1) as lo, max(b1) as hi from obs group by 1, 2) select variant_id, replicate::bigint as replicate, r::bigint as r, c::bigint as c, " + micro("case when hi > lo then (b1 - lo) * 255 / (hi - lo) else 0 end", "b1") + " from obs join e using (variant_id, replicate)"))
def intensity_normalised(spark, d):
    obs = base.stability.valid_pixels(base._obs(spark, d)).withColumn("image", F.concat_ws("/", "variant_id", F.col("replicate").cast("string")))
    return out(features.intensity_normalised(obs, "image", ("b1",)), "variant_id replicate:i r:i c:i b1:m")


@query(sql("cell", ", q as (select quantile_cont(m1, 0.02) as lo, quantile_cont(m1, 0.98) as hi from cell) select r::bigint as r, c::bigint as c, " + micro("(least(greatest(m1, lo), hi) - lo) * 255 / (hi - lo)", "m1") + " from cell cross join q"))
def clip_rescaled(spark, d):
    return out(features.clip_rescale(base._cells(spark, d), "m1"), "r:i c:i m1:m")


@query(sql("cell", ", t as (select cast(i // w as int) as tr, cast(i % w as int) as tc, cast(floor((i // w + 0.5) * 1.5) as int) as r, cast(floor((i % w + 0.5) * 1.5) as int) as c from (select side * 2 // 3 as w from grid), lateral (select unnest(range(w * w)) as i)) select tr::bigint as r, tc::bigint as c, " + micro("coalesce(m1, 0)", "m1") + " from t left join cell using (r, c)"))
def resampled(spark, d):
    w = adapters.grid_side(spark, d) * 2 // 3
    return out(features.resample_nearest(base._cells(spark, d), ("m1",), 0.0, 0.0, 1.5, 1.5, 1.0, w, w), "r:i c:i m1:m")


@query(sql("cell", "select a.r::bigint as r, a.c::bigint as c, " + micro("a.m1", "m1") + " from cell a where not exists (select 1 from cell b where abs(b.r - a.r) <= 2 and abs(b.c - a.c) <= 2 and (b.m1 > a.m1 or b.m1 = a.m1 and (b.r < a.r or b.r = a.r and b.c < a.c)))"))
def local_maxima(spark, d):
    return out(features.local_maximum(base._cells(spark, d), "m1", 2), "r:i c:i m1:m")


@query(sql("cell", "select (r // 16)::bigint as block_row, (c // 16)::bigint as block_col, count(*) as cells, " + micro("avg(m1)", "m1") + " from cell group by 1, 2"))
def block_means(spark, d):
    return out(features.block_of(base._cells(spark, d), 16).groupBy("block_row", "block_col").agg(F.count(F.lit(1)).alias("cells"), F.avg("m1").alias("m1")), "block_row:i block_col:i cells:i m1:m")


_POWER = """, cov as (select avg(m1) as a1, avg(m2) as a2, avg(m3) as a3, covar_pop(m1, m1) as c11, covar_pop(m1, m2) as c12, covar_pop(m1, m3) as c13, covar_pop(m2, m2) as c22, covar_pop(m2, m3) as c23, covar_pop(m3, m3) as c33 from cell),
it as (select 0 as i, 1 / sqrt(3) as x, 1 / sqrt(3) + 0.001 as y, 1 / sqrt(3) + 0.002 as z union all select i + 1, u / n, v / n, w / n from (
  select i, u, v, w, sqrt(u * u + v * v + w * w) as n from (select i, c11 * x + c12 * y + c13 * z as u, c12 * x + c22 * y + c23 * z as v, c13 * x + c23 * y + c33 * z as w from it cross join cov where i < 200))),
vec as (select x * s as x, y * s as y, z * s as z from (select *, case when abs(x) >= abs(y) and abs(x) >= abs(z) then sign(x) when abs(y) >= abs(z) then sign(y) else sign(z) end as s from it where i = 200))
select r::bigint as r, c::bigint as c, """


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


base.ORACLES["pc1"] = _recursive(sql("cell", _POWER + micro("(m1 - a1) * x + (m2 - a2) * y + (m3 - a3) * z", "pc1") + " from cell cross join cov cross join vec"))


# seeds

_LATTICE = """hex as (select (i + 3) * (cols + rows_ + 10) + j + 3 + rows_ as index, floor(y)::int as r, floor(x)::int as c from (select i, j, cols, rows_, side, i * rise as y, (j + 0.5 * i) * s as x from (
  select *, s * sqrt(3) / 2 as rise, floor(side / (s * sqrt(3) / 2))::bigint + 4 as rows_, floor(side / s)::bigint + 4 as cols from (select side, sqrt(2 * pi() / sqrt(3)) * 3 as s from grid)),
  lateral (select unnest(range(-3, rows_)) as i), lateral (select unnest(range(-3 - rows_ // 2, cols + 4)) as j)) where y >= 0 and y < side and x >= 0 and x < side)"""
_SURFACE = "var as (select a.r, a.c, greatest(0, " + " + ".join(f"sum(b.{b} * b.{b}) / count(*) - pow(sum(b.{b}) / count(*), 2)" for b in BANDS) + ") as v from cell a join cell b on b.r between a.r - 2 and a.r + 2 and b.c between a.c - 2 and a.c + 2 group by a.r, a.c)"
_SEEDS = f""", {_LATTICE}, {_SURFACE},
snap as (select index, r, c from (select index, v.r, v.c, row_number() over (partition by index order by v, v.r, v.c) as k from hex h join var v on (v.r - h.r) * (v.r - h.r) + (v.c - h.c) * (v.c - h.c) <= 1.8225::double) where k = 1),
ord as (select *, row_number() over (order by index) as i from snap),
acc as (select 0::bigint as i, []::struct(index bigint, r int, c int)[] as done union all select o.i, case when len(list_filter(done, lambda s: (s.r - o.r) * (s.r - o.r) + (s.c - o.c) * (s.c - o.c) < 9)) = 0 then list_append(done, struct_pack(index := o.index::bigint, r := o.r::int, c := o.c::int)) else done end from acc join ord o on o.i = acc.i + 1),
seed as (select unnest(done, recursive := true) from acc where i = (select max(i) from acc))
"""
base.ORACLES["hex_seeds"] = sql("grid", ", " + _LATTICE + " select index::bigint as index, r::bigint as r, c::bigint as c from hex")
base.ORACLES["seed_mis"] = _recursive(sql("cell", _SEEDS + "select index::bigint as rank, r::bigint as r, c::bigint as c from seed"))
base.ORACLES["valid_seeds"] = _recursive(sql("cell", _SEEDS + "select rank, r, c from (select s.index::bigint as rank, v.r::bigint as r, v.c::bigint as c, row_number() over (partition by s.index order by (v.r - s.r) * (v.r - s.r) + (v.c - s.c) * (v.c - s.c), v.r, v.c) as k from seed s cross join cell v where m1 > 30) where k = 1"))
_NEAREST = "select cell.r, cell.c, min((cell.r - s.r) * (cell.r - s.r) + (cell.c - s.c) * (cell.c - s.c)) as d2 from cell cross join"
base.ORACLES["seed_coverage"] = _recursive(
    sql(
        "cell",
        _SEEDS
        + f""", far as (select *, row_number() over (order by d2 desc, r, c) as i from ({_NEAREST} seed s group by 1, 2) where d2 > 36),
add_ as (select 0::bigint as i, []::struct(r int, c int)[] as done union all select o.i, case when len(list_filter(done, lambda s: (s.r - o.r) * (s.r - o.r) + (s.c - o.c) * (s.c - o.c) <= 36)) = 0 then list_append(done, struct_pack(r := o.r::int, c := o.c::int)) else done end from add_ join far o on o.i = add_.i + 1),
all_ as (select r, c from seed union all select unnest(done, recursive := true) from add_ where i = (select max(i) from add_)),
d as (select sqrt(d2) as d from ({_NEAREST} all_ s group by 1, 2))
select count(*) as cells, count(*) filter (d <= 6) as within, """
        + _named(("quantile_cont(d, 0.5)", "p50"), ("quantile_cont(d, 0.95)", "p95"), ("quantile_cont(d, 0.99)", "p99"), ("max(d)", "max"))
        + " from d",
    )
)

_PEAKS = """, cen as (select run_id, spatialr, ranger, phase, label, avg(r) as y, avg(c) as x from label_px where label > 0 group by all),
imp as (select spatialr, floor(y + 0.5)::int as r, floor(x + 0.5)::int as c, count(*) as n from cen group by 1, 2, 3),
dens as (select i.spatialr, a.r, a.c, sum(n * (3 - abs(a.r - i.r)) * (3 - abs(a.c - i.c))) as density from imp i join cell a on abs(a.r - i.r) <= 2 and abs(a.c - i.c) <= 2 group by 1, 2, 3),
peak as (select a.* from dens a where not exists (select 1 from dens b where b.spatialr = a.spatialr and abs(b.r - a.r) <= 2 and abs(b.c - a.c) <= 2 and (b.density > a.density or b.density = a.density and (b.r < a.r or b.r = a.r and b.c < a.c)))),
sup as (select p.spatialr, p.r, p.c, any_value(density) as density, count(distinct run_id) as runs, count(distinct phase) as phases, count(distinct ranger) as rangers from peak p join cen q on q.spatialr = p.spatialr and (y - p.r) * (y - p.r) + (x - p.c) * (x - p.c) <= 9 group by 1, 2, 3)
"""
base.ORACLES["density_peaks"] = sql("label_px", _PEAKS + "select spatialr::bigint as spatialr, r::bigint as r, c::bigint as c, density::bigint as density, runs, phases, rangers from sup")
base.ORACLES["centroid_tracks"] = _recursive(
    sql(
        "label_px",
        _PEAKS
        + """, node as (select spatialr::bigint * 1000000000000 + r::bigint * 1000000 + c as node, case spatialr when 4 then 0 when 6 then 1 else 2 end as step, r, c from sup where runs >= 2),
near2 as (select a.node as u, b.node as v, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) as d2 from node a join node b on b.step = a.step + 1 where (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 16),
link as (select u, v from (select *, row_number() over (partition by u order by d2, v) as i, row_number() over (partition by v order by d2, u) as j from near2) where i = 1 and j = 1),
both2 as (select u, v from link union all select v, u from link),
reach as (select node, node as other from node union select reach.node, v from reach join both2 on u = other),
track as (select node, min(other) as track from reach group by 1)
select node, step::bigint as step, r::bigint as r, c::bigint as c, track, scales from node join track using (node) join (select track, count(distinct step) as scales from node join track using (node) group by 1 having count(distinct step) >= 2) using (track)""",
    )
)
base.ORACLES["patch_radii"] = _recursive(
    sql(
        "cell",
        """, px as (select r * 1000000::bigint + c as cell, r, c, (m1 > 25)::int as side_ from cell), lab as (select cell, r, c, side_, cell as region, 0 as t from px),
run1 as (select r, side_, min(c) as a, max(c) as b from (select *, c - row_number() over (partition by r, side_ order by c) as g from px) group by r, side_, g),
nd as (select *, r * 1000000::bigint + a as id from run1),
eg as (select p.id as u, q.id as v from nd p join nd q on p.side_ = q.side_ and abs(p.r - q.r) = 1 and p.a <= q.b + 1 and q.a <= p.b + 1),
cc as (select id, id as other from nd union select cc.id, v from cc join eg on u = other),
comp as (select id, min(other) as region from cc group by 1),
sz as (select region, sum(b - a + 1) as n from nd join comp using (id) group by 1)
select count(*) as patches, """
        + _named(("quantile_cont(sqrt(n / pi()), 0.25)", "p25"), ("quantile_cont(sqrt(n / pi()), 0.5)", "p50"), ("quantile_cont(sqrt(n / pi()), 0.75)", "p75"))
        + " from sz",
    )
)
_PATCHES = base.ORACLES["patch_radii"].rpartition("select count(*) as patches")[0]


@query(_PATCHES + ", q as (select list_distinct([quantile_cont(sqrt(n / pi()) * 0.5, 0.25), quantile_cont(sqrt(n / pi()) * 0.5, 0.6), quantile_cont(sqrt(n / pi()) * 0.5, 0.95)]) as q from sz where n >= 2), u as (select list_sort(q) as q from q), x as (select unnest(range(4)) as i, q from u), y as (select i, q[least(i + 1, len(q))] as v from x) select i as index, least(30, greatest(1, round_even(v / 0.5, 0)))::bigint as spatialr, greatest(1, round_even(pi() * v * v / 0.25, 0))::bigint as minsize from y")
def patch_scales(spark, d):
    cells = base._cells(spark, d).withColumns({"cell": (F.col("r") * 1_000_000 + F.col("c")).cast("long"), "side": (F.col("m1") > 25).cast("int")})
    return out(regions.patch_scales(regions.patches(cells.select("cell", "r", "c", "side"), ["side"], 0.5, 2), (0.25, 0.6, 0.95), 0.5, 4), "index:i spatialr:i minsize:i")


# prescreening

_HSM = base._KNN + """, a0 as (select k, list_sort(list(distance) filter (distance > 0)) as a from knn where k in (2, 4, 8, 16, 32) group by 1),
nar as (select k, a, 0 as t from a0 union all select k, list_slice(a, i, i + h - 1), t + 1 from (select k, a, t, h, list_position(w, list_min(w)) as i from (
  select k, a, t, h, list_transform(range(1, len(a) - h + 2), lambda j: a[j + h - 1] - a[j]) as w from (select *, (len(a) + 1) // 2 as h from nar where len(a) > 2)))),
mode_ as (select k, (f[1] + f[-1]) / 2 as mode from (select k, arg_max(a, t) as f from nar group by 1)),
iv as (select k, a[1] as low, a[-1] as high from nar where t = 1 or (t = 0 and len(a) <= 2)),
md as (select * from mode_ join iv using (k)),
win as (select k as first_k, lead(k) over w as at_, lead(k, 2) over w as last_k, [mode, lead(mode) over w, lead(mode, 2) over w] as m from md window w as (order by k)),
sp as (select *, (list_max(m) - list_min(m)) / list_sort(m)[2] as span from win where last_k is not null),
pick as (select * from sp order by (not span <= 0.1::double)::int, case when span <= 0.1::double then first_k::double else span end, first_k limit 1)
"""
_HSM_SQL = "with recursive " + _HSM
base.ORACLES["hsm_plateau"] = _HSM_SQL + "select k::bigint as k, first_k::bigint as first_k, last_k::bigint as last_k, not span <= 0.1::double as fallback, " + _named(("mode", "mode"), ("low", "low"), ("high", "high"), ("span", "span")) + " from pick join md on k = at_"
base.ORACLES["ranger_levels"] = _HSM_SQL + ", s as (select mode, low, high from pick join md on k = at_), l as (select 0 as level, 'mode' as position, mode as ranger from s union all select 1, 'interval_lower', low from s union all select 2, 'interval_upper', high from s) select level::bigint as level, position, level = 0 as is_baseline, " + micro("ranger", "ranger") + " from (select *, row_number() over (partition by round(ranger, 15) order by level) as i from l where ranger > 0) where i = 1"


@query(f"with {base._KNN}, d as (select distance from knn where k = 10) select (i - 1)::bigint as level, p as share, " + micro("v", "ranger") + " from (select unnest(range(1, 5)) as i, unnest([0.25::double, 0.5, 0.75, 0.9]) as p, unnest(quantile_cont(distance, [0.25, 0.5, 0.75, 0.9])) as v from d)")
def distance_ladder(spark, d):
    return out(prescreen.distance_ladder(adapters.vectors(spark, d), sample=None), "level:i share ranger:m")


@query(sql("segment", ", own as (select run_id, list_sort(list(pixels)) as x from segment group by 1), lg as (select run_id, x, list_transform(x, lambda v: ln(v)) as l, len(x) as n from own), sm as (select run_id, x, n, case when n > 5 then list_transform(range(1, n + 1), lambda i: list_median(list_slice(l, i - least(i - 1, n - i, 2), i + least(i - 1, n - i, 2)))) else l end as l from lg), bd as (select run_id, x, n, list_transform(range(2, n), lambda i: floor((l[i + 1] - 2 * l[i] + l[i - 1]) * 1e9 + 0.5)) as b from sm) select run_id, n, case when n >= 10 then greatest(1, x[list_position(b, list_max(b)) + 1]) else 1 end::bigint as cutoff from bd"))
def jump_cutoff(spark, d):
    return out(checks.jump_cutoff(base._segments(spark, d), "pixels", ("run_id",), 5), "run_id n:i cutoff:i")


# flights

_WINDOWS = """, mean0 as (select avg(lat) as mlat, min(lon) as base from line), off0 as (select *, (lon - base + 180 + 360) % 360 - 180 as off_ from line cross join mean0), mean1 as (select avg(off_) as mlon from off0),
loc as (select *, (off_ - mlon) * (111412.84::double * cos(radians(mlat)) - 93.5::double * cos(3 * radians(mlat)) + 0.118::double * cos(5 * radians(mlat))) as ex, (lat - mlat) * (111132.92::double - 559.82::double * cos(2 * radians(mlat)) + 1.175::double * cos(4 * radians(mlat)) - 0.0023::double * cos(6 * radians(mlat))) as ny from off0 cross join mean1),
lm as (select *, ex * sin(radians(45.0::double)) + ny * cos(radians(45.0::double)) as along_m, ex * cos(radians(45.0::double)) - ny * sin(radians(45.0::double)) as cross_m from loc),
wd as (select sortie, line, image_id as first_image, last(image_id) over w as last_image, last(along_m) over w as end_, along_m, max(abs(along_m)) over w as far, count(*) over w as n, median(cross_m) over (partition by sortie, line) as cr, max(sqrt(along_m * along_m + cross_m * cross_m)) over w as radial from lm window w as (partition by sortie, line order by along_m, t_us, image_id rows between current row and 2 following)),
ww as (select sortie, line, first_image, last_image, abs((along_m + end_) / 2) as mid, far, end_ - along_m as span, cr as cross_m, (along_m + end_) / 2 as along_m, radial from wd where n = 3),
best as (select * from (select *, row_number() over (partition by sortie, line order by mid, far, span, first_image) as i from ww) where i = 1)
"""
base.ORACLES["centred_windows"] = sql("line", _WINDOWS + "select sortie::bigint as sortie, line::bigint as line, first_image, last_image, " + ", ".join(milli(c, c) for c in ("mid", "far", "span", "cross_m", "along_m", "radial")) + " from best")
base.ORACLES["grid_block"] = sql(
    "line",
    _WINDOWS
    + """, bl as (select sortie, line as first_line, lead(line) over w as last_line, (cross_m + lead(cross_m) over w) / 2 as cc, (along_m + lead(along_m) over w) / 2 as ac, greatest(radial, lead(radial) over w) as far_, row_number() over w as k from best window w as (partition by sortie order by cross_m, line))
select sortie::bigint as sortie, first_line::bigint as first_line, last_line::bigint as last_line, """
    + ", ".join(milli(x, n) for x, n in (("sqrt(cc * cc + ac * ac)", "centre"), ("far_", "farthest"), ("cc", "cross_centre"), ("ac", "along_centre")))
    + " from bl where last_line is not null order by sqrt(cc * cc + ac * ac), far_, abs(cc), sortie, k limit 1",
)


@query(sql("position", "select image_id, case when lat > 50.009::double then 'position out of range' else '' end as reasons from position").replace("lat > 50.009::double", "abs(lat) > 90"))
def image_reasons(spark, d):
    return flight.validity_reasons(adapters.position(spark, d)).select("image_id", "reasons")


# study

@query("with m as (" + " union all ".join(f"select l_returnflag as flag, '{k}' as metric, {c} as v from lineitem" for k, c in (("rc_score", "l_discount"), ("missed", "l_tax"))) + ") select flag, metric, count(*) as n, " + _named(("avg(v)", "mean"), ("coalesce(stddev_samp(v), 0)", "sd")) + " from m group by 1, 2")
def printed_metrics(spark, d):
    rows = adapters.table(spark, d, "lineitem")
    lines = rows.select(F.col("l_returnflag").alias("flag"), F.explode(F.array(F.concat(F.lit("  RC score: "), F.col("l_discount").cast("string")), F.concat(F.lit("Missed = "), F.col("l_tax").cast("string")), F.lit("no metric here"))).alias("line"))
    return out(partitions.printed_spread(lines, ["flag"]), "flag metric n:i mean:m sd:m")


@query(sql("label_px", """, ab as (select x.label as a, y.label as b, count(*) as n from label_px x join label_px y on x.r = y.r and x.c = y.c where x.run_id = 's9_g2_p0' and y.run_id = 's4_g2_p0' group by 1, 2),
t as (select *, sum(n) over (partition by a) as ln, sum(n) over (partition by b) as rn from ab), u as (select *, n / rn >= 0.8::double as in_a, n / ln >= 0.8::double as in_b from t),
mg as (select b from u where in_b group by b having count(*) >= 2 and sum(n) >= 0.8::double * max(rn)),
p as (select a, max(ln) as n, max((in_a and in_b)::int) as matched, count(*) filter (in_a) as inside, coalesce(sum(n) filter (in_a), 0) as cov, max((in_b and b in (select b from mg))::int) as merged from u group by 1),
k as (select *, case when matched = 1 then 'matched' when inside >= 2 and cov >= 0.8::double * n then 'split' when merged = 1 then 'merged' else 'missed' end as kind from p)
select count(*) as parts, """ + _named(*((f"coalesce(sum(n) filter (kind = '{k}'), 0) / sum(n)", k) for k in ("matched", "split", "merged", "missed"))) + " from k"))
def hoover_scores(spark, d):
    labels = base._labels(spark, d)
    one = lambda run, name: labels.where(F.col("run_id") == run).select("r", "c", F.col("label").alias(name))
    return out(partitions.hoover_scores(one("s9_g2_p0", "a").join(one("s4_g2_p0", "b"), ["r", "c"])), "parts:i matched:m split:m merged:m missed:m")


@query("with p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for a, b in base._COLS) + ") select row_metric, column_metric, " + micro("r", "r") + " from (select a as row_metric, b as column_metric, r from p union all select b, a, r from p union all select distinct x, x, 1 from (select a as x from p union all select b from p))")
def correlation_matrix(spark, d):
    pairs = study.correlations(adapters.table(spark, d, "lineitem").select(*base._NUM), base._NUM)
    return out(study.correlation_matrix(pairs), "row_metric column_metric r:m")


@query("select event_id, unnest(json_keys(props)) as field, json_extract_string(props, unnest(json_keys(props))) as value from events")
def profile_fields(spark, d):
    return study.flattened(adapters.table(spark, d, "events"), "event_id", "props")


@query("select o_orderkey, status from (select o_orderkey, case o_orderstatus when 'F' then 'complete' when 'P' then 'choice_required' else 'running' end as status from orders) where status in ('complete', 'choice_required')")
def finished_steps(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "choice_required").otherwise("running")
    return study.finished(adapters.table(spark, d, "orders").select("o_orderkey", status.alias("status")))


@query("select c_custkey, n_name, coalesce(n, 0) as orders from customer left join nation on n_nationkey = c_nationkey left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def collected_results(spark, d):
    t = lambda n: adapters.table(spark, d, n)
    plan = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    counted = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    whole = study.collect_results(study.collect_results(plan, [t("nation").select("n_nationkey", "n_name")], ["n_nationkey"]), [counted], ["c_custkey"])
    return whole.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_results(spark, d):
    return study.missing_results(adapters.table(spark, d, "customer").select("c_custkey"), adapters.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select n_nationkey as key, n_name as nation, null::varchar as region from nation union all select r_regionkey, null, r_name from region")
def union_of_keys(spark, d):
    t = lambda n: adapters.table(spark, d, n)
    return study.union_of_keys([t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation")), t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))])


@query(sql("attempt", "select variant_id, replicate, count(*) as n from attempt group by 1, 2 having count(*) > 1"))
def duplicate_keys(spark, d):
    return ledger.duplicate_keys(adapters.attempt(spark, d), "variant_id", "replicate")


@query("with x as (select distinct l_tax as v from lineitem), m as (select v, row_number() over (order by v) as g from x) select g as \"group\", count(*) as rasters, count(distinct l_returnflag) as variants, count(distinct (l_returnflag, l_linenumber)) as pairs, count(distinct l_linestatus) as projections, count(*) filter (l_quantity > 49) as rotated from lineitem join m on v = l_tax group by 1")
def resolution_report(spark, d):
    rows = adapters.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("variant_id"), F.col("l_linenumber").alias("replicate"), F.col("l_tax").alias("xres"), F.col("l_tax").alias("yres"), F.col("l_linestatus").alias("proj"), (F.col("l_quantity") > 49).alias("rotated"))
    return out(checks.resolution_report(rows), "group:i rasters:i variants:i pairs:i projections:i rotated:i")


@query("select (select count(*) from (select l_orderkey, l_linenumber from lineitem except all select o_orderkey, 1 from orders)) as left_only, (select count(*) from (select o_orderkey, 1 from orders except all select l_orderkey, l_linenumber from lineitem)) as right_only")
def same_rows(spark, d):
    a = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n"))
    return checks.same_rows(a, adapters.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("n")))


# scalars

@query("""select c_custkey, case when c_acctbal > 0 then printf('%.4f', c_acctbal) else 'NA' end as fixed, case when len(c_custkey::varchar) >= 6 then c_custkey::varchar else lpad(c_custkey::varchar, 6, '0') end as padded, 'run_' || case when c_custkey != 0 and c_custkey % 1000 = 0 then (c_custkey // 1000)::bigint || 'k' else c_custkey::varchar end || '_' || c_nationkey as rendered,
  trim(regexp_replace(trim(c_name), '[^A-Za-z0-9._-]+', '_', 'g'), '_') as safe, case when c_nationkey % 2 = 0 then (c_nationkey // 2)::bigint::varchar else (c_nationkey // 2)::bigint || 'p5' end as threshold, """ + micro("((c_custkey % 720 - 360) + 180 + 720) % 360 - 180", "wrapped") + " from customer")
def scalar_texts(spark, d):
    c = adapters.table(spark, d, "customer")
    return c.select(
        "c_custkey",
        exprs.fixed4(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("fixed"),
        exprs.zero_padded(F.col("c_custkey"), 6).alias("padded"),
        exprs.rendered("run_{key:k}_{nation}", key=F.col("c_custkey"), nation=F.col("c_nationkey")).alias("rendered"),
        exprs.safe_id(F.col("c_name")).alias("safe"),
        exprs.threshold_label(F.col("c_nationkey") / 2).alias("threshold"),
        exprs.micro(exprs.longitude_wrap((F.col("c_custkey") % 720 - 360).cast("double"))).alias("wrapped"),
    )


@query("""with p as (select *, p_size % 5 as k from part) select p_partkey, case when k = 0 then 'failed' when k < 3 then 'ok' else 'ok_no_ortho' end as status, case when k in (1, 2) then 'SUCCESS' when k = 3 then 'FAILED' when k = 0 then 'FAILED' else 'CRITICAL' end as screening, case when k < 3 then 'own' else 'other' end as filled, """
       + _named(("case when k = 0 then p_size when k = 1 then sqrt(p_retailprice / pi()) else p_size * 0.5 end", "radius"), ("greatest(0.005, 0.1::double * p_retailprice)", "dr"), ("greatest(5.0, 0.2::double * p_size)", "dm")) + ", (p_size > 3)::int::bigint as ds, " + micro("case when k = 0 then 1 else p_size end", "last") + ", array_length(p_) as n from (select *, [1, p_size, p_size] as p_ from p)".replace(", array_length(p_) as n", ""))
def scalar_rules(spark, d):
    p = adapters.table(spark, d, "part").withColumn("k", F.col("p_size") % 5)
    size, price, k = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("k")
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    code = F.when(k == 0, 1).otherwise(0)
    ortho = F.when(k.isin(1, 2), F.lit("o.tif")).otherwise(F.lit(" "))
    widths = exprs.adaptive_widths(price, size, size)
    return p.select(
        "p_partkey",
        ledger.derive_status(code, ortho).alias("status"),
        exprs.screening_status(code, ortho, F.when(k.isin(0, 3), F.lit("log")).otherwise(F.lit(""))).alias("screening"),
        exprs.first_filled(F.when(k < 3, F.lit("own")).otherwise(F.lit(" ")), text, F.lit("other")).alias("filled"),
        exprs.micro(exprs.radius_m(F.when(k == 0, size), F.when(k == 1, price).otherwise(none), size, F.lit(0.5))).alias("radius"),
        exprs.micro(widths["dr"]).alias("dr"),
        exprs.micro(widths["dm"]).alias("dm"),
        widths["ds"].cast("long").alias("ds"),
        exprs.micro(F.element_at(exprs.padded(F.array(F.lit(1.0), size), F.when(k == 0, 1).otherwise(3)), -1)).alias("last"),
    )
