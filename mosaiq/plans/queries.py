"""The engine's queries over the driver tables, each with its oracle. Float results are given in millionths, as integers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import exprs
from mosaiq.operators import boundary, checks, features, flight, ledger, partitions, prescreen, regions, response, seeds, segments, stability, study
from mosaiq.plans.oracle_views import micro, sql
from mosaiq.sources import adapters
from mosaiq.sources.stage import stage

N, LIMIT = adapters.REPLICATES, 15.0
THRESHOLDS = [5.0, 10.0, 15.0, 20.0, 25.0]
LAGS = [1, 2, 3, 5, 8, 13]
KS = [2, 4, 8, 16, 32]
BANDS = ("m1", "m2", "m3")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def out(df: DataFrame, spec: str) -> DataFrame:
    """Columns by a short text: `name` as it is, `name:i` as a long, `name:m` in millionths, `name:k` in thousandths."""
    cols = []
    for x in spec.split():
        name, _, kind = x.partition(":")
        c = F.col(name)
        cols.append({"": c, "i": c.cast("long"), "m": exprs.micro(c), "k": exprs.milli(c)}[kind].alias(name))
    return df.select(*cols)


def want(spec: str, source: str) -> str:
    """The same in SQL."""
    cols = []
    for x in spec.split():
        name, _, kind = x.partition(":")
        cols.append({"": name, "i": f"cast({name} as bigint) as {name}", "m": micro(name, name)}[kind])
    return f"select {', '.join(cols)} from {source}"


def _obs(spark, d):
    return adapters.pixel_obs(spark, d)


def _pixels(spark, d):
    return stability.pixel_stability(_obs(spark, d))


def _summary(spark, d):
    return stability.variant_summary(_pixels(spark, d), adapters.grid_side(spark, d) ** 2, N, LIMIT)


def _cells(spark, d):
    return adapters.cells(_obs(spark, d))


def _labels(spark, d):
    return adapters.label_px(_cells(spark, d))


def _segments(spark, d):
    return segments.segment_sizes(_labels(spark, d))


_PIXEL = "variant_id r:i c:i valid_count:i med_b1:m med_b2:m med_b3:m mad:m rmse:m"
_SUMMARY = "variant_id any_support:i full_support:i observations:i min_valid_count:i max_valid_count:i mean_mad:m p95_mad:m mean_rmse:m p95_rmse:m stable_pixels:i unstable_pixels:i dropout:m persistence:m variable_support_fraction:m stable_fraction:m unstable_fraction:m"


@query(sql("pixels", want(_PIXEL, "pixels")))
def stability_pixel(spark, d):
    return out(_pixels(spark, d), _PIXEL)


@query(sql("summary", want(_SUMMARY, "summary")))
def stability_variant_summary(spark, d):
    return out(_summary(spark, d), _SUMMARY)


@query(sql("pixels", "select variant_id, cast(r as bigint) as r, cast(c as bigint) as c, cast(case when valid_count = 3 then (rmse <= 15)::int else 255 end as bigint) as stable, cast(case when valid_count = 3 then (rmse > 15)::int else 255 end as bigint) as unstable, cast(case when valid_count < 3 then 0 when rmse <= 15 then 1 else 2 end as bigint) as quality from pixels"))
def stability_masks(spark, d):
    return out(stability.masks(_pixels(spark, d), N, LIMIT), "variant_id r:i c:i stable:i unstable:i quality:i")


@query(sql("pixels", "select variant_id, cast(k as bigint) as valid_count, cast(case when k = 0 then (select side * side from grid) - count(*) else count(*) filter (valid_count = k) end as bigint) as pixels from pixels cross join (values (0), (1), (2), (3)) x(k) group by variant_id, k"))
def support_histogram(spark, d):
    return out(stability.support_histogram(_pixels(spark, d), adapters.grid_side(spark, d) ** 2, N), "variant_id valid_count:i pixels:i")


@query(sql("summary", want("variant_id persistence:m dropout:m variable_support_fraction:m", "summary")))
def support_metrics(spark, d):
    return out(_summary(spark, d), "variant_id persistence:m dropout:m variable_support_fraction:m")


def _t(c: str, down: bool = False) -> str:
    return f"cast(floor({c} * 1e4 + 0.5) as bigint) {'desc' if down else 'asc'} nulls last"


for _kind, _keys in {"continuous": [_t("p95_rmse"), _t("mean_rmse"), _t("p95_mad"), _t("mean_mad")], "mask": [_t("stable_fraction", True), _t("unstable_fraction")], "support": [_t("dropout"), _t("variable_support_fraction"), _t("persistence", True)]}.items():

    def _rank(spark, d, kind=_kind):
        return out(stability.rank_variants(_summary(spark, d), kind), "variant_id rank:i")

    _rank.__name__ = f"rank_{_kind}"
    query(sql("summary", f"select variant_id, row_number() over (order by {', '.join(_keys)}, variant_id) as rank from summary"))(_rank)

_REVIEW = "threshold variant_id stable_pixels:i unstable_pixels:i stable_fraction:m unstable_fraction:m"


@query(sql("review", want(_REVIEW, "review")))
def threshold_review(spark, d):
    return out(stability.threshold_review(_pixels(spark, d), N, THRESHOLDS), _REVIEW)


@query(sql("review", "select threshold, variant_id, " + micro("stable_fraction", "stable_fraction") + " from (select *, row_number() over (partition by threshold order by stable_fraction desc nulls last, unstable_fraction nulls last, variant_id) as i from review) where i = 1"))
def threshold_winners(spark, d):
    return out(stability.threshold_winners(stability.threshold_review(_pixels(spark, d), N, THRESHOLDS)), "threshold variant_id stable_fraction:m")


@query(sql("pixels", "select variant_id, cast(replicate as bigint) as replicate, common_pixels, " + micro("distance", "distance") + ", row_number() over (partition by variant_id order by distance, replicate) as rank from (select variant_id, replicate, count(*) as common_pixels, sqrt(sum((b1 - med_b1) ** 2 + (b2 - med_b2) ** 2 + (b3 - med_b3) ** 2) / (count(*) * 3)) as distance from obs join pixels using (variant_id, r, c) group by 1, 2)"))
def medoid_replicate(spark, d):
    return out(stability.medoid_replicate(_obs(spark, d), _pixels(spark, d)), "variant_id replicate:i common_pixels:i distance:m rank:i")


@query(sql("pixel_obs", """, per as (select variant_id, min(c) as xmin, max(c) + 1 as xmax, min(r) as ymin, max(r) + 1 as ymax from pixel_obs group by 1),
a as (select 'union' as mode, min(xmin) as xmin, max(xmax) as xmax, min(ymin) as ymin, max(ymax) as ymax from per union all select 'intersection', max(xmin), min(xmax), max(ymin), min(ymax) from per union all select 'reference', xmin, xmax, ymin, ymax from per where variant_id = 'NO')
select mode, cast(xmin as bigint) as xmin, cast(xmax as bigint) as xmax, cast(ymin as bigint) as ymin, cast(ymax as bigint) as ymax, cast(xmax - xmin as bigint) as xsize, cast(ymax - ymin as bigint) as ysize from a"""))
def grid_modes(spark, d):
    return out(stability.grid_modes(_obs(spark, d), "NO"), "mode xmin:i xmax:i ymin:i ymax:i xsize:i ysize:i")


@query(sql("summary", """, f as (select (select variant_id from summary order by {c}, variant_id limit 1) as a, (select variant_id from summary order by {m}, variant_id limit 1) as b, (select variant_id from summary order by {s}, variant_id limit 1) as d)
select a as variant_id, a = b as mask_agrees, a = d as support_agrees from f""".format(c=", ".join([_t("p95_rmse"), _t("mean_rmse"), _t("p95_mad"), _t("mean_mad")]), m=", ".join([_t("stable_fraction", True), _t("unstable_fraction")]), s=", ".join([_t("dropout"), _t("variable_support_fraction"), _t("persistence", True)]))))
def selected_product(spark, d):
    return stability.selected_product(_summary(spark, d))


@query(sql("attempt", "select variant_id, replicate, status, attempt_seq, attempts from (select *, row_number() over (partition by variant_id, replicate order by attempt_seq desc) as i, count(*) over (partition by variant_id, replicate) as attempts from attempt) where i = 1"))
def ledger_latest(spark, d):
    return out(ledger.latest_attempts(adapters.attempt(spark, d)), "variant_id replicate status attempt_seq:i attempts:i")


@query(sql("attempt", "select variant_id, status, count(*) as n from attempt group by 1, 2"))
def ledger_status_counts(spark, d):
    return ledger.status_counts(ledger.check_status(adapters.attempt(spark, d)))


@query(sql("attempt", "select variant_id, replicate, attempt_seq, case when i = 1 then replicate else replicate || '_attempt_' || i end as label from (select *, row_number() over (partition by variant_id, replicate order by attempt_seq) as i from attempt)"))
def attempt_labels(spark, d):
    return ledger.attempt_labels(adapters.attempt(spark, d)).select("variant_id", "replicate", "attempt_seq", "label")


@query(sql("attempt", ", last as (select *, row_number() over (partition by variant_id, replicate order by attempt_seq desc) as i from attempt) select v as variant_id, 'rep_' || k as replicate from (select distinct variant_id as v from attempt) cross join range(7) r(k) where not exists (select 1 from last where i = 1 and variant_id = v and replicate = 'rep_' || k and status in ('ok', 'ok_no_ortho'))"))
def resume_plan(spark, d):
    attempts = adapters.attempt(spark, d)
    planned = attempts.select("variant_id").distinct().select("variant_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select("variant_id", F.concat(F.lit("rep_"), F.col("k").cast("string")).alias("replicate"))
    return ledger.resume_plan(planned, attempts)


@query(
    """with a as (select distinct o_orderpriority as a from orders), m as (select distinct l_linenumber as m from lineitem),
b as (select distinct l_returnflag as b from lineitem)
select 'accuracy-' || a || '_mesh-' || m || '_blend-' || b as variant_id, a as accuracy, m as mesh, b as blend from a cross join m cross join b"""
)
def variant_grid(spark, d):
    """Factors whose levels are the values that the tables hold."""
    orders, lines = adapters.table(spark, d, "orders"), adapters.table(spark, d, "lineitem")
    return ledger.factor_grid(spark, {"accuracy": orders.select("o_orderpriority"), "mesh": lines.select("l_linenumber"), "blend": lines.select("l_returnflag")})


@query(
    """with s as (select distinct cast(p_size as int) as s from part), g as (select distinct cast(round(l_tax * 100) as int) as g from lineitem),
p as (select distinct cast(l_linenumber as int) as p from lineitem)
select cast(s as bigint) as spatialr, cast(g as bigint) as ranger, cast(p as bigint) as phase, 's' || s || '_g' || g || '_p' || p as candidate_id, g = 2 and p = 0 as is_baseline
from s cross join g cross join p"""
)
def candidate_population(spark, d):
    """Scales, rangers and phases that the tables hold; 50 x 9 x 7 of them are within the budget."""
    lines = adapters.table(spark, d, "lineitem")
    scales = adapters.table(spark, d, "part").select(F.col("p_size").cast("int").alias("spatialr")).distinct()
    rangers = lines.select(F.rint(F.col("l_tax") * 100).cast("int").alias("ranger")).distinct()
    phases = lines.select(F.col("l_linenumber").cast("int").alias("phase")).distinct()
    return out(ledger.candidate_population(scales, rangers, phases, 4_000), "spatialr:i ranger:i phase:i candidate_id is_baseline")


@query(sql("segment", want("run_id label:i pixels:i area:m radius:m", "segment")))
def segment_sizes(spark, d):
    return out(_segments(spark, d), "run_id label:i pixels:i area:m radius:m")


@query(sql("seg", want("run_id label:i q:m size_class", "seg")))
def segment_q_classes(spark, d):
    return out(_segments(spark, d), "run_id label:i q:m size_class")


@query(sql("share", want("run_id size_class segments:i area:m share:m", "share")))
def run_class_shares(spark, d):
    return out(segments.class_shares(_segments(spark, d)), "run_id size_class segments:i area:m share:m")


@query(sql("wq", want("run_id q10:m q50:m q90:m", "wq")))
def run_weighted_quantiles(spark, d):
    return out(segments.weighted_quantiles(_segments(spark, d), ["run_id"], "q", "area", (0.1, 0.5, 0.9)), "run_id q10:m q50:m q90:m")


@query(sql("match", want("run_id scale_match:m", "match")))
def run_scale_match(spark, d):
    return out(segments.scale_match(_segments(spark, d)), "run_id scale_match:m")


@query(sql("hist", "select run_id, " + ", ".join(micro(f"sum(h) filter (k = {k})", f"h{k}") for k in range(7)) + " from hist group by 1"))
def run_q_histogram(spark, d):
    return out(segments.q_histogram(_segments(spark, d)), "run_id " + " ".join(f"h{k}:m" for k in range(7)))


def _runs(spark, d):
    return segments.run_summary(_segments(spark, d))


@query(sql("tails wq match", "select run_id, count(*) as segments, " + ", ".join(micro(f"any_value({c})", n) for c, n in (("low", "lower_tail"), ("mid", "central"), ("up", "upper_tail"), ("scale_match", "scale_match"), ("q50", "q50"))) + ", any_value(dominant) as dominant_class from seg join tails using (run_id) join wq using (run_id) join match using (run_id) group by 1"))
def run_summary(spark, d):
    return out(_runs(spark, d), "run_id segments:i lower_tail:m central:m upper_tail:m scale_match:m q50:m dominant_class")


@query(sql("dist", "select cast(spatialr as bigint) as spatialr, left_run, right_run, " + ", ".join(micro(c, c) for c in ("ordinal", "histogram", "tail", "radius")) + ", " + micro("ordinal + histogram + tail", "combined") + " from dist"))
def run_pair_distances(spark, d):
    return out(response.run_pairs(_runs(spark, d)), "spatialr:i left_run right_run ordinal:m histogram:m tail:m radius:m combined:m")


@query(sql("dist", ", b as (select spatialr, left_run as run_id, ordinal + histogram + tail as v from dist union all select spatialr, right_run, ordinal + histogram + tail from dist), m as (select spatialr, run_id, avg(v) as mean from b group by 1, 2) select cast(spatialr as bigint) as spatialr, run_id, " + micro("mean", "mean") + " from (select *, row_number() over (partition by spatialr order by floor(mean * 1e9 + 0.5), run_id) as i from m) where i = 1"))
def group_medoid_run(spark, d):
    return out(response.medoids(response.run_pairs(_runs(spark, d)), "combined"), "spatialr:i run_id mean:m")


@query(sql("tails wq match", "select cast(t.spatialr as bigint) as spatialr, count(*) as runs, " + ", ".join(micro(x, n) for x, n in (("median(q50)", "centre"), ("median(q90 - q10)", "spread"), ("avg(q90 + q10 - 2 * q50)", "skew"), ("avg(low)", "lower_tail_mean"), ("avg(mid)", "central_mean"), ("avg(up)", "upper_tail_mean"), ("coalesce(stddev_samp(mid), 0)", "central_sd"))) + ", count(distinct dominant) as dominant_classes, median(q50) >= 0.5 and median(q50) <= 2 and avg(mid) >= 0.5 as centered, avg(low) + avg(up) > 0.5 as edge_loaded, avg(low) > 0.35::double and avg(low) > 1.5 * avg(up) as one_sided_lower, avg(up) > 0.35::double and avg(up) > 1.5 * avg(low) as one_sided_upper, avg(mid) < 0.5 as missing_central, abs(avg(q90 + q10 - 2 * q50)) > 1.5 as strongly_skewed, median(q90 - q10) > 1.5 as unstably_spread, avg(low) > avg(mid) and avg(low) > avg(up) as lower_dominated, avg(up) > avg(mid) and avg(up) > avg(low) as upper_dominated, count(distinct dominant) >= 3 or (max((dominant = 'small')::int) = 1 and max((dominant = 'large')::int) = 1) as multimodal from tails t join wq using (run_id) join match using (run_id) group by 1"))
def group_diagnostics(spark, d):
    return out(response.group_diagnostics(_runs(spark, d)), "spatialr:i runs:i centre:m spread:m skew:m lower_tail_mean:m central_mean:m upper_tail_mean:m central_sd:m dominant_classes:i centered multimodal edge_loaded one_sided_lower one_sided_upper missing_central strongly_skewed unstably_spread lower_dominated upper_dominated")


def _matrix(spark, d):
    labels = _labels(spark, d)
    return response.analysis_matrix(labels, segments.segment_sizes(labels), 8)


@query(sql("matrix", "select run_id, cast(cell_row as bigint) as cell_row, cast(cell_col as bigint) as cell_col, " + micro("low", "low") + ", " + micro("mid", "mid") + ", " + micro("up", "up") + ", dominant_class, tail from matrix"))
def analysis_matrix(spark, d):
    at = lambda k: F.get("shares", F.lit(k))
    return out(_matrix(spark, d).withColumns({"low": at(0) + at(1), "mid": at(2), "up": at(3) + at(4)}), "run_id cell_row:i cell_col:i low:m mid:m up:m dominant_class tail")


_DOMINANCE = "run_id cells:i problem_area:m micro:m small:m in_scale:m large:m oversize:m lower_cells:m central_cells:m upper_cells:m"


@query(sql("dominance", want(_DOMINANCE, "dominance")))
def spatial_dominance(spark, d):
    return out(response.spatial_dominance(_matrix(spark, d)), _DOMINANCE)


_V = ("micro", "small", "in_scale", "large", "oversize", "lower_cells", "central_cells", "upper_cells")


@query(sql("dominance", f", p as (select a.spatialr, {' + '.join(f'abs(a.{c} - b.{c})' for c in _V)} as d from dominance a join dominance b on a.spatialr = b.spatialr and a.run_id < b.run_id), g as (select spatialr, max(central_cells) - min(central_cells) as central_range, greatest({', '.join(f'avg({c})' for c in _V[:5])}) as agreement from dominance group by 1) select cast(spatialr as bigint) as spatialr, " + ", ".join(micro(x, n) for x, n in (("avg(d)", "distance_mean"), ("max(d)", "distance_max"), ("any_value(central_range)", "central_range"), ("any_value(agreement)", "agreement"))) + " from p join g using (spatialr) group by 1"))
def spatial_stability(spark, d):
    return out(response.spatial_stability(response.spatial_dominance(_matrix(spark, d))), "spatialr:i distance_mean:m distance_max:m central_range:m agreement:m")


@query(sql("edge", "select run_id, cast(r as bigint) as r, cast(c as bigint) as c from edge"))
def boundary_pixels(spark, d):
    return out(boundary.boundary_pixels(_labels(spark, d)), "run_id r:i c:i")


@query(sql("edge", "select cast(l.spatialr as bigint) as spatialr, cast(l.r as bigint) as r, cast(l.c as bigint) as c, " + micro("count(e.run_id) / any_value(runs)", "support") + " from label_px l join (select spatialr, count(distinct run_id) as runs from label_px group by 1) using (spatialr) left join edge e on e.run_id = l.run_id and e.r = l.r and e.c = l.c where l.label > 0 group by 1, 2, 3"))
def boundary_support(spark, d):
    labels = _labels(spark, d)
    return out(boundary.boundary_support(labels, boundary.boundary_pixels(labels)), "spatialr:i r:i c:i support:m")


@query(sql("edge pair edge_n", "select left_run, right_run, coalesce(k, 0) as shared, coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(k, 0) as united, " + micro("case when coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(k, 0) > 0 then coalesce(k, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(k, 0)) else 1 end", "jaccard") + " from pair left join edge_n a on a.run_id = left_run left join edge_n b on b.run_id = right_run left join (select x.run_id as l, y.run_id as r, count(*) as k from edge x join edge y on x.spatialr = y.spatialr and x.r = y.r and x.c = y.c and x.run_id < y.run_id group by 1, 2) s on s.l = left_run and s.r = right_run"))
def boundary_jaccard(spark, d):
    labels = _labels(spark, d)
    return out(boundary.boundary_jaccard(boundary.boundary_pixels(labels), boundary.run_pairs(labels)), "left_run right_run shared:i united:i jaccard:m")


_PAIR_IN = "select left_run, right_run, reach from pair"


@query(sql("pair pair_in pair_score", want("left_run right_run pixels:i support:m", "pair_score"), pair_in=_PAIR_IN))
def boundary_pair_support(spark, d):
    labels, edges = _boundaries(spark, d)
    return out(boundary.scored_pairs(labels, edges), "left_run right_run pixels:i support:m")


def _boundaries(spark, d):
    """Labels and their boundary pixels as tables, read by each of the parts."""
    labels = stage(_labels(spark, d), "labels")
    return labels, stage(boundary.boundary_pixels(labels), "edges")


def _ensemble(spark, d):
    labels, edges = _boundaries(spark, d)
    return boundary.ensemble_rank(labels, edges, segments.run_summary(segments.segment_sizes(labels)))


_ROBUST = "greatest(0.0, least(1.0, m - 1.4826 * mad))"
_ENSEMBLE = f"""scored as (select * from pair join pair_score using (left_run, right_run, reach)),
x as (select spatialr, pair_class as part, support as v from scored where pair_class != 'factorial_cross' union all select spatialr, 'scale_match', scale_match from match),
both_ as (select spatialr, left_run as run_id, support as v from scored union all select spatialr, right_run, support from scored),
mid as (select spatialr, run_id from (select *, row_number() over (partition by spatialr order by floor(mean * 1e9 + 0.5) * -1, run_id) as i from (select spatialr, run_id, avg(v) as mean from both_ group by 1, 2)) where i = 1),
step as (select spatialr as s, lead(spatialr) over (order by spatialr) as t, run_id as a, lead(run_id) over (order by spatialr) as b from mid),
step2 as (select s, t, a, b, sqrt(s * t) as reach from step where t is not null),
sd2 as (select a as own, b as other, s, reach from step2 union all select b, a, s, reach from step2),
near_step as (select s, any_value(t) as t, sum(pts) as pts, sum(n) as n from (select sd2.s, sum(cast(floor(greatest(0.0, 1 - sqrt(coalesce(d2, 1e18)) / reach) * 1e9 + 0.5) as bigint)) as pts, count(*) as n from sd2 join edge e on e.run_id = own left join near nb on nb.run_id = other and nb.r = e.r and nb.c = e.c group by 1, own) g join step2 using (s) group by 1),
x2 as (select * from x union all select unnest([s, t]), 'radius', pts / 1e9 / n from near_step),
m1 as (select *, median(v) over (partition by spatialr, part) as m from x2),
rob as (select spatialr, part, {_ROBUST} as r from (select spatialr, part, any_value(m) as m, median(abs(v - m)) as mad from m1 group by 1, 2)),
wide as (select spatialr, max(r) filter (part = 'seed_realization') as seed_realization, max(r) filter (part = 'ranger') as ranger, max(r) filter (part = 'radius') as radius, max(r) filter (part = 'scale_match') as scale_match from rob group by 1),
ranked as (select *, row_number() over (order by score desc, spatialr) as rank from (select wide.*, run_id as medoid_run, coalesce(pow(seed_realization * ranger * radius * scale_match, 0.25), 0) as score from wide join mid using (spatialr)))"""


@query(sql("pair match near pair_in pair_score", ", " + _ENSEMBLE + " select cast(spatialr as bigint) as spatialr, medoid_run, " + ", ".join(micro(c, c) for c in ("seed_realization", "ranger", "radius", "scale_match", "score")) + ", rank from ranked", pair_in=_PAIR_IN))
def ensemble_rank(spark, d):
    return out(_ensemble(spark, d), "spatialr:i medoid_run seed_realization:m ranger:m radius:m scale_match:m score:m rank:i")


@query(sql("pair match near pair_in pair_score", ", " + _ENSEMBLE + ", st as (select *, dense_rank() over (order by spatialr) as step from ranked), p as (select max(spatialr) filter (rank = 1) as f, max(spatialr) filter (rank = 2) as s, max(step) filter (rank = 1) as a, max(step) filter (rank = 2) as b, max(step) as top from st) select cast(f as bigint) as first, cast(s as bigint) as second, cast(least(f, s) as bigint) as lower, cast(greatest(f, s) as bigint) as upper, abs(a - b) = 1 as adjacent, greatest(abs(a - b) - 1, 0) as between, case when a = top then 'upper' when a = 1 then 'lower' else 'inside' end as boundary_side from p".replace("as between,", 'as "between",'), pair_in=_PAIR_IN))
def scale_gate(spark, d):
    return out(boundary.scale_gate(_ensemble(spark, d)), "first:i second:i lower:i upper:i adjacent between:i boundary_side")


@query(
    "select k, " + micro("gain_share", "gain_share") + ", case when gain_share > 0.5 then 'midpoint' else 'first' end as handoff, gain_share is null as warning"
    " from (select k, case when s1 > s2 then (sm - s2) / (s1 - s2) end as gain_share"
    " from (select c_custkey as k, cast(c_acctbal as double) as s1, cast(c_nationkey * 100 as double) as s2, cast(c_custkey % 11 * 500 as double) as sm from customer))"
)
def gain_share(spark, d):
    """Every customer as a trial: its balance as the best score, two more scores from its keys."""
    k = F.col("c_custkey")
    rows = adapters.table(spark, d, "customer").select(k.alias("k"), F.col("c_acctbal").cast("double").alias("s1"), (F.col("c_nationkey") * 100).cast("double").alias("s2"), (k % 11 * 500).cast("double").alias("sm"))
    return out(boundary.gain_share(rows), "k gain_share:m handoff warning")


def _variogram(spark, d):
    return prescreen.variogram(_cells(spark, d), LAGS)


def _curve(spark, d):
    return prescreen.variogram_curve(_variogram(spark, d))


@query(sql("vario", want("lag:i direction:i pairs:i semivariance:m", "vario")))
def variogram(spark, d):
    return out(_variogram(spark, d), "lag:i direction:i pairs:i semivariance:m")


@query(sql("sill", want("sill:m relative_span:m", "sill")))
def variogram_sill(spark, d):
    return out(prescreen.sill(_curve(spark, d)), "sill:m relative_span:m")


@query(sql("sill", ", w as (select lag, min(semivariance) over f as low, count(*) over f as n from curve window f as (order by lag rows between current row and 1 following)) select t as target, cast(min(lag) filter (low >= t * sill and n = 2) as bigint) as lag from w cross join sill cross join (values (0.25::double), (0.5), (0.75), (0.95)) x(t) group by 1"))
def sill_crossings(spark, d):
    curve = _curve(spark, d)
    return out(prescreen.sill_crossings(curve, prescreen.sill(curve), [0.25, 0.5, 0.75, 0.95]), "target lag:i")


@query(sql("curve", "select cast(lag as bigint) as lag, " + micro("semivariance", "semivariance") + ", " + micro("above", "above") + " from (select *, (semivariance - min(semivariance) over ()) / (max(semivariance) over () - min(semivariance) over ()) - (ln(lag) - min(ln(lag)) over ()) / (max(ln(lag)) over () - min(ln(lag)) over ()) as above from curve) order by above desc, lag limit 1"))
def variogram_knee(spark, d):
    return out(prescreen.knee(_curve(spark, d)), "lag:i semivariance:m above:m")


@query(sql("vario", """, tail as (select *, row_number() over (partition by direction order by lag desc) as i, count(*) over (partition by direction) as n from vario), s as (select direction, median(semivariance) as sill from tail where i <= greatest(2, ceil(n * 0.25)) group by 1),
w as (select direction, lag, min(semivariance) over f as low, count(*) over f as n from vario window f as (partition by direction order by lag rows between current row and 1 following)),
x as (select direction, min(lag) filter (low >= 0.95::double * sill and n = 2) as lag from w join s using (direction) group by 1)
select count(lag) as directions, cast(min(lag) as bigint) as least, cast(max(lag) as bigint) as greatest, """ + micro("max(lag) / min(lag)", "ratio") + " from x".replace("as least", 'as "least"')))
def variogram_anisotropy(spark, d):
    return out(prescreen.anisotropy(_variogram(spark, d)), "directions:i least:i greatest:i ratio:m")


_KNN = "knn as (select a.vec_id, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))), b.vec_id) as k, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as distance from embeddings a join embeddings b on a.vec_id != b.vec_id)"


def _knn(spark, d):
    return prescreen.knn_distances(adapters.vectors(spark, d), KS)


@query(f"with {_KNN} select vec_id, k, {micro('distance', 'distance')} from knn where k in (2, 4, 8, 16, 32)")
def knn_distances(spark, d):
    return out(_knn(spark, d), "vec_id:i k:i distance:m")


@query()
def hsm_plateau(spark, d):
    return out(prescreen.plateau(prescreen.modes_by_k(_knn(spark, d))), "k:i first_k:i last_k:i mode:m low:m high:m span:m fallback")


@query()
def ranger_levels(spark, d):
    return out(prescreen.ranger_levels(prescreen.plateau(prescreen.modes_by_k(_knn(spark, d)))), "level:i position ranger:m is_baseline")


@query(sql("pixel_obs", "select variant_id, count(*) as n, count(*) filter ((b1 != 0 or b2 != 0 or b3 != 0) and (b1 != 49 or b2 != 100 or b3 != 80)) as valid from pixel_obs group by 1"))
def valid_mask(spark, d):
    masked = features.valid_mask(_obs(spark, d), ((0.0, 0.0, 0.0), (49.0, 100.0, 80.0)))
    return masked.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"))


@query(sql("cell", "select cast(r as bigint) as r, cast(c as bigint) as c, " + ", ".join(micro(x, n) for x, n in (("2 * m2 - m1 - m3", "exg"), ("1.4::double * m1 - m3", "exr"), ("2 * m2 - m1 - m3 - (1.4::double * m1 - m3)", "exgr"), ("(m1 + m2 + m3) / 3", "bri"))) + " from cell"))
def rgb_indices(spark, d):
    return out(features.colour_indices(_cells(spark, d), BANDS), "r:i c:i exg:m exr:m exgr:m bri:m")


@query(sql("cell", ", q as (" + " union all ".join(f"select '{b}' as band, quantile_cont({b}, 0.02) as lo, quantile_cont({b}, 0.98) as hi from cell" for b in BANDS) + ") select band, " + ", ".join(micro(x, n) for x, n in (("lo", "low"), ("hi", "high"), ("(lo + hi) / 2", "centre"), ("(hi - lo) / 2", "scale"))) + " from q"))
def quantile_parameters(spark, d):
    return out(features.quantile_parameters(_cells(spark, d), BANDS), "band low:m high:m centre:m scale:m")


@query(sql("cell", ", q as (select " + ", ".join(f"quantile_cont({b}, 0.02) as {b}_lo, quantile_cont({b}, 0.98) as {b}_hi" for b in BANDS) + " from cell) select cast(r as bigint) as r, cast(c as bigint) as c, " + ", ".join(micro(f"greatest(-1.0, least(1.0, ({b} - ({b}_lo + {b}_hi) / 2) / (({b}_hi - {b}_lo) / 2)))", b) for b in BANDS) + " from cell cross join q"))
def quantile_scaling(spark, d):
    return out(features.quantile_scaled(_cells(spark, d), BANDS), "r:i c:i m1:m m2:m m3:m")


@query(sql("cell", """, lv as (select r, c, cast(floor(greatest(0.0, least(0.999999, m1 / 50)) * 32) as int) as q from cell), st as (select * from (values (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) x(k, dr, dc)),
pr as (select k, b.r, b.c, (a.q - b.q) * (a.q - b.q) as d from lv a cross join st join lv b on b.r = a.r + dr and b.c = a.c + dc),
bx as (select k, l.r, l.c, sum(d) / count(*) as inertia from lv l join pr p on p.r between l.r - 2 and l.r + 2 and p.c between l.c - 2 and l.c + 2 group by 1, 2, 3)
select cast(r as bigint) as r, cast(c as bigint) as c, """ + micro("max(inertia)", "inertia") + " from bx group by 1, 2"))
def directional_inertia(spark, d):
    return out(features.directional_inertia(_cells(spark, d), "m1", 2), "r:i c:i inertia:m")


@query(sql("cell", "select cast(a.r as bigint) as r, cast(a.c as bigint) as c, " + micro("greatest(0, " + " + ".join(f"sum(b.{b} * b.{b}) / count(*) - pow(sum(b.{b}) / count(*), 2)" for b in BANDS) + ")", "variance") + " from cell a join cell b on b.r between a.r - 2 and a.r + 2 and b.c between a.c - 2 and a.c + 2 group by a.r, a.c"))
def local_variance(spark, d):
    return out(features.local_variance(_cells(spark, d), BANDS, 2), "r:i c:i variance:m")


@query()
def pc1(spark, d):
    return out(features.first_component(_cells(spark, d)), "r:i c:i pc1:m")


def _sorties(spark, d):
    return flight.sorties(adapters.position(spark, d), 300)


@query(sql("sortie", "select image_id, cast(sortie as bigint) as sortie from sortie"))
def sorties(spark, d):
    return out(_sorties(spark, d), "image_id:i sortie:i")


@query(sql("sortie", "select cast(sortie as bigint) as sortie, count(*) as images, " + "cast(floor(case when sqrt(sum(cos(radians(yaw * 2))) ** 2 + sum(sin(radians(yaw * 2))) ** 2) / count(*) > 1e-6 then degrees(atan2(sum(sin(radians(yaw * 2))), sum(cos(radians(yaw * 2))))) / 2 + 180 end * 1e6 + 0.5) as bigint) % 180000000 as axis from sortie group by 1 having count(*) > 1"))
def flight_axis(spark, d):
    axis = flight.dominant_axis(_sorties(spark, d), "sortie").where("images > 1")
    # 0 and 180 degrees are one axis
    return out(axis.withColumn("axis", F.when(F.col("strength") > 1e-6, exprs.micro(F.col("axis") + 180) % 180_000_000)), "sortie:i images:i axis:i")


@query(sql("line", "select image_id, cast(sortie as bigint) as sortie, cast(line as bigint) as line, cast(direction as bigint) as direction from line"))
def flight_lines(spark, d):
    return out(flight.flight_lines(_sorties(spark, d), 45.0, 60.0), "image_id:i sortie:i line:i direction:i")


def _windows(spark, d):
    lines = flight.flight_lines(_sorties(spark, d), 45.0, 60.0)
    return flight.centred_windows(flight.local_metres(lines, 45.0), 3)


@query()
def centred_windows(spark, d):
    return out(_windows(spark, d), "sortie:i line:i first_image:i last_image:i mid:k far:k span:k cross_m:k along_m:k radial:k")


@query()
def grid_block(spark, d):
    return out(flight.grid_block(_windows(spark, d), 2), "sortie:i first_line:i last_line:i centre:k farthest:k cross_centre:k along_centre:k")


METRICS = ["n_rows", "quantity", "top_cents"]


@query(sql("metric", ", e as (select metric, flag, max(value) filter (state = 'O') - max(value) filter (state = 'F') as diff, sum(abs(value)) as size, count(*) as n from metric group by 1, 2 having count(*) = 2) select 'state' as factor, metric, count(*) as pairs, " + ", ".join(micro(x, n) for x, n in (("avg(diff)", "mean_difference"), ("stddev_samp(diff)", "sd"), ("stddev_samp(diff) / sqrt(count(*))", "se"), ("avg(diff) - 4.30265273 * stddev_samp(diff) / sqrt(count(*))", "ci_low"), ("100 * avg(diff) / (sum(size) / sum(n))", "relative_percent"))) + " from e group by metric"))
def factor_effects(spark, d):
    return out(study.factor_effects(adapters.design(spark, d), "state", ["flag"], METRICS), "factor metric pairs:i mean_difference:m sd:m se:m ci_low:m relative_percent:m")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COLS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(" union all ".join(f"select '{a}' as left_metric, '{b}' as right_metric, count(*) as n, {micro(f'corr({a}, {b})', 'r')} from lineitem" for a, b in _COLS))
def corr_pearson(spark, d):
    return out(study.correlations(adapters.table(spark, d, "lineitem").select(*_NUM), _NUM), "left_metric right_metric n:i r:m")


@query("with k as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in _NUM) + " from lineitem) " + " union all ".join(f"select '{a}' as left_metric, '{b}' as right_metric, count(*) as n, {micro(f'corr({a}, {b})', 'r')} from k" for a, b in _COLS))
def corr_spearman(spark, d):
    return out(study.correlations(adapters.table(spark, d, "lineitem").select(*_NUM), _NUM, "spearman"), "left_metric right_metric n:i r:m")


@query("with m as (" + " union all ".join(f"select l_returnflag as flag, '{c}' as metric, {c} as value from lineitem" for c in _NUM) + "), d as (select *, median(value) over (partition by flag, metric) as med from m) select flag, metric, count(*) as n, " + ", ".join(micro(x, n) for x, n in (("avg(value)", "mean"), ("stddev_samp(value)", "sd"), ("any_value(med)", "median"), ("median(abs(value - med))", "mad"), ("min(value)", "min"), ("max(value)", "max"), ("max(value) - min(value)", "range"), ("100 * stddev_samp(value) / avg(value)", "cv_percent"))) + " from d group by 1, 2")
def numeric_summary(spark, d):
    rows = adapters.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), *_NUM)
    return out(study.numeric_summary(rows, ["flag"], _NUM), "flag metric n:i mean:m sd:m median:m mad:m min:m max:m range:m cv_percent:m")


@query(sql("metric", "select m.flag, m.state, m.metric, " + ", ".join(micro(x, n) for x, n in (("b.value", "base"), ("m.value", "value"), ("m.value - b.value", "change"), ("100 * (m.value - b.value) / abs(b.value)", "relative_percent"))) + " from metric m join metric b on b.metric = m.metric and b.flag = 'A' and b.state = 'F' where not (m.flag = 'A' and m.state = 'F')"))
def change_from_baseline(spark, d):
    return out(study.change_from_baseline(adapters.design(spark, d), ["flag", "state"], METRICS, (F.col("flag") == "A") & (F.col("state") == "F")), "flag state metric base:m value:m change:m relative_percent:m")


@query(sql("design", " union all ".join(f"select '{m}' as metric, '{x}' as direction, k as flag_state, {micro('v', 'value')} from (select flag || state as k, {m} as v from design order by v {'desc' if x == 'max' else 'asc'}, k limit 1)" for m, x in (("n_rows", "min"), ("quantity", "max"), ("top_cents", "max")))))
def metric_extrema(spark, d):
    rows = adapters.design(spark, d).withColumn("flag_state", F.concat("flag", "state"))
    return out(study.metric_extrema(rows, "flag_state", {"n_rows": "min", "quantity": "max", "top_cents": "max"}), "metric direction flag_state value:m")


@query(sql("ct", ", p as (select (select sum(n * (n - 1) / 2) from ct) as both_, (select sum(n * (n - 1) / 2) from (select sum(n) as n from ct group by a)) as l, (select sum(n * (n - 1) / 2) from (select sum(n) as n from ct group by b)) as r, (select sum(n) from ct) as items) select cast(items as bigint) as items, " + micro("(both_ - l * r / (items * (items - 1) / 2)) / ((l + r) / 2 - l * r / (items * (items - 1) / 2))", "ari") + " from p"))
def ari(spark, d):
    return out(partitions.adjusted_rand(adapters.contingency(spark, d)), "items:i ari:m")


@query(sql("ct", ", x as (select *, sum(n) over (partition by a) as ln, sum(n) over (partition by b) as rn, row_number() over (partition by a order by n desc, b) as i from ct) select a, b, n, " + micro("n / ln", "left_share") + ", " + micro("n / rn", "right_share") + " from x where i = 1"))
def best_overlaps(spark, d):
    return out(partitions.best_overlaps(adapters.contingency(spark, d)), "a b n:i left_share:m right_share:m")


@query(sql("segment", "select run_id, count(*) as segments, " + ", ".join(micro(f"quantile_cont(pixels, {p})", f"p{n}") for p, n in ((0.25, 25), (0.5, 50), (0.75, 75))) + ", " + ", ".join(micro(f"avg((pixels < {n})::int::double)", f"below_{n}") for n in (2, 5, 10, 20)) + " from segment group by 1"))
def label_size_stats(spark, d):
    return out(segments.label_size_stats(_segments(spark, d)), "run_id segments:i p25:m p50:m p75:m below_2:m below_5:m below_10:m below_20:m")


@query(sql("label_px", ", x as (select run_id, label, band, value from (select run_id, label, m1, m2, m3 from label_px join cell using (r, c) where label > 0) unpivot (value for band in (m1, m2, m3))) select run_id, label, band, count(*) as n, " + ", ".join(micro(e, n) for e, n in (("avg(value)", "mean"), ("median(value)", "median"), ("min(value)", "min"), ("max(value)", "max"), *((f"quantile_cont(value, {p / 100})", f"q{p:02d}") for p in (5, 10, 25, 50, 75, 90, 95)), ("var_pop(value)", "variance"), ("stddev_pop(value)", "stdev"))) + " from x group by 1, 2, 3"))
def zonal_stats(spark, d):
    cells = stage(_cells(spark, d), "cells")  # read as the cells of the labels and as their features
    return out(segments.zonal_stats(adapters.label_px(cells), cells), "run_id label:i band n:i mean:m median:m min:m max:m q05:m q10:m q25:m q50:m q75:m q90:m q95:m variance:m stdev:m")


def _lattice(spark, d):
    side = adapters.grid_side(spark, d)
    return seeds.hex_lattice(spark, side, side, 3.0)


def _seeds(spark, d, cells=None):
    cells = stage(_cells(spark, d), "cells") if cells is None else cells  # read for the sums and for the places
    surface = features.local_variance(cells, BANDS, 2)
    moved = seeds.snap_to_minimum(_lattice(spark, d), surface, "variance", 1.35)
    return seeds.accept_in_order(moved.withColumnRenamed("index", "rank"), 9)


@query()
def hex_seeds(spark, d):
    return out(_lattice(spark, d), "index:i r:i c:i")


@query()
def seed_mis(spark, d):
    return out(_seeds(spark, d), "rank:i r:i c:i")


@query()
def seed_coverage(spark, d):
    cells = stage(_cells(spark, d), "cells")  # read for the surface and for both distances
    whole = stage(seeds.complete_coverage(cells, _seeds(spark, d, cells), 6), "covering")
    return out(seeds.coverage_summary(stage(seeds.nearest_seed(cells, whole), "covered"), 6.0), "cells:i p50:m p95:m p99:m max:m within:i")


def _peaks(spark, d):
    cells = stage(_cells(spark, d), "cells")
    points = stage(seeds.centroids(adapters.label_px(cells)), "centroids")  # a row a segment; the ensemble is read once
    return seeds.peak_support(seeds.density_peaks(points, cells, 2), points, 3.0)


@query(sql("label_px", "select run_id, label, " + micro("avg(r)", "y") + ", " + micro("avg(c)", "x") + " from label_px where label > 0 group by 1, 2"))
def label_centroids(spark, d):
    return out(seeds.centroids(_labels(spark, d)), "run_id label:i y:m x:m")


@query()
def density_peaks(spark, d):
    return out(_peaks(spark, d), "spatialr:i r:i c:i density:i runs:i phases:i rangers:i")


@query()
def centroid_tracks(spark, d):
    peaks = _peaks(spark, d).where("runs >= 2")
    step = F.when(F.col("spatialr") == 4, 0).when(F.col("spatialr") == 6, 1).otherwise(2)
    nodes = peaks.withColumns({"step": step, "node": (F.col("spatialr") * 1_000_000_000_000 + F.col("r") * 1_000_000 + F.col("c")).cast("long")})
    return out(seeds.scale_tracks(nodes.select("node", "step", "r", "c"), 4.0), "node:i step:i r:i c:i track:i scales:i")


@query()
def region_merge(spark, d):
    cells = stage(_cells(spark, d), "cells")
    first = stage(regions.initial_regions(cells, BANDS, 4, 12.0), "initial")  # read by every pass
    return out(regions.merge_regions(first, BANDS, 18.0, 6.0), "r:i c:i region:i")


@query()
def region_growing(spark, d):
    cells = stage(_cells(spark, d), "cells")  # read for the seeds, the forest and the result
    return out(regions.grow_regions(cells, _seeds(spark, d, cells), BANDS), "r:i c:i label:i")


@query()
def patch_radii(spark, d):
    cells = _cells(spark, d).withColumns({"cell": (F.col("r") * 1_000_000 + F.col("c")).cast("long"), "side": (F.col("m1") > 25).cast("int")})
    return out(regions.patch_radii(cells.select("cell", "r", "c", "side"), ["side"]), "patches:i p25:m p50:m p75:m")


@query("select count(*) as groups, cast(max(n) as bigint) as largest from (select l_tax, count(*) as n from lineitem group by 1)")
def resolution_groups(spark, d):
    headers = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("raster_id"), F.col("l_tax").alias("xres"), F.col("l_tax").alias("yres"))
    return checks.resolution_groups(headers).agg(F.count(F.lit(1)).alias("groups"), F.max("rasters").cast("long").alias("largest"))


@query(sql("pair match near pair_in pair_score", ", " + _ENSEMBLE + " select count(*) as candidates, cast(0 as bigint) as mismatches, count(*) filter (score < -1e-9 or score > 1 + 1e-9) as outside from ranked", pair_in=_PAIR_IN))
def rank_check(spark, d):
    return checks.rank_check(_ensemble(spark, d), "score", "rank", "spatialr")


@query(sql("segment", ", x as (select distinct run_id, pixels from segment), b as (select run_id, pixels, ln(lead(pixels) over w) - 2 * ln(pixels) + ln(lag(pixels) over w) as bend from x window w as (partition by run_id order by pixels)) select run_id, cast(pixels as bigint) as pixels, " + micro("bend", "bend") + " from (select *, row_number() over (partition by run_id order by floor(bend * 1e9 + 0.5) desc, pixels) as i from b where bend is not null) where i = 1"))
def knee_cutoff(spark, d):
    return out(checks.knee_cutoff(_segments(spark, d), "pixels", ("run_id",)), "run_id pixels:i bend:m")


@query(
    "select id as candidate_id, s + a as spatialr, greatest(1, m + c * 5) as minsize, " + micro("r + b * 0.1::double", "ranger") + ", max(a = 0 and b = 0 and c = 0) as is_baseline"
    " from (select p_partkey as id, cast(p_size as int) as s, (p_partkey % 40 + 10) / 10.0::double as r, cast(p_partkey % 30 + 1 as int) as m from part)"
    " cross join (values (-1), (0), (1)) i(a) cross join (values (-1), (0), (1)) j(b) cross join (values (-1), (0), (1)) k(c) where s + a > 0 group by id, s + a, greatest(1, m + c * 5), r + b * 0.1::double"
)
def perturbation_grid(spark, d):
    """The grid around a candidate for each part."""
    k = F.col("p_partkey")
    base = adapters.table(spark, d, "part").select(k.alias("candidate_id"), F.col("p_size").cast("int").alias("spatialr"), ((k % 40 + 10) / 10).alias("ranger"), (k % 30 + 1).cast("int").alias("minsize"))
    return out(checks.one_baseline(checks.perturbation_grid(base, 0.1, 5, 1)), "candidate_id spatialr minsize ranger:m is_baseline")


@query("with x as (select l_returnflag as flag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem) select flag, n, " + micro("greatest(1000.0, v)", "threshold") + " from x where i = least(floor(n * (1 - 10 / 100)), n - 1)")
def percentile_cut(spark, d):
    points = adapters.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return out(checks.percentile_cut(points, "l_extendedprice", 10.0, 1000.0, ("flag",)), "flag n:i threshold:m")


@query(sql("label_px", """, t as (select a.spatialr, a.run_id as l, b.run_id as r, a.label as x, b.label as y, count(*) as n from label_px a join label_px b on a.spatialr = b.spatialr and a.r = b.r and a.c = b.c and a.run_id < b.run_id where a.label > 0 and b.label > 0 group by all),
p as (select spatialr, l, r, sum(n) as items, sum(n * (n - 1) / 2) as both_ from t group by all), a as (select l, r, sum(n * (n - 1) / 2) as s from (select l, r, x, sum(n) as n from t group by all) group by all), b as (select l, r, sum(n * (n - 1) / 2) as s from (select l, r, y, sum(n) as n from t group by all) group by all),
q as (select spatialr, (both_ - a.s * b.s / (items * (items - 1) / 2)) / ((a.s + b.s) / 2 - a.s * b.s / (items * (items - 1) / 2)) as ari from p join a using (l, r) join b using (l, r))
select cast(spatialr as bigint) as spatialr, count(*) as pairs, """ + micro("avg(ari)", "mean") + ", " + micro("stddev_samp(ari)", "sd") + " from q group by 1"))
def ari_stability(spark, d):
    return out(partitions.ari_stability(_labels(spark, d)), "spatialr:i pairs:i mean:m sd:m")


@query("with m as (" + " union all ".join(f"select l_returnflag as flag, '{c}' as metric, {c} as value from lineitem" for c in _NUM) + ") select flag, metric, count(*) as n, " + ", ".join(micro(x, n) for x, n in (("avg(value)", "mean"), ("median(value)", "median"), ("min(value)", "min"), ("max(value)", "max"), ("quantile_cont(value, 0.05)", "p05"), ("quantile_cont(value, 0.95)", "p95"), ("stddev_pop(value)", "sd"))) + " from m group by 1, 2")
def distribution_table(spark, d):
    rows = adapters.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), *_NUM)
    return out(study.distribution_table(rows, "flag", _NUM), "flag metric n:i mean:m median:m min:m max:m p05:m p95:m sd:m")


@query(sql("design", ", x as (select flag, state, quantity, row_number() over (partition by flag order by quantity desc, state) as i from design) select flag, max(state) filter (i = 1) as first, max(state) filter (i = 2) as second, " + micro("max(quantity) filter (i = 1) - max(quantity) filter (i = 2)", "gap") + " from x group by 1".replace("as first,", 'as "first",')))
def top_two(spark, d):
    return out(study.top_two(adapters.design(spark, d), ["flag"], "quantity", "state"), "flag first second gap:m")


@query(sql("cell", ", p as (select event_id as point_id, (event_id % (10 * side - 20)) / 10 as y, (event_id % (10 * side - 30)) / 10 as x from events cross join grid), k as (select point_id, cast(floor(y) + a as int) as r, cast(floor(x) + b as int) as c, ((1 - a) + (2 * a - 1) * (y - floor(y))) * ((1 - b) + (2 * b - 1) * (x - floor(x))) as w from p, (values (0), (1)) i(a), (values (0), (1)) j(b)) select point_id, " + micro("case when count(*) = count(m1) then sum(w * m1) end", "m1") + " from k left join cell using (r, c) where w > 0 group by 1"))
def bilinear(spark, d):
    side = adapters.grid_side(spark, d)
    points = adapters.table(spark, d, "events").select(F.col("event_id").alias("point_id"), ((F.col("event_id") % (10 * side - 20)) / 10).alias("y"), ((F.col("event_id") % (10 * side - 30)) / 10).alias("x"))
    return out(checks.bilinear(points, _cells(spark, d), "m1"), "point_id:i m1:m")


@query()
def valid_seeds(spark, d):
    cells = stage(_cells(spark, d), "cells")
    return out(checks.snap_to_valid(_seeds(spark, d, cells), cells.where("m1 > 30")), "rank:i r:i c:i")


from mosaiq.plans import grid_queries, more_queries  # noqa: E402, F401  (they register their queries)
