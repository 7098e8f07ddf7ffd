"""The adapter views in SQL, as common table expressions that the oracles begin with."""

CTE = {
    "grid": "select greatest(8, cast(floor(sqrt(count(*) / 25)) as int)) as side from lineitem",
    "pixel_obs": """select l_returnflag || l_linestatus as variant_id, cast((l_linenumber - 1) % 3 + 1 as int) as replicate,
  cast(l_orderkey % side as int) as r, cast(l_partkey % side as int) as c, min(l_quantity - 1) as b1,
  min(cast(floor(l_discount * 1000 + 0.5) as double)) as b2, min(cast(floor(l_tax * 1000 + 0.5) as double)) as b3
  from lineitem cross join grid group by 1, 2, 3, 4""",
    "obs": "select * from pixel_obs where not (b1 = 0 and b2 = 0 and b3 = 0)",
    "med": "select variant_id, r, c, count(*) as valid_count, median(b1) as m1, median(b2) as m2, median(b3) as m3 from obs group by 1, 2, 3",
    "pixels": """select o.variant_id, o.r, o.c, any_value(valid_count) as valid_count, any_value(m1) as med_b1, any_value(m2) as med_b2, any_value(m3) as med_b3,
  (median(abs(b1 - m1)) + median(abs(b2 - m2)) + median(abs(b3 - m3))) / 3 as mad,
  sqrt(sum((b1 - m1) * (b1 - m1) + (b2 - m2) * (b2 - m2) + (b3 - m3) * (b3 - m3)) / (count(*) * 3)) as rmse
  from obs o join med using (variant_id, r, c) group by 1, 2, 3""",
    "summary": """select variant_id, count(*) as any_support, count(*) filter (valid_count = 3) as full_support, sum(valid_count) as observations,
  case when count(*) < (select side * side from grid) then 0 else min(valid_count) end as min_valid_count, max(valid_count) as max_valid_count,
  avg(mad) as mean_mad, quantile_cont(mad, 0.95) as p95_mad, avg(rmse) as mean_rmse, quantile_cont(rmse, 0.95) as p95_rmse,
  count(*) filter (valid_count = 3 and rmse <= 15) as stable_pixels, count(*) filter (valid_count = 3 and not rmse <= 15) as unstable_pixels,
  (count(*) - count(*) filter (valid_count = 3)) / count(*) as dropout, count(*) filter (valid_count = 3) / count(*) as persistence,
  (count(*) - count(*) filter (valid_count = 3)) / (select side * side from grid) as variable_support_fraction,
  case when count(*) filter (valid_count = 3) > 0 then count(*) filter (valid_count = 3 and rmse <= 15) / count(*) filter (valid_count = 3) end as stable_fraction,
  case when count(*) filter (valid_count = 3) > 0 then count(*) filter (valid_count = 3 and not rmse <= 15) / count(*) filter (valid_count = 3) end as unstable_fraction
  from pixels group by 1""",
    "review": """select t as threshold, variant_id, count(*) filter (rmse <= t) as stable_pixels, count(*) filter (not rmse <= t) as unstable_pixels,
  case when count(*) > 0 then count(*) filter (rmse <= t) / count(*) end as stable_fraction, case when count(*) > 0 then count(*) filter (not rmse <= t) / count(*) end as unstable_fraction
  from (select distinct variant_id from pixels) v cross join (values (5.0::double), (10.0), (15.0), (20.0), (25.0)) x(t) left join (select * from pixels where valid_count = 3) p using (variant_id) group by 1, 2""",
    "attempt": """select o_orderpriority as variant_id, 'rep_' || cast(o_custkey % 5 as varchar) as replicate,
  case o_orderstatus when 'F' then 'ok' when 'O' then 'ok_no_ortho' else 'failed' end as status, o_orderkey as attempt_seq from orders""",
    "cell": "select r, c, median(b1) as m1, median(b2) as m2, median(b3) as m3 from obs group by 1, 2",
    "label_px": """select 's' || s || '_g' || g || '_p' || p as run_id, cast(s as int) as spatialr, cast(g as int) as ranger, cast(p as int) as phase, r, c,
  cast(floor((r + (p % 2) * 0.5 * s) / s) * 2000000 + floor((c + floor(p / 2) * 0.5 * s) / s) * 2 + case when m1 > 15 + 5 * g then 1 else 0 end + 1 as bigint) as label
  from cell cross join (values (4), (6), (9)) a(s) cross join (values (1), (2), (3)) b(g) cross join (values (0), (1), (2), (3)) d(p)""",
    "segment": """select *, sqrt(area / pi()) as radius, sqrt(area / pi()) / spatialr as q from (
  select run_id, spatialr, ranger, phase, label, count(*) as pixels, cast(count(*) as double) as area from label_px where label > 0 group by all)""",
    "seg": """select *, case when q < 0.25 then 'micro' when q < 0.5 then 'small' when q <= 2 then 'in_scale' when q <= 4 then 'large' else 'oversize' end as size_class from segment""",
    "classes": "select * from (values (1, 'micro'), (2, 'small'), (3, 'in_scale'), (4, 'large'), (5, 'oversize')) x(k, size_class)",
    "share": """select run_id, spatialr, k, size_class, count(label) as segments, coalesce(sum(area), 0) as area, coalesce(sum(area), 0) / any_value(total) as share
  from (select run_id, spatialr, sum(area) as total from seg group by 1, 2) r cross join classes left join seg using (run_id, spatialr, size_class) group by 1, 2, 3, 4""",
    "hist": """select run_id, spatialr, k, coalesce(sum(area) filter (q >= lo and q < hi), 0) / sum(area) as h from seg
  cross join (values (0, 0.0, 0.25), (1, 0.25, 0.5), (2, 0.5, 1.0), (3, 1.0, 2.0), (4, 2.0, 4.0), (5, 4.0, 8.0), (6, 8.0, 1e300)) b(k, lo, hi) group by 1, 2, 3""",
    "wq": "select run_id, spatialr, " + ", ".join(f"coalesce(min(q) filter (cdf >= {p / 100}), max(q)) as q{p}" for p in (10, 25, 50, 75, 90, 95)) + """ from (
  select run_id, spatialr, q, sum(w) over (partition by run_id order by q rows unbounded preceding) / sum(w) over (partition by run_id) as cdf from (select run_id, spatialr, q, sum(area) as w from seg group by 1, 2, 3)) group by 1, 2""",
    "tails": """select run_id, spatialr, sum(share) filter (k <= 2) as low, sum(share) filter (k = 3) as mid, sum(share) filter (k >= 4) as up, arg_max(size_class, struct_pack(s := share, k := -k)) as dominant from share group by 1, 2""",
    "match": "select run_id, spatialr, sum(area * least(q, 1 / q)) / sum(area) as scale_match from seg where q > 0 group by 1, 2",
    "cum": "select run_id, spatialr, k, share, sum(share) over (partition by run_id order by k rows unbounded preceding) as cum from share",
    "dist": """select a.spatialr, a.run_id as left_run, b.run_id as right_run, ordinal, histogram, abs(ta.low - tb.low) + abs(ta.mid - tb.mid) + abs(ta.up - tb.up) as tail,
  abs(wa.q50 - wb.q50) + abs(wa.q75 - wb.q75) + abs(wa.q90 - wb.q90) + abs(wa.q95 - wb.q95) as radius
  from (select distinct run_id, spatialr from share) a join (select distinct run_id, spatialr from share) b on a.spatialr = b.spatialr and a.run_id < b.run_id
  join (select x.run_id as l, y.run_id as r, sum(abs(x.cum - y.cum)) as ordinal from cum x join cum y on x.spatialr = y.spatialr and x.k = y.k and x.run_id < y.run_id group by 1, 2) o on o.l = a.run_id and o.r = b.run_id
  join (select x.run_id as l, y.run_id as r, sum(abs(x.h - y.h)) as histogram from hist x join hist y on x.spatialr = y.spatialr and x.k = y.k and x.run_id < y.run_id group by 1, 2) h on h.l = a.run_id and h.r = b.run_id
  join tails ta on ta.run_id = a.run_id join tails tb on tb.run_id = b.run_id join wq wa on wa.run_id = a.run_id join wq wb on wb.run_id = b.run_id""",
    "matrix": """select *, case when mid >= low and mid >= up then 'central' when low >= up then 'lower' else 'upper' end as tail,
  case greatest(s1, s2, s3, s4, s5) when s1 then 'micro' when s2 then 'small' when s3 then 'in_scale' when s4 then 'large' else 'oversize' end as dominant_class from (select *, s1 + s2 as low, s3 as mid, s4 + s5 as up from (
  select run_id, spatialr, floor(r / 8) as cell_row, floor(c / 8) as cell_col, count(*) as pixels, avg((size_class = 'micro')::int::double) as s1, avg((size_class = 'small')::int::double) as s2, avg((size_class = 'in_scale')::int::double) as s3, avg((size_class = 'large')::int::double) as s4, avg((size_class = 'oversize')::int::double) as s5
  from label_px join seg using (run_id, spatialr, label) where label > 0 group by 1, 2, 3, 4))""",
    "dominance": """select run_id, spatialr, count(*) as cells, coalesce(sum(pixels) filter (tail != 'central'), 0) / sum(pixels) as problem_area, """ + ", ".join(f"avg((dominant_class = '{k}')::int::double) as {k}" for k in ("micro", "small", "in_scale", "large", "oversize")) + ", " + ", ".join(f"avg((tail = '{k}')::int::double) as {k}_cells" for k in ("lower", "central", "upper")) + " from matrix group by 1, 2",
    "edge": """select run_id, spatialr, ranger, phase, r, c from (select *, lead(c) over w as c2, lead(label) over w as right_label, lead(r) over h as r2, lead(label) over h as lower_label
  from label_px where label > 0 window w as (partition by run_id, r order by c), h as (partition by run_id, c order by r)) where (c2 = c + 1 and right_label != label) or (r2 = r + 1 and lower_label != label)""",
    "run": "select distinct run_id, spatialr, ranger, phase from label_px",
    "pair": """select a.spatialr, a.run_id as left_run, b.run_id as right_run, cast(a.spatialr as double) as reach,
  case when a.ranger = b.ranger and a.phase != b.phase then 'seed_realization' when a.phase = b.phase and a.ranger != b.ranger then 'ranger' else 'factorial_cross' end as pair_class
  from run a join run b on a.spatialr = b.spatialr and a.run_id < b.run_id""",
    "disc": "select x, y, cast(x * x + y * y as bigint) as d2 from range(-9, 10) a(x), range(-9, 10) b(y) where x * x + y * y <= 81",
    "near": "select run_id, r + y as r, c + x as c, min(d2) as d2 from edge, disc group by 1, 2, 3",
    "edge_n": "select run_id, count(*) as n from edge group by 1",
    "side": "select *, left_run as own, right_run as other from pair_in union all select *, right_run, left_run from pair_in",
    "pair_score": """select p.left_run, p.right_run, p.reach, coalesce(ln.n, 0) + coalesce(rn.n, 0) as pixels, case when coalesce(ln.n, 0) + coalesce(rn.n, 0) > 0 then coalesce(score, 0) / 1e9 / (coalesce(ln.n, 0) + coalesce(rn.n, 0)) else 1.0 end as support
  from pair_in p left join edge_n ln on ln.run_id = p.left_run left join edge_n rn on rn.run_id = p.right_run left join (
    select left_run, right_run, reach, sum(cast(floor(greatest(0.0, 1 - sqrt(d2) / reach) * 1e9 + 0.5) as bigint)) as score
    from side join edge e on e.run_id = own join near nb on nb.run_id = other and nb.r = e.r and nb.c = e.c group by 1, 2, 3) s using (left_run, right_run, reach)""",
    "lag_dir": """select h, k, dr * h as dr, dc * h as dc from (values (1), (2), (3), (5), (8), (13)) a(h) cross join (values (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) b(k, dr, dc)""",
    "vario": """select h as lag, k as direction, count(*) as pairs, median(0.5 * ((a.m1 - b.m1) * (a.m1 - b.m1) + (a.m2 - b.m2) * (a.m2 - b.m2) + (a.m3 - b.m3) * (a.m3 - b.m3)) / 3) as semivariance
  from lag_dir join cell b on true join cell a on a.r = b.r + dr and a.c = b.c + dc group by 1, 2""",
    "curve": "select lag, median(semivariance) as semivariance, sum(pairs) as pairs from vario group by 1",
    "sill": """select median(semivariance) as sill, (max(semivariance) - min(semivariance)) / median(semivariance) as relative_span from (select *, row_number() over (order by lag desc) as i, count(*) over () as n from curve) where i <= greatest(2, ceil(n * 0.25))""",
    "position": "select event_id as image_id, epoch_us(ts) as t_us, 50 + (event_id % 97) / 10000 as lat, 8 + (event_id % 89) / 10000 as lon, cast((event_id * 37) % 360 as double) as yaw from events",
    "sortie": """select *, sum(case when gap is null or gap > 300000000::bigint then 1 else 0 end) over (order by t_us, image_id rows unbounded preceding) as sortie
  from (select *, t_us - lag(t_us) over (order by t_us, image_id) as gap from position)""",
    "line": """select * from (select *, sum(case when off then 0 when coalesce(prev_off or prev_dir != direction or step > greatest(1e7, 5 * coalesce(med, 1e6)), true) then 1 else 0 end) over (partition by sortie order by t_us, image_id rows unbounded preceding) as line from (
    select *, lag(off) over w as prev_off, lag(direction) over w as prev_dir, median(case when step > 0 then step end) over (partition by sortie) as med from (
      select *, t_us - lag(t_us) over (partition by sortie order by t_us, image_id) as step,
        least(abs(yaw - 45.0) % 180, 180 - abs(yaw - 45.0) % 180) > 60 as off, case when least(abs(yaw - 45.0) % 360, 360 - abs(yaw - 45.0) % 360) <= 90 then 1 else -1 end as direction from sortie)
    window w as (partition by sortie order by t_us, image_id))) where not off""",
    "design": """select l_returnflag as flag, l_linestatus as state, cast(count(*) as double) as n_rows, cast(sum(cast(floor(l_quantity) as bigint)) as double) as quantity, cast(max(floor(l_extendedprice * 100 + 0.5)) as double) as top_cents from lineitem group by 1, 2""",
    "metric": "select flag, state, m as metric, case m when 'n_rows' then n_rows when 'quantity' then quantity else top_cents end as value from design cross join (values ('n_rows'), ('quantity'), ('top_cents')) x(m)",
    "ct": "select lang as a, source as b, count(*) as n from documents where lang is not null and source is not null group by 1, 2",
}
NEEDS = {
    "pixel_obs": "grid", "obs": "pixel_obs", "med": "obs", "pixels": "med", "summary": "pixels", "review": "pixels", "cell": "obs", "label_px": "cell", "segment": "label_px", "seg": "segment", "share": "seg classes", "hist": "seg", "wq": "seg",
    "tails": "share", "match": "seg", "cum": "share", "dist": "cum hist tails wq", "matrix": "seg", "dominance": "matrix", "edge": "label_px", "run": "label_px", "pair": "run", "near": "edge disc", "edge_n": "edge", "side": "pair_in", "pair_score": "side near edge_n",
    "vario": "lag_dir cell", "curve": "vario", "sill": "curve", "sortie": "position", "line": "sortie", "metric": "design",
}


def sql(views: str, body: str, **own: str) -> str:
    """body after the views it needs; `own` adds or replaces views."""
    table = CTE | own
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in NEEDS.get(name, "").split():
                add(x)
            order.append(name)

    for name in views.split():
        add(name)
    return "with " + ",\n".join(f"{n} as ({table[n]})" for n in order) + "\n" + body


def micro(x: str, name: str) -> str:
    return f"cast(floor(floor(({x}) * 1e9 + 0.5) / 1000 + 0.5) as bigint) as {name}"


def milli(x: str, name: str) -> str:
    return f"cast(floor(({x}) * 1e3 + 0.5) as bigint) as {name}"
