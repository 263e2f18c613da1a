"""Registered queries of the studies: prediction across groups, permutations, power, budgets, geometry. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import studies as S
from gaugeline.plans.catalogue import LO, query, returned

U = "('0x' || substr(md5({arm} || '#' || n || '#' || rep || '#' || i), 1, 8))::bigint / 4294967296.0"
UNNEST = "u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from u group by 1, 2)"
POWER = [(40, 0.3, 0.5), (80, 0.3, 0.5), (160, 0.3, 0.5), (160, 0.3, 0.3)]


def _ev(t):
    return t("events").select("event_id", "user_id", "event_type", "value", F.hour("ts").alias("h"), F.to_date("ts").alias("day"), "ts")


def _scored(t):
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")


# ---- prediction across groups
@query("""with g as (select l_suppkey, count(*) as n, sum(l_quantity) as sx, sum(l_extendedprice) as sy, sum(l_quantity * l_quantity) as xx, sum(l_quantity * l_extendedprice) as xy, sum(l_extendedprice * l_extendedprice) as yy from lineitem group by 1),
o as (select *, sum(n) over () - n as m, sum(sx) over () - sx as tx, sum(sy) over () - sy as ty, sum(xx) over () - xx as txx, sum(xy) over () - xy as txy from g), b as (select *, (m * txy - tx * ty) / (m * txx - tx * tx) as b from o), a as (select *, (ty - b * tx) / m as a from b)
select l_suppkey, n, round(b, 3) as slope, round(sqrt(greatest(yy - 2 * a * sy - 2 * b * xy + n * a * a + 2 * a * b * sx + b * b * xx, 0) / n), 2) as rmse from a""")
def leave_group_out(t):
    return S.leave_group_out(t("lineitem"), "l_quantity", "l_extendedprice", "l_suppkey").select("l_suppkey", "n", F.round("slope", 3).alias("slope"), F.round("rmse", 2).alias("rmse"))


@query()
def ridge_nested(t):
    d = t("lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))
    return S.ridge_nested(d, ["l_quantity", "l_discount", "l_tax"], "y", "l_suppkey", [0.0, 0.01, 0.1, 1.0]).withColumn("mse", F.round("mse", 4))


@query()
def stage_model(t):
    """Order status as a stage (P, O, F), by size and month: counts and mean predicted shares."""
    d = t("orders").select("o_orderstatus", F.log("o_totalprice").alias("size"), (F.month("o_orderdate") / 12.0).alias("month"), F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("stage"))
    p = S.stage_probabilities(d, S.stage_gates(d, "stage", ["size", "month"], 3), ["size", "month"])
    return p.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col("stages")[i]), 5).alias(f"p{i}") for i in range(3)])


# ---- permutations and resampling
@query("""with d as (select event_id, user_id, hour(ts)::double as z, (event_type = 'purchase')::int::double as x, value as y from events), l as (select regr_slope(x, z) as bx, regr_intercept(x, z) as ax, regr_slope(y, z) as b_y, regr_intercept(y, z) as ay from d),
f as (select event_id, user_id, x - ax - bx * z as u, y - ay - b_y * z as v from d, l), s as (select count(*) as n, round(sum(u * v) / sum(u * u), 9) as coef from f),
m as (select *, row_number() over (partition by rep, user_id order by event_id) as i, row_number() over (partition by rep, user_id order by md5(event_id || '#' || rep), event_id) as j from f, (select unnest(range(1, 31)) as rep)),
r as (select a.rep, round(sum(a.u * b.v) / sum(a.u * a.u), 9) as m from m a join m b on a.rep = b.rep and a.user_id = b.user_id and a.i = b.j group by 1)
select n, round(coef, 6) as coef, sum((abs(m) >= abs(coef))::int)::bigint as exceed, round((sum((abs(m) >= abs(coef))::int) + 1) / 31.0, 6) as p from r, s group by n, coef""")
def residual_permutation(t):
    d = _ev(t).withColumn("x", (F.col("event_type") == "purchase").cast("int"))
    return S.residual_permutation(d, "event_id", "user_id", "x", "h", "value", 30)


@query("""with d as (select doc_id, lang, quality as y, n_chars from documents join labels using (doc_id) where lang is not null and quality is not null and n_chars is not null),
r as (select *, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r, sum(y) over (partition by lang) as p, count(*) over (partition by lang) as n from d),
s as (select lang, max(n) as n, (sum(case when y = 1 then r end) - max(p) * (max(p) + 1) / 2.0) / nullif(max(p) * (max(n) - max(p)), 0) as auc from r group by 1),
m as (select *, row_number() over (partition by rep, lang order by md5(doc_id || '#' || rep), doc_id) as i from r, (select unnest(range(1, 31)) as rep)),
q as (select lang, rep, (sum(case when i <= p then r end) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p))) as m from m group by 1, 2)
select lang, n, round(auc, 6) as auc, sum((round(abs(m - 0.5), 9) >= round(abs(auc - 0.5), 9))::int)::bigint as exceed, round((sum((round(abs(m - 0.5), 9) >= round(abs(auc - 0.5), 9))::int) + 1) / 31.0, 6) as p from q join s using (lang) where auc is not null group by lang, n, auc""")
def auc_permutation(t):
    return S.auc_permutation(_scored(t), "doc_id", "n_chars", "quality", "lang", 30)


@query("""with d as (select user_id, event_type = 'purchase' as t, ts >= timestamp '2024-01-16' as a, value as v from events),
u as (select user_id, coalesce(sum(v) filter (where t and a), 0) as s11, coalesce(sum(v) filter (where t and not a), 0) as s10, coalesce(sum(v) filter (where not t and a), 0) as s01, coalesce(sum(v) filter (where not t and not a), 0) as s00, count(v) filter (where t and a) as c11, count(v) filter (where t and not a) as c10, count(v) filter (where not t and a) as c01, count(v) filter (where not t and not a) as c00 from d group by 1),
i as (select *, row_number() over (order by user_id) - 1 as i, count(*) over () as n from u), r as (select rep, ('0x' || substr(md5(i || '#' || rep), 1, 8))::bigint % n as i from i, (select unnest(range(1, 41)) as rep)),
m as (select rep, sum(s11) / sum(c11) - sum(s10) / sum(c10) - (sum(s01) / sum(c01) - sum(s00) / sum(c00)) as m from r join i using (i) group by 1), s as (select count(*) as units, sum(s11) / sum(c11) - sum(s10) / sum(c10) - (sum(s01) / sum(c01) - sum(s00) / sum(c00)) as did from u)
select units, round(did, 5) as did, round(quantile_cont(m, 0.025), 5) as lo, round(quantile_cont(m, 0.975), 5) as hi from m, s group by units, did""")
def did_bootstrap(t):
    d = t("events").select("user_id", (F.col("event_type") == "purchase").alias("t"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).alias("a"), "value")
    return S.did_bootstrap(d, "user_id", "t", "a", "value", 40)


@query("""with m as (select user_id, avg(value) filter (where event_type = 'click') - avg(value) filter (where event_type = 'view') as d from events group by 1), s as (select count(*) filter (where d <> 0) as n, count(*) filter (where d > 0) as up from m),
k as (select n, up, unnest(range(0, least(up, n - up) + 1)) as k from s) select n, up, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) as p from k group by n, up""")
def sign_test(t):
    of = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    return S.sign_test(t("events").groupBy("user_id").agg((of("click") - of("view")).alias("d")), "d")


@query("""with g as (select event_type, round(avg(value), 6) as a, count(*)::double as b, round(max(value), 6) as y from events group by 1), r as (select *, row_number() over (order by event_type) as i, count(*) over () as n, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from g),
p as (select [a.i, b.i, c.i, d.i, e.i] as p, row_number() over () as id from r a, r b, r c, r d, r e where a.i not in (b.i, c.i, d.i, e.i) and b.i not in (c.i, d.i, e.i) and c.i not in (d.i, e.i) and d.i <> e.i),
m as (select id, p, round(greatest(abs(corr(x.ra, z.ry)), abs(corr(x.rb, z.ry))), 9) as m from p, r x join r z on z.i = p.p[x.i] group by id, p), o as (select m as o from m where p = [1, 2, 3, 4, 5])
select 5::int as n, round(o, 6) as observed, round(avg((m >= o)::int), 6) as p from m, o group by o""")
def exact_order_test(t):
    g = t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("a"), F.count(F.lit(1)).alias("b"), F.round(F.max("value"), 6).alias("y"))
    return S.exact_order_test(g, "event_type", ["a", "b"], "y")


# ---- power, floors, budgets, picks
@query(f"""with g(n, p0, p1) as (values {", ".join(f"({n}, {a}::double, {b}::double)" for n, a, b in POWER)}), x as (select *, unnest(range(1, n + 1)) as i from g, (select unnest(range(1, 101)) as rep)),
d as (select n, p0, p1, rep, sum(({U.format(arm="'a'")} < p0)::int)::double as k0, sum(({U.format(arm="'b'")} < p1)::int)::double as k1 from x group by 1, 2, 3, 4), q as (select *, (k0 + k1) / (2.0 * n) as q from d)
select n, p0, p1, round(avg((abs(k1 - k0) / n > 1.96 * sqrt(2 * q * (1 - q) / n))::int), 6) as power, round(2.8016 * sqrt(2 * p0 * (1 - p0) / n), 6) as mde from q group by 1, 2, 3""")
def simulated_power(t):
    return S.simulated_power(t("region").sparkSession, POWER)


@query("""with g as (select m, rho::double as rho from (select unnest([3, 5, 9]) as m), (select unnest([0, 0.25, 0.5]) as rho)), w as (select m, rho, (case when i in (1, m) then 0.5 else 1 end)::double / (m - 1) as w from (select *, unnest(range(1, m + 1)) as i from g))
select m, rho, round(0.0333 * sqrt((1 - rho) * sum(w * w) + rho * sum(w) ** 2), 6) as floor from w group by 1, 2""")
def trapezoid_floor(t):
    return S.trapezoid_floor(t("region").sparkSession, [3, 5, 9], [0.0, 0.25, 0.5], 0.0333)


@query("""with g as (select event_type, day(ts) as b, sum(value) as v from events group by 1, 2), c as (select *, sum(v) over w as c, 0.95 * sum(v) over (partition by event_type) as t from g window w as (partition by event_type order by b)), l as (select *, lag(c) over w as pc, lag(b) over w as pb from c window w as (partition by event_type order by b)),
f as (select *, row_number() over (partition by event_type order by b) as i from l where c >= t) select event_type, round(case when pc is null then b::double else pb + (b - pb) * (t - pc) / (c - pc) end, 6) as budget from f where i = 1""")
def budget_to_share(t):
    return S.budget_to_share(t("events").withColumn("b", F.dayofmonth("ts")), "event_type", "b", "value")


@query("""with g as (select day(ts) as day, event_type, count(*) as s, round(avg(value), 6) as v from events group by 1, 2), r as (select *, row_number() over (partition by day order by s desc, event_type desc) as i, row_number() over (partition by day order by v desc, event_type desc) as j from g)
select day, max(case when i = 1 then event_type end) as picked, (max(case when i = 1 then event_type end) = max(case when j = 1 then event_type end))::int as "right", round(max(v) - max(case when i = 1 then v end), 6) as regret, round(max(v) - avg(v), 6) as chance_regret from r group by 1""")
def pick_quality(t):
    g = t("events").groupBy(F.dayofmonth("ts").cast("long").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("s"), F.round(F.avg("value"), 6).alias("v"))
    return S.pick_quality(g, "day", "event_type", "s", "v")


@query("""with r as (select o_orderkey, row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) as i from orders), k as (select o_orderkey, 'quota' as phase from r where i <= 20)
select * from k union all select * from (select o_orderkey, 'overflow' as phase from r where i > 20 order by o_orderkey limit greatest(0, 400 - (select count(*) from k)))""")
def quota_scan(t):
    return S.quota_scan(t("orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 20, 400)


@query(f"""with g as (select p_brand, count(*) as n, sum((l_returnflag = 'N')::int)::bigint as good, sum((l_returnflag = 'R')::int)::bigint as bad, avg(l_discount) as u from lineitem join part on l_partkey = p_partkey group by 1),
a as (select p_brand, n, u, bad, {LO.replace("round(", "(").replace(", 6) end", ") end").replace("k::double", "good::double")} as lg from g), b as (select p_brand, n, u, lg, {LO.replace("round(", "(").replace(", 6) end", ") end").replace("k::double", "bad::double")} as lb from a) select p_brand, n, round(lg * lb * u, 9) as score from b""")
def acquisition(t):
    d = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return S.acquisition(d, "p_brand", F.col("l_returnflag") == "N", returned(), F.col("l_discount"))


@query("""with d as (select p_size as x, p_retailprice as y from part), t as (select count(*) as n, regr_slope(y, x) as s, regr_intercept(y, x) as i, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, min(x) as lo, max(x) as hi from d), e as (select *, greatest(syy - s * s * sxx, 0) / (n - 2) as s2 from t)
select n, round(s, 6) as slope, round(i, 6) as intercept, round(sqrt(greatest(s2 - 25, 0)), 6) as excess, lo::double as lo, hi::double as hi, s - 1.645 * sqrt(s2 / sxx) > 0 as passed from e""")
def proxy_gate(t):
    return S.proxy_gate(t("part"), "p_size", "p_retailprice", 5.0)


# ---- geometry of clusters and vectors
@query(f"""with {UNNEST}, d as (select vec_id, u.label, round(sqrt(sum((x - m) ** 2)), 9) as d from u join c on u.label = c.label and u.i = c.i group by 1, 2), r as (select *, row_number() over (partition by label order by d, vec_id) as k from d)
select label, count(*) as size, round(count(*)::double / sum(count(*)) over (), 6) as share, round(avg(d), 6) as spread, string_agg(vec_id::varchar, ',' order by k) filter (where k <= 3) as nearest from r group by 1""")
def cluster_cards(t):
    return S.cluster_cards(t("embeddings"), "vec_id", "embedding", "label")


@query(f"""with {UNNEST}, d as (select vec_id, u.label, c.label as other, sqrt(sum((x - m) ** 2)) as d from u join c on u.i = c.i group by 1, 2, 3), r as (select vec_id, label, min(d) filter (where label = other) as o, min(d) filter (where label <> other) as f from d group by 1, 2)
select label, round(avg(o), 6) as own, round(avg(f - o), 6) as margin from r group by 1""")
def margins(t):
    return S.margins(t("embeddings"), "embedding", "label")


@query(f"""with {UNNEST}, w as (select i, avg(x) as m from u group by 1), n as (select label, count(*) as n from embeddings group by 1)
select u.vec_id, round(sqrt(sum((x - case when n.n >= 50 then c.m else w.m end) ** 2)), 6) as distance from u join c on u.label = c.label and u.i = c.i join w on u.i = w.i join n on u.label = n.label group by 1""")
def group_shape(t):
    return S.group_shape(t("embeddings"), "vec_id", "embedding", "label", 50)


@query("""with g as (select user_id, avg(value) as a, stddev_pop(value) as b, arg_min(value, event_id) as c, arg_max(value, event_id) as d, count(*)::double as e from events where value is not null group by 1)
select user_id, round((a - avg(a) over ()) / greatest(stddev_pop(a) over (), 1e-9), 5) as mean, round((b - avg(b) over ()) / greatest(stddev_pop(b) over (), 1e-9), 5) as sd, round((c - avg(c) over ()) / greatest(stddev_pop(c) over (), 1e-9), 5) as "first", round((d - avg(d) over ()) / greatest(stddev_pop(d) over (), 1e-9), 5) as "last", round((e - avg(e) over ()) / greatest(stddev_pop(e) over (), 1e-9), 5) as length from g""")
def sequence_features(t):
    return S.sequence_features(t("events"), "user_id", "event_id", "value")


# ---- clusterings
@query()
def spherical_kmeans(t):
    return S.spherical_kmeans(t("embeddings"), "vec_id", "embedding", 10)


@query()
def mixture(t):
    return S.mixture(t("embeddings"), "vec_id", "embedding", 4)


@query()
def seed_stability(t):
    return S.seed_stability(t("embeddings"), "vec_id", "embedding", 10, [1, 2, 3])
