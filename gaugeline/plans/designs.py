"""Queries of halves, relabellings, floors, slopes, shares, profiles, paths and reference sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import exprs as E
from gaugeline.operators import designs as D
from gaugeline.operators import joins, stats, vectors
from gaugeline.plans.catalogue import query

UNIT = "('0x' || substr(md5({k} || '#' || '{s}'), 1, 8))::bigint"
NORMAL = f"(sqrt(-2 * ln(({UNIT} + 0.5) / 4294967296.0)) * cos(2 * pi() * (({UNIT.replace('{s}', '{s1}')} + 0.5) / 4294967296.0)))"


def _ev(t):
    return t("events").select("event_id", "user_id", "event_type", "value", "ts")


def _cut(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- expressions
@query("""with g as (select l_linenumber, count(*) filter (where l_linestatus = 'O') as n1, count(*) filter (where l_linestatus = 'F') as n2, count(*) filter (where l_linestatus = 'O' and l_quantity > 25) as k1, count(*) filter (where l_linestatus = 'F' and l_quantity > 25) as k2 from lineitem group by 1),
p as (select *, k1::double / nullif(n1, 0) as p1, k2::double / nullif(n2, 0) as p2, (k1 + k2)::double / nullif(n1 + n2, 0) as p from g) select l_linenumber, round((p1 - p2) / nullif(sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)), 0), 5) as z from p""")
def two_proportion(t):
    of = lambda s, x: F.count(F.when((F.col("l_linestatus") == s) & x, 1))
    big = F.col("l_quantity") > 25
    g = t("lineitem").groupBy("l_linenumber").agg(of("O", F.lit(True)).alias("n1"), of("F", F.lit(True)).alias("n2"), of("O", big).alias("k1"), of("F", big).alias("k2"))
    return g.select("l_linenumber", F.round(E.two_proportion_z("k1", "n1", "k2", "n2"), 5).alias("z"))


@query("select l_linenumber || '#' || round_even(l_discount, 4)::varchar || '#' || round_even(l_tax, 4)::varchar as signature, count(*) as n from lineitem group by 1")
def config_signature(t):
    return t("lineitem").groupBy(E.signature("l_linenumber", "l_discount", "l_tax").alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, round(x * cos(w) + y * sin(w), 6) as u, round(y * cos(w) - x * sin(w), 6) as v from (select l_orderkey, l_linenumber, l_discount + 0.0051 as x, l_tax + 0.0032 as y, l_quantity / 10 as w from lineitem)")
def local_frame(t):
    u, v = E.rotated(F.col("l_discount") + 0.0051, F.col("l_tax") + 0.0032, F.col("l_quantity") / 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("select l_orderkey, l_linenumber, round(atan2(2 * (l_discount * l_quantity / 50 + l_tax * 0.5), 1 - 2 * (0.25 + l_quantity / 50 * l_quantity / 50)), 6) as yaw from lineitem")
def quaternion_yaw(t):
    d = t("lineitem").withColumn("z", F.col("l_quantity") / 50).withColumn("y", F.lit(0.5))
    return d.select("l_orderkey", "l_linenumber", F.round(E.quaternion_yaw("l_discount", "l_tax", "y", "z"), 6).alias("yaw"))


@query("select case when l_quantity < 10 then 0 when l_quantity <= 30 then 1 else 2 end as bin, count(*) as n, round(avg(least(greatest(l_extendedprice, 5000), 40000)), 4) as price from lineitem group by 1")
def closed_middle_bins(t):
    return t("lineitem").groupBy(E.closed_middle("l_quantity", 10, 30).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(E.clip("l_extendedprice", 5000.0, 40000.0)), 4).alias("price"))


@query("select case l_returnflag when 'A' then 'accepted' when 'R' then 'returned' else l_returnflag end as flag, count(*) as n from lineitem group by 1")
def canonical_labels(t):
    return t("lineitem").groupBy(E.canonical("l_returnflag", {"A": "accepted", "R": "returned"}).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select user_id, event_type, count(*)::double as n from events group by 1, 2), p as (select user_id, n / sum(n) over (partition by user_id) as p from c) select user_id, round(-sum(p * ln(p)), 6) as entropy from p group by 1")
def user_entropy(t):
    c = _ev(t).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("ns"), F.sum("n").alias("s"))
    return c.select("user_id", F.round(E.entropy(F.transform("ns", lambda x: x / F.col("s"))), 6).alias("entropy"))


@query("with g as (select user_id, count(*) as n from events group by 1) select user_id, i, round_even(i * (n - 1) / 7.0, 0)::int as at from (select *, unnest(range(0, 8))::int as i from g)")
def frame_offsets(t):
    return _ev(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.posexplode(E.evenly(8, "n")).alias("i", "at"))


@query("select c_custkey, coalesce(n_regionkey, -1)::int as region from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey")
def lookup_default(t):
    dim = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    return joins.lookup(t("customer"), dim, "c_nationkey", "region", -1).select("c_custkey", "region")


@query("select 'chunk-' || lpad((o_orderkey // 1000)::varchar, 3, '0') as chunk, count(*) as n from orders group by 1")
def chunk_sizes(t):
    return t("orders").groupBy(E.chunk_label("o_orderkey", 1000).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


# ---- halves and names
@query("with r as (select user_id, (row_number() over (order by user_id) - 1) % 2 as half from (select distinct user_id from events)) select half::int as half, count(*) as n, round(avg(value), 6) as mean from events join r using (user_id) group by 1")
def alternate_halves(t):
    return D.alternate_halves(_ev(t), "user_id").groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""with r as (select user_id, (row_number() over (order by user_id) - 1) % 2 as half from (select distinct user_id from events)), e as (select *, hour(ts) as h from events join r using (user_id)),
m as (select half, h, avg(value) as m from e group by 1, 2 having count(*) >= 5), l as (select *, row_number() over (partition by half order by round(m, 9), h) as i from m)
select e.event_id, (l.i is not null)::int as flag from e left join (select * from l where i <= 6) l on l.h = e.h and l.half = 1 - e.half""")
def cross_fitted_flag(t):
    return D.cross_fitted_flag(_ev(t).withColumn("h", F.hour("ts")), "user_id", "h", "value", 6, 5).select("event_id", "flag")


@query("select count(*) as n, count(distinct o_orderstatus) as names from orders")
def canonical_check(t):
    return D.assert_canonical(t("orders"), "o_orderstatus", ["F", "O", "P"])


@query("select case when c_mktsegment like 'AUTO%' then 'vehicle' when c_mktsegment like 'MACH%' then 'plant' else 'other' end as family, count(*) as n from customer group by 1")
def arm_families(t):
    named = t("customer").withColumn("arm", F.concat("c_mktsegment", F.lit("_j"), (F.col("c_custkey") % 7).cast("string")))
    return named.groupBy(D.arm_family("arm", {"AUTO": "vehicle", "MACH": "plant"}, "other").alias("family")).agg(F.count(F.lit(1)).alias("n"))


# ---- counters, lists, paths
@query("""select l_suppkey, count(*) filter (where l_linestatus = 'O') as first_n, count(*) filter (where l_linestatus = 'O' and l_returnflag = 'N') as first_k, count(*) filter (where l_linestatus = 'F') as second_n,
count(*) filter (where l_linestatus = 'F' and l_returnflag = 'N') as second_k, round(avg(case when l_tax > 0.02 then l_tax end), 6) as spread from lineitem group by 1""")
def source_counters(t):
    d = t("lineitem").withColumn("u", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    return _cut(D.two_source_counters(d, "l_suppkey", "l_linestatus", "O", "F", F.col("l_returnflag") == "N", "u"), 6, "spread")


@query("with s as (select o_custkey, o_totalprice as v, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders) select o_custkey, count(*)::int as n, round(sum(abs(v - p)), 2) as walked from s group by 1")
def list_steps(t):
    d = D.ordered_lists(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return d.select("o_custkey", F.size("values").alias("n"), F.round(F.col("step") * (F.size("values") - 1), 2).alias("walked"))


@query("""with c as (select l_suppkey, l_linestatus as region, count(*) as n from lineitem where l_quantity > 40 group by 1, 2), m as (select l_suppkey, 'F' as region, min(l_quantity) as value from lineitem group by 1 union all select l_suppkey, 'O', max(l_tax) from lineitem group by 1)
select l_suppkey, region, value, coalesce(n, 0) as n from m left join c using (l_suppkey, region)""")
def map_to_rows(t):
    li = t("lineitem")
    maps = li.groupBy("l_suppkey").agg(F.create_map(F.lit("F"), F.min("l_quantity"), F.lit("O"), F.max("l_tax")).alias("by_region"))
    return D.map_rows(maps, "l_suppkey", "by_region", li.where("l_quantity > 40").groupBy("l_suppkey", F.col("l_linestatus").alias("region")).agg(F.count(F.lit(1)).alias("n")), "region")


@query("with r as (select *, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as m from events) select user_id, count(*) as n, round(avg(value), 6) as mean from r where m <= 20 or (i > 5 and i <= m - 5) group by 1")
def trimmed_means(t):
    return D.trimmed(_ev(t), "user_id", ["ts", "event_id"], 5, 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""with r as (select user_id, value as a, lead(value) over w as b, row_number() over w - 1 as j, count(*) over (partition by user_id) as m from events window w as (partition by user_id order by ts, event_id)), p as (select distinct user_id, m, i from r, (select unnest(range(0, 32)) as i))
select p.user_id, p.i::int as i, round(case when (p.i * (p.m - 1)) % 31 = 0 then a else a + ((p.i * (p.m - 1)) % 31) / 31.0 * (b - a) end, 6) as value from p join r on p.user_id = r.user_id and r.j = (p.i * (p.m - 1)) // 31""")
def resampled_paths(t):
    return _cut(D.resampled_path(_ev(t), "user_id", ["ts", "event_id"], "value", 32), 6, "value")


@query("""with c as (select (n_nationkey % 3)::int as t, (n_nationkey % 5)::int as h, n_regionkey::int as x, n_name as cell from nation), p as (select p_partkey, (p_size % 4)::int as t, (p_size % 7)::int as h, (p_partkey % 6)::int as x from part),
r as (select p_partkey, cell, row_number() over (partition by p_partkey order by abs(p.t - c.t), abs(p.h - c.h) + abs(p.x - c.x), cell) as i from p, c) select p_partkey, cell from r where i = 1""")
def nearest_cells(t):
    i = lambda c, m: (F.col(c) % m).cast("int")
    cells = t("nation").select(i("n_nationkey", 3).alias("t"), i("n_nationkey", 5).alias("h"), F.col("n_regionkey").cast("int").alias("x"), F.col("n_name").alias("cell"))
    rows = t("part").select("p_partkey", i("p_size", 4).alias("t"), i("p_size", 7).alias("h"), i("p_partkey", 6).alias("x"))
    return D.nearest_cell(rows, cells).select("p_partkey", "cell")


@query("""with e as (select quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as b from lineitem)
select ((l_quantity >= a[1])::int + (l_quantity >= a[2])::int + (l_quantity >= a[3])::int) as ix, ((l_extendedprice >= b[1])::int + (l_extendedprice >= b[2])::int + (l_extendedprice >= b[3])::int) as iy, count(*) as n, round(avg(l_discount), 6) as mean from lineitem, e group by 1, 2""")
def heat_map(t):
    return D.heat_index(t("lineitem"), "l_quantity", "l_extendedprice", 4).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


# ---- permutations, components, floors, slopes
@query("""with b as (select event_id, user_id || '/' || hour(ts) // 6 as g, (event_type = 'purchase')::int as f, value as y from events), o as (select round(avg(case when f = 1 then y end) - avg(case when f = 0 then y end), 9) as d from b),
s as (select rep, y, (row_number() over (partition by rep, g order by md5(event_id || '#' || rep), event_id) <= k)::int as f from (select *, sum(f) over (partition by g) as k from b), (select unnest(range(1, 201)) as rep)),
n as (select rep, round(avg(case when f = 1 then y end) - avg(case when f = 0 then y end), 9) as m from s group by 1) select round(d, 6) as observed, sum((abs(m) >= abs(d))::int)::bigint as exceed, round((sum((abs(m) >= abs(d))::int) + 1) / 201.0, 6) as p from n, o group by d""")
def perm_two_level(t):
    d = _ev(t).select("event_id", F.concat_ws("/", "user_id", F.floor(F.hour("ts") / 6)).alias("g"), (F.col("event_type") == "purchase").cast("int").alias("f"), "value")
    return stats.permutation_test(d, "event_id", "g", "f", "value", 200)


@query("""with u as (select vec_id, (label = 0)::int as y, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings where label is not null), r as (select i, y, rank() over (partition by i order by x) + (count(*) over (partition by i, x) - 1) / 2.0 as r from u),
a as (select i, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as a from r group by 1), b as (select (i - 1)::int as mode, round(greatest(a, 1 - a), 6) as auc from a) select mode, auc from b order by auc desc, mode limit 1""")
def best_mode_auc(t):
    d = t("embeddings").where("label is not null").select((F.col("label") == 0).cast("int").alias("y"), F.posexplode("embedding").alias("mode", "x"))
    a = stats.auc(d, "x", "y", ["mode"]).select("mode", F.round(F.greatest(F.col("auc"), 1 - F.col("auc")), 6).alias("auc"))
    return a.orderBy(F.desc("auc"), "mode").limit(1)  # the best is the feature


@query("""with v as (select l_returnflag as p, l_linenumber as a, l_suppkey % 2 as s, round(avg(l_quantity), 9) as v from lineitem group by 1, 2, 3), x as (select i.p, i.a as i, j.a as j, k.a as k, round(k.v - (i.v + j.v) / 2, 9) as d from v i join v j on i.p = j.p and i.s = j.s and i.a <> j.a join v k on k.p = i.p and k.s = i.s and k.a not in (i.a, j.a)),
o as (select p, i, j, k, round(avg(d), 9) > 0.05 as big, min(sign(d)) = max(sign(d)) as same from x group by 1, 2, 3, 4), h as (select p, i, j, sum((big and same)::int) as hits from o group by 1, 2, 3), g as (select p, hits, count(*) as ways from h group by 1, 2)
select (a.hits + b.hits + c.hits)::bigint as hits, sum(a.ways * b.ways * c.ways)::bigint as ways from g a, g b, g c where a.p = 'A' and b.p = 'N' and c.p = 'R' group by 1""")
def relabelling_hits(t):
    d = t("lineitem").withColumn("s", F.col("l_suppkey") % 2)
    return D.relabelling_hits(d, "l_returnflag", "l_linenumber", "s", "l_quantity", 0.05)


@query("""with d as (select event_type, user_id % 11 as draw, count(*) as n, sum(value) as s, sum(value * value) as q from events where value is not null group by 1, 2), g as (select event_type, count(*) as d, sum(n) as n, sum(n * n) as nn, sum(s) as s, sum(s * s / n) as b, sum(q) as q from d group by 1),
m as (select *, (b - s * s / n) / (d - 1) as msb, (q - b) / (n - d) as msw, (n - nn / n) / (d - 1) as n0 from g) select event_type, d as draws, n::bigint as n, round(sqrt(msw), 5) as sd_seed, round(sqrt(greatest(0, (msb - msw) / n0)), 5) as sd_draw, round(msb / msw, 5) as f from m""")
def nested_components(t):
    return _cut(D.nested_components(_ev(t).withColumn("draw", F.col("user_id") % 11), "event_type", "draw", "value"), 5, "sd_seed", "sd_draw", "f")


@query("""with r as (select l_linenumber, l_suppkey % 5 as seed, count(*) as n, avg((l_returnflag = 'R')::int) as r from lineitem group by 1, 2), g as (select l_linenumber, count(*) as seeds, avg(r) as mean, var_samp(r) as v, avg(r * (1 - r) / n) as e from r group by 1)
select l_linenumber, seeds, round(mean, 6) as mean, round(sqrt(greatest(v - e, 0)), 6) as sd_seed, round(sqrt(e), 6) as noise, round((select regr_slope(mean, ln(l_linenumber)) from g), 6) as slope from g""")
def seed_spread(t):
    return _cut(D.seed_spread(t("lineitem").withColumn("seed", F.col("l_suppkey") % 5), "l_linenumber", "seed", F.col("l_returnflag") == "R"), 6, "mean", "sd_seed", "noise", "slope")


@query("with d as (select event_type, user_id, avg(value) filter (where event_id % 2 = 0) - avg(value) filter (where event_id % 2 = 1) as d from events group by 1, 2) select event_type, count(d) as n, round(greatest(stddev_samp(d), 1.5), 6) as floor from d group by 1")
def noise_floors(t):
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    return _cut(D.noise_floor(_ev(t).groupBy("event_type", "user_id").agg((half(0) - half(1)).alias("d")), "event_type", "d", 1.5), 6, "floor")


@query("""with d as (select n_regionkey, n_nationkey, avg(c_acctbal) filter (where c_custkey % 2 = 0) - avg(c_acctbal) filter (where c_custkey % 2 = 1) as d from customer join nation on c_nationkey = n_nationkey where n_regionkey < 3 group by 1, 2),
m as (select avg(d) as m from d group by n_regionkey) select count(m) as clusters, round(stddev_samp(m), 4) as sd, round((2.919985580 + 1.060660172) * stddev_samp(m) / sqrt(count(m)), 2) as mde from m""")
def null_pair_mde(t):
    c = t("customer").join(t("nation").where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    half = lambda k: F.avg(F.when(F.col("c_custkey") % 2 == k, F.col("c_acctbal")))
    d = D.null_pair_mde(c.groupBy("n_regionkey", "n_nationkey").agg((half(0) - half(1)).alias("d")), "n_regionkey", "d")
    return d.select("clusters", F.round("sd", 4).alias("sd"), F.round("mde", 2).alias("mde"))


@query("""with r as (select case when user_id % 6 < 5 then user_id % 6 end as a, event_id % 5 as z, value from events), m as (select a, z, avg(value) as m from r group by 1, 2), g as (select x.a, x.z, (x.m - b.m) / 20.0 as g from m x join m b on b.a is null and b.z = x.z where x.a is not null)
select round(avg(g) filter (where a = z), 7) as own, round(avg(g) filter (where a <> z), 7) as "cross" from g""")
def dose_slopes(t):
    d = _ev(t).select(F.when(F.col("user_id") % 6 < 5, F.col("user_id") % 6).alias("a"), (F.col("event_id") % 5).alias("z"), "value")
    return _cut(D.dose_slopes(d, "a", "z", "value", 20.0), 7, "own", "cross")


# ---- shares, profiles, sets
@query("""with c as (select n_regionkey, c_nationkey, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2), s as (select *, sum(n) over (partition by n_regionkey) as t from c), w as (select *, least(30 + 10 * n_regionkey, t) as w from s), q as (select *, w * n // t as q, w * n % t as r from w),
k as (select *, w - sum(q) over (partition by n_regionkey) as l, row_number() over (partition by n_regionkey order by r desc, c_nationkey) as k from q) select n_regionkey, c_nationkey, n, (q + (k <= l)::int)::bigint as given from k""")
def category_plan(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return D.distributed(c, "c_nationkey", "n", 30 + 10 * F.col("n_regionkey"), ["n_regionkey"])


@query(f"""with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5(o_orderkey || '#' || '7'), o_orderkey) as i from orders)
select o_orderkey, o_orderpriority from r where i <= case o_orderpriority when '2-HIGH' then 5 when '1-URGENT' then 25 when '3-MEDIUM' then 25 when '4-NOT SPECIFIED' then 24 when '5-LOW' then 24 else 0 end""")
def starved_profile(t):
    counts = D.profile_counts(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 103, "2-HIGH")
    return D.profile_draw(t("orders"), "o_orderkey", "o_orderpriority", counts, 7).select("o_orderkey", "o_orderpriority")


@query("""with s as (select o_orderkey, o_totalprice, (ntile(3) over (order by o_totalprice, o_orderkey) - 1)::int as stratum from orders), r as (select *, row_number() over (partition by stratum order by o_totalprice, o_orderkey) - 1 as i, count(*) over (partition by stratum) as m from s)
select distinct o_orderkey, stratum from r, (select unnest(range(0, 50)) as j) where i = round_even(j * (m - 1) / 49.0, 0)::bigint""")
def evaluation_set(t):
    return D.evaluation_set(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 150).select("o_orderkey", "stratum")


@query(f"""with g as (select c_nationkey, avg(c_acctbal) / 1000 as truth, count(*) / 100.0 as decoy from customer group by 1), p as (select c_nationkey, 0.6 * truth + 0.4 * decoy + {NORMAL.format(k='c_nationkey', s=3, s1=4)} * 0.5 as probe from g)
select c_nationkey, round(probe, 5) as probe, round(200 * greatest(probe, 0) / sum(greatest(probe, 0)) over (), 4) as share from p""")
def probed_shares(t):
    g = t("customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("truth"), (F.count(F.lit(1)) / 100.0).alias("decoy"))
    p = g.select("c_nationkey", D.paid_probe(F.col("truth"), F.col("decoy"), 0.6, 1.0, 4.0, 3, "c_nationkey").alias("probe"))
    return D.positive_shares(p, "probe", 200.0).select("c_nationkey", F.round("probe", 5).alias("probe"), F.round("share", 4).alias("share"))


@query(f"""with g as (select c_nationkey, avg(c_acctbal) as v from customer group by 1), z as (select c_nationkey, (v - avg(v) over ()) / stddev_pop(v) over () as z, {NORMAL.format(k='c_nationkey', s=5, s1=6)} as n from g), c as (select *, n - avg(n) over () as c from z),
o as (select *, c - sum(c * z) over () / sum(z * z) over () * z as o from c) select c_nationkey, round(0.7 * z + sqrt(1 - 0.7 * 0.7) * (o - avg(o) over ()) / stddev_pop(o) over (), 5) as signal from o""")
def correlated_signal(t):
    g = t("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    return D.correlated_vector(g, "c_nationkey", "v", 0.7, 5).select("c_nationkey", F.round("signal", 5).alias("signal"))


@query("""with f as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_discount) as md, avg(l_tax) as mt, sqrt(var_pop(l_discount) + var_pop(l_tax)) as sb from lineitem where l_linestatus = 'F')
select l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 5) as z_l_quantity, round((l_discount - md) / sb, 5) as z_l_discount, round((l_tax - mt) / sb, 5) as z_l_tax from lineitem, f""")
def frozen_spec(t):
    li, cols = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus"), ["l_quantity", "l_discount", "l_tax"]
    z = D.apply_spec(li, D.fit_spec(li.where("l_linestatus = 'F'"), cols[:1], cols[1:]), cols)
    return z.select("l_orderkey", "l_linenumber", *[F.round(f"z_{c}", 5).alias(f"z_{c}") for c in cols])


# ---- reference sets
@query("""with u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), d as (select a.vec_id, b.vec_id as r, sum((a.x - b.x) ** 2) as d from u a join u b on a.i = b.i and b.label = 0 group by 1, 2)
select vec_id, round(sqrt(min(d)), 5) as distance from d group by 1""")
def reference_distance(t):
    e = t("embeddings")
    return _cut(D.reference_distance(e, e.where("label = 0"), "vec_id", "embedding"), 5, "distance")


@query("""with u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from u group by 1, 2), n as (select label, sqrt(sum(m * m)) as n from c group by 1), v as (select vec_id, sqrt(sum(x * x)) as n from u group by 1),
s as (select vec_id, label, sum(x * m) as d from (select vec_id, i, x from u) join c using (i) group by 1, 2), r as (select s.vec_id, round(d / (v.n * n.n), 9) as s, row_number() over (partition by s.vec_id order by d / (v.n * n.n) desc) as k from s join v using (vec_id) join n using (label))
select vec_id, round(max(s), 5) as best, round(avg(s), 5) as coverage from r where k <= 3 group by 1""")
def mode_menu(t):
    e = t("embeddings")
    modes = vectors.mean_vector(e, "embedding", "label").withColumnRenamed("centre", "embedding")
    return _cut(D.mode_menu(e, modes, "vec_id", "embedding", 3), 5, "best", "coverage")


@query()
def gated_draw(t):
    d = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return D.gated_draw(d, "id", ["l_quantity", "l_extendedprice", "l_discount"], ["l_discount", "l_tax"], 40, 0.005, 11)
