"""More registered queries: regressions, resampling of units, agreement, sweeps, labels. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions import exprs as E
from gaugeline.operators import inference as I
from gaugeline.operators import learners as L
from gaugeline.operators import models, windows
from gaugeline.plans.catalogue import query, returned

HOURS = "(hour(ts) // 6)"


def _events(t):
    return t("events").withColumn("b", F.floor(F.hour("ts") / 6).cast("int"))


def _line_part(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))


# ---- regressions
@query("""with d as (select l_quantity - avg(l_quantity) over g as a, l_discount - avg(l_discount) over g as b, l_extendedprice - avg(l_extendedprice) over g as y, l_suppkey from lineitem window g as (partition by l_suppkey)),
s as (select count(*) as n, count(distinct l_suppkey) as g, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as yb, sum(y * y) as yy from d),
c as (select *, (bb * ay - ab * yb) / (aa * bb - ab * ab) as p, (aa * yb - ab * ay) / (aa * bb - ab * ab) as q from s), e as (select *, (yy - p * ay - q * yb) / (n - g - 2) as s2 from c)
select 'l_quantity' as term, round(p, 4) as coef, round(sqrt(s2 * bb / (aa * bb - ab * ab)), 4) as se from e union all select 'l_discount', round(q, 2), round(sqrt(s2 * aa / (aa * bb - ab * ab)), 2) from e""")
def ols_gram(t):
    c = I.ols(t("lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", "l_suppkey")
    shown = lambda x: F.when(F.col("term") == "l_discount", F.round(x, 2)).otherwise(F.round(x, 4)).alias(x)
    return c.select("term", shown("coef"), shown("se"))


@query("""with d as (select l_suppkey, l_quantity - avg(l_quantity) over (partition by l_suppkey) as a, l_extendedprice - avg(l_extendedprice) over (partition by l_suppkey) as b from lineitem), g as (select l_suppkey, sum(a * a) as xx, sum(a * b) as xy from d group by 1), s as (select sum(xy) / sum(xx) as slope, sum(xx) as xx, count(*) as n from g),
v as (select s.n, s.slope, sqrt(sum((g.xy - s.slope * g.xx) ** 2) * s.n / (s.n - 1)) / s.xx as se from g, s group by s.n, s.slope, s.xx) select n as groups, round(slope, 5) as slope, round(se, 5) as se, round((slope / se) ** 2, 2) as wald from v""")
def cluster_robust(t):
    return I.cluster_robust_slope(t("lineitem"), "l_quantity", "l_extendedprice", "l_suppkey")


@query()
def newton_logistic(t):
    d = t("documents").join(t("labels"), "doc_id").select(F.log1p("n_chars").alias("size"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("_caps"), "n_chars", "toxic")
    d = d.withColumn("caps", E.ratio("_caps", "n_chars"))
    return I.newton_logistic(d, ["size", "caps"], "toxic", ridge=1e-3).select("term", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"))


@query(f"""with c as (select event_type as a, {HOURS} as b, avg(value) as m from events group by 1, 2), d as (select *, avg(m) over (partition by a) as ma, avg(m) over (partition by b) as mb, avg(m) over () as mm from c)
select count(*) as cells, round(sum((ma - mm) ** 2), 5) as ss_a, round(sum((mb - mm) ** 2), 5) as ss_b, round(sum((m - ma - mb + mm) ** 2), 5) as ss_ab from d""")
def two_factor(t):
    return I.two_factor(_events(t), "event_type", "b", "value")


@query("""with a as (select user_id, event_type, value - avg(value) over (partition by user_id) as r from events), b as (select user_id, event_type, r - avg(r) over (partition by event_type) as r from a),
c as (select user_id, event_type, r - avg(r) over (partition by user_id) as r from b), d as (select r - avg(r) over (partition by event_type) as r from c) select count(*) as n, round(var_samp(r), 5) as variance from d""")
def two_way_demean(t):
    d = windows.alternating_demean(t("events").select("user_id", "event_type", "value"), "value", ["user_id", "event_type"], sweeps=2)
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.var_samp("resid"), 5).alias("variance"))


# ---- resampling and agreement
@query("""with u as (select user_id, sum(value) as s, count(value) as c from events group by 1), i as (select *, row_number() over (order by user_id) - 1 as i, count(*) over () as n from u),
d as (select rep, ('0x' || substr(md5(i || '#' || rep), 1, 8))::bigint % n as i from i, (select unnest(range(1, 41)) as rep)), m as (select rep, sum(s) / sum(c) as m from d join i using (i) group by 1)
select count(*) as reps, round(quantile_cont(m, 0.025), 5) as lo, round(quantile_cont(m, 0.975), 5) as hi from m""")
def cluster_bootstrap(t):
    return I.cluster_bootstrap(t("events"), "user_id", "value", 40)


@query("""with r as (select user_id, event_type, avg(value) as m, row_number() over (partition by user_id order by event_type) as i from events group by 1, 2), o as (select round(max(m), 9) as o from (select event_type, avg(m) as m from r group by 1)),
p as (select rep, user_id, event_type, row_number() over (partition by rep, user_id order by md5(user_id || '#' || event_type || '#' || rep), event_type) as i from r, (select unnest(range(1, 31)) as rep)),
n as (select rep, round(max(m), 9) as m from (select rep, p.event_type, avg(r.m) as m from p join r on p.user_id = r.user_id and p.i = r.i group by 1, 2) group by 1)
select round(o, 6) as observed, sum((m >= o)::int)::bigint as exceed, round((sum((m >= o)::int) + 1) / 31.0, 6) as p from n, o group by o""")
def max_stat_perm(t):
    return I.max_statistic(t("events"), "user_id", "event_type", "value", 30)


@query("""with c as (select l_returnflag as a, l_linestatus as b, count(*)::double as o from lineitem group by 1, 2), d as (select *, sum(o) over (partition by a) as ra, sum(o) over (partition by b) as rb, sum(o) over () as t from c),
s as (select max(t) as t, sum(o * (o - 1) / 2) as s, sum(o * (ra - 1) / 2) as sa, sum(o * (rb - 1) / 2) as sb, sum(o / t * ln(o * t / (ra * rb))) as mi, -sum(o / t * ln(ra / t)) as ha, -sum(o / t * ln(rb / t)) as hb from d)
select t::bigint as n, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) as ari, round(2 * mi / (ha + hb), 6) as nmi from s""")
def label_agreement(t):
    return I.agreement(t("lineitem"), "l_returnflag", "l_linestatus")


@query("with g as (select p_brand, count(*) as n, avg((l_returnflag = 'R')::int) as r from lineitem join part on l_partkey = p_partkey group by 1) select count(*) as groups, round(stddev_samp(r), 6) as sd, round(sqrt(greatest(var_samp(r) - avg(r * (1 - r) / n), 0)), 6) as sd_true from g")
def excess_spread(t):
    return I.excess_spread(_line_part(t), "p_brand", returned())


@query("with g as (select user_id, count(value) as n, sum(value) as s from events group by 1) select user_id, n, round((sum(s) over () - s) / (sum(n) over () - n), 6) as others from g")
def leave_one_out(t):
    return I.leave_one_out(t("events"), "user_id", "value")


@query("""with s as (select sum(w) as w, sum(w * x) as x, sum(w * y) as y, sum(w * x * x) as xx, sum(w * y * y) as yy, sum(w * x * y) as xy from (select l_extendedprice::double as x, l_discount::double as y, l_quantity::double as w from lineitem))
select round(x / w, 4) as mean_x, round(y / w, 6) as mean_y, round((xy / w - x / w * y / w) / sqrt((xx / w - (x / w) ** 2) * (yy / w - (y / w) ** 2)), 6) as r from s""")
def weighted_corr(t):
    return I.weighted_corr(t("lineitem"), "l_extendedprice", "l_discount", "l_quantity")


@query("with r as (select p_brand, count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem join part on l_partkey = p_partkey group by 1) select p_brand, n, round(tanh(n / (n + 20.0) * atanh(r)), 6) as shrunk from r where n >= 5")
def shrunk_correlation(t):
    r = _line_part(t).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.corr("l_quantity", "l_extendedprice").alias("r")).where("n >= 5")
    return r.select("p_brand", "n", F.round(E.shrunk_correlation("r", "n", 20.0), 6).alias("shrunk"))


@query("with d as (select value - avg(value) over (partition by event_type) as x, hour(ts) - avg(hour(ts)) over (partition by event_type) as y from events) select count(*) as n, round(corr(x, y), 6) as r from d")
def round_centred_corr(t):
    ev = t("events").withColumn("h", F.hour("ts"))
    return ev.select(windows.demean("value", "event_type").alias("x"), windows.demean("h", "event_type").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("with u as (select user_id, count(*) filter (where event_type = 'purchase') as n from events group by 1) select k, round(avg((n >= k)::int), 6) as share from u, (select unnest(range(1, 11)) as k) group by 1")
def tail_counts(t):
    u = t("events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("n"))
    tails = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.avg((F.col("n") >= k).cast("int")).alias("p")) for k in range(1, 11)])
    return u.agg(tails.alias("a")).select(F.explode("a").alias("x")).select("x.k", F.round("x.p", 6).alias("share"))


@query("""with u as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from u group by 1, 2),
p as (select a.label as a, b.label as b, (a.i <= 32) as h, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 9) as s from c a join c b on a.i = b.i and a.label < b.label group by 1, 2, 3),
w as (select a, b, max(case when h then s end) as x, max(case when not h then s end) as y from p group by 1, 2), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as y from w)
select count(*) as pairs, round(corr(x, y), 6) as spearman from r""")
def pair_similarity_corr(t):
    from gaugeline.operators import stats, vectors

    c = vectors.mean_vector(t("embeddings"), "embedding", "label")  # a row a label
    a, b = c.select(F.col("label").alias("la"), F.col("centre").alias("ca")), c.select(F.col("label").alias("lb"), F.col("centre").alias("cb"))
    part = lambda x, at: F.slice(x, at, 32)
    p = a.join(b, F.col("la") < F.col("lb")).select(*[F.round(E.cosine(part("ca", at), part("cb", at)), 9).alias(n) for n, at in (("x", 1), ("y", 33))])
    return stats.spearman(p, "x", "y").select(F.col("n").alias("pairs"), "spearman")


# ---- labels, ranks and folds
@query("select p_partkey, dense_rank() over (order by p_type) - 1 as code, round((p_size - min(p_size) over (partition by p_brand))::double / nullif(max(p_size) over (partition by p_brand) - min(p_size) over (partition by p_brand), 0), 6) as scaled from part")
def codes_and_scaling(t):
    p, w = t("part"), Window.partitionBy("p_brand")
    kinds = p.select("p_type").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("p_type")) - 1).cast("long"))  # ranks distinct values only
    lo, hi = F.min("p_size").over(w), F.max("p_size").over(w)
    return p.join(kinds, "p_type").select("p_partkey", "code", F.round(E.ratio(F.col("p_size") - lo, hi - lo), 6).alias("scaled"))


@query("""with g as (select p_brand, count(*) as n, avg((l_returnflag = 'R')::int) as r from lineitem join part on l_partkey = p_partkey group by 1)
select p_brand, case when r < 0.30 then 'weak' when r < 0.33 then 'soft' when r <= 0.36 then 'even' else 'strong' end || case when n < 100 then ' (few)' else '' end as verdict from g""")
def verdict_buckets(t):
    g = _line_part(t).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg(returned().cast("int")).alias("r"))
    v = F.when(F.col("r") < 0.30, "weak").when(F.col("r") < 0.33, "soft").when(F.col("r") <= 0.36, "even").otherwise("strong")
    return g.select("p_brand", F.concat(v, F.when(F.col("n") < 100, " (few)").otherwise("")).alias("verdict"))


@query("with r as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as a, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as b, round_even(count(*) over (partition by o_orderpriority) * 0.01, 0) as k from orders) select o_orderpriority, o_orderkey, case when a <= k then 'top' else 'bottom' end as side from r where a <= k or b <= k")
def top_and_bottom(t):
    w = Window.partitionBy("o_orderpriority")
    r = t("orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("a"), F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).alias("b"), F.bround(F.count(F.lit(1)).over(w) * 0.01).alias("k"))
    return r.where("a <= k or b <= k").select("o_orderpriority", "o_orderkey", F.when(F.col("a") <= F.col("k"), "top").otherwise("bottom").alias("side"))


@query("with k as (select p_size as v from part order by p_size desc limit 1 offset 49) select p_partkey, p_size from part, k where p_size >= v")
def kth_with_ties(t):
    p = t("part").select("p_partkey", "p_size")
    kth = p.orderBy(F.desc("p_size")).limit(50).agg(F.min("p_size").alias("v"))  # a bounded top-k, then one row
    return p.crossJoin(F.broadcast(kth)).where("p_size >= v").select("p_partkey", "p_size")


@query("with g as (select source, count(*) as n from documents where source is not null group by 1), i as (select *, (row_number() over (order by n desc, source) - 1) % 8 as i from g) select source, (case when i < 4 then i else 7 - i end)::bigint as fold, n from i")
def snake_folds(t):
    d = models.group_folds(t("documents").select("source"), "source", 4)
    return d.groupBy("source", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("""with v as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), p as (select vec_id, j, round(sum(case when substr(md5(i || '#' || j || '#0'), 1, 1) < '8' then x else -x end) / 2, 5) as p from v, (select unnest(range(1, 5)) as j) group by 1, 2)
select vec_id, max(case when j = 1 then p end) as p1, max(case when j = 2 then p end) as p2, max(case when j = 3 then p end) as p3, max(case when j = 4 then p end) as p4 from p group by 1""")
def sign_projection(t):
    return I.sign_projection(t("embeddings"), "vec_id", "embedding", 64, 4)


# ---- gates, eliminations and sweeps
@query("""with m as (select event_type, cast(ts as date) as d, avg(value) as x from events group by 1, 2), c as (select cast(ts as date) as d, avg(value) as x from events group by 1), e as (select event_type, day(m.d) % 2 as h, m.x - c.x as z from m join c using (d)),
g as (select event_type, avg(z) as z, avg(case when h = 0 then z end) as a, avg(case when h = 1 then z end) as b from e group by 1) select event_type, round(z, 6) as advantage, abs(z) > 0.5 and sign(a) = sign(b) and sign(a) = sign(z) as passes from g""")
def paired_gate(t):
    ev = t("events").select("event_type", "value", F.to_date("ts").alias("d"))
    w = Window.partitionBy("d")
    cells = ev.groupBy("event_type", "d").agg(F.avg("value").alias("x"), F.sum("value").alias("s"), F.count("value").alias("n"))
    e = cells.select("event_type", (F.day("d") % 2).alias("h"), (F.col("x") - F.sum("s").over(w) / F.sum("n").over(w)).alias("z"))
    g = e.groupBy("event_type").agg(F.avg("z").alias("z"), F.avg(F.when(F.col("h") == 0, F.col("z"))).alias("a"), F.avg(F.when(F.col("h") == 1, F.col("z"))).alias("b"))
    return g.select("event_type", F.round("z", 6).alias("advantage"), ((F.abs("z") > 0.5) & (F.signum("a") == F.signum("b")) & (F.signum("a") == F.signum("z"))).alias("passes"))


@query("""with s as (select p_brand, l_linenumber as g, sum(l_quantity)::double as s, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2),
a as (select p_brand, row_number() over (order by round(sum(s) / nullif(sum(n), 0), 9) desc nulls last, p_brand) as k, count(*) over () as c from (select p_brand, case when g <= 1 then s end as s, case when g <= 1 then n end as n from s) group by 1), r1 as (select p_brand from a where k <= ceil(c / 2.0)),
b as (select p_brand, row_number() over (order by round(sum(s) / nullif(sum(n), 0), 9) desc nulls last, p_brand) as k, count(*) over () as c from (select p_brand, case when g <= 2 then s end as s, case when g <= 2 then n end as n from s join r1 using (p_brand)) group by 1), r2 as (select p_brand from b where k <= ceil(c / 2.0)),
d as (select p_brand, row_number() over (order by round(sum(s) / nullif(sum(n), 0), 9) desc nulls last, p_brand) as k, count(*) over () as c from (select p_brand, case when g <= 3 then s end as s, case when g <= 3 then n end as n from s join r2 using (p_brand)) group by 1), r3 as (select p_brand from d where k <= ceil(c / 2.0))
select p_brand, case when p_brand in (from r3) then 3 when p_brand in (from r2) then 2 when p_brand in (from r1) then 1 else 0 end as survived from (select distinct p_brand from s)""")
def halving(t):
    return I.halving(_line_part(t).select("p_brand", "l_linenumber", "l_quantity"), "p_brand", "l_linenumber", "l_quantity", 3)


@query(f"""with e as (select event_type, {HOURS} as b, cast(ts as date) as d, avg(value) as x from events group by 1, 2, 3), r as (select b, d, avg(x) as x from e group by 1, 2), p as (select event_type, e.b, count(*) as n, avg(e.x - r.x) as m, stddev_samp(e.x - r.x) as s from e join r using (b, d) group by 1, 2)
select event_type, min(case when n > 1 and m - 1.96 * s / sqrt(n) > 0 then b end)::int as lowest from p group by 1""")
def transfer_threshold(t):
    e = _events(t).groupBy("event_type", "b", F.to_date("ts").alias("d")).agg(F.avg("value").alias("x"))
    e = e.withColumn("z", F.col("x") - F.avg("x").over(Window.partitionBy("b", "d")))
    p = e.groupBy("event_type", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    return p.groupBy("event_type").agg(F.min(F.when((F.col("n") > 1) & (F.col("m") - 1.96 * F.col("s") / F.sqrt("n") > 0), F.col("b"))).alias("lowest"))


REGIONS = [("calm", "a", 0.2, 0.5, 40.0), ("calm", "b", 0.6, 0.3, 80.0), ("calm", "c", 0.4, 0.4, 10.0), ("hard", "a", 0.1, 0.8, 60.0), ("hard", "b", 0.3, 0.1, 20.0), ("hard", "c", 0.5, 0.2, 90.0)]


@query(f"""with r(regime, name, base, headroom, tau) as (values {", ".join(map(str, REGIONS))}), x as (select regime, name, base, headroom, seed, tau * (1 + ('0x' || substr(md5(name || '#' || seed), 1, 4))::bigint / 65536.0) as tau from r, (select unnest(range(0, 6)) as seed)),
g as (select *, headroom * (exp(-5.0 * j / tau) - exp(-5.0 * (j + 1) / tau)) as gain from x, (select unnest(range(0, 24)) as j)), k as (select *, row_number() over (partition by regime, seed order by gain desc, name, j) as i from g), b as (select unnest([30, 60, 120]) as budget),
o as (select regime, seed, budget, sum(gain) as best from k, b where i <= budget / 5 group by 1, 2, 3), e as (select regime, seed, budget, sum(headroom * (1 - exp(-(budget / 3.0) / tau))) as even from x, b group by 1, 2, 3)
select regime, budget, count(*) as seeds, round(avg(best - even), 6) as regret, round(1.96 * stddev_samp(best - even) / sqrt(count(*)), 6) as half from o join e using (regime, seed, budget) group by 1, 2""")
def regret_sweep(t):
    r = t("region").sparkSession.createDataFrame(REGIONS, "regime string, name string, base double, headroom double, tau double")
    x = r.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(5))))
    x = x.withColumn("tau", F.col("tau") * (1 + F.conv(F.substring(F.md5(F.concat_ws("#", "name", F.col("seed").cast("string"))), 1, 4), 16, 10).cast("long") / 65536.0))
    left = lambda j: F.exp(-5.0 * j / F.col("tau"))
    g = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("gain", F.col("headroom") * (left(F.col("j")) - left(F.col("j") + 1)))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("regime", "seed").orderBy(F.desc("gain"), "name", "j")))
    budgets = F.explode(F.array(*[F.lit(b) for b in (30, 60, 120)]))
    best = g.withColumn("budget", budgets).where("i <= budget / 5").groupBy("regime", "seed", "budget").agg(F.sum("gain").alias("best"))
    even = x.withColumn("budget", budgets).groupBy("regime", "seed", "budget").agg(F.sum(E.saturating(F.lit(0.0), "headroom", "tau", F.col("budget") / 3.0)).alias("even"))
    d = best.join(even, ["regime", "seed", "budget"]).withColumn("d", F.col("best") - F.col("even"))
    return d.groupBy("regime", "budget").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("d"), 6).alias("regret"), F.round(1.96 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))), 6).alias("half"))


PLANS = [("even", 40.0, 30.0, 30.0), ("greedy", 48.0, 90.0, 60.0), ("probe", 65.0, 50.0, 50.0)]


@query(f"""with p(allocator, used, a, b) as (values {", ".join(map(str, PLANS))}), c as (select *, least(1.0, 100.0 / (a + b)) as f from p), v as (select allocator, used > 50.0 as over, 0.5 * (1 - exp(-a * f / 40.0)) + 0.3 * (1 - exp(-b * f / 80.0)) as v from c)
select allocator, over, round(case when not over then v end, 6) as value, round(case when not over then max(case when not over then v end) over () - v end, 6) as regret from v""")
def proxy_eval_budget(t):
    p = t("region").sparkSession.createDataFrame(PLANS, "allocator string, used double, a double, b double")
    f = F.least(F.lit(1.0), 100.0 / (F.col("a") + F.col("b")))
    v = E.saturating(F.lit(0.0), F.lit(0.5), F.lit(40.0), F.col("a") * f) + E.saturating(F.lit(0.0), F.lit(0.3), F.lit(80.0), F.col("b") * f)
    rows = p.select("allocator", (F.col("used") > 50.0).alias("over"), v.alias("v")).withColumn("v", F.when(~F.col("over"), F.col("v")))
    return rows.select("allocator", "over", F.round("v", 6).alias("value"), F.round(F.max("v").over(Window.partitionBy()) - F.col("v"), 6).alias("regret"))


@query("""with a as (select c_mktsegment, c_nationkey, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by 1, 2), b as (select c_mktsegment, c_nationkey, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' group by 1, 2)
select c_mktsegment, count(*) as pairs, round(avg(a.m - b.m), 4) as delta, sum((a.m > b.m)::int)::bigint as better from a join b using (c_mktsegment, c_nationkey) group by 1""")
def paired_arm_delta(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    m = o.groupBy("c_mktsegment", "c_nationkey").agg(of("F").alias("a"), of("O").alias("b")).dropna()  # one shuffle in place of two and a join
    return m.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("a") - F.col("b")), 4).alias("delta"), F.sum((F.col("a") > F.col("b")).cast("int")).alias("better"))


# ---- learners: sequential or iterative, so without SQL; the tests hold them against brute force
@query()
def ucb_race(t):
    return _race(t, "ucb1")


@query()
def exp3_race(t):
    return _race(t, "exp3")


def _race(t, rule):
    arms = _line_part(t).groupBy("p_brand").agg(F.avg(returned().cast("int")).alias("rate"))
    return L.race(arms, "p_brand", "rate", 8, 300, rule)


@query()
def determinantal(t):
    return L.determinantal(t("embeddings"), "vec_id", "embedding", 12).withColumn("gain", F.round("gain", 6))


@query()
def mutual_information(t):
    return L.mutual_information(t("lineitem").withColumn("k", F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey")), "k", "l_quantity", "l_extendedprice")
