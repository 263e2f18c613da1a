"""Registry of queries on the star-schema tables and of the SQL that they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions import exprs as E
from gaugeline.operators import alloc, joins, models, rates, stats, vectors, windows
from gaugeline.streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of tables: f(t), where t("orders") reads a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WILSON = """case when n = 0 then null else round(least(greatest(((k::double / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n)
  {s} sqrt((k::double / n) * (1 - k::double / n) / n + 3.8416 / (4.0 * n * n)) * 1.96 / (1 + 3.8416 / n), 0.0), 1.0), 6) end"""
LO, HI = WILSON.format(s="-"), WILSON.format(s="+")


def failed():
    return F.col("o_orderstatus") == "F"


def returned():
    return F.col("l_returnflag") == "R"



# ---- rates
@query(f"with g as (select o_orderpriority as category, count(*) as n, sum((o_orderstatus = 'F')::int)::bigint as k from orders group by 1) select category, n, k, round(k::double / n, 6) as rate, {LO} as lo, {HI} as hi from g")
def weak_region_rates(t):
    return rates.rate_block(t("orders").withColumnRenamed("o_orderpriority", "category"), ["category"], failed()).orderBy("rate", "category")


@query("""select case when grouping(status) = 0 then 'status' when grouping(priority) = 0 then 'priority' when grouping(year) = 0 then 'year' else 'overall' end as dimension,
coalesce(status, priority, year, 'all') as bucket, count(*) as n, sum(y)::bigint as k, round(sum(y)::double / count(*), 6) as rate from
(select o_orderstatus as status, o_orderpriority as priority, year(o_orderdate)::varchar as year, (o_totalprice > 150000)::int as y from orders) group by grouping sets ((), (status), (priority), (year))""")
def multi_dim_summary(t):
    o = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 150000).alias("y"))
    return rates.summary(o, ["status", "priority", "year"], "y")


BUCKETS = """with r as (select p_brand as brand, p_type as kind, (l_returnflag = 'R')::int as y from lineitem join part on l_partkey = p_partkey),
b as (select 'brand' as dimension, brand as bucket, count(*) as n, sum(y)::bigint as k from r group by 2 union all select 'kind', kind, count(*), sum(y)::bigint from r group by 2)"""


@query(BUCKETS + " select dimension, bucket, n, k, round(k::double / n, 6) as rate from b where n >= 100 order by rate, dimension, bucket limit 3")
def pooled_weakest_buckets(t):
    r = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), returned().alias("y"))
    return rates.weakest(rates.summary(r, ["brand", "kind"], "y"), 100, 3)


@query("""with p as (select p_partkey, p_size, p_retailprice, row_number() over (order by p_size, p_partkey) as i, row_number() over (order by p_retailprice, p_partkey) as j, count(*) over () as n from part),
e as (select max(case when i = n // 3 + 1 then p_size end) as s1, max(case when i = 2 * n // 3 + 1 then p_size end) as s2, max(case when j = n // 3 + 1 then p_retailprice end) as r1, max(case when j = 2 * n // 3 + 1 then p_retailprice end) as r2 from p)
select case when p_size < s1 then 'near' when p_size < s2 then 'mid' else 'far' end || '-' || case when p_retailprice < r1 then 'left' when p_retailprice < r2 then 'center' else 'right' end as region, count(*) as n from p, e group by 1""")
def tertile_regions(t):
    p = t("part")
    edges = models.order_edges(p, ["p_size", "p_retailprice"], "p_partkey", 3)
    label = lambda v, e, names: F.when(F.col(v) < F.col(e)[0], names[0]).when(F.col(v) < F.col(e)[1], names[1]).otherwise(names[2])
    return p.crossJoin(F.broadcast(edges)).groupBy(F.concat(label("p_size", "p_size_edges", ("near", "mid", "far")), F.lit("-"), label("p_retailprice", "p_retailprice_edges", ("left", "center", "right"))).alias("region")).agg(F.count(F.lit(1)).alias("n"))


STAGE = "case when l_returnflag = 'N' then 'success' when l_discount > 0.07 then 'fail_late' when l_quantity > 30 then 'fail_transport' when l_tax > 0.04 then 'no_grasp' else 'never' end"


@query(f"select {STAGE} as stage, count(*) as n, round(avg((l_quantity > 25)::int), 6) as p_large, round(avg(case when l_discount <= 0.07 then (l_returnflag = 'N')::int end), 6) as p_success_given_low from lineitem group by 1")
def stage_case_funnel(t):
    stage = F.when(F.col("l_returnflag") == "N", "success").when(F.col("l_discount") > 0.07, "fail_late").when(F.col("l_quantity") > 30, "fail_transport").when(F.col("l_tax") > 0.04, "no_grasp").otherwise("never")
    return t("lineitem").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("l_quantity") > 25).cast("int")), 6).alias("p_large"), F.round(F.avg(F.when(F.col("l_discount") <= 0.07, (F.col("l_returnflag") == "N").cast("int"))), 6).alias("p_success_given_low"))


@query("select p_brand, n, round((8.0 * mu + s) / (8.0 + n), 6) as encoded from (select p_brand, count(*) as n, sum((l_returnflag = 'R')::int)::double as s from lineitem join part on l_partkey = p_partkey group by 1), (select avg((l_returnflag = 'R')::int) as mu from lineitem where l_partkey in (select p_partkey from part))")
def target_encoding(t):
    return rates.shrunken_rate(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", returned(), 8.0)


@query("with g as (select l_suppkey, count(*) as n, avg((l_returnflag = 'R')::int) as r from lineitem group by 1) select l_suppkey, n, round(r * n / (n + 20.0), 6) as shrunk from g")
def eb_shrink(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg(returned().cast("int")).alias("r"))
    return g.select("l_suppkey", "n", F.round(F.col("r") * F.col("n") / (F.col("n") + 20.0), 6).alias("shrunk"))


@query("""with g as (select p_brand, count(*) as n, sum((l_returnflag = 'R')::int)::bigint as f from lineitem join part on l_partkey = p_partkey group by 1)
select p_brand, n, f as fails, round(f::double / n, 6) as p_fail, round(f::double / sum(f) over (), 6) as fail_share, round(n::double / sum(n) over (), 6) as base_share, round(sum(least(f::double / sf, n::double / sn)) over (), 6) as overlap from g, (select sum(f) as sf, sum(n) as sn from g)""")
def failure_profile_overlap(t):
    p = rates.failure_profile(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", returned())
    p = p.withColumn("overlap", F.sum(F.least("fail_share", "base_share")).over(Window.partitionBy()))
    return p.select("p_brand", "n", "fails", *[F.round(c, 6).alias(c) for c in ("p_fail", "fail_share", "base_share", "overlap")])


BAND = "case when l_quantity > 0 and l_quantity <= 10 then 0 when l_quantity <= 25 then 1 when l_quantity <= 40 then 2 when l_quantity <= 50 then 3 end"


@query(f"select l_returnflag, round(avg(case when b = 0 then l_extendedprice end), 4) as b0, round(avg(case when b = 1 then l_extendedprice end), 4) as b1, round(avg(case when b = 2 then l_extendedprice end), 4) as b2, round(avg(case when b = 3 then l_extendedprice end), 4) as b3 from (select *, {BAND} as b from lineitem) group by 1")
def pivot_bands(t):
    x = t("lineitem").select("l_returnflag", "l_extendedprice", E.cut_right("l_quantity", [0, 10, 25, 40, 50]).alias("b"))
    p = x.groupBy("l_returnflag").pivot("b", [0, 1, 2, 3]).agg(F.avg("l_extendedprice"))
    return p.select("l_returnflag", *[F.round(F.col(str(i)), 4).alias(f"b{i}") for i in range(4)])


@query("select l_returnflag, l_linestatus, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by l_returnflag), 6) as share from lineitem group by 1, 2")
def crosstab_share(t):
    return rates.shares(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"])


@query("select count(*) filter (where k = 3) as shared_by_all, count(*) as total from (select o_custkey, count(distinct o_orderstatus) as k from orders group by 1)")
def incidence(t):
    k = t("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("k"))
    return k.agg(F.count(F.when(F.col("k") == 3, 1)).alias("shared_by_all"), F.count(F.lit(1)).alias("total"))


@query("""with g as (select avg((o_totalprice > 200000)::int) as share, avg(case when o_totalprice > 200000 and o_orderpriority = '1-URGENT' then (o_orderstatus = 'F')::int end) - avg(case when o_totalprice > 200000 and o_orderpriority = '5-LOW' then (o_orderstatus = 'F')::int end) as dt,
avg(case when o_totalprice <= 200000 and o_orderpriority = '1-URGENT' then (o_orderstatus = 'F')::int end) - avg(case when o_totalprice <= 200000 and o_orderpriority = '5-LOW' then (o_orderstatus = 'F')::int end) as dother from orders)
select round(share, 6) as share, round(dt, 6) as d_target, round(dother, 6) as d_other, round(share * dt + (1 - share) * dother, 6) as total from g""")
def gain_decomposition(t):
    big, y = F.col("o_totalprice") > 200000, failed().cast("int")
    d = lambda m: F.avg(F.when(m & (F.col("o_orderpriority") == "1-URGENT"), y)) - F.avg(F.when(m & (F.col("o_orderpriority") == "5-LOW"), y))
    g = t("orders").agg(F.avg(big.cast("int")).alias("share"), d(big).alias("d_target"), d(~big).alias("d_other"))
    return g.withColumn("total", F.col("share") * F.col("d_target") + (1 - F.col("share")) * F.col("d_other")).select(*[F.round(c, 6).alias(c) for c in ("share", "d_target", "d_other", "total")])


@query("""with e as (select user_id, d from (select distinct user_id from events), (select distinct cast(ts as date) as d from events)), f as (select user_id, cast(ts as date) as d, count(*) as n from events where event_type = 'view' group by 1, 2)
select user_id, cast(d as varchar) as d, coalesce(n, 0) as n, case when n is null then 'missing' else 'doubled' end as problem from e left join f using (user_id, d) where coalesce(n, 0) <> 1""")
def completeness_check(t):
    ev = t("events").withColumn("d", F.to_date("ts").cast("string"))
    return rates.exactly_once(ev.select("user_id").distinct().crossJoin(F.broadcast(ev.select("d").distinct())), ev.where("event_type = 'view'"), ["user_id", "d"])


@query("select c_mktsegment, count(*) as repeats, round(avg(m), 6) as mean from (select c_mktsegment, c_nationkey, avg(c_acctbal) as m from customer group by 1, 2) group by 1")
def nested_mean_strata(t):
    return rates.nested_mean(t("customer"), ["c_mktsegment"], ["c_nationkey"], "c_acctbal")


@query("select user_id, count(*) as n, sum((event_type = 'purchase')::int)::bigint as k, (sum((event_type = 'purchase')::int) > 0 and sum((event_type = 'purchase')::int) < count(*)) as flip from events group by 1")
def flip_table(t):
    y = (F.col("event_type") == "purchase").cast("int")
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("k")).withColumn("flip", (F.col("k") > 0) & (F.col("k") < F.col("n")))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("""with c as (select user_id, event_type, count(*)::double as n from events group by 1, 2), u as (select user_id, sum(n) as n from c group by 1), g as (select event_type, sum(n) / (select sum(n) from c) as q from c group by 1),
p as (select u.user_id, g.event_type, coalesce(c.n, 0) / u.n as p, g.q from u cross join g left join c on c.user_id = u.user_id and c.event_type = g.event_type)
select user_id, round(sum(coalesce(case when p > 0 then p * log2(2 * p / (p + q)) end, 0) + coalesce(case when q > 0 then q * log2(2 * q / (p + q)) end, 0)) / 2, 6) as js from p group by 1""")
def stage_distribution_js(t):
    ev = t("events")
    mix = [F.avg((F.col("event_type") == x).cast("double")) for x in TYPES]
    return ev.groupBy("user_id").agg(F.array(*mix).alias("p")).crossJoin(F.broadcast(ev.agg(F.array(*mix).alias("q")))).select("user_id", F.round(E.js_divergence(F.col("p"), F.col("q")), 6).alias("js"))


@query("select count(*) as groups, round(sum(v * (n - 1)) / sum(n - 1), 4) as pooled from (select user_id, count(value) as n, var_samp(value) as v from events group by 1) where n > 1")
def pooled_noise(t):
    return rates.pooled_variance(t("events"), "user_id", "value")


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as lo, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as q90, round(max(value), 6) as hi from events group by 1")
def describe_groups(t):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.min("value"), 6).alias("lo"), p(0.5).alias("median"), p(0.9).alias("q90"), F.round(F.max("value"), 6).alias("hi"))


@query("select coalesce(c_mktsegment, 'random') as arm, count(*) as n from customer group by rollup(c_mktsegment)")
def rollup_all_row(t):
    return t("customer").rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("c_mktsegment", F.lit("random")).alias("arm"), "n")


@query("select p_brand, p_type as dominant, n from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by 1, 2) where r = 1")
def dominant_label(t):
    c = t("part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.capped(c, "p_brand", [F.desc("n"), "p_type"], 1).select("p_brand", F.col("p_type").alias("dominant"), "n")


@query("""with m as (select quantile_cont(p_size, 0.5) as s from part) select round(avg(case when p_size <= s then p_retailprice end), 4) as low, round(avg(case when p_size > s then p_retailprice end), 4) as high, sum((p_size <= s)::int)::bigint as n_low from part, m""")
def median_split(t):
    p = t("part")
    m = p.agg(F.percentile("p_size", F.lit(0.5)).alias("s"))
    return p.crossJoin(F.broadcast(m)).agg(F.round(F.avg(F.when(F.col("p_size") <= F.col("s"), F.col("p_retailprice"))), 4).alias("low"), F.round(F.avg(F.when(F.col("p_size") > F.col("s"), F.col("p_retailprice"))), 4).alias("high"), F.sum((F.col("p_size") <= F.col("s")).cast("int")).alias("n_low"))


@query("with r as (select c_nationkey as g, avg((c_acctbal > 0)::int) as rate from customer group by 1), q as (select s_nationkey as g, count(*)::double / (select count(*) from supplier) as q from supplier group by 1) select round(sum(q * rate), 6) as score, count(*) as regions from r join q using (g)")
def weighted_region_score(t):
    r = t("customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.avg((F.col("c_acctbal") > 0).cast("int")).alias("rate"))
    q = t("supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.count(F.lit(1)).alias("n")).withColumn("q", E.ratio("n", F.sum("n").over(Window.partitionBy())))
    return r.join(q, "g").agg(F.round(F.sum(F.col("q") * F.col("rate")), 6).alias("score"), F.count(F.lit(1)).alias("regions"))


@query("with m as (select user_id, event_type, avg(value) as m from events group by 1, 2) select user_id, round(avg(case when event_type = 'purchase' then m end) - avg(case when event_type <> 'purchase' then m end), 6) as contrast from m group by 1")
def own_vs_other(t):
    m = t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    own = F.col("event_type") == "purchase"
    return m.groupBy("user_id").agg(F.round(F.avg(F.when(own, F.col("m"))) - F.avg(F.when(~own, F.col("m"))), 6).alias("contrast"))


@query("select o_orderstatus, round(100 * avg((o_orderpriority in ('1-URGENT', '2-HIGH'))::int), 6) as share from orders group by 1")
def selection_share(t):
    return t("orders").groupBy("o_orderstatus").agg(F.round(100 * F.avg(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")), 6).alias("share"))


# ---- windows
@query("with d as (select event_type, value - avg(value) over (partition by user_id) as d from events) select event_type, count(*) as n, round(avg(d), 6) as effect from d group by 1")
def run_demeaned_effect(t):
    d = t("events").select("event_type", windows.demean("value", "user_id").alias("d"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("effect"))


@query("select doc_id, round(case when count(*) over (partition by source) < 60 then (n_chars - avg(n_chars) over (partition by lang)) / greatest(stddev_pop(n_chars) over (partition by lang), 1e-9) else (n_chars - avg(n_chars) over (partition by source)) / greatest(stddev_pop(n_chars) over (partition by source), 1e-9) end, 5) as z from documents")
def group_zscore_fallback(t):
    return t("documents").select("doc_id", F.round(windows.zscore("n_chars", "source", "lang", 60), 5).alias("z"))


@query("with d as (select l_extendedprice as x, avg(l_extendedprice) over (partition by l_partkey) as m from lineitem) select round(var_samp(m) / var_samp(x), 6) as between_share, round(var_samp(x - m) / var_samp(x), 6) as within_share from d")
def within_between_variance(t):
    d = t("lineitem").select(F.col("l_extendedprice").alias("x"), F.avg("l_extendedprice").over(Window.partitionBy("l_partkey")).alias("m"))
    return d.agg(F.round(F.var_samp("m") / F.var_samp("x"), 6).alias("between_share"), F.round(F.var_samp(F.col("x") - F.col("m")) / F.var_samp("x"), 6).alias("within_share"))


@query("select tile, count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from (select o_totalprice, ntile(10) over (order by o_totalprice, o_orderkey) - 1 as tile from orders) group by 1")
def equal_count_tiles(t):
    x = windows.tiles(t("orders"), 10, ["o_totalprice", "o_orderkey"]).withColumn("tile", F.col("tile").cast("long"))
    return x.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("""with r as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1 as i, count(*) over (partition by o_orderstatus) as m from orders), k as (select unnest(range(0, 5)) as j)
select distinct o_orderstatus, o_orderkey from r, k where i = round_even(j * (m - 1) / 4.0, 0)::bigint""")
def even_picks(t):
    return windows.even_picks(t("orders"), 5, ["o_orderstatus"], ["o_totalprice", "o_orderkey"]).select("o_orderstatus", "o_orderkey")


@query("select tile, count(*) as n, round(avg(n_chars), 4) as mean_chars, round(avg(quality), 6) as rate from (select n_chars, quality, ntile(10) over (order by n_chars, doc_id) - 1 as tile from documents join labels using (doc_id)) group by 1")
def calibration_bins(t):
    d = windows.tiles(t("documents").join(t("labels"), "doc_id").select("doc_id", "n_chars", "quality"), 10, ["n_chars", "doc_id"])
    return d.groupBy(F.col("tile").cast("long").alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg("quality"), 6).alias("rate"))


@query("""with e as (select quantile_cont(p_retailprice, 0.25) as a, quantile_cont(p_retailprice, 0.5) as b, quantile_cont(p_retailprice, 0.75) as c from part)
select case when p_retailprice <= a then 0 when p_retailprice <= b then 1 when p_retailprice <= c then 2 else 3 end as bin, count(*) as n, round(avg(p_size), 6) as mean, round(stddev_samp(p_size) / sqrt(count(*)), 6) as se from part, e group by 1""")
def qcut_curve(t):
    p = t("part")
    e = p.agg(F.percentile("p_retailprice", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("e"))
    b = F.when(F.col("p_retailprice") <= F.col("e")[0], 0).when(F.col("p_retailprice") <= F.col("e")[1], 1).when(F.col("p_retailprice") <= F.col("e")[2], 2).otherwise(3)
    return p.crossJoin(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_size"), 6).alias("mean"), F.round(F.stddev_samp("p_size") / F.sqrt(F.count(F.lit(1))), 6).alias("se"))


@query(f"select {BAND} as band, count(*) as n from lineitem group by 1")
def cut_bands(t):
    return t("lineitem").groupBy(E.cut_right("l_quantity", [0, 10, 25, 40, 50]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("select (l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 40)::int as bin, count(*) as n, round(avg(l_discount), 6) as mean from lineitem group by 1")
def digitize_curve(t):
    return t("lineitem").groupBy(E.digitize("l_quantity", [10, 20, 40]).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("with e as (select min(p_retailprice) as a, max(p_retailprice) as b from part) select greatest(1, ceil((p_retailprice - a) / ((b - a) / 4)))::int as bin, count(*) as n from part, e group by 1")
def width_grid(t):
    p = t("part")
    e = p.agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    return p.crossJoin(F.broadcast(e)).groupBy(E.equal_width("p_retailprice", "a", "b", 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select user_id, ts, value, event_id, value - lag(value) over (partition by user_id order by ts, event_id) as v from events), j as (select *, v - lag(v) over (partition by user_id order by ts, event_id) as a from e) select user_id, count(*) as n, round(sum(abs(v)), 4) as path, round(avg(abs(a)), 6) as jerk from j group by 1")
def velocity_jerk(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").withColumn("v", F.col("value") - F.lag("value").over(w))
    e = e.withColumn("a", F.col("v") - F.lag("v").over(w))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("v")), 4).alias("path"), F.round(F.avg(F.abs("a")), 6).alias("jerk"))


@query("""with r as (select user_id, event_id, event_type in ('view', 'click') as c, row_number() over (partition by user_id order by event_id) as n from events), h as (select *, n - row_number() over (partition by user_id order by event_id) as g from r where c)
select user_id, min(event_id) as start, count(*) as length from h group by user_id, g having count(*) >= 3""")
def runs_of_condition(t):
    return windows.islands(t("events"), "user_id", ["event_id"], F.col("event_type").isin("view", "click")).where("length >= 3")


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as first from lineitem")
def offsets(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", windows.prefix_offsets("l_quantity", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).alias("first"))


# ---- joins and sets
@query("""with a as (select o_custkey, avg(o_totalprice) as x from orders where year(o_orderdate) = 1996 group by 1), b as (select o_custkey, avg(o_totalprice) as x from orders where year(o_orderdate) = 1997 group by 1)
select count(*) as pairs, round(avg(a.x - b.x), 4) as delta, round(avg(((a.x > 150000) = (b.x > 150000))::int), 6) as agreement from a join b using (o_custkey)""")
def paired_agreement(t):
    o = t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("x"))
    p = joins.paired(o.where("y = 1996"), o.where("y = 1997"), ["o_custkey"], "x")
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("d"), 4).alias("delta"), F.round(F.avg(((F.col("a") > 150000) == (F.col("b") > 150000)).cast("int")), 6).alias("agreement"))


@query("select p_partkey from part p where p_partkey % 3 <> 0 and not exists (select 1 from part u where u.p_partkey % 3 = 0 and u.p_brand = p.p_brand and sqrt((p.p_size - u.p_size) ** 2 + (p.p_retailprice - u.p_retailprice) ** 2) < 6)")
def theta_gate_anti(t):
    p = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return joins.epsilon_gate(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), "p_brand", "p_size", "p_retailprice", 6.0).select("p_partkey")


@query("select a.p_partkey as a, b.p_partkey as b, round(sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2), 6) as distance from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey where sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) < 3")
def near_dup_pairs(t):
    return joins.near_pairs(t("part"), "p_partkey", "p_brand", "p_size", "p_retailprice", 3.0)


@query("with m as (select cast(cast(ts as date) as varchar) as day, event_type, avg(value) as m from events group by 1, 2) select a.day, a.event_type, round(a.m - c.m, 6) as delta from m a join m c on a.day = c.day and c.event_type = 'view' where a.event_type <> 'view'")
def round_control_delta(t):
    return joins.control_delta(t("events").withColumn("day", F.to_date("ts").cast("string")), "day", "event_type", "view", "value")


@query("""with p as (select p_partkey, p_brand, p_size // 10 as bin, p_type from part where p_brand in ('Brand#1', 'Brand#2')), k as (select bin, p_type, least(count(*) filter (where p_brand = 'Brand#1'), count(*) filter (where p_brand = 'Brand#2')) as k from p group by 1, 2),
r as (select *, row_number() over (partition by p_brand, bin, p_type order by md5(p_partkey || '#0'), p_partkey) as r from p) select r.bin::bigint as bin, r.p_type, p_partkey, case when p_brand = 'Brand#1' then 'a' else 'b' end as side from r join k on r.bin = k.bin and r.p_type = k.p_type where r <= k""")
def exact_matching(t):
    p = t("part").withColumn("bin", F.floor(F.col("p_size") / 10))
    return joins.exact_match(p.where("p_brand = 'Brand#1'"), p.where("p_brand = 'Brand#2'"), ["bin", "p_type"], "p_partkey")


@query("select (select count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier)) as shared, (select count(*) from (select distinct o_custkey from orders where o_orderstatus = 'F') f where not exists (select 1 from orders o where o.o_orderstatus = 'P' and o.o_custkey = f.o_custkey)) as only_f, (select count(*) from (select c_custkey as k from customer union select s_suppkey from supplier)) as either")
def set_ops(t):
    o = t("orders")
    shared = t("customer").select("c_nationkey").intersect(t("supplier").select("s_nationkey")).agg(F.count(F.lit(1)).alias("shared"))
    only = o.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("only_f"))
    either = t("customer").select(F.col("c_custkey").alias("k")).union(t("supplier").select("s_suppkey")).distinct().agg(F.count(F.lit(1)).alias("either"))
    return shared.crossJoin(only).crossJoin(either)


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def dedup_first(t):
    return windows.capped(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 1).select("o_custkey", "o_orderkey")


@query("select (select count(*) from (select l_returnflag, l_quantity from lineitem where l_linenumber = 1 except all select l_returnflag, l_quantity from lineitem where l_linenumber = 2)) as only_a, (select count(*) from (select l_returnflag, l_quantity from lineitem where l_linenumber = 2 except all select l_returnflag, l_quantity from lineitem where l_linenumber = 1)) as only_b")
def multiset_equal(t):
    a, b = (t("lineitem").where(F.col("l_linenumber") == i).select("l_returnflag", "l_quantity") for i in (1, 2))
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b")))


@query("with x(brand, ref) as (values ('Brand#1', 0.2), ('Brand#2', 0.3), ('Brand#3', 0.25), ('Brand#4', 0.4), ('Brand#99', 0.1)), r as (select p_brand, avg((l_returnflag = 'R')::int) as r from lineitem join part on l_partkey = p_partkey group by 1) select count(r.r) as n, round(corr(r.r, x.ref::double), 6) as r from x left join r on r.p_brand = x.brand")
def external_table_corr(t):
    x = t("part").sparkSession.createDataFrame([("Brand#1", 0.2), ("Brand#2", 0.3), ("Brand#3", 0.25), ("Brand#4", 0.4), ("Brand#99", 0.1)], "brand string, ref double")
    r = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.avg(returned().cast("int")).alias("r"))
    return x.join(r, x.brand == r.p_brand, "left").agg(F.count("r").alias("n"), F.round(F.corr("r", "ref"), 6).alias("r"))


# ---- statistics
@query("""with r as (select lang, quality as y, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r from documents join labels using (doc_id)) select sum(y)::bigint as pos, sum(1 - y)::bigint as neg, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as auc from r""")
def midrank_auc(t):
    return stats.auc(t("documents").join(t("labels"), "doc_id"), "n_chars", "quality")


@query("""with r as (select lang, quality as y, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from documents join labels using (doc_id)),
g as (select lang, sum(y) as p, sum(1 - y) as n, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as auc from r group by 1 having sum(y) >= 3 and sum(1 - y) >= 3) select count(*) as groups, round(sum(auc * p * n) / sum(p * n), 5) as auc from g""")
def within_group_auc(t):
    return stats.within_auc(t("documents").join(t("labels"), "doc_id"), "n_chars", "quality", "lang")


@query("with r as (select p_size::double as x, p_retailprice as y, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select count(*) as n, round(corr(x, y), 6) as pearson, round(corr(a, b), 6) as spearman from r")
def spearman_pearson(t):
    return stats.spearman(t("part"), "p_size", "p_retailprice")


@query("""with b as (select event_id, user_id, (event_type = 'purchase')::int as f, value as y from events), o as (select round(avg(case when f = 1 then y end) - avg(case when f = 0 then y end), 9) as d from b),
s as (select rep, y, (row_number() over (partition by rep, user_id order by md5(event_id || '#' || rep), event_id) <= k)::int as g from (select *, sum(f) over (partition by user_id) as k from b), (select unnest(range(1, 31)) as rep)),
n as (select rep, round(avg(case when g = 1 then y end) - avg(case when g = 0 then y end), 9) as m from s group by 1) select round(d, 6) as observed, sum((abs(m) >= abs(d))::int)::bigint as exceed, round((sum((abs(m) >= abs(d))::int) + 1) / 31.0, 6) as p from n, o group by d""")
def perm_within_group(t):
    ev = t("events").select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("f"), "value")
    return stats.permutation_test(ev, "event_id", "user_id", "f", "value", 30)


@query("""with a as (select user_id, avg(value) as x from events where event_type = 'click' group by 1), b as (select user_id, avg(value) as x from events where event_type = 'view' group by 1), d as (select user_id, a.x - b.x as d from a join b using (user_id)), o as (select round(avg(d), 9) as m0, count(d) as n from d),
s as (select rep, round(avg(d * case when substr(md5(user_id || '#' || rep), 1, 1) < '8' then 1 else -1 end), 9) as m from d, (select unnest(range(1, 101)) as rep) group by 1) select n as pairs, round(m0, 6) as observed, sum((abs(m) >= abs(m0))::int)::bigint as exceed, round((sum((abs(m) >= abs(m0))::int) + 1) / 101.0, 6) as p from s, o group by n, m0""")
def sign_flip(t):
    m = t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    return stats.sign_flip(joins.paired(m.where("event_type = 'click'"), m.where("event_type = 'view'"), ["user_id"], "x"), "user_id", "d", 100)


@query("""with e as (select rep, event_type, value as y, (substr(md5(user_id || '#' || rep), 1, 1) < '8')::int as h from events, (select unnest(range(1, 21)) as rep)), g as (select rep, event_type, avg(case when h = 1 then y end) as a, avg(case when h = 0 then y end) as b from e group by 1, 2 having sum(h) >= 2 and sum(1 - h) >= 2), c as (select avg(r) as r from (select rep, corr(a, b) as r from g group by 1))
select round(r, 5) as r, round(2 * r / (1 + r), 5) as reliability from c""")
def split_half(t):
    return stats.split_half(t("events"), "user_id", "event_type", "value")


@query("""with r as (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) - 1 as i, count(*) over (partition by event_type) as n from events),
d as (select event_type, rep, ('0x' || substr(md5(event_type || '#' || i || '#' || rep), 1, 8))::bigint % n as i from r, (select unnest(range(1, 41)) as rep)), m as (select d.event_type, rep, avg(value) as m from d join r on d.event_type = r.event_type and d.i = r.i group by 1, 2)
select event_type, round(quantile_cont(m, 0.025), 5) as lo, round(quantile_cont(m, 0.975), 5) as hi from m group by 1""")
def bootstrap_ci(t):
    return stats.bootstrap_mean(t("events"), "event_id", "event_type", "value", 40)


@query("""with g as (select user_id, count(value) as n, avg(value) as m, var_samp(value) as v from events group by 1), a as (select sum(n * m) / sum(n) as mu, count(*) as k, sum(n) as nn, sum(n * n) as q from g), s as (select sum(n * (m - mu) ** 2) as ssb, sum(coalesce(v, 0) * (n - 1)) as ssw from g, a),
t as (select k, ssb, ssw, ssb / (k - 1) as msb, ssw / (nn - k) as msw, (nn - q / nn) / (k - 1) as n0 from a, s), b as (select *, greatest((msb - msw) / n0, 0) as bt from t)
select k as groups, round(bt, 4) as between, round(msw, 4) as within, round(bt / (bt + msw), 6) as icc, round(ssb / (ssb + ssw), 6) as eta_sq, round(msb / msw, 5) as f from b""")
def var_components(t):
    return stats.variance_components(t("events"), "user_id", "value")


@query("""with c as (select event_type as a, hour(ts) // 6 as b, count(*) as o from events group by 1, 2), ra as (select a, sum(o) as ra from c group by 1), rb as (select b, sum(o) as rb from c group by 1), e as (select ra.a, rb.b, coalesce(o, 0) as o, ra * rb / (select sum(o) from c)::double as e from ra cross join rb left join c on c.a = ra.a and c.b = rb.b)
select round(sum((o - e) ** 2 / e), 5) as chi2, (count(distinct a) - 1) * (count(distinct b) - 1) as df, round(sqrt(sum((o - e) ** 2 / e) / ((select sum(o) from c) * (least(count(distinct a), count(distinct b)) - 1))), 6) as cramers_v from e""")
def chi2_stat(t):
    return stats.chi_square(t("events").withColumn("b", F.floor(F.hour("ts") / 6)), "event_type", "b")


@query("with d as (select l_suppkey, l_quantity - avg(l_quantity) over (partition by l_suppkey) as a, l_extendedprice - avg(l_extendedprice) over (partition by l_suppkey) as b from lineitem), s as (select count(*) as n, count(distinct l_suppkey) as g, sum(a * a) as xx, sum(a * b) as xy, sum(b * b) as yy from d) select n, round(xy / xx, 5) as slope, round(sqrt((yy - xy / xx * xy) / (n - g - 1) / xx), 5) as se from s")
def fe_slope(t):
    return stats.fe_slope(t("lineitem"), "l_quantity", "l_extendedprice", "l_suppkey")


@query("with u as (select user_id, date_diff('day', min(ts)::date, (min(ts) filter (where event_type = 'purchase'))::date) + 1 as d, count(*) filter (where event_type = 'purchase') > 0 as e from events group by 1), b as (select ceil(coalesce(d, 31) / 3.0)::bigint as bin, count(*) as n, sum(e::int)::bigint as events from u group by 1) select bin, sum(n) over (order by bin desc)::bigint as at_risk, events, round(events::double / sum(n) over (order by bin desc), 6) as hazard from b")
def hazard_windows(t):
    p = F.col("event_type") == "purchase"
    u = t("events").groupBy("user_id").agg(F.datediff(F.min(F.when(p, F.to_date("ts"))), F.min(F.to_date("ts"))).alias("d"), F.max(p).alias("e"))
    return stats.hazard(u.withColumn("d", F.coalesce(F.col("d") + 1, F.lit(31))), "d", "e", 3)


@query("""with q as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q), e as (select unnest(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as cut from orders)
select round(cut, 4) as cut, sum((o_totalprice <= cut)::int)::bigint as n_low, round(avg(case when o_totalprice <= cut then (o_orderstatus = 'F')::int end) - avg(case when o_totalprice > cut then (o_orderstatus = 'F')::int end), 6) as gap from orders, e group by e.cut""")
def threshold_scan(t):
    o = t("orders")
    e = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e")).select(F.explode("e").alias("cut"))
    low, y = F.col("o_totalprice") <= F.col("cut"), failed().cast("int")
    return o.crossJoin(F.broadcast(e)).groupBy("cut").agg(F.sum(low.cast("int")).alias("n_low"), F.round(F.avg(F.when(low, y)) - F.avg(F.when(~low, y)), 6).alias("gap")).withColumn("cut", F.round("cut", 4))


@query("with g as (select user_id, count(*) filter (where event_type = 'purchase') as n1, count(*) filter (where event_type <> 'purchase') as n0, avg(value) filter (where event_type = 'purchase') as m1, avg(value) filter (where event_type <> 'purchase') as m0 from events group by 1) select count(*) as strata, round(sum((m1 - m0) / (1.0 / n1 + 1.0 / n0)) / sum(1 / (1.0 / n1 + 1.0 / n0)), 6) as contrast from g where n1 > 0 and n0 > 0")
def harmonic_contrast(t):
    return stats.harmonic_contrast(t("events"), "user_id", F.col("event_type") == "purchase", "value")


@query("with m as (select o_orderpriority as arm, year(o_orderdate) as y, avg(o_totalprice) as m from orders group by 1, 2) select count(*) as years, sum((a.m > b.m)::int)::bigint as better, sum((b.m > c.m)::int)::bigint as worse from m a join m b on a.y = b.y and b.arm = '3-MEDIUM' join m c on a.y = c.y and c.arm = '5-LOW' where a.arm = '1-URGENT'")
def ordering_test(t):
    arms = ["1-URGENT", "3-MEDIUM", "5-LOW"]
    p = t("orders").groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderpriority", arms).agg(F.avg("o_totalprice")).dropna()
    a, b, c = (F.col(f"`{x}`") for x in arms)
    return p.agg(F.count(F.lit(1)).alias("years"), F.sum((a > b).cast("int")).alias("better"), F.sum((b > c).cast("int")).alias("worse"))


@query("with d as (select o_orderpriority, round(avg((o_orderstatus = 'F')::int) - 1.0 / 3, 6) as regret, count(*) as n, round(stddev_samp((o_orderstatus = 'F')::int) / sqrt(count(*)), 6) as se from orders group by 1) select *, (regret - 1.96 * se > 0) as beats from d")
def cell_summary(t):
    y = failed().cast("int")
    d = t("orders").groupBy("o_orderpriority").agg(F.round(F.avg(y) - 1.0 / 3, 6).alias("regret"), F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp(y) / F.sqrt(F.count(F.lit(1))), 6).alias("se"))
    return d.withColumn("beats", F.col("regret") - 1.96 * F.col("se") > 0)


# ---- vectors
@query("""with u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from u group by 1, 2), d as (select u.vec_id, c.label as l, round(sum((x - m) ** 2), 9) as d from u join c using (i) group by 1, 2)
select vec_id, min_by(l, (d, l)) as nearest, round(sqrt(min(d)), 6) as distance from d group by 1""")
def nearest_centroid(t):
    e = t("embeddings")
    c = vectors.mean_vector(e, "embedding", "label").withColumnRenamed("label", "nearest_label")
    return joins.nearest_centre(e, c, "vec_id", "embedding", "nearest_label", "centre")


COS = """n as (select vec_id, label, embedding::double[] as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-12 as r from embeddings),
s as (select a.vec_id, b.label as l, round(list_dot_product(a.e, b.e) / a.r / b.r, 9) as s from n a, n b where a.label not in (0, 1) and b.label in (0, 1)),
k as (select *, row_number() over (partition by vec_id, l order by s desc) as r from s)"""


@query(f"with {COS}, m as (select vec_id, l, round(avg(s), 6) as score from k where r <= 5 group by 1, 2) select a.vec_id, round(a.score - b.score, 6) as contrast from m a join m b on a.vec_id = b.vec_id and a.l = 0 and b.l = 1 order by contrast desc, vec_id limit 20")
def contrast_retrieval(t):
    e = t("embeddings")
    pool = e.where("label not in (0, 1)")
    a, b = (vectors.top_k_score(pool, e.where(F.col("label") == i), "vec_id", "embedding", 5).withColumnRenamed("score", f"s{i}") for i in (0, 1))
    return a.join(b, "vec_id").select("vec_id", F.round(F.col("s0") - F.col("s1"), 6).alias("contrast")).orderBy(F.desc("contrast"), "vec_id").limit(20)


@query(f"with {COS} select vec_id, round(avg(s), 6) as score from k where r <= 3 and l = 0 group by 1 order by score desc, vec_id limit 25")
def topk_similarity(t):
    e = t("embeddings")
    return vectors.top_k_score(e.where("label not in (0, 1)"), e.where("label = 0"), "vec_id", "embedding", 3).orderBy(F.desc("score"), "vec_id").limit(25)


@query("""with u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-12 as r from embeddings), s as (select label, i, sum(x / r) as s, count(*) as n from u group by 1, 2)
select label, max(n) as n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) as coherence from s group by 1""")
def mean_pairwise(t):
    return vectors.mean_pairwise_dot(t("embeddings"), "embedding", "label")


@query("""with u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from u group by 1, 2)
select vec_id, u.label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as cosine from u join c on u.label = c.label and u.i = c.i group by 1, 2""")
def coherence(t):
    return vectors.centroid_cosine(t("embeddings"), "embedding", "vec_id", "label")


@query("""with u as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), m as (select i, avg(case when label = 0 then x end) - avg(case when label <> 0 then x end) as d from u group by 1), z as (select sqrt(sum(d * d)) + 1e-12 as z from m),
s as (select vec_id, label, round(sum(x * d / z), 6) as s from u join m using (i), z group by 1, 2), k as (select *, row_number() over (order by s desc, vec_id) as r from s) select round(avg((label = 0)::int), 6) as precision_at_n, count(*) as n from k where r <= 50""")
def precision_at_n(t):
    e = t("embeddings")
    top = vectors.contrast_direction(e, "embedding", "vec_id", F.col("label") == 0, 50)
    return top.join(e.select("vec_id", "label"), "vec_id").agg(F.round(F.avg((F.col("label") == 0).cast("int")), 6).alias("precision_at_n"), F.count(F.lit(1)).alias("n"))


@query("""with u as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from u group by 1, 2) select (a.label // 5 = b.label // 5) as same_half, count(distinct (a.label, b.label)) as pairs, round(avg(cosine), 6) as mean_cosine from
(select a.label as la, b.label as lb, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 9) as cosine from c a join c b on a.i = b.i and a.label < b.label group by 1, 2) s, (select distinct label from c) a, (select distinct label from c) b where s.la = a.label and s.lb = b.label group by 1""")
def self_pair_relations(t):
    c = vectors.mean_vector(t("embeddings"), "embedding", "label")
    a, b = c.select(F.col("label").alias("la"), F.col("centre").alias("ca")), c.select(F.col("label").alias("lb"), F.col("centre").alias("cb"))
    p = a.join(b, F.col("la") < F.col("lb")).select((F.floor(F.col("la") / 5) == F.floor(F.col("lb") / 5)).alias("same_half"), F.round(E.cosine("ca", "cb"), 9).alias("c"))
    return p.groupBy("same_half").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("c"), 6).alias("mean_cosine"))


@query()
def fps_select(t):
    return vectors.farthest_points(t("embeddings"), "vec_id", "embedding", 20)


@query()
def facility_location(t):
    e = t("embeddings")
    return vectors.facility_location(e, e.where("label = 0"), "vec_id", "embedding", 15)


@query()
def whitening(t):
    return vectors.whiten(t("embeddings"), "vec_id", "embedding", 3)


@query()
def kmeans_assign(t):
    return models.kmeans(t("embeddings"), "vec_id", "embedding", 10)


@query()
def logistic_oof(t):
    d = t("documents").join(t("labels"), "doc_id").select("doc_id", "source", F.log1p("n_chars").alias("size"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("caps"), F.length(F.regexp_replace("text", "[a-zA-Z]", "")).cast("double").alias("other"), "quality")
    return models.logistic_oof(d, "doc_id", "source", ["size", "caps", "other"], "quality", 4)


# ---- allocation
SCORES = "s as (select p_brand, count(*) as n, round(avg((l_returnflag = 'R')::int), 6) as score from lineitem join part on l_partkey = p_partkey group by 1)"


def _scores(t):
    r = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return r.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(returned().cast("int")), 6).alias("score"))


@query(f"with {SCORES} select p_brand, round(1000.0 * score / sum(score) over (), 6) as alloc from s")
def proportional_alloc(t):
    return alloc.proportional(_scores(t), "score", 1000.0).select("p_brand", F.round("alloc", 6).alias("alloc"))


@query(f"""with recursive {SCORES}, c as (select p_brand, score, (n * 0.02) as cap from s), r as (select *, row_number() over (order by cap / score, score desc) as i, sum(cap) over (order by cap / score, score desc rows between unbounded preceding and 1 preceding) as bc, sum(score) over (order by cap / score, score desc rows between unbounded preceding and 1 preceding) as bs, sum(score) over () as ts from c),
l as (select *, (900.0 - coalesce(bc, 0)) / (ts - coalesce(bs, 0)) as lev from r), v as (select min_by(lev, i) as lev from l where lev <= cap / score) select p_brand, round(least(cap, coalesce(v.lev * score, cap)), 4) as alloc from c, v""")
def water_fill(t):
    return alloc.water_fill(_scores(t).withColumn("cap", F.col("n") * 0.02), "score", "cap", 900.0).select("p_brand", F.round("alloc", 4).alias("alloc"))


@query("with c as (select c_mktsegment, count(*) as n from customer group by 1), x as (select *, round(997 * n / (select sum(n) from c)::double, 9) as x from c), f as (select *, floor(x)::bigint as f, row_number() over (order by round(x - floor(x), 9) desc, c_mktsegment) as r from x) select c_mktsegment, f + (r <= 997 - (select sum(f) from f))::int as alloc from f")
def largest_remainder(t):
    c = t("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return alloc.largest_remainder(c, "n", 997, "c_mktsegment").select("c_mktsegment", "alloc")


@query("select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by md5(o_orderkey || '#7'), o_orderkey) as r from orders) where r <= 40")
def stratified_sample(t):
    return alloc.stratified_sample(t("orders"), "o_orderpriority", "o_orderkey", 40, 7).select("o_orderpriority", "o_orderkey")


@query("""with p as (select event_type as arm, cast(ts as date) as d, avg(value) as x from events group by 1, 2), g as (select arm, count(x) as n, avg(x) as mean, coalesce(stddev_samp(x), 0) as sd, max(d) as last from p group by 1), b as (select *, mean - 1.0 * greatest(sd, 0.5) / sqrt(n) as lcb, mean + 1.0 * greatest(sd, 0.5) / sqrt(n) as ucb, last = (select max(last) from g) as live from g)
select arm, n, round(mean, 6) as mean, round(lcb, 6) as lcb, round(ucb, 6) as ucb, live and (ucb >= (select max(lcb) from b where live) or arm = (select arm from b where live order by mean desc, arm limit 1)) as survives from b""")
def scheduler_decide(t):
    p = t("events").groupBy(F.col("event_type").alias("arm"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("x"))
    return alloc.elimination(p, "arm", "d", "x", 1.0, 0.5).select("arm", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lcb", "ucb")], "survives")


@query("with s as (select p_brand, avg(p_size) as a from part group by 1), g as (select p_brand, j as step, round(a * 0.6 ** j - 4, 6) as gain from s, (select unnest(range(0, 8)) as j)), k as (select * from g where gain > 0 order by gain desc, p_brand, step limit 40) select p_brand, count(*) as alloc, round(sum(gain), 6) as gain from k group by 1")
def greedy_ladder(t):
    s = t("part").groupBy("p_brand").agg(F.avg("p_size").alias("a"))
    return alloc.greedy_ladder(s.withColumn("g", F.array(*[F.round(F.col("a") * F.pow(F.lit(0.6), F.lit(float(j))) - 4, 6) for j in range(8)])), "p_brand", "g", 40)


@query("with a(arm) as (values ('core'), ('random'), ('coverage')), b(budget) as (values (50), (100), (200)), c(arm, size) as (values ('core', 120), ('random', 500), ('coverage', 90)) select arm, budget, seed::int as seed from a join c using (arm), b, (select unnest(range(0, 3)) as seed) where budget <= size")
def run_manifest(t):
    spark = t("region").sparkSession
    arms = spark.createDataFrame([("core", 120), ("random", 500), ("coverage", 90)], "arm string, size int")
    grid = arms.withColumn("budget", F.explode(F.array(*[F.lit(x) for x in (50, 100, 200)]))).withColumn("seed", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2)])))
    return grid.where("budget <= size").select("arm", "budget", "seed")


@query("with r(name, base, headroom, tau, amount) as (values ('a', 0.2, 0.5, 40.0, 30.0), ('b', 0.6, 0.3, 80.0, 60.0), ('c', 0.4, 0.4, 10.0, 5.0)) select name, round(base + headroom * (1 - exp(-amount / tau)), 6) as value from r")
def saturating_response(t):
    r = t("region").sparkSession.createDataFrame([("a", 0.2, 0.5, 40.0, 30.0), ("b", 0.6, 0.3, 80.0, 60.0), ("c", 0.4, 0.4, 10.0, 5.0)], "name string, base double, headroom double, tau double, amount double")
    return r.select("name", F.round(E.saturating("base", "headroom", "tau", "amount"), 6).alias("value"))


@query("select event_id, user_id, value from (select event_id, user_id, value, sum(value) over (partition by user_id order by event_id rows unbounded preceding) as spent from events) where spent <= 500")
def metered_budget(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").withColumn("spent", F.sum("value").over(w)).where("spent <= 500").select("event_id", "user_id", "value")


# ---- functions, sources and ledger
@query("select replace(lower(trim(p_name)), ' ', '_') as name, count(*) as n, regexp_extract(min(p_brand), '#([0-9]+)', 1) as number from part group by 1")
def name_functions(t):
    return t("part").groupBy(E.normal_name("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("p_brand").alias("b")).select("name", "n", F.regexp_extract("b", "#([0-9]+)", 1).alias("number"))


@query("select (props->>'k')::int as k, count(*) as n from events group by 1")
def json_property(t):
    return t("events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when (s_nationkey - 12) ** 2 >= (s_acctbal / 1000) ** 2 then case when s_nationkey - 12 >= 0 then 1 else -1 end else case when s_acctbal >= 0 then 1 else -1 end end as side, greatest(abs(s_nationkey - 12), abs(s_acctbal / 1000)) > 5 as rim, count(*) as n from supplier group by 1, 2")
def side_and_rim(t):
    s = t("supplier").select((F.col("s_nationkey") - 12).cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    return s.groupBy(E.dominant_side("x", "y").alias("side"), E.rim("x", "y", 5).alias("rim")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def ledger_resume(t):
    ev = t("events").select("event_id", "event_type", "value")
    first = ev.where("event_id % 3 <> 0")
    both = first.unionByName(ledger.not_done(ev, first, ["event_id"]))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_counts(t):
    return ledger.windowed(t("events"), "ts", "6 hours", ["event_type"], "value")
