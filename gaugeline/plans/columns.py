"""Queries of filters, derived columns, encodings and set differences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import exprs as E
from gaugeline.operators import columns as C
from gaugeline.plans.catalogue import query


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority is distinct from '5-LOW'")
def status_filter(t):
    return C.with_status(t("orders"), "o_orderstatus", "F", "o_orderpriority", "5-LOW").select("o_orderkey", "o_orderpriority")


@query("select c_custkey, c_custkey in (select o_custkey from orders) as has_order from customer")
def member_flag(t):
    return C.flag_members(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_order")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def complement_mask(t):
    flagged = C.flag_members(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_order")
    return flagged.where(~F.col("has_order")).drop("has_order")


@query("with e as (select event_id, case when event_id % 7 <> 0 then value end as v from events) select event_id, round(coalesce(v, (select median(v) from e)), 4) as v from e")
def median_imputed(t):
    return C.impute_median(t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")), "v").withColumn("v", F.round("v", 4))


@query("""select l_orderkey, l_linenumber, case when l_quantity <= 5 then 0 when l_discount <= 0.02 then 1 when l_tax <= 0.03 then 2 when l_returnflag <> 'R' then 3 else 4 end as depth from lineitem""")
def failure_depth(t):
    reached = [F.col("l_quantity") > 5, F.col("l_discount") > 0.02, F.col("l_tax") > 0.03, F.col("l_returnflag") == "R"]
    return t("lineitem").select("l_orderkey", "l_linenumber", C.ordinal_depth(reached).alias("depth"))


@query("select o_orderkey, round(least(greatest((o_totalprice - 20000.0) / 180000.0, 0), 1), 5) as progress from orders")
def progress_score(t):
    return t("orders").select("o_orderkey", E.rounded(C.progress(F.col("o_totalprice").cast("double"), F.lit(20000.0), F.lit(200000.0)), 5).alias("progress"))


@query("""with m as (select n_nationkey, (n_regionkey % 3)::int as tier from nation where n_nationkey < 20)
select c_custkey, 't' || coalesce(tier, 1)::varchar || 'h' || (c_custkey % 3)::varchar || 'x' || (c_custkey % 4)::varchar as cell from customer left join m on c_nationkey = n_nationkey""")
def grid_cells(t):
    tiers = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") % 3).cast("int").alias("tier"))
    return C.grid_cell(t("customer"), tiers, "c_nationkey", "tier", F.col("c_custkey") % 3, F.col("c_custkey") % 4).select("c_custkey", "cell")


@query("""with c as (select round_even(l_quantity::double / 7, 0)::bigint as cx, round_even(l_discount::double / 0.03, 0)::bigint as cy, count(*) as n, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by 1, 2)
select *, dense_rank() over (order by first)::int - 1 as cell_id from c""")
def rounded_grid(t):
    rows = t("lineitem").select((F.col("l_quantity").cast("double") / 7).alias("x"), (F.col("l_discount").cast("double") / 0.03).alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return C.round_grid(rows, "x", "y", 1.0, "at")


@query("select o_orderkey, case split_part(o_orderpriority, '-', 2) when 'URGENT' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 end as code, lpad(o_orderkey::varchar, 9, '0') as name from orders")
def level_codes(t):
    level = F.element_at(F.split("o_orderpriority", "-"), 2)
    return t("orders").select("o_orderkey", C.encode_levels(level, ["URGENT", "HIGH", "MEDIUM"]).alias("code"), F.format_string("%09d", F.col("o_orderkey")).alias("name"))


@query("select o_orderkey, (o_orderstatus = 'F')::int as o_orderstatus_F, (o_orderstatus = 'O')::int as o_orderstatus_O from orders where o_orderpriority like '1-%' or contains(o_orderpriority, 'LOW')")
def status_dummies(t):
    rows = t("orders").where(F.col("o_orderpriority").startswith("1-") | F.col("o_orderpriority").contains("LOW")).select("o_orderkey", "o_orderstatus")
    return C.dummies(rows, "o_orderstatus", ["F", "O"]).drop("o_orderstatus")


@query("select c_custkey, 0 as part from customer where c_custkey % 3 = 0 union all select c_custkey, 1 from customer where c_custkey % 3 = 1")
def base_then_rest(t):
    c = t("customer").select("c_custkey")
    return C.ordered_union(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 3 = 1"), "c_custkey")


@query("""with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O')
select k, 'dropped' as change from a where k not in (select k from b) union all select k, 'added' from b where k not in (select k from a)""")
def roster_diff(t):
    one = lambda s: t("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return C.roster_changes(one("F"), one("O"), "k")


@query("""select o_orderkey, concat_ws(',', case when o_orderstatus is distinct from 'F' then 'a' end, case when (o_custkey % 2)::varchar is distinct from '0' then 'b' end, 'c') as changed from orders""")
def fingerprint_diff(t):
    mine = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), (F.col("o_custkey") % 2).cast("string"))
    other = F.create_map(F.lit("a"), F.lit("F"), F.lit("b"), F.lit("0"), F.lit("c"), F.lit("x"))
    return t("orders").select("o_orderkey", F.array_join(C.map_changes(mine, other), ",").alias("changed"))


@query("select case when l_returnflag in ('A', 'N') then 'A' else l_returnflag end as name, round(sum(l_discount::double * l_quantity::double) / sum(l_quantity::double), 6) as rate from lineitem group by 1")
def merged_aliases(t):
    rows = t("lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("d"), F.col("l_quantity").cast("double").alias("q"))
    return C.merge_aliases(rows, F.when(F.col("l_returnflag").isin("A", "N"), "A").otherwise(F.col("l_returnflag")), "d", "q").select("name", F.round("rate", 6).alias("rate"))


@query("select o_orderkey, (row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1)::int as rank from orders")
def ordinal_ranks(t):
    return C.ordinal_rank(t("orders"), "o_totalprice", "o_orderkey", ["o_orderpriority"]).select("o_orderkey", "rank")


@query("with k as (select o_orderkey, o_totalprice::double as s from orders order by 2 desc, 1 limit 20) select o_orderkey, round(s / sum(s) over (), 6) as share from k")
def top_shares(t):
    return C.top_concentration(t("orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("s")), "s", "o_orderkey", 20).select("o_orderkey", F.round("share", 6).alias("share"))


@query("with c as (select o_orderpriority, count(*) as n from orders group by 1) select max(b)::int as budget, (select min(n) from c) as least from (values (10), (50), (100), (1000), (100000)) v(b) where (select min(n) from c) >= 3 * b")
def budget_rule(t):
    return C.largest_budget(t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "n", [10, 50, 100, 1000, 100000])


@query("""select l_orderkey, l_linenumber, greatest(0, least(l_quantity::double, 60 - coalesce(sum(l_quantity::double) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0))) as granted from lineitem""")
def granted_spend(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q"))
    return C.clip_to_budget(rows, "q", ["l_linenumber", "l_partkey", "l_suppkey", "q"], ["l_orderkey"], 60.0).select("l_orderkey", "l_linenumber", "granted")


@query("""with p as (select least(greatest(l_quantity::double / 51, 1e-15), 1 - 1e-15) as q, (l_returnflag = 'R')::int as y from lineitem)
select count(*) as n, round(avg(-case when y = 1 then ln(q) else ln(1 - q) end), 6) as log_loss, round(avg((q - y) ** 2), 6) as brier from p""")
def log_loss_report(t):
    out = C.log_loss(t("lineitem"), F.col("l_quantity").cast("double") / 51, (F.col("l_returnflag") == "R").cast("int"))
    return out.select("n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))
