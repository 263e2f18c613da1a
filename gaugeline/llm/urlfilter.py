"""URL filters: a temporal join of captures with dated list entries.

Entries ``(key, action, since)`` say that from ``since`` on a key is ``block``, ``allow`` or ``clear``
(off the list). Entries of a key become validity intervals [since, next since); a capture is decided
by the entries active at its fetch time, the longest matching key first. A key is a host, a parent
domain, or a host with its first path segment. DataFrame and SQL functions only.

Scale: each capture gives a few narrow rows (row number, key, time), joined by equality on the key and
the interval; intervals of a key don't overlap, so a row matches at most one. Captures of a hot host
are salted by row number and the list is repeated ``salts`` times. Nothing is broadcast by hand.

Defined cases: a null, empty or malformed URL has no host and stays ("none"); a null fetch time sees no
entry; entries with a null key, action or time don't count; of entries of one key and time the largest
action by code point counts; repeated captures are decided one by one; empty tables give empty results
or no decision. Letter case of hosts and paths doesn't matter; a port and a user are no part of a
key; a host with a trailing dot is another host, and a bracketed IPv6 host is read to its first colon. Columns ``host, list_key, action, blocked`` replace input columns of those names; all others
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden, cut

#: The list that the registered query applies (key, action, since).
ENTRIES = [
    ("spam-farm.example.org", "block", "2024-01-03 00:00:00"),
    ("cheap-pills.example.com", "block", "2024-01-05 00:00:00"),
    ("cheap-pills.example.com", "clear", "2024-01-15 00:00:00"),
    ("cheap-pills.example.com", "block", "2024-01-22 12:00:00"),
    ("example.net", "block", "2024-01-10 00:00:00"),
    ("example.net", "clear", "2024-01-12 06:00:00"),
    ("tionsh.example.net", "allow", "2024-01-11 00:00:00"),
    ("tionsh.example.net", "block", "2024-01-20 00:00:00"),
    ("tionsh.example.net/en", "allow", "2024-01-25 00:00:00"),
    ("www.cheap-pills.example.com/en", "allow", "2024-01-08 00:00:00"),
]
FETCHED = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast((page_id * 37) % 720 as int))"


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries -> (list_key, action, since, until); until is null while the entry holds."""
    clean = entries.where("key is not null and action is not null and since is not null").groupBy(F.lower("key").alias("list_key"), "since").agg(F.max("action").alias("action"))
    return clean.withColumn("until", F.lead("since").over(Window.partitionBy("list_key").orderBy("since"))).where("action <> 'clear'")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at", salts: int = 16) -> DataFrame:
    own = Hidden(captures)
    url_col, time_col = own[url_col], own[time_col]
    rows, _ = cut(own.df.withColumn("_row", F.monotonically_increasing_id()), "urls")  # written, so that row numbers hold for both branches
    rows = rows.withColumn("_m", F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]*)?(/[^/?#]*)?", 1))
    rows = rows.withColumn("host", F.when(F.col("_m") != "", F.col("_m")))
    first = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+(?::[0-9]*)?(/[^/?#]+)", 1)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.array_distinct(F.when(first != "", F.array_append(suffixes, F.concat("host", first))).otherwise(suffixes))
    asked = rows.where(F.col("host").isNotNull() & F.col(time_col).isNotNull()).select("_row", F.col(time_col).alias("_at"), F.pmod(F.col("_row"), F.lit(salts)).cast("int").alias("_salt"), F.explode(keys).alias("list_key"))
    listed = intervals(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = asked.join(listed, (asked.list_key == listed.list_key) & (asked._salt == listed._salt) & (asked._at >= listed.since) & (listed.until.isNull() | (asked._at < listed.until)))
    best = active.groupBy("_row").agg(F.max(F.struct(F.length(asked.list_key).alias("n"), asked.list_key.alias("k"), "action")).alias("_b"))
    action = F.coalesce("_b.action", F.lit("none"))
    return own.show(rows.join(best, "_row", "left"), host=F.col("host"), list_key=F.col("_b.k"), action=action, blocked=action == "block")


def op2_filter_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    entries = spark.createDataFrame(ENTRIES, "key string, action string, since string").withColumn("since", F.to_timestamp("since"))
    return filter_urls(pages, entries).select("page_id", "url", "host", "list_key", "action", "blocked")


ORACLE = f"""
with entries(key, action, since) as (values {", ".join(f"('{k}', '{a}', timestamp '{s}')" for k, a, s in ENTRIES)}),
spans as (select key, action, since, lead(since) over (partition by key order by since) as until from entries),
rows as (select row_number() over () as r, page_id, url, lower(url) as u, timestamp '2024-01-01 00:00:00' + to_hours(((page_id * 37) % 720)::int) as fetched_at from pages),
hosts as (select *, nullif(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '') as host,
  regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+(?::[0-9]*)?(/[^/?#]+)', 1) as first from rows),
hits as (select r, s.key, s.action, row_number() over (partition by r order by length(s.key) desc, s.key desc) as best
  from hosts h join spans s on s.action <> 'clear' and h.fetched_at >= s.since and (s.until is null or h.fetched_at < s.until)
  and (h.host = s.key or h.host like '%.' || s.key or (h.first <> '' and h.host || h.first = s.key)))
select page_id, url, host, key as list_key, coalesce(action, 'none') as action, coalesce(action, 'none') = 'block' as blocked
from hosts left join hits on hosts.r = hits.r and hits.best = 1
"""
