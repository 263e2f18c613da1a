"""WARC: write pages as records, read archives back by boundary-chain verification.

Writing: of pages with equal payloads of at least ``min_bytes``, the one with the largest id is a response record and
the others revisit records that refer to it; all others are responses. Spark's text writer writes the records, with the
blank lines that end a record as the line separator, in gzip files of about ``file_bytes`` each.

Reading: each file's task looks for the magic at every line start and emits candidates: offset, the successor that the
candidate's own length announces, and what its header says. A payload may hold the magic, even whole records, so
candidates alone prove nothing: pointer jumping from offset 0 (successors of 1, 2, 4, ... steps, doubled by joins, cut
in the shared folder) keeps only the reachable ones. All files are jumped at once; rounds are the logarithm of the most
records in a file, which ``file_bytes`` bounds. Files are read by Spark (binaryFile), one at a time in a task.

Defined cases: null html is an empty payload; null ids and urls give records without those fields and read back null;
among equal payloads with repeated largest ids all of those are responses, and if all ids are null all are; an empty
table gives no record; an archive whose chain breaks raises an error; extra columns aren't stored. URLs are written as they
are, but that a line break in one becomes %0D or %0A; spaces around one aren't read back.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut, drop, new_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADS = {b"warc-type": "record_type", b"warc-record-id": "record_id", b"warc-refers-to": "refers", b"warc-target-uri": "url", b"warc-payload-digest": "digest", b"x-payload-length": "payload_length"}
SCHEMA = "file string, offset long, successor long, size long, record_type string, record_id string, refers string, url string, digest string, payload_length string, sound boolean"


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """_id, _url, _body, _digest, _size and _refers (the response's id for revisits). The hot digest is counted before it is shuffled."""
    body = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col("url").alias("_url"), body.alias("_body")).withColumns({"_digest": F.sha1("_body"), "_size": F.octet_length("_body").cast("long")})
    large = F.col("_size") >= min_bytes
    heads = rows.where(large).groupBy("_digest", "_size").agg(F.max("_id").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(heads, ["_digest", "_size"], "left")
    return joined.withColumn("_refers", F.when(F.coalesce(F.col("_id"), F.lit(-(1 << 62))) < F.col("_head"), F.col("_head"))).drop("_head")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", body_col: str = "html", min_bytes: int = 1000, file_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    rows = mark_revisits(pages, id_col=id_col, body_col=body_col, min_bytes=min_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(key + ": "), value, F.lit("\r\n"))).otherwise("")
    revisit = F.col("_refers").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.decode("_body", "UTF-8"))
    url = F.replace(F.replace("_url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", name(F.col("_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("WARC-Refers-To", name(F.col("_refers"))), line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")), line("X-Payload-Length", F.col("_size").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("_size").cast("string"))), F.lit("\r\n"),
    )
    total, n = pages.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(body_col), F.lit(0)) + 500), F.lit(0)), F.count(F.lit(1))).first()
    most = max(1, int(file_bytes * max(n, 1) / max(total, 1)))  # records of the mean size that fill a file
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _inflate(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else zlib.decompress(data) if data[:1] == b"\x78" else data


def candidates(content: bytes) -> Iterator[dict]:
    """Whatever looks like a record at a line start. A last candidate gives where the chain has to end."""
    at = 0
    while (at := content.find(MAGIC, at)) >= 0:
        if at == 0 or content[at - 1 : at] == b"\n":
            stop = content.find(b"\r\n\r\n", at)
            head = content[at + len(MAGIC) : stop if stop >= 0 else at + len(MAGIC)]
            found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))}
            size = found.get(b"content-length", b"")
            if stop >= 0 and size.isdigit():
                body = stop + 4
                after = body + int(size)
                if content[after : after + 4] == b"\r\n\r\n":
                    out = {name: found[k].decode("utf-8", "replace") if k in found else None for k, name in HEADS.items()}
                    sound = out["record_type"] != "response" or out["digest"] == "sha1:" + hashlib.sha1(content[body:after]).hexdigest()
                    yield out | {"offset": at, "successor": after + 4, "size": int(size), "sound": sound}
        at += len(MAGIC)


def read_candidates(spark, path: str) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                plain = _inflate(content.as_py())
                rows = [*candidates(plain), {"offset": len(plain), "record_type": "end"}]
                yield pa.RecordBatch.from_pylist([r | {"file": file} for r in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def read_warc(spark, path: str) -> DataFrame:
    """Records on the chain from each file's start: page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, offset."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)  # a few files at a time
        found, _ = cut(read_candidates(spark, path), "warc-candidates")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    most = found.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    now = found.select("file", "offset", F.col("successor").alias("jump"), (F.col("offset") == 0).alias("reached"))
    path_now = None
    for k in range(max(1, most).bit_length()):
        targets = now.where("reached and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(True).alias("_hit"))
        steps = now.select("file", F.col("offset").alias("jump"), F.col("jump").alias("_next"))
        new = now.join(targets, ["file", "offset"], "left").join(steps, ["file", "jump"], "left").select("file", "offset", F.col("_next").alias("jump"), (F.col("reached") | F.coalesce("_hit", F.lit(False))).alias("reached"))
        new, path_new = cut(new, f"warc-jump{k}")
        if path_now:
            drop(spark, path_now)
        now, path_now = new, path_new
    kept = found.join(now.where("reached").select("file", "offset"), ["file", "offset"])
    lost = found.select("file").distinct().join(kept.where("record_type = 'end'").select("file"), "file", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} archives have a broken chain of records")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("long"))
    good = F.when(F.col("sound"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), "file")))
    return kept.where("record_type <> 'end'").select(
        whole(F.col("record_id")).alias("page_id"), "url", F.col("payload_length").cast("long").alias("payload_bytes"),
        F.regexp_replace(good, "^sha1:", "").alias("payload_digest"), "record_type", whole(F.col("refers")).alias("refers_to"), "file", "offset",
    )


def op7_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h) as n, sha1(h) as d from p),
r as (select *, max(page_id) over (partition by d, n) as head from q)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when n >= 1000 and page_id < head then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < head then head end as refers_to from r
"""
