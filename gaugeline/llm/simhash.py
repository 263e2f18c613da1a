"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has 64 bits from the XXH64 (seed 42) of word shingles. It is cut into three segments of 21, 21
and 22 bits, each a word of the perfect Golay [23, 12, 7] code. If two fingerprints differ in at most two bits,
the pigeonhole gives, in cyclic order, a segment without error followed by one with at most one error. A key
joins the exact bits of the first with a codeword index of the second; a word's indices are all codewords within
distance 4 (one for words within 2 of the code, six else), so words one bit apart share an index. Keys are joined
and the links verified by the whole fingerprints.

Only distinct fingerprints take part, so exact copies cost nothing. A bucket of up to ``pair_limit`` fingerprints
is joined with itself; a larger one is refined exactly without pairs: two fingerprints differ in at most two bits
just if the points within one bit of them meet, so its members link to the least member at each such point.
Components come from alternating large-star and small-star rounds, cut in the shared folder after each.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make
one shingle; repeated rows and ids are copies; null ids never are a component's id unless it has no other; an empty
table gives an empty result; column names of ``docs`` don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden, cut, drop

#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
#: (exact segment, its bits, fuzzy segment, its bits), as shifts and widths in the fingerprint.
LAYOUT = [((0, 21), (21, 21)), ((21, 21), (42, 22)), ((42, 22), (0, 21))]
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: A fingerprint of more rows than HOT is dealt to SALTS tasks when rows get their component.
HOT, SALTS = 20_000, 32
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator, of 23-bit words."""
    s = words.astype(np.int64).copy()
    for i in range(22, 10, -1):
        s ^= ((s >> i) & 1) * (GOLAY << (i - 11))
    return s


def _leaders() -> np.ndarray:
    """The only error pattern of weight 3 or less for each of the 2048 syndromes."""
    errors = np.array([sum(1 << i for i in c) for k in range(4) for c in combinations(range(23), k)])
    out = np.zeros(2048, np.int64)
    out[syndromes(errors)] = errors
    return out


LEADERS = _leaders()


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices: of the word, and of the word with each one bit flipped; many are equal."""
    flips = np.concatenate(([0], 1 << np.arange(23)))
    near = words.astype(np.int64)[:, None] ^ flips[None, :]
    return (near ^ LEADERS[syndromes(near)]) >> 11  # systematic: the upper 12 bits name the codeword


def fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([digest(flat[a:b], 42) for a, b in zip(starts[at:to], ends[at + min(width, len(words)) - 1 :])], "<u8")
        slots = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
        counts += (np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def fingerprints(docs: DataFrame, *, width: int = 3, text_col: str = "text", out: str = "_fp") -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in b], np.uint64).astype(np.int64))

    return docs.withColumn(out, F.pandas_udf(run, "long").asNondeterministic()(F.col(text_col).cast("string")))


def keyed(distinct: DataFrame) -> DataFrame:
    """(key, fp): all keys of each fingerprint. A key holds the layout's number, the exact bits and the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for k, ((at, wide), (to, broad)) in enumerate(LAYOUT):
                exact = (fp >> at) & ((1 << wide) - 1)
                index = np.sort(golay_keys((fp >> to) & ((1 << broad) - 1)), axis=1)
                new = np.ones(index.shape, bool)
                new[:, 1:] = index[:, 1:] != index[:, :-1]
                row, col = np.nonzero(new)
                yield pd.DataFrame({"key": (k << 40) | (exact[row] << 12) | index[row, col], "fp": fp[row]})

    return distinct.mapInPandas(run, "key long, fp long")


def links(distinct: DataFrame, *, max_bits: int = 2, pair_limit: int = 12) -> tuple[DataFrame, list[str]]:
    """Verified links (u, v), u > v, with the same components as all pairs within ``max_bits`` (2 at most)."""
    spark, paths = distinct.sparkSession, []
    keys, p = cut(keyed(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared, q = cut(keys.join(sizes, "key"), "golay-buckets")
    drop(spark, p)
    paths.append(q)
    small = shared.where(F.col("n") <= pair_limit).select("key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    pairs = small.withColumnRenamed("fp", "u").join(small.withColumnRenamed("fp", "v"), "key").where((F.col("u") > F.col("v")) & near).select("u", "v")
    large = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    balls = large.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    if max_bits == 2:
        heads = balls.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "v")
        stars = balls.join(heads, "point").where(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v").where(near)
    else:  # a fingerprint within one bit is itself a point: at most 64 links each
        stars = balls.select(F.col("fp").alias("u"), "point").join(large.select(F.col("fp").alias("v")), F.col("point") == F.col("v")).where((F.col("u") > F.col("v")) & near).select("u", "v")
    return pairs.union(stars).distinct(), paths


def components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, list[str]]:
    """(node, root) of nodes with links: large-star and small-star rounds until nothing changes."""
    spark = edges.sparkSession

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = cut(edges, "cc")
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = cut(large.distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new, new_path = cut(small.where("u <> v").distinct(), "cc")
        drop(spark, path)
        drop(spark, large_path)
        now, path = new, new_path
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), [path]


def name_components(marked: DataFrame, *, max_bits: int, id_col: str) -> DataFrame:
    """(_fp, component_id) of each distinct fingerprint of ``marked`` (id, _fp)."""
    distinct = marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("least"))
    edges, _ = links(distinct.select("fp"), max_bits=max_bits)
    nodes, _ = components(edges)
    joined = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(ids, "root").select(F.col("fp").alias("_fp"), "root", "component_id")


def cluster(docs: DataFrame, *, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, fingerprint as signed long ``_fp``, component_id), one row for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    marked, _ = cut(fingerprints(narrow, width=width, text_col="_t").select("_id", "_fp"), "simhash")
    named, _ = cut(name_components(marked, max_bits=max_bits, id_col="_id").select("_fp", "component_id"), "simhash-ids")
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")  # copies of one text are one key: dealt to several tasks
    lone = marked.groupBy("_fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("_fp")
    lone, _ = cut(lone, "simhash-hot")
    lone = F.broadcast(lone)  # at most rows / HOT fingerprints
    hot = named.join(lone, "_fp", "left_semi").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = named.join(lone, "_fp", "left_anti").withColumn("s", F.lit(-1)).union(hot.select("_fp", "component_id", "s"))
    dealt = marked.join(lone.withColumn("hot", F.lit(True)), "_fp", "left").withColumn("s", F.when(F.col("hot"), salt).otherwise(-1))
    return dealt.join(both, ["_fp", "s"]).select(F.col("_id").alias(id_col), "_fp", "component_id")


def dedup(docs: DataFrame, *, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, of the smallest id (null last; of repeated ids, the first as written)."""
    own = Hidden(docs)
    id_col = own[id_col]
    marked, _ = cut(fingerprints(own.df, width=width, text_col=own[text_col]).withColumn("_row", F.monotonically_increasing_id()), "simhash-docs")
    narrow = marked.select(id_col, "_fp", "_row")
    named = name_components(narrow, max_bits=max_bits, id_col=id_col).select("_fp", "root")
    first = narrow.groupBy("_fp").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))).alias("_first"))
    keep = first.join(named, "_fp").groupBy("root").agg(F.min("_first")["_row"].alias("_row"))
    return own.show(marked.join(keep.select("_row"), "_row", "left_semi"))


def op5_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
