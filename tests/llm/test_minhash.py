"""The near-dedup stage against brute-force Jaccard similarity."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gaugeline.llm import minhash, simhash


def shingle_set(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_keep(rows):
    """Least id of each component of (id, text) under Jaccard similarity of 0.8 or more."""
    sets, root = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id"])
    got = {r["doc_id"] for r in P.dedup_stage(spark, docs, "").select("doc_id").collect()}
    assert got == brute_keep([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("edits", [1, 2, 6])
def test_a_crowded_group(spark, edits):
    """Many edited copies of one text: more sets in a bucket than are compared with each other."""
    r = np.random.default_rng(edits)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(400):
        words = list(base)
        for at in r.choice(90, edits, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    want = brute_keep(rows)
    got = {x["doc_id"] for x in minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_crowded_buckets_of_several_groups(spark, monkeypatch):
    """Groups that share most of a passage meet in the same buckets; links between any two of them are found, block by block."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    r, rows = np.random.default_rng(9), []
    for g in range(12):
        base = [f"w{i}" for i in range(84)] + [f"g{g}x{i}" for i in range(12)]
        for i in range(15):
            words = list(base)
            for at in r.choice(84, 2, replace=False):
                words[at] = f"x{g}y{i}z{at}"
            rows.append((100 * g + i, " ".join(words)))
    r.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    got = {x["doc_id"] for x in minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"), ahead=1).collect()}
    assert got == brute_keep(rows)


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "one two", 2), (3, "One two", 3), (None, "one two", 4), (5, "long " * 60_000, 5), (None, "x y z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = minhash.dedup(df)
    assert got.columns == df.columns and sorted(r["n"] for r in got.collect()) == [0, 2, 5, 6]
    assert minhash.dedup(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", *[F.lit("c").alias(c) for c in ("_set", "_row", "node", "root", "_first")])
    assert minhash.dedup(clash).count() == 4 and minhash.dedup(clash).columns == clash.columns
