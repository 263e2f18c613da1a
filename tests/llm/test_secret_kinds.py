"""Kinds of secrets that the candidate patterns have to let through to the forest."""

import base64
import hashlib

import pytest

from gaugeline.llm import secrets

BODY = "\n".join(base64.b64encode(hashlib.sha384(str(i).encode()).digest()).decode() for i in range(400))
PLAIN = f"-----BEGIN PRIVATE KEY-----\n{BODY}\n-----END PRIVATE KEY-----"
HEADED = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D4E5F60718293A4B5C6D7E8F9\n\n{BODY[:1500]}\n-----END RSA PRIVATE KEY-----"
LATE = "kQzBvXwTnLpRsYdFgHjMcVbN" * 5 + "7" + "aZ3kQ9"
SECRETS = {
    "letters": ('client_secret = "', "kQzBvXwTnLpRsYdFgHjMcVbN", '" end'), "json": ('{"auth_token": "', "QwNzXcVbTmKjHgFdSaPoIuYt", '"}'),
    "upper": ("DB_PASSWORD=", "hunter2secret!", " end"), "title": ("Password: ", "Winter19#", " end"),
    "long block": ("see ", PLAIN, " end"), "headed block": ("see ", HEADED, " end"), "late digit": ("token = ", LATE, " end"),
}


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.SecretForest(secrets.labelled_findings(spark))


def test_all_kinds_are_found_and_masked(spark, forest):
    assert len(PLAIN) > 8000
    df = spark.createDataFrame([(k, "".join(v)) for k, v in SECRETS.items()], "doc_id string, text string")
    got = {r["doc_id"]: r["findings"] for r in secrets.scan_secrets(df, forest).collect()}
    for k, (before, secret, _) in SECRETS.items():
        assert [(f["start"], f["candidate"], f["is_secret"]) for f in got[k]] == [(len(before) + 1, secret, True)], k
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, forest).collect()}
    assert clean == {k: a + secrets.MASK + b for k, (a, _, b) in SECRETS.items()}


def test_the_forest_rejects_plain_words(spark, forest):
    texts = ["Password: required for all", "the token: internationalization of it", "author: representative-of-the-house", "-----BEGIN PRIVATE KEY----- without an end, " * 2000]
    found = secrets.scan_secrets(spark.createDataFrame([(t,) for t in texts], "text string"), forest).collect()
    assert [f["candidate"] for r in found for f in r["findings"] if f["is_secret"]] == []


def test_candidates_are_those_of_the_pattern_alone(spark, forest):
    """Spark's candidates against another engine's matches of the pattern, without the first search, on whole documents."""
    import regex

    pattern = regex.compile(secrets.CANDIDATE)
    odd = ["".join(v) for v in SECRETS.values()] + [None, "", "x" * 16, "a1" * 8, "PassWord:abcdef", "pwd=12345", "ssh-rsa " + "Q1" * 4000, "é1" * 20 + " token: " + "Z" * 16]
    texts = odd + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), forest).collect()
    for r in got:
        want = [(m.start() + 1, m.group()) for m in pattern.finditer(r["text"] or "")]
        assert [(f["start"], f["candidate"]) for f in r["findings"]] == want


def test_the_exported_forest_votes_as_the_trained_one(spark):
    """The nested expressions against MLlib's own probability."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    findings = secrets.labelled_findings(spark, 1500).cache()
    own = secrets.SecretForest(findings, trees=7, depth=5, seed=3)
    named = secrets.features(F.col("candidate"), F.col("before"), F.col("after"))
    data = VectorAssembler(inputCols=secrets.FEATURES, outputCol="x").transform(findings.select("label", "candidate", *[named[k].cast("double").alias(k) for k in secrets.FEATURES]))
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=7, maxDepth=5, seed=3).fit(data)
    both = model.transform(data).withColumn("made", F.struct(*secrets.FEATURES)).withColumn("own", own.score(F.col("made"))).select("own", "probability", "label").collect()
    assert len(both) > 1000 and all(r["own"] == pytest.approx(r["probability"][1], abs=1e-9) for r in both)
    assert sum((r["own"] >= 0.5) == (r["label"] == 1) for r in both) > 0.97 * len(both)


def test_planted_secrets_of_the_documents(spark, forest):
    """Precision and recall on the documents' own planted keys (40 hexadecimal digits) against their card numbers and prose."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    planted = {(r["doc_id"], m.group()) for r in rows for m in re.finditer(r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])", r["text"] or "")}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], f["candidate"]) for r in secrets.scan_secrets(docs, forest).collect() for f in r["findings"] if f["is_secret"]}
    hit = sum(any(s in c for d, c in found if d == i) for i, s in planted)
    assert len(planted) > 10 and hit >= 0.9 * len(planted) and hit >= 0.9 * len(found)
