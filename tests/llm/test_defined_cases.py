"""Nulls, empty tables, repeated rows, ties, very long texts and clashing column names, for every operator that takes documents."""

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import decontaminate, language, lm, minhash, mixing, quality, secrets, simhash, urlfilter
from tests.llm.test_operators import ODD

#: Names that operators use inside, and those of their results.
NAMES = "_n _shard _tokens _quota _hash _null _src _row _m _fp _set _found _parts _judged _made findings items spans n_hit n_words score predicted lang_pred size source_size target taken host action node root fp s f p new _u0 _u1 Text_ rank".split()


@pytest.fixture(scope="module")
def clash(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return rows.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.SecretForest(secrets.labelled_findings(spark, 400), trees=3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (None, "a b"), (2, None), (3, "")], "item_id long, text string")


def operators(spark, forest, bench):
    none = spark.createDataFrame([], "doc_id long, quality int")
    return {
        "mix": (lambda d: mixing.mix_sources(d), ["size", "source_size", "target", "taken"], True),
        "quality": (lambda d: quality.score_quality(d, quality.fit_quality(d, none)), ["score", "predicted"], True),
        "keep_good": (lambda d: quality.keep_good(d, quality.fit_quality(d, none)), [], True),
        "language": (lambda d: language.identify_language(d, language.Profiles([], [], 300)), ["lang_pred", "score"], True),
        "simhash": (lambda d: simhash.dedup(d), [], False),
        "minhash": (lambda d: minhash.dedup(d), [], False),
        "scan": (lambda d: decontaminate.scan(d, bench), ["n_words", "n_hit", "items", "spans"], True),
        "decontaminate": (lambda d: decontaminate.decontaminate(d, bench, length_col="n_chars"), [], False),
        "scan_secrets": (lambda d: secrets.scan_secrets(d, forest), ["findings"], True),
        "redact": (lambda d: secrets.redact_secrets(d, forest, length_col="n_chars"), [], True),
    }


@pytest.mark.parametrize("name", ["mix", "quality", "keep_good", "language", "simhash", "minhash", "scan", "decontaminate", "scan_secrets", "redact"])
def test_columns_rows_and_empty_tables(spark, clash, forest, bench, name):
    run, added, whole = operators(spark, forest, bench)[name]
    out = run(clash)
    assert out.columns == [c for c in clash.columns if c not in added] + added
    rows = out.collect()
    assert len(rows) == len(ODD) if whole else 0 < len(rows) <= len(ODD)
    for r in rows:
        for c in NAMES:
            if c not in added:
                assert r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}"
    assert run(clash.limit(0)).count() == 0


def test_url_filter_keeps_clashing_columns_and_repeated_captures(spark):
    entries = spark.createDataFrame([("bad.org", "block", 10), ("bad.org", "allow", 10)], "key string, action string, t long").select("key", "action", F.timestamp_seconds("t").alias("since"))
    rows = [("http://bad.org/x", 11, "r", "m"), ("http://bad.org/x", 11, "r", "m"), ("http://bad.org./", 11, None, "m"), ("http://[::1]/", 11, "r", None)]
    caps = spark.createDataFrame(rows, "url string, t long, _row string, _m string").withColumn("fetched_at", F.timestamp_seconds("t"))
    got = urlfilter.filter_urls(caps, entries).collect()
    assert sorted(r["action"] for r in got) == ["block", "block", "none", "none"] and sum(r["_row"] == "r" for r in got) == 3
    assert urlfilter.filter_urls(caps.limit(0), entries).count() == 0 and {r["action"] for r in urlfilter.filter_urls(caps, entries.limit(0)).collect()} == {"none"}


def test_quality_takes_text_ids_and_repeated_labels(spark):
    rows = [(f"d{i}", ("good sound prose here " if i % 2 else "junk 000 $$$ ") * 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(a, i % 2) for i, (a, _) in enumerate(rows)] + [("d1", 1), ("d3", None), (None, 1)], "doc_id string, quality int")
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).toPandas()
    assert ((got["score"] > 0.5) == got["text"].str.startswith("good")).all()


def test_long_texts_are_read_in_pieces_and_count_whole():
    """Texts over the piece size of the quality classifier and of language profiles: their ends count too."""
    import numpy as np

    unit = "lorem ipsum dolor sit amet "
    long = unit * (2 * quality.PIECE // len(unit)) + "zzqx " * 400_000
    ids, shares = quality.sparse(long, 16)
    only = quality.sparse("zzqx " * 50, 16)[0]
    assert np.isin(only[:-1], ids).mean() > 0.9
    table = np.zeros(1 << 16, np.float32)
    table[only] = 1
    m = quality.QualityModel(table, 0.0, 16)
    assert m.score([long])[0] > m.score([long[: quality.PIECE]])[0]
    codes, counts = language.gram_counts("ab " * 600_000)
    assert counts.sum() > 2.9e6 and dict(zip(codes.tolist(), counts.tolist()))[ord("a")] == 600_000


def brute_logit(text, table, bits=16):
    """Features of one text by plain loops: words, word pairs with a repeat mark, runs of 3 and of 4 bytes."""
    mask, mult, step = (1 << 64) - 1, 0x9E3779B97F4A7C15, 1099511628211
    data = text.encode().lower()
    cell = lambda x: x * mult % 2**64 >> (64 - bits)
    out = [cell(int.from_bytes(data[i : i + 3], "little") + (1 << 40)) for i in range(len(data) - 2)] + [cell(int.from_bytes(data[i : i + 4], "little")) for i in range(len(data) - 3)]
    words = [sum((b + 1) * pow(step, i, 2**64) for i, b in enumerate(w)) & mask for w in data.split()]
    out += [cell(w ^ (w >> 29)) for w in words]
    pairs = [12345 if a == b else (a * 3 + b) & mask for a, b in zip(words, words[1:])]
    out += [cell(p ^ (p >> 31)) for p in pairs]
    return sum(float(table[i]) for i in out) / max(1, len(out))


def test_quality_score_is_the_formula():
    import numpy as np

    table = np.random.default_rng(1).normal(size=1 << 16).astype(np.float32)
    m = quality.QualityModel(table, 0.25, 16)
    for t in ["One two two three", "a", "", "ab cd\nef  gh", "été là là"]:
        assert m.score([t])[0] == pytest.approx(1 / (1 + np.exp(-(brute_logit(t, table) + 0.25))), rel=1e-6)


def test_quality_training_step_is_the_gradient():
    """The vectors move against the gradient of the log loss."""
    import numpy as np

    r = np.random.default_rng(0)
    ids = [r.choice(1 << 10, 30, replace=False).astype(np.uint16) for _ in range(40)]
    y = np.array([int((i < 512).sum() > 15) for i in ids])
    table, bias = quality.train(ids, [np.ones(30, np.float16)] * 40, y, bits=10)
    z = np.array([table[i].mean() for i in ids]) + bias
    assert ((z > 0) == (y == 1)).all()


def brute_language(text, profiles, size):
    """Out-of-place distance by plain loops; profiles: language -> ranked n-grams."""
    from collections import Counter

    clean = "".join(c if c.isalpha() else " " for c in " " + text.lower() + " ")
    words = [f" {w} " for w in clean.split()]
    stream = " " + " ".join(w.strip() for w in words) + " "
    grams = Counter(stream[i : i + n] for n in (1, 2, 3) for i in range(len(stream) - n + 1) if stream[i : i + n].strip() and " " not in stream[i : i + n][1:-1])
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    own = sorted(grams, key=lambda g: (-grams[g], code(g)))[:size]
    far = {lang: sum(abs(ranked.index(g) - k) if g in ranked else size for k, g in enumerate(own)) for lang, ranked in profiles.items()}
    best = min(far, key=lambda x: (far[x], x))
    return best, 1 - far[best] / (size * len(own))


def test_language_distance_is_the_formula():
    import numpy as np

    size, train = 12, {"aa": "the cat sat on the mat, the hat", "bb": "der hund und die katze der baum"}
    ranked = {k: language.top(*language.gram_counts(t), size) for k, t in train.items()}
    decode = lambda code: "".join(chr(code >> 21 * k & 0x1FFFFF) for k in (2, 1, 0) if code >> 21 * k)
    names = {k: [decode(int(c)) for c in v] for k, v in ranked.items()}
    p = language.Profiles(sorted(train), [np.asarray(ranked[k]) for k in sorted(train)], size)
    for t in ["the dog and the cat", "der hut", "x", "Tha tha thé 12 the"]:
        want = brute_language(t, names, size)
        got = p.predict(t)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])
