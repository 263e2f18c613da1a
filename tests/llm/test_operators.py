"""The ten operators against brute force, and their defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeline.llm import decontaminate, language, lm, mixing, neighbours, quality, secrets, simhash, urlfilter, warc
from tests.conftest import SMALL

ODD = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x " * 30, "b"), (5, "long " * 60_000, "c"), (6, "the cat sat on the mat", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("lang", F.col("source")).withColumn("n", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("score", F.lit("clash"))


def size(text):
    return len((text or "").encode().split())


def test_mixing_targets_and_counts(spark, docs, local):
    got = mixing.mix_sources(docs).toPandas().set_index("doc_id")
    assert (got["size"] == local.set_index("doc_id")["text"].map(size).reindex(got.index)).all()
    sizes = got.groupby("source")["size"].sum()
    names = sorted(sizes.index, key=lambda s: s.encode())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sizes.sum()), set(names), {}
    while True:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
        left = sizes.sum() - sum(target[s] for s in names if s not in open_)
    for s, g in got.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(target[s]) and g["taken"].sum() == pytest.approx(target[s], rel=0.03, abs=64)
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix_sources(docs.repartition(7)).toPandas().set_index("doc_id")["taken"]
    assert (again.reindex(got.index) == got["taken"]).all()


def test_sainte_lague_is_exact(spark):
    votes, seats = [0, 1, 5, 13, 400, 7, 7], 33
    df = spark.createDataFrame(list(enumerate(votes)), "i int, v long").withColumn("s", F.lit(seats))
    got = [r["n"] for r in mixing.sainte_lague(df, "v", "s", ["i"], [], "n").orderBy("i").collect()]
    want = [0] * len(votes)
    for _ in range(seats):
        want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == want


def test_mixing_defined_cases(spark, odd):
    got = mixing.mix_sources(odd).toPandas()
    assert len(got) == len(ODD) and (got.loc[got["size"] == 0, "taken"] == 0).all()
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_url_filter_intervals(spark):
    entries = spark.createDataFrame([("bad.org", "block", 10), ("bad.org", "clear", 20), ("ok.bad.org", "allow", 5), (None, "block", 1)], "key string, action string, t long").select("key", "action", F.timestamp_seconds("t").alias("since"))
    rows = [("http://bad.org/x", 9), ("http://bad.org/x", 10), ("http://www.bad.org/", 19), ("http://bad.org/", 20), ("https://OK.bad.org:80/p", 15), ("nonsense", 15), (None, 15), ("http://bad.org/", None)]
    caps = spark.createDataFrame(rows, "url string, t long").withColumn("fetched_at", F.timestamp_seconds("t"))
    got = {(r["url"], r["t"]): (r["action"], r["blocked"]) for r in urlfilter.filter_urls(caps, entries).collect()}
    assert [got[r] for r in rows] == [("none", False), ("block", True), ("block", True), ("none", False), ("allow", False), ("none", False), ("none", False), ("none", False)]


@pytest.mark.parametrize("name", ["op2_filter_urls", "op7_warc"])
def test_sql(spark, duck, name):
    from gaugeline.llm import catalog

    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.SQL[name]).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).astype(str).values.tolist()))
    assert key(got) == key(want)


def test_quality_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    test = got[got["held_out"]]
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((test["predicted"] == 1) == (test["quality"] == 1)).mean() > 0.9
    clean = test[test["quality"] == 1]
    assert clean["predicted"].mean() > 0.95
    model = quality.fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_quality(odd, model).collect()} == {0.5}


def test_language_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = language.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
    rows = language.identify_language(odd, language.fit_profiles(odd)).toPandas()
    assert (rows.loc[rows["text"].fillna("") == "", "lang_pred"] == "und").all() and rows["score"].between(0, 1).all()
    assert (language.identify_language(odd, language.Profiles([], [], 300)).toPandas()["lang_pred"] == "und").all()


def brute_fingerprint(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_meet_within_one_bit():
    r = np.random.default_rng(0).integers(0, 1 << 23, 300)
    keys = simhash.golay_keys(r)
    assert max(len(set(k)) for k in keys.tolist()) <= 6
    for bit in range(23):
        other = simhash.golay_keys(r ^ (1 << bit))
        assert all(set(a) & set(b) for a, b in zip(keys.tolist(), other.tolist()))


def components_of(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_simhash_is_exact(spark, docs, local):
    got = simhash.op5_simhash(spark, SMALL).toPandas().set_index("doc_id")
    fps = {i: brute_fingerprint(t) for i, t in zip(local["doc_id"], local["text"])}
    assert all(int(got.loc[i, "fingerprint"], 16) == f for i, f in fps.items())
    comp = components_of(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    assert all(got.loc[i, "component_id"] == least[comp[f]] for i, f in fps.items())


@pytest.mark.parametrize("limit", [0, 1000])
def test_links_of_a_crowded_group(spark, limit):
    """Many fingerprints around one centre: small buckets by pairs and large ones by points give the same components."""
    r = np.random.default_rng(1)
    fps = {int(x) for x in r.integers(0, 1 << 63, 40)}
    for _ in range(120):
        f = 0x123456789ABCDEF
        for b in r.choice(64, 3, replace=False):
            f ^= 1 << int(b)
            fps.add(f & (2**63 - 1))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges, _ = simhash.links(df, pair_limit=limit)
    nodes, _ = simhash.components(edges)
    got = {r["node"]: r["root"] for r in nodes.collect()}
    want = components_of(fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_dedup_defined_cases(spark, odd):
    got = simhash.dedup(odd).toPandas()
    assert sorted(got["doc_id"].dropna()) == [1, 3, 5, 6] and len(got) == 5
    assert list(got.columns) == odd.columns and simhash.dedup(odd.limit(0)).count() == 0


def brute_scan(text, items, width=10):
    words = decontaminate._plain(text).split()
    hit, found = set(), set()
    for k, item in items:
        w = decontaminate._plain(item).split()
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(k))
    return len(words), len(hit), sorted(found)


def test_decontamination_is_exact(spark, docs, local):
    rows = [(1, "the"), (2, "a b a b a"), (3, "A, b; a b a b a b a b a c d e f"), (4, ""), (None, "q r s"), (5, "c d e f g h i j k l m n")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = ["x the y", "a b a b a b a b a b a b", "zz c d e f g h i j k l m q r s", None, "", "b a b a c the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(df, bench).collect()}
    for i, t in enumerate(texts):
        n, h, items = brute_scan(t, rows)
        assert got[i] == (n, h, [x for x in items if x != "None"])
    blocks = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(df, bench, block_words=6).collect()}
    assert blocks == got
    real = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    whole = decontaminate.op6_decontaminate(spark, SMALL).toPandas().set_index("doc_id")
    for i, t in list(zip(local["doc_id"], local["text"]))[:40]:
        n, h, items = brute_scan(t, [(r["item_id"], r["text"]) for r in real])
        assert tuple(whole.loc[i, ["n_words", "n_hit", "n_items"]]) == (n, h, len(items)) and whole.loc[i, "items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_spans_leave_the_text(spark):
    bench = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    df = spark.createDataFrame([(1, "été ok, W0 w1 w2 w3 w4-w5 w6 w7 w8 w9! then some more words follow here and there again ok", 9)], "doc_id long, text string, n_chars long")
    got = decontaminate.decontaminate(df, bench, length_col="n_chars").first()
    assert "w5" not in got["text"] and got["text"].startswith("été ok,") and got["text"].endswith("again ok") and got["n_chars"] == len(got["text"])
    assert decontaminate.decontaminate(df, bench.limit(0)).first()["text"] == df.first()["text"]


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 800
    rows = [(1, "http://a", f"x\n{inner}{inner}"), (2, None, None), (3, "http://b", big), (7, "http://c d", big), (None, "http://e", big), (4, "u", inner)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    warc.write_warc(pages, path)
    assert warc.read_candidates(spark, path).where("record_type = 'response' and record_id = '<urn:page:99>'").count() == 3
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert set(got) == {1, 2, 3, 4, 7, None}
    for i, u, h in rows:
        body = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["url"]) == (len(body), hashlib.sha1(body).hexdigest(), u)
    assert got[3]["refers_to"] == 7 and got[3]["record_type"] == "revisit" and got[None]["record_type"] == "revisit" and got[7]["record_type"] == "response"


def test_secrets(spark, odd):
    forest = secrets.SecretForest(secrets.labelled_findings(spark, 1600), trees=8)
    h = hashlib.sha256(b"k").hexdigest()[:40]
    texts = [f'le token = "{h}" fin', "card 4026083977531332 is", f"commit {h} done", None, "", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["findings"] for r in secrets.scan_secrets(df, forest).collect()}
    assert got[0][0]["is_secret"] and got[0][0]["start"] == texts[0].index(h) + 1 and not got[1][0]["is_secret"] and not got[2][0]["is_secret"]
    assert got[3] == [] == got[4] == got[5]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, forest).collect()}
    assert clean[0] == 'le token = "[SECRET]" fin' and [clean[i] for i in range(1, 6)] == texts[1:]
    assert secrets.redact_secrets(odd, forest).count() == len(ODD)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall(spark, sf):
    got = neighbours.op9_neighbours(spark, f"/root/testdata/{sf}").toPandas()
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids, hit = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy(), 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    for i in asked:
        s = u @ u[i]
        s[i] = -9
        mine = got[got["query_id"] == ids[i]].sort_values("rank")
        hit += len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, -s))[:5]]))
        assert mine["score"].to_numpy() == pytest.approx(s[np.searchsorted(ids, mine["vec_id"])])
    assert hit / len(asked) / 5 >= 0.9


def test_neighbours_do_not_depend_on_partitions_or_blocks(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ask = lambda df, **o: sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 50 == 0, sample=700, **o).collect()))
    want = ask(e.coalesce(1))
    assert len(want) == 5 * e.where("vec_id % 50 = 0").count()
    assert ask(e.repartition(3)) == want == ask(e.repartition(8)) == ask(e, block=300, query_block=9)


def test_neighbours_ties_and_odd_vectors(spark):
    nan, find = float("nan"), lambda rows, q, kind="long": [(r["vec_id"], r["score"]) for r in neighbours.search(spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, score string, rank int, q string"), q).orderBy("query_id", "rank").collect()]
    make = lambda rows: [(i, v, "clash", 7, "clash") for i, v in rows]
    rows = make([(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [4.0, 0.0]), (2, [4.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0]), (10, [])])
    assert find(rows, F.col("vec_id") == 0) == [(2, 1.0), (3, 1.0), (4, 0.0)]
    assert find(rows, F.col("vec_id") == 9) == []
    assert find(make([("b", [1.0, 0.0]), ("a", [3.0, 0.0]), ("q", [2.0, 0.0])]), F.col("vec_id") == "q", "string") == [("a", 1.0), ("b", 1.0)]
    assert find(make([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 5.0])]), F.col("vec_id") == 0) == [(1, 1.0)]
    wide = make([(0, [1e200, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [5e-324, 0.0]), (4, [1.0, 0.0])])
    got = dict(find(wide, F.col("vec_id") == 0))
    assert got == pytest.approx({1: math.sqrt(0.5), 2: 1.0, 3: 1.0, 4: 1.0})
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_lm_contract(spark, local, odd):
    got = lm.op10_lm_score(spark, SMALL).toPandas().set_index("doc_id")
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in zip(local["doc_id"], local["text"])}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    norm = math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    for i, ws in words.items():
        r = got.loc[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), sum(c.values()))
        assert r["base_score"] == pytest.approx(sum(math.log10(c[w] + 0.5) - norm for w in ws))
    assert (got["score"] < 0).all() and got["held_out"].sum() > 0
    again = lm.score_documents(spark.createDataFrame(local).repartition(3), most_words=50).toPandas().set_index("doc_id")
    assert again["base_score"].reindex(got.index).to_numpy() == pytest.approx(got["base_score"].to_numpy())
    rows = lm.score_documents(odd.withColumn("held_out", F.lit("clash")).withColumn("_row", F.lit("clash")))
    assert rows.count() == len(ODD) and [k for k, _ in rows.dtypes] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert lm.score_documents(odd.limit(0)).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = lm.op10_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.05


def small_scorer(texts, classes=5, least=2):
    """A scorer fitted without Spark, and the n-gram counts that it keeps."""
    import pyarrow as pa

    path = lm.tokenizer_path()
    words, n = lm.split_words(pa.array(texts))
    count = Counter(words.to_pylist())
    names = [*sorted(count), lm.END]
    weight = np.array([count.get(w, len(texts)) for w in names])
    starts, symbols, grams, spans = Counter(), Counter(), Counter(), Counter()
    for w, k in zip(names, weight):
        ids = lm.encode_words([w], path)[0].tolist()
        starts[ids[0]] += k
        for j in range(len(ids) if w else 0):
            after = ids[j + 1] if j + 1 < len(ids) else lm.STOP
            symbols[after] += k
            for d in (1, 2, 3):
                if d <= j + 1:
                    c = tuple(ids[j + 1 - d : j + 1])
                    spans[c] += k
                    grams[c, after] += k
    spans = {c: k for c, k in spans.items() if k >= least}
    grams = {g: k for g, k in grams.items() if k >= least and g[0] in spans}

    def pack(c):
        out = 0
        for x in [lm.NONE] * (3 - len(c)) + list(c):
            out = out << lm.BITS | x
        return out

    dense = lambda x: np.array([x[i] for i in range(lm.PIECES + 1)], float)
    arrays = lambda d: (np.array(list(d)), np.array(list(d.values())))
    s = lm.Spelling(dense(starts), dense(symbols), arrays({pack(c) << lm.BITS | y: k for (c, y), k in grams.items()}), arrays({pack(c): k for c, k in spans.items()}))
    m = lm.Attention(classes=classes)
    s.group(np.random.default_rng(0).integers(0, classes, lm.PIECES + 1))
    m.w = {k: np.random.default_rng(4).normal(size=x.shape).astype(np.float32) * 0.4 for k, x in m.w.items()}
    return lm.Scorer(names, weight, int(weight.sum()), len(names), s, m, path), (starts, symbols, grams, spans)


def brute_next(scorer, kept, ids, starts_word):
    """(2, ids) p of each id within the word, and of each that starts a word or ends the text, after ``ids``, by the formula; starts_word: of each id before."""
    starts, symbols, grams, spans = kept
    share = np.array([starts[i] + 0.05 for i in range(lm.PIECES + 1)])
    share /= share.sum()
    word = []
    for i, s in zip(ids, starts_word):
        word = [i] if s else [*word, i]
    prior = np.stack([0 * share, share])
    if ids:
        p = np.array([symbols[i] + 0.05 for i in range(lm.PIECES + 1)])
        p /= p.sum()
        for d in range(1, min(3, len(word)) + 1):
            c = tuple(word[-d:])
            if c in spans:
                own = np.array([max(grams.get((c, y), 0) - lm.DISCOUNT, 0) for y in range(lm.PIECES + 1)]) / spans[c]
                p = own + (1 - own.sum()) * p
        prior = np.stack([p, p[lm.STOP] * share])
        prior[0, lm.STOP] = 0
    w = {k: x.astype(float) for k, x in scorer.model.w.items()}
    inputs = [lm.BOS, *ids]
    at = len(inputs) - 1
    lo = max(0, (at // lm.STRIDE - 1) * lm.STRIDE)
    x = w["E"][inputs[lo : at + 1]]
    s = (x @ w["K"]) @ (x[-1] @ w["Q"]) / np.sqrt(lm.DIM) + w["R"][np.arange(len(x))[::-1]]
    a = np.exp(s) / np.exp(s).sum()
    weights = (x[-1] + (a @ (x @ w["V"])) @ w["O"]) @ w["C"] + w["B"]
    raw = prior * np.exp(weights)[scorer.spelling.classes]
    return raw / raw.sum(), prior


def test_lm_score_is_the_formula_and_sums_to_one():
    """Each text's score against a plain reckoning of every id's probability; the prior and the probabilities sum to one."""
    import pyarrow as pa

    texts = ["the cat sat on the mat and the other cat", "a theory of other things, thinking", "the cat", "internationalisation of the nation " * 6]
    scorer, kept = small_scorer(texts)
    for t in [*texts, "", None, "unseen zzyzx thé"]:
        words = (t or "").lower().split()
        ids, first = [], []
        for w in [*words, lm.END]:
            got = lm.encode_words([w], scorer.path)[0].tolist()
            ids += got
            first += [True] + [False] * (len(got) - 1)
        total = 0.0
        for k, i in enumerate(ids):
            p, prior = brute_next(scorer, kept, ids[:k], first[:k])
            assert p.sum() == pytest.approx(1) and prior.sum() == pytest.approx(1)
            total += math.log10(p[int(first[k]), i])
        n, known, base, score, rare, many = scorer.score(pa.array([t], pa.string()))
        assert score[0] == pytest.approx(total, abs=2e-3) and n[0] == len(words) + 1


def test_lm_class_masses_sum_to_one():
    scorer, _ = small_scorer(["one two three two", "three threes"])
    assert scorer.spelling.mass.sum(1) == pytest.approx(1, abs=1e-5)


def test_each_id_is_scored_once_with_the_half_window_before():
    import pyarrow as pa

    scorer, _ = small_scorer(["one two three " * 30, "x"])
    words, n = lm.split_words(pa.array(["one two three " * 30, "", "x y"]))
    got = scorer.lay_out(words, n)
    each = [len(lm.encode_words([w], scorer.path)[0]) for w in words.to_pylist()]
    assert got["valid"].sum() == sum(each) + 3
    windows = scorer.windows(got, np.arange(len(got["text"])))
    for k in np.flatnonzero(~got["lead"]):
        assert (windows[k, : lm.STRIDE] == windows[k - 1, lm.STRIDE :]).all()
    assert (windows[got["lead"], : lm.STRIDE] == lm.PAD).all() and (windows[got["lead"], lm.STRIDE] == lm.BOS).all()


def test_attention_gradient():
    r = np.random.default_rng(0)
    m = lm.Attention(classes=7)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    t, y = r.integers(0, lm.PIECES, (3, lm.LENGTH)), r.integers(0, 7, (3, lm.STRIDE))
    t[0, : lm.STRIDE] = lm.PAD
    mass, valid = r.dirichlet(np.ones(7), (3, lm.STRIDE)), r.random((3, lm.STRIDE)) < 0.8
    _, g = m.step(t, y, mass, valid)
    for k in m.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, eps, losses = m.w[k][at], 1e-5, []
        for d in (eps, -eps):
            m.w[k][at] = was + d
            losses.append(m.step(t, y, mass, valid)[0])
        m.w[k][at] = was
        assert (losses[0] - losses[1]) / (2 * eps) == pytest.approx(g[k][at], rel=2e-2, abs=1e-6)


def test_word_rules():
    import pyarrow as pa

    words, n = lm.split_words(pa.array([" A\tb\x0bC ", None, "", "É x"]))
    assert words.to_pylist() == ["a", "b", "c", "É", "x"] and n.tolist() == [3, 0, 0, 2]
    assert re.findall(mixing.WORD, "a\x1cb c") == ["a\x1cb", "c"]


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash_large_buckets(spark, bits):
    """Buckets over the limit give the components of all pairs, for each number of differing bits."""
    rng = np.random.default_rng(bits)
    fps = sorted({int(x) for x in rng.choice(1 << 9, 90, replace=False)})
    edges, _ = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), max_bits=bits, pair_limit=2)
    roots, _ = simhash.components(edges)
    got = {r["node"]: r["root"] for r in roots.collect()}
    want = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= bits:
                    want[a] = want[b] = min(want[a], want[b])
    assert {f: got.get(f, f) for f in fps} == want


def test_passages_cover_a_share_of_every_text():
    n, h = np.array([0, 5, 40, 41, 1000, 7]), np.array([3, 9, -4, 1, 12345, 0])
    pick, size, first, last = lm.passages(n, h, 4)
    text = np.repeat(np.arange(len(n)), n)[pick]
    assert set(text.tolist()) == {1, 2, 3, 4, 5} and size.sum() == len(pick) and len(set(pick.tolist())) == len(pick)
    assert (text == 4).sum() in (240, 250, 260, 280) and len(size) == len(first) == len(last) == 5 + (np.count_nonzero(text == 4) + 39) // 40
    every = lm.passages(n, h, 1)
    assert (every[0] == np.arange(n.sum())).all() and every[2].sum() == every[3].sum() == len(n)


def test_warc_headers_for_other_readers(spark, tmp_path):
    import gzip

    big = "y" * 1200
    rows = [(1, "https://a.org/x?y=1&z=%20é", big), (2, "http://b/\r\nWARC-Type: x", big)]
    path = tmp_path / "w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), "file://" + str(path))
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in path.glob("part-*"))
    assert "WARC-Target-URI: https://a.org/x?y=1&z=%20é\r\n".encode() in plain and plain.count(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n") == 1
    got = {r["page_id"]: (r["url"], r["record_type"]) for r in warc.read_warc(spark, "file://" + str(path)).collect()}
    assert got == {1: (rows[0][1], "revisit"), 2: ("http://b/%0D%0AWARC-Type: x", "response")}
