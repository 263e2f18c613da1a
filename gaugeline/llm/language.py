"""Language ID by rank-order profiles: out-of-place distance of a document's most frequent n-grams.

N-grams are 1 to 3 letters of the lower-cased text, words bounded by a space, coded exactly in 63 bits.
A profile is the ``size`` most frequent n-grams of a language's training texts, ranked by count, then code.
A document's own ``size`` most frequent n-grams are compared with each profile; an n-gram missing from a
profile costs ``size``. The score is 1 - distance / largest distance.

Training takes at most about ``max_train`` documents (by hash; a documented bound); counts are summed by
Spark. Profiles are a few hundred rows a language. Defined cases: a null text or one without letters is
``und`` with score 0; equal distances go to the smaller language name; null languages aren't learned; with
nothing to learn from, all is ``und``; very long texts are counted in pieces of 1 M characters and summed;
an empty table gives an empty result. ``lang_pred`` and ``score`` replace input columns;
other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden, fold

PIECE = 1_000_000
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    is_letter = letters()[a]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a gap is one space
    keep[0] = True
    a = np.where(is_letter, a, np.uint64(32))[keep]
    gap = a == 32
    two = (a[:-1] << np.uint64(21)) | a[1:]
    three = (two[:-1] << np.uint64(21)) | a[2:]
    return np.concatenate((a[~gap], two[~(gap[:-1] & gap[1:])], three[~gap[1:-1]]))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of n-grams, ascending, and their counts."""
    text = text or ""
    got = [np.unique(_codes(text[i : i + PIECE]), return_counts=True) for i in range(0, max(1, len(text)), PIECE)]
    if len(got) == 1:
        return got[0]
    codes, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([g[1] for g in got])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes by rank; ties by code."""
    if len(codes) > size:
        least = np.partition(counts, -size)[-size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, langs: list[str], ranked: list[np.ndarray], size: int):
        self.langs, self.size = langs, size
        self.codes = np.unique(np.concatenate(ranked)) if ranked else np.zeros(0, np.uint64)
        self.ranks = np.full((len(langs), len(self.codes)), -1)
        for i, r in enumerate(ranked):
            self.ranks[i, np.searchsorted(self.codes, r)] = np.arange(len(r))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = top(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def fit_profiles(docs: DataFrame, *, size: int = 300, max_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 0)).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_t"))
    n = docs.where(F.col(lang_col).isNotNull() & (fold(id_col) != 0)).count()
    rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_train / max(n, 1))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, g in b.groupby("_lang"):
                got = [x for x in map(gram_counts, g["_t"]) if len(x[0])]
                if got:
                    codes, inverse = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": np.bincount(inverse, np.concatenate([x[1] for x in got])).astype(np.int64)})

    sums = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    got = ranked.select("lang", "code", "rank").toPandas().sort_values(["lang", "rank"])  # size rows a language
    langs = sorted(got["lang"].unique())
    return Profiles(langs, [got.loc[got["lang"] == x, "code"].to_numpy(np.uint64) for x in langs], size)


def identify_language(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # size rows a language

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([held.value.predict(t) for t in b], columns=["lang_pred", "score"])

    udf = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()
    own = Hidden(docs)
    return own.show(own.df.withColumn("p", udf(F.col(own[text_col]).cast("string"))), lang_pred=F.col("p.lang_pred"), score=F.col("p.score"))


def op4_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_language(docs.select("doc_id", "text"), fit_profiles(docs))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")
