"""Quality classifier: learned embeddings of hashed words and character n-grams, averaged per document.

Features of a text (ASCII lower-cased, in pieces of 1 MiB cut at white space): each word, each word pair,
a mark for a repeated word, and each run of 3 and 4 bytes, hashed into ``2**bits`` buckets. A document is
the mean of its features' vectors; softmax over two classes follows. Training is numpy stochastic gradient
descent over at most ``max_train`` labelled documents (a bound by hash order, so the driver holds a fixed
amount); scoring multiplies vectors and output weights once, so a feature costs one lookup.

Defined cases: null and empty texts have no feature and get the bias alone; with no labelled row the score
is 0.5, with labels of one class the smoothed prior; null labels don't count; repeated rows count as often
as they occur; an empty table gives an empty result; a score equal to the
threshold counts as good; ids may be of any type. At least ``least_steps`` descent steps are made, so that few labelled rows
are seen more often. ``score`` and ``predicted`` replace input columns of ``score_quality``; other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden, fold

MULT = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(1099511628211)
STEP_INV = np.uint64(pow(1099511628211, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        up, down = np.full(n, STEP, np.uint64), np.full(n, STEP_INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _pieces(data: bytes) -> Iterator[bytes]:
    while len(data) > PIECE:
        at = data.rfind(b" ", 1, PIECE)
        at = at if at > 0 else PIECE
        yield data[:at]
        data = data[at:]
    yield data


def hashed(data: bytes, bits: int) -> list[np.ndarray]:
    """Bucket numbers of one piece: words, word pairs with repeat marks, runs of 3 and of 4 bytes; uint32 arrays."""
    shift = np.uint64(64 - bits)
    a = np.frombuffer(data, np.uint8)
    out = []
    if len(a) >= 3:
        low = a.astype(np.uint32)
        tri = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))
        out.append(((tri.astype(np.uint64) + np.uint64(1 << 40)) * MULT >> shift).astype(np.uint32))
        if len(a) >= 4:
            four = tri[:-1] | (low[3:] << np.uint32(24))
            out.append((four.astype(np.uint64) * MULT >> shift).astype(np.uint32))
    gap = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([1], gap, [1])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start):
        up, down = _powers(len(a) + 1)
        pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        words = (pre[end] - pre[start]) * down[start]
        out.append(((words ^ (words >> np.uint64(29))) * MULT >> shift).astype(np.uint32))
        pair = words[:-1] * np.uint64(3) + words[1:]
        pair = np.where(words[:-1] == words[1:], np.uint64(12345), pair)
        out.append(((pair ^ (pair >> np.uint64(31))) * MULT >> shift).astype(np.uint32))
    return out


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def sparse(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares, as small as they travel to the driver (up to 16 bits a bucket)."""
    got = [x for p in _pieces(_data(text)) for x in hashed(p, bits)]
    if not got:
        return np.zeros(0, np.uint16), np.zeros(0, np.float16)
    ids, n = np.unique(np.concatenate(got), return_counts=True)
    return ids.astype(np.uint16), (n / n.max()).astype(np.float16)


def train(ids: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, *, bits: int, dim: int = 8, epochs: int = 12, least_steps: int = 400, lr: float = 6.0, batch: int = 16, seed: int = 5) -> tuple[np.ndarray, float]:
    """SGD; returns for each bucket its logit difference (class 1 less class 0), and the bias."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, int)
    if len(y) == 0 or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior)))
    emb = rng.uniform(-1, 1, (1 << bits, dim)).astype(np.float32) / dim
    out, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    rounds = -(-len(y) // batch)
    epochs = max(epochs, -(-least_steps // rounds))  # few rows are seen more often
    steps, done = epochs * rounds, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), rounds):
            rate = lr * (1 - done / steps)
            done += 1
            n = np.array([len(ids[i]) for i in at])
            flat = np.concatenate([ids[i] for i in at])
            share = np.concatenate([shares[i].astype(np.float32) / max(float(shares[i].sum(dtype=np.float64)), 1e-9) for i in at])
            row = np.repeat(np.arange(len(at)), n)
            hidden = np.zeros((len(at), dim), np.float32)
            vec = emb[flat]
            vec *= share[:, None]
            full = np.flatnonzero(n)
            if len(full):
                hidden[full] = np.add.reduceat(vec, np.concatenate(([0], np.cumsum(n[full])[:-1])))
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = (p @ out.T) * rate * len(at)  # each document moves its own vectors at the full rate
            out -= rate * 0.1 * hidden.T @ p
            bias -= rate * 0.02 * p.sum(0)
            np.subtract.at(emb, flat, share[:, None] * back[row])
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class QualityModel:
    def __init__(self, table: np.ndarray, bias: float, bits: int):
        self.table, self.bias, self.bits = table, bias, bits

    def score(self, texts) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            total, n = 0.0, 0
            for p in _pieces(_data(t)):
                for x in hashed(p, self.bits):
                    total += float(self.table[x].sum(dtype=np.float64))
                    n += len(x)
            out[i] = total / max(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bits: int = 16, max_train: int = 3000) -> QualityModel:
    """Learn from at most ``max_train`` labelled rows outside fold 0, chosen by hash of the id."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train)
    kind = chosen.schema["_id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast(kind).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sparse(t, bits) for t in b["_t"]]
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "ids": [g[0].tobytes() for g in got], "shares": [g[1].tobytes() for g in got]})

    got = rows.mapInPandas(featurise, f"_id {kind}, _y int, ids binary, shares binary").toPandas().sort_values(["_id", "_y", "ids"])
    ids = [np.frombuffer(x, np.uint16) for x in got["ids"]]
    shares = [np.frombuffer(x, np.float16) for x in got["shares"]]
    table, bias = train(ids, shares, got["_y"].to_numpy(), bits=bits)
    return QualityModel(table, bias, bits)


def _scorer(docs: DataFrame, model: QualityModel):
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.bits))  # 2**bits floats: a fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = QualityModel(*held.value)
        for b in batches:
            yield pd.Series(m.score(b.tolist()))

    return F.pandas_udf(run, "double").asNondeterministic()


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows and columns with ``score`` and ``predicted``."""
    own = Hidden(docs)
    rows = own.df.withColumn("s", _scorer(docs, model)(F.col(own[text_col]).cast("string")))
    return own.show(rows, score=F.col("s"), predicted=(F.col("s") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns as they are."""
    own = Hidden(docs)
    return own.show(own.df.withColumn("s", _scorer(docs, model)(F.col(own[text_col]).cast("string"))).where(F.col("s") >= threshold))


def op3_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
