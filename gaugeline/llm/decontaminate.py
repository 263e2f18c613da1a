"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are runs of letters, digits and non-ASCII bytes, lower-cased. The items' word sequences go into one suffix
automaton (built anew from the root for each item); a document's words are streamed through it, tracking the
longest suffix that is a substring of an item. A suffix of at least ``width`` words ends an occurrence of a window;
items of fewer words count as whole ones, found along suffix links. The words of all occurrences are hit.

The automaton is broadcast in blocks of at most ``block_words`` item words, one held at a time, so memory is bounded
however many items there are. Documents are scanned where they lie: no shuffle.

Defined cases: null, empty and wordless texts have no words and no hits; wordless items never occur; repeated items
count one by one by id; null item ids match but aren't listed; very long texts are streamed whole; an empty
benchmark hits nothing. ``scan`` adds ``n_words, n_hit, items, spans``, which replace input columns; ``decontaminate`` rewrites the text
and keeps all other columns, whatever their names; repeated documents are scanned one by one; a text exactly at
``max_coverage`` stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden

SPLIT = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(SPLIT)


class SuffixAutomaton:
    def __init__(self, items: list[list[bytes]], width: int):
        self.width, self.vocab = width, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in item] for item in items]
        for item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        #: Items with a window (of the full width) in the state, and short items ending in it: state -> [(length, item)].
        self.windows: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(coded):
            state, n = 0, 0
            for c in item:
                state, n = self.next[state][c], n + 1
                if n >= width:
                    self.windows.setdefault(self.reduce(state), set()).add(k)
            if 0 < n < width:
                self.short.setdefault(state, []).append((n, k))
        #: The nearest state at or above a state that ends a short item (-1: none).
        self.up = [-1] * len(self.link)
        for v in sorted(range(len(self.link)), key=self.len.__getitem__):
            self.up[v] = v if v in self.short else self.up[self.link[v]] if v else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        new = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def reduce(self, state: int) -> int:
        """The state of the suffix of ``width`` words."""
        while self.len[self.link[state]] >= self.width:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of occurrences, in order of their ends, and the items."""
        nxt, link, size, up, width, get = self.next, self.link, self.len, self.up, self.width, self.vocab.get
        spans, items, state, n = [], set(), 0, 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = n = 0
                continue
            while c not in nxt[state]:
                state = link[state]
                if state < 0:
                    break
                n = size[state]
            if state < 0:
                state = n = 0
                continue
            state, n = nxt[state][c], n + 1
            if n >= width:
                spans.append((i + 1 - width, i + 1))
                items |= self.windows[self.reduce(state)]
            at = up[state]
            while at > 0:
                for k, item in self.short[at]:
                    if k <= n:
                        spans.append((i + 1 - k, i + 1))
                        items.add(item)
                at = up[link[at]]
        return spans, items


def _blocks(benchmark: DataFrame, width: int, block_words: int, id_col: str, text_col: str) -> list:
    sc, blocks, words, ids, n = benchmark.sparkSession.sparkContext, [], [], [], 0

    def close():
        if words:
            blocks.append((sc.broadcast((list(words), width)), list(ids)))

    for r in benchmark.select(id_col, text_col).toLocalIterator():
        w = _plain(r[1]).split()
        if n + len(w) > block_words:
            close()
            words.clear()
            ids.clear()
            n = 0
        words.append(w)
        ids.append(r[0])
        n += len(w)
    close()
    return blocks


_BUILT: dict = {}


def _finder(docs: DataFrame, benchmark: DataFrame, width: int, block_words: int, id_col: str, text_col: str):
    """A UDF from a text to (n_words, n_hit, items, spans)."""
    blocks = [(i, held, ids) for i, (held, ids) in enumerate(_blocks(benchmark, width, block_words, id_col, text_col))]
    stamp = f"{docs.sparkSession.sparkContext.applicationId}-{id(blocks)}-{np.random.default_rng().integers(1 << 60)}"

    def automaton(i, held):
        if (stamp, i) not in _BUILT:
            _BUILT.clear()
            _BUILT[(stamp, i)] = SuffixAutomaton(*held.value)
        return _BUILT[(stamp, i)]

    def one(plain: bytes, auto, found):
        words = plain.split()
        spans, items = auto.stream(words)
        if spans:
            marks = found.setdefault("marks", np.zeros(len(words) + 1, np.int64))
            for a, b in spans:
                marks[a] += 1
                marks[b] -= 1
            found["items"] |= items
        return len(words)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plains = [_plain(t) for t in b]
            found = [{"items": set(), "ids": set()} for _ in plains]
            sizes = [len(p.split()) for p in plains] if not blocks else [0] * len(plains)
            for i, held, ids in blocks:
                auto = automaton(i, held)
                for k, p in enumerate(plains):
                    sizes[k] = one(p, auto, found[k])
                    if found[k]["items"]:
                        found[k]["ids"] |= {str(ids[j]) for j in found[k]["items"] if ids[j] is not None}
                        found[k]["items"] = set()
            rows = []
            for p, n, f in zip(plains, sizes, found, strict=True):
                if "marks" not in f:
                    rows.append((n, 0, [], []))
                    continue
                hit = np.cumsum(f["marks"])[:-1] > 0
                rows.append((n, int(hit.sum()), sorted(f["ids"]), _bytes(p, hit)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return F.pandas_udf(run, "n_words long, n_hit long, items array<string>, spans array<array<int>>").asNondeterministic()


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, block_words: int = 1_000_000, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with n_words, n_hit, items (ids, sorted as strings) and spans (byte offsets [from, to) in UTF-8, merged)."""
    own = Hidden(docs)
    rows = own.df.withColumn("f", _finder(docs, benchmark, width, block_words, id_col, "text" if "text" in benchmark.columns else text_col)(F.col(own[text_col]).cast("string")))
    return own.show(rows, **{n: F.col(f"f.{n}") for n in ("n_words", "n_hit", "items", "spans")})


def _bytes(plain: bytes, hit: np.ndarray) -> list[list[int]]:
    """Byte offsets of runs of hit words."""
    a = np.frombuffer(plain, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], a, [0])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
    return [[int(start[x]), int(end[y - 1])] for x, y in zip(run[::2], run[1::2], strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, max_coverage: float = 0.5, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Hit spans leave the text; a document with more than ``max_coverage`` of its words hit goes as a whole."""
    own = Hidden(docs)
    found = _finder(docs, benchmark, width, 1_000_000, "item_id", "text")(F.col(own[text_col]).cast("string"))
    rows = own.df.withColumn("f", found).select("*", "f.n_words", "f.n_hit", "f.spans").where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    text = F.col(own[text_col])
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s[1]))
    ends = F.concat(F.transform("spans", lambda s: s[0]), F.array(F.octet_length(text)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.decode(F.substring(raw, x["a"] + 1, x["b"] - x["a"]), "UTF-8"))
    out, put = rows.withColumn("new", F.when(F.size("spans") > 0, F.array_join(pieces, " ")).otherwise(text)), {text_col: F.col("new")}
    if length_col:
        put[length_col] = F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col(own[length_col]))
    return own.show(out, put=put)


def op6_decontaminate(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = scan(docs.select("doc_id", "text"), bench)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
