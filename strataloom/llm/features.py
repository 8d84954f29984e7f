"""Sparse text features and linear models, shared by the toxicity and quality classifiers.

A feature is a 32-bit hash of a word, of a word's first bytes, or of a bin of a text
statistic.  A score adds, over the distinct words of a text, the weight of the word and
of its stem, and the weight of each statistic's bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import split_test, text_bytes, words_of

STEMS = (4, 5)  # bytes; a word of no more has no such stem
_CACHE = 400_000
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_MARK = bytes(b for b in range(256) if b not in b"#*$%&|<>@_^~{}[]=+\\/")
_NOT_SHOUT = bytes(b for b in range(256) if b not in b"!?")

# Bounds of the bins of each statistic.
_BINS = {
    "words": (1, 5, 10, 20, 40, 80, 200, 1000, 5000), "length": (2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 10.0), "upper": (0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.8),
    "digits": (0.001, 0.003, 0.01, 0.03, 0.1, 0.3), "marks": (0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2), "shouts": (0.0005, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97), "again": (0.001, 0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4), "lines": (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
}


def statistics(text: bytes, words: list[bytes], distinct: set[bytes]) -> dict[str, float]:
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    return {
        "words": len(words), "length": sum(map(len, words)) / w, "upper": len(text.translate(None, _NOT_UPPER)) / max(1, len(text.translate(None, _NOT_LETTER))),
        "digits": len(text.translate(None, _NOT_DIGIT)) / n, "marks": len(text.translate(None, _NOT_MARK)) / n, "shouts": len(text.translate(None, _NOT_SHOUT)) / n,
        "distinct": len(distinct) / w, "again": sum(map(bytes.__eq__, words, words[1:])) / w, "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }


#: Every bin's feature, by statistic and number.
BIN_FEATURES = {(k, i): crc32(f"{k}\0{i}".encode(), 2) for k, v in _BINS.items() for i in range(len(v) + 1)}
BIN_IDS = np.array(sorted(BIN_FEATURES.values()), np.uint32)


def bins(stats: dict[str, float]) -> list[int]:
    return [BIN_FEATURES[k, sum(v >= b for b in _BINS[k])] for k, v in stats.items()]


def word_features(word: bytes) -> tuple[int, ...]:
    return (crc32(word), *(crc32(word[:n], n) for n in STEMS if len(word) > n))


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of a text's features; a stem counts once for each distinct word."""
    words = words_of(text)
    distinct = set(words)
    ids = bins(statistics(text, words, distinct))
    for w in distinct:
        ids += word_features(w)
    return np.unique(np.array(ids, np.uint32), return_counts=True)


def sampled_features(docs: DataFrame, wanted: DataFrame) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """Features, on the driver, of the documents in wanted (doc_id, role): a table of a bounded number of rows.

    A document whose id several rows share stands once, as its first text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = [text_features(x.as_py()) for x in t.column(2)]
            yield pa.record_batch({
                "doc_id": t.column(0), "role": t.column(1), "ids": pa.array([a.tobytes() for a, _ in rows], pa.binary()),
                "counts": pa.array([np.minimum(b, 255).astype(np.uint8).tobytes() for _, b in rows], pa.binary()),
            })

    some = text_bytes(docs.select("doc_id", "text")).join(F.broadcast(wanted), "doc_id").select("doc_id", "role", "text")
    seen: dict = {}
    for doc, role, ids, counts in sorted(map(tuple, some.mapInArrow(run, "doc_id long, role int, ids binary, counts binary").collect())):
        seen.setdefault((doc, role), (np.frombuffer(ids, np.uint32), np.frombuffer(counts, np.uint8)))
    return list(seen), common_features(list(seen.values()))


def common_features(rows: list[tuple[np.ndarray, np.ndarray]], least: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows without features that fewer rows have: no model uses those, and they are most of the memory."""
    if not rows:
        return rows
    u, n = np.unique(np.concatenate([a for a, _ in rows]), return_counts=True)
    u = u[n >= least]
    out = []
    for a, b in rows:
        at = np.searchsorted(u, a)
        ok = np.zeros(len(a), bool)
        inside = at < len(u)
        ok[inside] = u[at[inside]] == a[inside]
        out.append((a[ok].copy(), b[ok].copy()))
    return out


def bounded(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most so many rows of ids (doc_id, ...), those with the least hashes."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from; one row an id, the larger label where they differ."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna()
    return some.filter(split_test() != 0).groupBy("doc_id").agg(F.max("y").alias("y"))


class Sparse:
    """Rows of (columns, values) in compressed form: nine bytes an entry, products in slices, as all of it is held by the driver."""

    SLICE = 1 << 18

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray):
        self.n, self.k = len(rows), len(columns)
        ids = np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, np.uint32)
        val = np.concatenate([b for _, b in rows]) if rows else np.zeros(0, np.uint8)
        row = np.repeat(np.arange(self.n, dtype=np.int32), [len(a) for a, _ in rows]) if rows else np.zeros(0, np.int32)
        at = np.searchsorted(columns, ids).astype(np.int32)
        at[at == self.k] = 0
        ok = columns[at] == ids if self.k else np.zeros(len(ids), bool)
        self.row, self.col, self.val = row[ok], at[ok], val[ok]

    def _sum(self, to: np.ndarray, by: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for i in range(0, len(self.val), self.SLICE):
            s = slice(i, i + self.SLICE)
            out += np.bincount(to[s], self.val[s] * x[by[s]], n)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sum(self.row, self.col, w, self.n)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return self._sum(self.col, self.row, r, self.k)


def document_counts(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows that have each, their weight)."""
    ids = np.concatenate([a for a, _ in rows]) if rows else np.zeros(0, np.uint32)
    w = np.repeat(weight, [len(a) for a, _ in rows]) if rows else np.zeros(0)
    u, inv = np.unique(ids, return_inverse=True)
    return u, np.bincount(inv, minlength=len(u)), np.bincount(inv, w, len(u))


def distinct_families(rows) -> list[int]:
    """One row of each family of copies: those whose three least hashed features agree, as near copies mostly do."""
    first: dict[tuple, int] = {}
    for i, (ids, _) in enumerate(rows):
        first.setdefault(tuple(np.sort(ids * np.uint32(2654435761))[:3].tolist()), i)
    return list(first.values())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], k: int, steps: int, rate: float = 0.1, start: np.ndarray | None = None) -> np.ndarray:
    w, m, v = np.zeros(k) if start is None else start.copy(), np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def weights_of(columns: np.ndarray, w: np.ndarray) -> tuple[dict[int, float], float]:
    """(weights by feature, bias) of a fitted vector."""
    return {int(f): round(float(v), 6) for f, v in zip(columns, w) if abs(v) > 1e-3}, round(float(w[-1]), 6)


class Scorer:
    """Scores of texts; the weights of words are remembered."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, w: bytes) -> float:
        x = self.known.get(w)
        if x is None:
            if len(self.known) > _CACHE:
                self.known.clear()
            x = self.known[w] = sum(self.weights.get(i, 0.0) for i in word_features(w))
        return x

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for text in texts:
            words = words_of(text)
            distinct = set(words)
            # sorted, so that a sum is the same on every machine
            out.append(self.bias + sum(self.weights.get(i, 0.0) for i in bins(statistics(text, words, distinct))) + sum(sorted(filter(None, map(self.word, distinct)))))
        return np.array(out, float)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return np.round(sigmoid(self.logits(texts)), 9)


def score_texts(docs: DataFrame, weights: dict[int, float], bias: float, cut: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; a null id counts as held out, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(weights, bias)
        for t in batches:
            yield pa.record_batch({"doc_id": t.column(0), "score": pa.array(score(t.column(1).to_pylist()))})

    out = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(split_test() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_below(docs: DataFrame, weights: dict[int, float], bias: float, cut: float) -> DataFrame:
    """Rows of docs with a score under cut, as they are: one pass, nothing is joined."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(weights, bias)
        for t in batches:
            if t.num_rows:
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in t.column(at).to_pylist()]
                yield t.filter(pa.array(score(texts) < cut))

    return docs.mapInArrow(run, docs.schema)
