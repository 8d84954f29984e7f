"""Quality by positive-unlabelled learning.

Method: a linear classifier minimises the non-negative unbiased risk: with trusted
positives P, unlabelled web text U and the class prior c,

    risk = c * loss(P, +1) + max(0, loss(U, -1) - c * loss(P, -1)).

Where the second term falls below zero by more than a tolerance, the step goes back
against its gradient instead.
The prior is estimated: classifiers that tell P from U score the rows of folds they
weren't fitted on.  Among the rows that look most positive U holds positives only, so the
ratio of U's and P's tails there is c; the least ratio over tails long enough to count is
taken, each held down by its standard error no more than up.  The weights come from a
bounded sample; the prior's tails are counted over all documents.  No negative label is
used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import text_bytes
from .features import BIN_IDS, Scorer, Sparse, adam, bounded, distinct_families, document_counts, learnable, sampled_features, score_texts, sigmoid, weights_of

#: Trusted positives and unlabelled documents learned from, at most.
SAMPLE_ROWS = 6_000
CUT = 0.3
#: Evidence a word's feature needs; statistics' bins are always taken.
Z_SCORE = 5.0
#: How far the second term may fall below zero, and the share of the step taken back then.
TOLERANCE, BACK = 0.05, 0.2
FOLDS = 3
#: Tails of the positives from which the prior is read.
TAILS = np.arange(0.3, 0.96, 0.05)
#: The prior where nothing can be estimated, and its bounds.
PRIOR, LEAST, MOST = 0.5, 0.05, 0.98


def columns_of(rows, pos: np.ndarray) -> np.ndarray:
    """Bins of statistics, and words that tell the two samples apart beyond doubt; a family of copies counts once in each."""
    sides = [np.flatnonzero(pos == v) for v in (1, 0)]
    one = np.concatenate([side[distinct_families([rows[i] for i in side])] for side in sides])
    u, n, p = document_counts([rows[i] for i in one], pos[one])
    share = pos[one].mean()
    z = np.abs(p - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    words = (n >= 8) & (z > Z_SCORE)
    return u[words | np.isin(u, BIN_IDS)]


def _tell_apart(rows, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights) of a logistic model of P against U, either side with half the weight."""
    columns = columns_of(rows, pos)
    x = Sparse(rows, columns)
    weight = np.where(pos > 0, 0.5 / pos.sum(), 0.5 / (1 - pos).sum())

    def gradient(w: np.ndarray) -> np.ndarray:
        r = weight * (sigmoid(x.dot(w[:-1]) + w[-1]) - pos)
        return np.r_[x.tdot(r), r.sum()] + 1e-3 * np.r_[w[:-1], 0]

    return columns, adam(gradient, x.k + 1, 150)


def estimate_prior(p: np.ndarray, u: np.ndarray, often: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from scores of positives (p) and of unlabelled rows (u, each so often) that weren't fitted on.

    At the cut that a given share of p passes, the share of u that passes over it; the least
    over the cuts in TAILS of that ratio less half a standard error.
    """
    n = often.sum()
    if len(p) < 20 or n < 20:
        return PRIOR
    ratios = []
    for tail in TAILS:
        cut = np.quantile(p, 1 - tail)
        a, b = often[u >= cut].sum() / n, (p >= cut).mean()
        spread = np.sqrt(a * (1 - a) / n + (a / b) ** 2 * b * (1 - b) / len(p)) / b
        ratios.append(a / b - 0.5 * spread)
    return float(np.clip(min(ratios), LEAST, MOST))


def _fold(doc) -> int:
    return crc32(str(doc).encode(), 9) % FOLDS


def _tails(docs: DataFrame, models: list[tuple[dict[int, float], float]]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, counts) of all documents, each scored by the model of its fold: counted where they are, a row for each distinct rounded score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(*x) for x in models]
        often: Counter = Counter()
        for t in batches:
            fold = np.array([_fold(d) for d in t.column(0).to_pylist()])
            texts = t.column(1).to_pylist()
            for k, score in enumerate(scorers):
                often.update(_rounded(score.logits([texts[i] for i in np.flatnonzero(fold == k)])).tolist())
        yield pa.record_batch({"s": pa.array(list(often), pa.int64()), "n": pa.array(list(often.values()), pa.int64())})

    some = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "s long, n long")
    rows = some.groupBy("s").agg(F.sum("n").alias("n")).collect()  # at most as many as there are rounded scores
    return np.array([r["s"] for r in rows], float), np.array([r["n"] for r in rows], float)


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores in hundredths between -20 and 20."""
    return np.round(100 * np.clip(score, -20, 20)).astype(np.int64)


def held_out_scores(keys, rows, pos: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A classifier of P against U for each fold, fitted on the other folds, and the rounded scores of the sample's rows by their own fold's."""
    fold = np.array([_fold(d) for d, _ in keys], int)
    models, score = [], np.zeros(len(rows), np.int64)
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        columns, w = _tell_apart([rows[i] for i in rest], pos[rest]) if 0 < pos[rest].sum() < len(rest) else (np.zeros(0, np.uint32), np.zeros(1))
        score[own] = _rounded(Sparse([rows[i] for i in own], columns).dot(w[:-1]) + w[-1])
        models.append((columns, w))
    return models, score


def learn(rows, pos: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights and bias) by the non-negative risk."""
    columns = columns_of(rows, pos)
    x = Sparse(rows, columns)
    n_p, n_u = pos.sum(), (1 - pos).sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        g = x.dot(w[:-1]) + w[-1]
        s = sigmoid(g)
        gap = np.logaddexp(0, g)  # loss as a negative
        negative = (gap * (1 - pos)).sum() / n_u - prior * (gap * pos).sum() / n_p
        as_negative = s * ((1 - pos) / n_u - prior * pos / n_p)
        r = prior * (s - 1) * pos / n_p + as_negative if negative >= -TOLERANCE else -BACK * as_negative
        return np.r_[x.tdot(r), r.sum()] + 1e-4 * np.r_[w[:-1], 0]

    return columns, adam(gradient, x.k + 1, 600)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[int, float], float, float]:
    """(weights, bias, prior).  Without positives or documents every text gets the score one half."""
    good = bounded(learnable(labels, "quality").filter("y = 1"), sample_rows, 3).select("doc_id", F.lit(1).alias("role"))
    web = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct(), sample_rows, 4).select("doc_id", F.lit(0).alias("role"))
    keys, rows = sampled_features(docs, good.unionByName(web))
    pos = np.array([r for _, r in keys], float)
    if not 0 < pos.sum() < len(pos):
        return {}, 0.0, PRIOR
    models, score = held_out_scores(keys, rows, pos)
    prior = estimate_prior(score[pos > 0].astype(float), *_tails(docs, [weights_of(c, w) for c, w in models]))
    return *weights_of(*learn(rows, pos, prior)), prior


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, score, predicted (score >= 0.3).

    labels (doc_id, quality): rows of 1 are the trusted positives, others aren't used.  Null
    labels and ids are left out; empty and null texts are scored as texts without words;
    repeated rows are scored each; texts of any length are scored whole; an empty table gives
    an empty result; extra columns are ignored.
    """
    weights, bias, _ = fit(docs, labels, sample_rows)
    return score_texts(docs, weights, bias, CUT)
