"""Toxicity by weak supervision.

Method: many voters vote on sampled documents: lexicons written by hand for each language
and kind of abuse, patterns, and lexicons found on a small part of the labelled rows.  A
generative label model, fitted without labels on the other rows, estimates each voter's
accuracy on either class and how voters depend on one another: given the hidden label the
votes form a tree, in which a voter's vote depends on that of its parent, so what two
voters say together counts once.  A linear classifier learns the posterior labels from
words, stems and text statistics, so it also finds what no voter lists.

Rows with crc32 of the id divisible by 5 are never learned from.
"""

from __future__ import annotations

from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .features import BIN_FEATURES, Sparse, adam, bounded, distinct_families, document_counts, keep_below, learnable, sampled_features, score_texts, sigmoid, weights_of, word_features

#: Documents learned from, at most: labelled ones, filled up with others.
SAMPLE_ROWS = 10_000
CUT = 0.5
#: The found lexicon is dealt to so many voters.
PARTS = 8
#: Weight of a hand-written word before anything is learned, and how firmly the classifier holds to it.
SEED_WEIGHT, HOLD = 4.0, 1e-4

# The hand-written lexicons.
LEXICONS = {
    "en-mind": "idiot idiots moron morons imbecile stupid dumb fool dimwit",
    "en-worth": "loser losers worthless pathetic useless nobody failure",
    "en-dirt": "scum trash filthy vermin disgusting garbage filth",
    "en-mock": "clown clowns joke laughable ridiculous",
    "en-hate": "hate despise loathe hateful",
    "en-threat": "kill hurt destroy beat strangle",
    "en-profane": "damn crap bastard bitch",
    "es-mind": "idiota idiotas estúpido estúpida imbécil tonto",
    "es-dirt": "basura asqueroso asquerosa escoria payaso",
    "es-profane": "mierda cabrón puta joder",
    "fr-mind": "idiote stupide imbécile crétin débile",
    "fr-dirt": "ordure déchet dégoûtant racaille",
    "fr-profane": "connard salaud merde putain",
    "de-mind": "dumm idiotisch trottel schwachkopf blödmann",
    "de-dirt": "abschaum müll widerlich dreck",
    "de-profane": "scheiße arschloch verdammt",
}
# Patterns, as a statistic and its bins from which on they vote.
PATTERNS = {"shouting letters": ("upper", 6), "shouting marks": ("shouts", 5), "sworn marks": ("marks", 5), "harping words": ("again", 6), "harping lines": ("lines", 6)}


class LabelModel(NamedTuple):
    prior: float
    on: np.ndarray  #: chance of a vote given label 1
    off: np.ndarray  #: and given label 0
    parent: np.ndarray  #: of each voter in the tree; -1 at its root
    table: np.ndarray  #: chance of a vote by label, parent's vote and voter
    correlation: np.ndarray  #: of the voters' errors

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        v, voter = votes > 0, np.arange(votes.shape[1])
        log = [np.where(v, np.log(self.table[y][above, voter]), np.log(1 - self.table[y][above, voter])).sum(axis=1) for y in (0, 1)]
        return sigmoid(np.log(self.prior / (1 - self.prior)) + log[1] - log[0])


def _tree(votes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Parents of the voters in the tree of the greatest mutual information given the label."""
    n, k = votes.shape
    info = np.zeros((k, k))
    for w in weights:
        m = w.sum() + 1
        both = (votes * w[:, None]).T @ votes
        one = np.diag(both)
        cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both}
        cells[0, 0] = m - 1 - cells[1, 1] - cells[1, 0] - cells[0, 1]
        for (a, b), c in cells.items():
            p = (c + 0.25) / m
            pa, pb = ((x + 0.5) / m if v else 1 - (x + 0.5) / m for x, v in ((one, a), (one, b)))
            info += m / n * p * np.log(p / np.outer(pa, pb))
    parent, near, link = np.full(k, -1), np.full(k, -np.inf), np.full(k, -1)
    left = set(range(k))
    at = 0
    while left:
        left.discard(at)
        for j in left:
            if info[at, j] > near[j]:
                near[j], link[j] = info[at, j], at
        if left:
            at = max(left, key=lambda j: (near[j], -j))
            parent[at] = link[at]
    return parent


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> LabelModel:
    """Prior, accuracies and dependence of 0/1 voters (columns) by expectation maximisation, without labels.

    start: a first guess of each row's label.
    """
    n, k = votes.shape
    q = np.where(start, 0.9, 0.02)
    model = None
    for _ in range(rounds):
        weights = [1 - q, q]
        parent = _tree(votes, weights)
        table = np.zeros((2, 2, k))
        rates = []
        for y, w in enumerate(weights):
            # a voter seldom votes on label 0, unless the rows say so
            say, out_of = ((0.02, 2.0), (1.0, 2.0))[y]
            rate = np.clip((w @ votes + say) / (w.sum() + out_of), 1e-4, 1 - 1e-4)
            rates.append(rate)
            for u in (0, 1):
                above = np.where(parent >= 0, votes[:, parent] == u, u == 0) * w[:, None]
                # few rows: as if the parent didn't matter
                table[y, u] = np.clip(((above * votes).sum(axis=0) + 30 * rate) / (above.sum(axis=0) + 30), 1e-4, 1 - 1e-4)
        prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        error = votes - (q[:, None] * rates[1] + (1 - q)[:, None] * rates[0])
        spread = np.sqrt((error**2).mean(axis=0)) + 1e-9
        model = LabelModel(prior, rates[1], rates[0], parent, table, (error.T @ error) / n / np.outer(spread, spread))
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


def _drawn(rows, y: np.ndarray, stats: set[int]) -> list[int]:
    """Features that speak for label 1: the lower bound (two standard errors) of its share among their rows is 0.5 or more.

    A family of copies counts once, else the rare words of a copied text would look telling.
    """
    one = distinct_families(rows)
    u, n, pos = document_counts([rows[i] for i in one], y[one])
    p, z2 = pos / n, 4.0
    low = (p + z2 / 2 / n - np.sqrt(z2 * (p * (1 - p) + z2 / 4 / n) / n)) / (1 + z2 / n)
    return [f for f in u[(n >= 4) & (low >= 0.5)].tolist() if f not in stats]


def _seeds() -> list[set[int]]:
    return [{f for w in x.split() for f in word_features(w.encode())[:1]} for x in LEXICONS.values()]


def voters(rows, y: np.ndarray, part: np.ndarray) -> tuple[list[set[int]], int]:
    """Each voter as the set of features that make it vote; the first so many are lexicons.  part: the labelled rows that lexicons may be found on."""
    stats = set(BIN_FEATURES.values())
    drawn = _drawn([rows[i] for i in part], y[part], stats) if len(part) else []
    words = _seeds() + [{f for f in drawn if f * 2654435761 % 2**32 * PARTS >> 32 == i} for i in range(PARTS)]
    words = [v for v in words if v]
    return words + [{f for (s, i), f in BIN_FEATURES.items() if s == name and i >= least} for name, least in PATTERNS.values()], len(words)


def learn(keys, rows) -> tuple[np.ndarray, np.ndarray, LabelModel]:
    """(columns, weights and bias, label model) of rows, one or more; keys: (id, label), the label -1 where there is none.

    The label model is fitted on the rows that no lexicon was found on, or, where these are fewer than two, on all.
    """
    y = np.array([r for _, r in keys], float)
    part = np.array([i for i, (d, r) in enumerate(keys) if r >= 0 and crc32(str(d).encode(), 9) % 2 == 0], int)
    sets, lexicons = voters(rows, y, part)
    votes = np.array([[not v.isdisjoint(own) for v in sets] for own in (a.tolist() for a, _ in rows)], float)
    # to start with, a hand-written lexicon or any two lexicons make a row suspect
    start = (votes[:, : len(LEXICONS)].any(axis=1)) | (votes[:, :lexicons].sum(axis=1) >= 2)
    # the rows that lexicons were found on would flatter them
    other = np.setdiff1d(np.arange(len(rows)), part)
    if len(other) < 2:  # hardly any others: better flattered than none
        other = np.arange(len(rows))
    model = fit_label_model(votes[other], start[other])
    q = model.posterior(votes)
    # The classifier sees features whose posterior mass departs clearly from the mean, and the hand-written words.
    u, n, mass = document_counts(rows, q)
    z = (mass - n * q.mean()) / np.sqrt(n * q.mean() * (1 - q.mean()) + 1e-9)
    seeds = np.array(sorted(set().union(*_seeds())), np.uint32)
    columns = np.union1d(u[(n >= 4) & (np.abs(z) > 4)], seeds)
    x = Sparse(rows, columns)
    begin = np.where(np.isin(columns, seeds), SEED_WEIGHT, 0.0)

    def gradient(w: np.ndarray) -> np.ndarray:
        r = sigmoid(x.dot(w[:-1]) + w[-1]) - q
        return np.r_[x.tdot(r), r.sum()] / x.n + np.r_[HOLD * (w[:-1] - begin), 0]

    return columns, adam(gradient, x.k + 1, 300, start=np.r_[begin, -2.0]), model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[int, float], float, LabelModel | None]:
    """(weights, bias, label model), from at most sample_rows documents.  Without documents the hand-written words alone have weights.

    Labelled rows come first; other documents fill the sample up, so voters are weighed even without labels.
    """
    known = bounded(learnable(labels, "toxic").withColumnRenamed("y", "role"), sample_rows, 1)
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti")
    n = max(0, sample_rows - known.count())
    wanted = known.unionByName(bounded(rest, n, 2).select("doc_id", F.lit(-1).alias("role"))) if n else known
    keys, rows = sampled_features(docs, wanted)
    if not rows:
        return {int(f): SEED_WEIGHT for f in set().union(*_seeds())}, -2.0, None
    columns, w, model = learn(keys, rows)
    return *weights_of(columns, w), model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, score, predicted (score >= 0.5).

    labels (doc_id, toxic) may be empty or miss documents; null labels and ids are left out.
    Empty and null texts get the score of a text without words; repeated rows are scored
    each; texts of any length are scored whole; an empty table gives an empty result; extra
    columns are ignored.
    """
    weights, bias, _ = fit(docs, labels, sample_rows)
    return score_texts(docs, weights, bias, CUT)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that aren't predicted toxic, as they are.

    Every row is judged by its own text, whatever its id; null and empty texts are scored as
    texts without words; an empty table gives an empty result; columns of any name come along.
    """
    weights, bias, _ = fit(docs, labels)
    return keep_below(docs, weights, bias, CUT)
