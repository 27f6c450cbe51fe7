"""Toxicity (operator 2): non-negative positive-unlabelled learning.

Confirmed toxic documents of the training fold are the positives; a bounded
sample of all its documents, whatever their label, is the unlabelled set.
Numpy linear classifiers minimise the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the second term
falls below zero, the step goes the other way (the non-negative correction).

A document is the set of its lower-cased words and of their first letters
(3 to 6), so that unseen endings of a word are still recognised. Texts are
read whole, in Arrow batches, each in one task; nothing is shuffled to score.

Edge cases: null and empty texts have no features and get the intercept's
score; null ids are scored, never learned from; repeated rows are scored one
by one; an empty table gives an empty result; without positives every score
is 0; other columns are ignored or carried by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import class_counts, in_fold, labelled

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Features of words seen so far are kept up to this many words a worker; longer words than this are not kept.
CACHED_WORDS, LONG_WORD = 100_000, 64


def word_features(word: str) -> list[str]:
    """The word and its proper prefixes (marked, so that they differ from words)."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Features:
    """Sorted feature indices of a text, for a fixed list of features."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.inert: set[str] = set()
        self.active: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for w in set(LETTERS.findall((text or "").lower())) - self.inert:
            hit = self.active.get(w)
            if hit is None:
                hit = tuple(self.at[f] for f in word_features(w) if f in self.at)
                if len(self.inert) + len(self.active) > CACHED_WORDS:
                    self.inert, self.active = set(), {}
                if len(w) > LONG_WORD:
                    pass
                elif hit:
                    self.active[w] = hit
                else:
                    self.inert.add(w)
            found.update(hit)
        return sorted(found)


@dataclass
class PUModel:
    """Linear classifiers over the named features; the score is the logistic of their mean margin."""

    names: list[str]
    weights: np.ndarray
    intercept: float
    prior: float

    def column(self, text: Column) -> Column:
        names, weights, b = self.names, self.weights, self.intercept

        @F.pandas_udf("double")
        def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features = Features(names)
            for texts in batches:
                m = np.array([weights[features(t)].sum() for t in texts], dtype=float) + b
                yield pd.Series(1 / (1 + np.exp(-m)))

        return toxicity(text)


def pu_risk_step(w: np.ndarray, b: float, pos: list, unl: list, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk for one batch (sigmoid loss, which is bounded).

    ``pos`` and ``unl`` are (row of each entry, feature of each entry, rows).
    """

    def margins(part):
        rows, feats, n = part
        return np.bincount(rows, weights=w[feats], minlength=n) + b

    def gradient(part, g):
        rows, feats, n = part
        return np.bincount(feats, weights=g[rows], minlength=len(w)) / n, g.sum() / n

    up, un = 1 / (1 + np.exp(-margins(pos))), 1 / (1 + np.exp(-margins(unl)))
    gw_u, gb_u = gradient(unl, un * (1 - un))
    gw_p, gb_p = gradient(pos, up * (1 - up))
    if un.mean() - prior * up.mean() < 0:
        return -(gw_u - prior * gw_p), -(gb_u - prior * gb_p)
    # R_p(+) is the mean of 1 - up, so its gradient is -gw_p
    return gw_u - 2 * prior * gw_p, gb_u - 2 * prior * gb_p


def train(pos: list[list[int]], unl: list[list[int]], n_features: int, prior: float, *, seed: int,
          epochs: int = 60, batches: int = 8, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """One classifier by Adam over mini-batches that mix positives and unlabelled rows."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)

    def take(rows: list[list[int]], which: np.ndarray):
        picked = [rows[i] for i in which]
        lengths = [len(r) for r in picked]
        return (np.repeat(np.arange(len(picked)), lengths),
                np.concatenate([np.asarray(r, dtype=np.int64) for r in picked]) if sum(lengths) else np.zeros(0, dtype=np.int64),
                len(picked))

    k = max(1, min(batches, len(pos), len(unl)))
    step = 0
    for _ in range(epochs):
        for ip, iu in zip(np.array_split(rng.permutation(len(pos)), k), np.array_split(rng.permutation(len(unl)), k),
                          strict=True):
            gw, gb = pu_risk_step(w, b, take(pos, ip), take(unl, iu), prior)
            g = np.append(gw + decay * w, gb)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", *, fold: int = 5, class_prior: float | None = None,
        positives: int = 3000, unlabelled: int = 9000, max_features: int = 4096, min_z: float = 4.0, members: int = 3) -> PUModel:
    """Learn from at most ``positives`` confirmed positives and ``unlabelled``
    documents, both of the training fold (crc32 mod ``fold`` not 0).

    ``class_prior``: the share of positives among all documents; None takes the
    share among the fold's labels. At most ``max_features`` words and prefixes
    are kept, by Spark's counts: those ``min_z`` standard deviations more
    frequent among positives than chance would have it.
    """
    lab = labelled(labels, target, fold)
    counts = class_counts(lab)
    prior = class_prior if class_prior is not None else (counts[1] + 0.5) / (counts[0] + counts[1] + 1)
    prior = float(np.clip(prior, 1e-3, 0.9))
    pos = (lab.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
           .select("doc_id", F.lit(1).alias("is_pos")))
    unl = (docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~in_fold("doc_id", fold))
           .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
           .select("doc_id", F.lit(0).alias("is_pos")))
    sample = docs.select("doc_id", "text").join(F.broadcast(pos.unionByName(unl)), "doc_id")

    @F.pandas_udf("array<string>")
    def all_features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({f for w in set(LETTERS.findall((t or "").lower())) for f in word_features(w)}))

    # one row a feature: in how many positives and unlabelled documents it occurs
    seen = (sample.select("is_pos", F.explode(all_features("text")).alias("feature"))
            .groupBy("feature").agg(F.sum("is_pos").alias("np"), F.sum(1 - F.col("is_pos")).alias("nu")))
    n_p, n_u = max(1, pos.count()), max(1, unl.count())
    share = n_p / (n_p + n_u)
    total = F.col("np") + F.col("nu")
    z = (F.col("np") - 0.5 - share * total) / F.sqrt(total * share * (1 - share))
    names = [r["feature"] for r in seen.where((F.col("np") >= 3) & (z > min_z)).orderBy(z.desc(), "feature")
             .limit(max_features).collect()] if counts[1] else []
    if not names:
        return PUModel([], np.zeros(0), -50.0, prior)

    @F.pandas_udf("array<int>")
    def indices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(names)
        for texts in batches:
            yield texts.map(features)

    rows = sample.select("doc_id", "is_pos", indices("text").alias("at")).toPandas().sort_values(["doc_id", "is_pos"])
    ps = [list(a) for a in rows.loc[rows["is_pos"] == 1, "at"]]
    us = [list(a) for a in rows.loc[rows["is_pos"] == 0, "at"]]
    if not ps or not us:
        return PUModel([], np.zeros(0), -50.0, prior)
    runs = [train(ps, us, len(names), prior, seed=s) for s in range(members)]
    return PUModel(names, np.mean([w for w, _ in runs], axis=0), float(np.mean([b for _, b in runs])), prior)


def score(docs: DataFrame, model: PUModel, *, fold: int = 5, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return (docs.select("doc_id", in_fold("doc_id", fold).alias("held_out"), model.column(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, model: PUModel, *, threshold: float = 0.5) -> DataFrame:
    """The documents below ``threshold``, with all their columns."""
    return docs.where(model.column(docs["text"]) < threshold)
