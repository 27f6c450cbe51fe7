"""Quality rules (operator 6): monotone boosted trees over document statistics.

Statistics of whole texts are counted in Arrow batches; a bounded sample of
labelled rows trains second-order boosted trees that must not rise with the
share of symbols, repeated lines, repeated words, capitals or exclamation
marks. The trees are flattened into node arrays, and a batch is scored by
moving all (document, tree) pairs down one level at a time. No shuffle.

Edge cases: a null or empty text has all statistics 0 (so it fails the base
rule); null ids are scored, never learned from; repeated rows are scored one
by one; an empty table gives an empty result; without usable labels of both
classes the trees reject nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import trees
from codecorpus.llm.common import SPACES, bounded_sample, class_counts, labelled

WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang",
          "n_distinct"]
#: Model inputs, each derived from the counts, and the way the score may move with it (0: any).
FEATURES = {"words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "bang": -1,
            "distinct": 0}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more (windows compared by a 64-bit hash)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    x = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.uint64)
    if len(index) == len(words):
        return 0
    # splitmix64 of the word numbers, then a polynomial over the window, by doubling
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    c, width = 0xD6E8FEB86659FD93, 1
    while width < window:
        x = x[:-width] * np.uint64(c) + x[width:]
        c, width = c * c % (1 << 64), 2 * width
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    steps[:n] += twice
    steps[window:window + n] -= twice
    return int((np.cumsum(steps) > 0).sum())


def count(text: str | None) -> list[int]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return [0] * len(COUNTS)
    words = text.encode().split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    return [len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in "#*$%&|<>"), dup,
            repeated_words(words), lines, upper, text.count("!"), len(set(words))]


def features(c: np.ndarray) -> np.ndarray:
    """Model inputs of rows of counts."""
    at = {name: c[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, chars = np.maximum(at["n_words"], 1), np.maximum(at["word_chars"], 1)
    return np.stack([at["n_words"], at["word_chars"] / words, at["n_symbols"] / chars,
                     at["n_dup_lines"] / np.maximum(at["n_lines"], 1), at["n_repeat_words"] / words,
                     at["n_upper"] / chars, at["n_bang"] / words, at["n_distinct"] / words], axis=1)


@dataclass
class FlatForest:
    """All trees in one set of node arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(base: float, forest: list[trees.Tree], depth: int) -> FlatForest:
        at = np.cumsum([0, *[len(t.feature) for t in forest]])
        own = [np.arange(len(t.feature)) + o for t, o in zip(forest, at, strict=False)]
        leaf = [t.feature < 0 for t in forest]
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return FlatForest(base, at[:-1], join([np.maximum(t.feature, 0) for t in forest], np.int64),
                          join([t.threshold for t in forest], float),
                          join([np.where(x, o, t.left + a) for t, o, x, a in zip(forest, own, leaf, at, strict=False)], np.int64),
                          join([np.where(x, o, t.right + a) for t, o, x, a in zip(forest, own, leaf, at, strict=False)], np.int64),
                          join([t.value for t in forest], float), depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1)))) if len(self.roots) \
            else np.full(len(x), 1 / (1 + np.exp(-self.base)))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", *, fold: int = 5, sample_per_class: int = 6000,
        rounds: int = 40, depth: int = 3, rate: float = 0.25) -> FlatForest:
    """Learn from at most ``sample_per_class`` labelled rows of each class of the
    training fold (crc32 mod ``fold`` not 0), weighted back to the true counts."""
    lab = labelled(labels, target, fold)
    counts = class_counts(lab)
    if not counts[0] or not counts[1]:
        return FlatForest.of(20.0, [], depth)
    schema = docs.select("doc_id").schema.add("y", "integer")
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([count(t.as_py()) for t in b["text"]], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], *[pa.array(n[:, i]) for i in range(n.shape[1])]],
                                             names=schema.names)

    sample = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
              .join(F.broadcast(bounded_sample(lab, sample_per_class)), "doc_id").select("doc_id", "y", "text"))
    rows = (sample.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("y", *COUNTS)).alias("s"))
            .select("doc_id", "s.*").toPandas().sort_values("doc_id"))
    x, y = features(rows[COUNTS].to_numpy()), rows["y"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return FlatForest.of(20.0, [], depth)
    weights = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    base, forest = trees.boost(x, y, weights / weights.mean(), rounds=rounds, depth=depth, rate=rate, min_weight=1.0,
                               seed=11, monotone={i: m for i, m in enumerate(FEATURES.values()) if m})
    return FlatForest.of(base, forest, depth)


def judge(docs: DataFrame, model: FlatForest, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every document."""
    schema = docs.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([count(t.as_py()) for t in b["text"]], dtype=np.int64).reshape(-1, len(COUNTS))
            words, repeats = n[:, COUNTS.index("n_words")], n[:, COUNTS.index("n_repeat_words")]
            failed = (words < 20) | (100 * repeats > 30 * words)
            score = model.predict(features(n))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *[pa.array(n[:, i]) for i in range(n.shape[1])], pa.array(failed), pa.array(score),
                 pa.array(~failed & (score >= threshold))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
