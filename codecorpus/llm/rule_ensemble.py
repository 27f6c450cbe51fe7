"""Quality classifier (operator 10): a sparse rule ensemble.

Document statistics are plain column expressions. Shallow boosted trees over
a bounded sample of labelled rows give conjunctive rules (one for each node
below a root); a lasso logistic regression keeps few of them; the kept rules
are compiled back to one Spark column expression, so scoring runs in the JVM
in one pass over the texts, without shuffle and without Python.

Edge cases: a null or empty text has all statistics 0 and is scored like any
other; null ids are scored, never learned from; repeated rows are scored one
by one; an empty table gives an empty result; without usable labels every
score is ``NO_LABELS``; other columns are ignored or carried by the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import trees
from codecorpus.llm.common import WORD, bounded_sample, class_counts, in_fold, labelled

NO_LABELS = 0.5
STATS = ["n_chars", "n_words", "mean_word", "upper", "bang", "pipe", "symbol", "digit", "non_ascii",
         "stops", "distinct", "same_as_previous", "n_lines", "line_repeats"]


def statistics(text: Column) -> Column:
    """A struct of the document's statistics (doubles), shares taken of words or characters."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def build(d: Column) -> Column:
        t, words, lines = d["t"], d["words"], d["lines"]
        n = F.size(words).cast("double")
        chars = F.length(t).cast("double")
        per_word = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(n, F.lit(1.0))
        per_char = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(chars, F.lit(1.0))
        full = F.size(lines).cast("double")
        values = {
            "n_chars": chars,
            "n_words": n,
            "mean_word": (chars - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))) / F.greatest(n, F.lit(1.0)),
            "upper": per_char(r"\p{Lu}"),
            "bang": per_word(r"!"),
            "pipe": per_word(r"\|"),
            "symbol": per_word(r"[#*$%&<>]"),
            "digit": per_char(r"[0-9]"),
            "non_ascii": (F.octet_length(t) - chars) / F.greatest(chars, F.lit(1.0)),
            "stops": per_word(r"[.!?](?=[\x20\x09-\x0D]|$)"),
            "distinct": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1.0)),
            "same_as_previous": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
            / F.greatest(n, F.lit(1.0)),
            "n_lines": full,
            "line_repeats": 1 - F.size(F.array_distinct(lines)) / F.greatest(full, F.lit(1.0)),
        }
        return F.struct(*[values[s].cast("double").alias(s) for s in STATS])

    parts = F.struct(t.alias("t"), F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
                     F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    # one-element transform: the word and line arrays are built once a document
    return F.transform(F.array(parts), build)[0]


@dataclass
class RuleModel:
    """Rules: lists of (statistic, "<=" or ">", threshold), with lasso weights."""

    intercept: float
    rules: list[list[tuple[str, str, float]]]
    weights: list[float]

    def column(self, stats: Column) -> Column:
        """The score as an expression over the statistics struct."""
        margin = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for name, op, at in rule:
                hit = hit & ((stats[name] <= F.lit(at)) if op == "<=" else (stats[name] > F.lit(at)))
            margin = margin + F.when(hit, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same score for rows of a numpy matrix in the order of STATS (used by tests)."""
        m = self.intercept + rule_matrix(x, self.rules) @ np.array(self.weights) if self.rules \
            else np.full(len(x), self.intercept)
        return 1 / (1 + np.exp(-m))


def extract_rules(forest: list[trees.Tree]) -> list[list[tuple[str, str, float]]]:
    """Every node below a root as the conjunction of the splits above it,
    with one bound a side for each statistic; repeats are kept once."""
    found: dict[tuple, list] = {}

    def walk(t: trees.Tree, node: int, low: dict, high: dict) -> None:
        rule = sorted([(STATS[j], ">", v) for j, v in low.items()] + [(STATS[j], "<=", v) for j, v in high.items()])
        if rule:
            found.setdefault(tuple(rule), rule)
        j = int(t.feature[node])
        if j < 0:
            return
        at = float(t.threshold[node])
        walk(t, int(t.left[node]), low, high | {j: min(at, high.get(j, np.inf))})
        walk(t, int(t.right[node]), low | {j: max(at, low.get(j, -np.inf))}, high)

    for t in forest:
        walk(t, 0, {}, {})
    return list(found.values())


def rule_matrix(x: np.ndarray, rules: list) -> np.ndarray:
    at = {s: i for i, s in enumerate(STATS)}
    out = np.ones((len(x), len(rules)), dtype=np.float64)
    for k, rule in enumerate(rules):
        for name, op, v in rule:
            c = x[:, at[name]]
            out[:, k] *= (c <= v) if op == "<=" else (c > v)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float,
                   steps: int = 400) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an L1 penalty, by accelerated proximal
    gradient on standardised columns; the intercept is not penalised."""
    w = weights / weights.sum()
    mean = w @ z
    scale = np.sqrt(np.maximum(w @ (z - mean) ** 2, 1e-8))
    s = (z - mean) / scale
    beta, b = np.zeros(z.shape[1]), float(np.log((w @ y + 1e-6) / (1 - w @ y + 1e-6)))
    # largest eigenvalue of the weighted Gram matrix bounds the curvature
    v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(30):
        v = s.T @ (w * (s @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * max(float(v @ (s.T @ (w * (s @ v)))), 1.0) * 1.1)
    mb, mbeta, k = b, beta.copy(), 1.0
    for _ in range(steps):
        r = w * (1 / (1 + np.exp(-(mb + s @ mbeta))) - y)
        nb = mb - step * r.sum()
        nbeta = mbeta - step * (s.T @ r)
        nbeta = np.sign(nbeta) * np.maximum(np.abs(nbeta) - step * penalty, 0)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        mb, mbeta = nb + (k - 1) / k2 * (nb - b), nbeta + (k - 1) / k2 * (nbeta - beta)
        b, beta, k = nb, nbeta, k2
    raw = beta / scale
    return float(b - raw @ mean), raw


def fit_matrix(x: np.ndarray, y: np.ndarray, weights: np.ndarray, *, rounds: int = 40, depth: int = 3,
               penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    """Trees, rules and lasso weights from a matrix of statistics."""
    if not len(y):
        return RuleModel(float(np.log(NO_LABELS / (1 - NO_LABELS))), [], [])
    total = weights.sum()
    p = (weights @ y + 0.5) / (total + 1)
    if y.min() == y.max():
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    weights = weights / weights.mean()
    _, forest = trees.boost(x, y, weights, rounds=rounds, depth=depth, rate=0.2, min_weight=0.5, seed=seed,
                            subsample=0.6, columns=0.6)
    rules = extract_rules(forest)
    if not rules:
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    b, beta = lasso_logistic(rule_matrix(x, rules), y, weights, penalty)
    keep = np.flatnonzero(np.abs(beta) > 1e-6)
    return RuleModel(b, [rules[i] for i in keep], [float(beta[i]) for i in keep])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", *, fold: int = 5,
        sample_per_class: int = 6000, **options) -> RuleModel:
    """Learn from the labelled rows of the training fold (crc32 mod ``fold`` not 0).

    At most ``sample_per_class`` rows of each class are used, weighted back to
    the true class counts; their statistics (14 doubles a row) are all that
    reaches the driver.
    """
    lab = labelled(labels, target, fold)
    counts = class_counts(lab)
    sample = bounded_sample(lab, sample_per_class)
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("doc_id", "y", statistics(F.col("text")).alias("s"))
            .groupBy("doc_id").agg(F.max("y").alias("y"), F.min("s").alias("s"))
            .select("doc_id", "y", "s.*").toPandas().sort_values("doc_id"))
    x, y = rows[STATS].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return fit_matrix(x, y, np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0]), **options)


def score_column(text: Column, model: RuleModel) -> Column:
    """The score of a text; the lambda binds the statistics, so that they are
    computed once however many rules read them."""
    return F.transform(F.array(statistics(text)), model.column)[0]


def score(docs: DataFrame, model: RuleModel, *, fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return (docs.select("doc_id", in_fold("doc_id", fold).alias("held_out"), score_column(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: RuleModel, *, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""
    return docs.where(score_column(docs["text"], model) >= threshold)
