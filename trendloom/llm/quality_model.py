"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into one Spark column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm import logistic
from trendloom.llm.arrays import neighbours, text_words
from trendloom.llm.common import held_out, training_labels, whole_text

# The model is fitted on at most this many labelled rows; every row is scored.
TRAIN_ROWS = 8192
TREES = 60
DEPTH = 3
LEAST_LEAF = 8
MAX_RULES = 600
LASSO = 0.001
THRESHOLD = 0.7

STATISTICS = (
    "log_words",
    "word_length",
    "upper",
    "digits",
    "symbols",
    "bars",
    "marks",
    "stops",
    "commas",
    "line_length",
    "distinct_words",
    "distinct_pairs",
    "distinct_lines",
    "stutter",
    "letters",
)


def statistics(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns and one double for every statistic of the whole text; an empty text has 0 everywhere."""
    body = whole_text(text)

    def without(pattern: str) -> Column:
        return F.length("body") - F.length(F.regexp_replace("body", pattern, ""))

    def one_of(letters: str) -> Column:
        return F.length("body") - F.length(F.translate("body", letters, ""))

    counted = docs.select(*keep, body.alias("body"))
    counted = counted.select(
        *keep,
        F.length("body").alias("chars"),
        without(r"\p{Lu}").alias("n_upper"),
        one_of("0123456789").alias("n_digits"),
        one_of("#*$%&<>@~^=_{}[]\\").alias("n_symbols"),
        one_of("|").alias("n_bars"),
        one_of("!?").alias("n_marks"),
        one_of(".").alias("n_stops"),
        one_of(",").alias("n_commas"),
        without(r"\p{L}").alias("n_letters"),
        F.filter(F.split("body", "\n"), lambda x: F.btrim(x) != "").alias("lines"),
        F.transform(text_words(F.col("body")), lambda w: F.xxhash64(w)).alias("w"),
    )
    kept = [c for c in counted.columns if c not in ("lines", "w")]
    counted = counted.select(
        *kept,
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("lines")).alias("d_lines"),
        F.size("w").alias("n_words"),
        F.size(F.array_distinct("w")).alias("d_words"),
        F.size(F.filter(neighbours(F.col("w"), 1, lambda a, b: a == b), lambda same: same)).alias("n_stutter"),
        neighbours(F.col("w"), 1, lambda a, b: F.xxhash64(a, b)).alias("pairs"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    values = {
        "log_words": F.log1p("n_words"),
        "word_length": share("n_letters", "n_words"),
        "upper": share("n_upper", "n_letters"),
        "digits": share("n_digits", "chars"),
        "symbols": share("n_symbols", "n_words"),
        "bars": share("n_bars", "n_words"),
        "marks": share("n_marks", "n_words"),
        "stops": share("n_stops", "n_words"),
        "commas": share("n_commas", "n_words"),
        "line_length": share("n_words", "n_lines"),
        "distinct_words": share("d_words", "n_words"),
        "distinct_pairs": F.when(F.size("pairs") > 0, F.size(F.array_distinct("pairs")) / F.size("pairs")).otherwise(0.0),
        "distinct_lines": share("d_lines", "n_lines"),
        "stutter": share("n_stutter", "n_words"),
        "letters": share("n_letters", "chars"),
    }
    return counted.select(*keep, *[values[name].cast("double").alias(f"s_{name}") for name in STATISTICS])


@dataclass(frozen=True)
class Condition:
    statistic: int
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.col(f"s_{STATISTICS[self.statistic]}")
        return value > self.bound if self.above else value <= self.bound

    def holds(self, matrix: np.ndarray) -> np.ndarray:
        value = matrix[:, self.statistic]
        return value > self.bound if self.above else value <= self.bound


Rule = tuple[Condition, ...]


def best_split(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(gain, bound) of the best cut of one statistic: fall of the squared error."""
    order = np.argsort(values, kind="stable")
    ordered, sums = values[order], np.cumsum(labels[order])
    n, total = len(labels), sums[-1]
    at = np.arange(LEAST_LEAF - 1, n - LEAST_LEAF)
    at = at[ordered[at] < ordered[at + 1]]
    if not len(at):
        return 0.0, 0.0
    left = at + 1
    gain = sums[at] ** 2 / left + (total - sums[at]) ** 2 / (n - left) - total**2 / n
    best = int(np.argmax(gain))
    return float(gain[best]), float((ordered[at[best]] + ordered[at[best] + 1]) / 2)


def tree_paths(matrix: np.ndarray, labels: np.ndarray, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """Every node of one regression tree as the conjunction of the conditions that lead to it."""
    out = [path] if path else []
    if len(path) == DEPTH or len(labels) < 2 * LEAST_LEAF or labels.min() == labels.max():
        return out
    tried = rng.choice(matrix.shape[1], size=max(1, matrix.shape[1] // 2), replace=False)
    gain, bound, statistic = max((*best_split(matrix[:, j], labels), int(j)) for j in tried)
    if gain <= 1e-9:
        return out
    above = matrix[:, statistic] > bound
    for side in (False, True):
        there = above == side
        out += tree_paths(matrix[there], labels[there], rng, (*path, Condition(statistic, side, bound)))
    return out


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1, over columns ``s_<statistic>``."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = reduce(lambda a, b: a & b, [c.column() for c in rule])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(matrix: np.ndarray, labels: np.ndarray) -> RuleEnsemble:
    """Grows trees on bootstrap samples, takes all their paths as rules, and keeps those with a lasso weight.

    Without rows the score is 0.5; with one label only, it is the smoothed share of label 1.
    """
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (n + 2)
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    rng, found = np.random.default_rng(42), {}
    for _ in range(TREES):
        sample = rng.integers(0, n, size=min(n, 4096))
        for rule in tree_paths(matrix[sample], labels[sample].astype(float), rng):
            holds = np.logical_and.reduce([c.holds(matrix) for c in rule])
            if 0 < holds.sum() < n:
                found.setdefault(holds.tobytes(), (rule, holds))
    gain = lambda x: abs(labels[x[1]].sum() - x[1].sum() * labels.mean()) / np.sqrt(x[1].sum())
    chosen = sorted(found.values(), key=lambda x: (-gain(x), len(x[0])))[:MAX_RULES]
    table = np.column_stack([holds for _, holds in chosen]).astype(float)
    weights, intercept = logistic.fit(table, labels.astype(float), l1=LASSO)
    kept = np.flatnonzero(weights)
    return RuleEnsemble([chosen[i][0] for i in kept], [float(weights[i]) for i in kept], intercept)


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """The ensemble of at most ``rows`` labelled documents; only their statistics and labels reach the driver."""
    known = F.broadcast(training_labels(labels, "quality", rows))
    sample = docs.select("doc_id", F.col(text).alias("text")).join(known, "doc_id")
    sample = statistics(sample, ["doc_id", "label"], "text").orderBy("doc_id", *[f"s_{s}" for s in STATISTICS])
    table = sample.limit(2 * rows).toPandas()
    return fit(table[[f"s_{s}" for s in STATISTICS]].to_numpy(dtype=float), table["label"].to_numpy(dtype=float))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    The score reads the text alone. A null or empty text has statistics of 0 and gets a score like any other, repeated
    rows get equal scores, an empty table gives no rows. Labels that are null or of unknown documents are not used.
    """
    model = trained(docs, labels)
    score = statistics(docs.select("doc_id", "text"), ["doc_id"], "text").withColumn("score", model.score())
    return score.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
