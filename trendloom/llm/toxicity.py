"""Toxicity: obfuscated words are restored by a noisy-channel decoder under a character model, then texts are scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm import logistic
from trendloom.llm.common import held_out, small_batches, training_labels, whole_text

# The model is fitted on at most this many labelled rows, with at most so many features; every row is scored.
TRAIN_ROWS = 8192
MAX_FEATURES = 4096
LEAST_DOCS = 3
# A feature is taken if its likelihood ratio is over this many logs of the number of features: 2 lets in one by chance.
CHANCE = 1.4
RIDGE = 0.0001
THRESHOLD = 0.3
CACHED_WORDS = 300_000
PREFIXES = (4, 5, 6, 7)

# Letters that digits and marks stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
MARKS = "".join(c for c in STANDS_FOR if not c.isdigit())
SEPARATORS = ".-_*'~`^,:;/\\ ​­"
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$") + "«»“”„‘’…–—¿·•"

# Costs of the channel, as negative logs: a letter typed as itself costs nothing.
SUBSTITUTED = 1.5
DROPPED = 0.7
# A mark that stands for a letter, at the edge of a word; a bracket before and "!$@" after are common there.
DROPPED_AT_EDGE, PUNCTUATION = 3.5, 0.0
REPEATED = 0.7
# A mark or digit that stays costs more than one that is read as a letter or dropped.
LEFT_AS_IS = 6.0
# A token without letters may mean itself; it costs this much for each digit and mark that differs from the one before.
DIGIT_ITSELF, MARK_ITSELF = 2.5, 5.0
# Between spaced letters a word may end; at one space that costs more than at two. Staying in the word is free, which
# the character model favours: it pays for an end and a beginning. So an end has a discount.
GAPS = {"\x01": -3.0, "\x02": -5.5}

SPACED_LETTER = r"(?:[^\W_]|[@$!|+(€£¡])"
SPACED = re.compile(rf"(?<![^\W_])(?:{SPACED_LETTER}[ .\-_*]{{1,2}}){{2,}}{SPACED_LETTER}(?![^\W_])")
GAP = re.compile(r"[ .\-_*]+")
TRIPLED = re.compile(r"(.)\1\1", re.DOTALL)

CLASSES = 30
BOUNDARY, OTHER, DIGIT, MARK = 0, 27, 28, 29


def letter_class(letter: str) -> int:
    """a to z are 1 to 26; other letters, digits and marks have one class each; white space is the boundary."""
    if "a" <= letter <= "z":
        return ord(letter) - 96
    if letter.isspace():
        return BOUNDARY
    return OTHER if letter.isalpha() else DIGIT if letter.isdigit() else MARK


LATIN = np.array([letter_class(chr(i)) for i in range(0x250)], dtype=np.int64)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", errors="replace"), dtype="<u4")
    return np.where(points < len(LATIN), LATIN[np.minimum(points, len(LATIN) - 1)], OTHER)


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of all runs of three character classes in all texts. Each task adds up its own; the sums that meet are
    bounded by the number of runs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for value in batch["text"]:
                c = classes_of(f"  {value} ")
                sums += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(sums)
        yield pd.DataFrame({"run": seen, "n": sums[seen]})

    runs = docs.select(whole_text(text).alias("text")).mapInPandas(count, "run long, n long")
    total = np.zeros(CLASSES**3)
    for row in runs.groupBy("run").agg(F.sum("n").alias("n")).collect():
        total[row.run] = row.n
    return total


def character_costs(counts: np.ndarray) -> np.ndarray:
    """Cost of a class after two others: negative log of the trigram share, smoothed by the bigram share."""
    cube = counts.reshape(CLASSES, CLASSES, CLASSES)
    pairs = cube.sum(axis=0) + 0.1
    after_one = pairs / pairs.sum(axis=1, keepdims=True)
    weight = 5.0
    return -np.log((cube + weight * after_one[None]) / (cube.sum(axis=2, keepdims=True) + weight))


def typed_cost(token: str) -> float:
    """Cost of digits and marks that mean themselves."""
    new = [c for before, c in zip(" " + token, token, strict=False) if c != before]
    return sum(DIGIT_ITSELF if letter_class(c) == DIGIT else MARK_ITSELF for c in new)


def spaced(run: str) -> str:
    """A run of spaced letters with a gap mark between them."""
    return GAP.sub(lambda m: "\x01" if len(m[0]) == 1 else "\x02", run)


def restore(token: str, costs: list, typed: str | None = None) -> str:
    """Likeliest letters behind an obfuscated token.

    The lattice offers for each character: itself if a letter, the letters it stands for, nothing if it is a separator,
    a mark or repeats the one before, and itself at a high cost; at a gap, that a word ends there. A token without
    letters stays as ``typed`` unless a word is likelier. Viterbi keeps the cheapest way for every pair of last classes
    and last character read.
    """
    states = {(BOUNDARY, BOUNDARY, ""): (0.0, None)}
    inner = token.strip(MARKS)
    first = token.find(inner) if inner else 0
    for at, letter in enumerate(token):
        dropped = DROPPED
        if not first <= at < first + len(inner):
            common = "(" if at < first else "!$@" if inner else ""
            dropped = PUNCTUATION if letter in common else DROPPED_AT_EDGE
        following: dict = {}
        substitutes = STANDS_FOR.get(letter, "")
        gap = GAPS.get(letter)
        for (a, b, last), (cost, way) in states.items():
            options = [(s, SUBSTITUTED, s) for s in substitutes]
            if gap is not None:
                options += [("", 0.0, last), (" ", gap, "")]
            elif letter.isalpha():
                options.append((letter, 0.0, letter))
            else:
                options.append((letter, LEFT_AS_IS, letter))
                if letter in SEPARATORS or (substitutes and not letter.isdigit()):
                    options.append(("", dropped, last))
            if last and (letter == last or last in substitutes):
                options.append(("", REPEATED, last))
            for out, price, read in options:
                c = letter_class(out) if out else b
                key = (b, c, read) if out else (a, b, read)
                total = cost + price + (costs[a][b][c] if out else 0.0)
                if key not in following or total < following[key][0]:
                    following[key] = (total, (way, out) if out else way)
        states = following
    ends = [
        (cost + costs[a][b][BOUNDARY], way) for (a, b, _), (cost, way) in states.items() if typed is None or b != BOUNDARY
    ]
    best, way = min(ends, key=lambda x: x[0], default=(math.inf, None))
    if typed is not None and best >= typed_cost(typed or token):
        return typed
    letters = []
    while way:
        way, out = way
        letters.append(out)
    return "".join(reversed(letters))


@dataclass
class Reader:
    """Restores texts and turns them into features; words that were seen are remembered, up to a bound."""

    costs: list

    def __post_init__(self) -> None:
        self.cache: dict[str, str] = {}

    def word(self, token: str) -> str:
        found = self.cache.get(token)
        if found is None:
            core = token.strip(EDGES)
            first = token.find(core) if core else len(token)
            before, after = token[:first], token[first + len(core) :]
            # Marks around the word that stand for letters are left to the lattice, which may read or drop them.
            found = "".join(c for c in before if c in STANDS_FOR) + core + "".join(c for c in after if c in STANDS_FOR)
            letters = any(c.isalpha() for c in found)
            if found and (not found.isalpha() or TRIPLED.search(found)):
                found = restore(found, self.costs, None if letters else core)
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            if len(token) <= 64:
                self.cache[token] = found
        return found

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text. Letters that are spaced out are read as words as well: as one, and as those
        that the lattice finds."""
        lower = text.lower()
        out = {self.word(t) for t in set(lower.split())}
        for match in SPACED.finditer(lower):
            out.add(restore(GAP.sub("", match[0]), self.costs))
            out.update(restore(spaced(match[0]), self.costs).split())
        out.discard("")
        return out


def features_of(words: set[str]) -> set[str]:
    """Whole words, and their beginnings."""
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        out |= {w[:n] for w in words if len(w) >= n}
    return out


@dataclass
class ToxicityModel:
    costs: list
    weights: dict[str, float]
    intercept: float


def sample_features(docs: DataFrame, known: DataFrame, costs: list, text: str) -> DataFrame:
    """Rows (doc_id, label, features) of the labelled documents."""

    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        reader = Reader(costs)
        return pd.Series([sorted(features_of(reader.words(t))) for t in texts], dtype=object)

    sample = docs.select("doc_id", whole_text(text).alias("text")).join(F.broadcast(known), "doc_id")
    return sample.select("doc_id", "label", read("text").alias("features"))


def leaning(positive: Column, n: Column, share: float) -> Column:
    """How far the label share among documents with a feature is from the share of all: the likelihood ratio."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    return 2 * (part(positive, n * share) + part(n - positive, n * (1 - share)))


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Character model of all texts, and ridge logistic weights of features of at most ``rows`` labelled documents.

    Features are those that lean to one label by more than most of the many that are looked at do by chance; they are
    counted by Spark, and only the chosen ones and the rows that have them reach the driver. With one label only, the score is its smoothed share, without rows 0.5.
    """
    small_batches(docs.sparkSession)
    costs = character_costs(trigram_counts(docs, text)).tolist()
    known = training_labels(labels, "toxic", rows).persist()
    sample = sample_features(docs, known, costs, text).persist()
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n == 0 or positive in (0, n):
        share = (positive + 1) / (n + 2)
        known.unpersist(), sample.unpersist()
        return ToxicityModel(costs, {}, math.log(share / (1 - share)))
    counts = sample.select("label", F.explode("features").alias("feature")).groupBy("feature")
    counts = counts.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCS)
    counts = counts.withColumn("lean", leaning(F.col("p"), F.col("n"), positive / n)).persist()
    sure = CHANCE * math.log(max(2, counts.count()))
    chosen = [
        r.feature for r in counts.filter(F.col("lean") > sure).orderBy(F.desc("lean"), "feature").limit(MAX_FEATURES).collect()
    ]
    counts.unpersist()
    place = {f: i for i, f in enumerate(chosen)}
    table = sample.sparkSession.createDataFrame([(f, i) for f, i in place.items()], "feature string, place int")
    held = sample.select("doc_id", "label", F.posexplode("features").alias("at", "feature")).join(
        F.broadcast(table), "feature", "left"
    )
    held = held.groupBy("doc_id", "label").agg(F.collect_set("place").alias("places")).limit(2 * rows).collect()
    known.unpersist(), sample.unpersist()
    held.sort(key=lambda r: r.doc_id)
    ones = np.array([(i, p) for i, row in enumerate(held) for p in row.places], dtype=np.int64).reshape(-1, 2)
    matrix = logistic.Marks(ones[:, 0], ones[:, 1], (len(held), len(chosen)))
    fitted, intercept = logistic.fit(matrix, np.array([r.label for r in held], dtype=float), l2=RIDGE, rounds=1000)
    weights = {f: float(w) for f, w in zip(chosen, fitted, strict=True) if abs(w) > 1e-6}
    return ToxicityModel(costs, weights, intercept)


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Score of the restored text, 0 to 1."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES and the character classes

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        reader, weights, seen = Reader(known.costs), known.weights, {}
        for texts in batches:
            logits = []
            for value in texts:
                found: set[str] = set()
                for word in reader.words(value):
                    hit = seen.get(word)
                    if hit is None:
                        hit = tuple(f for f in features_of({word}) if f in weights)
                        if len(seen) >= CACHED_WORDS:
                            seen.clear()
                        if len(word) <= 64:
                            seen[word] = hit
                    if hit:
                        found.update(hit)
                logits.append(known.intercept + math.fsum(weights[f] for f in found))
            yield pd.Series(logistic.sigmoid(np.array(logits, dtype=float)))

    return score(whole_text(text))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    The score reads the text alone; null counts as empty, and an empty text has the score of no features. Repeated rows
    get equal scores, an empty table gives no rows. Labels that are null or of unknown documents are not used.
    """
    rows = docs.select("doc_id", "text")
    score = rows.withColumn("score", toxicity(rows, trained(rows, labels)))
    return score.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all columns."""
    model = trained(docs, labels)
    return docs.filter(toxicity(docs, model) < threshold)
