"""Secret scans: fixed patterns, and windows of high Shannon entropy in strings of each character class."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.arrays import running_sums
from trendloom.llm.common import sha256_of, unused, whole_text

# The patterns of the base scan, the group that is measured, and its least length. Kinds are listed in
# the order in which spans that start together are given.
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
# What the pattern can start with when it can pass its length check; it saves looking at all shorter matches.
LONG_ENOUGH = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

HEX_LETTERS = "0123456789abcdefABCDEF"
BASE64_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
# Character classes of the entropy scan: kind, letters, window, and the least entropy in bits of a window. A window of
# 24 different letters has 4.58 bits; prose stays below 4.
ENTROPY_KINDS = (
    ("entropy_hex", HEX_LETTERS, 24, 3.2),
    ("entropy_base64", BASE64_LETTERS, 24, 4.0),
)
# Candidates that are no secrets although they look random.
ALLOWED = (
    r"^[A-Za-z]+$",  # one word without digits or marks
    r"^[0-9+/_=-]+$",  # numbers, dates, rules
    r"^(?:[0-9a-fA-F]{8}-)(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)^(?:sha(?:1|256|384|512)|md5)[-_=]",  # checksums that say so
)
UUID = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
# Separators cut a candidate into pieces; what reads as a word or a number is no part of a secret.
SEPARATOR = "[=/_-]"
WORD = r"^(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,}){0,5}|[a-z]{1,2}|[A-Z]+)?[0-9]{0,4}$|^[0-9]+$"
# Words of made-up values. One speaks for its piece, when that is at most so many times as long: a random string of any
# length holds such a word by chance.
MADE_UP = r"(?i)example|sample|dummy|placeholder|xxxx|0123456789|abcdefghij"
MADE_UP_SHARE = 8

# Strings are scanned in parts of so many letters, each with a window's rest of the next one.
PART_LETTERS = 4096

SPAN = "array<struct<start:bigint,kind_order:int,stop:bigint,kind:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, stop, value) of all matches, in code points.

    The pieces between the matches give the places: running sums of their lengths and those of the matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    gaps = F.slice(gaps, F.lit(1), F.size(matches))
    sizes = F.zip_with(gaps, matches, lambda g, m: g + F.length(m))
    stops = F.slice(running_sums(sizes), F.lit(2), F.size(matches))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pairs = F.arrays_zip(matches.alias("match"), stops.alias("stop"), values.alias("value"))
    return F.transform(
        pairs,
        lambda p: F.struct((p["stop"] - F.length(p["match"])).alias("start"), p["stop"].alias("stop"), p["value"].alias("value")),
    )


def as_spans(found: Column, order: int, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].cast("bigint").alias("start"),
            F.lit(order).alias("kind_order"),
            m["stop"].cast("bigint").alias("stop"),
            F.lit(kind).alias("kind"),
        ),
    )


def base_spans(text: Column) -> list[Column]:
    """Spans of each base kind: all matches from the left, without those whose measured group is too short."""

    def spans(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
        looked_for = LONG_ENOUGH.get(kind, pattern)
        long_ones = F.filter(located(text, looked_for, group), lambda m: F.length(m["value"]) >= least)
        return F.when(text.rlike(looked_for), as_spans(long_ones, order, kind)).otherwise(F.array().cast(SPAN))

    return [spans(order, *rule) for order, rule in enumerate(BASE_KINDS)]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def overlapping(value: Column, window: int) -> Column:
    """Parts of the string that hold every window of it."""
    parts = F.regexp_extract_all(value, F.lit(f".{{1,{PART_LETTERS}}}"), F.lit(0))
    return bind(
        parts,
        lambda p: F.zip_with(
            p, F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.lit(""))), lambda own, following: F.concat(own, F.substring(following, 1, window - 1))
        ),
    )


def hot(value: Column, letters: str, window: int, least_bits: float) -> Column:
    """Whether a window of the string reaches the entropy.

    One pass over the letters, whose places in ``letters`` are found once. The state holds the count of each letter in
    the window, a character for each, and the sum of c log2 c over them; a letter that enters or leaves changes one
    character and one term. Entropy is log2(window) - sum / window.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most_sum = window * (math.log2(window) - least_bits) + 1e-9
    zero = ord("0")
    start = F.struct(F.lit("0" * len(letters)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(False).alias("hot"))
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - zero
    put = lambda counts, place, c: F.overlay(counts, F.char(c + zero), place, F.lit(1))

    def enter(state: Column, place: Column, full: Column) -> Column:
        def counted(c: Column) -> Column:
            total = state["sum"] - F.get(terms, c) + F.get(terms, c + 1)
            return F.struct(put(state["counts"], place, c + 1).alias("counts"), total.alias("sum"), (state["hot"] | (full & (total <= most_sum))).alias("hot"))

        return bind(count(state["counts"], place), counted)

    def leave(state: Column, place: Column) -> Column:
        def counted(c: Column) -> Column:
            total = state["sum"] - F.get(terms, c) + F.get(terms, c - 1)
            return F.struct(put(state["counts"], place, c - 1).alias("counts"), total.alias("sum"), state["hot"].alias("hot"))

        return bind(count(state["counts"], place), counted)

    def scan(places: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            left = F.when(state["hot"] | (i < window), state).otherwise(leave(state, F.get(places, i - window)))
            return F.when(state["hot"], state).otherwise(bind(left, lambda rest: enter(rest, F.get(places, i), i >= window - 1)))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda state: state["hot"])

    return bind(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(letters), c)), scan)


def without_words(value: Column) -> Column:
    """The candidate with blanks in place of UUIDs, words, numbers and made-up pieces, so that all places stay."""
    made_up = lambda p: MADE_UP_SHARE * (F.length(p) - F.length(F.regexp_replace(p, MADE_UP, ""))) >= F.length(p)
    word = lambda p: p.rlike(WORD) | (p.rlike(MADE_UP) & made_up(p))
    plain = F.regexp_replace(value, UUID, " " * 36)
    pieces = F.split(plain, f"(?<={SEPARATOR})|(?={SEPARATOR})", -1)
    return F.array_join(F.transform(pieces, lambda p: F.when(word(p), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")


def entropy_spans(text: Column) -> list[Column]:
    """Spans of each character class: every stretch of a candidate between words that holds a hot window, whole."""

    def spans(order: int, kind: str, letters: str, window: int, bits: float) -> Column:
        own = "[" + letters.replace("-", r"\-") + "]"
        candidate = own + "{" + str(window) + ",}"
        # A stretch neither begins nor ends with a separator, but for the padding of base64.
        stretch = f"(?!{SEPARATOR})" + own + "{" + str(window - 1) + ",}(?:=|(?<!" + SEPARATOR + "))"
        allowed = lambda m: reduce(lambda a, b: a | b, [m["value"].rlike(p) for p in ALLOWED])
        found = F.filter(located(text, candidate), lambda m: ~allowed(m))
        stretches = F.flatten(
            F.transform(
                found,
                lambda m: F.transform(
                    bind(without_words(m["value"]), lambda v: located(v, stretch)),
                    lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["stop"]).alias("stop"), s["value"].alias("value")),
                ),
            )
        )
        long_ones = F.filter(stretches, lambda s: F.length(s["value"]) >= window)
        hot_ones = F.filter(long_ones, lambda s: F.exists(overlapping(s["value"], window), lambda p: hot(p, letters, window, bits)))
        return F.when(text.rlike(candidate), as_spans(hot_ones, order, kind)).otherwise(F.array().cast(SPAN))

    return [spans(order, *rule) for order, rule in enumerate(ENTROPY_KINDS, start=len(BASE_KINDS))]


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """All rows and columns, with ``into``: spans (start, kind_order, stop, kind) in code points, by start and kind.

    Base spans always stay. An entropy span is added unless a base span or an entropy span of an earlier class holds
    all of it. A null or empty text has no spans; repeated rows are scanned alike; a column named ``into`` is replaced,
    all others stay as they are.
    """
    body = whole_text(text)
    base, entropy = unused(docs, "base"), unused(docs, "entropy")
    found = docs.withColumn(base, F.concat(*base_spans(body))).withColumn(entropy, F.concat(*entropy_spans(body)))
    known = F.concat(base, entropy)
    added = F.filter(
        entropy,
        lambda e: ~F.exists(
            known, lambda b: (b["kind_order"] < e["kind_order"]) & (b["start"] <= e["start"]) & (b["stop"] >= e["stop"])
        ),
    )
    return found.withColumn(into, F.array_sort(F.concat(base, added))).drop(base, entropy)


def listed(spans: Column) -> Column:
    """kind:start:stop of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the count of each base kind, base_sha256 and spans."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE_KINDS]
    base = F.filter("secrets", lambda s: s["kind_order"] < len(BASE_KINDS))
    return found.select(
        "doc_id", *counts, sha256_of(listed(base)).alias("base_sha256"), F.array_join(listed(F.col("secrets")), ",").alias("spans")
    )


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All rows and columns; every stretch of spans in the text is replaced by the mask, and n_chars, where there is such
    a column, follows. Texts without spans stay as they are, null included."""
    spans = unused(docs, "spans")
    found = find_secrets(docs, into=spans)
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    cut = F.aggregate(
        spans,
        state,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                F.concat(
                    acc["out"],
                    F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.when((s["start"] == acc["at"]) & (acc["at"] > 0), F.lit("")).otherwise(F.lit(mask)),
                ).alias("out"),
                s["stop"].alias("at"),
            ),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    out = found.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
