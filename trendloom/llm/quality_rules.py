"""Line-first cleaning: rules drop lines, then documents that lost too much text are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.arrays import covered, neighbours, text_words
from trendloom.llm.common import whole_text

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# A document that keeps less than this share of its characters is rejected.
MIN_KEPT_SHARE = 0.5

# A line of navigation: several separators, hardly a sentence between them.
NAVIGATION = r"(?:[|»›•·→]|\x20/\x20|\x20>\x20)"
NAVIGATION_SHARE = 0.2
# Fixed openings of notices that a site prints on every page.
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|cookies? (?:policy|settings|to improve)|we use cookies|privacy policy|terms of (?:use|service)"
    r"|licensed under|copyright (?:\(c\)|©|\d{4})|enable javascript|click here|sign (?:in|up) (?:to|for|now)|subscribe to"
    r"|share (?:this|on)|follow us|powered by|skip to (?:main )?content)\b"
)
# Symbols per word, and runs of marks, that no sentence has.
SYMBOL_SHARE = 0.3
MARK_RUNS = r"[!?]{2,}"


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule. Lines without a word never fail.

    Punctuation: symbols at over 0.3 a word, or runs of exclamation or question marks at over 0.3 a word.
    Navigation: at least three separators, and over 0.2 a word. Boilerplate: a notice in a line of up to 40 words.
    """
    words = F.greatest(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1))
    symbols = F.length(line) - F.length(F.regexp_replace(line, "[#*$%&<>]", ""))
    runs = F.regexp_count(line, F.lit(MARK_RUNS))
    separators = F.regexp_count(line, F.lit(NAVIGATION))
    return (
        (symbols > SYMBOL_SHARE * words)
        | (runs > SYMBOL_SHARE * words)
        | ((separators >= 3) & (separators > NAVIGATION_SHARE * words))
        | ((words <= 40) & line.rlike(BOILERPLATE))
    )


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash is there twice or more. Sorting by hash brings equal windows together; only
    texts with any are sorted."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(windows) - 1
    pairs = F.zip_with(
        F.slice(placed, F.lit(1), size),
        F.slice(placed, F.lit(2), size),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    positions = F.array_sort(F.array_distinct(F.flatten(pairs)))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(positions, WINDOW)).otherwise(F.lit(0).cast("long"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_kept: float = MIN_KEPT_SHARE) -> DataFrame:
    """Per row: doc_id, the counts of the base rules, base_failed, kept, n_chars_kept, and clean_text.

    ``clean_text`` is the text without failed lines. A null text counts as empty: it has no words, fails the base rules
    and is not kept. A text without characters loses nothing. Repeated rows are judged alike, other columns are not
    read, an empty table gives no rows. Windows are compared by 64-bit hashes of their words.
    """
    body = whole_text(text)
    lines = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.split(body, "\n").alias("lines"))
    worded = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = lines.select(
        "doc_id",
        F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length("body").cast("long").alias("n_chars"),
        worded.alias("worded"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("passed"),
        F.transform(text_words(F.col("body")), lambda w: F.xxhash64(w)).alias("w1"),
    )
    paired = lambda a, b: F.xxhash64(a, b)
    counted = counted.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_chars",
        F.size("w1").cast("long").alias("n_words"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.array_join("passed", "\n").alias("clean_text"),
        neighbours(F.col("w1"), 1, paired).alias("w2"),
    )
    kept = [c for c in counted.columns if c != "w2"]
    counted = counted.select(*kept, neighbours(F.col("w2"), 2, paired).alias("w4"))
    counted = counted.select(*kept, neighbours(F.col("w4"), 4, paired).alias("w8"))
    counted = counted.select(*kept, repeated_words(F.col("w8")).alias("n_repeat_words"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    kept_chars = F.length("clean_text").cast("long")
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (kept_chars >= min_kept * F.col("n_chars"))).alias("kept"),
        kept_chars.alias("n_chars_kept"),
        "clean_text",
    )
