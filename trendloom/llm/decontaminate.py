"""Benchmark decontamination by winnowing: fingerprints of training and test texts meet, and hits are extended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.arrays import neighbours
from trendloom.llm.common import row_key, sha256_of, stored, unused, whole_text

WINDOW = 10
GRAM = 6
# Fingerprints of the benchmark up to this many are sent to all tasks (some 200 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A selected k-gram is one long: 35 bits of its hash above 28 bits of its place, so that the least one of a window also
# tells where it is. Equal windows select the same place. False matches are told apart by the words around.
PLACE_BITS = 28
HASH_MASK = (1 << 35) - 1
PLACE_MASK = (1 << PLACE_BITS) - 1


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, A-Z in lower case. Words are compared by them."""
    return F.transform(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CASED_WORD)).cast("long")


def stepped(frame: DataFrame, keep: list[str], source: str, name: str, distance: int, combine) -> DataFrame:
    """The kept columns and ``name``, each element of ``source`` combined with the one ``distance`` after it."""
    return frame.select(*keep, neighbours(F.col(source), distance, combine).alias(name))


def grams(frame: DataFrame, keep: list[str], size: int) -> DataFrame:
    """Adds ``gram``: hashes of all runs of ``size`` words of column ``w``, combined in doubling steps."""
    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    frame, done = frame.select(*keep, F.col("w").alias("gram")), 1
    while done < size:
        step = min(done, size - done)
        frame, done = stepped(frame, keep, "gram", "gram", step, pair), done + step
    return frame


def fingerprints(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, fp, at, around): the least k-gram of each window of k-grams, with the words around it.

    A window spans WINDOW words, so every shared run of WINDOW words has a common fingerprint. ``around`` holds the
    hashes of the k-gram's words and of as many on both sides as such a run can reach; null beyond the ends.
    """
    reach, carried = WINDOW - GRAM, [*keep, "w"]
    frame = grams(frame, carried, GRAM)
    packed = F.transform(
        "gram", lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(HASH_MASK)), PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    frame, done = frame.select(*carried, packed.alias("least")), 1
    while done < reach + 1:
        step = min(done, reach + 1 - done)
        frame, done = stepped(frame, carried, "least", "least", step, lambda a, b: F.least(a, b)), done + step
    edge = F.array_repeat(F.lit(None).cast("long"), reach)
    frame = frame.select(*keep, F.array_distinct("least").alias("least"), F.concat(edge, "w", edge).alias("padded"))
    place = lambda p: p.bitwiseAND(F.lit(PLACE_MASK)).cast("int")
    selected = F.transform(
        "least",
        lambda p: F.struct(
            F.shiftright(p, PLACE_BITS).alias("fp"),
            place(p).alias("at"),
            F.slice("padded", place(p) + 1, F.lit(GRAM + 2 * reach)).alias("around"),
        ),
    )
    return frame.select(*keep, F.inline(selected))


def extension(steps: list[Column]) -> Column:
    """How many steps in a row hold, from the first."""
    out = F.lit(0)
    for step in reversed(steps):
        out = F.when(F.coalesce(step, F.lit(False)), out + 1).otherwise(F.lit(0))
    return out


def long_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (row, start, stop, item): runs of WINDOW shared words or more around a common fingerprint."""
    reach = WINDOW - GRAM
    test = stored(
        fingerprints(items, ["item"]).select("fp", "item", F.col("around").alias("theirs")).distinct(), "benchmark-prints"
    )
    if test.count() <= BROADCAST_ROWS:
        test = F.broadcast(test)
    met = fingerprints(docs, ["row"]).join(test, "fp")
    same = [F.col("around")[i] == F.col("theirs")[i] for i in range(GRAM + 2 * reach)]
    met = met.filter(reduce(lambda a, b: a & b, same[reach : reach + GRAM]))
    left, right = extension(same[:reach][::-1]), extension(same[reach + GRAM :])
    met = met.select("row", "item", (F.col("at") - left).alias("start"), (F.col("at") + GRAM + right).alias("stop"))
    return met.filter(F.col("stop") - F.col("start") >= WINDOW)


def short_hits(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """Rows (row, start, stop, item): places of items of ``length`` words, fewer than a window."""
    test = grams(items.filter(F.size("w") == length), ["item"], length).select("item", F.col("gram")[0].alias("h")).distinct()
    test = stored(test, "benchmark-short")
    if test.count() <= BROADCAST_ROWS:
        test = F.broadcast(test)
    places = grams(docs, ["row"], length).select("row", F.posexplode("gram").alias("start", "h"))
    return places.join(test, "h").select("row", "item", "start", (F.col("start") + length).alias("stop"))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows (row, n_hit, items) for every distinct id and text with a hit; ``row`` is ``row_key(doc_id, text)``.

    Stretches and items of a document are made distinct before they are gathered. A null item id is written as
    ``null``; items of one id count once. Null texts have no words. Items without words match nothing.
    """
    ours = docs.select(row_key("doc_id", "text").alias("row"), word_hashes(whole_text(text)).alias("w"))
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), word_hashes(whole_text("text")).alias("w")
    )
    sizes = items.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n")).distinct()  # at most eleven
    short = sorted(r.n for r in sizes.collect() if 0 < r.n < WINDOW)
    found = reduce(DataFrame.unionByName, [short_hits(ours, items, n) for n in short], long_hits(ours, items.filter(F.size("w") >= WINDOW)))
    merged = F.aggregate(
        F.array_sort("stretches"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("n"),
            F.greatest(acc["end"], s["stop"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    gathered = found.groupBy("row").agg(
        F.collect_set(F.struct("start", "stop")).alias("stretches"), F.collect_set("item").alias("items")
    )
    return gathered.select("row", merged.alias("n_hit"), F.array_sort("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256 and contaminated, beside doc_id.

    Repeated rows get the same figures. An empty benchmark hits nothing, an empty table gives no rows, columns other
    than doc_id, text and item_id are not read.
    """
    ours = docs.select("doc_id", row_key("doc_id", "text").alias("row"), n_words(whole_text("text")).alias("n_words"))
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return ours.join(hits(docs, benchmark), "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        sha256_of(items).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any hit, with all columns."""
    row = unused(docs, "__row")
    found = hits(docs, benchmark).select(F.col("row").alias(row))
    marked = docs.withColumn(row, row_key("doc_id", "text"))
    return marked.join(found, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
