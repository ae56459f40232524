"""Exact removal of byte strings that occur more than once, by suffix arrays of shards.

Where the text goes. A window of 200 bytes has a least k-gram hash, its anchor, which depends on its bytes alone. A run
of windows with one anchor is cut out as a segment, and segments are dealt to shards by anchor, so that all copies of a
window meet. Segments whose bytes occur twice are repeated as a whole; only different segments that share an anchor go
to a suffix array. It is sorted by Larsson-Sadakane refinement, Kasai's method gives the common prefixes, and windows
of an anchor that is spread over several shards are looked up in the other shards' sorted windows by binary search.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import small_batches, stored, whole_text
from trendloom.session import scratch_dir

LENGTH = 200
GRAM = 64
# Bytes of text that are cut into segments at once.
CHUNK = 1 << 20
# A run of windows is cut after so many, which bounds a segment.
RUN = 256
# Different segments of one anchor in one shard; more are salted over several.
SHARD_SEGMENTS = 2048
# Segments of one suffix array: some 300 bytes each.
ARRAY_SEGMENTS = 4096
# Windows that meet in one lookup across shards.
LOOKUP_WINDOWS = 200_000

# Odd multiplier and letter codes of the k-gram hash, from a fixed generator.
_RNG = np.random.default_rng(20)
MULTIPLIER = int(_RNG.integers(1 << 62, dtype=np.uint64)) * 2 + 1
LETTERS = _RNG.integers(np.iinfo(np.uint64).max, size=256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hash of every ``size`` bytes: a power of two, joined in halves and mixed."""
    out, power = LETTERS[data], np.uint64(MULTIPLIER)
    width = 1
    while width < size:
        out = out[: len(out) - width] * power + out[width:]
        power, width = power * power, 2 * width
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def sliding(values: np.ndarray, size: int, combine: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``size`` neighbours, in doubling steps."""
    out, width = values, 1
    while width < size:
        step = min(width, size - width)
        out, width = combine(out[: len(out) - step], out[step:]), width + step
    return out


def segments(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(piece, anchor, digest, start, windows) of all segments of the pieces, as arrays; the bytes of a segment are
    ``pieces[piece][start : start + windows + length - 1]``.

    The digest is 62 bits of a hash of the bytes, above one bit that tells that the anchor is there twice, in which case
    a window may be repeated within the segment.
    """
    data, span = b"".join(pieces), length - GRAM + 1
    if len(data) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        grams = gram_hashes(np.frombuffer(data, dtype=np.uint8))
    least = sliding(grams, span, np.minimum)
    whole = np.zeros(len(least) + 1, dtype=np.int8)  # windows that lie in one piece
    for begin, size in zip(begins[sizes >= length].tolist(), sizes[sizes >= length].tolist(), strict=True):
        whole[begin] += 1
        whole[begin + size - length + 1] -= 1
    whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
    edge = np.ones(len(least), dtype=bool)
    edge[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    edge[begins[begins < len(least)]] = True
    starts = np.flatnonzero(edge)
    windows = np.diff(np.r_[starts, len(least)])
    starts, windows = starts[whole[starts]], windows[whole[starts]]
    cuts = -(-windows // RUN)
    within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts, windows = np.repeat(starts, cuts) + within * RUN, np.minimum(RUN, np.repeat(windows, cuts) - within * RUN)
    anchors = least[starts]
    # Grams that are the least of some window around them; those of a segment's anchor are counted in its range.
    around = np.zeros(len(grams) + span - 1, dtype=np.uint64)
    around[span - 1 : span - 1 + len(least)] = least
    chosen = np.flatnonzero(grams == sliding(around, span, np.maximum))
    chosen = chosen[np.argsort(grams[chosen], kind="stable")]
    hashes = grams[chosen]
    low, high = np.searchsorted(hashes, anchors, "left"), np.searchsorted(hashes, anchors, "right")
    twice = np.zeros(len(starts), dtype=np.int64)
    for i in np.flatnonzero(high - low > 1).tolist():
        inside = chosen[low[i] : high[i]]
        ends = np.searchsorted(inside, (starts[i], starts[i] + windows[i] + span - 1))
        twice[i] = ends[1] - ends[0] > 1
    digest = xxhash.xxh3_64_intdigest
    stops = (starts + windows + (length - 1)).tolist()
    digests = np.array([digest(data[i:j]) for i, j in zip(starts.tolist(), stops, strict=True)], dtype=np.uint64)
    digests = (digests >> np.uint64(2)).astype(np.int64) << 1 | twice
    piece = np.searchsorted(begins, starts, "right") - 1
    while len(piece) and (empty := sizes[piece] == 0).any():
        piece -= empty
    return piece, anchors.view(np.int64), digests, starts - begins[piece], windows


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order.

    Larsson and Sadakane's refinement: suffixes are sorted by a prefix, and groups that tie are sorted by the rank of
    the suffix as many symbols further on, which doubles the prefix; groups of one are left alone.
    """
    n, width = len(data), 4
    padded = np.r_[data.astype(np.int64), np.zeros(width, dtype=np.int64)]
    key = np.zeros(n, dtype=np.int64)
    for i in range(width):
        key = key * 512 + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, dtype=np.int64)
    # The rank of a group is the place of its last member, so that ranks stay as groups split.
    group = np.cumsum(first) - 1
    last = np.r_[np.flatnonzero(first)[1:] - 1, n - 1]
    rank[order] = last[group]
    open_places = np.flatnonzero(np.bincount(group)[group] > 1)
    while len(open_places):
        members = order[open_places]
        further = np.where(members + width < n, rank[np.minimum(members + width, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + further
        turn = np.argsort(key, kind="stable")
        members, key = members[turn], key[turn]
        order[open_places] = members
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(first) - 1
        ends = np.r_[np.flatnonzero(first)[1:] - 1, len(members) - 1]
        rank[members] = open_places[ends[group]]
        open_places = open_places[np.bincount(group)[group] > 1]
        width *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Length, up to ``limit``, of the prefix that each suffix of ``order`` shares with the one before it.

    Kasai's method: the common prefix of the next suffix of a text is at least one shorter, so comparing goes on from
    there. The parts between ``starts`` and ``ends`` advance together, one suffix each.
    """
    n = len(data)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    at, known = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    alive = np.flatnonzero(at < ends)
    while len(alive):
        here = at[alive]
        spot = place[here]
        other = order[np.maximum(spot - 1, 0)]
        most = np.where(spot > 0, np.minimum(limit, n - np.maximum(here, other)), 0)
        length = np.minimum(np.maximum(known[alive] - 1, 0), most)
        going = np.flatnonzero(length < most)
        while len(going):
            same = data[here[going] + length[going]] == data[other[going] + length[going]]
            going = going[same]
            length[going] += 1
            going = going[length[going] < most[going]]
        out[spot] = length
        known[alive] = length
        at[alive] += 1
        alive = alive[at[alive] < ends[alive]]
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part and each start of a window in it: whether this window is also at another place of these parts, and
    whether it is the first of its kind in the array.

    A 0 ends every part, below all bytes: suffixes that reach it within a window sort apart from whole windows.
    """
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    data = np.zeros(ends[-1], dtype=np.int64)
    inside = np.ones(len(data), dtype=bool)
    inside[ends - 1] = False
    data[inside] = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64) + 1
    order = suffix_array(data)
    shared = common_prefixes(data, order, ends - 1 - sizes, ends, length) >= length
    hit, first = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    hit[order], first[order] = shared | np.r_[shared[1:], False], ~shared
    spans = [slice(e - 1 - s, e - length) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return [(hit[x], first[x]) for x in spans]


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, windows) of each run of repeated window starts."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, copies, body) into one row for every segment. Texts are joined up to a bounded size, and longer ones
    cut into pieces that overlap by a window less one byte, so memory does not grow with a text."""

    def cut(pieces: list[bytes], rows: list[int], offsets: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
        piece, anchor, digest, start, windows = segments(pieces)
        row = np.array(rows, dtype=np.int64)[piece]
        start = start + np.array(offsets, dtype=np.int64)[piece]
        columns = [
            batch.column("key").take(pa.array(row)),
            batch.column("copies").take(pa.array(row)),
            pa.array(anchor),
            pa.array(digest),
            pa.array(start.astype(np.int32)),
            pa.array(windows.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["key", "copies", "anchor", "digest", "start", "windows"])

    for batch in batches:
        pieces, rows, offsets, held = [], [], [], 0
        for row, body in enumerate(batch.column("body")):
            data = body.as_py().encode()
            for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
                pieces.append(data[at : at + CHUNK + LENGTH - 1])
                rows.append(row)
                offsets.append(at)
                held += len(pieces[-1])
                if held >= CHUNK:
                    yield cut(pieces, rows, offsets, batch)
                    pieces, rows, offsets, held = [], [], [], 0
        if pieces:
            yield cut(pieces, rows, offsets, batch)


def shard_hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (anchor, different, salts, digest, bytes), sorted by anchor and salt, into rows (anchor, different, digest,
    runs, rest): runs of repeated starts, and for salted anchors every different window of the shard with one of its
    starts.

    Whole groups of one anchor and salt are put into one array until it is full; a group is never split.
    """
    held: list[tuple] = []

    def finish(rows: list[tuple]) -> pd.DataFrame:
        out = []
        found = repeated_starts([r[-1] for r in rows])
        for (anchor, _, different, salts, digest, data), (hit, first) in zip(rows, found, strict=True):
            rest = []
            if salts > 1:
                rest = [{"window": xxhash.xxh3_128_digest(data[i : i + LENGTH]), "at": int(i)} for i in np.flatnonzero(first)]
            out.append((anchor, different, digest, [{"at": a, "windows": n} for a, n in runs_of(hit)], rest))
        return pd.DataFrame(out, columns=["anchor", "different", "digest", "runs", "rest"])

    for batch in batches:
        for row in batch[["anchor", "salt", "different", "salts", "digest", "bytes"]].itertuples(index=False, name=None):
            if len(held) >= ARRAY_SEGMENTS and held[-1][:2] != row[:2]:
                yield finish(held)
                held = []
            held.append(row)
    if held:
        yield finish(held)


def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (windows, digests, starts), one per anchor and range of windows, with the windows of all shards; gives
    (digest, at) of the windows that are there more than once.

    The windows of the shards are merged into one sorted array; each is looked up in it by binary search.
    """
    for batch in batches:
        for anchor, found in zip(batch["anchor"], batch["found"], strict=True):
            windows = np.array([f["window"] + b"." for f in found], dtype="S17")  # numpy drops zero bytes at the end
            merged = np.sort(windows)
            there = np.searchsorted(merged, windows, "right") - np.searchsorted(merged, windows, "left")
            hits = np.flatnonzero(there > 1)
            yield pd.DataFrame(
                {
                    "anchor": anchor,
                    "digest": [found[i]["digest"] for i in hits],
                    "at": [found[i]["at"] for i in hits],
                }
            )


def covered_bytes(frame: DataFrame) -> DataFrame:
    """Rows (key, runs): sorted, merged runs of removed bytes, from rows (key, start, stop)."""
    gathered = frame.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("runs"))

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def merged(column: pd.Series) -> pd.Series:
        out = []
        for runs in column:
            pairs = np.array([(r["start"], r["stop"]) for r in runs], dtype=np.int64)
            reach = np.maximum.accumulate(pairs[:, 1])
            first = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
            last = np.r_[first[1:] - 1, len(pairs) - 1]
            out.append([{"start": int(a), "stop": int(b)} for a, b in zip(pairs[first, 0], reach[last], strict=True)])
        return pd.Series(out, dtype=object)

    return gathered.select("key", merged("runs").alias("runs"))


def key_of(text: Column) -> Column:
    """First half of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def distinct_texts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Rows (key, body, copies) of all different texts that have a window, laid out in buckets by key, so that later
    joins with places of a text don't move texts again: a table of this name."""
    spark = docs.sparkSession
    body = whole_text(text)
    rows = docs.select(body.alias("body")).filter(F.octet_length("body") >= LENGTH).withColumn("key", key_of(F.col("body")))
    rows = rows.groupBy("key").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "key").option("path", scratch_dir(spark, "suffix-texts")).saveAsTable(name)
    return spark.table(name)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """Rows (key, runs) of the texts that have a repeated window."""
    cut = texts.select("key", "copies", "body").mapInArrow(
        cut_segments, "key binary, copies long, anchor long, digest long, start int, windows int"
    )
    # A segment is repeated as a whole if its bytes are there twice; it needs a closer look if its anchor is in other
    # segments too, or twice in itself.
    counts = cut.groupBy("anchor", "digest").agg(F.sum(F.least("copies", F.lit(2))).alias("times"))
    counts = stored(counts, "suffix-counts")
    anchors = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    twice = F.col("digest").bitwiseAND(F.lit(1)) == 1
    kinds = counts.join(anchors, "anchor", "left").withColumn("different", F.coalesce("different", F.lit(1)))
    kinds = kinds.filter((F.col("times") > 1) | (F.col("different") > 1) | twice)
    kinds = kinds.select("anchor", "digest", (F.col("times") > 1).alias("whole"), (twice | (F.col("different") > 1)).alias("closer"), "different")
    places = stored(cut.drop("copies").join(kinds, ["anchor", "digest"]), "suffix-places")

    whole = places.filter("whole").select("key", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("stop"))

    # One place of every segment that needs a closer look; its bytes are read there.
    looked = places.filter("closer").groupBy("anchor", "digest", "different", "whole")
    looked = looked.agg(F.min(F.struct("key", "start", "windows")).alias("place")).select("anchor", "digest", "different", "whole", "place.*")
    here = F.encode("body", "UTF-8")
    looked = looked.join(texts.select("key", "body"), "key").select(
        "anchor",
        "different",
        "digest",
        F.ceil(F.col("different") / SHARD_SEGMENTS).cast("int").alias("salts"),
        F.substring(here, F.col("start") + 1, F.col("windows") + LENGTH - 1).alias("bytes"),
    )
    looked = looked.withColumn("salt", F.pmod(F.shiftright("digest", 1), F.col("salts")).cast("int"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = looked.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", "digest")
    found = shards.mapInPandas(
        shard_hits,
        "anchor long, different long, digest long, runs array<struct<at:int,windows:int>>, rest array<struct<window:binary,at:int>>",
    )
    found = stored(found, "suffix-hits")
    hits = found.select("anchor", "digest", F.inline("runs"))

    # The different windows of every shard of a salted anchor meet those of its other shards, in ranges of windows: an
    # anchor's windows are never in one place.
    rest = found.filter(F.col("different") > SHARD_SEGMENTS).select("anchor", "different", "digest", F.inline("rest"))
    ranges = F.ceil(F.col("different") * RUN / LOOKUP_WINDOWS).cast("long")
    rest = rest.withColumn("range", F.pmod(F.xxhash64("window"), ranges))
    met = rest.groupBy("anchor", "range").agg(F.collect_list(F.struct("window", "digest", "at")).alias("found"))
    across = met.select("anchor", "found").mapInPandas(lookup, "anchor long, digest long, at int")
    hits = hits.unionByName(across.withColumn("windows", F.lit(1)))

    single = places.filter("closer AND NOT whole").select("anchor", "digest", "key", "start")
    part = hits.join(single, ["anchor", "digest"]).select(
        "key", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + F.col("windows") + LENGTH - 1).alias("stop")
    )
    return covered_bytes(whole.unionByName(part))


def without_runs(body: Column, runs: Column) -> Column:
    """Bytes of the text outside the runs."""

    @F.pandas_udf("binary")
    def without(bodies: pd.Series, column: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(bodies, column, strict=True):
            data, at, kept = text.encode(), 0, []
            for run in gone:
                kept.append(data[at : run["start"]])
                at = run["stop"]
            out.append(b"".join([*kept, data[at:]]))
        return pd.Series(out, dtype=object)

    return without(body, runs)


def changed_texts(docs: DataFrame, text: str = "text", kept: Callable[[Column], Column] = lambda kept: kept) -> DataFrame:
    """Rows (key, n_removed, n_spans, kept) of every different text that loses bytes; ``kept`` may be no whole UTF-8, and
    is stored as the given function of it.

    Every byte goes that lies in a string of LENGTH bytes which starts anywhere else, in the same text too; texts of
    repeated rows repeat each other. The table of texts leaves the catalog as soon as the rows are stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = f"suffix_texts_{uuid.uuid4().hex}"
    try:
        texts = distinct_texts(docs, text, name)
        return stored(without_repeats(texts, kept), "suffix-changed")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def without_repeats(texts: DataFrame, kept: Callable[[Column], Column]) -> DataFrame:
    runs = stored(repeated_runs(texts), "suffix-runs")
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + (r["stop"] - r["start"]))
    return texts.select("key", "body").join(runs, "key").select(
        "key",
        length.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        kept(without_runs(F.col("body"), F.col("runs"))).alias("kept"),
    )


def removal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one per input row.

    Null counts as empty; texts under LENGTH bytes keep all; repeated rows get equal figures; other columns are not
    read; an empty table gives no rows.
    """
    # A plain stored side, so that Spark can split a text that very many rows have.
    changed = changed_texts(docs, text, lambda kept: F.sha2(kept, 256)).withColumnRenamed("kept", "changed_sha256")
    body = whole_text(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest")
    ).withColumn("key", F.unhex(F.substring("digest", 1, 32)))
    return rows.join(changed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("changed_sha256", "digest").alias("kept_sha256"),
    )
