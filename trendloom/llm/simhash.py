"""SimHash near-duplicates: fingerprints, links within a Hamming radius by BK-trees, and their components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import row_key, small_batches, stored, unused, whole_text

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
# A shard of more fingerprints is cut further; a BK-tree never holds more than this, or than the free bits allow.
SHARD_LIMIT = 1024
ALL_BITS = (1 << 64) - 1


def fingerprint_of(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles: a bit is set if it is set in over half of their hashes."""
    words = text.encode("utf-8").lower().split()  # on bytes, both concern ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = np.r_[0, ends[: n - 1] + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for part in range(0, n, 8192):
        bits = np.unpackbits(hashes[part : part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(text)


class BkTree:
    """Burkhard-Keller tree: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self, root: int):
        self.root = root
        self.children: dict[int, dict[int, int]] = {root: {}}

    def add(self, value: int) -> None:
        node = self.root
        while (distance := (node ^ value).bit_count()) > 0:
            following = self.children[node].get(distance)
            if following is None:
                self.children[node][distance] = value
                self.children[value] = {}
                return
            node = following

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` away: only edges of ``distance - radius`` to ``distance + radius`` are followed."""
        found, open_nodes = [], [self.root]
        while open_nodes:
            node = open_nodes.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.children[node]
            for d in range(max(1, distance - radius), distance + radius + 1):
                if d in edges:
                    open_nodes.append(edges[d])
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what the pairs within the radius connect: each value is searched in the shard's tree
    before it joins it, and one link to each component met is enough."""
    parent = {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    links, tree = [], BkTree(values[0])
    for value in values[1:]:
        for other in tree.within(value, radius):
            a, b = root(value), root(other)
            if a != b:
                parent[a] = b
                links.append((value, other))
        tree.add(value)
    return links


def split_masks(mask: int, parts: int, keep: int) -> list[int]:
    """Masks that fix ``keep`` of ``parts`` equal pieces of the bits that ``mask`` leaves free, besides its own."""
    free = [b for b in range(64) if not mask >> b & 1]
    pieces = [sum(1 << b for b in free[i * len(free) // parts : (i + 1) * len(free) // parts]) for i in range(parts)]
    return [mask | sum(chosen) for chosen in combinations(pieces, keep)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shards(prints: DataFrame, radius: int, limit: int) -> DataFrame:
    """Rows (mask, bits, members): every pair within the radius shares at least one shard, all shards have two members
    or more and none has many.

    Of ``radius + 2`` pieces of 64 bits, two are equal in both members of a pair, so a shard is a choice of two pieces
    and their bits. A shard over the limit is cut again by its free bits, of which one piece of ``radius + 1`` is equal.
    Each cut fixes a third of the free bits or more; when at most ``log2(limit)`` bits are free, no shard can be over
    the limit.
    """
    spark = prints.sparkSession
    masks = split_masks(0, radius + 2, 2)
    keyed = prints.select("print", F.explode(F.array([F.lit(signed(m)) for m in masks])).alias("mask"))
    done = None
    while True:
        keyed = keyed.select("print", "mask", F.col("print").bitwiseAND(F.col("mask")).alias("bits"))
        counts = keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        counts = stored(counts, "simhash-shards")
        may_be_large = any(64 - m.bit_count() > limit.bit_length() - 1 for m in masks)
        large = F.col("members") > limit if may_be_large else F.lit(False)
        sized = keyed.join(counts, ["mask", "bits"])
        small = sized.filter(~large).select("mask", "bits", "print")
        done = small if done is None else done.unionByName(small)
        if not may_be_large or counts.filter(large).isEmpty():
            return done.groupBy("mask", "bits").agg(F.collect_list("print").alias("prints"))
        finer = [(signed(m), [signed(x) for x in split_masks(m, radius + 1, 1)]) for m in masks]
        table = F.broadcast(spark.createDataFrame(finer, "mask long, finer array<long>"))  # a few hundred masks
        keyed = sized.filter(large).select("print", "mask").join(table, "mask")
        keyed = stored(keyed.select("print", F.explode("finer").alias("mask")), "simhash-finer")
        masks = [x for m in masks for x in split_masks(m, radius + 1, 1)]


def linked(prints: DataFrame, radius: int = MAX_BITS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) between different fingerprints that have the components of all pairs within the radius."""

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def search(members: pd.Series) -> pd.Series:
        out = []
        for values in members:
            found = tree_links([int(v) & ALL_BITS for v in sorted(values)], radius)
            out.append([{"a": signed(a), "b": signed(b)} for a, b in found])
        return pd.Series(out, dtype=object)

    small_batches(prints.sparkSession)
    return shards(prints, radius, limit).select(F.inline(search("prints"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every linked node; the root is the least node that it reaches.

    Alternates large-star and small-star rounds: a node passes its least neighbour to the greater ones, then to the
    others, until nothing changes. Rounds grow with the logarithm of the longest path. Neighbours are never gathered in
    a list: the least one comes from an aggregate and is joined back.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "simhash-edges")
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u"), F.col("v")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
        starred = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("low").alias("u")).distinct()
        down = starred.groupBy("v").agg(F.min("u").alias("low"))
        passed = starred.join(down, "v")
        smaller = passed.select("v", F.col("low").alias("u")).union(
            passed.filter("u != low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        )
        after = stored(smaller.distinct(), "simhash-edges")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        edges = after


def classified(marked: DataFrame, radius: int) -> DataFrame:
    """Rows with a ``print`` and a ``doc_id``, with their ``component_id``."""
    prints = stored(marked.groupBy("print").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    roots = components(linked(prints.select("print"), radius))
    classes = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "least_id", F.coalesce("root", "print").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(classes.join(least, "root").select("print", "root", "component_id"), "print")


def near_duplicates(
    docs: DataFrame, radius: int = MAX_BITS, shingle: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    Texts that are null, empty or blank have fingerprint zero and are linked like any other. Rows of one text, repeated
    ids among them, share a fingerprint and so a component; its id is the least one that is not null, and null only if
    all are. Other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    marked = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(whole_text(text), shingle).alias("print"))
    return classified(stored(marked, "simhash-prints"), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_each(docs: DataFrame, radius: int = MAX_BITS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The documents without their near-duplicates, with all columns: one row of each component stays.

    It is the row of the least id (null ids come last), then of the least digest of id and text. Of several rows with
    this id and text, one stays. Which rows stay follows from the narrow columns alone; texts are moved once, to meet
    the digests of the rows that stay.
    """
    small_batches(docs.sparkSession)
    marked = docs.select(
        "doc_id", row_key("doc_id", "text").alias("row"), fingerprint(whole_text("text"), shingle).alias("print")
    )
    found = classified(stored(marked, "simhash-prints"), radius)
    one = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("one"))
    row, number, least = (unused(docs, name) for name in ("__row", "__copies", "__least"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stays = one.select(F.col("one.row").alias(row))
    copies = found.groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias(number))
    stays = stored(stays.join(copies, row), "simhash-stays")
    kept = docs.withColumn(row, row_key("doc_id", "text")).join(stays, row)
    single = kept.filter(F.col(number) == 1).select(*columns)
    # Rows of one id and text that differ elsewhere: that of the least digest stays, whatever task sees it first.
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    repeated = kept.filter(F.col(number) > 1).groupBy(row).agg(F.min_by(F.struct(*columns), digest).alias(least))
    return single.unionByName(repeated.select(f"{least}.*"))
