"""K-d tree sharding: nodes are split at weighted medians along their widest metadata dimension until leaves are small."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import stored, whole_text

SHARDS = 24
ROW_BYTES = 8
# Buckets of one histogram pass; each pass sends at most this many sums for every open node to the driver.
BUCKETS = 2048
# Once so many rows at most are left around the cuts of a level, they are read by the driver.
FINISH_ROWS = 20_000
# A cut goes between two texts rather than through the rows of one when that moves this share of a leaf at most.
TOLERANCE = 0.01
# Rows of one numbering window.
NUMBERED_ROWS = 100_000
# Rows of one file of a stored table, once every core has a file.
FILE_ROWS = 1_000_000

DIMENSIONS = ("d_size", "d_lang", "d_source")
# Ties of a dimension are ordered by the digest of the text, then by the row.
TIES = ("content", "point")


@dataclass
class Node:
    """A part of the space that takes ``shards`` leaves. ``cut`` holds values of ``order``: rows whose leading values
    are below go left. The cut lies in ``low`` to ``high`` of the next key, a range that holds ``rows`` rows of weight
    ``held``, with ``below`` before it; ``text_edges`` are the weights before and after the one text that is left."""

    shards: int
    path: int = 1
    total: int = 0
    order: tuple[str, ...] = ()
    cut: tuple[int, ...] = ()
    low: int = 0
    high: int = 0
    below: int = 0
    held: int = 0
    rows: int = 0
    text_edges: tuple[int, ...] = ()
    bounds: dict[str, tuple[int, int]] = field(default_factory=dict)
    left: Node | None = None
    right: Node | None = None

    @property
    def target(self) -> float:
        return self.total * (self.shards // 2) / self.shards

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def goes_left(self) -> Column:
        out = F.lit(False)
        for name, value in reversed(list(zip(self.order, self.cut, strict=False))):
            out = (F.col(name) < value) | ((F.col(name) == value) & out)
        return out

    def leaf_path(self) -> Column:
        if self.left is None:
            return F.lit(self.path)
        return F.when(self.goes_left(), self.left.leaf_path()).otherwise(self.right.leaf_path())


def points_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One narrow row per document: its size, its coordinates, and a number that tells repeated rows apart. They are
    stored in a few files, however many partitions the shuffle has: every level of the tree reads them several times.

    Rows of one text take the least source and language of them, so that they have one place and stay together unless
    a cut has to go through them.
    """

    def coordinate(name: str) -> Column:
        if name not in docs.columns:
            return F.lit(-1).cast("long")
        return F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(-1)).cast("long")

    body = whole_text(text)
    size = (F.octet_length(body) + ROW_BYTES).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        size.alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        size.alias("d_size"),
        coordinate("source").alias("d_source"),
        coordinate("lang").alias("d_lang"),
        F.xxhash64(body).bitwiseAND(F.lit((1 << 61) - 1)).alias("content"),
        F.monotonically_increasing_id().alias("point"),
    )
    rows = stored(rows, "kd-rows")
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILE_ROWS))
    same = rows.groupBy("content", "size").agg(F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"))
    # A plain side, so that Spark can split a text that very many rows have.
    same = stored(same.repartition(files), "kd-texts")
    return stored(rows.drop("d_source", "d_lang").join(same, ["content", "size"]).repartition(files), "kd-points")


def measure(points: DataFrame, tree: Node, open_nodes: list[Node]) -> None:
    """Weight and bounds of every open node, in one pass."""
    coordinates = (*DIMENSIONS, *TIES)
    sums = [F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows")]
    sums += [f(c).alias(f"{f.__name__}_{c}") for c in coordinates for f in (F.min, F.max)]
    rows = {r.path: r for r in points.groupBy(tree.leaf_path().alias("path")).agg(*sums).collect()}
    for node in open_nodes:
        if row := rows.get(node.path):
            node.total, node.rows = row.total, row.rows
            node.bounds = {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in coordinates}


def in_range(node: Node) -> Column:
    """Rows of the node whose key can still hold the cut."""
    inside = (F.col("path") == node.path) & F.col(node.order[len(node.cut)]).between(node.low, node.high)
    for name, value in zip(node.order, node.cut, strict=False):
        inside &= F.col(name) == value
    return inside


def next_key(node: Node) -> None:
    """A range of one value hands over to the next key, so that the copies of a text are told apart by their row."""
    while node.low == node.high and len(node.cut) + 1 < len(node.order):
        node.cut = (*node.cut, node.low)
        node.low, node.high = node.bounds[node.order[len(node.cut)]]
        if node.order[len(node.cut)] == "point":
            node.text_edges = (node.below, node.below + node.held)


def narrow(points: DataFrame, nodes: list[Node]) -> None:
    """One histogram pass: every node's range becomes the bucket in which its weight passes the target."""
    bucket, widths = F.lit(None).cast("long"), {}
    for node in nodes:
        widths[node.path] = width = -(-(node.high - node.low + 1) // BUCKETS)
        place = F.expr(f"({node.order[len(node.cut)]} - ({node.low}L)) div {width}L")
        bucket = F.when(in_range(node), place).otherwise(bucket)
    held = points.select("path", bucket.alias("bucket"), "size").filter("bucket IS NOT NULL")
    sums: dict[int, list[tuple[int, int, int]]] = {}
    for r in held.groupBy("path", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect():
        sums.setdefault(r.path, []).append((r.bucket, r.size, r.rows))
    for node in nodes:
        buckets, width = sorted(sums[node.path]), widths[node.path]
        for b, node.held, node.rows in buckets:
            if node.below + node.held >= node.target or b == buckets[-1][0]:
                node.low, node.high = node.low + b * width, min(node.high, node.low + (b + 1) * width - 1)
                break
            node.below += node.held
        next_key(node)


def finish(points: DataFrame, nodes: list[Node], slack: float) -> None:
    """Reads the few rows that are left in each range and cuts where the weight is nearest to the target; between two
    texts, where that changes the weight by no more than the slack."""
    keep = F.lit(False)
    for node in nodes:
        keep |= in_range(node)
    rows: dict[int, list] = {}
    for r in points.filter(keep).select("path", *DIMENSIONS, *TIES, "size").collect():
        rows.setdefault(r.path, []).append(r)
    for node in nodes:
        keyed = sorted((*(r[c] for c in node.order), r.size) for r in rows[node.path])
        weight, between, within = node.below, [], []
        for before, row in zip([None, *keyed], keyed, strict=False):
            off = abs(weight - node.target)
            (within if before and before[:2] == row[:2] else between).append((off, row[:-1]))
            weight += row[-1]
        after = (abs(weight - node.target), (*keyed[-1][:-2], keyed[-1][-2] + 1))
        between.append(after)
        if node.text_edges:  # all rows left are of one text, whose edges may lie outside
            points_of_cut = (node.bounds["point"][0], node.bounds["point"][1] + 1)
            within += between
            between = [(abs(w - node.target), (*node.cut, p)) for w, p in zip(node.text_edges, points_of_cut, strict=True)]
        best = min(between + within)
        text_edge = min(between)
        node.cut = text_edge[1] if text_edge[0] <= best[0] + slack else best[1]


def find_cuts(points: DataFrame, tree: Node, open_nodes: list[Node], leaf_bytes: float) -> None:
    """Weighted median of every open node along its widest dimension. Histograms of all rows narrow in on it until a
    bounded number of rows is left, from which the cut is read."""
    spans = {c: max(1, tree.bounds[c][1] - tree.bounds[c][0]) for c in DIMENSIONS}
    for node in open_nodes:
        widest = max(DIMENSIONS, key=lambda c: (node.bounds[c][1] - node.bounds[c][0]) / spans[c])
        node.order, node.cut, node.below, node.held = (widest, *TIES), (), 0, node.total
        node.low, node.high = node.bounds[widest]
        next_key(node)
    points = points.withColumn("path", tree.leaf_path())
    few = FINISH_ROWS // len(open_nodes)
    while wide := [n for n in open_nodes if n.rows > few and n.high > n.low]:
        narrow(points, wide)
    finish(points, open_nodes, TOLERANCE * leaf_bytes)


def kd_tree(points: DataFrame, shards: int) -> Node:
    """The tree over the points; only sums of buckets and bounds of nodes reach the driver."""
    tree = Node(shards)
    measure(points, tree, [tree])
    leaf_bytes = tree.total / shards
    while open_nodes := [n for n in tree.leaves() if n.shards > 1 and n.bounds]:
        find_cuts(points, tree, open_nodes, leaf_bytes)
        for node in open_nodes:
            node.left = Node(node.shards // 2, 2 * node.path)
            node.right = Node(node.shards - node.shards // 2, 2 * node.path + 1)
        measure(points, tree, [child for n in open_nodes for child in (n.left, n.right)])
    return tree


def numbered(placed: DataFrame, rows: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in every shard: rows are numbered in small windows, which start where the counts of
    those before them end."""
    parts = max(1, -(-rows // NUMBERED_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("point"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("point")
    return placed.withColumn("place", F.row_number().over(inside)).join(counts, ["shard", "part"]).withColumn(
        "slot", (F.col("offset") + F.col("place") - 1).cast("long")
    )


def sharded(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per input row; the law is ``bytes``.

    With ``target_bytes`` the number of leaves is the total divided by it; else it is ``shards``. A null text has no
    bytes, a null source or language lies before all others, missing columns don't split. Repeated rows are told apart
    by their place in the table and may be split. An empty table gives no rows.
    """
    points = points_of(docs, doc_id, text)
    rows, total = points.agg(F.count(F.lit(1)), F.sum("size")).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    if not rows:
        shard = F.lit(0)
    else:
        tree = kd_tree(points, shards)
        number, first = {}, 0
        for leaf in tree.leaves():
            number[leaf.path] = first
            first += leaf.shards
        path = tree.leaf_path()
        shard = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), path)
    placed = points.select("doc_id", "size", "text_crc32", "point", shard.cast("int").alias("shard"))
    return numbered(placed, rows // shards + 1).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
