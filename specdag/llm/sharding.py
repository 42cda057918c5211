"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together. Groups of one size are interchangeable, so what is packed are classes: a size and how
many groups have it. The driver gets the distinct sizes only; it takes them from the largest down, and for each a balanced tree
of the open bins, ordered by remaining capacity, gives the tightest bin, which takes as many groups of that size as fit.
A group then finds its bin by its number among those of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specdag.llm.common import discard, materialize

#: Fixed value: the most size classes that are broadcast, beyond which a shuffled join takes over.
MOST_BROADCAST = 1_000_000


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _lifted(node: _Node, side: str) -> _Node:
    """The child of that side takes the node's place."""
    other = "right" if side == "left" else "left"
    child = getattr(node, side)
    setattr(node, side, getattr(child, other))
    setattr(child, other, node)
    node.height = 1 + max(_height(node.left), _height(node.right))
    child.height = 1 + max(_height(child.left), _height(child.right))
    return child


def _balanced(node: _Node) -> _Node:
    """Heights of the two sides differ by one at most afterwards, if by two before."""
    node.height = 1 + max(_height(node.left), _height(node.right))
    lean = _height(node.left) - _height(node.right)
    if abs(lean) > 1:
        side, other = ("left", "right") if lean > 1 else ("right", "left")
        child = getattr(node, side)
        if _height(getattr(child, other)) > _height(getattr(child, side)):
            setattr(node, side, _lifted(child, other))
        return _lifted(node, side)
    return node


def _added(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _added(node.left, key)
    else:
        node.right = _added(node.right, key)
    return _balanced(node)


def _without_least(node: _Node) -> tuple[_Node | None, tuple[int, int]]:
    if node.left is None:
        return node.right, node.key
    node.left, key = _without_least(node.left)
    return _balanced(node), key


def _without(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key < node.key:
        node.left = _without(node.left, key)
    elif node.key < key:
        node.right = _without(node.right, key)
    elif node.left is None or node.right is None:
        return node.left or node.right
    else:
        node.right, node.key = _without_least(node.right)
    return _balanced(node)


class Tree:
    """Open bins (remaining capacity, number) in a height-balanced search tree: each step takes the logarithm of the bins."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, entry: tuple[int, int]) -> None:
        self.root = _added(self.root, entry)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (remaining, bin) of least remaining capacity that is at least ``size``."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self.root = _without(self.root, best)
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each class (size, how many) the runs (bin, how many) in which its items are placed, and how many bins of ``capacity``
    were opened: what placing item after item gives, the larger before the smaller and ties to the lower bin. A bin that has
    taken an item is the tightest for the next of the same size while that fits, so one visit fills it."""
    if classes and max(classes)[0] > capacity:
        raise ValueError("an item is larger than the capacity")
    tree, runs, opened = Tree(), [[] for _ in classes], 0
    for i in sorted(range(len(classes)), key=lambda i: -classes[i][0]):
        size, left = classes[i]
        while left:
            remaining, b = tree.take(size) or (capacity, opened)
            opened = max(opened, b + 1)
            fit = min(left, remaining // size) if size else left
            runs[i].append((b, fit))
            left -= fit
            tree.add((remaining - fit * size, b))
    return runs, opened


def fit_into(classes: list[tuple[int, int]], shards: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The runs under the least capacity, found by halving, with which no more than ``shards`` bins are opened."""
    total = sum(size * n for size, n in classes)
    low = max([-(-total // shards), *(size for size, _ in classes), 1])
    runs, opened = best_fit_decreasing(classes, low)
    if opened <= shards:
        return runs, low
    high = 2 * low + 1  # best fit opens fewer than 2 * total / capacity bins, or one
    best = best_fit_decreasing(classes, high)[0]
    while high - low > max(1, low // 4096):
        middle = (low + high) // 2
        runs, opened = best_fit_decreasing(classes, middle)
        if opened <= shards:
            best, high = runs, middle
        else:
            low = middle
    return best, high


def _numbered(rows: DataFrame, by: list[str], order: list[str], cells: int) -> DataFrame:
    """Add ``_n``, a gapless number from 0 within ``by``. Rows are numbered in cells by the hash of ``order``, which must tell them
    apart, and cells by how many rows lie before them, so that a large group is no single task's."""
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = dealt.groupBy(*by, "_cell").agg(F.count("*").alias("_many"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_cell", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_from"))
    inner = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order)) - 1)
    return inner.join(starts, [*by, "_cell"]).withColumn("_n", (F.col("_from") + F.col("_in")).cast("long")).drop("_cell", "_in", "_from")


def _runs(classes: list[tuple[int, int]], runs: list[list[tuple[int, int]]]) -> Iterator[dict]:
    for (size, _), own in zip(classes, runs, strict=True):
        past, pasts = 0, []
        for _, n in own:
            past += n
            pasts.append(past)
        yield {"bytes": size, "_pasts": pasts, "_bins": [b for b, _ in own]}


def shard(docs: DataFrame, shards: int | None = None, *, capacity: int | None = None, row_bytes: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Give every row of ``docs`` a ``shard`` and a ``slot`` in it: ``shards`` shards of nearly equal bytes, or as many of
    ``capacity`` bytes as best fit opens.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes of the text, null: none, plus ``row_bytes``), ``text_crc32``, ``shard``,
    ``slot`` (gapless from 0 in the shard). Equal texts share a shard (null counts as empty), so a group larger than
    an equal share makes its shard larger; with ``capacity`` it raises. Every group is an item of best-fit-decreasing; the driver
    gets one row for each distinct size of a group. Groups of one size are taken by hash, so the shards do not depend
    on the row order; fully repeated rows get slots in any order. Null ids are allowed, other columns are ignored, an empty
    table gives no rows.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    cells = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("_t")).select(
        "doc_id", (F.octet_length("_t") + row_bytes).cast("long").alias("size"), F.crc32(F.encode("_t", "UTF-8")).alias("text_crc32"), F.xxhash64("_t").alias("_g"), F.xxhash64(F.lit(1), "_t").alias("_g2")
    )
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")  # the texts are read once
    groups = materialize(rows.groupBy("_g", "_g2").agg(F.sum("size").alias("bytes")), "shard-groups")
    found = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    classes = sorted(zip(found.column("bytes").to_pylist(), found.column("n").to_pylist(), strict=True), reverse=True)
    runs = fit_into(classes, shards)[0] if shards else best_fit_decreasing(classes, capacity)[0]
    schema = pa.schema([("bytes", pa.int64()), ("_pasts", pa.list_(pa.int64())), ("_bins", pa.list_(pa.int32()))])
    bins = materialize(spark.createDataFrame(pa.Table.from_pylist(list(_runs(classes, runs)), schema=schema)), "shard-runs")
    bins = F.broadcast(bins) if len(classes) <= MOST_BROADCAST and sum(map(len, runs)) <= MOST_BROADCAST else bins
    run = F.size(F.filter("_pasts", lambda past: past <= F.col("_n")))
    placed = _numbered(groups, ["bytes"], ["_g", "_g2"], cells).join(bins, "bytes").select("_g", "_g2", F.get("_bins", run).alias("shard"))
    placed = materialize(rows.join(placed, ["_g", "_g2"]).select("doc_id", "size", "text_crc32", "shard", "_row"), "shard-placed")
    discard(rows, groups)
    return _numbered(placed, ["shard"], ["doc_id", "text_crc32", "_row"], cells).select("doc_id", "size", "text_crc32", "shard", F.col("_n").alias("slot"))
