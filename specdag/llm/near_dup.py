"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds hashes of its word shingles. The hash's top bits tell how rare a shingle is, so the least values of a
set, which it retains as its sketch, are its rarest. Inverted lists of the retained values give candidates: a list is that of
two values that follow one another in both sketches, since single values meet by chance the more the larger a corpus is. The
sketches of two candidates bound the similarity of the sets from above and drop the impossible, first by odd sketches, which are
narrow, then by the union of the retained values; the full sets confirm.

No link is lost. Let two sets of similarity t >= 0.8 that are not equal be walked in the common order, and let x and y count the values that only
one of them has. Their shared values are more than x + y + 1, so two of them follow one another with no other value between.
Up to the first such two, at most x + y + 1 values are shared, hence they are among the first 2 x + y + 2 of the one set, that
is 2 (1 - t) n + 2 at most, which is what a set of n values retains.

Equal sets are one class before any list is made. Lists are not expanded into pairs: each list is first tied to its most
central member, the links so confirmed form components, and only members of lists that are still in different components
are paired, by single values of the sketches then. A group of copies thus costs as many pairs as it has members, and no link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import discard, drop_shuffles, materialize, text_slices, words_of
from specdag.llm.components import components
from specdag.llm.grams import mix

#: The most narrow rows that are broadcast, beyond which a shuffled join takes over, and pairs of one salted group.
MOST_BROADCAST, GROUP = 400_000, 256
#: Fixed values of cost only, results are the same under any: words and shingles that occur in so large a share of documents
#: count as frequent, and the most of them that are told apart.
SHARE, MOST_WORDS, MOST_SHINGLES = 2e-4, 1 << 16, 1 << 18
#: The bits of a shingle's hash, above which are those of its rarity, and the bits of an odd sketch.
BITS, ODD = 56, 512
#: Fixed value: how many values two sets must share for a pair of single values; four at most.
TOGETHER = 3
_ALL = -(1 << 63)  # stands for all words together


@dataclass(frozen=True)
class Ranks:
    """What the order of shingles goes by: how often words and frequent shingles occur."""

    tokens: int
    words: tuple[np.ndarray, np.ndarray]  # hashes in order, and counts
    shingles: tuple[np.ndarray, np.ndarray]


def _looked_up(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts, 0 for what the table lacks."""
    if not len(table[0]):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
    return np.where(table[0][at] == hashes, table[1][at], 0)


class Shingles:
    """Of each of a batch of texts the distinct shingles in order: hashes of ``BITS`` bits, under ``ranks`` with the rarity above."""

    def __init__(self, texts: pa.Array, width: int, ranks: Ranks | None = None):
        words, self.codes, self.offsets = words_of(pc.ascii_lower(texts))
        self.width, self.ranks = width, ranks
        self.distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        self.words = self.distinct[self.codes] if words else np.zeros(0, np.uint64)
        self.logs = np.zeros(len(self.words), np.float32)
        if ranks is not None and words:
            self.logs = np.log2(_looked_up(self.distinct >> np.uint64(64 - BITS), ranks.words) + np.float32(0.5)).astype(np.float32)[self.codes]
        self.windows = self._windows(0, len(self.words), width)  # those across two texts are never read

    def _windows(self, begin: int, past: int, width: int) -> np.ndarray:
        n = max(0, past - begin - width + 1)
        h = np.full(n, width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(begin, begin + width):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.words[k : k + n])
        h >>= np.uint64(64 - BITS)
        if self.ranks is None or not n:
            return h
        logs = np.full(n, -(width - 1) * np.log2(max(2, self.ranks.tokens)), np.float32)
        for k in range(begin, begin + width):
            logs += self.logs[k : k + n]
        seen = np.exp2(np.minimum(logs, 60)) + np.float32(0.5)  # occurrences if words met at random
        seen = np.maximum(seen, _looked_up(h, self.ranks.shingles))
        rank = np.minimum(np.round(3 * np.log2(seen)) + 3, 127).astype(np.uint64)
        return rank << np.uint64(BITS) | h

    def of(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        found = np.sort(self.windows[a : b - self.width + 1] if b - a >= self.width else self._windows(a, b, b - a) if b > a else self.windows[:0])
        fresh = np.ones(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=fresh[1:])
        return found[fresh]


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, whatever the rarity of its shingles."""
    with np.errstate(over="ignore"):
        mixed = mix((found & np.uint64((1 << BITS) - 1)) ^ np.uint64(0x5851F42D4C957F2D))
        return int(mixed.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(mixed)).view(np.int64))


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """For each of ODD bits whether an odd number of values fall on it. Two sketches differ in no more bits than the sets do in values."""
    at = (found & np.uint64(ODD - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=ODD) & 1).view(np.int64)


def _near_enough(one: str, other: str, percent: int) -> Column:
    """By sizes ``n`` and odd sketches of two sides, whose columns end so: sets of the wanted similarity differ in so few values."""
    n, m = F.col(f"n{one}"), F.col(f"n{other}")
    differ = sum((F.bit_count(F.get(f"odd{one}", F.lit(i)).bitwiseXOR(F.get(f"odd{other}", F.lit(i)))) for i in range(1, ODD // 64)), F.bit_count(F.get(f"odd{one}", F.lit(0)).bitwiseXOR(F.get(f"odd{other}", F.lit(0)))))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _frequent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of words (as -1 - hash) and shingles (as hash), for those that a slice has often enough, and of all words together."""
    for batch in text_slices(batches, "text"):
        shingles = Shingles(batch.column("text"), width)
        n = np.bincount(shingles.codes, minlength=len(shingles.distinct))
        some = np.flatnonzero(n >= max(2, SHARE * batch.num_rows))
        windows = np.sort(shingles.windows)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(windows)), bool), windows[1:] != windows[:-1])))
        m = np.diff(np.append(first, len(windows)))
        often = m >= max(3, SHARE * batch.num_rows)
        words = -1 - (shingles.distinct[some] >> np.uint64(64 - BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([_ALL], words, windows[first[often]].astype(np.int64)))), pa.array(np.concatenate(([len(shingles.codes)], n[some], m[often])).astype(np.int64))], ["item", "n"])


def _ranks(source: DataFrame, width: int) -> Ranks:
    total = source.count()
    counted = materialize(source.mapInArrow(partial(_frequent, width=width), "item long, n long").groupBy("item").agg(F.sum("n").alias("n")), "near-counts")
    tokens = counted.filter(F.col("item") == _ALL).agg(F.sum("n")).first()[0] or 0
    often = counted.filter((F.col("n") >= SHARE * total) & (F.col("item") != _ALL))

    def table(kind: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        found = kind.orderBy(F.desc("n"), "item").limit(most).toArrow()
        hashes = found.column("item").to_numpy().astype(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], found.column("n").to_numpy()[order]

    words = table(often.filter("item < 0").select((-1 - F.col("item")).alias("item"), "n"), MOST_WORDS)
    shingles = table(often.filter("item >= 0"), MOST_SHINGLES)
    discard(counted)
    return Ranks(tokens, words, shingles)


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int, ranks: object) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        shingles = Shingles(batch.column("text"), width, ranks.value)
        sizes, marks, odd, retained = [], [], [], []
        for i in range(batch.num_rows):
            found = shingles.of(i)
            sizes.append(len(found))
            marks.append(fingerprint(found))
            odd.append(odd_sketch(found))
            retained.append(found[: 2 * (100 - percent) * len(found) // 100 + 2])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in retained])))
        values = pa.array(np.concatenate(retained).view(np.int64)) if retained else pa.array([], pa.int64())
        sketches = pa.array(np.concatenate(odd)) if odd else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*marks, strict=True)), pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1) * (ODD // 64), pa.int32()), sketches), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
            ["doc_id", "n", "f1", "f2", "odd", "retained"],
        )


def checked_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join narrow ``right`` by broadcast while it is small, else by a shuffle."""
    return left.join(F.broadcast(right) if right.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else right, on, how)


def _full(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted texts; rows of another text under the same id are left out."""
    for batch in text_slices(batches, "text"):
        shingles = Shingles(batch.column("text"), width)
        sets, at = [], []
        for i, f1 in enumerate(batch.column("f1").to_pylist()):
            found = shingles.of(i)
            if fingerprint(found)[0] == f1:
                sets.append(found.tobytes())
                at.append(i)
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("hub", "salt", "member")), pa.array(sets, pa.binary())], ["hub", "salt", "member", "found"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and salt, the hub's own set first."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for h, member, raw in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), batch.column("found"), strict=True):
            found = np.frombuffer(raw.as_buffer(), np.uint64)
            if member is None:
                hub, own = h, found.copy()
                continue
            if h != hub:
                raise ValueError("a member came before its hub")
            both = np.sort(np.concatenate((own, found)))
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(own) + len(found) - shared):
                a.append(h)
                b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (hub, member) of classes those that are linked, as (a, b)."""
    # as 32-bit values: half as wide; those that meet within a set are given back as slack
    short = F.array_distinct(F.transform("retained", lambda v: F.hash(v)))
    cut = classes.select("node", "n", F.size("retained").alias("k"), short.alias("s"))
    sides = [cut.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "k", "s"))) for name in ("hub", "member")]
    # A certain bound: of two sets, the one whose retained values end first in the common order shares with the other, of
    # those, only what both retain.
    slack = F.col("k_hub") - F.size("s_hub")
    most = F.size(F.array_intersect("s_hub", "s_member")) + slack + F.greatest(F.col("n_hub") - F.col("k_hub"), F.col("n_member") - F.col("k_member"))
    sizes = materialize(classes.select("node", "n", "odd"), "near-sizes")
    for name in ("hub", "member"):
        pairs = checked_join(pairs, sizes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}")), name)
    hopeful = (
        pairs.filter(_near_enough("_hub", "_member", percent))
        .select("hub", "member")
        .join(sides[1], "member")
        .join(sides[0], "hub")
        .filter(most * (100 + percent) >= (F.col("n_hub") + F.col("n_member")) * percent)
        .select("hub", "member")
    )
    hopeful = materialize(hopeful, "near-pairs")
    salts = hopeful.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    members = hopeful.join(salts, "hub").select(F.col("member").alias("node"), "hub", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt"), "member")
    hubs = salts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"))
    wanted = materialize(members.unionByName(hubs).join(classes.select("node", F.col("doc").alias("doc_id"), "f1"), "node").drop("node"), "near-wanted")
    texts = checked_join(docs, wanted, "doc_id").select("f1", "hub", "salt", "member", "text")
    full = texts.mapInArrow(partial(_full, width=width), "hub long, salt long, member long, found binary")
    near = full.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    links = materialize(near.mapInArrow(partial(_confirm, percent=percent), "a long, b long").distinct(), "near-links")
    discard(sizes, hopeful, wanted)
    drop_shuffles(docs.sparkSession)
    return links


def _lists(classes: DataFrame) -> DataFrame:
    """The inverted lists of two members or more: ``key``, ``node`` and the list's ``size``."""
    at = classes.filter(F.size("retained") > 1).select("node", "retained", F.explode(F.sequence(F.lit(0), F.size("retained") - 2)).alias("at"))
    entries = at.select("node", F.xxhash64(F.get("retained", F.col("at")), F.get("retained", F.col("at") + 1)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).filter("size > 1")
    sizes = materialize(sizes, "near-keys")
    drop_shuffles(classes.sparkSession)
    two = sizes.filter("size = 2").select("key", F.explode(F.array("low", "high")).alias("node"), "size")
    more = checked_join(entries, sizes.filter("size > 2").select("key", "size"), "key")  # most lists have two members
    lists = materialize(two.unionByName(more), "near-lists")
    discard(sizes)
    drop_shuffles(classes.sparkSession)
    return lists


def _crossing(lists: DataFrame, hubs: DataFrame, listed: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member) that may be linked of different components of ``tied``, of nodes that lie with another component in a list.
    Those with the list's hub, and so all of a list of two, have been tried.

    Of two sets that are linked and not equal, which share four values at least, the first ``TOGETHER`` that they share are among the first
    n - least + TOGETHER of each, least being what a linked set of n must share; from each of them on, both must still hold
    the others of the least overlap. One rare value in common may be chance, several are not."""
    untried = lists.filter("size > 2").select("key", "node").join(hubs.filter("size > 2").select("key", "hub"), "key").filter("node <> hub").select("key", "node")
    placed = checked_join(untried, tied, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    nodes = materialize(placed.join(mixed, "key", "left_semi").select("node", "component").distinct(), "near-open")
    first = F.slice("retained", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + TOGETHER).cast("int"))
    entries = checked_join(listed, nodes, "node").select("node", "component", "n", "odd", F.posexplode(first).alias("place", "value"))
    mixed = entries.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("value")
    rest = materialize(entries.join(mixed, "value", "left_semi"), "near-rest")
    discard(nodes)
    drop_shuffles(lists.sparkSession)
    other = rest.select("value", F.col("node").alias("member"), F.col("component").alias("other"), F.col("n").alias("n_other"), F.col("odd").alias("odd_other"), F.col("place").alias("place_other"))
    overlap = F.least(F.col("n") - F.col("place"), F.col("n_other") - F.col("place_other")) + (TOGETHER - 1)
    possible = (overlap * (100 + percent) >= (F.col("n") + F.col("n_other")) * percent) & _near_enough("", "_other", percent)
    pairs = rest.withColumnRenamed("node", "hub").join(other, "value").filter((F.col("component") != F.col("other")) & (F.col("hub") < F.col("member")) & possible)
    pairs = materialize(pairs.groupBy("hub", "member").agg(F.count("*").alias("together")).filter(F.col("together") >= TOGETHER).select("hub", "member"), "near-crossing")
    discard(rest)
    return pairs


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` (its set's size) and ``component_id``, the least id reachable over
    links of a Jaccard similarity of ``percent`` (80 at least) or more; a row is to stay if the two ids are equal.

    A-Z are lower-cased; words are runs without the space and U+0009 to U+000D; a text with fewer words than ``width``
    has one shingle of all of them. Null and empty texts have empty sets and are linked with nothing. Rows with a null id
    are linked with nothing and have a null component. Rows that share an id and have words share a component, and so do all that
    are linked with any of them. Other columns are ignored; an empty table gives no rows. Sets are of 56-bit hashes.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(_ranks(source, width))
    schema = "doc_id long, n long, f1 long, f2 long, odd array<long>, retained array<long>"
    made = source.mapInArrow(partial(_sets, width=width, percent=percent, ranks=ranks), schema)
    sets = materialize(made.withColumn("row", F.monotonically_increasing_id()), "near-sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets are one class, named by its least row; most classes are one row
    shared = known.groupBy("f1", "f2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.count("*").alias("many")).filter("many > 1").drop("many")
    shared = materialize(shared, "near-shared")
    named = checked_join(known.select("doc_id", "row", "f1", "f2", "n"), shared, ["f1", "f2", "n"], "left")
    rows = materialize(named.select("row", "doc_id", F.coalesce("node", "row").alias("node"), F.coalesce("doc", "doc_id").alias("doc")), "near-rows")
    copies = rows.filter("row <> node").select("row")
    classes = checked_join(known, copies, "row", "left_anti").select(F.col("row").alias("node"), F.col("doc_id").alias("doc"), "n", "f1", "odd", "retained")
    lists = _lists(classes)
    listed = materialize(checked_join(classes, materialize(lists.select("node").distinct(), "near-listed"), "node", "left_semi"), "near-sketches")
    narrow = materialize(sets.select("doc_id", "row", "n"), "near-ids")
    discard(sets, shared)
    source = source.filter(F.col("doc_id").isNotNull())

    central = lists.groupBy("node").agg(F.sum("size").alias("weight"))
    central = materialize(central, "near-central")
    hubs = materialize(checked_join(lists, central, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"), F.first("size").alias("size")), "near-hubs")
    stars = materialize(lists.drop("size").join(hubs, "key").filter("node <> hub").select("hub", F.col("node").alias("member")).distinct(), "near-stars")
    discard(central)
    links = _verify(source, listed, stars, width, percent)

    tied = components(links)
    crossing = _crossing(lists, hubs, listed, tied, percent)
    discard(lists, hubs)
    done = stars.unionByName(stars.select(F.col("member").alias("hub"), F.col("hub").alias("member")))
    more = _verify(source, listed, crossing.join(done, ["hub", "member"], "left_anti"), width, percent)
    discard(listed, stars, crossing)

    twice = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a <> high").drop("high")
    same = checked_join(rows, materialize(twice, "near-twice"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")  # rows that share an id
    tied = components(links.unionByName(more).unionByName(same))
    # what is tied is little and may be sent to where the rows are; a class that is not has its own least id
    members = tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
    own = checked_join(rows.filter("row = node").select("node", "doc"), members, "node")
    ids = materialize(own.groupBy("component").agg(F.min("doc").alias("least")), "near-components")
    placed = checked_join(rows, tied, "node", "left").select("row", "doc", F.coalesce("component", "node").alias("component"))
    placed = checked_join(placed, ids, "component", "left").select("row", F.coalesce("least", "doc").alias("component_id"))
    return narrow.join(placed, "row", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
