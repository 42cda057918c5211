"""Language-model scoring with a probabilistic suffix tree over words.

A text is a sequence of words and one end. A context is what stands before a word: the last word, the last two, up to the
last three, the start of the text counting as one. Every context that training texts have twice is put to a divergence test: it
is kept if what follows it differs enough from what follows its longest kept suffix. The test is the gain in log likelihood
over that suffix, with every occurrence judged by the context's other occurrences only. A kept context's distribution is
smoothed towards that of its longest kept suffix, and a word is scored by the longest kept suffix of what stands before it.
At the root are the counts of words. Words that training texts lack share the mass of the words seen once, evenly over as many
unseen words as the words seen once and twice let expect: were there more, the shares would sum to more than one.

Work is dealt by subtrees. All contexts that end in one word are the tree below that word; a bucket has whole subtrees, so
that it counts, tests, smooths and scores by itself, and no table of contexts is ever sent anywhere. A context that has a large
share of all words is hot: its subtree is dealt by the next longer contexts, and its own figures are found on a
second way, as are those of the root: blocks of texts send the distinct pairs of such a context and a word to buckets by word, and
these tell each subtree what the words in it have there. So a word that fills the corpus costs a few entries for each block,
and any list of hot contexts gives the same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specdag.llm.common import discard, drop_shuffles, materialize, text_slices, words_of
from specdag.llm.grams import mix

#: The longest context, how often training texts must have one, what it must gain in nats to be kept, and how
#: much weight, for each distinct word that follows it, its longest kept suffix may get.
DEPTH, LEAST, STRENGTH, WEIGHTS = 3, 2, 1.0, (0.25, 0.5, 1.0, 2.0, 4.0)
#: The end of a text as a word (no word has a space), and the symbol before a text's first word.
END, START = " ", np.uint64(0x5354415254)
#: The bytes of a block of texts, the symbols of some blocks together that go to buckets at a time and those of a bucket
#: that are scored at a time, the unit of the sums of logarithms that buckets return, and the bytes of the hashes of words and
#: of the symbols further back.
BLOCK_BYTES, AT_ONCE, SCORED, UNIT, WIDE, NARROW = 8 << 20, 5 << 20, 1 << 19, 1e-9, 7, 3

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pack(*columns: np.ndarray) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True) if (raw := b"".join(c.tobytes() for c in columns)) else b""


def _unpack(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    total, at, out = sum(np.dtype(kind).itemsize * n for kind, n in kinds), 0, []
    raw = pa.decompress(blob, total, "zstd", asbytes=True) if total else b""
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += np.dtype(kind).itemsize * n
    return out


def _cut(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each value, plane by plane, so that what values in order have in common lies together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _whole(planes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def _joined(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * _ODD + symbol)


@dataclass
class Hot:
    """Hot contexts, numbered from 1 by depth; number 0 is the root. ``sorted`` has the hashes in order and ``own`` their numbers;
    ``above[c]`` is the number of c's suffix, which is hot too."""

    hashes: np.ndarray
    above: np.ndarray
    depth: np.ndarray
    sorted: np.ndarray
    own: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, int, int]]) -> Hot:
        """From (hash, hash of the suffix, depth); a context whose suffix is not among them is left out."""
        number, above, depth = {0: 0}, [0], [0]
        for own, suffix, d in sorted(rows, key=lambda x: (x[2], x[0])):
            if suffix in number:
                number[own] = len(above)
                above.append(number[suffix])
                depth.append(d)
        hashes = np.array(list(number), np.uint64)
        order = np.argsort(hashes[1:]) + 1
        return cls(hashes, np.array(above), np.array(depth), hashes[order], order)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers, 0 for what is not hot."""
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.own[at], 0)


class Block:
    """Texts as one sequence of symbols: the words of each and an end behind them."""

    def __init__(self, batch: pa.RecordBatch):
        words, codes, offsets = words_of(pc.ascii_lower(batch.column("text")))
        self.words, self.held = [*words, END], np.array(batch.column("held").to_pylist(), bool)
        ends = offsets[1:] + np.arange(batch.num_rows)
        self.symbols = np.full(len(codes) + batch.num_rows, len(words), np.int64)
        inner = np.ones(len(self.symbols), bool)
        inner[ends] = False
        self.symbols[inner] = codes
        self.text = np.repeat(np.arange(batch.num_rows), np.diff(offsets) + 1)
        self.place = np.arange(len(self.symbols)) - (offsets[:-1] + np.arange(batch.num_rows))[self.text]
        self.training = ~self.held[self.text]

    @cached_property
    def ids(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))

    def before(self, distance: int) -> np.ndarray:
        """The symbol so far before each; 0 where the text had not begun."""
        out = np.zeros(len(self.symbols), np.uint64)
        out[distance:] = self.ids[self.symbols[: len(self.symbols) - distance]]
        out[self.place == distance - 1] = START
        out[self.place < distance - 1] = 0
        return out

    def contexts(self, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hashes of the contexts of each length in turn, 0 where there is none, and the symbols before."""
        symbols, found, last = [self.before(d) for d in range(1, depth + 1)], [], np.full(len(self.symbols), 1, np.uint64)
        for s in symbols:
            last = np.where(s > 0, _joined(last, s), np.uint64(0))
            found.append(last)
        return np.array(found).reshape(depth, -1), symbols

    def dealt(self, hot: Hot, depth: int, buckets: int, ids: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each symbol: its longest hot context, the hash of the next longer one (0 if there is none), its bucket, and the symbols
        before that go beyond. What has no longer context is spread over buckets by text and symbol."""
        contexts, symbols = self.contexts(depth)
        longest, key, level, open_ = np.zeros(len(self.symbols), np.int64), np.zeros(len(self.symbols), np.uint64), np.full(len(self.symbols), depth), np.ones(len(self.symbols), bool)
        for d in range(depth):
            number = np.where(open_ & (contexts[d] > 0), hot.find(contexts[d]), 0)
            stop = open_ & (number == 0)
            key[stop], level[stop] = contexts[d][stop], d
            longest = np.where(number > 0, number, longest)
            open_ &= number > 0
        spread = mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64) ^ _ODD)[self.text]
        bucket = np.where(key > 0, mix(key), mix(spread ^ self.ids[self.symbols])) % np.uint64(buckets)
        beyond = []
        for k in range(1, depth):  # the k-th symbol that is longer than the key
            at = level + k
            beyond.append(np.where((key > 0) & (at < depth), np.choose(np.minimum(at, depth - 1), symbols), 0))
        return longest, key, bucket.astype(np.int64), beyond


def _hot(batches: Iterator[pa.RecordBatch], share: float, depth: int) -> Iterator[pa.RecordBatch]:
    """Contexts that have a quarter of ``share`` of a block's training words, with their counts; at hash 0 the number of all."""
    for batch in text_slices(batches, "text", 2 * BLOCK_BYTES):
        block = Block(batch)
        many = len(block.words) + 1  # as a code, the last is the start of a text
        some, rows = np.flatnonzero(block.training), [(0, 0, 0, int(block.training.sum()))]
        least, codes, hashes = max(2, share / 4 * len(some)), np.zeros(len(some), np.int64), [1]
        for d in range(1, depth + 1):
            there = block.place[some] >= d - 1
            some, codes = some[there], codes[there]
            last = np.where(block.place[some] == d - 1, many - 1, block.symbols[some - d])
            if d == 1:
                n = np.bincount(last, minlength=many)
                found = np.flatnonzero(n >= least)
                n, fresh = n[found], np.full(many, -1)
                fresh[found] = np.arange(len(found))
                codes = fresh[last]
            else:
                found, codes, n = np.unique(codes * many + last, return_inverse=True, return_counts=True)
                often = np.flatnonzero(n >= least)
                fresh = np.full(len(found), -1)
                fresh[often] = np.arange(len(often))
                found, n, codes = found[often], n[often], fresh[codes]
            before, hashes = hashes, []
            for x, k in zip(found.tolist(), n.tolist(), strict=True):
                symbol = START if x % many == many - 1 else np.uint64(xxhash.xxh64_intdigest(block.words[x % many]))
                hashes.append(int(_joined(np.array([before[x // many if d > 1 else 0]], np.uint64), symbol)[0]))
                rows.append((hashes[-1], before[x // many] if d > 1 else 0, d, k))
            some, codes = some[codes >= 0], codes[codes >= 0]
        columns = [np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1)] + [np.array([r[k] for r in rows], np.int64) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "above", "depth", "n"])


_ITEMS = "bucket int, words binary, size long, distinct int, pairs int, items binary, wants binary, wanted int"


def _items(batches: Iterator[pa.RecordBatch], labels: list[int], depth: int, hot: object) -> Iterator[pa.RecordBatch]:
    """For each block of texts and bucket of words: the words, one a line; for each word its pairs with hot contexts, how often
    training texts have them, and the buckets of subtrees that ask for them."""
    many, buckets = len(hot.value.above), len(labels)
    for batch in text_slices(batches, "text", BLOCK_BYTES):
        block = Block(batch)
        longest, _, ask, _ = block.dealt(hot.value, depth, buckets, batch.column("doc_id").to_pylist())
        bucket = (block.ids % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, codes = np.unique(place[block.symbols] * many + longest, return_inverse=True)
        counts = np.bincount(codes[block.training], minlength=len(pairs))
        wants = np.unique(codes * buckets + ask)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        of_pairs = np.searchsorted(pairs, edges * many)
        of_wants = np.searchsorted(wants, of_pairs * buckets)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            own, asked = slice(of_pairs[b], of_pairs[b + 1]), slice(of_wants[b], of_wants[b + 1])
            text = "\n".join([block.words[x] for x in order[edges[b] : edges[b + 1]].tolist()]).encode("utf-8", "surrogatepass")
            items = _pack((pairs[own] // many - edges[b]).astype("<i4"), (pairs[own] % many).astype("<i4"), counts[own].astype("<i4"))
            wanted = _pack(np.bincount(wants[asked] // buckets - of_pairs[b], minlength=own.stop - own.start).astype("<i4"), _cut(wants[asked] % buckets, 4))
            rows.append({"bucket": labels[b], "words": pa.compress(text, "zstd", asbytes=True), "size": len(text), "distinct": int(edges[b + 1] - edges[b]), "pairs": own.stop - own.start, "items": items, "wants": wanted, "wanted": asked.stop - asked.start})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("size", pa.int64()), ("distinct", pa.int32()), ("pairs", pa.int32()), ("items", pa.binary()), ("wants", pa.binary()), ("wanted", pa.int32())]))


def _every(keys: np.ndarray, n: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (word * contexts + context) and counts of all pairs, those of each context with those of longer ones."""
    many, found, counts = len(hot.above), [keys], [n]
    while len(keys):
        some = keys % many > 0
        keys, n = keys[some] - keys[some] % many + hot.above[keys[some] % many], n[some]
        found.append(keys)
        counts.append(n)
    every, place = np.unique(np.concatenate(found), return_inverse=True)
    return every, np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)


def _reduce(table: pa.Table, hot: Hot, buckets: int) -> pa.Table:
    """One row for a bucket of words: hashes of the distinct words, their pairs with the root and hot contexts and their counts, who
    asks for which pair, and of each context how many words follow it and how many distinct ones."""
    known: dict[bytes, int] = {}
    many, parts, sums, asked = len(hot.above), [], [], []
    for row in table.to_pylist():
        own = pa.decompress(row["words"], row["size"], "zstd", asbytes=True).split(b"\n")
        refs = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
        word, context, n = _unpack(row["items"], *[("<i4", row["pairs"])] * 3)
        keys = refs[word] * many + context
        runs, by = _unpack(row["wants"], ("<i4", row["pairs"]), ("u1", row["wanted"] * 4))
        parts.append(keys)
        sums.append(n)
        asked.append(np.stack((np.repeat(keys, runs), _whole(by, 4).astype(np.int64))))
    every, n = _every(np.concatenate(parts), np.concatenate(sums), hot)
    keys, by = np.concatenate(asked, axis=1)
    wants = np.unique(np.searchsorted(every, keys) * buckets + by)
    seen = n > 0
    of_words = n[every % many == 0]
    row = {
        "bucket": table.column("bucket")[0].as_py(),
        "distinct": len(known),
        "pairs": len(every),
        "wanted": len(wants),
        "data": _pack(np.fromiter((xxhash.xxh64_intdigest(w) for w in known), "<u8", len(known)), every.astype("<i8"), n.astype("<i8"), np.bincount(wants // buckets, minlength=len(every)).astype("<i4"), _cut(wants % buckets, 4)),
        "context_counts": np.bincount(every % many, n, many).astype(np.int64).tolist(),
        "context_words": np.bincount((every % many)[seen], minlength=many).tolist(),
        "once": int((of_words == 1).sum()),
        "twice": int((of_words == 2).sum()),
    }
    return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int32()), ("distinct", pa.int64()), ("pairs", pa.int64()), ("wanted", pa.int64()), ("data", pa.binary()), ("context_counts", pa.list_(pa.int64())), ("context_words", pa.list_(pa.int64())), ("once", pa.int64()), ("twice", pa.int64())]))


def _told(row: dict) -> list[tuple[str, int]]:
    """The columns of a bucket of words: hashes, pairs, counts, how many ask for each pair, and who."""
    return [("<u8", row["distinct"]), ("<i8", row["pairs"]), ("<i8", row["pairs"]), ("<i4", row["pairs"]), ("u1", row["wanted"] * 4)]


_WORDS = "bucket int, distinct long, pairs long, wanted long, data binary, context_counts array<long>, context_words array<long>, once long, twice long"


@dataclass
class Top:
    """The root and the hot contexts: which are kept, with their counts, their distinct words and the weight of their longest kept
    suffix. At the root the weight is that of all unseen words, of which there are ``unseen``."""

    hot: Hot
    kept: np.ndarray
    counts: np.ndarray
    distinct: np.ndarray
    weights: np.ndarray
    unseen: float

    def probabilities(self, every: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
        """Of each pair's word after its context, for contexts down to ``depth``; for longer ones that after their suffix."""
        many, out = len(self.kept), np.zeros(len(every))
        context = every % many
        up = np.searchsorted(every, every - context + self.hot.above[context])
        root = context == 0
        out[root] = np.where(n[root] > 0, n[root], self.weights[0] / self.unseen) / (self.counts[0] + self.weights[0])
        for d in range(1, int(self.hot.depth.max()) + 1):
            at = np.flatnonzero(self.hot.depth[context] == d)
            q, c = out[up[at]], context[at]
            own = (n[at] + self.weights[c] * q) / np.maximum(1, self.counts[c] + self.weights[c])
            out[at] = np.where(self.kept[c] & (d <= depth), own, q)
        return out


def _gain(n: np.ndarray, total: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of n occurrences of a word after a context: the gain in log likelihood over ``q`` if each is judged by the others."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, n * (np.log((n - 1 + weight * q) / (total - 1 + weight)) - np.log(q)), 0.0)


def _gains(batches: Iterator[pa.RecordBatch], top: object, depth: int) -> Iterator[pa.RecordBatch]:
    """What each hot context of ``depth`` would gain over its longest kept suffix, under each weight."""
    tree = top.value
    many = len(tree.kept)
    for batch in batches:
        for row in batch.to_pylist():
            _, every, n, _, _ = _unpack(row["data"], *_told(row))
            q, c = tree.probabilities(every, n, depth - 1), every % many
            at = np.flatnonzero((tree.hot.depth[c] == depth) & (n > 0))
            sums = [np.bincount(c[at], _gain(n[at], tree.counts[c[at]], w * tree.distinct[c[at]], q[at]), many).astype(float) for w in WEIGHTS]
            some = np.unique(c[at])
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in sums)], ["context", *(f"g{k}" for k in range(len(WEIGHTS)))])


_DEALT = "bucket int, block long, positions int, distinct int, texts int, data binary, ids array<long>, held array<boolean>, tokens array<int>"
_DEALT_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("positions", pa.int32()), ("distinct", pa.int32()), ("texts", pa.int32()), ("data", pa.binary())]
    + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int32()))]
)


def _names(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash for a word after a hot context."""
    with np.errstate(over="ignore"):
        return mix(word ^ mix(context * _ODD + np.uint64(7))) >> np.uint64(64 - 8 * WIDE)


def _answers(batches: Iterator[pa.RecordBatch], top: object, labels: list[int]) -> Iterator[pa.RecordBatch]:
    """To each bucket of subtrees the probability of each word that it asks for after its hot context, and the word's count."""
    tree, buckets = top.value, len(labels)
    many = len(tree.kept)
    for batch in batches:
        for row in batch.to_pylist():
            ids, every, n, runs, by = _unpack(row["data"], *_told(row))
            pair, by = np.repeat(np.arange(len(every)), runs), _whole(by, 4).astype(np.int64)
            word, context = every // many, every % many
            names, q, count = _names(tree.hot.hashes[context], ids[word]), tree.probabilities(every, n, 1 << 30), n[np.searchsorted(every, word * many)]
            told = (context[pair] > 0) | (count[pair] != 1)  # most words occur once, which is what silence means
            pair, by = pair[told], by[told]
            order = np.lexsort((names[pair], context[pair] > 0, by))  # those of the root first
            pair, by = pair[order], by[order]
            edges = np.searchsorted(by, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = pair[edges[b] : edges[b + 1]]
                hot = context[own] > 0
                # at the root the count tells the probability
                data = _pack(_cut(names[own], WIDE), _cut(count[own], 5), q[own][hot])
                yield pa.RecordBatch.from_pylist([{"bucket": labels[b], "positions": len(own), "distinct": int(hot.sum()), "data": data}], schema=_DEALT_SCHEMA)


def _positions(batches: Iterator[pa.RecordBatch], labels: list[int], depth: int, hot: object) -> Iterator[pa.RecordBatch]:
    """For some blocks of texts together and each bucket of subtrees the symbols that follow contexts in it: the subtree, the symbols
    before that go beyond, the symbol, and its text. One bucket gets the ids of the texts."""
    partition, number, buckets = TaskContext.get().partitionId(), 0, len(labels)
    parts, ids, held, tokens = [[] for _ in range(3 + depth)], [], [], []

    def whole(column: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(column)
        column.clear()
        return out

    def flushed() -> pa.RecordBatch:
        names, key, bucket, text, *beyond = map(whole, parts)
        block = partition << 33 | number
        further = beyond[0] if beyond else np.zeros(len(key), np.uint32)
        if buckets < 1 << 16:
            order = np.argsort(bucket.astype(np.uint64) << np.uint64(48) | key >> np.uint64(32) << np.uint64(16) | further & np.uint32(0xFFFF)).astype(np.int32)
        else:
            order = np.lexsort((further, key, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint32))
        rows = [{"bucket": labels[block % buckets], "block": block, "ids": ids, "held": held, "tokens": tokens}]
        for b in np.flatnonzero(np.diff(edges)):
            own = order[edges[b] : edges[b + 1]]
            found, codes = np.unique(names[own], return_inverse=True)
            data = _pack(_cut(found, WIDE), _cut(codes, 4), _cut(key[own] >> np.uint64(64 - 8 * WIDE), WIDE), _cut(text[own], 4), *(_cut(x[own], NARROW) for x in beyond))
            rows.append({"bucket": labels[b], "block": block, "positions": len(own), "distinct": len(found), "texts": len(ids), "data": data})
        return pa.RecordBatch.from_pylist(rows, schema=_DEALT_SCHEMA)

    for batch in text_slices(batches, "text", BLOCK_BYTES // 2):
        block, own = Block(batch), batch.column("doc_id").to_pylist()
        longest, key, bucket, beyond = block.dealt(hot.value, depth, buckets, own)
        names = _names(hot.value.hashes[longest], block.ids[block.symbols])
        for column, x in zip(parts, (names, key, bucket.astype(np.uint32), ((block.text + len(ids)) * 2 + block.training).astype(np.uint32), *(x.astype(np.uint32) for x in beyond)), strict=True):
            column.append(x)
        del longest, key, bucket, beyond, names, x
        ids += own
        held += block.held.tolist()
        tokens += np.bincount(block.text, minlength=batch.num_rows).tolist()
        if sum(map(len, parts[0])) >= AT_ONCE:
            yield flushed()
            ids, held, tokens, number = [], [], [], number + 1
    if ids:
        yield flushed()


def walk(key: np.ndarray, beyond: list[np.ndarray], symbol: np.ndarray, q: np.ndarray, training: np.ndarray, least: int, strength: float) -> np.ndarray:
    """The probability of each symbol after its longest kept context: ``key`` names the shortest one that is tried (0: none),
    ``beyond`` what makes it longer, one symbol at a time (0: the text begins), and ``q`` is the probability after the suffix of ``key``."""
    p, some, size = q.copy(), np.flatnonzero(key), int(symbol.max(initial=0)) + 1
    group = key[some]
    for d in range(len(beyond) + 1):
        if d:
            longer = beyond[d - 1][some]
            some, group = some[longer > 0], (context[longer > 0].astype(np.uint64) << np.uint64(32)) | longer[longer > 0].astype(np.uint64)
        _, context = np.unique(group, return_inverse=True)
        counts = np.bincount(context, training[some])
        enough = counts[context] >= least
        some, context = some[enough], context[enough]
        if not len(some):
            break
        pairs = context * size + symbol[some]
        order = np.argsort(pairs)
        pairs, at = pairs[order], some[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        n, c, own = np.add.reduceat(training[at].astype(np.int64), first), pairs[first] // size, p[at[first]]
        distinct, best, weight = np.bincount(c, n > 0, len(counts)), np.full(len(counts), strength), np.zeros(len(counts))
        for w in WEIGHTS:
            gain = np.bincount(c, _gain(n, counts[c], w * distinct[c], own), len(counts))
            weight = np.where(gain > best, w * distinct, weight)
            best = np.maximum(gain, best)
        kept = weight[c] > 0
        own = np.where(kept, (n + weight[c] * own) / np.maximum(1, counts[c] + weight[c]), own)
        p[at] = np.repeat(own, np.diff(np.append(first, len(pairs))))
    return p


def _subtrees(table: pa.Table, beyond_most: int, root: tuple[float, float], least: int, strength: float) -> pa.Table:
    """The sums of a bucket's symbols for each text: known ones, logarithms of counts, and logarithms of probabilities. ``root`` has the
    probability of an unseen word and the sum that counts are divided by."""
    told, rows, out = [], [], []
    for row in table.to_pylist():
        n = row["positions"]
        if row["block"] is None:
            found, count, hot = _unpack(row["data"], ("u1", n * WIDE), ("u1", n * 5), ("<f8", row["distinct"]))
            count = _whole(count, 5).astype(np.int64)
            own = np.where(count > 0, count / root[1], root[0])
            own[n - row["distinct"] :] = hot
            told.append((_whole(found, WIDE), own, count))
        elif row["ids"] is not None:
            out.append({"block": row["block"], "ids": row["ids"], "held": row["held"], "tokens": row["tokens"]})
        else:
            rows.append(row)
    del table
    parts, places, start = [], [], 0
    for row in rows:
        n = row["positions"]
        found, codes, key, texts, *beyond = _unpack(row.pop("data"), ("u1", row["distinct"] * WIDE), ("u1", n * 4), ("u1", n * WIDE), ("u1", n * 4), *[("u1", n * NARROW)] * beyond_most)
        texts = _whole(texts, 4)
        places.append(_whole(found, WIDE))
        parts.append((_whole(codes, 4).astype(np.int32), _whole(key, WIDE), (texts >> np.uint64(1)).astype(np.int64) + start, (texts & np.uint64(1)).astype(bool), *(_whole(x, NARROW).astype(np.uint32) for x in beyond)))
        start += row["texts"]
    if parts:
        names = np.unique(np.concatenate(places))
        q, counts = np.full(len(names), 1 / root[1]), np.ones(len(names), np.int64)
        for found, own, count in told:
            at = np.searchsorted(names, found)
            q[at], counts[at] = own, count
        symbol = np.concatenate([np.searchsorted(names, found).astype(np.int32)[part[0]] for found, part in zip(places, parts, strict=True)])
        key, text, training, *beyond = (np.concatenate(x) for x in list(zip(*parts, strict=True))[1:])
        del parts, places, told, names
        p = q[symbol]
        many = -(-len(p) // SCORED)
        for k in range(many):  # subtrees fall to either, whole
            some = np.flatnonzero(key % np.uint64(many) == k)
            p[some] = walk(key[some], [x[some] for x in beyond], symbol[some].astype(np.int64), p[some], training[some], least, strength)
        del key, beyond, training
        texts, text = np.unique(text, return_inverse=True)
        known = np.bincount(text, counts[symbol] > 0)
        base = np.round(np.bincount(text, np.round(np.log10(counts + 1) / UNIT)[symbol])).astype("<i8")
        model = np.bincount(text, np.log10(p))
        begin = 0
        for row in rows:
            own = slice(*np.searchsorted(texts, (begin, begin + row["texts"])))
            out.append({"block": row["block"], "n": own.stop - own.start, "data": _pack(_cut(texts[own] - begin, 4), _cut(known[own].astype(np.int64), 4), _cut(base[own], 7), model[own].astype("<f4"))})
            begin += row["texts"]
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int32()))]))


def _texts(table: pa.Table) -> pa.Table:
    """Adds up what the buckets say of the texts of a block."""
    rows = table.to_pylist()
    texts = next(r for r in rows if r["ids"] is not None)
    known, base, model = np.zeros((3, len(texts["ids"])))
    for row in rows:
        if row["ids"] is None:
            n = row["n"]
            own, a, b, c = _unpack(row["data"], ("u1", n * 4), ("u1", n * 4), ("u1", n * 7), ("<f4", n))
            own = _whole(own, 4).astype(np.int64)
            known[own] += _whole(a, 4)
            base[own] += _whole(b, 7)
            model[own] += c
    return pa.table({"doc_id": pa.array(texts["ids"], pa.int64()), "held_out": pa.array(texts["held"], pa.bool_()), "tokens": pa.array(texts["tokens"], pa.int64()), "known": pa.array(known.astype(np.int64)), "base": pa.array(base * UNIT), "model": pa.array(model)})


def _labels(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket, such that hashing deals the buckets evenly to partitions: by chance some would get several."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("id").cast("int")
    dealt: list[list[int]] = [[] for _ in range(parts)]
    for row in spark.range(40 * (buckets + parts)).select(number.alias("b"), F.pmod(F.hash(number), F.lit(parts)).alias("p")).sort("b").collect():
        dealt[row["p"]].append(row["b"])
    spare = iter(range(1 << 30, 1 << 31))
    return [own[k // parts] if k // parts < len(own := dealt[k % parts]) else next(spare) for k in range(buckets)]


def score(docs: DataFrame, held_out: Callable[[Column], Column], *, depth: int = DEPTH, least: int = LEAST, strength: float = STRENGTH, buckets: int | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and score every row.

    Columns: ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (those that training texts have),
    ``train_tokens``, ``base_score`` (log10 under add-one word counts) and ``score`` (log10 under the tree). A-Z are lower-cased;
    words are runs without the space and U+0009 to U+000D. Null and empty texts are one end. A null id counts as training.
    Repeated rows count each; other columns are ignored; an empty table gives no rows; without training texts all words are unseen.

    Contexts of up to ``depth`` words are tried if training texts have them ``least`` times (2 at least) and kept if they gain more than
    ``strength`` nats. The word that a subtree is dealt by and the words scored are told apart by 56-bit hashes, the words further
    back, within a subtree, by 24-bit ones. ``buckets`` follows the number of shuffle partitions, and with it what counts as hot, so
    that a bucket stays small as the input grows; the hot contexts, which are all that tasks are sent, are 3 * buckets at most for each length. Of a bucket's arrays some 60 bytes a symbol are held, and what
    scoring takes for ``SCORED`` symbols or the largest subtree.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(2, least)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share, labels = 1 / (2 * buckets), _labels(spark, buckets)
    often = source.mapInArrow(partial(_hot, share=share, depth=depth), "hash long, above long, depth long, n long").groupBy("hash").agg(F.first("above").alias("above"), F.first("depth").alias("depth"), F.sum("n").alias("n"))
    often = materialize(often, "pst-often")
    training = often.filter("hash = 0").agg(F.sum("n")).first()[0] or 0
    rows = often.filter(F.col("hash") != 0).filter(F.col("n") >= F.lit(share * training * 3 / 4)).select("hash", "above", "depth").collect()
    discard(often)
    contexts = Hot.build([(r["hash"] % (1 << 64), r["above"] % (1 << 64), r["depth"]) for r in rows])
    hot = spark.sparkContext.broadcast(contexts)
    items = source.mapInArrow(partial(_items, labels=labels, depth=depth, hot=hot), _ITEMS)
    words = materialize(items.groupBy("bucket").applyInArrow(lambda table: _reduce(table, hot.value, buckets), _WORDS), "pst-words")
    drop_shuffles(spark)

    sums = words.select(F.posexplode(F.arrays_zip("context_counts", "context_words")).alias("context", "x")).groupBy("context").agg(F.sum("x.context_counts").alias("n"), F.sum("x.context_words").alias("words")).toArrow()
    figures = np.zeros((2, len(contexts.above)))
    figures[:, sums.column("context").to_numpy()] = sums.column("n").to_numpy(), sums.column("words").to_numpy()
    once, twice = (max(1, x or 0) for x in words.agg(F.sum("once"), F.sum("twice")).first())
    tokens, distinct = int(figures[0, 0]), int(figures[1, 0])
    top = Top(contexts, np.zeros(len(contexts.above), bool), figures[0], figures[1], np.zeros(len(contexts.above)), max(1.0, once**2 / (2 * twice)))
    top.weights[0] = once
    names = [f"g{k}" for k in range(len(WEIGHTS))]
    for d in range(1, int(contexts.depth.max()) + 1):
        told = words.mapInArrow(partial(_gains, top=spark.sparkContext.broadcast(top), depth=d), ", ".join(["context long", *(f"{g} double" for g in names)]))
        table = told.groupBy("context").agg(*(F.sum(g).alias(g) for g in names)).toArrow()
        gains = np.zeros((len(contexts.above), len(WEIGHTS)))
        gains[table.column("context").to_numpy()] = np.column_stack([table.column(g).to_numpy() for g in names])
        fresh = contexts.depth == d
        top = replace(top, kept=np.where(fresh, (gains.max(1) > strength) & (top.counts >= least), top.kept), weights=np.where(fresh, figures[1] * np.array(WEIGHTS)[gains.argmax(1)], top.weights))

    answers = words.mapInArrow(partial(_answers, top=spark.sparkContext.broadcast(top), labels=labels), _DEALT)
    positions = source.mapInArrow(partial(_positions, labels=labels, depth=depth, hot=hot), _DEALT)
    root = (float(once / top.unseen / (tokens + once)), float(tokens + once))
    sent = "block long, n int, data binary, ids array<long>, held array<boolean>, tokens array<int>"
    subtrees = positions.unionByName(answers).groupBy("bucket").applyInArrow(lambda table: _subtrees(table, depth - 1, root, least, strength), sent)
    subtrees = materialize(subtrees, "pst-sums")
    discard(words)
    drop_shuffles(spark)
    sums = subtrees.groupBy("block").applyInArrow(_texts, "doc_id long, held_out boolean, tokens long, known long, base double, model double")
    unit = float(np.log10(tokens + distinct + 1))
    return sums.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("tokens") * unit).alias("base_score"), F.col("model").alias("score")
    )
