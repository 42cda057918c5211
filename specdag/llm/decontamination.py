"""Benchmark decontamination by pigeonhole edit matching.

An item that may be off by k edits is cut into k + 1 pieces: wherever it occurs, one piece occurs exactly. An automaton
finds all pieces of all items in one walk over a text; each hit says where the item would lie, and Myers' bit-parallel
edit distance over that window decides. Run backwards from where the occurrence ends, it tells where that begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import discard, materialize, text_slices

_BETWEEN = re.compile(r"[\W_]+")
#: Fixed value: bytes of the items that one automaton holds; a block has twice as many at most, but for a single item.
BLOCK = 32 << 20


def normal(text: str | None) -> str:
    """Lower-case words with one space between, before and behind: case, punctuation and line breaks do not count."""
    return f" {_BETWEEN.sub(' ', (text or '').lower()).strip()} "


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """(begin, end) of ``budget + 1`` pieces of nearly equal length."""
    edges = [length * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(edges, edges[1:], strict=False))


def myers(pattern: str, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any part of ``text`` (``anchored``: to any beginning), with the first such
    part's end, if within ``budget``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, step = (1 << m) - 1, 1 << m - 1, int(anchored)
    up, down, distance, best = full, 0, m, (m, 0) if m <= budget else None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right, left = (right << 1 | step) & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, end)
    return best


@dataclass
class Items:
    """Normalised items with their budgets, and the automaton of their pieces."""

    ids: list[int]
    texts: list[str]
    budgets: list[int]
    automaton: object

    @classmethod
    def of(cls, rows: list[tuple[int, str]], error_rate: float) -> Items:
        ids, texts, budgets, at = [], [], [], {}
        for item, raw in rows:
            text = normal(raw)
            if not text.strip():
                continue
            budget = int(len(text) * error_rate)
            for begin, end in pieces(len(text), budget):
                at.setdefault(text[begin:end], []).append((len(ids), begin))
            ids.append(item), texts.append(text), budgets.append(budget)
        automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            automaton.add_word(piece, (len(piece), where))
        if at:
            automaton.make_automaton()
        return cls(ids, texts, budgets, automaton if at else None)

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, begin, end) of the first occurrence of each item in the normalised text."""
        if self.automaton is None or not raw:
            return []
        text = normal(raw)
        found: dict[int, tuple[int, int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(text):
            for k, begin in where:
                if k in found:
                    continue
                start, budget, length = last + 1 - size - begin, self.budgets[k], len(self.texts[k])
                if text.startswith(self.texts[k], max(0, start)) and start >= 0:
                    found[k] = (self.ids[k], 0, start, start + length)
                elif budget and (k, start) not in tried:
                    tried.add((k, start))
                    low = max(0, start - budget)
                    if hit := myers(self.texts[k], text[low : start + length + budget], budget):
                        past = low + hit[1]
                        back = myers(self.texts[k][::-1], text[max(0, past - length - budget) : past][::-1], hit[0], anchored=True)
                        found[k] = (self.ids[k], hit[0], past - back[1], past)
        return list(found.values())


def _find(batches: Iterator[pa.RecordBatch], rows: object, error_rate: float) -> Iterator[pa.RecordBatch]:
    items = Items.of(rows.value, error_rate)
    for batch in text_slices(batches, "text"):
        at, hits = [], []
        for i, text in enumerate(batch.column("text")):
            for hit in items.matches(text.as_py()):
                at.append(i)
                hits.append(hit)
        columns = [pa.array([h[k] for h in hits], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", "item_id", "distance", "start", "end"])


def _clean(batches: Iterator[pa.RecordBatch], rows: object, error_rate: float) -> Iterator[pa.RecordBatch]:
    items = Items.of(rows.value, error_rate)
    for batch in text_slices(batches, "text"):
        yield batch.filter(pa.array([not items.matches(t.as_py()) for t in batch.column("text")], pa.bool_()))


def _blocks(benchmark: DataFrame, block: int) -> tuple[int, Iterator]:
    """How many blocks the items fall into, by hash, and one after the other a broadcast list of (item_id, text) of each: so many that
    none has over twice ``block`` bytes, but for a single item."""
    spark = benchmark.sparkSession
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    number = lambda many: F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
    many = max(1, -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    while known.groupBy(number(many).alias("b")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("item_id", "text").alias("n")).filter((F.col("bytes") > 2 * block) & (F.col("n") > 1)).limit(1).count():
        many *= 2
    return many, (spark.sparkContext.broadcast([tuple(r) for r in known.filter(number(many) == b).sort("item_id", "text").collect()]) for b in range(many))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.05, block: int = BLOCK) -> DataFrame:
    """A row for each document and item that it holds: ``doc_id``, ``item_id``, ``distance`` (edits), ``start`` and ``end`` of its
    first occurrence in the normalised text.

    Items may be off by ``error_rate`` of their normalised length, rounded down; so short ones must occur as they are, between
    word borders. Null or empty texts and items match nothing; null ids stay null; repeated rows and items are reported each;
    other columns are ignored; an empty table gives no rows. No shuffle; the items come in blocks of about ``block`` bytes, which
    are broadcast one at a time: if there are more than one, each scans the documents and its matches are written before the next.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    many, blocks = _blocks(benchmark, block)
    out = None
    for rows in blocks:
        found = source.mapInArrow(partial(_find, rows=rows, error_rate=error_rate), "doc_id long, item_id long, distance long, start long, end long")
        if many > 1:
            found = materialize(found, "leaks")
            rows.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.05, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item in the sense of ``find_leaks``: null and empty texts stay, repeated
    rows stay or go together, an empty table gives no rows and an empty benchmark removes none."""
    many, blocks = _blocks(benchmark, block)
    for rows in blocks:
        last, docs = docs, docs.mapInArrow(partial(_clean, rows=rows, error_rate=error_rate), docs.schema)
        if many > 1:
            docs = materialize(docs, "unleaked")
            rows.destroy()
            if hasattr(last, "_specdag_path") and "specdag-unleaked-" in last._specdag_path:
                discard(last)
    return docs
