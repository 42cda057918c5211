"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature after the other, so each feature ends up with one lookup table over its
bins; pairs of features that explain most of what remains get tables over a coarse grid. A score is a sum of looked-up
bins through the logistic function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import labelled_sample, text_slices

FEATURES = ("log_words", "symbols", "bars", "exclamations", "upper", "digits", "word_length", "distinct_words", "distinct_pairs", "repeated_lines", "same_neighbours", "line_words", "stops")

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def features(text: str | None) -> list[float]:
    """Scale-free measurements of a whole text; an empty or null one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    has = lambda characters: len(raw) - len(raw.translate(None, characters))
    solid = max(1, len(raw) - has(b" \t\n\x0b\x0c\r"))
    upper, lower = has(_UPPER), has(_LOWER)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        has(b"#*$%&<>") / solid,
        has(b"|") / n,
        has(b"!") / n,
        upper / max(1, upper + lower),
        has(b"0123456789") / solid,
        len("".join(words)) / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        float(np.log1p(n / max(1, len(lines)))),
        has(b".,;:?") / n,
    ]


@dataclass
class Additive:
    """``edges[j]`` are the inner borders of feature j's bins; ``tables[j]`` has a value per bin; ``pairs`` holds
    (i, j, edges of i, edges of j, table)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for i, j, ei, ej, table in self.pairs:
            total += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a sequence of bins with gradient and curvature sums."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The step of a tree of three leaves over the bins."""
    cuts = [0, _split(g, h, ridge)[1] or len(g), len(g)]
    found = [(*_split(g[a:b], h[a:b], ridge), a) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
    if found and (best := max(found))[0] > 0:
        cuts = sorted({*cuts, best[2] + best[1]})
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The step of a tree that cuts one axis of a grid and then each side along the other axis."""

    def along(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        cut = _split(g.sum(1), h.sum(1), ridge)[1] or len(g)
        step, gain = np.zeros(g.shape), 0.0
        for part in (slice(0, cut), slice(cut, len(g))):
            gs, hs = g[part].sum(0), h[part].sum(0)
            second = _split(gs, hs, ridge)[1]
            for a, b in ((0, second), (second, len(gs))):
                if b > a:
                    step[part, a:b] = gs[a:b].sum() / (hs[a:b].sum() + ridge)
                    gain += gs[a:b].sum() ** 2 / (hs[a:b].sum() + ridge)
        return gain, step

    (gain, step), (other_gain, other) = along(g, h), along(g.T, h.T)
    return step if gain >= other_gain else other.T


def train(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pair_bins: int = 8, pairs: int = 4, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 4.0) -> Additive:
    """Cyclic boosting of ``y`` (0 or 1) on ``x``. Without rows the model says one half; with one class, that class' smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_quantile_edges(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def sums(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(place, y - p, size), np.bincount(place, p * (1 - p), size)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                step = rate * _tree(*sums(at[j], len(table)), ridge)
                table += step
                total += step[at[j]]
    coarse = [_quantile_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            size = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            if min(size) > 1:
                g, h = sums(cell[i] * size[1] + cell[j], size[0] * size[1])
                ranked.append((float((g**2 / (h + ridge)).sum()), i, j, size))
    for _, i, j, size in sorted(ranked, reverse=True)[:pairs]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros(size)))
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            place = cell[i] * table.shape[1] + cell[j]
            g, h = sums(place, table.size)
            step = rate * _grid_tree(g.reshape(table.shape), h.reshape(table.shape), ridge)
            table += step
            total += step.ravel()[place]
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], *, label: str = "quality", rows: int = 20_000) -> Additive:
    """Train on at most ``rows`` labelled documents that are not held out; the same ones whenever the labels are the same."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, label, held_out, rows)
    measured = sample.mapInArrow(_measure, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.first("label").alias("label"), F.first("x").alias("x"))
    found = sorted((r["doc_id"], r["label"], r["x"]) for r in measured.collect())
    x = np.array([r[2] for r in found]).reshape(-1, len(FEATURES))
    return train(x, np.array([r[1] for r in found], float))


def _apply(batches: Iterator[pa.RecordBatch], model: Additive) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(model.score(x))], [*batch.schema.names, "score"])


def classify(docs: DataFrame, model: Additive, *, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row of ``docs`` with the model's ``score``.

    Only the text is read for the score. Null and empty texts get the score of a text without words; repeated rows are
    scored each by itself; an empty table gives no rows. One pass, no shuffle.
    """
    kept = docs.select(*dict.fromkeys((*columns, "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double"
    return kept.mapInArrow(partial(_apply, model=model), schema).select(*columns, "score")
