"""Language identification of mixed-language text.

The script of a word narrows the languages it may be in; character n-grams score it under each of those; Viterbi with a
penalty for switching then labels the words, so that a text falls into spans of one language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import text_slices, words_of
from specdag.llm.grams import word_grams

#: First and last code points of scripts' main ranges; letters outside are of script 0.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
_RANGES = sorted((a, b, k) for k, ranges in enumerate(SCRIPTS.values(), 1) for a, b in ranges)
_STARTS = np.array([a for a, _, _ in _RANGES])
_STOPS = np.array([b for _, b, _ in _RANGES])
_SCRIPT = np.array([k for _, _, k in _RANGES])
_LETTER = re.compile(r"[^\W\d_]")

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 17
#: Nats that a switch costs, the scale on overlapping n-grams, the cost of a language whose script differs.
SWITCH, SCALE, FOREIGN = 12.0, 0.5, 25.0
#: Fixed value: the share of a language's letters from which a script counts as its own.
SHARE = 0.005


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # float32 [BUCKETS, languages]: log probability of an n-gram, less its mean over the languages
    scripts: np.ndarray  # bool [scripts + 1, languages]: may a word of this script be in this language?


def _plain(words: list[str]) -> list[str]:
    return [w.lower().strip("\"'.,;:!?()[]{}<>|*#$%&«»¡¿…-_") for w in words]


def word_scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter: 0 for a script without a range here, -1 without a letter."""
    firsts = [m[0] if (m := _LETTER.search(w)) else "" for w in words]
    points = np.fromiter((ord(c) if c else -1 for c in firsts), np.int64, len(words))
    at = np.searchsorted(_STARTS, points, side="right") - 1
    script = np.where((at >= 0) & (points <= _STOPS[at]), _SCRIPT[at], 0)
    return np.where(points < 0, -1, script)


def word_scores(words: list[str], model: LanguageModel) -> np.ndarray:
    """Scores in nats [words, languages]; a word without letters says nothing."""
    out = np.zeros((len(words), len(model.languages)))
    if not words:
        return out
    owner, h = word_grams(_plain(words), SIZES)
    rows = model.table[(h % np.uint64(BUCKETS)).astype(np.int64)]
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(owner, rows[:, k], len(words)) * SCALE
    script = word_scripts(words)
    allowed = model.scripts[np.maximum(script, 0)]
    out -= FOREIGN * (~allowed & allowed.any(1)[:, None])
    out[script < 0] = 0
    return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word of texts that lie one after the other; all texts advance together, longest first."""
    n, k = scores.shape
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    first, longest = offsets[:-1][order], int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")  # texts with a word at each step
    stay, jump = np.zeros((n, k), bool), np.zeros(n, np.int16)
    value = np.zeros((len(lengths), k))
    for t in range(longest):
        m = alive[t]
        at, v = first[:m] + t, value[:m]
        if t:
            top = v.argmax(1)
            most = v[np.arange(m), top] - switch
            keep = v >= most[:, None]
            stay[at], jump[at] = keep, top
            v = np.where(keep, v, most[:, None])
        v = v + scores[at]
        value[:m] = v - v.max(1, keepdims=True)
    path = np.zeros(n, np.int16)
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at, s = first[:m] + t, state[:m]
        path[at] = s
        if t:
            state[:m] = np.where(stay[at, s], s, jump[at])
    return path


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        words, codes, offsets = words_of(batch.column("text"))
        names, place = np.unique(np.array(batch.column("lang").to_pylist()), return_inverse=True)
        which = np.repeat(place.ravel(), np.diff(offsets))
        for k, name in enumerate(names):
            n = np.bincount(codes[which == k], minlength=len(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some), pa.string()), pa.array([words[i] for i in some], pa.string()), pa.array(n[some])], ["lang", "word", "n"])


def train(counted: list[tuple[str, str, int]]) -> LanguageModel:
    """From the number of times that each language has each word."""
    languages = sorted({lang for lang, _, _ in counted})
    number = {lang: k for k, lang in enumerate(languages)}
    counts, letters = np.full((BUCKETS, len(languages)), 0.2), np.zeros((len(SCRIPTS) + 1, len(languages)))
    for lang in languages:
        own = [(w, n) for x, w, n in counted if x == lang and _LETTER.search(w)]
        words, n = [w for w, _ in own], np.array([n for _, n in own], float)
        for at in range(0, len(words), 50_000):
            part, weight = words[at : at + 50_000], np.sqrt(n[at : at + 50_000])  # damped: frequent words say less per occurrence
            owner, h = word_grams(_plain(part), SIZES)
            counts[:, number[lang]] += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), weight[owner], BUCKETS)
        letters[:, number[lang]] = np.bincount(np.maximum(word_scripts(words), 0), n, len(letters)) if words else 0
    table = np.log(counts / counts.sum(0))
    return LanguageModel(languages, (table - table.mean(1, keepdims=True)).astype(np.float32) if languages else table, letters > SHARE * letters.sum(0))


def fit(docs: DataFrame, held_out: Callable[[Column], Column], *, quota: int = 1000) -> LanguageModel:
    """Learn from about ``quota`` documents of each language that are not held out, those of least hash: the share of a
    language's documents that is taken follows from their number."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return train([])
    limits = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, quota / n)))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(limits, F.col("lang")) * 1_000_003)
    counted = chosen.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return train(sorted(zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)))


def _spans(path: np.ndarray, languages: list[str]) -> list[dict]:
    edges = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
    return [{"lang": languages[path[a]], "first": int(a), "past": int(b)} for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _label(batches: Iterator[pa.RecordBatch], model: LanguageModel, keep_spans: bool) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", 4 << 20):
        words, codes, offsets = words_of(batch.column("text"))
        k, lengths = max(1, len(model.languages)), np.diff(offsets)
        scores = word_scores(words, model)
        size = np.fromiter((len(w) if _LETTER.search(w) else 0 for w in words), np.int64, len(words))[codes] if words else np.zeros(0)
        path = viterbi(scores[codes], offsets) if len(model.languages) else np.zeros(len(codes), np.int16)
        share = np.bincount(np.repeat(np.arange(batch.num_rows), lengths) * k + path, size, batch.num_rows * k).reshape(-1, k)
        total = share.sum(1)
        sure = total > 0 if model.languages else np.zeros(batch.num_rows, bool)
        best = share.argmax(1)
        names = [model.languages[b] if s else "und" for b, s in zip(best, sure, strict=True)]
        score = np.where(sure, share[np.arange(len(best)), best] / np.maximum(total, 1), 0.0)
        columns, fields = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
        if keep_spans:
            spans = [_spans(path[a:b], model.languages) if s else [] for a, b, s in zip(offsets, offsets[1:], sure, strict=False)]
            columns.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("past", pa.int32())]))))
            fields.append("spans")
        yield pa.RecordBatch.from_arrays(columns, fields)


def identify(docs: DataFrame, model: LanguageModel, *, keep_spans: bool = True) -> DataFrame:
    """``doc_id``, ``lang_pred`` (the language of most letters' words), ``score`` (its share of them) and ``spans``: the
    language of each stretch of words, by word numbers.

    Null text, or text without a letter, gives ``und``, 0 and no spans, as does a model without languages. Ties go to
    the language first by name. Whole texts are labelled; repeated rows each by itself; other columns are ignored; an
    empty table gives no rows. One pass, no shuffle.
    """
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,first:int,past:int>>" * keep_spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_label, model=model, keep_spans=keep_spans), schema)
