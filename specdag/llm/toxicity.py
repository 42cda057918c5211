"""Toxicity with noisy-channel deobfuscation.

Words that look disguised (digits or signs among letters, letters spaced out, letters repeated) become lattices of what
each character may stand for; Viterbi finds the likeliest reading under a character trigram model. The text so
restored is scored by evidence of character n-grams, learned from labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import discard, drop_shuffles, labelled, materialize, text_slices, words_of
from specdag.llm.grams import word_grams

#: Letters that a disguising character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "x", "*": "aeiou",
}
#: Characters that may be nothing but spacing within a word.
SPACING = " .-_*~'`,:;/\\|+="
#: Costs in nats of leaving a disguise unread, of dropping spacing, and of a repeated letter read once.
AS_IS, DROPPED, REPEATED = 6.0, 0.5, 0.3
SIZES = (3, 4, 5, 6)
PHRASE = 48  # letters of a reading; a longer one is a phrase, of which overlapping pieces count each
UNLIKELY = 4.0  # nats of a doubled letter that may be a disguise

_EDGE = ".,;:!?\"'()[]{}<>|*#$%&@+=~`_-¡¿“”‘’«»…"
_DISGUISED = re.compile(r"[^\W\d_].*[0-9@$!|+(<{\[€£¡#%*.\-_~'`/\\].*|[0-9@$!|+(<{\[€£¡#%*].*[^\W\d_].*|.*([^\W\d_])\1\1.*", re.DOTALL)
_DOUBLED = re.compile(r"([^\W\d_])\1")
_MARK = "^"


@dataclass
class CharacterModel:
    """Trigram costs in nats with interpolated shorter contexts; unseen letters get the smoothing share."""

    costs: dict[str, float]
    floor: float

    @classmethod
    def of(cls, words: dict[str, float]) -> CharacterModel:
        trigrams: Counter[str] = Counter()
        for word, n in words.items():
            marked = _MARK * 2 + word + _MARK
            for i in range(2, len(marked)):
                trigrams[marked[i - 2 : i + 1]] += n
        return cls.of_trigrams(trigrams)

    @classmethod
    def of_trigrams(cls, trigrams: dict[str, float]) -> CharacterModel:
        """From the trigrams of marked words; each letter ends one, so shorter contexts are sums of them."""
        grams: Counter[str] = Counter()
        for trigram, n in trigrams.items():
            for k in (0, 1, 2):
                grams[trigram[2 - k :]] += n
                grams[trigram[2 - k : 2] + "\x00"] += n  # the context's total
        alphabet = max(2, sum(len(g) == 1 and g != "\x00" for g in grams))
        costs: dict[str, float] = {}
        total = grams["\x00"] or 1.0
        for g, n in sorted(grams.items(), key=lambda x: len(x[0])):
            if g.endswith("\x00"):
                continue
            if len(g) == 1:
                p = (n + 0.5) / (total + 0.5 * alphabet)
            else:
                p = (n + 2 * np.exp(-costs[g[1:]])) / (grams[g[:-1] + "\x00"] + 2)
            costs[g] = float(-np.log(p))
        return cls(costs, float(np.log(2 * total + 2 * alphabet)))

    @property
    def most(self) -> float:
        """No letter costs more, whatever stands before it."""
        return self.floor + 1.5

    def cost(self, context: str, letter: str) -> float:
        """Of ``letter`` after the two letters of ``context``."""
        get = self.costs.get
        found = get(context + letter)
        if found is None:
            found = get(context[1:] + letter)
            found = (get(letter, self.floor) if found is None else found) + (1.5 if found is None else 0.7)
        return found


def _readings_of(c: str) -> list[tuple[str, float]]:
    """The letters that a character may be read as, with their costs."""
    return [(c, 0.0 if c.isalpha() else AS_IS)] + [(x, 0.2) for x in STANDS_FOR.get(c, "")]


def decode(seen: str, model: CharacterModel) -> str:
    """The likeliest reading of a disguised word of any length: Viterbi over the letters each character may stand for.

    A state is the last two letters read. A character is read as one of its letters, dropped as spacing, or dropped as
    a repeat of the letter before it. States are left out only where they cannot win: whatever may follow, the best state can
    go the same way, and the two letters of its own that it goes by cost it at most ``model.most`` each.
    """
    lattice: dict[str, list[tuple[str, float]]] = {}
    states: dict[str, tuple[float, tuple | None]] = {_MARK * 2: (0.0, None)}
    get, floor, before, slack = model.costs.get, model.floor, "", 2 * model.most
    for c in seen:
        after: dict[str, tuple[float, tuple | None]] = {}
        readings = lattice.get(c)
        if readings is None:
            readings = lattice[c] = _readings_of(c)
        spacing = c in SPACING
        for state, (cost, read) in states.items():
            last = state[1]
            for letter, extra in readings:
                found = get(state + letter)
                if found is None:
                    found = get(last + letter)
                    found = get(letter, floor) + 1.5 if found is None else found + 0.7
                found += cost + extra
                to = last + letter
                old = after.get(to)
                if old is None or found < old[0]:
                    after[to] = (found, (letter, read))
                if letter == before or letter == last:
                    old, found = after.get(state), cost + extra + REPEATED
                    if old is None or found < old[0]:
                        after[state] = (found, read)
            if spacing:
                old, found = after.get(state), cost + DROPPED
                if old is None or found < old[0]:
                    after[state] = (found, read)
        most = min(x[0] for x in after.values()) + slack
        states = {s: x for s, x in after.items() if x[0] <= most}
        before = c
    read, out = min(((cost + model.cost(state, _MARK), state, read) for state, (cost, read) in states.items()), key=lambda x: x[:2])[2], []
    while read:
        out.append(read[0])
        read = read[1]
    return "".join(reversed(out))


@dataclass
class ToxicModel:
    hashes: np.ndarray  # sorted n-gram hashes with evidence
    weights: np.ndarray
    letters: CharacterModel
    fit: np.ndarray  # intercept and a weight for each measurement of ``best_words``


def _plain(words: list[str]) -> list[str]:
    return [w.lower().strip(_EDGE) for w in words]


def evidence(words: list[str], model: ToxicModel) -> np.ndarray:
    """The strongest n-gram weight of each word, 0 without any."""
    out = np.zeros(len(words))
    if len(words) and len(model.hashes):
        owner, h = word_grams(words, SIZES)
        at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
        hit = model.hashes[at] == h
        np.maximum.at(out, owner[hit], model.weights[at[hit]])
    return out


def _pieces(reading: str) -> list[str]:
    """Overlapping pieces of a long reading; no piece lies within the one before."""
    return [reading[i : i + PHRASE] for i in range(0, max(1, len(reading) - PHRASE // 2), PHRASE // 2)]


def _odd_doubles(core: str, letters: CharacterModel) -> bool:
    """Whether a letter is doubled where the character model does not expect it."""
    marked = _MARK * 2 + core
    return any(letters.cost(marked[m.start() + 1 : m.start() + 3], m.group(1)) > UNLIKELY for m in _DOUBLED.finditer(core))


def _readings(words: list[str], memo: dict[str, str], letters: CharacterModel) -> list[list[str]]:
    """Of each word what it may stand for: nothing, a reading, or those of its pieces if it is long."""
    out = []
    for w in words:
        core = w.lower().strip("\"'()[]{}<>,;:.?“”«»…")
        if len(core) > 2 and core[-1] == core[-2] == core[-3] and not core[-1].isalnum():
            core = core.rstrip(core[-1])  # a run of signs behind a word is an ornament
        core = core.rstrip("!")
        if len(core) < 3 or not (_DISGUISED.fullmatch(core) or _odd_doubles(core, letters)):
            out.append([])
            continue
        if core not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[core] = decode(core, letters)
        out.append([r for r in _pieces(memo[core]) if r])
    return out


def _spaced(codes: np.ndarray, offsets: np.ndarray, single: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first, past) of runs of three or more one-character words."""
    on = np.concatenate(([0], single[codes].astype(np.int8), [0])) if len(codes) else np.zeros(2, np.int8)
    edges = np.diff(on)
    runs = []
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        text = int(np.searchsorted(offsets, a, side="right")) - 1
        while a < b:  # a run ends with its text
            stop = min(b, int(offsets[text + 1]))
            if stop - a >= 3:
                runs.append((text, int(a), stop))
            a, text = stop, text + 1
    return runs


TOP = 5


def best_words(texts: pa.Array, model: ToxicModel, memo: dict[str, str]) -> np.ndarray:
    """For each text the evidence of its ``TOP`` most toxic distinct words, restored where they were disguised, the logarithm
    of the sum of all others', and that of its words: a long text meets some evidence by chance."""
    words, codes, offsets = words_of(texts)
    out = np.zeros((len(texts), TOP + 2))
    out[:, TOP + 1] = np.log1p(np.diff(offsets))
    if not words:
        return out
    strength = np.maximum(evidence(_plain(words), model), 0)
    read = _readings(words, memo, model.letters)
    flat = [(i, r) for i, of in enumerate(read) for r in of]
    pieces: dict[int, dict[str, float]] = {}
    for (i, r), s in zip(flat, evidence([r for _, r in flat], model).tolist(), strict=True):
        if len(read[i]) == 1:
            strength[i] = max(strength[i], s)
        elif s > 0:  # a phrase: each piece counts
            strength[i] = max(strength[i], s)
            pieces.setdefault(i, {})[r] = s
    found: dict[int, dict[str, float]] = {}
    for at in np.flatnonzero(strength[codes] > 0):
        code = int(codes[at])
        own = pieces.get(code) or {read[code][0] if len(read[code]) == 1 else words[code].lower().strip(_EDGE): strength[code]}
        found.setdefault(int(np.searchsorted(offsets, at, side="right")) - 1, {}).update(own)
    single = np.fromiter((len(w.strip(".,-_*")) == 1 for w in words), bool, len(words))
    for text, a, b in _spaced(codes, offsets, single):
        read = _pieces(decode("".join(words[c].strip(".,-_*")[:1] for c in codes[a:b]).lower(), model.letters))
        for piece, s in zip(read, evidence(read, model).tolist(), strict=True):
            if s > 0:
                found.setdefault(text, {})[piece] = s
    for text, by in found.items():
        best = sorted(by.values(), reverse=True)
        out[text, : len(best[:TOP])] = best[:TOP]
        out[text, TOP] = np.log1p(sum(best[TOP:]))
    return out


def _letter_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, trigram) of every letter of every word and its end mark; a trigram is three code points of 21 bits."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(_MARK * 2 + w + _MARK for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 3
    ends = np.ones(len(codes), bool)
    first = np.cumsum(lengths) - lengths
    ends[first] = ends[first + 1] = False  # what ends here would begin in the word before
    at = np.flatnonzero(ends)
    return np.repeat(np.arange(len(words)), lengths)[at], codes[at - 2] << 42 | codes[at - 1] << 21 | codes[at]


def _sums(keys: np.ndarray, owner: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their owners' counts."""
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, toxic[owner], len(keys)), np.bincount(place, clean[owner], len(keys))


#: Kinds of counts: of all words (key 0), of letter trigrams, of n-grams by their hash.
WORDS, LETTERS, GRAMS = range(3)
COUNTS = "kind int, key long, toxic long, clean long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch how many documents of each label hold a word, summed over all words, over those with a trigram of
    letters and over those with an n-gram. All are plain sums over documents, so that no table of words is needed."""
    for batch in text_slices(batches, "text"):
        words, codes, offsets = words_of(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        pairs = np.unique(owner * max(1, len(words)) + codes) if len(codes) else np.zeros(0, np.int64)
        label = batch.column("label").to_numpy()
        is_toxic = label[pairs // max(1, len(words))] == 1
        numbers: dict[str, int] = {}
        plain = np.fromiter((numbers.setdefault(w, len(numbers)) for w in _plain(words)), np.int64, len(words))
        code = plain[pairs % max(1, len(words))]
        toxic, clean = (np.bincount(code[which], minlength=len(numbers)).astype(float) for which in (is_toxic, ~is_toxic))
        if "" in numbers:
            toxic[numbers[""]] = clean[numbers[""]] = 0
        words = list(numbers)
        alpha = np.fromiter((w.isalpha() for w in words), bool, len(words))
        which, trigrams = _letter_trigrams([w for w, a in zip(words, alpha, strict=True) if a])
        owner, grams = word_grams(words, SIZES)
        parts = (
            (WORDS, np.zeros(1, np.int64), toxic.sum(keepdims=True), clean.sum(keepdims=True)),
            (LETTERS, *_sums(trigrams, np.flatnonzero(alpha)[which], toxic, clean)),
            (GRAMS, *_sums(grams, owner, toxic, clean)),
        )
        for kind, keys, t, c in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "toxic", "clean"])


def _best(batches: Iterator[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    memo: dict[str, str] = {}
    for batch in text_slices(batches, "text"):
        rows = best_words(batch.column("text"), model, memo)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows of the logistic likelihood's slope and, behind it, curvature at the weights ``w``, the intercept's first."""
    a = np.c_[np.ones(len(x)), x]
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return np.concatenate((a.T @ (y - p), ((a * (p * (1 - p))[:, None]).T @ a).ravel()))


def _newton(slopes: Callable[[np.ndarray], np.ndarray], n: int, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on the regularised likelihood whose ``_slopes`` are given; it ends when no weight moves any more."""
    w, penalty = np.zeros(n + 1), np.array([0.01, *[ridge] * n])
    for _ in range(30):
        found = slopes(w)
        step = np.linalg.solve(found[n + 1 :].reshape(n + 1, n + 1) + np.diag(penalty), found[: n + 1] - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-10:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on the regularised logistic likelihood; the intercept comes first."""
    return _newton(partial(_slopes, x, y), x.shape[1], ridge)


def _part_slopes(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(w) * (len(w) + 1))
    for batch in batches:
        total += _slopes(batch.column("x").flatten().to_numpy().reshape(-1, len(w) - 1), batch.column("label").to_numpy().astype(float), w)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])


def _standing_out(a: np.ndarray, b: np.ndarray, nt: float, nc: float, least_docs: int, least_g: float) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams count as evidence, and the weights of all: seen in at least ``least_docs`` toxic documents, likelihood ratio of
    at least ``least_g``."""
    w = np.log((a + 0.5) / nt) - np.log((b + 0.5) / nc)
    e = (a + b) * nt / (nt + nc)
    g = 2 * (a * np.log(np.maximum(a, 1e-9) / e) + b * np.log(np.maximum(b, 1e-9) / np.maximum(a + b - e, 1e-9)))
    return (a >= least_docs) & (w > 1.5) & (g >= least_g), w


def _weights(words: list[str], toxic: np.ndarray, clean: np.ndarray, least_docs: int, least_g: float) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that stand out in toxic documents, and their weights, from counts of words."""
    nt, nc = max(1.0, toxic.sum()), max(1.0, clean.sum())
    owner, h = word_grams(words, SIZES)
    keys, a, b = _sums(h, owner, toxic, clean)
    seen = a + b > 0
    keys, a, b = keys[seen], a[seen], b[seen]
    keep, w = _standing_out(a, b, nt, nc, least_docs, least_g)
    return keys[keep], w[keep]


def _choose(batches: Iterator[pa.RecordBatch], nt: float, nc: float, least_docs: int, least_g: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy().astype(float) for c in ("toxic", "clean"))
        keep, w = _standing_out(a, b, nt, nc, least_docs, least_g)
        yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(keep)), pa.array(w[keep])], ["key", "weight"])


def fit(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], *, label: str = "toxic", least_docs: int = 4, least_g: float = 25.0) -> ToxicModel:
    """Learn from all labelled documents that are not held out: n-gram evidence, the character model of all their words, and
    the weights of a text's best words.

    Nothing that grows with the documents comes to the driver. It gets the trigrams of letters that there are, the n-grams that
    stand out, and the likelihood's slopes for each step towards the weights; the labelled texts, the counts of all n-grams
    and the measurements of the texts are scratch tables, deleted once they have been read.
    """
    texts = materialize(labelled(docs.select("doc_id", "text"), labels, label, held_out), "toxic-texts")
    drop_shuffles(docs.sparkSession)
    counted = texts.mapInArrow(_count, COUNTS).groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counted.filter((F.col("kind") != GRAMS) | (F.col("toxic") >= least_docs)), "toxic-counts")  # with less, none stands out
    few = counts.filter(F.col("kind") != GRAMS).toArrow().sort_by([("kind", "ascending"), ("key", "ascending")])
    kind, key, toxic, clean = (few.column(c).to_numpy() for c in ("kind", "key", "toxic", "clean"))
    nt, nc = (max(1.0, float(n[kind == WORDS].sum())) for n in (toxic, clean))
    of = kind == LETTERS
    trigrams = {"".join(chr(k >> shift & 0x1FFFFF) for shift in (42, 21, 0)): n for k, n in zip(key[of].tolist(), (toxic + clean)[of].tolist(), strict=True)}
    chosen = counts.filter(F.col("kind") == GRAMS).mapInArrow(partial(_choose, nt=nt, nc=nc, least_docs=least_docs, least_g=least_g), "key long, weight double").toArrow()
    discard(counts)
    hashes, weights = chosen.column("key").to_numpy().view(np.uint64), chosen.column("weight").to_numpy()
    order = np.argsort(hashes)
    model = ToxicModel(hashes[order], weights[order], CharacterModel.of_trigrams(trigrams), np.zeros(TOP + 3))
    measured = texts.mapInArrow(partial(_best, model=model), "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    rows = materialize(measured.select("label", "x"), "toxic-rows")
    discard(texts)
    drop_shuffles(docs.sparkSession)

    def slopes(w: np.ndarray) -> np.ndarray:
        return sum((np.array(r["sums"]) for r in rows.mapInArrow(partial(_part_slopes, w=w), "sums array<double>").collect()), np.zeros(len(w) * (len(w) + 1)))

    model.fit = _newton(slopes, TOP + 2)
    discard(rows)
    return model


def _apply(batches: Iterator[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    memo: dict[str, str] = {}
    for batch in text_slices(batches, "text"):
        x = best_words(batch.column("text"), model, memo)
        score = 1 / (1 + np.exp(-np.clip(model.fit[0] + x @ model.fit[1:], -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs``.

    Whole texts are read; null and empty ones get the score of a text without evidence, as all do if nothing could be
    learned. Repeated rows are scored each by itself, null ids stay null, ties among words count each, other columns are ignored,
    an empty table gives no rows. One pass, no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_apply, model=model), "doc_id long, score double")
