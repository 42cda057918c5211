"""Quality rules as a bitmask ledger, built from DataFrame functions only.

Every rule is evaluated once for a document; its failure is one bit of ``failed`` and its measurement is kept. A policy is
a versioned set of rules, that is a mask: applying it, or asking what each rule alone removes, needs the ledger only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import WORD_SPACE, WORD_SPLIT, let

#: The characters that count as symbols, and the words of a window.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` gets the ledger's measurement columns by name; ``bit`` never changes once it has been published."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


def _over(part: str, whole: str, percent: float) -> Callable[[Callable[[str], Column]], Column]:
    return lambda m: m(part) * 100 > m(whole) * percent


RULES: tuple[Rule, ...] = (
    Rule(0, "few_words", lambda m: m("n_words") < 10),
    Rule(1, "repeated_windows", _over("n_repeat_words", "n_words", 20)),
    Rule(2, "symbols", _over("n_symbols", "word_chars", 8)),
    Rule(3, "duplicate_lines", lambda m: (m("n_lines") >= 4) & (m("n_dup_lines") * 100 > m("n_lines") * 40)),
    Rule(4, "upper_case", lambda m: (m("word_chars") >= 40) & (m("n_upper") * 100 > m("word_chars") * 60)),
    Rule(5, "exclamation", _over("n_exclaim", "n_words", 60)),
    Rule(6, "digits", _over("n_digits", "word_chars", 40)),
    Rule(7, "long_words", lambda m: m("word_chars") > m("n_words") * 25),
    Rule(8, "few_distinct_words", lambda m: (m("n_words") >= 50) & (m("n_distinct_words") * 100 < m("n_words") * 10)),
)

#: Versions of the policy; a version is never edited, a change makes a new one.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES if r.name != "few_distinct_words"),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in set(names))


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Windows are compared by 64-bit hashes of their words.

    The windows are sorted with their places, equal neighbours give the covered places, and each place counts the words
    up to the next one: sort, no nested scan, so a long text of repeats costs n log n.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(placed, _neighbours)
        return let(F.array_sort(F.transform(repeated, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found))))
    )


def _neighbours(ordered: Column) -> Column:
    return F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def ledger(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measurements, and ``failed``, a bit per rule.

    Null text counts as empty: all measurements are 0 and ``few_words`` fails. Null ids stay null, repeated rows are
    measured each by itself, other columns of ``docs`` are ignored, an empty table gives no rows. A projection only:
    no shuffle, whatever the sources or copies hold.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    measured = docs.select(F.col(id_column).alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        F.length(F.translate("_text", WORD_SPACE, "")).cast("long").alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        _removed(F.col("_text"), "!").cast("long").alias("n_exclaim"),
        _removed(F.col("_text"), "0123456789").cast("long").alias("n_digits"),
        F.when(F.col("_text") == F.lower("_text"), F.lit(0)).otherwise(F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", ""))).cast("long").alias("n_upper"),
        let(F.filter(F.split("_text", WORD_SPLIT), lambda w: w != ""), lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            _repeat_words(words).alias("n_repeat_words"),
        )).alias("_words"),
        let(F.filter(F.split("_text", "\n"), lambda line: F.translate(line, WORD_SPACE, "") != ""), lambda lines: F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )).alias("_lines"),
    )
    measured = measured.select("*", "_words.*", "_lines.*").drop("_words", "_lines")
    failed = F.lit(0).cast("long")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(rule.fails(F.col), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """What each rule of a policy does, from one aggregation of the bits: documents that fail it, that fail it alone (and
    would come back without it), and those that pass the whole policy. A row per rule."""
    mask = policy_mask(policy)
    bits = F.col("failed").bitwiseAND(F.lit(mask))
    rules = [r for r in RULES if mask >> r.bit & 1]
    sums = rows.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(bits == 0).alias("kept"),
        *(F.count_if(bits.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in rules),
        *(F.count_if(bits == (1 << r.bit)).alias(f"a{r.bit}") for r in rules),
    )
    lines = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.col(f"f{r.bit}").alias("failed"), F.col(f"a{r.bit}").alias("failed_alone")) for r in rules))
    return sums.select("documents", "kept", F.explode(lines).alias("_r")).select("_r.*", "documents", "kept")
