"""Personal data by pattern, checksum and context, built from DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for bank accounts, part and digit
ranges for the rest), and words close by raise a span's score. Kinds whose pattern says little by itself start below the least
score, so that a word close by decides about them. Positions come from the pieces between the matches.

Patterns here repeat single characters only, never groups: Java's matcher keeps a stack frame for each repeat of a group,
and a long text would overflow it. A separator that counts as part of a match is first masked by one other character.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import let

_MASK = "\x01"


@dataclass(frozen=True)
class Kind:
    """``worth``: a cheap test without which no match is possible. ``shown`` turns the text into the form that ``pattern``
    reads, of the same length. ``valid`` gets a match. ``base`` kinds stay whatever their score."""

    name: str
    pattern: str
    worth: Callable[[Column], Column]
    shown: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: tuple[str, ...]
    base: bool = True
    ends: Callable[[Column], Column] | None = None  # of the text from a match on: the span's length, 0 if there is none


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""

    def weighed(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * (F.lit(1) + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return let(_digits(match), lambda d: F.length(d).between(12, 19) & (F.aggregate(F.transform(F.split(F.reverse(d), ""), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0))


def _mod_97(match: Column) -> Column:
    """The account number with its first four characters moved to the end, letters read as 10 to 35, leaves 1 modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (acc * F.when(letter, 100).otherwise(10) + value) % 97

    return let(F.replace(match, F.lit(" "), F.lit("")), lambda d: F.length(d).between(15, 34) & (F.aggregate(F.split(F.concat(F.substring(d, 5, 40), F.substring(d, 1, 4)), ""), F.lit(0), step) == 1))


#: How long the account numbers of countries are.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD MN PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(rest: Column) -> Column:
    """The length of the account number that a text begins with: of the candidate's endings before another character than
    A-Z and 0-9 that pass, the one that has its country's length, else the longest."""
    lengths = F.create_map(*(F.lit(x) for n, of in _LENGTHS.items() for country in of.split() for x in (country, n)))

    def best(candidate: Column) -> Column:
        border = lambda i: F.substring(candidate, i, 1).rlike("[A-Z0-9]") & ~F.substring(rest, i + 1, 1).rlike("[A-Z0-9]")
        ends = F.filter(F.sequence(F.lit(15), F.length(candidate)), lambda i: border(i) & _mod_97(F.substring(candidate, F.lit(1), i)))
        usual = F.try_element_at(lengths, F.substring(candidate, 1, 2))
        ranked = F.transform(ends, lambda i: F.struct(F.coalesce(F.length(F.replace(F.substring(candidate, F.lit(1), i), F.lit(" "), F.lit(""))) == usual, F.lit(False)).alias("usual"), i.alias("i")))
        return F.when(F.length(candidate) >= 15, F.coalesce(F.array_max(ranked)["i"], F.lit(0))).otherwise(F.lit(0))

    return let(F.regexp_extract(rest, r"^[A-Z]{2}[0-9]{2}(?: *+[A-Z0-9]){11,30}", 0), best)


def _ip_parts(match: Column) -> Column:
    """No part above 255; leading zeros and long parts are compared without overflow."""
    return F.forall(F.split(match, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(F.when(F.length(q).between(1, 3), q).cast("int"), F.lit(0)) <= 255)))


def _same(text: Column) -> Column:
    return text


def _masked(between: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_replace(F.translate(text, _MASK, "\x02"), between, _MASK)


#: The kinds in the order in which spans of one start are listed.
KINDS: tuple[Kind, ...] = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
        lambda t: F.contains(t, F.lit("@")),
        _masked(r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"),
        lambda m: F.lit(True),
        0.8,
        ("mail", "contact", "write", "address", "kontakt", "correo", "courriel"),
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _same, _ip_parts, 0.6, ("ip", "host", "server", "address", "login")),
    Kind("card", r"[0-9][0-9\x01]{11,}+", lambda t: t.rlike(r"[0-9][0-9 -]{10,}[0-9]"), _masked(r"(?<=[0-9])[ -](?=[0-9])"), _luhn, 0.7, ("card", "visa", "credit", "debit", "karte", "tarjeta", "carte")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), _same, lambda m: F.length(_digits(m)).between(9, 15), 0.7, ("phone", "call", "tel", "mobile", "fax", "anruf", "llamar")),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= *+[A-Z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}"),
        _same,
        lambda m: F.lit(True),
        0.8,
        ("iban", "account", "bank", "konto", "cuenta", "compte"),
        base=False,
        ends=_account,
    ),
    Kind("secret", r"(?i)(?:token|secret|password|passwd|api_?key|access_?key)[\x20\t]*[=:][\x20\t]*[\"']?[A-Za-z0-9_+/-]{16,}", lambda t: t.rlike("[=:]"), _same, lambda m: F.lit(True), 0.6, ("login", "auth", "user"), base=False),
    # the next two are numbers like any others unless a word close by says what they are
    Kind("local_phone", r"\(?[0-9]+\)?[ .-][0-9]+[ .-][0-9]+", lambda t: t.rlike("[0-9][ .-][0-9]"), _same, lambda m: m.rlike(r"^(\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}$"), 0.4, ("phone", "call", "tel", "mobile", "fax", "anruf", "llamar"), base=False),
    Kind("national_id", r"[0-9]+-[0-9]+-[0-9]+", lambda t: t.rlike("[0-9]-[0-9]"), _same, lambda m: m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.4, ("ssn", "social", "identity", "passport", "ausweis", "pasaporte"), base=False),
)
#: How far context words are looked for, what one adds, and what a span that is no base one must reach.
NEAR, BONUS, LEAST = 40, 0.2, 0.6


def _spans(text: Column, order: int, kind: Kind) -> Column:
    """All valid matches of a kind with their places, left to right: code points, end exclusive."""

    def placed(shown: Column) -> Column:
        return let(F.regexp_extract_all(shown, F.lit(kind.pattern), F.lit(0)), lambda matches: F.when(F.size(matches) == 0, none).otherwise(let(F.split(shown, kind.pattern, -1), lambda gaps: walked(shown, matches, gaps))))

    def walked(shown: Column, matches: Column, gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("past"), none.alias("found"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.length(pair["gap"])
            end = begin + F.length(pair["match"])
            if kind.ends is None:
                return after(acc, begin, end, end, kind.valid(pair["match"]))
            rest = F.substring(shown, begin + 1, F.length(shown))
            own = F.when(begin >= acc["past"], let(rest, kind.ends)).otherwise(F.lit(0))  # not within the span before
            return let(own, lambda n: after(acc, begin, end, begin + n, n > 0))

        def after(acc: Column, begin: Column, at: Column, end: Column, valid: Column) -> Column:
            span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"))
            found = F.when(valid, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
            return F.struct(at.alias("at"), F.when(valid, end).otherwise(acc["past"]).alias("past"), found.alias("found"))

        pairs = F.transform(matches, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m.alias("match")))
        return F.aggregate(pairs, start, step, lambda acc: acc["found"])

    none = F.from_json(F.lit("[]"), "array<struct<start:int,order:int,end:int>>")
    return F.when(kind.worth(text), let(kind.shown(text), placed)).otherwise(none)


def _scored(text: Column, spans: Column) -> Column:
    def scored(span: Column) -> Column:
        begin = F.greatest(span["start"] - NEAR, F.lit(0))
        around = F.lower(F.substring(text, begin + 1, span["end"] - begin + NEAR))
        score = F.lit(0.0)
        for k, kind in enumerate(KINDS):
            words = around.rlike(r"(?<![\p{L}])(?:" + "|".join(kind.context) + r")")
            score = F.when(span["order"] == k, F.lit(kind.score) + F.when(words, F.lit(BONUS)).otherwise(F.lit(0.0))).otherwise(score)
        names = F.array(*(F.lit(k.name) for k in KINDS))
        bases = F.array(*(F.lit(k.base) for k in KINDS))
        return F.struct(span["start"].alias("start"), span["order"].alias("order"), span["end"].alias("end"), F.get(names, span["order"]).alias("kind"), F.round(score, 3).alias("score"), F.get(bases, span["order"]).alias("base"))

    return F.filter(F.transform(spans, scored), lambda s: s["base"] | (s["score"] >= LEAST))


def pii_spans(text: Column) -> Column:
    """The spans of a text column without nulls: start, order, end, kind, score and base of each, by start and then kind."""
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double,base:boolean>>")
    found = F.array_sort(F.concat(*(_spans(text, k, kind) for k, kind in enumerate(KINDS))))
    return let(found, lambda spans: F.when(F.size(spans) == 0, none).otherwise(_scored(text, spans)))


def find_pii(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id`` and ``spans``: start, order, end, kind, score and base of each span, by start and then kind.

    Matches of a kind do not overlap each other; kinds may. Null text counts as empty and has no spans. Null ids stay
    null, repeated rows are scanned each by itself, other columns of ``docs`` are ignored, an empty table gives no rows.
    A projection only: no shuffle.
    """
    raw = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return raw.select("doc_id", *(["text"] if keep_text else []), pii_spans(F.col("text")).alias("spans"))


def scores(spans: Column) -> Column:
    """Of each span the score in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
