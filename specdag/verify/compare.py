"""Keyed, typed, tolerant comparison of two results, as distributed joins and counters."""

from __future__ import annotations

import enum
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Status(enum.Enum):
    CONSISTENT = "CONSISTENT"
    CONSISTENT_WITH_WARN = "CONSISTENT_WITH_WARN"
    SAMPLED_CONSISTENT = "SAMPLED_CONSISTENT"
    MISMATCH = "MISMATCH"
    HUMAN_REVIEW = "HUMAN_REVIEW"


@dataclass(frozen=True)
class Tolerance:
    relative: float = 1e-9
    absolute: float = 1e-12


@dataclass(frozen=True)
class Report:
    status: Status
    reason: str
    counts: dict[str, int]


def _exact(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def close(a: Column, b: Column, kind: T.DataType, tolerance: Tolerance) -> Column:
    """Never null. NaN equals NaN, an infinity itself, null null; null, NaN and empty text are three values."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
        near = F.abs(a - b) <= F.greatest(F.lit(tolerance.absolute), F.lit(tolerance.relative) * F.greatest(F.abs(a), F.abs(b)))
        return _exact(a, b) | F.coalesce(finite & near, F.lit(False))
    return _exact(a, b)


def diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: Tolerance = Tolerance()) -> DataFrame:
    """Rows that differ: the keys, ``side`` (left, right or both), and ``columns``, those beyond the tolerance."""
    values = [c for c in left.columns if c not in keys]
    l = left.select(*(F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns), F.lit(True).alias("l__there"))
    r = right.select(*(F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns), F.lit(True).alias("r__there"))
    both = l.join(r, reduce(lambda a, b: a & b, (F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys)), "full")
    types = {f.name: f.dataType for f in left.schema.fields}
    wrong = F.filter(F.array(*(F.when(~close(F.col(f"l_{c}"), F.col(f"r_{c}"), types[c], tolerance), F.lit(c)) for c in values)) if values else F.array().cast("array<string>"), lambda x: x.isNotNull())
    side = F.when(F.col("l__there").isNull(), "right").when(F.col("r__there").isNull(), "left").otherwise("both")
    out = both.select(*(F.coalesce(F.col(f"l_{k}"), F.col(f"r_{k}")).alias(k) for k in keys), side.alias("side"), wrong.alias("columns"))
    return out.filter((F.col("side") != "both") | (F.size("columns") > 0))


def smallest_keys(df: DataFrame, key: str, groups: int = 10) -> DataFrame:
    return df.select(key).distinct().orderBy(F.col(key).asc_nulls_last()).limit(groups)


def of_groups(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    named = few.select(F.col(f"`{key}`").alias("_few"))
    return df.join(F.broadcast(named), F.col(f"`{key}`").eqNullSafe(F.col("_few")), "left_semi")


def smallest_groups(df: DataFrame, key: str, groups: int = 10) -> DataFrame:
    """The complete groups of a key's smallest values: a cheap part to compare."""
    return of_groups(df, smallest_keys(df, key, groups), key)


#: Rows beyond which a comparison looks at the groups of the smallest keys only, and the most rows of those.
OVERFLOW, SAMPLED_ROWS = 100_000, 10_000


def compare(left: DataFrame, right: DataFrame, keys: list[str] | None, tolerance: Tolerance = Tolerance(), sampled: bool | None = None, overflow: int = OVERFLOW) -> Report:
    """Counters decide: columns, keys, counts, then values. No rows on both sides prove nothing and go to a person.

    If a side has more than ``overflow`` rows, all rows are counted, and of the values only those of the complete groups of the ten
    smallest first keys are compared, as many as have ``SAMPLED_ROWS`` rows together; ``sampled`` says so, or forbids it, whatever the rows."""
    if sorted(left.columns) != sorted(right.columns):
        return Report(Status.MISMATCH, "the columns differ", {})
    if not keys or not set(keys) <= set(left.columns):
        return Report(Status.HUMAN_REVIEW, "there are no keys to align rows by", {})
    counts = {}
    if sampled is not False:
        whole = {"left_whole": left.count(), "right_whole": right.count()}  # of all rows, before any are cut
        sampled = sampled or max(whole.values()) > overflow
    if sampled:
        counts = whole
        if counts["left_whole"] != counts["right_whole"]:
            return Report(Status.MISMATCH, "the row counts differ", counts)
        both = left.select(keys[0]).unionByName(right.select(keys[0]))
        sizes = [tuple(r) for r in both.groupBy(keys[0]).count().orderBy(F.col(keys[0]).asc_nulls_last()).limit(10).collect()]
        few, rows = [], 0
        for key, n in sizes:
            rows += n
            if few and rows > 2 * SAMPLED_ROWS:
                break
            few.append((key,))
        few = left.sparkSession.createDataFrame(few, left.select(keys[0]).schema)
        left, right = of_groups(left, few, keys[0]), of_groups(right, few, keys[0])
    for name, df in (("left", left), ("right", right)):
        null = reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() | (F.col(f"`{k}`").cast("string") == "") for k in keys))
        by_key = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(null.cast("int")).alias("_null"))
        row = by_key.agg(F.sum("_n"), F.count_if(F.col("_n") > 1), F.sum("_null")).first()
        counts |= {name: row[0] or 0, f"{name}_repeated": row[1] or 0, f"{name}_null": row[2] or 0}
    if counts["left"] == counts["right"] == 0:
        return Report(Status.HUMAN_REVIEW, "both results are empty", counts)
    if any(counts[f"{side}_{what}"] for side in ("left", "right") for what in ("repeated", "null")):
        return Report(Status.HUMAN_REVIEW, "keys are null or repeated", counts)
    if counts["left"] != counts["right"]:
        return Report(Status.MISMATCH, "the row counts differ", counts)
    counts["beyond"] = diff(left, right, keys, tolerance).count()
    if counts["beyond"]:
        return Report(Status.MISMATCH, "values differ", counts)
    if sampled:
        return Report(Status.SAMPLED_CONSISTENT, "the compared groups agree", counts)
    counts["inexact"] = diff(left, right, keys, Tolerance(0.0, 0.0)).count()
    if counts["inexact"]:
        return Report(Status.CONSISTENT_WITH_WARN, "values agree within the tolerance", counts)
    return Report(Status.CONSISTENT, "values agree", counts)
