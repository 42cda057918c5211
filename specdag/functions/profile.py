"""Enum profiles: which columns hold flags, states or codes, from one aggregation with bounded sets of values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of the names of flags, states, codes and of columns that are none of them.
FLAG_NAMES = ("is_*", "has_*", "flag_*", "*_flag", "*_yn", "是否*", "*_是否")
STATUS_NAMES = ("*_status", "*_state", "status_*", "*_phase", "*_stage", "状态", "*_状态")
CODE_NAMES = ("*_type", "*_code", "*_category", "*_class", "*_kind", "*_level", "type_*", "code_*", "类型", "分类", "级别")
NO_ENUM_NAMES = (
    "*year*", "*_yr", "*_yr_*", "年份", "年度", "*month*", "*_mon", "*_mon_*", "月份", "月",
    "*amount*", "*_amt", "*price*", "*_price", "*qty*", "*quantity*", "*count*", "*_cnt", "金额", "数量", "价格",
    "*age*", "*_days", "*day_*",
)
#: Words that states are called.
STATUS_WORDS = (
    "approved", "pending", "active", "inactive", "complete", "completed", "draft", "closed", "open", "done", "failed", "success", "processing", "processed",
    "submitted", "received", "shipped", "delivered", "enabled", "disabled", "valid", "invalid", "new", "in_progress", "in-progress", "in progress",
    "on_hold", "on-hold", "on hold", "cancelled", "canceled",
)
#: Sets of flag values, limits on distinct values and on their share of the rows, and shapes of values.
FLAGS = ({"0", "1"}, {"0", "1", "true", "false"}, {"y", "n"}, {"yes", "no"}, {"true", "false"}, {"是", "否"})
MOST_FLAG, MOST_STATUS, MOST_CODE = 2, 30, 50
SHARE_STATUS, SHARE_CODE, ROWS_FOR_SHARE = 0.1, 0.05, 10
HIGH, MEDIUM, LOW = 0.9, 0.8, 0.6
SHORTEST, LONGEST = 3, 25
_STATUS = re.compile(r"[A-Z][a-zA-Z]*([\s\-][A-Z][a-zA-Z]*)*")
_CODE = re.compile(r"\d{1,6}|[A-Z]{2,6}")


@dataclass(frozen=True)
class EnumProfile:
    column: str
    tier: str  # CERTAIN, HIGH, MEDIUM, LOW or NOT_ENUM
    kind: str | None
    values: tuple[str, ...]
    rows: int


def _called(name: str, shapes: tuple[str, ...]) -> bool:
    return any(fnmatchcase(name, shape) for shape in shapes)


def _tier(share: float, named: bool, worded: bool) -> str:
    """How sure a kind is whose shape ``share`` of the values have."""
    if share >= HIGH and named:
        return "HIGH"
    return "MEDIUM" if share >= MEDIUM and (named or worded) else "LOW"


def _share(values: list[str], fits: object) -> float:
    return sum(bool(fits(v)) for v in values) / len(values)


def judge(column: str, values: list[str], distinct: int, rows: int, normalised: str | None = None) -> EnumProfile:
    """Flag, then state, then code; the first kind that fits decides. A flag's name on other values makes no enum of any kind."""
    name, seen = (normalised or column).lower(), sorted({v.strip() for v in values})
    none = EnumProfile(column, "NOT_ENUM", None, (), rows)
    made = lambda tier, kind, found: EnumProfile(column, tier, kind, tuple(found), rows)
    if not seen or _called(name, NO_ENUM_NAMES):
        return none
    flag_name, lower = _called(name, FLAG_NAMES), {v.lower() for v in seen}
    if distinct <= MOST_FLAG and any(lower <= f for f in FLAGS):
        return made("CERTAIN" if flag_name else "LOW", "flag", sorted(lower))
    if flag_name:
        return none
    few = lambda most, share: distinct <= most and (rows < ROWS_FOR_SHARE or distinct / rows <= share)
    length = sum(map(len, seen)) / len(seen)
    short = _share(seen, lambda v: 2 <= len(v) <= 4 and v.isupper() and v.isalpha())  # such are rather codes
    if few(MOST_STATUS, SHARE_STATUS) and SHORTEST <= length <= LONGEST and short < MEDIUM and (share := _share(seen, _STATUS.fullmatch)) >= LOW:
        return made(_tier(share, _called(name, STATUS_NAMES), any(v.lower().replace("-", "_") in STATUS_WORDS for v in seen)), "status", seen)
    if distinct > MOST_FLAG and few(MOST_CODE, SHARE_CODE) and (share := _share(seen, _CODE.fullmatch)) >= LOW:
        return made(_tier(share, _called(name, CODE_NAMES), False), "code", seen)
    return none


def profile(df: DataFrame, columns: list[str]) -> list[EnumProfile]:
    """Profiles of ``columns``. A first aggregation counts distinct values roughly; only columns that may be enums are then
    counted and listed in full, so no set outgrows the limit for long."""
    rough = df.agg(F.count(F.lit(1)).alias("_n"), *(F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"_d{k}") for k, c in enumerate(columns))).first()
    small = [c for k, c in enumerate(columns) if rough[f"_d{k}"] <= 2 * MOST_CODE]
    exact = df.agg(F.count(F.lit(1)), *(F.collect_set(F.col(f"`{c}`").cast("string")).alias(f"_s{k}") for k, c in enumerate(small))).first() if small else None
    out = []
    for c in columns:
        values = list(exact[f"_s{small.index(c)}"]) if c in small else []
        out.append(judge(c, values, len(values), rough["_n"]))
    return out
