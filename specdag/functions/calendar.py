"""Time ranges as predicates with constant bounds, which reach the scan."""

from __future__ import annotations

import datetime
import re

from specdag.errors import SpecError
from specdag.functions.expr import And, Between, Cmp, Expr, Lit, date_literal

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
#: The month in which a fiscal year begins.
FISCAL = {"fiscal_jul": 7, "fiscal_apr": 4}


def _half_open(column: Expr, start: datetime.date, after: datetime.date) -> Expr:
    return And((Cmp(">=", column, date_literal(start)), Cmp("<", column, date_literal(after))))


def fixed(column: Expr, start: str | None, end: str | None, inclusive: bool = True) -> Expr:
    """From ``start`` to ``end``. Days become a half-open range, to the end of the last day if ``inclusive``; bounds in other
    forms are compared as they are."""
    if not start and not end:
        raise SpecError("TIME_RANGE", "a fixed range needs a bound")
    days = all(_DAY.fullmatch(b) for b in (start, end) if b)
    parts: list[Expr] = []
    if start:
        parts.append(Cmp(">=", column, Lit(start)))
    if end and days:
        last = datetime.date.fromisoformat(end) + datetime.timedelta(days=int(inclusive))
        parts.append(Cmp("<", column, date_literal(last)))
    elif end:
        if start and inclusive:
            return Between(column, Lit(start), Lit(end))
        parts.append(Cmp("<=" if inclusive else "<", column, Lit(end)))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def fiscal(column: Expr, calendar: str, year: int) -> Expr:
    if calendar not in FISCAL:
        raise SpecError("TIME_RANGE", f"no calendar {calendar}; there are {sorted(FISCAL)}")
    month = FISCAL[calendar]
    return _half_open(column, datetime.date(year, month, 1), datetime.date(year + 1, month, 1))


def relative(column: Expr, name: str, as_of: datetime.date | None = None) -> Expr:
    """``last_<n>d``, ``mtd`` or ``ytd`` before ``as_of`` (today unless given), without an upper bound."""
    today = as_of or datetime.datetime.now(datetime.UTC).date()
    if m := re.fullmatch(r"last_(\d+)d", name):
        start = today - datetime.timedelta(days=int(m[1]))
    elif name == "mtd":
        start = today.replace(day=1)
    elif name == "ytd":
        start = today.replace(month=1, day=1)
    else:
        raise SpecError("TIME_RANGE", f"no relative range {name}")
    return Cmp(">=", column, date_literal(start))
