"""Partition overwrites: planned and checked first, written only when asked to."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdag.errors import Finding, raise_if_rejected

#: Partition formats, operations on temporary tables, and those that production may never see.
FORMATS = {"yyyyMMdd": re.compile(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"), "yyyyMM": re.compile(r"\d{4}(0[1-9]|1[0-2])")}
TEMPORARY = {"CREATE_TEMP", "DROP_TEMP", "INSERT_TEMP"}
FORBIDDEN = {"UPDATE", "DELETE", "MERGE", "TRUNCATE", "DROP", "ALTER"}
_TABLE = re.compile(r"\w+(\.\w+)*")


@dataclass(frozen=True)
class WritePlan:
    target: str
    source: str
    keys: tuple[str, ...]
    values: dict[str, str]
    format: str | None = None
    mode: str = "partition"
    operations: tuple[str, ...] = ()

    def statement(self) -> str:
        """The overwrite as text, for people; nothing here runs it."""
        parts = ", ".join("{}='{}'".format(k, v.replace("'", "''")) for k, v in self.values.items())
        return f"INSERT OVERWRITE TABLE {self.target}\n  PARTITION ({parts})\nSELECT *\nFROM {self.source}"


def check(plan: WritePlan) -> list[Finding]:
    """Only single partitions may be overwritten, with all keys given in the declared format, and nothing else be done."""
    out: list[Finding] = []
    say = lambda code, text: out.append(Finding(code, "reject", text))
    if plan.mode != "partition":
        say("WV-001", f"mode {plan.mode}: only partitions may be overwritten")
    if not plan.keys:
        say("WV-002", "there are no partition keys")
    if set(plan.values) != set(plan.keys):
        say("WV-003", f"values of {sorted(plan.values)} for keys {sorted(plan.keys)}")
    for op in plan.operations:
        if op.upper() in FORBIDDEN:
            say("WV-005", f"{op} may not be done")
        elif op.upper() not in TEMPORARY:
            say("WV-006", f"{op} is no operation on temporary tables")
    text = plan.statement().upper()
    if any(re.search(rf"\b{op}\b", re.sub(r"'[^']*'", "''", text)) for op in FORBIDDEN):
        say("WV-007", "the statement does more than overwrite")
    if "PARTITION (" not in text:
        say("WV-008", "the statement overwrites a whole table")
    if not _TABLE.fullmatch(plan.target) or not _TABLE.fullmatch(plan.source):
        say("WV-009", f"{plan.target!r} or {plan.source!r} is no table")
    if plan.format:
        if plan.format not in FORMATS:
            say("WV-010", f"no format {plan.format}")
        else:
            out += [Finding("WV-010", "reject", f"{k}={v} is not {plan.format}") for k, v in plan.values.items() if not FORMATS[plan.format].fullmatch(v)]
    return out


def execute(df: DataFrame, plan: WritePlan, path: str) -> None:
    """Overwrite the plan's partition under ``path`` and no other."""
    raise_if_rejected(check(plan))
    rows = df.drop(*plan.keys).select("*", *(F.lit(v).alias(k) for k, v in plan.values.items()))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*plan.keys).parquet(path)
