"""Row-wise plans over streams: steps that look at one row at a time mean the same on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from specdag.errors import SpecError
from specdag.operators.lower import lower
from specdag.plans import steps as S
from specdag.sources.catalog import Catalog

_ROW_WISE = (S.Scan, S.Filter, S.Derive, S.Project)


def apply(plan: S.Plan, stream: DataFrame) -> DataFrame:
    """The plan over ``stream`` in place of its one table. A step that needs all rows at once is refused rather than given
    another meaning."""
    scan = plan.steps[0] if plan.steps else None
    if not isinstance(scan, S.Scan) or not stream.isStreaming:
        raise SpecError("STREAM", "a plan over a stream begins with a scan of it")
    if bad := [type(s).__name__ for s in plan.steps if not isinstance(s, _ROW_WISE)]:
        raise SpecError("STREAM", f"{bad} need all rows at once")
    return lower(plan, Catalog(stream.sparkSession).add(scan.table, stream))
