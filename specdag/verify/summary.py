"""Figures of a result, and anomalies of a source, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specdag.errors import Finding
from specdag.sources.catalog import TableMeta


def summary(df: DataFrame) -> DataFrame:
    """A row for each column: ``column``, ``row_count``, ``null_count``, and ``total`` of numeric ones to four places."""
    parts = []
    for k, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, T.NumericType)
        parts += [F.count_if(c.isNull()).alias(f"n{k}"), (F.round(F.sum(c.cast("double")), 4) if numeric else F.lit(None).cast("double")).alias(f"t{k}")]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *parts)
    rows = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"n{k}").alias("null_count"), F.col(f"t{k}").alias("total")) for k, f in enumerate(df.schema.fields)))
    return one.select("row_count", F.explode(rows).alias("r")).select("r.column", "row_count", "r.null_count", "r.total")


def samples(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows by the columns in order, those that can be sorted: the same ones whenever they are asked for."""
    return df.orderBy(*(F.col(f"`{f.name}`").asc_nulls_last() for f in df.schema.fields if not isinstance(f.dataType, T.MapType))).limit(rows)


def anomalies(df: DataFrame, meta: TableMeta, drift: float = 0.5, partition: str | None = None, partitions: tuple = ()) -> list[Finding]:
    """Missing columns, types of another family, nulls where none may be, partitions without rows, and drift of the row count."""
    out = [Finding("MISSING_COLUMN", "reject", f"{meta.name} has no {c}") for c in meta.types if c not in df.columns]
    from specdag.plans.validate import family

    for f in df.schema.fields:
        if f.name in meta.types and family(meta.types[f.name]) not in (None, family(f.dataType.simpleString())):
            out.append(Finding("TYPE_MISMATCH", "reject", f"{meta.name}.{f.name} is {f.dataType.simpleString()}, not {meta.types[f.name]}"))
    strict = [c for c, may in meta.nullable.items() if not may and c in df.columns]
    asked = [F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in strict)]
    if partition:
        asked += [F.count_if(F.col(f"`{partition}`") == F.lit(p)).alias(f"_p{k}") for k, p in enumerate(partitions)]
    row = df.agg(*asked).first()
    out += [Finding("UNEXPECTED_NULL", "warn", f"{meta.name}.{c} has {row[c]} nulls") for c in strict if row[c]]
    if partition:
        out += [Finding("PARTITION_GAP", "warn", f"{meta.name} has no rows of {partition} {p}") for k, p in enumerate(partitions) if not row[f"_p{k}"]]
    if meta.est_rows and abs(row["_n"] - meta.est_rows) > drift * meta.est_rows:
        out.append(Finding("ROW_COUNT_DRIFT", "warn", f"{meta.name} has {row['_n']} rows, not about {meta.est_rows}"))
    return out
