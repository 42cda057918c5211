"""Tables by name, read as DataFrames, with the facts that plans are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from specdag.errors import SpecError


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str


@dataclass(frozen=True)
class TableMeta:
    """What is known of a table besides its schema."""

    name: str
    role: str | None = None  # fact or dim
    unique_keys: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    est_rows: int | None = None
    time_column: str | None = None
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    types: dict[str, str] = field(default_factory=dict, hash=False)
    nullable: dict[str, bool] = field(default_factory=dict, hash=False)


class Catalog:
    """``add`` tables or sources; ``read`` gives a fresh DataFrame each time, so a table may stand on both sides of a join."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._readers: dict[str, Callable[[], DataFrame]] = {}
        self.meta: dict[str, TableMeta] = {}

    def add(self, name: str, reader: Callable[[], DataFrame] | DataFrame, meta: TableMeta | None = None) -> Catalog:
        self._readers[name] = (lambda: reader) if isinstance(reader, DataFrame) else reader
        self.meta[name] = meta or TableMeta(name)
        return self

    def add_file(self, name: str, path: str, kind: str | None = None, meta: TableMeta | None = None, schema: str | None = None) -> Catalog:
        """A Parquet, CSV or JSON source, by its ending unless ``kind`` says; without a ``schema`` CSV and JSON are inferred."""
        kind = kind or path.rstrip("/").rpartition(".")[2].lower()
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        readers = {
            "parquet": lambda: reader.parquet(path),
            "csv": lambda: reader.csv(path, header=True, inferSchema=schema is None),
            "json": lambda: reader.json(path),
            "jsonl": lambda: reader.json(path),
        }
        if kind not in readers:
            raise SpecError("SOURCE", f"no reader for {path}")
        return self.add(name, readers[kind], meta)

    def add_catalog_table(self, name: str, table: str, meta: TableMeta | None = None) -> Catalog:
        """A table or view that the session's own catalog knows, such as an attached warehouse's."""
        return self.add(name, lambda: self.spark.table(table), meta)

    def read(self, name: str) -> DataFrame:
        if name not in self._readers:
            raise SpecError("TABLE", f"no table {name}")
        return self._readers[name]()

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, tables: dict[str, TableMeta]) -> Catalog:
        """One Parquet table per name in ``folder``."""
        out = cls(spark)
        for name, meta in tables.items():
            out.add_file(name, f"{folder}/{name}.parquet", "parquet", meta)
        return out
