"""Snapshots: immutable Parquet folders with a manifest, sampled so that keys still meet."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from specdag.errors import SpecError
from specdag.sources.catalog import Catalog, TableMeta

#: Rows that the related tables of a sample may have, cells that a stratum is dealt over, and rows of a snapshot's file.
BUDGET, CELLS, FILE_ROWS = 500_000, 256, 2_000_000


def sample(df: DataFrame, mode: str = "full", *, rows: int | None = None, fraction: float | None = None, by: str | None = None, seed: int = 0) -> DataFrame:
    """full, head (``rows``), random (``fraction``) or stratified (of each value of ``by``, null being one, ``fraction`` of its rows, rounded up)."""
    match mode:
        case "full":
            return df
        case "head":
            return df.limit(rows)
        case "random":
            return df.sample(fraction=fraction, seed=seed)
        case "stratified":
            if not by:
                raise SpecError("SNAPSHOT", "a stratified sample needs the column of its strata")
            return _strata(df, by, fraction, seed)
    raise SpecError("SNAPSHOT", f"no mode {mode}")


def _strata(df: DataFrame, by: str, fraction: float, seed: int) -> DataFrame:
    """The rows of each stratum whose random number is among the least ``fraction`` of them. Numbers are counted in cells of their
    leading digits, so that a stratum of any size is dealt over many tasks: all rows of the cells that fit whole are taken,
    and of the one that fits in part the first."""
    drawn = df.withColumn("_u", F.rand(seed)).withColumn("_cell", F.floor(F.col("_u") * CELLS).cast("int"))
    counts = drawn.groupBy(F.col(f"`{by}`").alias("_by"), "_cell").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_by")
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_cell")) - F.col("_n")).withColumn("_wanted", F.ceil(F.sum("_n").over(whole) * fraction))
    room = counts.select("_by", F.col("_cell").alias("_c"), F.least("_n", F.col("_wanted") - F.col("_before")).alias("_room"), "_n").filter("_room > 0")
    near = drawn.join(room, F.col(f"`{by}`").eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_c")))
    first = near.withColumn("_k", F.row_number().over(Window.partitionBy("_by", "_c").orderBy("_u")))
    return first.filter(F.col("_k") <= F.col("_room")).select(*(F.col(f"`{c}`") for c in df.columns))


@dataclass(frozen=True)
class Relation:
    left: str
    right: str
    keys: tuple[tuple[str, str], ...]


def complete_groups(df: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Rows of whole key groups, smallest first, while their sum stays within the budget.

    Group sizes are added up over their distinct values, of which there are few. At most one size fits in part; of its
    groups the first by key are taken, so no task gets more than the groups that are kept."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy("_n").agg(F.count("*").alias("_groups"))
    before = F.coalesce(F.sum(F.col("_n") * F.col("_groups")).over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("_before", before).withColumn("_fit", F.floor((F.lit(budget) - F.col("_before")) / F.col("_n"))).filter("_fit > 0")
    chosen = counts.join(F.broadcast(room.filter("_fit >= _groups").select("_n")), "_n").select(*keys)
    if part := room.filter("_fit < _groups").first():
        chosen = chosen.unionByName(counts.filter(F.col("_n") == part["_n"]).orderBy(*keys).limit(part["_fit"]).select(*keys))
    return df.join(chosen, keys, "left_semi")


def related(tables: dict[str, DataFrame], anchor: str, relations: list[Relation], *, rows: int, budget: int = BUDGET, where: object = None) -> dict[str, DataFrame]:
    """A sample in which keys meet: the first ``rows`` of the anchor by its columns in order, and of each table tied to a chosen one the rows
    whose keys are there, by whole groups within the budget. Tables that nothing ties are anchors of their own. The order makes
    every evaluation, also one after a lost executor, choose the same rows; rows that are equal in all columns are the same."""
    first = lambda df: df.orderBy(*(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType))).limit(rows)
    out = {anchor: first(tables[anchor] if where is None else tables[anchor].filter(where))}
    left = [t for t in tables if t != anchor]
    while left:
        step = next(((t, r) for r in relations for t in left if (r.left == t and r.right in out) or (r.right == t and r.left in out)), None)
        if step is None:
            out[left[0]] = first(tables[left[0]])
            left.pop(0)
            continue
        t, r = step
        own, there = ([a for a, _ in r.keys], [b for _, b in r.keys]) if r.left == t else ([b for _, b in r.keys], [a for a, _ in r.keys])
        other = out[r.right if r.left == t else r.left].select(*(F.col(b).alias(a) for a, b in zip(own, there, strict=True))).distinct()
        out[t] = complete_groups(tables[t].join(other, own, "left_semi"), own, budget)
        left.remove(t)
    return out


def _files(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """Name, SHA-256 and size of each data file, read where the executors are, each file whole by one task: ``write`` keeps them short."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    rows = found.select("path", F.sha2("content", 256).alias("sha"), "length").collect()
    return sorted((r["path"].rpartition("/")[2], r["sha"], r["length"]) for r in rows)


def write(spark: SparkSession, tables: dict[str, DataFrame], folder: str, aliases: dict[str, str] | None = None) -> dict:
    """Write each table and the manifest: an id, rows and file hashes, and an index from each name, and each of ``aliases`` to one of them, to
    the folder that has its files. The folder must not hold a snapshot yet."""
    aliases = aliases or {}
    if lost := sorted({t for t in aliases.values() if t not in tables}):
        raise SpecError("SNAPSHOT", f"aliases name {lost}, which the snapshot does not have")
    if twice := sorted(set(aliases) & set(tables)):
        raise SpecError("SNAPSHOT", f"{twice} are tables and aliases")
    manifest = {"version": 1, "tables": {}, "index": {t: t for t in tables} | aliases}
    for name, df in tables.items():
        df.write.mode("error").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/{name}")
        manifest["tables"][name] = {"rows": spark.read.parquet(f"{folder}/{name}").count(), "files": _files(spark, f"{folder}/{name}")}
    manifest["id"] = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("error").text(f"{folder}/_manifest")
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/_manifest").first()[0])


def catalog_of(spark: SparkSession, folder: str, meta: dict[str, TableMeta] | None = None) -> Catalog:
    """The snapshot's tables under all names of its index; names of one table share its files, and each reading is a fresh frame."""
    out = Catalog(spark)
    for name, table in manifest_of(spark, folder).get("index", {}).items():
        out.add_file(name, f"{folder}/{table}", "parquet", (meta or {}).get(name))
    return out


def verify(spark: SparkSession, folder: str) -> list[str]:
    """Tables whose files are not as the manifest says."""
    return [name for name, facts in manifest_of(spark, folder)["tables"].items() if [list(f) for f in _files(spark, f"{folder}/{name}")] != [list(f) for f in facts["files"]]]
