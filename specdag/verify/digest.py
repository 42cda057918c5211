"""An order-free digest of a result as a multiset of rows, in built-in expressions only.

A field is tag, length in four bytes, UTF-8 text; a null is tag and FFFFFFFF. A row is the SHA-256 of its fields. Rows go
to 256 buckets by their hash's first byte; a bucket is the SHA-256 of its number, how many distinct rows it has, and each
of them with its count, in order; the whole is the SHA-256 of the version, the specification's hash, the row count, and
all buckets. Per-bucket work is an aggregation over distinct rows, so a digest costs two shuffles of hashes.

Floats are taken only with a precision, and timestamps have one form, both so that the text does not depend on an engine.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specdag.errors import SpecError

VERSION = "cdp-v1"
#: The tag of each type family.
TAGS = {"BOOLEAN": 0x01, "INT8": 0x02, "INT16": 0x03, "INT32": 0x04, "INT64": 0x05, "FLOAT32": 0x06, "FLOAT64": 0x07, "DECIMAL": 0x08, "VARCHAR": 0x09, "DATE": 0x0A, "TIMESTAMP": 0x0B}
BUCKETS = 256
_FAMILY = {T.BooleanType: "BOOLEAN", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.FloatType: "FLOAT32", T.DoubleType: "FLOAT64", T.StringType: "VARCHAR", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP"}


@dataclass(frozen=True)
class Field:
    name: str
    family: str
    precision: int | None = None  # decimal places of floats and decimals


@dataclass(frozen=True)
class DigestSpec:
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, df: DataFrame, float_places: int = 6) -> DigestSpec:
        """From a frame's schema; a nested column raises."""
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.DecimalType):
                out.append(Field(f.name, "DECIMAL", f.dataType.scale))
            elif type(f.dataType) in _FAMILY:
                family = _FAMILY[type(f.dataType)]
                out.append(Field(f.name, family, float_places if family.startswith("FLOAT") else None))
            else:
                raise SpecError("DIGEST", f"{f.name}: {f.dataType.simpleString()} has no digest")
        return cls(tuple(out))

    def hash(self) -> str:
        text = json.dumps({"version": VERSION, "fields": [[f.name, f.family, f.precision] for f in self.fields]}, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()


def _text(c: Column, field: Field) -> Column:
    if field.family == "BOOLEAN":
        return F.when(c, F.lit("true")).otherwise(F.lit("false"))
    if field.family.startswith("FLOAT"):
        x = c.cast("double")
        special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        # a negative zero equals zero; only its inverse or text tells them apart
        zero = F.when((x == 0) & x.cast("string").startswith("-"), "-0.0").when(x == 0, "0.0")
        if field.precision is None:
            raise SpecError("DIGEST", f"{field.name}: floats need a precision")
        rounded = F.round(x.cast(f"decimal(38,{min(18, field.precision + 6)})"), field.precision)
        places = rounded.cast("double")
        usual = F.when(places == 0, F.when(x < 0, "-0.0").otherwise("0.0")).otherwise(F.regexp_replace(F.regexp_replace(rounded.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0"))
        return F.coalesce(special, zero, F.when(usual.contains("."), usual).otherwise(F.concat(usual, F.lit(".0"))))
    if field.family == "DECIMAL":
        return F.regexp_replace(F.regexp_replace(F.round(c, field.precision or 0).cast("string"), r"\.", ""), r"^(-?)0+(?=\d)", "$1")
    if field.family == "DATE":
        return F.date_format(c, "yyyy-MM-dd")
    if field.family == "TIMESTAMP":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast("string")


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number), digits, "0")


def row_hash(df: DataFrame, spec: DigestSpec) -> Column:
    """Upper-case hex of a row's SHA-256."""
    parts = []
    for f in spec.fields:
        text = _text(F.col(f"`{f.name}`"), f)
        full = F.concat(F.lit(f"{TAGS[f.family]:02X}"), _hex(F.octet_length(text), 8), F.hex(F.encode(text, "UTF-8")))
        parts.append(F.when(F.col(f"`{f.name}`").isNull(), F.lit(f"{TAGS[f.family]:02X}FFFFFFFF")).otherwise(full))
    return F.upper(F.sha2(F.unhex(F.concat(*parts)), 256)) if parts else F.upper(F.sha2(F.lit(b""), 256))


def buckets(df: DataFrame, spec: DigestSpec | None = None) -> DataFrame:
    """``bucket``, its ``rows`` and its ``digest`` (hex), for buckets that are not empty.

    Distinct rows of a bucket are listed in one task, a 256th of them: for results, not for raw tables."""
    spec = spec or DigestSpec.of(df)
    counted = df.select(row_hash(df, spec).alias("h")).groupBy("h").count()
    listed = counted.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sum("count").alias("rows"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat("h", _hex(F.col("count"), 16)))).alias("list"))
    digest = F.upper(F.sha2(F.unhex(F.concat("b", _hex(F.col("n"), 16), F.array_join("list", ""))), 256))
    return listed.select(F.conv("b", 16, 10).cast("int").alias("bucket"), "rows", digest.alias("digest"))


def digest(df: DataFrame, spec: DigestSpec | None = None, spec_hash: str | None = None) -> DataFrame:
    """One row: ``spec_hash``, ``row_count`` and ``digest`` (lower-case hex)."""
    spec = spec or DigestSpec.of(df)
    spec_hash = spec_hash or spec.hash()
    empty = [hashlib.sha256(bytes([b]) + bytes(8)).hexdigest().upper() for b in range(BUCKETS)]
    found = buckets(df, spec).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.map_from_entries(F.collect_list(F.struct("bucket", "digest"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.concat(_hex(b, 2), F.coalesce(F.element_at("m", b), F.get(F.array(*map(F.lit, empty)), b))))
    head = F.lit((VERSION.encode().hex() + spec_hash).upper())
    whole = F.concat(head, _hex(F.col("row_count"), 16), F.lit(f"{BUCKETS:04X}"), F.array_join(every, ""))
    return found.select(F.lit(spec_hash).alias("spec_hash"), F.col("row_count").cast("bigint").alias("row_count"), F.sha2(F.unhex(whole), 256).alias("digest"))


def same(a: DataFrame, b: DataFrame, float_places: int = 6) -> bool:
    """Whether two results have one digest; different specifications raise, since their digests say nothing."""
    x, y = DigestSpec.of(a, float_places), DigestSpec.of(b, float_places)
    if x != y:
        raise SpecError("DIGEST", "the results have different columns")
    return digest(a, x).first() == digest(b, y).first()


@dataclass(frozen=True)
class Bound:
    """A digest with what it holds for: how rows were read as bytes, and of which snapshot they were made."""

    spec_hash: str
    snapshot_id: str
    row_count: int
    digest: str


def bound(df: DataFrame, snapshot_id: str, spec: DigestSpec | None = None) -> Bound:
    row = digest(df, spec).first()
    return Bound(row["spec_hash"], snapshot_id, row["row_count"], row["digest"])


def compared(a: Bound, b: Bound) -> tuple[bool, str]:
    """Whether two digests agree, and why not. Digests of different specifications or snapshots say nothing of each other and raise."""
    if a.spec_hash != b.spec_hash:
        raise SpecError("DIGEST", "the digests are of different specifications")
    if a.snapshot_id != b.snapshot_id:
        raise SpecError("DIGEST", "the digests are of different snapshots")
    if a.row_count != b.row_count:
        return False, f"{a.row_count} rows and {b.row_count}"
    return (True, "") if a.digest == b.digest else (False, "the rows differ")
