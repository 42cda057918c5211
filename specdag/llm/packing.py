"""Packing by power-of-two decomposition.

Every document's token ids are cut into pieces whose lengths are powers of two: as many of the largest length as fit,
then the binary digits of the rest, longest first. A piece is a sequence by itself, so no sequence crosses documents and
none needs padding; equal lengths share a bucket, from which a trainer draws batches of one shape.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdag.llm.common import text_slices

#: Characters of whose class (letter, digit, blank, other) every regular expression library thinks the same.
_SETTLED = re.compile("[\t\n\r -~\xa0-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

_encoders: dict[tuple[str, str | None], Encoder] = {}


class Encoder:
    """Token ids of whole texts through the ``tokenizers`` file at ``path``.

    If ``ranks`` names the same vocabulary as a rank file, with ``pattern`` as its pre-tokenizer, texts of settled
    characters go through ``tiktoken``, which gives the same ids several times faster; other texts never do, and no text that
    holds the string of an added token, which ``tokenizers`` reads as that token.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.fast = path, None
        if ranks:
            import tiktoken

            with open(path, encoding="utf-8") as file:
                self.added = [t["content"] for t in json.load(file).get("added_tokens", ())]
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def tokenizer(self) -> object:
        """Loaded when the first text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @classmethod
    def of(cls, path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
        if (path, ranks) not in _encoders:
            _encoders[path, ranks] = cls(path, ranks, pattern)
        return _encoders[path, ranks]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast and (text.isascii() or _SETTLED.fullmatch(text)) and not _CONTROL.search(text) and not any(x in text for x in self.added):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def lengths_of(tokens: int, longest: int) -> list[int]:
    """The power-of-two lengths that ``tokens`` ids decompose into, longest first."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, pattern: str | None, longest: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, end = Encoder.of(path, ranks, pattern), array("I", [end_id]).tobytes()
    for batch in text_slices(batches, "text", 4 << 20):
        rows, starts, sizes, crcs, totals, kept = [], [], [], [], [], []
        for row, text in enumerate(batch.column("text")):
            ids, at = memoryview(encoder.encode(text.as_py() or "") + end), 0
            for n in lengths_of(total := len(ids) // 4, longest):
                piece = ids[4 * at : 4 * (at + n)]
                rows.append(row), starts.append(at), sizes.append(n), crcs.append(zlib.crc32(piece)), totals.append(total)
                if keep_ids:
                    kept.append(np.frombuffer(piece, "<u4").astype("i4"))
                at += n
        columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if keep_ids:
            columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, pattern: str | None = None, longest: int = 2048, end_id: int = 1, keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of every document of ``docs``.

    Columns: ``doc_id``, ``start`` (ids of the document before it), ``length`` (a power of two up to ``longest``),
    ``ids_crc32``, ``doc_tokens`` (with the end id), ``ids`` if ``keep_ids``, ``sequence_id``, ``offset`` (always 0) and
    ``bucket`` (log2 of the length, by which sequences of one shape are drawn or written).

    Null and empty texts give one piece, the end id. Null ids stay null. Repeated rows are packed each by itself; other
    columns of ``docs`` are ignored; an empty table gives no rows. See ``Encoder`` for ``ranks_path`` and ``pattern``.
    There is no shuffle: ``sequence_id`` is the partition's number and the row's place in it, unique without counting,
    and the same again when a lost task is run anew.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = source.mapInArrow(partial(_pack, path=tokenizer_path, ranks=ranks_path, pattern=pattern, longest=longest, end_id=end_id, keep_ids=keep_ids), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences to one folder per length, so that a reader gets batches of one shape."""
    pieces.write.partitionBy("bucket").parquet(path)
