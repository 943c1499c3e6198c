"""Texts on their way through a shuffle: compressed, one blob each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lumenry.llm.common import pieces, raw


def unpack(blob: bytes | None) -> bytes:
    """A blob's UTF-8 text; null gives an empty one."""
    return zstandard.ZstdDecompressor().decompress(blob) if blob else b""


def packed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *carry: str) -> DataFrame:
    """(key, the columns ``carry``, blob) of all rows; null text has a null blob."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for piece in pieces(batches):
            blobs = [None if t is None else pack(t) for t in raw(piece.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in (key, *carry)), pa.array(blobs, pa.binary())], names=[key, *carry, "blob"])

    kind = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (key, *carry))
    return docs.select(key, *carry, docs[text].alias("_text")).mapInArrow(run, f"{kind}blob binary")
