"""Token ids in directly addressable codes.

An id is split into chunks, one level each. Every level but the last has a bitmap that says whether an id goes on at the
next level, and a rank directory over that bitmap, so token ``i`` is found from level to level without decoding a block.
Chunk widths are chosen for each segment by dynamic programming over the bit lengths of its ids. Segments are rows of a
Parquet table, in ascending ``doc_id`` order, so they can be written to and read from any store Spark reaches and a lost
task is simply run again.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import Lookup, keep, new_path, pieces

MAGIC = b"DAC1"
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 18
#: Keys of each of two generations of a worker's tables, about 200 bytes each.
WORD_KEYS, PART_KEYS = 500_000, 300_000
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, multiples of 4 bits, of least total size.

    ``f(b) = min over w of n(b) * (w + 1 if more follows) + f(b + w)``, n(b) being the ids of over b bits.
    """
    lengths = np.zeros(33, np.int64)
    if len(ids):
        bits = np.frexp(np.maximum(ids, 1).astype(np.float64))[1]
        lengths += np.bincount(bits, minlength=33)
    most = -(-int(np.max(np.nonzero(lengths)[0], initial=1)) // 4)
    over = [int(lengths[4 * b + 1 :].sum()) if b else int(lengths.sum()) for b in range(most)]
    best: list[tuple[int, list[int]]] = [(0, [])] * (most + 1)
    for b in reversed(range(most)):
        best[b] = min((over[b] * (4 * w + (b + w < most)) + best[b + w][0], [4 * w, *best[b + w][1]]) for w in range(1, most - b + 1))
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Chunks side by side, the first in the highest bits; two of them fill whole bytes."""
    two = np.zeros(-(-len(values) // 2) * 2, np.uint64)
    two[: len(values)] = values
    joined = (two[::2] << np.uint64(width)) | two[1::2]
    return joined.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width // 4 :].tobytes()


def _unpack(data: memoryview, count: int, width: int) -> np.ndarray:
    wide = np.zeros((-(-count // 2), 8), np.uint8)
    wide[:, 8 - width // 4 :] = np.frombuffer(data, np.uint8).reshape(-1, width // 4)
    joined = wide.view(">u8").ravel().astype(np.uint64)
    out = np.empty(2 * len(joined), np.uint32)
    out[::2], out[1::2] = joined >> np.uint64(width), joined & np.uint64((1 << width) - 1)
    return out[:count]


def encode_codes(ids: np.ndarray) -> bytes:
    """Header (magic, levels), then for each level: width, count, chunks, bitmap and rank directory (ones before each 512 bits)."""
    widths, rest = chunk_widths(ids), np.asarray(ids, np.uint32)
    out = [MAGIC, struct.pack("<I", len(widths))]
    for k, w in enumerate(widths):
        last = k == len(widths) - 1
        chunks = _pack(rest & np.uint32((1 << w) - 1), w)
        high = rest >> np.uint32(w) if w < 32 else np.zeros_like(rest)
        go_on = high > 0
        bitmap = b"" if last else np.packbits(go_on).tobytes()
        ones = [] if last else np.add.reduceat(go_on, np.arange(0, len(rest), RANK_BLOCK), dtype=np.uint32) if len(rest) else []
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4").tobytes() if len(ones) else b""
        out += [struct.pack("<IIIII", w, len(rest), len(chunks), len(bitmap), len(ranks)), chunks, bitmap, ranks]
        rest = high[go_on]
    return b"".join(out)


class Codes:
    """A reader of one segment: ``codes[i]`` for random access, ``all()`` for every id."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a code segment")
        view, at, self.levels = memoryview(data), 8, []
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            w, n, *sizes = struct.unpack_from("<IIIII", data, at)
            at += 20
            parts = []
            for size in sizes:
                parts.append(view[at : at + size])
                at += size
            self.levels.append((w, n, *parts))

    def __len__(self) -> int:
        return self.levels[0][1]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for w, _, chunks, bitmap, ranks in self.levels:
            first, end = i * w // 8, (i * w + w + 7) // 8
            value |= ((int.from_bytes(chunks[first:end], "big") >> (end * 8 - i * w - w)) & ((1 << w) - 1)) << shift
            shift += w
            if not len(bitmap) or not bitmap[i // 8] >> (7 - i % 8) & 1:
                break
            block = i // RANK_BLOCK
            before = np.frombuffer(bitmap[block * RANK_BLOCK // 8 : i // 8], np.uint8)
            i = struct.unpack_from("<I", ranks, 4 * block)[0] + int(_POPCOUNT[before].sum()) + bin(bitmap[i // 8] >> (8 - i % 8)).count("1")
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        where, shift = slice(None), 0
        for w, n, chunks, bitmap, _ in self.levels:
            out[where] |= _unpack(chunks, n, w) << np.uint32(shift)
            if not len(bitmap):
                break
            go_on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
            where = np.nonzero(go_on)[0] if isinstance(where, slice) else where[go_on]
            shift += w
        return out


class LibraryEncoder:
    """The tokenizers library's ids of whole texts, from tables of the pieces met before.

    The library runs on pieces between single spaces or line ends, which its normalizer and pre-tokenizer never join; a
    test holds this against encoding whole texts. Texts with the information separators U+001C to U+001F go to it whole, as
    do all texts if the tokenizer isn't one that is known to discard white space (``plain``).
    """

    _PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        import json

        kept = json.loads(self.tokenizer.to_str())
        split = (kept["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        lower = [x["type"] for x in (kept["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.plain = lower and split.get("pattern", {}).get("Regex") == self._PIECES.pattern and "continuing_subword_prefix" in kept["model"]
        self.special = [x["content"] for x in kept["added_tokens"]]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind, self.code = ("<u4", "I") if self.wide else ("<u2", "H")
        self.plain = self.plain and all("<" in x for x in self.special)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(128)}
        self.plain = self.plain and all(self.byte_chars[i] == chr(i) for i in range(33, 127))
        latin = "".join(level.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x180))
        pairs = {b: c for x, c in zip(range(0x80, 0x180), zip(*[iter(latin)] * 2, strict=True), strict=True) for b, c in zip(chr(x).encode(), c, strict=True)}
        self.byte_chars |= pairs
        self.words, self.parts = Lookup(self._word, WORD_KEYS), Lookup(self._part, PART_KEYS)

    def _part(self, part: str) -> bytes:
        mapped = part if part.isalpha() and part.isascii() else part.encode().decode("latin-1").translate(self.byte_chars)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if self.plain and "<" not in word and (word.isascii() or max(word) < "ƀ" and "İ" not in word):  # all in NFC
            low = word.lower()
            if low.isalpha():
                return self.parts[low]
            if low[:-1].isalpha() and low[-1] in ".,!?:;":
                return self.parts[low[:-1]] + self.parts[low[-1]]
            return b"".join(map(self.parts.__getitem__, self._PIECES.findall(low)))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian integers of the width of ``kind``."""
        if not self.plain or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


SEGMENT_SCHEMA = "part int, segment int, part_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, codes binary"


def segments(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segment rows of ``docs`` (doc_id, text) in ascending doc_id order, null ids first; null text is empty."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], own.kind).tobytes()
        held: list[bytes] = []
        ids: list[int | None] = []
        sizes: list[int] = []
        start = number = waiting = 0
        size = np.dtype(own.kind).itemsize

        def flush() -> pa.RecordBatch:
            nonlocal start, number, waiting
            n = waiting
            data = encode_codes(np.frombuffer(b"".join(held), own.kind).astype(np.uint32))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["part", "segment", "part_start", "n_tokens", "doc_ids", "doc_tokens", "codes"],
            )
            start, number, waiting = start + n, number + 1, 0
            held.clear(), ids.clear(), sizes.clear()
            return row

        keep("codes", encoder.cache_clear)
        for piece in pieces(batches, owner="codes"):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                held.append(own.encode(text or "") + end)
                ids.append(doc_id)
                sizes.append(len(held[-1]) // size)
                waiting += sizes[-1]
                if waiting >= segment_tokens:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(build, SEGMENT_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, segment_tokens: int = SEGMENT_TOKENS) -> None:
    segments(docs, tokenizer_path, end_id, segment_tokens).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a written table: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` adds three counts: of the parts before, of the part's segments before and of the segment's documents
    before. The driver sees one number for each part file, as many as the write had partitions.
    """
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, "part int, part_offset bigint")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row = {k: batch.column(k)[0].as_py() for k in ("part", "part_start", "doc_ids", "doc_tokens", "codes")}
            ids = Codes(row["codes"]).all().astype("<u4")
            ends = np.cumsum(row["doc_tokens"]).tolist()
            starts = [0, *ends[:-1]]
            out = {
                "part": pa.array([row["part"]] * len(ends), pa.int32()),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array([row["part_start"] + s for s in starts], pa.int64()),
                "n_tokens": pa.array(row["doc_tokens"], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([ids[s:e].astype(np.int32) for s, e in zip(starts, ends, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    rows = stored.mapInArrow(read, schema)
    # one row per part file, a few kB for thousands of files
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back. Repeated ids keep a row each; an empty table gives none."""
    path = new_path(docs.sparkSession, "token-codes")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)


__all__ = ["Codes", "LibraryEncoder", "chunk_widths", "encode_codes", "read_tokens", "segments", "token_table", "write_tokens"]
