"""Removal of word windows that an earlier document has.

Rabin-Karp hashes of all windows come from one running sum: with ``P[i]`` the sum of ``hash(word j) * B**j`` for ``j < i``,
a window at ``i`` has ``(P[i + L] - P[i]) * B**-i`` modulo 2**64. So that not every window travels, consecutive windows
that share their minimizer (the least hash among their inner 8-word hashes) form a segment, about one for 20 words.
Equal windows have equal minimizers, so a minimizer of one document alone settles all windows around it. Of minimizers in
several documents, a segment that reads the same in all of them is settled by the least doc_id; only where readings
differ, one document for each distinct segment sends the hashes of its single windows. Nothing is grouped by document
count: every aggregate is a minimum, a maximum or a list bounded by a document's or a segment's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import Lookup, hashes, materialize, mix, pieces, raw, word_hashes
from lumenry.llm.texts import packed_texts, unpack

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
INNER = 8
#: Words of a text that are handled at once; also bounds the positions that ties are broken by.
BLOCK = 1 << 17


class Windows:
    """The windows of one block of words and their segments."""

    def __init__(self, words: np.ndarray, length: int) -> None:
        n = len(words)
        inner = min(INNER, length)
        power = np.full(n + 1, BASE)
        power[0] = 1
        power = np.cumprod(power)
        back = np.full(n + 1, BASE_INVERSE)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n])))
        self.length, self.count = length, n - length + 1
        grams = mix((self.sums[inner:] - self.sums[: n - inner + 1]) * self.back[: n - inner + 1])
        span = length - inner + 1
        low = (grams & ~np.uint64(BLOCK * 2 - 1)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: self.count], low[span - step : span - step + self.count])
        at = (low[: self.count] & np.uint64(BLOCK * 2 - 1)).astype(np.int64)
        self.starts = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
        self.ends = np.append(self.starts[1:], self.count)  # exclusive
        self.minimizers = grams[at[self.starts]]
        size = self.ends - self.starts + length - 1
        self.keys = mix((self.sums[self.starts + size] - self.sums[self.starts]) * self.back[self.starts] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self, start: int, end: int) -> np.ndarray:
        i = np.arange(start, end)
        return mix((self.sums[i + self.length] - self.sums[i]) * self.back[i])


def blocks(words: np.ndarray, length: int) -> Iterator[tuple[int, Windows]]:
    """Blocks of a text's windows, each with the first window's position; every window is in one block."""
    for at in range(0, max(0, len(words) - length + 1), BLOCK):
        yield at, Windows(words[at : at + BLOCK + length - 1], length)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """(m, s, doc_id) for each distinct segment of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for piece in pieces(batches):
            out_m, out_s, out_d = [], [], []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), raw(piece.column("text")), strict=True):
                for _, w in blocks(hashes((text or b"").split(), known), length):
                    s, first = np.unique(_signed(w.keys), return_index=True)
                    out_m.append(_signed(w.minimizers)[first])
                    out_s.append(s)
                    out_d.append(np.full(len(s), doc_id))
            if out_m:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_m, out_s, out_d)], names=["m", "s", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "m bigint, s bigint, doc_id bigint")


def window_rows(flagged: DataFrame, length: int) -> DataFrame:
    """(m, w, s, j, doc_id) for each window of the segments listed in ``segments`` of each row (doc_id, blob, segments)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for piece in pieces(batches, 64):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc_id, blob, wanted in zip(piece.column("doc_id").to_pylist(), piece.column("blob").to_pylist(), piece.column("segments").to_pylist(), strict=True):
                wanted = set(wanted)
                for _, w in blocks(hashes(unpack(blob).split(), known), length):
                    keys = _signed(w.keys).tolist()
                    for i in [i for i, k in enumerate(keys) if k in wanted]:
                        wanted.discard(keys[i])
                        a, b = int(w.starts[i]), int(w.ends[i])
                        for col, x in zip(cols, (np.full(b - a, w.minimizers[i]).view(np.int64), _signed(w.hashes(a, b)), np.full(b - a, keys[i]), np.arange(b - a, dtype=np.int32), np.full(b - a, doc_id)), strict=True):
                            col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], names=["m", "w", "s", "j", "doc_id"])

    return flagged.mapInArrow(run, "m bigint, w bigint, s bigint, j int, doc_id bigint")


def _cover(words: list[bytes], doc_id: int, verdicts: list[dict], length: int, known: Lookup) -> np.ndarray:
    """Which words lie in a window that a document of smaller doc_id has."""
    hit = np.zeros(len(words) + 1, np.int64)
    of = {v["s"]: v for v in verdicts}
    for at, w in blocks(hashes(words, known), length):
        for a, b, key in zip(w.starts.tolist(), w.ends.tolist(), _signed(w.keys).tolist(), strict=True):
            if (v := of.get(key)) is None:
                continue
            if v["first_doc"] < doc_id:
                runs = [(a, b)]
            else:
                runs = [(a + j, a + j + 1) for j, d in zip(v["offsets"] or (), v["docs"] or (), strict=True) if d < doc_id]
            for x, y in runs:
                hit[at + x] += 1
                hit[at + y + length - 1] -= 1
    return np.cumsum(hit[:-1]) > 0


def find_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per document with repeated windows: doc_id and the list of its segments' verdicts."""
    segs = materialize(segment_rows(docs, length), "segments")
    # minimizers of two documents or more; the others settle nothing
    # each aggregate is written before it is joined: both sides of a join then come from an exchange of their own, of which
    # Spark splits a hot minimizer's partition
    shared = materialize(segs.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("m"), "shared")
    segs = materialize(segs.join(shared, "m", "left_semi"), "shared-segments")
    distinct = materialize(segs.groupBy("m", "s").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")), "distinct-segments")
    readings = materialize(distinct.groupBy("m").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a < b").select("m"), "differing")
    # where readings differ, the first document of each sends its single windows
    wanted = materialize(distinct.join(readings, "m", "left_semi").groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_set("s").alias("segments")), "readings")
    windows = materialize(window_rows(packed_texts(docs).join(wanted, "doc_id"), length), "windows")
    earliest = materialize(windows.groupBy("m", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("m", "w", "lo"), "earliest")
    extras = windows.join(earliest, ["m", "w"]).filter("lo < doc_id").groupBy("m", "s").agg(F.collect_list(F.struct("j", "lo")).alias("x"))  # a segment has at most length - 7 windows
    verdicts = distinct.join(extras.select("m", "s", F.col("x.j").alias("offsets"), F.col("x.lo").alias("docs")), ["m", "s"], "left")
    verdicts = materialize(verdicts.filter("first_doc < last_doc or offsets is not null").drop("last_doc"), "segment-verdicts")
    return (
        segs.join(verdicts, ["m", "s"])
        .filter("first_doc < doc_id or offsets is not null")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("s", "first_doc", "offsets", "docs")).alias("verdicts"))
    )


def dedup(docs: DataFrame, length: int = 50, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns ``carry``, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept_text: the
    kept words joined by one space, or the text itself if it lost none.

    Words are runs without ASCII white space; a null or empty text has none. Texts shorter than the window lose nothing.
    Rows of one doc_id, and rows without one, are never each other's earlier document; rows without a doc_id keep all
    words. Windows are judged on the input.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for piece in pieces(batches, 64):
            n, gone, sha, texts = [], [], [], []
            for doc_id, blob, verdicts in zip(piece.column("doc_id").to_pylist(), piece.column("blob").to_pylist(), piece.column("verdicts").to_pylist(), strict=True):
                words = unpack(blob).split()
                kept = words
                if verdicts:
                    hit = _cover(words, doc_id, verdicts, length, known)
                    kept = [w for w, h in zip(words, hit.tolist(), strict=True) if not h]
                joined = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                # a text that lost nothing keeps its own white space
                texts.append((joined if len(kept) < len(words) else unpack(blob)).decode() if keep_text and blob is not None else None)
            cols = [*(piece.column(c) for c in ("doc_id", *carry)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(texts, pa.string())] if keep_text else [])], names=["doc_id", *carry, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])])

    named = docs.filter("doc_id is not null")
    joined = packed_texts(docs, "doc_id", "text", *carry).join(find_repeats(named, length), "doc_id", "left")
    kind = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *carry))
    return joined.select("doc_id", *carry, "blob", "verdicts").mapInArrow(run, f"{kind}n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else ""))
