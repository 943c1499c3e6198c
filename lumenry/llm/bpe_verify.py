"""Byte-pair encoding by speculation: greedy longest matches, pair checks, and exact merging of what fails.

A token sequence is the encoding of its text exactly if every token and every adjacent pair is the encoding of its own
bytes. So the greedy longest-match tokens of a word are proposed, all adjacent pairs of all new words are tested in
one vectorised step by undoing their merges against a table of all merges, and only words with a failing pair are merged
rank by rank. Decoding goes from ids to bytes to text, with U+FFFD for what isn't UTF-8.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenry.llm.common import keep, pieces

#: The pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of each of two generations of a worker's table, and pre-tokens of another, about 200 bytes each.
KNOWN_CHUNKS, KNOWN_PARTS = 250_000, 250_000
#: Characters beyond which a chunk or pre-token isn't kept.
LONG = 128
#: Bytes up to which merging scans rather than keeps a heap.
SHORT = 32


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable Latin-1, else the next code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}


class SpeculativeBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    _chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+")

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        self.size = max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        special = set(self.special.values())
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if i not in special and b}
        self.longest = max(map(len, self.id_of))
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge_of[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        self.text_of = [str(i) for i in range(self.size)]
        self.split = regex.compile(PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.failed = 0
        # ids as bytes, which take less memory than tuples and are joined at once
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.rank_of = {pair: rank for pair, (rank, _) in self.merge_of.items()}
        self.made_by = {rank: made for rank, made in self.merge_of.values()}
        self.byte_ids = [self.id_of[bytes([i])] for i in range(256)]
        self._fit_tables()

    def merge(self, data: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, with a heap over a linked list: n log n."""
        ids: list[int] = list(map(self.byte_ids.__getitem__, data))
        n = len(ids)
        if n <= SHORT:  # so few that a scan for each merge is faster
            get, never = self.rank_of.get, 1 << 60
            ranks = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (rank := min(ranks)) < never:
                i = ranks.index(rank)
                ids[i] = self.made_by[rank]
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), never)
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merge_of[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merge_of]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge_of[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in self.merge_of:
                    heapq.heappush(heap, (self.merge_of[p][0], x, *p))
        return [x for x in ids if x >= 0]

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest matches."""
        out, at, n, get = [], 0, len(data), self.sound.get
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := get(data[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of tokens as it is, for all pairs at once.

        Both tokens are undone merge by merge, the later one first; a pair fails if the two ends that then meet would
        have merged before the merge just undone. ``limit``: ranks from which a merge of the two whole tokens is late.
        """
        a, b, top = first.copy(), second.copy(), limit.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            keys = x * self.size + y
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            fails = (self.merge_keys[at] == keys) & (self.merge_ranks[at] < top[live])
            ok[live[fails]] = False
            rx, ry = self.rank[x], self.rank[y]
            live, x, y, rx, ry = (v[~fails & (np.maximum(rx, ry) >= 0)] for v in (live, x, y, rx, ry))
            left = rx > ry  # equal merges go from left to right, so the right one is the later
            a[live[left]], top[live[left]] = self.right[x[left]], rx[left]
            b[live[~left]], top[live[~left]] = self.left[y[~left]], ry[~left] + 1
        return ok

    def _fit_tables(self) -> None:
        """Arrays of all merges, and of the tokens that their own bytes encode to."""
        pairs = np.array(list(self.merge_of), np.int64).reshape(-1, 2)
        ranks, made = np.array(list(self.merge_of.values()), np.int64).reshape(-1, 2).T
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], ranks[order]
        self.rank, self.left, self.right = np.full(self.size, -1), np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        first = np.unique(made, return_index=True)[1]  # the earliest merge that makes a token
        self.rank[made[first]], self.left[made[first]], self.right[made[first]] = ranks[first], *pairs[first].T
        sound = np.ones(self.size, bool)
        sound[made[first]] = self.compatible(pairs[first][:, 0], pairs[first][:, 1], ranks[first])
        for t in made[first][np.argsort(ranks[first])].tolist():
            sound[t] &= sound[self.left[t]] & sound[self.right[t]]
        self.sound = {b: i for b, i in self.id_of.items() if sound[i] and (self.rank[i] >= 0 or len(b) == 1)}

    def learn(self, parts: list[str]) -> None:
        """Encode new pre-tokens together: propose, check all adjacent pairs at once, merge those that fail."""
        for at in range(0, len(parts), 20_000):
            block = parts[at : at + 20_000]
            data = [p.encode() for p in block]
            proposed = [self.propose(d) for d in data]
            sizes = np.fromiter(map(len, proposed), np.int64, len(block))
            flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
            word = np.repeat(np.arange(len(block)), sizes)
            inner = np.nonzero(word[1:] == word[:-1])[0]
            keys, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            ok = self.compatible(keys // self.size, keys % self.size, np.full(len(keys), 1 << 60))
            failing = np.zeros(len(block), bool)
            failing[word[inner[~ok[which]]]] = True
            self.failed += int(failing.sum())
            for p, d, ids, bad in zip(block, data, proposed, failing.tolist(), strict=True):
                self.parts[p] = array("i", self.merge(d) if bad else ids).tobytes()

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens; beyond Latin, where Unicode versions could differ, those of the library itself."""
        if chunk.isascii() or max(chunk) < "ɐ":
            body = chunk[1:] if chunk[0] == " " else chunk
            if body.isalpha():
                return [chunk]
            if body[:-1].isalpha() and body[-1] in ".,":
                return [chunk[:-1], body[-1]]
            return self.split.findall(chunk)
        from tokenizers import pre_tokenizers

        found = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(chunk)
        return [chunk[a:b] for _, (a, b) in found]

    def prepare(self, chunks: set[str]) -> None:
        """Have every chunk of a batch in the table. A full table becomes the older of two generations."""
        fresh = list(chunks - self.known.keys())
        if len(self.known) + len(fresh) > KNOWN_CHUNKS:
            self.known, self.older = {}, self.known
            fresh = list(chunks)
        old = self.older.keys() & set(fresh)
        self.known.update((c, self.older[c]) for c in old)
        fresh = [c for c in fresh if c not in old]
        for at in range(0, len(fresh), 20_000):
            split = [self._split(c) for c in fresh[at : at + 20_000]]
            needed = set(chain.from_iterable(split))
            missing = list(needed - self.parts.keys())
            if len(self.parts) + len(missing) > KNOWN_PARTS:
                self.parts = {p: self.parts[p] for p in needed & self.parts.keys()}
            self.learn(missing)
            parts = self.parts
            long = [p for p in missing if len(p) > LONG]
            for c, x in zip(fresh[at : at + 20_000], split, strict=True):
                self.known[c] = parts[x[0]] if len(x) == 1 else b"".join(map(parts.__getitem__, x))
            for p in long:
                del parts[p]

    def chunks(self, text: str) -> list[str]:
        """Pieces between which no pre-token reaches; special tokens stand alone."""
        sections = self.marks.split(text) if self.marks and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for s in sections:
            if s in self.special:
                out.append(s)
            elif any(c in s for c in "\x1c\x1d\x1e\x1f"):  # white space to re, not to the tokenizer
                out += self._split(s)
            else:
                out += self._chunks.findall(s)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = [self.chunks(t) for t in texts]
        needed = set().union(*split)
        gc.disable()  # many lists and no cycles
        try:
            self.prepare(needed - self.special.keys())
        finally:
            gc.enable()
        for special, i in self.special.items():
            self.known[special] = array("i", [i]).tobytes()
        for x in split:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, x)), np.int32)
        for long in [x for x in needed if len(x) > LONG]:
            self.known.pop(long, None)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def bpe(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


#: Characters of text that are encoded together.
BATCH_CHARS = 1 << 20


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_column(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` (doc_id, text) with token ids: doc_id, ids array<int>. Null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(tokenizer_path)
        keep("bpe", bpe.cache_clear)
        for piece in pieces(batches, owner="bpe"):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            ids = [x for block in _batches(texts) for x in own.encode_batch(block)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256 (decimal ids, comma-joined) and decoded_sha256.

    Null text is empty text; repeated rows give a row each; an empty table gives none. No shuffle, and memory is that of
    one slice of rows, its longest text included.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(tokenizer_path)
        keep("bpe", bpe.cache_clear)
        for piece in pieces(batches, owner="bpe"):
            n, a, b = [], [], []
            for block in _batches([t or "" for t in piece.column("text").to_pylist()]):
                for ids in map(np.ndarray.tolist, own.encode_batch(block)):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
