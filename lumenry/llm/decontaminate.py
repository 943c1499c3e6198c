"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items are taken in blocks of a bounded number of words, one automaton each, so what is broadcast has a proven size. A
benchmark of one block is one pass over the documents, without a shuffle. With more blocks, each is a pass of its own that
writes what it found and drops its automaton before the next; a last pass joins the findings. Within a pass, a document's
words become numbers (words of no item become -1), vectorised look-ups of item word pairs leave the runs that could hold a
window, and those runs are streamed through the automaton, which tracks the longest match that ends at each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import materialize, pieces, raw

#: Words of items in one automaton: at most twice as many states, a few hundred bytes each.
BLOCK_WORDS = 50_000
#: Bytes that end words: all ASCII but digits and lower-case letters.
_SEPARATORS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return (text or b"").lower().translate(_SEPARATORS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over numbered words, with the items of each state's strings."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        for code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.whole: list[list[int]] = [[] for _ in self.next]  # short items that end a state's strings
        for i, code in enumerate(coded):
            state = 0
            for c in code:
                state = self.next[state][c]
                at = state
                while at > 0 and i not in self.items[at]:
                    self.items[at].add(i)
                    at = self.link[at]
            if 0 < len(code) < window:
                self.whole[state].append(i)
        self.sizes = [len(c) for c in coded]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.whole[state] = sorted({i for i in self.whole[state]} | set(self.whole[self.link[state]]), key=self.sizes.__getitem__)
        base = len(self.number) + 1
        self.base = base
        self.pairs = np.unique(np.array([a * base + b for c in coded for a, b in zip(c, c[1:], strict=False)], np.int64))
        self.least = min([window, *(n for n in self.sizes if n)])
        self._window_state: dict[int, int] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        now = self._new(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return now

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _of_window(self, state: int) -> int:
        """The state of a match's last ``window`` words."""
        if (found := self._window_state.get(state)) is None:
            found = state
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self._window_state[state] = found
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of occurring windows in a text's words, and the items that have them."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(words) < self.least:
            return spans, found
        get = self.number.get
        code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if self.least == 1:
            good = code >= 0
        else:
            keys = code[:-1] * self.base + code[1:]
            keys[(code[:-1] < 0) | (code[1:] < 0)] = -1
            at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
            good = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            end = b if self.least == 1 else b + 1
            if end - a >= self.least:
                self._stream(code[a:end].tolist(), a, spans, found)
        return spans, found

    def _stream(self, code: list[int], offset: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(code, offset + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= window:
                if spans and spans[-1][1] == i - 1 and spans[-1][0] <= i - window:
                    spans[-1] = (spans[-1][0], i)
                else:
                    spans.append((i - window, i))
                found |= self.items[self._of_window(state)]
            at = state
            if self.whole[at]:
                for item in self.whole[at]:
                    if self.sizes[item] <= matched:
                        spans.append((i - self.sizes[item], i))
                        found.add(item)


def item_blocks(benchmark: DataFrame, window: int) -> Iterator[SuffixAutomaton]:
    """Automata of the items, BLOCK_WORDS words each; a longer item is cut into overlapping stretches of that size.

    Items come to the driver block by block. Rows of one item_id are one item; rows without a word play no part.
    """
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "utf-8").alias("text")).filter("item_id is not null and text is not null").orderBy("item_id").toLocalIterator()
    for row in rows:
        words = words_of(bytes(row["text"]))
        for at in range(0, max(1, len(words) - window + 1), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS + window - 1]
            if not part:
                continue
            held.append((row["item_id"], part))
            size += len(part)
            if size >= BLOCK_WORDS:
                yield SuffixAutomaton(held, window)
                held, size = [], 0
    if held:
        yield SuffixAutomaton(held, window)


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<a: int, b: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _kind(docs: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of 128 bits of doc_id and text: repeated ids with other texts are other documents."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", "doc_id", F.lit(7)))


def _found(docs: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """(k1, k2, spans, items) of the documents (doc_id, text) with hits of one automaton, as a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # at most BLOCK_WORDS words and one item

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for piece in pieces(batches):
            rows, spans, items = [], [], []
            for k, text in enumerate(raw(piece.column("text"))):
                got, found = own.scan(words_of(text))
                if found:
                    rows.append(k)
                    spans.append([{"a": a, "b": b} for a, b in _merged(got)])
                    items.append(sorted(own.names[i] for i in found))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("k1").take(at), piece.column("k2").take(at), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])

    out = materialize(_keyed(docs.select("doc_id", "text")).select("k1", "k2", "text").mapInArrow(run, f"k1 bigint, k2 bigint, spans {_SPANS}, items array<string>"), "hits")
    shared.destroy()
    return out


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_hit: float = 1.0, carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """``docs`` as doc_id, the columns ``carry``, ``spans`` (word spans of occurring windows), ``items`` (sorted item_ids
    found), ``n_words`` and, with ``keep_text``, kept_text."""
    names = ["doc_id", *carry]
    automata = item_blocks(benchmark, window)
    now, following = next(automata, None), next(automata, None)
    rows, shared = docs.select(*names, "text"), None
    if following is None:
        shared = docs.sparkSession.sparkContext.broadcast(now)
    else:
        hits = _found(docs, now)
        while following is not None:
            now, following = following, next(automata, None)
            hits = hits.union(_found(docs, now))
        # the sets of equal rows are equal, and what is gathered is a document's own findings
        hits = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        rows = _keyed(rows).join(materialize(hits, "hits"), ["k1", "k2"], "left").select(*names, "text", "spans", "items")
    kind = f"{_kind(docs, names)}spans {_SPANS}, items array<string>, n_words bigint{', kept_text string' if keep_text else ''}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value if shared else None
        for piece in pieces(batches):
            n, spans, items, texts = [], [], [], []
            given = zip(piece.column("spans").to_pylist(), piece.column("items").to_pylist(), strict=True) if "spans" in piece.schema.names else None
            for text in raw(piece.column("text")):
                words = words_of(text)
                if given:
                    had, ids = next(given)
                    got, found = ((s["a"], s["b"]) for s in had or ()), set(ids or ())
                else:
                    got, at = own.scan(words) if own else ((), ())
                    found = {own.names[i] for i in at}
                got = _merged(got)
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in got])
                items.append(sorted(found))
                if keep_text:
                    over = sum(b - a for a, b in got) > most_hit * len(words)
                    texts.append(None if text is None or over else cut(text, text.lower().translate(_SEPARATORS), got))
            columns = [*(piece.column(c) for c in names), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string())), pa.array(n, pa.int64()), *([pa.array(texts, pa.string())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "spans", "items", "n_words", *(["kept_text"] if keep_text else [])])

    return rows.mapInArrow(run, kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_hit: float = 1.0, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns ``carry``, n_words, n_hit, n_items, items_sha256, contaminated and, with ``keep_text``, kept_text.

    A word is hit inside any occurrence of a window: ``window`` consecutive words of an item, or a shorter item whole.
    ``kept_text`` is the text without its hit spans, each from its first word to its last, or null if over ``most_hit``
    of the words are hit. Null text has no words and stays null; an empty benchmark hits nothing; items without an
    item_id or text play no part; repeated rows give a row each.
    """
    found = find_spans(docs, benchmark, window, most_hit, carry, keep_text)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    texts = ["kept_text"] if keep_text else []
    return found.select("doc_id", *carry, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), *texts)


def cut(text: bytes, low: bytes, spans: list[tuple[int, int]]) -> str:
    """``text`` without the stretches of its word spans; ``low`` has a space for each byte that is in no word."""
    if not spans:
        return text.decode()
    bytes_of = np.frombuffer(low, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], bytes_of.view(np.int8), [0]))))
    firsts, lasts = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : firsts[a]])
        at = lasts[b - 1]
    out.append(text[at:])
    return b"".join(out).decode()
