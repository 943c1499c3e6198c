"""Language identification in two steps: the family, then the language within it.

Texts are counted as hashed letter n-grams (2 to 4 bytes of the letters, other characters being one space). Linear support
vector machines are trained by stochastic sub-gradient steps on the squared hinge loss: one for each family, against the
others, and within a family one for each two of its languages, which vote. A bounded sample of labelled documents, the same
number of different texts for each language at most and each text whole, is all that training sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import least_hashes, pieces, raw

UNDETERMINED = "und"
#: Different labelled texts per language that training sees at most.
TRAIN_ROWS = 400
BUCKETS = 1 << 14
#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "sinitic": ("zh", "yue"),
}
_OTHER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LETTER, _ASCII_LETTER = re.compile(r"[^\W\d_]"), re.compile(rb"[A-Za-z]")
_MARKS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
#: Bytes of a text that are counted at once.
BLOCK = 1 << 20


def features(text: bytes) -> np.ndarray:
    """Square roots of n-gram counts at unit length; runs of non-letters count as one space."""
    counts = np.zeros(BUCKETS)
    letters = np.frombuffer(b" " + b" ".join(text.translate(_OTHER).split()) + b" ", np.uint8)
    for at in range(0, len(letters), BLOCK):
        b = letters[at : at + BLOCK + len(_MARKS)].astype(np.uint32)  # with the ends of the n-grams that start in the block
        key = b
        for n, mark in enumerate(_MARKS, 1):
            if len(b) <= n:
                break
            key = key[:-1] * np.uint32(0x01000193) + b[n:] * mark
            counts += np.bincount((((key ^ (key >> np.uint32(15))) * mark) >> np.uint32(18))[:BLOCK], minlength=BUCKETS)
    counts = np.sqrt(counts)
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for labels of -1 and 1, both sides weighted alike; averaged over the last half."""
    w, bias, order = np.zeros(x.shape[1]), 0.0, np.random.default_rng(7)
    mean_w, mean_b, taken = np.zeros_like(w), 0.0, 0
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    for epoch in range(epochs):
        rate = 1.0 / (1 + epoch)
        for i in order.permutation(len(y)):
            slack = 1 - y[i] * (x[i] @ w + bias)
            w *= 1 - rate * penalty
            if slack > 0:
                step = rate * weight[i] * slack * y[i]
                w += step * x[i]
                bias += 0.1 * step
        if epoch >= epochs // 2:
            mean_w, mean_b, taken = mean_w + w, mean_b + bias, taken + 1
    return mean_w / max(1, taken), mean_b / max(1, taken)


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    weights: np.ndarray  # a row for each family, then for each two languages of each family, first against second
    bias: np.ndarray

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return UNDETERMINED, 0.0
        margins = self.weights @ features(text) + self.bias
        f = int(np.argmax(margins[: len(self.families)]))
        shares = np.exp(3 * (margins[: len(self.families)] - margins[f]))
        at = len(self.families) + sum(len(m) * (len(m) - 1) // 2 for m in self.members[:f])
        own = self.members[f]
        if len(own) == 1:
            return own[0], float(1 / shares.sum())
        votes, chance = np.zeros(len(own)), np.zeros(len(own))
        for k, (i, j) in enumerate(combinations(range(len(own)), 2), at):
            p = 1 / (1 + np.exp(-3 * float(margins[k])))
            votes[i if margins[k] > 0 else j] += 1
            chance[i] += p
            chance[j] += 1 - p
        best = max(range(len(own)), key=lambda i: (votes[i], chance[i], -i))
        return own[best], float(chance[best] / (len(own) - 1) / shares.sum())


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode()))


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different texts (lang, h, text) of each language, those of the least hashes."""
    known = labelled.filter("text is not null and lang is not null and lang <> ''").select("lang", "text").withColumn("h", F.xxhash64("text"))
    low, chosen = least_hashes(known, "lang", rows)
    return low.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` different texts of each language of ``labelled`` (text, lang), whole.

    Rows without text or lang play no part; a text that occurs more than once is one. The driver gets the features of
    the sample, at most 4 * BUCKETS bytes of a text.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            at, of = [], []
            for text in raw(piece.column("text")):
                x = features(text)
                some = np.flatnonzero(x)
                at.append(some.astype(np.uint16).tobytes())
                of.append(x[some].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("h"), pa.array(at, pa.binary()), pa.array(of, pa.binary())], names=["lang", "h", "at", "of"])

    got = sorted(sample(labelled, rows).select("lang", "h", "text").mapInArrow(count, "lang string, h bigint, at binary, of binary").collect(), key=lambda r: (r["lang"], r["h"]))
    langs = sorted({r["lang"] for r in got})
    family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
    families = sorted({family_of.get(x, x) for x in langs})
    members = [[x for x in langs if family_of.get(x, x) == f] for f in families]
    if not langs:
        return Model([], [], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.float32))
    x, y = np.zeros((len(got), BUCKETS), np.float32), np.array([r["lang"] for r in got])
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["of"], np.float16)
    machines = [train_svm(x, np.where(np.isin(y, m), 1, -1)) if len(families) > 1 else (np.zeros(BUCKETS), 0.0) for m in members]
    for m in members:
        for one, other in combinations(m, 2):
            own = np.isin(y, (one, other))
            machines.append(train_svm(x[own], np.where(y[own] == one, 1, -1)))
    return Model(families, members, np.array([w for w, _ in machines], np.float32), np.array([b for _, b in machines], np.float32))


def predict(docs: DataFrame, model: Model, *carry: str, keep_text: bool = False) -> DataFrame:
    """doc_id, the columns ``carry``, with ``keep_text`` text, lang_pred and score, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs of languages of a family) * BUCKETS * 4 bytes
    names = ["doc_id", *carry]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for piece in pieces(batches):
            column = piece.column("_text")
            got = [own.predict(t) for t in raw(column)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *([column] if keep_text else []), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, *(["text"] if keep_text else []), "lang_pred", "score"])

    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, f"{kind}{', text string' if keep_text else ''}, lang_pred string, score double")
