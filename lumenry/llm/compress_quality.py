"""A quality score from compression: which of two dictionaries, of good or of bad text, shortens a document more.

zstandard dictionaries are trained on the whole texts of a bounded sample of labelled documents. A text is compressed with
each, in blocks so short that the dictionary rather than the text before decides how small they get. The difference of the
sizes divided by the text's length is the only feature, the same for training and scoring and at any length. A logistic
curve, fitted on labelled documents that the dictionaries weren't built from, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import least_hashes, materialize, pieces, raw

#: Labelled documents per class that training sees at most, and the size of a dictionary.
TRAIN_ROWS, DICTIONARY_BYTES = 1500, 96 << 10
#: Bytes of the segments that a dictionary is made of, and of the strings whose frequency chooses them.
SEGMENT_BYTES, STRING_BYTES = 200, 8
LEVEL = 3
#: Bytes of a text that are compressed at once; sizes are summed over its blocks. And the bytes of a training sample.
BLOCK, TRAIN_BLOCK = 1 << 10, 1 << 17


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def start(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        def with_dictionary(data: bytes) -> zstandard.ZstdCompressor:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)

        self.good, self.bad = with_dictionary(model.good), with_dictionary(model.bad)
        self.weights = model.weights

    def features(self, text: bytes) -> np.ndarray:
        blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        difference = sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in blocks)
        return np.array([1.0, 10 * difference / max(1, len(text))])

    def score(self, text: bytes | None) -> float:
        if len(self.weights) == 0:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.weights @ self.features(text or b""), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps for a logistic curve; ``weight`` says how much each row counts."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary's content of at most DICTIONARY_BYTES, from the whole texts: all of them if they fit, else the segments
    whose strings are the most frequent."""
    if sum(map(len, texts)) + len(texts) <= DICTIONARY_BYTES:
        return b"\n".join(texts).rjust(8, b"\n")
    samples = [t[at : at + TRAIN_BLOCK] for t in texts for at in range(0, len(t), TRAIN_BLOCK)]  # the trainer's own bound is on a sample
    samples = [s for s in samples if len(s) >= STRING_BYTES]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT_BYTES, d=STRING_BYTES).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: stretches at even distances over all the texts
        whole = b"\n".join(texts)
        n = DICTIONARY_BYTES // SEGMENT_BYTES
        return b"".join(whole[at : at + SEGMENT_BYTES] for at in (i * (len(whole) - SEGMENT_BYTES) // (n - 1) for i in range(n)))


def _known(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", "label").distinct()


def count_labels(docs: DataFrame, labels: DataFrame) -> dict[int, int]:
    """Rows of ``docs`` with text that the labels (doc_id, label) call 0 and 1, over the whole tables; only ids move."""
    return _counts(docs.filter("text is not null").select("doc_id").join(_known(labels), "doc_id"))


def _counts(rows: DataFrame) -> dict[int, int]:
    return {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}


def _train(table: pa.Table) -> pa.Table:
    """A label's dictionary, from its rows (label, r, text)."""
    texts = table.sort_by("r").column("text").cast(pa.binary()).to_pylist()
    return pa.table({"label": table.column("label")[:1], "content": pa.array([dictionary(texts)], pa.binary())})


def sample_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` of the labels (doc_id, label) 0 and 1 each, those of the least id hashes: so few that their join
    with the documents moves no text."""
    low, chosen = least_hashes(_known(labels).withColumn("h", F.xxhash64("doc_id")), "label", rows)
    return low.join(chosen, ["label", "h"], "left_semi").select("doc_id", "label")


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, totals: dict[int, int] | None = None) -> Model:
    """Train on at most ``rows`` different texts of the rows (text, label) of each label 0 and 1, those of the least hashes.

    Of each class, half of the sample makes the dictionary and the other half the curve, in which each class counts as
    much as its rows in ``totals`` (those of ``labelled`` if not given, which may be a sample): the score's prior is that
    of all labelled rows at any size. Rows with another label or null text play no part; a text with both labels is
    learned as both. Without two texts of each label the score is 0.5 for every text.
    """
    known = labelled.filter("text is not null and label in (0, 1)").select(F.col("label").cast("int").alias("label"), F.xxhash64("text").alias("h"), "text")
    low, chosen = least_hashes(known, "label", rows)
    best = materialize(low.join(chosen, ["label", "h"]).dropDuplicates(["label", "h"]).select("label", "r", "text"), "quality-sample")
    taken = _counts(best)
    if min(taken.get(0, 0), taken.get(1, 0)) < 2:
        return Model(b"\n" * 8, b"\n" * 8, np.zeros(0))
    made = dict(best.filter("r % 2 = 1").groupBy("label").applyInArrow(_train, "label int, content binary").collect())  # half a sample each
    model = Model(bytes(made[1]), bytes(made[0]), np.zeros(1))
    shared = known.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value.start()
        for piece in pieces(batches):
            got = [tool.features(t).tolist() for t in raw(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("label"), piece.column("r"), pa.array(got, pa.list_(pa.float64()))], names=["label", "r", "x"])

    rest = sorted(best.filter("r % 2 = 0").mapInArrow(measure, "label int, r int, x array<double>").collect())  # no text comes to the driver
    x, y = np.array([r["x"] for r in rest]), np.array([float(r["label"]) for r in rest])
    totals = _counts(known) if totals is None else totals
    share = np.array([totals[0] / (y == 0).sum(), totals[1] / (y == 1).sum()])[y.astype(int)]
    model.weights = _logistic(x, y, weight=share * len(y) / share.sum())
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, *carry: str) -> DataFrame:
    """doc_id, the columns ``carry``, score (0 to 1) and predicted (1 if score >= threshold), from the whole text alone.

    Null text counts as empty text, which has a score too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    names = ["doc_id", *carry]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.start()
        for piece in pieces(batches):
            got = [own.score(t) for t in raw(piece.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(got, pa.float64()), pa.array([int(g >= threshold) for g in got], pa.int32())], names=[*names, "score", "predicted"])

    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, f"{kind}, score double, predicted int")
