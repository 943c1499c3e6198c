"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification, components.

Texts with equal shingle sets are one representative from the start. Banded signatures put representatives into buckets;
pairs of a bucket are compared signature batch by signature batch, and dropped once the posterior probability that their
similarity reaches the threshold is below ``miss``; survivors are verified on their full shingle sets.

No bucket expands into all its pairs. Star rounds come first: each member meets one leader of its bucket, the likeliest
leader of each is verified, and links merge components. Then only members of different components are left to compare,
each pair in the first bucket it shares. Of a bucket, the members outside its largest component, the minor ones, meet
all others in chunks of CHUNK members, so the rows dealt out are at most twice the bucket's as long as there are no more
minor ones than a chunk holds. A bucket with more minor ones is first keyed anew by each further band. Pairs that still
survive are verified in these chunks, the likeliest first, until links join their components.

What can be missed is ``miss`` for each batch, and pairs that share no band or, in buckets keyed anew, only one: for
similarity s, (1 - s**4)**40 and 40 * s**4 * (1 - s**4)**39, which at s = 0.8 are 7e-10 and 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import Lookup, hashes, materialize, mix, pieces, raw, word_hashes
from lumenry.llm.components import components
from lumenry.llm.texts import packed_texts, unpack

BANDS, BAND_ROWS, BATCH = 40, 4, 32
PERMUTATIONS = BANDS * BAND_ROWS
MISS = 1e-8
#: Members of a bucket that meet in one step, and star rounds before the others are compared.
CHUNK, STAR_ROUNDS = 1024, 2
#: Bytes of shingle sets that a task keeps at hand.
SETS_BYTES = 64 << 20
_random = np.random.default_rng(20240229)
MULTIPLY = _random.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
BAND_BASE = mix(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
BAND_SALT = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
_STEP = np.uint64(0xA24BAED4963EE407)


def shingles(words: list[bytes], size: int, known: Lookup) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``size`` are one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    h, k = hashes(words, known), min(size, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out * _STEP) ^ h[j : len(h) - k + 1 + j]
        out = mix(out)
    return np.unique(out)


class Signer:
    """Minima of ``PERMUTATIONS`` multiply-add hashes, in blocks so that long texts need little memory."""

    rows = 512

    def __init__(self) -> None:
        self.space = np.empty((self.rows, PERMUTATIONS), np.uint32)

    def signature(self, sets: np.ndarray) -> np.ndarray:
        low, short = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF)), (sets >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), self.rows):
            part = short[at : at + self.rows, None]
            space = self.space[: len(part)]
            np.multiply(part, MULTIPLY, out=space)
            space += ADD
            np.minimum(low, space.min(axis=0), out=low)
        return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return mix((low.astype(np.uint64).reshape(BANDS, BAND_ROWS) * BAND_BASE).sum(axis=1) ^ BAND_SALT).view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of batches seen, the least matching hashes whose posterior chance of reaching the threshold is ``miss``.

    Signatures keep 8 bits of a hash, so unequal minima agree once in 256. With a uniform prior,
    P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    t, out = threshold + (1 - threshold) / 256, []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, x1, x2, sig, bands) of all rows; the last four are null where there is no word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = word_hashes(), Signer()
        for piece in pieces(batches):
            n, x1, x2, sig, bands = [], [], [], [], []
            for text in raw(piece.column("text")):
                sets = shingles((text or b"").lower().split(), size, known)
                n.append(len(sets))
                if not len(sets):
                    x1.append(None), x2.append(None), sig.append(None), bands.append(None)
                    continue
                x1.append(int(mix(sets).sum().view(np.int64)))
                x2.append(int(mix(sets ^ _STEP).sum().view(np.int64)))
                low = signer.signature(sets)
                sig.append(low.astype(np.uint8).tobytes())
                bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "x1", "x2", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, x1 bigint, x2 bigint, sig binary, bands array<bigint>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)


def _survive(sig_a: np.ndarray, sig_b: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of rows ``a`` and ``b`` those that sequential comparison leaves, and their matching hashes."""
    matches = np.zeros(len(a), np.int64)
    for k, bound in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (sig_a[a, part] == sig_b[b, part]).sum(axis=1)
        keep = matches >= bound
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b, matches


def _alike(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes can be so similar."""
    return np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9


def prune(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, matches) of the pairs (a, b, sig_a, sig_b, n_a, n_b) that sequential comparison leaves."""
    least = least_matches(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 4096):
            if not piece.num_rows:
                continue
            live = np.nonzero(_alike(piece.column("n_a").to_numpy(), piece.column("n_b").to_numpy(), threshold))[0]
            live, _, matches = _survive(_matrix(piece.column("sig_a")), _matrix(piece.column("sig_b")), live, live, least)
            yield pa.RecordBatch.from_arrays([piece.column("a").take(pa.array(live)), piece.column("b").take(pa.array(live)), pa.array(matches)], names=["a", "b", "matches"])

    return pairs.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint, matches bigint")


def deal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of mixed buckets, dealt into chunks; and the buckets with more minor members than a chunk holds, as they are.

    A chunk (key, chunk) holds its own members (``home``) and all minor ones of the bucket (``minor``).
    """
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = per.groupBy("key").agg(F.max_by("comp", "n").alias("major"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("comps"))
    sizes = materialize(sizes.filter("comps > 1").drop("comps"), "sizes")
    sized = rows.join(sizes, "key").withColumn("minor", F.col("comp") != F.col("major"))
    heavy = sized.filter(F.col("size") - F.col("most") > CHUNK)
    return _chunks(sized.filter(F.col("size") - F.col("most") <= CHUNK)), heavy


def _chunks(sized: DataFrame) -> DataFrame:
    count = F.ceil(F.col("size") / CHUNK).cast("int")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), count).cast("int"))
    dealt = sized.withColumn("chunk", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), count - 1)).otherwise(F.array("own"))))
    return dealt.withColumn("home", F.col("own") == F.col("chunk")).drop("own", "size", "most", "major")


def rekeyed(heavy: DataFrame) -> DataFrame:
    """The rows once for each band after the bucket's own, with a key of both."""
    further = heavy.select("band", "doc_id", "comp", "n_shingles", "sig", "marks", F.col("key").alias("first"), F.posexplode("marks").alias("second", "mark")).filter("second > band")
    return further.select(F.xxhash64("first", "second", "mark").alias("key"), "band", "second", "doc_id", "comp", "n_shingles", "sig", "marks")


def across(dealt: DataFrame, threshold: float, exact: tuple[int, int] | None = None) -> DataFrame:
    """What sequential comparison leaves between different components of one bucket, never as all its pairs.

    ``dealt``: (key, chunk, home, minor, band, second, doc_id, comp, n_shingles, sig, marks). Without ``exact``, the rows
    (key, doc_id) that take part in any pair. With it, (shingle size, percent), the rows have texts as blob; pairs are
    verified on full shingle sets, the likeliest first, until links join their components: these links (a, b).
    """
    least = least_matches(threshold)

    def survivors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, comp, n = (t.column(c).to_numpy() for c in ("doc_id", "comp", "n_shingles"))
        minor, home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("minor", "home"))
        band, second = t.column("band")[0].as_py(), t.column("second")[0].as_py()
        sig, marks = _matrix(t.column("sig")), t.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        earlier = [j for j in range(band if second is None else second) if j != band]
        left, right = np.nonzero(minor)[0], np.nonzero(home)[0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            ok = (comp[rows, None] != comp[right]) & _alike(n[rows, None], n[right], threshold) & (~minor[right] | (doc[rows, None] < doc[right]))
            a, b = np.nonzero(ok)
            a, b, matches = _survive(sig, sig, rows[a], right[b], least)
            first = ~(marks[np.ix_(np.unique(a), earlier)][np.searchsorted(np.unique(a), a)] == marks[b][:, earlier]).any(axis=1)  # not met in an earlier bucket
            found.append((a[first], b[first], matches[first]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def compare(group: list[pa.RecordBatch], known: Lookup) -> pa.RecordBatch:
        t = pa.Table.from_batches(group).combine_chunks()
        a, b, matches = survivors(t)
        doc, comp = t.column("doc_id").to_numpy(), t.column("comp").to_numpy()
        if not exact:
            seen = np.unique(doc[np.concatenate((a, b))])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), t.column("key")[0].as_py())), pa.array(seen)], names=["key", "doc_id"])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        sets: dict[int, np.ndarray] = {}
        held = 0

        def shingled(row: int) -> np.ndarray:
            nonlocal held
            if (got := sets.get(row)) is None:
                got = shingles(unpack(t.column("blob")[row].as_py()).lower().split(), exact[0], known)
                if held > SETS_BYTES:
                    sets.clear()
                    held = 0
                sets[row] = got
                held += got.nbytes
            return got

        out: list[tuple[int, int]] = []
        for k in np.argsort(-matches, kind="stable").tolist():
            p, q = find(int(comp[a[k]])), find(int(comp[b[k]]))
            if p != q and _linked(shingled(int(a[k])), shingled(int(b[k])), exact[1]):
                root[max(p, q)] = min(p, q)
                out.append((int(doc[a[k]]), int(doc[b[k]])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, known = None, word_hashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [np.asarray(batch.column(c)) for c in ("key", "chunk")]
            cuts = [0, *(np.nonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0))[0] + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                mark = tuple(int(m[x]) for m in marks)
                if held and mark != last:
                    yield compare(held, known)
                    held = []
                held.append(batch.slice(x, y - x))
                last = mark
        if held:
            yield compare(held, known)

    return dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, "a bigint, b bigint" if exact else "key bigint, doc_id bigint")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common) > 0


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs``, on full shingle sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        recent: dict[int, tuple[bytes, np.ndarray]] = {}

        def of(doc: int, blob: bytes) -> np.ndarray:
            if (got := recent.get(doc)) is None or got[0] != blob:
                if len(recent) >= 16:
                    recent.clear()
                recent[doc] = got = (blob, shingles(unpack(blob).lower().split(), size, known))
            return got[1]

        for piece in pieces(batches, 64):
            a, b = piece.column("a").to_pylist(), piece.column("b").to_pylist()
            ok = []
            for p, q, s, t in zip(a, b, piece.column("blob_a").to_pylist(), piece.column("blob_b").to_pylist(), strict=True):
                ok.append(_linked(of(p, s), of(q, t), percent))
            keep = [k for k, good in enumerate(ok) if good]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    of_a, of_b = texts.toDF("a", "blob_a"), texts.toDF("b", "blob_b")
    return pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "blob_a", "blob_b").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable by links) and kept.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets. Null, empty and white texts have
    no set and are linked with nothing; a row without a doc_id is kept and has no component; rows of one doc_id are one
    document. Other columns of ``docs`` play no part.
    """
    threshold = percent / 100
    every = materialize(sketches(docs, size), "sketches")
    full = every.filter("sig is not null and doc_id is not null")
    copies = materialize(full.groupBy("x1", "x2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    alone = full.join(copies, ["x1", "x2"], "left").filter("rep is null or rep = doc_id")
    reps = materialize(alone.select("doc_id", "n_shingles", "sig", "bands").distinct(), "representatives")
    rows = materialize(reps.select("doc_id", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last").drop("last"), "buckets")
    members = materialize(rows.join(buckets, "key"), "members")
    involved = members.select("doc_id").distinct()
    marks = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("marks")
    signs = materialize(reps.join(involved, "doc_id", "left_semi").select("doc_id", "n_shingles", "sig", marks), "signatures")
    texts = materialize(packed_texts(docs.filter("doc_id is not null")).join(involved, "doc_id", "left_semi"), "texts")

    def star(pairs: DataFrame) -> DataFrame:
        """Verified links of members with the likeliest of their leaders."""
        of_a, of_b = (signs.select("doc_id", "n_shingles", "sig").toDF(x, f"n_{x}", f"sig_{x}") for x in "ab")
        likely = prune(pairs.distinct().join(of_a, "a").join(of_b, "b"), threshold).groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
        return materialize(verify(likely, texts, size, percent), "links")

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components, and the members of buckets that still have several."""
        labels = materialize(components(links), "labels")
        own = labels.select(F.col("node").alias("doc_id"), "component")
        known = materialize(members.select("key", "band", "doc_id").join(own, "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("comp")), "labelled")
        several = materialize(known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key"), "several")
        return labels, materialize(known.join(several, "key", "left_semi"), "mixed")

    links = star(members.filter("leader < doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))
    labels, mixed = labelled(links)
    for k in range(1, STAR_ROUNDS):
        by = F.xxhash64("key", "doc_id", F.lit(k))  # another leader in each bucket
        leaders = materialize(mixed.groupBy("key").agg(F.min_by("doc_id", by).alias("a"), F.min_by("comp", by).alias("of")), "leaders")
        more = star(mixed.join(leaders, "key").filter("comp <> of").select("a", F.col("doc_id").alias("b")))
        if more.isEmpty():
            break
        links = links.union(more)
        labels, mixed = labelled(links)
    rows = mixed.join(signs, "doc_id").withColumn("second", F.lit(None).cast("int"))
    dealt, heavy = deal(rows)
    dealt = materialize(dealt, "dealt")
    heavy = materialize(heavy, "heavy")
    if not heavy.isEmpty():
        light, still = deal(rekeyed(heavy))
        dealt = materialize(dealt.unionByName(light).unionByName(_chunks(still)), "dealt")
    who = materialize(across(dealt, threshold).distinct(), "who")
    if not who.isEmpty():
        chosen = dealt.join(who, ["key", "doc_id"], "left_semi").join(texts, "doc_id")
        more = materialize(across(chosen, threshold, (size, percent)).distinct(), "links")
        if not more.isEmpty():
            labels = materialize(components(links.union(more)), "labels")
    # every text's representative, then that one's component
    found = full.select("doc_id", "n_shingles", "x1", "x2").join(copies, ["x1", "x2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    found = found.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    others = every.filter("sig is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
