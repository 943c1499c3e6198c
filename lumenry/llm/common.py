"""What the training-data operators share: shared-folder tables, Arrow slices, hashing and column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_ROWS = 256
#: Distinct keys a worker's lookup table holds before it starts over; bounds its memory.
CACHE_KEYS = 150_000

try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not the GNU C library
    _malloc_trim = None
_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where that is unset, a temporary one in local mode and an error else."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="lumenry-"))
        base = _own_dir[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lumenry/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later uses survive the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended, or the store is gone: the other paths may still be there
            continue


atexit.register(_remove_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What operators keep in a worker process from task to task: how to let go of it, by owner.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, let_go: Callable[[], None]) -> None:
    """Have ``let_go`` called when a task of another operator starts in this process."""
    _kept[owner] = let_go


def pieces(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that Python objects of few rows exist at once. Workers are used again by later stages,
    so what other owners have kept in this process goes first."""
    for other in [x for x in _kept if x != owner]:
        _kept.pop(other)()
    give_back()
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, which otherwise counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


class Lookup(dict):
    """A dict that computes missing values. Beyond ``most`` keys it becomes the older of two generations and starts
    over, keeping what is met again: memory is bounded and frequent keys stay."""

    def __init__(self, make: Callable, most: int = CACHE_KEYS) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def word_hashes() -> Lookup:
    """64-bit hashes of words given as bytes."""
    return Lookup(xxhash.xxh3_64_intdigest)


def hashes(words: list[bytes], of: Lookup) -> np.ndarray:
    return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def least_hashes(rows: DataFrame, by: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` with a hash ``h``, those with low hashes, and (``by``, h) of the ``n`` least different hashes of each ``by``.

    Ranking takes hashes alone, and of these only those below a bound that leaves about twice ``n`` of each ``by``, so
    few rows meet however large the input or a group is. The second is a written table of at most ``n`` rows a group.
    """
    counts = rows.groupBy(by).agg(F.approx_count_distinct("h").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * n + 50) / F.col("n"))
    bounds = materialize(counts.select(by, (share * float(1 << 63) * 2 - float(1 << 63)).alias("bound")), "bounds")  # a row for each group
    low = rows.join(bounds, by).filter(F.col("h").cast("double") <= F.col("bound")).drop("bound")
    ranked = low.select(by, "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("h")))
    return low, materialize(ranked.filter(F.col("r") <= n).select(by, "h", "r"), "least-hashes")
