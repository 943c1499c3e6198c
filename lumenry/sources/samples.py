"""Generated points for tests and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.model import FIELD


def random_points(spark: SparkSession, rows: int, tags: int = 4, fields: int = 8, value_length: int = 10, seed: int = 1) -> DataFrame:
    """Points with fixed keys: fields 1 and 2 are doubles, 3 to 5 strings, 6 and 7 booleans, the others integers."""
    df = spark.range(rows)
    text = lambda salt: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{salt}-{seed}")), 256), 1, value_length)
    number = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(1_000_000))

    def value(i: int):
        members = {"f": number(i) / 1000.0} if i in (1, 2) else {"s": text(f"f{i}")} if i in (3, 4, 5) else {"b": number(i) % 2 == 0} if i in (6, 7) else {"i": number(i)}
        kinds = {"i": "bigint", "u": "decimal(20,0)", "f": "double", "b": "boolean", "d": "binary", "s": "string"}
        return F.struct(*(members.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items())).cast(FIELD)

    tag_map = F.create_map(*(x for i in range(tags) for x in (F.lit(f"tag{i}"), text(f"t{i}"))))
    field_map = F.create_map(*(x for i in range(1, fields + 1) for x in (F.lit(f"field{i}"), value(i))))
    return df.select(F.lit("random").alias("name"), (F.lit(1_700_000_000_000_000_000) + F.col("id")).alias("time_ns"), tag_map.alias("tags"), field_map.alias("fields"))
