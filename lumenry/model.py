"""The point model: a row is a measurement with string tags, typed fields and a time in nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<i: bigint, u: decimal(20,0), f: double, b: boolean, d: binary, s: string>"
POINTS = f"token string, category string, name string, time_ns bigint, ts timestamp, tags map<string, string>, fields map<string, {FIELD}>, warns array<struct<type: string, msg: string>>"
#: Data categories and their short names.
CATEGORIES = {
    "metric": "M", "network": "N", "keyevent": "E", "object": "O", "object_change": "OCH", "custom_object": "CO", "logging": "L", "tracing": "T",
    "rum": "R", "security": "S", "profiling": "P", "dialtesting": "DT", "dynamic": "DYNAMIC", "event_log": "EL", "llm": "LLM", "agent_llm": "AL",
}
_MEMBERS = {"bigint": "i", "int": "i", "smallint": "i", "tinyint": "i", "double": "f", "float": "f", "boolean": "b", "binary": "d", "string": "s"}


def field_value(column: Column, kind: str) -> Column:
    """A field struct with one member set."""
    member = "u" if kind.startswith("decimal") else _MEMBERS[kind]
    types = dict(x.strip().split(": ") for x in FIELD[len("struct<") : -1].replace("decimal(20,0)", "decimal(20;0)").split(","))
    cast = {k: v.replace(";", ",") for k, v in types.items()}
    return F.when(column.isNotNull(), F.struct(*((column if k == member else F.lit(None)).cast(v).alias(k) for k, v in cast.items())))


def to_points(df: DataFrame, name: str | Column, time: str, tags: list[str], fields: list[str], category: str = "metric") -> DataFrame:
    """A typed DataFrame as points; null tags and fields are absent keys."""
    kinds = dict(df.dtypes)
    tag_map = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(t).alias("key"), F.col(t).cast("string").alias("value")) for t in tags)), lambda e: e["value"].isNotNull())) if tags else F.expr("cast(map() as map<string,string>)")
    entries = F.array(*(F.struct(F.lit(f).alias("key"), field_value(F.col(f), kinds[f]).alias("value")) for f in fields))
    field_map = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    micros = epoch_micros(F.col(time))
    return df.select(
        F.lit(None).cast("string").alias("token"), F.lit(category).alias("category"), (F.col(name) if isinstance(name, str) else name).alias("name"), (micros * 1000).alias("time_ns"), F.timestamp_micros(micros).alias("ts"),
        tag_map.alias("tags"), field_map.alias("fields"), F.expr("cast(array() as array<struct<type: string, msg: string>>)").alias("warns"),
    )


def widen(points: DataFrame, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """Points as typed columns: name, time_ns, the tags, and the fields with their kinds (i, u, f, b, d or s)."""
    return points.select("name", "time_ns", *(F.try_element_at("tags", F.lit(t)).alias(t) for t in tags), *(F.try_element_at("fields", F.lit(f))[k].alias(f) for f, k in fields.items()))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))
