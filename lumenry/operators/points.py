"""Operators on points in map form: identity, editing, merging, validation and repair."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.scalar import adjust_kv, dots_to_underscores, trim_to

NO_NAME = "__default"


def _sorted_tags(tags: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], e["value"])), "")


def identity(name: Column, tags: Column) -> Column:
    """MD5 of name and sorted tags, without separators."""
    return F.md5(F.concat(name, _sorted_tags(tags)))


def identity_sha256(name: Column, tags: Column) -> Column:
    return F.sha2(F.concat(name, _sorted_tags(tags)), 256)


def time_series(points: DataFrame) -> DataFrame:
    """A row for each field: the point's columns, ``field`` and ``series``, the hash of identity and field key."""
    own = identity(F.col("name"), F.col("tags"))
    return points.withColumn("field", F.explode(F.map_keys("fields"))).withColumn("series", F.md5(F.concat(own, "field")))


def merge_by_identity(points: DataFrame, seq: str | None = None) -> DataFrame:
    """Points of equal name, tags and time as one; points that stand alone stay.

    Of a field's values that of the least ``seq`` wins, a column that says in which order the points came; without one the
    least value wins, so that the result doesn't depend on how rows are partitioned.
    """
    order = F.struct(F.col(seq), F.col("value")) if seq else F.col("value")
    entries = points.select("name", "time_ns", "tags", *([seq] if seq else []), identity(F.col("name"), F.col("tags")).alias("id"), F.explode("fields").alias("key", "value"))
    first = entries.groupBy("id", "time_ns", "key").agg(F.min_by("value", order).alias("value"), F.min("name").alias("name"), F.any_value("tags").alias("tags"))
    return first.groupBy("id", "time_ns").agg(F.min("name").alias("name"), F.any_value("tags").alias("tags"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))


def add_tags(tags: Column, extra: dict[str, str]) -> Column:
    """Extra tags where their keys are absent."""
    for k, v in extra.items():
        tags = F.when(F.map_contains_key(tags, k), tags).otherwise(F.map_concat(tags, F.create_map(F.lit(k), F.lit(v))))
    return tags


def set_entry(entries: Column, key: str, value: Column) -> Column:
    """A map with ``key`` set, whatever it was."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(F.lit(key), value))


def delete(entries: Column, *keys: str) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def trim_entries(entries: Column, most: int) -> Column:
    """The first ``most`` entries."""
    return F.map_from_entries(F.slice(F.map_entries(entries), 1, most))


def keys_of(tags: Column, fields: Column) -> Column:
    """The sorted keys of a point, which its schema's fingerprint is made of."""
    return F.array_sort(F.array_union(F.map_keys(tags), F.map_keys(fields)))


def size_of(points: DataFrame) -> Column:
    """Bytes of a point's keys and values, and 8 for each number and the time."""
    tag = F.aggregate(F.map_entries("tags"), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    value = F.aggregate(F.map_entries("fields"), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]["s"]), F.octet_length(e["value"]["d"]), F.lit(8)))
    return F.octet_length("name") + tag + value + 8


def counts(points: DataFrame) -> DataFrame:
    """Points with ``n_tags`` and ``n_fields``."""
    return points.withColumns({"n_tags": F.size("tags").cast("bigint"), "n_fields": F.size("fields").cast("bigint")})


def difference(a: Column, b: Column, exclude: tuple[str, ...] = (), with_name: bool = True) -> Column:
    """Why two points (structs of name, time_ns, tags and fields) aren't the same; "" if they are. Warnings play no part.

    The first reason counts: the name, the time, then of tags and of fields the number of keys, a missing key (the least)
    or a value that differs.
    """

    def entries(kind: str) -> Column:
        x, y = delete(a[kind], *exclude), delete(b[kind], *exclude)
        keys = F.array_sort(F.map_keys(x))
        gone = F.get(F.filter(keys, lambda k: ~F.map_contains_key(y, k)), 0)
        other = F.get(F.filter(keys, lambda k: ~F.try_element_at(x, k).eqNullSafe(F.try_element_at(y, k))), 0)
        return F.when(F.size(x) != F.size(y), F.concat(F.lit(f"{kind}: "), F.size(x), F.lit(" and "), F.size(y))).when(gone.isNotNull(), F.concat(gone, F.lit(" is missing"))).when(other.isNotNull(), F.concat(other, F.lit(" differs")))

    name = F.when(~a["name"].eqNullSafe(b["name"]), "name") if with_name else F.lit(None).cast("string")
    return F.coalesce(name, F.when(~a["time_ns"].eqNullSafe(b["time_ns"]), "time"), entries("tags"), entries("fields"), F.lit(""))


def same_points(a: DataFrame, b: DataFrame, exclude: tuple[str, ...] = ()) -> bool:
    """Whether two tables hold the same points, apart from the keys in ``exclude``."""

    def flat(df: DataFrame) -> DataFrame:
        return df.select("name", "time_ns", F.to_json(F.array_sort(F.map_entries(delete(F.col("tags"), *exclude)))).alias("tags"), F.to_json(F.array_sort(F.transform(F.map_entries(delete(F.col("fields"), *exclude)), lambda e: F.struct(e["key"], e["value"].cast("string"))))).alias("fields"))

    return flat(a).exceptAll(flat(b)).isEmpty() and flat(b).exceptAll(flat(a)).isEmpty()


@dataclass(frozen=True)
class Limits:
    """What a point may be. Lengths are in bytes; 0 is no limit."""

    fields: int = 1024
    tags: int = 256
    name: int = 1024
    tag_key: int = 0
    tag_value: int = 1024
    field_key: int = 0
    string: int = 32 << 20
    strings_allowed: bool = True
    unsigned_allowed: bool = True
    dots_allowed: bool = True
    disabled: tuple[str, ...] = ()
    required: tuple[tuple[str, str], ...] = ()


#: Limits of data categories.
PRESETS = {
    "default": Limits(),
    "metric": Limits(strings_allowed=False),
    "object": replace(Limits(), dots_allowed=False, disabled=("class", "date"), required=(("name", "default"),)),
    "logging": replace(Limits(), disabled=("source", "date"), required=(("status", "info"),)),
    "influx1": replace(Limits(), unsigned_allowed=False),
}


def _repair_key(key: Column, limits: Limits, most: int) -> Column:
    key = adjust_kv(trim_to(key, most) if most else key)
    return key if limits.dots_allowed else dots_to_underscores(key)


def _first_of_keys(entries: Column) -> Column:
    """Entries without those whose key came before."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def check(points: DataFrame, limits: Limits | str = "default") -> DataFrame:
    """Points validated and repaired, with a warning for each kind of repair in ``warns``.

    In order: name, counts, tag keys and values, field keys and values, required keys. Lengths are cut by bytes. Entries
    per point are bounded by the limits, so looking keys up among them is cheap.
    """
    lim = PRESETS[limits] if isinstance(limits, str) else limits
    notes: list[tuple[Column, str]] = []
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit(NO_NAME))
    notes.append((F.coalesce(F.col("name"), F.lit("")) == "", "empty_name"))
    notes.append((F.octet_length(name) > lim.name, "name_too_long"))
    name = trim_to(name, lim.name)
    tags, fields = F.map_entries("tags"), F.map_entries("fields")
    notes += [(F.size(tags) > lim.tags, "too_many_tags"), (F.size(fields) > lim.fields, "too_many_fields")]
    tags, fields = F.slice(tags, 1, lim.tags), F.slice(fields, 1, lim.fields)
    disabled = lambda k: k.isin(*lim.disabled) if lim.disabled else F.lit(False)
    tags_in, fields_in = tags, fields
    tags = F.transform(tags, lambda e: F.struct(_repair_key(e["key"], lim, lim.tag_key).alias("key"), trim_to(adjust_kv(e["value"]), lim.tag_value).alias("value")))
    notes.append((F.to_json(tags) != F.to_json(tags_in), "tag_repaired"))
    notes.append((F.exists(tags, lambda e: disabled(e["key"])), "disabled_tag"))
    tags = _first_of_keys(F.filter(tags, lambda e: ~disabled(e["key"])))

    def repaired(v: Column) -> Column:
        text = F.when(v["s"].isNotNull(), trim_to(v["s"], lim.string)) if lim.strings_allowed else F.lit(None).cast("string")
        infinite = F.when(v["f"] == float("inf"), F.lit("18446744073709551615").cast("decimal(20,0)"))
        lowest = F.when(v["f"] == float("-inf"), F.lit(-(1 << 63)).cast("bigint"))
        narrow = F.when(v["u"] <= F.lit(str((1 << 63) - 1)).cast("decimal(20,0)"), v["u"].cast("bigint")) if not lim.unsigned_allowed else F.lit(None).cast("bigint")
        unsigned = v["u"] if lim.unsigned_allowed else F.lit(None).cast("decimal(20,0)")
        finite = F.when(~F.abs(v["f"]).eqNullSafe(float("inf")), v["f"])
        return F.struct(F.coalesce(v["i"], lowest, narrow).alias("i"), F.coalesce(unsigned, infinite if lim.unsigned_allowed else F.lit(None)).alias("u"), finite.alias("f"), v["b"].alias("b"), (v["d"] if lim.strings_allowed else F.lit(None).cast("binary")).alias("d"), text.alias("s"))

    there = lambda v: F.coalesce(v["i"].cast("string"), v["u"].cast("string"), v["f"].cast("string"), v["b"].cast("string"), v["d"].cast("string"), v["s"]).isNotNull()
    fields = F.transform(fields, lambda e: F.struct(_repair_key(e["key"], lim, lim.field_key).alias("key"), repaired(e["value"]).alias("value")))
    tag_keys = F.transform(tags, lambda e: e["key"])
    notes.append((F.exists(fields, lambda e: disabled(e["key"]) | F.array_contains(tag_keys, e["key"])), "field_key_taken"))
    notes.append((F.exists(fields_in, lambda e: there(e["value"]) & ~there(repaired(e["value"]))), "field_dropped"))
    fields = _first_of_keys(F.filter(fields, lambda e: ~disabled(e["key"]) & ~F.array_contains(tag_keys, e["key"]) & there(e["value"])))
    for key, default in lim.required:
        has = F.exists(tags, lambda e: e["key"] == key) | F.exists(fields, lambda e: e["key"] == key)  # noqa: B023
        notes.append((~has, f"required_{key}"))
        tags = F.when(has, tags).otherwise(F.concat(tags, F.array(F.struct(F.lit(key).alias("key"), F.lit(default).alias("value")))))
    warns = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(t).alias("type"), F.lit(t).alias("msg"))) for c, t in notes)), lambda w: w.isNotNull())
    return points.select(*(c for c in points.columns if c not in ("name", "tags", "fields", "warns")), name.alias("name"), F.map_from_entries(tags).alias("tags"), F.map_from_entries(fields).alias("fields"), F.concat("warns", warns).alias("warns"))
