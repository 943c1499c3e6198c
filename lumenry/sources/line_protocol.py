"""Line protocol: text lines to points and back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.scalar import to_nanoseconds
from lumenry.model import FIELD

PARSED = f"name string, tags map<string, string>, fields map<string, {FIELD}>, time bigint, error string"


class LineError(ValueError):
    """A line that isn't line protocol."""


def _until(text: str, at: int, ends: str) -> tuple[str, int]:
    out = []
    while at < len(text) and text[at] not in ends:
        if text[at] == "\\" and at + 1 < len(text) and text[at + 1] in ", =\\":
            at += 1
        out.append(text[at])
        at += 1
    return "".join(out), at


def _value(text: str, at: int) -> tuple[dict, int]:
    if text[at : at + 1] == '"':
        out, at = [], at + 1
        while at < len(text) and text[at] != '"':
            if text[at] == "\\" and text[at + 1 : at + 2] in ('"', "\\"):
                at += 1
            out.append(text[at])
            at += 1
        if at >= len(text):
            raise LineError("string without end")
        return {"s": "".join(out)}, at + 1
    raw, at = _until(text, at, ", ")
    if raw in ("t", "T", "true", "True", "TRUE", "f", "F", "false", "False", "FALSE"):
        return {"b": raw[0] in "tT"}, at
    try:
        if raw.endswith("i"):
            return {"i": int(raw[:-1])}, at
        if raw.endswith("u"):
            return {"u": Decimal(raw[:-1])}, at
        return {"f": float(raw)}, at
    except (ValueError, ArithmeticError):
        raise LineError(f"value {raw!r}") from None


def parse_line(text: str) -> dict:
    """name, tags, fields and time (null if absent) of a line."""
    name, at = _until(text, 0, ", ")
    if not name:
        raise LineError("no measurement")
    tags: dict[str, str] = {}
    while text[at : at + 1] == ",":
        key, at = _until(text, at + 1, "= ")
        if text[at : at + 1] != "=" or not key:
            raise LineError("tag without value")
        tags_value, at = _until(text, at + 1, ", ")
        if key in tags:
            raise LineError(f"tag {key!r} twice")
        tags[key] = tags_value
    at += len(text[at:]) - len(text[at:].lstrip(" "))
    fields: dict[str, dict] = {}
    while True:
        key, at = _until(text, at, "= ")
        if text[at : at + 1] != "=" or not key:
            raise LineError("field without value")
        value, at = _value(text, at + 1)
        if key in fields or key in tags:
            raise LineError(f"key {key!r} twice")
        fields[key] = value
        if text[at : at + 1] != ",":
            break
        at += 1
    rest = text[at:].strip()
    if rest and not rest.lstrip("-").isdigit():
        raise LineError(f"time {rest!r}")
    return {"name": name, "tags": tags, "fields": {k: {m: v.get(m) for m in "iufbds"} for k, v in fields.items()}, "time": int(rest) if rest else None}


def parse(lines: DataFrame, column: str = "value", mode: str = "permissive", unit: str | None = "n", default_time_ns: int | None = None) -> DataFrame:
    """Lines to name, tags, fields, time_ns and error. Blank lines and comments go.

    "permissive" keeps bad lines as rows with an error, "drop" leaves them out, "fail" raises. ``unit`` None tells the
    unit of each time by its magnitude.
    """
    if mode not in ("permissive", "drop", "fail"):
        raise ValueError(mode)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for line in part["value"]:
                try:
                    rows.append(parse_line(line) | {"error": None})
                except LineError as e:
                    if mode == "fail":
                        raise
                    if mode == "permissive":
                        rows.append({"name": None, "tags": None, "fields": None, "time": None, "error": str(e)})
            out = pd.DataFrame(rows, columns=["name", "tags", "fields", "time", "error"])
            out["time"] = out["time"].astype("Int64")
            yield out

    kept = lines.select(F.trim(F.col(column)).alias("value")).filter("value <> '' and not startswith(value, '#')")
    parsed = kept.mapInPandas(run, PARSED)
    return parsed.select("name", "tags", "fields", F.coalesce(to_nanoseconds(F.col("time"), unit), F.lit(default_time_ns).cast("bigint")).alias("time_ns"), "error")


def read(spark, path: str, **options) -> DataFrame:
    return parse(spark.read.text(path), **options)


def _escape(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, f"([{marks}])", r"\\$1")


def encode(points: DataFrame) -> Column:
    """A point's line: tags and fields by key, ``i`` and ``u`` after whole numbers, all in expressions."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit(","), _escape(e["key"], ", ="), F.lit("="), _escape(e["value"], ", =")))
    value = lambda v: F.coalesce(F.concat(v["i"].cast("string"), F.lit("i")), F.concat(v["u"].cast("string"), F.lit("u")), v["f"].cast("string"), v["b"].cast("string"), F.concat(F.lit('"'), _escape(v["s"], r'"\\\\'), F.lit('"')), F.concat(F.lit('"'), F.base64(v["d"]), F.lit('"')))
    keys = F.array_sort(F.map_keys("fields"))
    fields = F.transform(keys, lambda k: F.concat(_escape(k, ", ="), F.lit("="), value(F.element_at(F.col("fields"), k))))
    return F.concat(_escape(F.col("name"), ", "), F.array_join(tags, ""), F.lit(" "), F.array_join(fields, ","), F.coalesce(F.concat(F.lit(" "), F.col("time_ns").cast("string")), F.lit("")))


def bodies(points: DataFrame, most_bytes: int) -> DataFrame:
    """(part, body): lines joined into bodies of at most ``most_bytes``; a longer line is left out. Runs within partitions."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size = number = 0
        for part in parts:
            out = []
            for line in part["line"]:
                n = len(line.encode()) + 1
                if n - 1 > most_bytes:
                    continue
                if held and size + n - 1 > most_bytes:
                    out.append((number, "\n".join(held)))
                    held, size, number = [], 0, number + 1
                held.append(line)
                size += n
            yield pd.DataFrame(out, columns=["part", "body"])
        if held:
            yield pd.DataFrame([(number, "\n".join(held))], columns=["part", "body"])

    return points.select(encode(points).alias("line")).mapInPandas(run, "part int, body string")
