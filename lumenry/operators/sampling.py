"""Tail sampling: spans, log lines or events are grouped, and a group is kept or dropped as a whole by ordered pipelines.

A group's decision needs one aggregate, ``bool_or`` of each pipeline's condition, with map-side partial aggregation; the
rows kept are then a semi-join against the decisions, so payloads are never gathered.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.scalar import fnv1a_mod
from lumenry.plans import conditions

RATE_STEPS = 10_000
#: Default and longest times that a group waits for more, in seconds.
TTL_DEFAULTS, TTL_MOST = {"trace": 300, "logging": 60, "rum": 60}, 3599


@dataclass
class Pipeline:
    name: str
    kind: str = "condition"  # or "probabilistic"
    condition: str = ""
    action: str = "keep"
    rate: float = 0.0
    hash_keys: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.kind not in ("condition", "probabilistic"):
            raise ValueError(f"pipeline type {self.kind!r}")
        if self.kind == "condition" and not self.condition:
            raise ValueError("a condition pipeline has a condition")
        if self.hash_keys:
            warnings.warn("hash_keys take no part in decisions", stacklevel=2)
        self.parsed = conditions.parse(self.condition) if self.condition else None

    @property
    def match_all(self) -> bool:
        return self.kind == "probabilistic" and not self.condition and self.rate > 0

    def decision(self, group_hash: Column) -> Column:
        if self.kind == "probabilistic":
            return F.when(group_hash < int(self.rate * RATE_STEPS), "keep").otherwise("drop")
        return F.lit("drop" if self.action == "drop" else "keep")


def usable_pipelines(pipelines: list[Pipeline]) -> list[Pipeline]:
    """Probabilistic pipelines without a rate are left out."""
    return [p for p in pipelines if p.kind == "condition" or p.rate > 0]


def ttl(kind: str, seconds: int | None = None) -> int:
    return min(TTL_MOST, seconds or TTL_DEFAULTS[kind])


def split_passthrough(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a group key, and rows without, which pass through."""
    there = F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    return df.filter(there), df.filter(~there)


def decide(df: DataFrame, keys: list[str], hash_key: str, pipelines: list[Pipeline], *facts: Column) -> DataFrame:
    """(keys..., spans, decision, pipeline): the first pipeline that any row of the group matches decides; else drop.

    ``facts`` are further named aggregates of the same pass, whose columns follow.
    """
    chosen = usable_pipelines(pipelines)
    resolve = conditions.wide(df.schema)
    flags = [F.bool_or(p.parsed.matches(resolve) if p.parsed else F.lit(True)).alias(f"_m{i}") for i, p in enumerate(chosen)]
    hashed = fnv1a_mod(F.col(hash_key).cast("string"), RATE_STEPS)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("spans"), *flags, *facts)
    extra = groups.columns[len(keys) + 1 + len(flags) :]
    if any(p.kind == "probabilistic" for p in chosen):
        groups = groups.withColumn("_h", hashed)
    decision, name = F.lit("drop"), F.lit(None).cast("string")
    for i, p in reversed(list(enumerate(chosen))):
        decision = F.when(F.col(f"_m{i}"), p.decision(F.col("_h") if p.kind == "probabilistic" else F.lit(0))).otherwise(decision)
        name = F.when(F.col(f"_m{i}"), F.lit(p.name)).otherwise(name)
    return groups.select(*keys, "spans", decision.alias("decision"), name.alias("pipeline"), *extra)


def kept_rows(df: DataFrame, keys: list[str], hash_key: str, pipelines: list[Pipeline]) -> DataFrame:
    """The rows of kept groups."""
    kept = decide(df, keys, hash_key, pipelines).filter("decision = 'keep'")
    return df.join(kept.select(*keys), keys, "left_semi")


def sessions(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Groups that end after ``seconds`` without a row: each row extends its session (batch form of the re-armed timer)."""
    return df.groupBy(*keys, F.session_window(F.col(ts), f"{seconds} seconds").alias("session")).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def group_summary(df: DataFrame, keys: list[str], start: str, duration: str, status: str, parent: str) -> DataFrame:
    """A group's envelope and flags: spans, start and end (0 starts are unset), any error, longest duration, roots."""
    begun = F.nullif(F.col(start), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spans"),
        F.min(begun).alias("trace_start"),
        F.max(begun + F.col(duration)).alias("trace_end"),
        F.bool_or(F.col(status) == "error").alias("has_error"),
        F.max(duration).alias("max_duration"),
        F.max(F.when(F.col(parent) == "0", F.col(duration))).alias("root_duration"),
        F.count_if(F.col(parent) == "0").alias("roots"),
    )


#: The built-in metrics of each data kind as (name, stage, decision, what is counted), and duration bounds in ms.
BUILTIN = {
    "trace": [("trace_total_count", "ingest", "", "total"), ("trace_kept_count", "decision", "kept", "kept"), ("trace_dropped_count", "decision", "dropped", "dropped"), ("trace_error_count", "ingest", "", "errors"), ("span_total_count", "ingest", "", "points")],
    "logging": [("logging_total_count", "ingest", "", "total"), ("logging_error_count", "ingest", "", "errors"), ("logging_kept_count", "decision", "kept", "kept"), ("logging_dropped_count", "decision", "dropped", "dropped")],
    "rum": [("rum_total_count", "ingest", "", "total"), ("rum_kept_count", "decision", "kept", "kept"), ("rum_dropped_count", "decision", "dropped", "dropped")],
}
DURATION_BOUNDS_MS = (1, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)


def builtin_metrics(df: DataFrame, keys: list[str], hash_key: str, pipelines: list[Pipeline], kind: str, error: Column, start_ns: Column | None = None, end_ns: Column | None = None, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """Built-in metrics of one data kind, long: (metric, stage, decision, le, value). One pass over the groups gives them all.

    Here a packet is a group. With the times of spans, traces also give the cumulative histogram of ``trace_duration``,
    over traces that last. ``enabled`` names the metrics wanted; without it all are.
    """
    timed = df.withColumns({"_error": error, "_start": start_ns if start_ns is not None else F.lit(None).cast("bigint"), "_end": end_ns if end_ns is not None else F.lit(None).cast("bigint")})
    groups = decide(timed, keys, hash_key, pipelines, F.bool_or("_error").alias("error"), ((F.max("_end") - F.min(F.nullif("_start", F.lit(0)))) / 1e6).alias("ms"))
    lasting = F.when(F.col("ms") > 0, F.col("ms"))
    one = groups.agg(
        F.count(F.lit(1)).alias("total"), F.sum("spans").alias("points"), F.count_if("error").alias("errors"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"),
        *(F.count_if(lasting <= b).alias(f"_b{b}") for b in DURATION_BOUNDS_MS), F.count(lasting).alias("_n"), F.sum(lasting).alias("_s"),
    )
    rows = [(m, s, d, "", c) for m, s, d, c in BUILTIN[kind]]
    if kind == "trace" and start_ns is not None:
        rows += [("trace_duration_bucket", "pre_decision", "", str(b), f"_b{b}") for b in DURATION_BOUNDS_MS]
        rows += [("trace_duration_bucket", "pre_decision", "", "+Inf", "_n"), ("trace_duration_count", "pre_decision", "", "", "_n"), ("trace_duration_sum", "pre_decision", "", "", "_s")]
    rows = [r for r in rows if enabled is None or r[0] in enabled or r[0].rsplit("_", 1)[0] in enabled]
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(s).alias("stage"), F.lit(d).alias("decision"), F.lit(le).alias("le"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value")) for m, s, d, le, c in rows))
    return one.select(F.inline(entries))


def derived(records: DataFrame, window_s: int, bounds: list[float] | None = None, time: str = "time_us") -> DataFrame:
    """Derived metrics of (token, measurement, metric_name, kind, stage, decision, value, time_us) records by window.

    Kind "sum" or empty adds values; "histogram" gives cumulative buckets, sum and count; other kinds are left out. Rows:
    (token, measurement, metric_name, stage, decision, window_end, field, le, value).
    """
    from lumenry.operators.windows import window_end

    keys = ["token", "measurement", "metric_name", "stage", "decision"]
    rows = records.withColumn("window_end", window_end(F.col(time), window_s))
    sums = rows.filter(F.coalesce("kind", F.lit("")).isin("", "sum")).groupBy(*keys, "window_end").agg(F.sum("value").alias("value"))
    out = sums.select(*keys, "window_end", F.lit("sum").alias("field"), F.lit("").alias("le"), "value")
    if bounds:
        ordered = sorted(bounds)
        grouped = rows.filter("kind = 'histogram'").groupBy(*keys, "window_end").agg(*(F.count_if(F.col("value") <= b).cast("double").alias(f"_b{i}") for i, b in enumerate(ordered)), F.count("value").cast("double").alias("_n"), F.sum("value").alias("_s"))
        entries = [*(("bucket", f"{b:g}", f"_b{i}") for i, b in enumerate(ordered)), ("bucket", "+Inf", "_n"), ("sum", "", "_s"), ("count", "", "_n")]
        out = out.unionByName(grouped.select(*keys, "window_end", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(le).alias("le"), F.col(c).alias("value")) for f, le, c in entries)))))
    return out


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
