"""Rule-driven metric aggregation: select, un-pivot fields, group, window, aggregate.

A rule's plan is declared once and lazily: the selection is a filter that reaches the scan, fields are un-pivoted with
one ``stack``-like explode or, in wide mode, aggregated column by column without un-pivoting, and the group is a real
``groupBy`` with partial aggregation, so nothing depends on hash collisions or on one process holding a window.
"""

from __future__ import annotations

import json
import re
import tomllib
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.model import epoch_micros
from lumenry.operators.windows import window_end
from lumenry.plans import conditions

#: Other names of methods.
METHOD_ALIASES = {"mean": "avg", "average": "avg", "stddev": "stdev", "std": "stdev", "merge_histogram": "histogram", "distinct": "count_distinct", "quantile": "quantiles", "percentile": "quantiles"}
METHODS = ("sum", "avg", "count", "min", "max", "first", "last", "stdev", "quantiles", "count_distinct", "histogram")
RULE_CATEGORIES = ("metric", "network", "keyevent", "object", "custom_object", "logging", "tracing", "rum", "security", "profiling", "dialtesting", "event_log", "llm")
LINEAR_SLOTS = 1 << 18


class RuleError(ValueError):
    """A rule that can't be used."""


def whitelisted(name: Column, allowed: list[str]) -> Column:
    """Exact names, or patterns after ``reg:`` found anywhere; an empty list allows every name."""
    if not allowed:
        return F.lit(True)
    exact = [a for a in allowed if not a.startswith("reg:")]
    tests = [name.isin(exact)] if exact else []
    for a in allowed:
        if a.startswith("reg:"):
            if not conditions.usable(a[4:]):
                raise RuleError(f"not a pattern: {a}")
            tests.append(F.rlike(name, F.lit(a[4:])))
    return reduce(lambda a, b: a | b, tests)


def name_allowed(name: str, allowed: list[str]) -> bool:
    return any(re.search(a[4:], name) if a.startswith("reg:") else a == name for a in allowed)


#: User aggregates by name: functions from a value column to an aggregate column.
USER_AGGREGATES: dict[str, Callable[[Column], Column]] = {}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Let rules use a method of this name; built-in ones can't be replaced."""
    own = name.strip().lower()
    if own in METHODS or own in METHOD_ALIASES:
        raise RuleError(f"{name!r} is a built-in method")
    USER_AGGREGATES[own] = build


@dataclass
class Algorithm:
    method: str
    source_field: str = ""
    window_s: int = 0
    percentiles: list[float] = field(default_factory=list)
    add_tags: dict[str, str] = field(default_factory=dict)
    approximate: bool = False

    def __post_init__(self) -> None:
        name = self.method.strip().lower()
        self.method = METHOD_ALIASES.get(name, name)
        if self.method not in METHODS and self.method not in USER_AGGREGATES:
            raise RuleError(f"method {self.method!r} isn't supported")
        if self.method == "quantiles" and (not self.percentiles or any(not 0 <= p <= 1 for p in self.percentiles)):
            raise RuleError("percentiles lie in [0, 1]")


@dataclass
class Rule:
    name: str
    category: str
    measurements: list[str]
    metric_names: list[str]
    group_by: list[str]
    algorithms: dict[str, Algorithm]
    condition: str = ""
    action: str = ""

    def __post_init__(self) -> None:
        if self.action not in ("", "passthrough", "drop"):
            raise RuleError(f"action {self.action!r}")
        if self.category not in RULE_CATEGORIES:
            raise RuleError(f"category {self.category!r}")
        self.group_by = sorted(self.group_by)
        self.parsed = conditions.parse(self.condition) if self.condition else None


def duration_s(value: str | int | float) -> int:
    """Seconds of "1m30s" or of a number of nanoseconds."""
    if isinstance(value, int | float):
        return int(value // 10**9)
    units = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", value)
    if "".join(a + b for a, b in parts) != value.strip():
        raise RuleError(f"duration {value!r}")
    return int(sum(float(n) * units[u] for n, u in parts))


def load_rules(text: str, fmt: str = "toml") -> list[Rule]:
    """Rules of a TOML or JSON text. A window of up to 10 means the default window; numbers are nanoseconds."""
    spec = tomllib.loads(text) if fmt == "toml" else json.loads(text)
    default = duration_s(spec.get("default_window", "10s"))
    out = []
    for i, r in enumerate(spec.get("aggregate_rules", [])):
        select = r.get("select", {})
        algorithms = {}
        for key, a in r.get("algorithms", {}).items():
            own = a.get("window", 0)
            window = default if isinstance(own, int | float) and own <= 10 else duration_s(own)
            opts = a.get("quantile_opts", {})
            if a.get("histogram_opts"):
                warnings.warn(f"{key}: histogram_opts are read but play no part; buckets are those of the input", stacklevel=2)
            algorithms[key] = Algorithm(a["method"], a.get("source_field", ""), window, opts.get("percentiles", a.get("percentiles", [])), a.get("add_tags", {}))
        if not algorithms:
            raise RuleError("a rule has an algorithm")
        out.append(Rule(r.get("name", f"rule{i}"), select.get("category", ""), select.get("measurements", []), select.get("metric_name", []), r.get("group_by", []), algorithms, select.get("condition", ""), spec.get("action", "")))
    return out


def rules_hash(rules: list[Rule]) -> int:
    """A fingerprint of rules, the same for the same content."""
    body = json.dumps([{k: v if not isinstance(v, dict) else {n: vars(a) for n, a in v.items()} for k, v in vars(r).items() if k != "parsed"} for r in rules], sort_keys=True)
    return xxhash.xxh64_intdigest(body)


def percentile_name(key: str, p: float) -> str:
    """``<key>_P95``; with the decimals that tell it from others, as in ``_P99_9``."""
    text = f"{p * 100:.6f}".rstrip("0").rstrip(".")
    return f"{key}_P{text.replace('.', '_')}"


def aggregate_names(key: str, a: Algorithm) -> list[str]:
    """The names of ``aggregate_columns``."""
    return [*([percentile_name(key, p) for p in a.percentiles] if a.method == "quantiles" else [key]), f"{key}_count", "time_us"]


def aggregate_columns(key: str, a: Algorithm, value: Column, micros: Column, seq: Column | None, counted: Column | None = None) -> list[Column]:
    """``<key>``, ``<key>_count`` and the row time of one algorithm over a group."""
    numeric = value
    count = F.count(counted if counted is not None else value).alias(f"{key}_count")
    order = F.struct(micros.alias("t"), (seq if seq is not None else F.lit(0)).alias("s"))
    late = F.struct(micros.alias("t"), (-seq if seq is not None else F.lit(0)).alias("s"))
    known = F.when(numeric.isNotNull(), micros)
    time = F.max(known)
    own: list[Column]
    if a.method in ("sum", "avg", "min", "max"):
        own = [getattr(F, a.method)(numeric).alias(key)]
    elif a.method in USER_AGGREGATES:
        own = [USER_AGGREGATES[a.method](numeric).alias(key)]
    elif a.method == "count":
        own = [F.count(counted if counted is not None else value).alias(key)]
        time = F.max(F.when((counted if counted is not None else value).isNotNull(), micros))
    elif a.method == "first":
        own, time = [F.min_by(numeric, F.when(numeric.isNotNull(), order)).alias(key)], F.min(known)
    elif a.method == "last":
        own = [F.max_by(numeric, F.when(numeric.isNotNull(), late)).alias(key)]
    elif a.method == "stdev":
        own = [F.stddev_samp(numeric).alias(key)]
    elif a.method == "quantiles":
        # one buffer for all percentiles: equal aggregates are computed once. The approximate form bounds it by a sketch
        every = F.percentile_approx(numeric, a.percentiles) if a.approximate else F.percentile(numeric, F.array(*map(F.lit, a.percentiles)))
        own = [every[i].alias(percentile_name(key, p)) for i, p in enumerate(a.percentiles)]
    elif a.method == "count_distinct":
        v = counted if counted is not None else value
        own = [(F.approx_count_distinct(v) if a.approximate else F.count_distinct(v)).alias(key)]
        time = F.max(F.when(v.isNotNull(), micros))
    else:
        own = [F.sum(numeric).alias(key)]
    return [*own, count, time.alias("time_us")]


def run_rule(df: DataFrame, rule: Rule, time: str, name: str | None = None, seq: str | None = None) -> dict[str, DataFrame]:
    """A typed DataFrame (one column a key) through a rule: a DataFrame for each algorithm key.

    Columns: measurement (if ``name`` is a column), window_end (epoch s), the group keys, the algorithm's outputs,
    ``time_us`` (of the latest input, or of the first or last one), and add_tags, which group keys override.
    """
    resolve = conditions.wide(df.schema)
    rows = df
    if name:
        rows = rows.filter(whitelisted(F.col(name), rule.measurements))
    if rule.parsed:
        rows = rows.filter(rule.parsed.matches(resolve))
    out = {}
    for key, a in rule.algorithms.items():
        source = a.source_field or key
        if rule.metric_names and not name_allowed(source, rule.metric_names) and not name_allowed(key, rule.metric_names):
            continue
        kind = dict(df.dtypes)[source]
        value = F.col(source).cast("double") if kind not in ("string", "boolean", "binary") else F.lit(None).cast("double")
        counted = F.col(source)
        micros = epoch_micros(F.col(time))
        keys = [*([F.col(name).alias("measurement")] if name else []), *(F.col(g) for g in rule.group_by)]
        grouped = rows.groupBy(window_end(micros, a.window_s).alias("window_end"), *keys)
        result = grouped.agg(*aggregate_columns(key, a, value, micros, F.col(seq) if seq else None, counted))
        result = result.filter(F.col(f"{key}_count") > 0)
        if a.method == "stdev":
            result = result.filter(F.col(key).isNotNull())
        for tag, v in a.add_tags.items():
            if tag not in rule.group_by:
                result = result.withColumn(tag, F.lit(v))
        out[key] = result
    return out


def selected(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that any rule's condition selects; its complement is what an action of "drop" leaves."""
    resolve = conditions.wide(df.schema)
    return df.filter(reduce(lambda a, b: a | b, (r.parsed.matches(resolve) if r.parsed else F.lit(True) for r in rules), F.lit(False)))


def fork(df: DataFrame, fields: list[str], keep: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Un-pivot: a row for each allowed field that is there, as (keep..., field, value double). No allowed names, no rows."""
    chosen = [f for f in fields if allowed is None or name_allowed(f, allowed)]
    if not chosen:
        return df.select(*keep, F.lit("").alias("field"), F.lit(0.0).alias("value")).limit(0)
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in chosen))
    return df.select(*keep, F.inline(entries)).filter("value is not null")


def linear_count(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Distinct values estimated by linear counting over 2**18 slots: ``-m * ln(empty / m)``, rounded."""
    slot = F.pmod(F.xxhash64(value), F.lit(LINEAR_SLOTS))
    used = df.filter(value.isNotNull()).groupBy(*keys).agg(F.count_distinct(slot).alias("used"))
    m = float(LINEAR_SLOTS)
    return used.select(*keys, F.round(-m * F.ln((m - F.least(F.col("used"), F.lit(LINEAR_SLOTS - 1))) / m)).cast("bigint").alias("distinct_estimate"))


def histogram(df: DataFrame, keys: list[str], value: str, le: str = "le") -> DataFrame:
    """Pre-bucketed values summed for each ``le``, beside the count of the group."""
    return df.groupBy(*keys, le).agg(F.sum(value).alias("bucket"), F.count(value).alias("n"))


def bucketize(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: (keys..., le, bucket), ``le`` being each bound and +Inf; one shuffle of partial counts."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)), F.count(value).alias("_all"))
    entries = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("bucket")))
    return counts.select(*keys, F.inline(entries))
