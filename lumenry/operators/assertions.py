"""Synthetic-check evaluation: assertions as columns, their AND/OR fold, and round-trip statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_assertion(value: Column, name: str, equals: str | None = None, differs: str | None = None, matches: str | None = None, misses: str | None = None, contains: str | None = None, lacks: str | None = None) -> Column:
    """The reason why a text fails, or null. Equality is tested first and alone."""
    v = F.coalesce(value, F.lit(""))
    if equals is not None:
        return F.when(v != equals, F.lit(f"{name} isn't `{equals}`"))
    if differs is not None:
        return F.when(v == differs, F.lit(f"{name} is `{differs}`"))
    out = F.when(F.lit(False), "")
    for text, test, why in ((matches, lambda x: ~F.rlike(v, F.lit(x)), "doesn't match"), (misses, lambda x: F.rlike(v, F.lit(x)), "matches"), (contains, lambda x: ~F.contains(v, F.lit(x)), "doesn't contain"), (lacks, lambda x: F.contains(v, F.lit(x)), "contains")):
        if text is not None:
            out = out.when(test(text), F.lit(f"{name} {why} `{text}`"))
    return out


def value_assertion(value: Column, op: str, target: float, name: str = "value") -> Column:
    """The reason why a number fails ``eq``, ``lt``, ``leq``, ``gt`` or ``geq``, or null; other operators pass."""
    holds = {"eq": value == target, "lt": value < target, "leq": value <= target, "gt": value > target, "geq": value >= target}.get(op)
    return F.lit(None).cast("string") if holds is None else F.when(~holds, F.lit(f"{name} isn't {op} {target:g}"))


def time_assertion(ms: Column, limit: float, inclusive: bool) -> Column:
    """Response time against a limit: for HTTP and websocket a time over it fails, for TCP and SSL one that reaches it too."""
    return F.when((ms >= limit) if inclusive else (ms > limit), F.lit(f"response time over {limit:g}"))


def ping_assertion(value: Column, loss_percent: Column, op: str, target: float, name: str) -> Column:
    """A round-trip assertion, which fails with one reason when every packet is lost."""
    return F.when(loss_percent >= 100, "all packets lost").otherwise(value_assertion(value, op, target, name))


def fold(reasons: list[Column], logic: str = "and") -> tuple[Column, Column, Column]:
    """(status, success, fail_reason). "and": no assertion fails, so none at all is OK. "or": one at least passes."""
    if not reasons:
        ok = F.lit(logic == "and")
        joined = F.lit("")
    else:
        fails = [r.isNotNull() for r in reasons]
        ok = ~reduce(lambda a, b: a | b, fails) if logic == "and" else ~reduce(lambda a, b: a & b, fails)
        joined = F.concat_ws(";", *reasons)
    return F.when(ok, "OK").otherwise("FAIL"), F.when(ok, 1).otherwise(-1), F.when(ok, "").otherwise(joined)


def with_result(df: DataFrame, reasons: list[Column], logic: str = "and", error: Column | None = None) -> DataFrame:
    """Rows with status, success and fail_reason. A request error fails by itself, without its assertions."""
    status, success, reason = fold(reasons, logic)
    if error is not None:
        failed = error.isNotNull()
        status, success, reason = F.when(failed, "FAIL").otherwise(status), F.when(failed, -1).otherwise(success), F.when(failed, error).otherwise(reason)
    return df.withColumns({"status": status, "success": success, "fail_reason": reason})


def steps_result(steps: Column) -> Column:
    """Of an array of struct<ok, allow_failure>: how many steps ran, and whether all that matter passed. A failing step that isn't allowed to ends the run."""
    start = F.struct(F.lit(0).alias("ran"), F.lit(True).alias("ok"), F.lit(False).alias("ended"))
    step = lambda a, s: F.when(a["ended"], a).otherwise(F.struct((a["ran"] + 1).alias("ran"), (a["ok"] & (s["ok"] | s["allow_failure"])).alias("ok"), (~s["ok"] & ~s["allow_failure"]).alias("ended")))
    return F.aggregate(steps, start, step)


#: The fields a network-path condition may name, by type.
NETPATH_FIELDS = {"min_rtt": "duration", "avg_rtt": "duration", "max_rtt": "duration", "jitter": "duration", "packet_loss_percent": "number", "hops_num": "number", "packets_sent": "number", "packets_recv": "number", "reachable": "status"}


def validate_netpath(conditions: list[dict]) -> None:
    """Raise ValueError for a condition with an unknown field, operator or value of the wrong type."""
    for c in conditions:
        kind = NETPATH_FIELDS.get(c.get("field", ""))
        if kind is None:
            raise ValueError(f"unknown field {c.get('field')!r}")
        if c.get("op") not in (("eq", "neq") if kind == "status" else ("eq", "lt", "leq", "gt", "geq")):
            raise ValueError(f"operator {c.get('op')!r} of {c['field']}")
        target = str(c.get("target", ""))
        if kind == "number" and not target.replace(".", "", 1).isdigit() or kind == "duration" and not any(target.endswith(u) and target[: -len(u)].replace(".", "", 1).isdigit() for u in ("ms", "us", "s")) or kind == "status" and target not in ("true", "false"):
            raise ValueError(f"value {target!r} of {c['field']}")


def rtt_stats(df: DataFrame, keys: list[str], rtt: str, lost: Column) -> DataFrame:
    """Round-trip statistics of a group: population deviation, loss in percent."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.min(rtt).alias("rtt_min"), F.max(rtt).alias("rtt_max"), F.avg(rtt).alias("rtt_avg"), F.stddev_pop(rtt).alias("rtt_std"), (100.0 * F.count_if(lost) / F.count(F.lit(1))).alias("loss_percent"))


def hop_stats(df: DataFrame, keys: list[str], rtt: str, failed: Column) -> DataFrame:
    """Statistics of a hop: sample deviation, 0 for a single probe."""
    good = F.when(~failed, F.col(rtt))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), (100.0 * F.count_if(failed) / F.count(F.lit(1))).alias("loss"), F.avg(good).alias("avg_cost"), F.min(good).alias("min_cost"), F.max(good).alias("max_cost"), F.coalesce(F.stddev_samp(good), F.lit(0.0)).alias("std_cost"))


def _any(*reasons: Column | None) -> list[Column]:
    return [r for r in reasons if r is not None]


def http_assertions(status: str | None = None, body_contains: str | None = None, header: tuple[str, str] | None = None, time_ms: float | None = None, columns: tuple[str, str, str, str] = ("status_code", "body", "headers", "response_ms")) -> list[Column]:
    """HTTP: a status code, text in the body, a header's value, and a response time that may not be over the limit."""
    code, body, headers, ms = (F.col(c) for c in columns)
    return _any(
        text_assertion(code.cast("string"), "status code", equals=status) if status else None,
        text_assertion(body, "body", contains=body_contains) if body_contains else None,
        text_assertion(F.try_element_at(headers, F.lit(header[0])), f"header {header[0]}", contains=header[1]) if header else None,
        time_assertion(ms, time_ms, False) if time_ms is not None else None,
    )


def tcp_assertions(time_ms: float | None = None, message: str | None = None, with_dns: bool = False, max_hops: int | None = None) -> list[Column]:
    """TCP: a response time, with or without name resolution, that must stay under the limit, the reply and the hops."""
    ms = F.col("response_ms") + (F.col("dns_ms") if with_dns else F.lit(0.0))
    return _any(time_assertion(ms, time_ms, True) if time_ms is not None else None, text_assertion(F.col("message"), "message", contains=message) if message else None, value_assertion(F.col("hops"), "leq", max_hops, "hops") if max_hops is not None else None)


def ping_assertions(rtt: dict[str, tuple[str, float]] | None = None, loss: tuple[str, float] | None = None, packets: tuple[str, float] | None = None) -> list[Column]:
    """ICMP: avg, min, max or std of the round trips, the loss in percent and the packets received."""
    out = [ping_assertion(F.col(f"rtt_{k}"), F.col("loss_percent"), op, target, f"{k} round trip") for k, (op, target) in (rtt or {}).items()]
    return out + _any(value_assertion(F.col("loss_percent"), *loss, "loss") if loss else None, value_assertion(F.col("packets"), *packets, "packets") if packets else None)


def ssl_assertions(now_s: Column, days_left: int | None = None, subject: str | None = None, issuer: str | None = None, version: str | None = None, time_ms: float | None = None) -> list[Column]:
    """TLS: days until expiry, subject, issuer, protocol version, and a response time that must stay under the limit."""
    left = F.floor((F.col("not_after_s") - now_s) / 86_400)
    return _any(
        value_assertion(left, "geq", days_left, "days left") if days_left is not None else None,
        text_assertion(F.col("subject"), "subject", contains=subject) if subject else None,
        text_assertion(F.col("issuer"), "issuer", contains=issuer) if issuer else None,
        text_assertion(F.col("tls_version"), "version", equals=version) if version else None,
        time_assertion(F.col("response_ms"), time_ms, True) if time_ms is not None else None,
    )


def websocket_assertions(message: str | None = None, header: tuple[str, str] | None = None, time_ms: float | None = None) -> list[Column]:
    return _any(text_assertion(F.col("message"), "message", contains=message) if message else None, text_assertion(F.try_element_at("headers", F.lit(header[0])), f"header {header[0]}", contains=header[1]) if header else None, time_assertion(F.col("response_ms"), time_ms, False) if time_ms is not None else None)


def grpc_assertions(body: str | None = None, time_ms: float | None = None) -> list[Column]:
    """gRPC: text in the reply and a response time; without either, a check passes."""
    return _any(text_assertion(F.col("body"), "body", contains=body) if body else None, time_assertion(F.col("response_ms"), time_ms, False) if time_ms is not None else None)


def result_rows(df: DataFrame, protocol: str, tags: list[str], fields: list[str], message: Column | None = None) -> DataFrame:
    """A check's results as points: its tags with status and protocol, its fields with success and the message."""
    tag_entries = [x for t in [*tags, "status"] for x in (F.lit(t), F.col(t).cast("string"))] + [F.lit("proto"), F.lit(protocol)]
    text = message if message is not None else F.to_json(F.struct(*fields, "fail_reason"))
    return df.select(F.lit(f"{protocol}_dial_testing").alias("name"), F.map_filter(F.create_map(*tag_entries), lambda _, v: v.isNotNull()).alias("tags"), *fields, "success", text.alias("message"))
