"""Other readers: JSON points, Prometheus text, OTLP in JSON, collapsed stacks; and JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.scalar import chunks, dots_to_underscores, hex_id, prometheus_measurement, severity, span_kind, span_status
from lumenry.model import FIELD

JSON_POINT = "measurement string, tags map<string, string>, fields map<string, string>, time bigint"


def json_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """``{measurement, tags, fields, time}`` to points. JSON has one kind of number, so all numbers are floats."""
    v = F.from_json(F.col(column), JSON_POINT)
    raw_fields = F.from_json(F.get_json_object(column, "$.fields"), "map<string, string>")
    number = lambda x: x.try_cast("double")
    value = lambda k, x: F.from_json(F.to_json(F.struct(F.lit(None).cast("bigint").alias("i"), F.when(~x.isin("true", "false"), number(x)).alias("f"), F.when(x.isin("true", "false"), x == "true").alias("b"), F.when(number(x).isNull() & ~x.isin("true", "false"), x).alias("s"))), FIELD)
    return lines.select(v["measurement"].alias("name"), F.coalesce(v["tags"], F.expr("cast(map() as map<string,string>)")).alias("tags"), F.transform_values(raw_fields, value).alias("fields"), v["time"].alias("time_ns"))


def to_json_point(points: DataFrame) -> Column:
    fields = F.transform_values("fields", lambda _, v: F.coalesce(v["i"].cast("string"), v["u"].cast("string"), v["f"].cast("string"), v["b"].cast("string"), v["s"], F.base64(v["d"])))
    return F.to_json(F.struct(F.col("name").alias("measurement"), F.col("tags"), fields.alias("fields"), F.col("time_ns").alias("time")))


_METRIC = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+([^\s]+)(?:\s+(-?\d+))?\s*$'
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:\\.|[^"\\])*)"'


def prometheus(lines: DataFrame, column: str = "value", prefix: str = "", default: str = "", file: str | None = None) -> DataFrame:
    """Exposition text to (name, field, tags, value, time_ms). Buckets are left out; ``_sum`` and ``_count`` stay.

    Series without labels belong to the default measurement, others to the one of their name. All in expressions, so a
    large dump splits by lines; a line's own time is its alone.
    """
    text = F.trim(F.col(column))
    rows = lines.filter((text != "") & ~F.startswith(text, F.lit("#"))).select(*([file] if file else []), text.alias("_t"))
    rows = rows.filter(F.rlike("_t", F.lit(_METRIC)))
    metric = F.regexp_extract("_t", _METRIC, 1)
    labels = F.regexp_extract("_t", _METRIC, 2)
    pairs = F.arrays_zip(F.regexp_extract_all(labels, F.lit(_LABEL), 1).alias("key"), F.regexp_extract_all(labels, F.lit(_LABEL), 2).alias("value"))
    unescape = lambda x: F.replace(F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    tags = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["key"], unescape(p["value"]))))
    value = F.regexp_extract("_t", _METRIC, 3)
    number = F.when(value.isin("+Inf", "Inf"), float("inf")).when(value == "-Inf", float("-inf")).otherwise(value.try_cast("double"))
    name = F.when((labels == "") & F.lit(bool(default)), F.lit(default)).otherwise(prometheus_measurement(metric, prefix, default))
    out = rows.select(*([file] if file else []), name.alias("name"), metric.alias("field"), tags.alias("tags"), number.alias("value"), F.nullif(F.regexp_extract("_t", _METRIC, 4), F.lit("")).cast("bigint").alias("time_ms"))
    return out.filter("not (endswith(field, '_bucket') and map_contains_key(tags, 'le'))")


def prometheus_errors(lines: DataFrame, column: str = "value", file: str | None = None) -> DataFrame:
    """The lines of exposition text that ``prometheus`` leaves out because they aren't samples: (file, line)."""
    text = F.trim(F.col(column))
    return lines.filter((text != "") & ~F.startswith(text, F.lit("#")) & ~F.rlike(text, F.lit(_METRIC))).select(*([file] if file else []), text.alias("line"))


# a string where JSON has an object or a list gives its text, so arrays and key lists of any depth are read
_ANY = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, bytesValue: string, arrayValue: string, kvlistValue: string>"
_ATTRS = f"array<struct<key: string, value: {_ANY}>>"
_POINT = f"struct<attributes: {_ATTRS}, timeUnixNano: string, asDouble: double, asInt: string, count: string, sum: double, min: double, max: double, bucketCounts: array<string>, explicitBounds: array<double>, quantileValues: array<struct<quantile: double, value: double>>>"
_DATA = f"struct<dataPoints: array<{_POINT}>, aggregationTemporality: string>"
OTLP_METRICS = f"struct<resourceMetrics: array<struct<resource: struct<attributes: {_ATTRS}>, scopeMetrics: array<struct<scope: struct<name: string, version: string, attributes: {_ATTRS}>, metrics: array<struct<name: string, unit: string, description: string, gauge: {_DATA}, sum: {_DATA}, histogram: {_DATA}, exponentialHistogram: {_DATA}, summary: {_DATA}>>>>>>>"
_EVENT = f"struct<name: string, timeUnixNano: string, attributes: {_ATTRS}>"
OTLP_TRACES = f"struct<resourceSpans: array<struct<resource: struct<attributes: {_ATTRS}>, scopeSpans: array<struct<scope: struct<name: string, version: string>, spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_ATTRS}, events: array<{_EVENT}>, status: struct<code: int, message: string>>>>>>>>"
OTLP_LOGS = f"struct<resourceLogs: array<struct<resource: struct<attributes: {_ATTRS}>, scopeLogs: array<struct<scope: struct<name: string>, logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: {_ANY}, attributes: {_ATTRS}, traceId: string, spanId: string>>>>>>>"


def _named(**members: Column) -> Column:
    """A struct whose names hold inside generators, which take aliases away."""
    return F.named_struct(*(x for k, v in members.items() for x in (F.lit(k), v)))


def any_text(v: Column) -> Column:
    """An OTLP value as text; doubles with six decimals, arrays and key lists as their JSON."""
    return F.coalesce(v["stringValue"], v["intValue"], F.when(v["doubleValue"].isNotNull(), F.format_string("%.6f", v["doubleValue"])), v["boolValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"])


def attributes(a: Column, drop: tuple[str, ...] = (), most: int | None = None) -> Column:
    """Attributes as a string map with underscores for dots; the first of equal keys wins. Keys in ``drop``, as they are
    sent, are left out, and so are attributes without a value; values are cut to ``most`` characters."""
    text = lambda e: any_text(e["value"]) if most is None else F.left(any_text(e["value"]), F.lit(most))
    given = F.filter(F.coalesce(a, F.expr(f"cast(array() as {_ATTRS})")), lambda e: any_text(e["value"]).isNotNull() & (~e["key"].isin(*drop) if drop else F.lit(True)))
    entries = F.transform(given, lambda e: _named(key=dots_to_underscores(e["key"]), value=text(e)))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


#: Public names of attributes.
ALIASES = {
    "db.system": "db_system", "db.operation": "db_operation", "db.name": "db_name", "db.statement": "db_statement",
    "server.address": "server_address", "net.host.name": "net_host_name", "server.port": "server_port", "net.host.port": "net_host_port",
    "network.peer.address": "network_peer_address", "network.peer.port": "network_peer_port", "network.transport": "network_transport",
    "http.request.method": "http_method", "http.method": "http_method", "error.type": "error_type", "http.response.status_code": "http_status_code", "http.status_code": "http_status_code",
    "http.route": "http_route", "http.target": "http_target", "http.scheme": "http_scheme", "http.url": "http_url",
    "url.full": "url_full", "url.scheme": "url_scheme", "url.path": "url_path", "url.query": "url_query", "client.address": "client_address", "client.port": "client_port",
    "messaging.system": "messaging_system", "messaging.operation": "messaging_operation", "messaging.message.id": "messaging_message.id", "messaging.destination.name": "messaging_destination.name",
    "rpc.service": "rpc_service", "rpc.system": "rpc_system",
    "exception": "exception", "exception.type": "exception_type", "exception.message": "exception_message", "exception.stacktrace": "exception_stacktrace",
    "container.name": "container_name", "process.pid": "process_pid", "project": "project", "version": "version", "env": "env", "host": "host", "pod_name": "pod_name", "pod_namespace": "pod_namespace",
    "telemetry.sdk.language": "sdk_language", "telemetry.sdk.name": "sdk_name", "telemetry.sdk.version": "sdk_version",
}


def public_attributes(a: Column) -> tuple[Column, Column]:
    """Attributes with a public name, as a map under it (the last of equal names wins), and the others as an array."""
    given = F.coalesce(a, F.expr(f"cast(array() as {_ATTRS})"))
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    public = lambda e: F.map_contains_key(known, e["key"]) & any_text(e["value"]).isNotNull()
    named = F.transform(F.filter(given, public), lambda e: _named(key=F.try_element_at(known, e["key"]), value=any_text(e["value"])))
    keys = F.reverse(F.transform(named, lambda e: e["key"]))
    last = F.filter(F.reverse(named), lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(last), F.filter(given, lambda e: ~public(e))


def merge_first(*maps: Column) -> Column:
    """Maps as one; the first that has a key wins."""
    def without(own: Column, first: Column) -> Column:
        return F.map_filter(own, lambda k, _: ~F.map_contains_key(first, k))

    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(out, without(m, out))
    return out


def otlp_metrics(bodies: DataFrame, column: str = "value") -> DataFrame:
    """OTLP metric requests in JSON to (name, kind, field, tags, value, time_ns).

    Gauges and sums give their value; histograms and summaries ``_count``, ``_sum``, ``_min``, ``_max`` (null if unset)
    and cumulative buckets or quantiles; exponential histograms ``_avg`` (if they count anything) instead of buckets. Resource attributes win over those of scope and point.
    """
    r = bodies.select(F.explode(F.from_json(column, OTLP_METRICS)["resourceMetrics"]).alias("r"))
    s = r.select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeMetrics").alias("s"))
    m = s.select("ra", attributes(F.col("s.scope.attributes")).alias("sa"), F.explode("s.metrics").alias("m"))
    kinds = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
    data = F.filter(F.array(*(_named(kind=F.lit(k), points=F.col(f"m.{k}.dataPoints"), temporality=F.col(f"m.{k}.aggregationTemporality")) for k in kinds)), lambda x: x["points"].isNotNull())
    p = m.select("ra", "sa", F.col("m.name").alias("name"), F.inline(data)).select("ra", "sa", "name", "kind", "temporality", F.explode("points").alias("p"))
    own = F.when(F.col("temporality").isNotNull(), F.create_map(F.lit("temporality"), F.col("temporality"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    tags = merge_first(F.col("ra"), F.col("sa"), attributes(F.col("p.attributes")), own)
    entry = lambda suffix, v, extra=None: _named(field=F.concat("name", F.lit(suffix)), value=v.cast("double"), le=(extra if extra is not None else F.lit(None)).cast("string"))
    counts = F.col("p.bucketCounts")
    running = F.aggregate(counts, F.expr("cast(array() as array<double>)"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x.cast("double"))))
    buckets = F.when(F.coalesce(F.size("p.explicitBounds"), F.lit(0)) > 0, F.transform(running, lambda v, i: entry("_bucket", v, F.coalesce(F.get("p.explicitBounds", i).cast("string"), F.lit("+Inf")))))
    quantiles = F.transform(F.col("p.quantileValues"), lambda q: entry("", q["value"], q["quantile"].cast("string")))
    plain = F.array(entry("", F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double"))))
    rest = F.array(entry("_count", F.col("p.count")), entry("_sum", F.col("p.sum")), entry("_min", F.col("p.min")), entry("_max", F.col("p.max")))
    count = F.col("p.count").cast("double")
    average = F.array(entry("_avg", F.when(count > 0, F.coalesce(F.col("p.sum"), F.lit(0.0)) / count)))
    none = F.expr("cast(array() as array<struct<field: string, value: double, le: string>>)")
    entries = F.when(F.col("kind").isin("gauge", "sum"), plain).when(F.col("kind") == "histogram", F.concat(rest, F.coalesce(buckets, none))).when(F.col("kind") == "exponentialHistogram", F.concat(rest, average)).otherwise(F.concat(F.slice(rest, 1, 2), F.coalesce(quantiles, none)))
    rows = p.select("name", "kind", tags.alias("tags"), F.col("p.timeUnixNano").cast("bigint").alias("time_ns"), F.inline(entries))
    return rows.filter("value is not null").select("name", "kind", "field", "tags", "le", "value", "time_ns")


def db_host(resource: Column, span: Column) -> Column:
    """The database's host from the attributes of a resource and a span; null where neither names a database system."""
    there = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    system = F.coalesce(*(there(m, k) for m in (resource, span) for k in ("db_system", "db_system_name")))
    return F.when(system.isNotNull(), F.coalesce(*(there(m, k) for m in (span, resource) for k in ("server_address", "net_peer_name"))))


def otlp_traces(bodies: DataFrame, column: str = "value") -> DataFrame:
    """OTLP trace requests in JSON to spans: ids, service, operation, kind, status, start and duration in µs, db_host, error_*, tags."""
    r = bodies.select(F.explode(F.from_json(column, OTLP_TRACES)["resourceSpans"]).alias("r"))
    s = r.select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeSpans").alias("s")).select("ra", F.explode("s.spans").alias("s"))
    raised = F.get(F.filter("s.events", lambda e: e["name"] == "exception"), 0)
    error = F.when(raised.isNotNull(), attributes(raised["attributes"]))
    start, end = F.col("s.startTimeUnixNano").cast("bigint"), F.col("s.endTimeUnixNano").cast("bigint")
    ident = lambda c: F.when(F.coalesce(c, F.lit("")).rlike("^0*$"), "0").otherwise(F.lower(c))
    tags = merge_first(F.col("ra"), attributes(F.col("s.attributes")))
    system = F.coalesce(*(F.try_element_at(tags, F.lit(k)) for k in ("db_system", "rpc_system", "messaging_system", "http_method")))
    source = F.when(F.map_contains_key(tags, "db_system"), "db").when(F.map_contains_key(tags, "messaging_system"), "message_queue").when(F.map_contains_key(tags, "http_method") | F.map_contains_key(tags, "http_request_method"), "web").otherwise("custom")
    return s.select(
        ident(F.col("s.traceId")).alias("trace_id"), ident(F.col("s.spanId")).alias("span_id"), ident(F.col("s.parentSpanId")).alias("parent_id"), F.coalesce(F.try_element_at("ra", F.lit("service_name")), F.lit("unknown_service")).alias("service"),
        F.col("s.name").alias("operation"), span_kind(F.col("s.kind")).alias("kind"), span_status(F.col("s.status.code")).alias("status"), F.floor(start / 1000).cast("bigint").alias("start"), F.floor((end - start) / 1000).cast("bigint").alias("duration"), source.alias("source_type"), system.alias("system"), db_host(F.col("ra"), attributes(F.col("s.attributes"))).alias("db_host"),
        F.try_element_at(error, F.lit("exception_type")).alias("error_type"), F.try_element_at(error, F.lit("exception_message")).alias("error_message"), F.try_element_at(error, F.lit("exception_stacktrace")).alias("error_stack"), tags.alias("tags"), start.alias("time_ns"),
    )


def span_types(spans: DataFrame) -> DataFrame:
    """Spans with ``span_type``: "entry" if the parent isn't a span of the same trace and service, else "local"."""
    known = spans.select("trace_id", "service", F.col("span_id").alias("parent_id")).distinct().withColumn("_in", F.lit(True))
    return spans.join(known, ["trace_id", "service", "parent_id"], "left").withColumn("span_type", F.when(F.col("_in"), "local").otherwise("entry")).drop("_in")


def otlp_logs(bodies: DataFrame, column: str = "value", chunk: int = 32_000) -> DataFrame:
    """OTLP log requests in JSON to (message, status, trace_id, span_id, tags, time_ns); long messages come in chunks 1 ms apart."""
    r = bodies.select(F.explode(F.from_json(column, OTLP_LOGS)["resourceLogs"]).alias("r"))
    s = r.select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeLogs").alias("s")).select("ra", F.explode("s.logRecords").alias("l"))
    time = F.coalesce(F.nullif(F.col("l.timeUnixNano").cast("bigint"), F.lit(0)), F.col("l.observedTimeUnixNano").cast("bigint"))
    status = severity(F.coalesce(F.col("l.severityNumber"), F.lit(0)), F.coalesce(F.lower("l.severityText"), F.lit("unknown")))
    rows = s.select(F.posexplode(chunks(F.coalesce(any_text(F.col("l.body")), F.lit("")), chunk)).alias("part", "message"), status.alias("status"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), merge_first(F.col("ra"), attributes(F.col("l.attributes"))).alias("tags"), time.alias("_t"))
    return rows.select("message", "status", "trace_id", "span_id", "tags", (F.col("_t") + F.col("part") * 1_000_000).alias("time_ns"))


def collapsed_stacks(lines: DataFrame, column: str = "value") -> DataFrame:
    """``a;b;c N`` lines to (stack, value); blank frames and lines without a number go."""
    pattern = r"^(.*)\s+(\d+)\s*$"
    rows = lines.filter(F.rlike(column, F.lit(pattern)))
    stack = F.filter(F.transform(F.split(F.regexp_extract(column, pattern, 1), ";"), lambda f: F.trim(f)), lambda f: f != "")
    return rows.select(stack.alias("stack"), F.regexp_extract(column, pattern, 2).cast("bigint").alias("value"))


def pprof_files(spark, path: str) -> DataFrame:
    """pprof protobuf files (gzip or plain) to (path, type, unit, stack, labels, value): root-first stacks of function names."""
    from lumenry.sources.pprof import samples

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return samples(files)


__all__ = ["any_text", "attributes", "collapsed_stacks", "db_host", "hex_id", "json_points", "merge_first", "otlp_logs", "otlp_metrics", "otlp_traces", "pprof_files", "prometheus", "prometheus_errors", "public_attributes", "span_types", "to_json_point"]
