"""Aggregates, windows, sampling, points, profiles, checks and formats on small rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumenry import queries
from lumenry.functions import scalar
from lumenry.model import POINTS, to_points
from lumenry.operators import assertions, points, profiles, rules, sampling
from lumenry.operators.windows import window_end
from lumenry.plans.query import Query
from lumenry.sources import formats, line_protocol
from lumenry.sources.pprof import read_profile


def test_window_end_is_the_next_boundary(spark):
    df = spark.createDataFrame([(123_000_000, 10), (123_000_000, 1), (120_000_000, 10), (1_700_000_001_000_000, 10), (123_400_000, 0)], "t bigint, w int")
    got = [r[0] for w in (10, 1, 0) for r in df.filter(F.col("w") == w).select(window_end(F.col("t"), w)).collect()]
    assert got == [130, 120, 1_700_000_010, 123, 123]


def _frame(spark, values):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 5)
    return spark.createDataFrame([(i, t0 + dt.timedelta(seconds=i), float(v), "a") for i, v in enumerate(values)], "id bigint, ts timestamp_ntz, v double, g string")


@pytest.mark.parametrize("method, values, expected", [("sum", [1, 2, 3], 6), ("avg", [3, 4, 5], 4), ("count", [1, 2, 9], 3), ("min", [9, 3, 4], 3), ("max", [9, 3, 4], 9), ("stdev", [2, 4, 6], 2), ("first", [7, 8], 7), ("last", [7, 8], 8), ("count_distinct", [1, 1, 2], 2)])
def test_aggregates(spark, method, values, expected):
    rule = rules.Rule("r", "metric", [], ["v"], ["g"], {"v": rules.Algorithm(method, "v", 60)})
    row = rules.run_rule(_frame(spark, values), rule, "ts", seq="id")["v"].collect()
    assert len(row) == 1 and row[0]["v"] == expected and row[0]["v_count"] == len(values)


def test_quantiles_and_names(spark):
    rule = rules.Rule("r", "metric", [], [], [], {"v": rules.Algorithm("quantiles", "v", 60, [0.5, 0.95, 0.999])})
    row = rules.run_rule(_frame(spark, [10, 30, 20, 40]), rule, "ts")["v"].first()
    assert (row["v_P50"], round(row["v_P95"], 6)) == (25.0, 38.5) and "v_P99_9" in row.asDict()


def test_deviation_of_one_value_gives_no_row(spark):
    rule = rules.Rule("r", "metric", [], [], [], {"v": rules.Algorithm("stdev", "v", 60)})
    assert rules.run_rule(_frame(spark, [1]), rule, "ts")["v"].count() == 0


def test_rules_load_and_reject():
    text = """
default_window = "30s"
[[aggregate_rules]]
name = "a"
group_by = ["z", "b"]
[aggregate_rules.select]
category = "metric"
metric_name = ["reg:^v"]
condition = "{ g = 'a' }"
[aggregate_rules.algorithms.v]
method = "SUM"
window = 10
"""
    rule = rules.load_rules(text)[0]
    assert rule.group_by == ["b", "z"] and rule.algorithms["v"].window_s == 30 and rule.algorithms["v"].method == "sum"
    assert rules.rules_hash([rule]) == rules.rules_hash(rules.load_rules(text))
    for bad in ({"method": "expo_histogram"}, {"method": "quantiles", "percentiles": [2]}, {"method": "quantiles"}):
        with pytest.raises(rules.RuleError):
            rules.Algorithm(**bad)
    with pytest.raises(rules.RuleError):
        rules.Rule("x", "nothing", [], [], [], {})


def test_fork(spark):
    df = spark.createDataFrame([(1, 2, None)], "k bigint, f1 bigint, f2 double")
    assert [tuple(r) for r in rules.fork(df, ["f1", "f2"], ["k"]).collect()] == [(1, "f1", 2.0)]
    assert rules.fork(df, ["f1", "f2"], ["k"], []).count() == 0


def test_sampling_order_rate_and_rest(spark):
    df = spark.createDataFrame([("a", "error"), ("a", "ok"), ("b", "ok"), ("c", "slow")], "t string, status string")
    pipes = [sampling.Pipeline("e", condition="{status = 'error'}"), sampling.Pipeline("s", condition="{status = 'slow'}", action="drop")]
    got = {r.t: (r.decision, r.pipeline) for r in sampling.decide(df, ["t"], "t", pipes).collect()}
    assert got == {"a": ("keep", "e"), "b": ("drop", None), "c": ("drop", "s")}
    every = sampling.decide(df, ["t"], "t", [sampling.Pipeline("p", "probabilistic", rate=1.0)]).filter("decision = 'keep'").count()
    none = sampling.decide(df, ["t"], "t", [sampling.Pipeline("p", "probabilistic", rate=0.0)]).filter("decision = 'keep'").count()
    assert (every, none) == (3, 0)
    assert sampling.kept_rows(df, ["t"], "t", pipes).count() == 2
    with pytest.raises(ValueError):
        sampling.Pipeline("x")


def test_derived_histogram(spark):
    rows = [("t", "m", "h", "histogram", "", "", 12.0, 1_000_000), ("t", "m", "h", "histogram", "", "", 25.0, 2_000_000), ("t", "m", "s", "", "", "", 1.5, 1), ("t", "m", "x", "odd", "", "", 1.0, 1)]
    df = spark.createDataFrame(rows, "token string, measurement string, metric_name string, kind string, stage string, decision string, value double, time_us bigint")
    got = {(r.metric_name, r.field, r.le): r.value for r in sampling.derived(df, 15, [20.0, 1.0, 10.0]).collect()}
    assert got == {("s", "sum", ""): 1.5, ("h", "bucket", "1"): 0, ("h", "bucket", "10"): 0, ("h", "bucket", "20"): 1, ("h", "bucket", "+Inf"): 2, ("h", "sum", ""): 37, ("h", "count", ""): 2}


def _fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) % (1 << 64)
    return h


def test_scalars(spark):
    texts = ["", "a", "trace-1", "é漢😀", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(scalar.fnv1a_hex(F.col("t")), scalar.fnv1a_mod(F.col("t"), 10_000)).collect()
    assert [(r[0], r[1]) for r in got] == [(f"{_fnv(t.encode()):016x}", _fnv(t.encode()) % 10_000) for t in texts]
    one = spark.range(1)
    row = one.select(
        scalar.size_format(F.lit(1536)), scalar.size_format(F.lit(7)), scalar.trim_to(F.lit("héllo"), 3), scalar.adjust_kv(F.lit("a\nb\\\\")), scalar.chunks(F.lit("abcde"), 2), scalar.hex_id(F.lit(b"\x00\x00")), scalar.hex_id(F.lit(b"\x0a\xff")),
        scalar.detect_precision(F.lit(1_700_000_000_000)), scalar.prometheus_measurement(F.lit("a_b_c"), "p_"), scalar.convert_unit(F.lit(1500), "ms", "seconds"), scalar.plain_number(F.lit(2.0)), scalar.plain_number(F.lit(0.5)), scalar.base_name(F.lit("/a/b.go")), scalar.directory(F.lit("/a/b.go")), scalar.decimal_id(F.lit(b"\x01\x00")),
    ).first()
    assert list(row) == ["1.5000K", "7B", "hé", "a b", ["ab", "cd", "e"], "0", "0aff", "ms", "p_a_b", 1.5, "2", "0.5", "b.go", "/a", "256"]


def _point(spark, name, tags, fields):
    full = {k: {m: v.get(m) for m in "iufbds"} for k, v in fields.items()}
    return spark.createDataFrame([(None, "metric", name, 1, None, tags, full, [])], POINTS)


def test_check_repairs_and_warns(spark):
    got = points.check(_point(spark, "", {"a\\": "v\nw", "source": "x"}, {"f": {"f": float("inf")}, "a": {"i": 1}, "s": {"s": "text"}}), points.Limits(disabled=("source",), strings_allowed=False, required=(("status", "info"),))).first()
    assert got.name == "__default" and got.tags == {"a": "v w", "status": "info"} and set(got.fields) == {"f"} and int(got.fields["f"]["u"]) == (1 << 64) - 1
    assert {w.type for w in got.warns} == {"empty_name", "tag_repaired", "disabled_tag", "field_key_taken", "field_dropped", "required_status"}


def test_identity_and_merge(spark):
    a = _point(spark, "m", {"b": "2", "a": "1"}, {"x": {"i": 1}})
    b = _point(spark, "m", {"a": "1", "b": "2"}, {"y": {"i": 2}})
    import hashlib

    assert a.select(points.identity(F.col("name"), F.col("tags"))).first()[0] == hashlib.md5(b"ma1b2").hexdigest()
    merged = points.merge_by_identity(a.union(b)).collect()
    assert len(merged) == 1 and set(merged[0].fields) == {"x", "y"}
    assert points.same_points(a, a) and not points.same_points(a, b) and points.same_points(a, a.withColumn("tags", points.set_entry(F.col("tags"), "z", F.lit("9"))), ("z",))


def test_profiles(spark):
    df = formats.collapsed_stacks(spark.createDataFrame([("main;f;g 3",), ("main;f 2",), ("main;;h 0",), ("bad",)], "value string"))
    got = {r.path: r.value for r in profiles.flame(df, "stack", "value").collect()}
    assert got == {"main": 5, "main;f": 5, "main;f;g": 3}
    assert profiles.tree(list(got.items()))["children"]["main"]["value"] == 5
    part = spark.range(1).select(profiles.frame_parts(F.lit("github.com/a/b.(*T).Run (/x/y.go:12)"), "go").alias("p")).first().p
    assert (part.package, part.function, part.file, part.line) == ("github.com/a/b", "(*T).Run", "/x/y.go", 12)


def _same_tree(rows, stacks):
    """Whether flame_nodes' rows are the prefix tree of (stack, value) pairs, built by brute force."""
    ids, sums = {}, {}
    for stack, value in stacks:
        at = None
        for frame in stack:
            at = ids.setdefault((at, frame), len(ids))
            sums[at] = sums.get(at, 0) + value
    found, got = {None: None}, {}
    for r in sorted(rows, key=lambda r: r.depth):
        found[bytes(r.node)] = at = ids[found[r.parent and bytes(r.parent)], r.frame]
        got[at] = r.value
    return len(rows) == len(ids) and got == sums


def test_flame_of_whole_stacks(spark):
    deep = [f"f{i % 7}" for i in range(30_000)]
    stacks = [(deep, 2), (deep[:20_000] + ["x"], 3), (["a", "b"], 1), (["a;b"], 1), (["ab"], 5), (["a"], 4), ([], 9), (["a"], 0)]
    df = spark.createDataFrame(stacks, "stack array<string>, value bigint")
    assert _same_tree(profiles.flame_nodes(df, "stack", "value").collect(), [s for s in stacks if s[1]])
    keyed = profiles.flame_nodes(df.withColumn("k", F.col("value") % 2), "stack", "value", ("k",)).filter("k = 1").collect()
    assert _same_tree(keyed, [s for s in stacks if s[1] % 2])
    short = {r.path: r.value for r in profiles.flame(df.filter("size(stack) < 3"), "stack", "value").filter("depth = 1").collect()}
    assert short == {"a": 5, "a;b": 1, "ab": 5}
    docs = queries.read(spark, "/root/testdata/sf0.001", "documents").collect()
    assert _same_tree(queries.flame_whole_stacks(spark, "/root/testdata/sf0.001").collect(), [([w for w in (r.text or "").split(" ") if w], 1) for r in docs])


def test_pprof_bytes():
    def field(n, v):
        return bytes([n << 3]) + bytes([v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v

    strings = [b"", b"cpu", b"ns", b"main", b"leaf"]
    data = field(1, field(1, 1) + field(2, 2)) + field(2, field(1, bytes([2, 1])) + field(2, bytes([7]))) + field(4, field(1, 1) + field(4, field(1, 1))) + field(4, field(1, 2) + field(4, field(1, 2))) + field(5, field(1, 1) + field(2, 3)) + field(5, field(1, 2) + field(2, 4)) + b"".join(field(6, s) for s in strings)
    assert read_profile(data) == [{"type": "cpu", "unit": "ns", "stack": ["main", "leaf"], "labels": {}, "value": 7}]


def test_assertions(spark):
    df = spark.createDataFrame([("ok body", 5.0, None), ("bad", 50.0, None), ("x", 1.0, "refused")], "body string, ms double, err string")
    out = assertions.with_result(df, [assertions.text_assertion(F.col("body"), "body", contains="ok"), assertions.time_assertion(F.col("ms"), 5, False)], error=F.col("err")).collect()
    assert [(r.status, r.success) for r in out] == [("OK", 1), ("FAIL", -1), ("FAIL", -1)] and out[1].fail_reason.count(";") == 1 and out[2].fail_reason == "refused"
    inclusive = assertions.with_result(df, [assertions.time_assertion(F.col("ms"), 5, True)], "or").collect()
    assert [r.status for r in inclusive] == ["FAIL", "FAIL", "OK"]
    assert assertions.with_result(df, []).first().status == "OK" and assertions.with_result(df, [], "or").first().status == "FAIL"
    steps = spark.createDataFrame([([(True, False), (False, True), (False, False), (True, False)],)], "s array<struct<ok: boolean, allow_failure: boolean>>")
    row = steps.select(assertions.steps_result(F.col("s")).alias("r")).first().r
    assert (row.ran, row.ok) == (3, False)
    assertions.validate_netpath([{"field": "avg_rtt", "op": "lt", "target": "10ms"}, {"field": "reachable", "op": "eq", "target": "true"}])
    with pytest.raises(ValueError):
        assertions.validate_netpath([{"field": "avg_rtt", "op": "lt", "target": "fast"}])


def test_line_protocol_escapes_and_modes(spark):
    lines = spark.createDataFrame([(r'some\ name,t\,1=v\=2 f1=1i,f2=3,f3="a \"q\" b",f4=t,f5=18446744073709551615u 1700000000',), ("bad",), ("# note",), ("m f=1",)], "value string")
    rows = line_protocol.parse(lines, unit=None, default_time_ns=7).collect()
    assert rows[0].name == "some name" and rows[0].tags == {"t,1": "v=2"} and rows[0].time_ns == 1_700_000_000 * 10**9
    assert (rows[0].fields["f1"]["i"], rows[0].fields["f2"]["f"], rows[0].fields["f3"]["s"], rows[0].fields["f4"]["b"]) == (1, 3.0, 'a "q" b', True)
    assert rows[1].error and rows[2].time_ns == 7 and line_protocol.parse(lines, mode="drop").count() == 2
    good = line_protocol.parse(lines, mode="drop", unit=None)
    again = line_protocol.parse(good.select(line_protocol.encode(good).alias("value")))
    assert sorted(map(str, again.select("name", "tags", "fields").collect())) == sorted(map(str, good.select("name", "tags", "fields").collect()))
    assert len(line_protocol.bodies(good, 40).collect()) >= 1
    for bad in ("m", "m,a=1,a=2 f=1", "m f=1,f=2", 'm f="x', "m f=1 12x", ",a=b f=1"):
        with pytest.raises(line_protocol.LineError):
            line_protocol.parse_line(bad)


def test_prometheus_text(spark):
    text = ['# TYPE a counter', 'http_req_total{code="200",p="a\\"b"} 5 1000', "go_goroutines 7", 'lat_ms_bucket{le="+Inf"} 3', "lat_ms_sum 1.5", "up +Inf"]
    rows = {r.field: r for r in formats.prometheus(spark.createDataFrame([(t,) for t in text], "value string"), default="node").collect()}
    assert set(rows) == {"http_req_total", "go_goroutines", "lat_ms_sum", "up"} and rows["http_req_total"].tags == {"code": "200", "p": 'a"b'} and rows["http_req_total"].name == "http_req" and rows["go_goroutines"].name == "node"


def test_json_points_and_otlp(spark):
    lines = spark.createDataFrame([(json.dumps({"measurement": "m", "tags": {"a": "1"}, "fields": {"x": 1, "s": "t", "b": True}, "time": 5}),)], "value string")
    row = formats.json_points(lines).first()
    assert row.fields["x"]["f"] == 1.0 and row.fields["s"]["s"] == "t" and row.fields["b"]["b"] is True
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    body = {"resourceMetrics": [{"resource": {"attributes": [attr("host.name", "h")]}, "scopeMetrics": [{"metrics": [{"name": "lat", "histogram": {"aggregationTemporality": "2", "dataPoints": [{"attributes": [attr("host.name", "p")], "timeUnixNano": "9", "count": "3", "sum": 6.0, "bucketCounts": ["1", "2"], "explicitBounds": [5.0]}]}}, {"name": "g", "gauge": {"dataPoints": [{"asInt": "4", "timeUnixNano": "9"}, {"timeUnixNano": "9"}]}}]}]}]}
    got = {(r.field, r.le): r.value for r in formats.otlp_metrics(spark.createDataFrame([(json.dumps(body),)], "value string")).collect()}
    assert got == {("lat_count", None): 3, ("lat_sum", None): 6, ("lat_bucket", "5.0"): 1, ("lat_bucket", "+Inf"): 3, ("g", None): 4}
    logs = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "0", "observedTimeUnixNano": "5", "severityNumber": 17, "body": {"stringValue": "abcdef"}}]}]}]}
    out = formats.otlp_logs(spark.createDataFrame([(json.dumps(logs),)], "value string"), chunk=4).collect()
    assert [(r.message, r.status, r.time_ns) for r in out] == [("abcd", "error", 5), ("ef", "error", 1_000_005)]


def test_otlp_exponential_histogram(spark):
    point = {"timeUnixNano": "9", "count": "4", "sum": 6.0, "min": 0.5, "max": 3.0, "scale": 1, "zeroCount": "0", "positive": {"offset": -2, "bucketCounts": ["1", "3"]}}
    data = {"name": "e", "exponentialHistogram": {"aggregationTemporality": 2, "dataPoints": [point, {"timeUnixNano": "10", "count": "0"}]}}
    body = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [data]}]}]}
    rows = formats.otlp_metrics(spark.createDataFrame([(json.dumps(body),)], "value string")).collect()
    assert {(r.field, r.time_ns): r.value for r in rows} == {("e_count", 9): 4, ("e_sum", 9): 6, ("e_min", 9): 0.5, ("e_max", 9): 3, ("e_avg", 9): 1.5, ("e_count", 10): 0}
    assert {r.kind for r in rows} == {"exponentialHistogram"}


def test_points_round_trip_and_query(spark):
    df = _frame(spark, [1, 2, 3])
    pts = to_points(df, "g", "ts", ["g"], ["v", "id"])
    assert pts.first().fields["v"]["f"] == 1.0 and pts.first().time_ns == 1_704_067_205 * 10**9
    q = Query(df).where("{v > 1.0}").bucket("ts", 60).group(["bucket"], n=F.count(F.lit(1))).order("bucket").limit(5)
    assert q.df.first().n == 2


def test_protobuf_round_trip(spark):
    from lumenry.sources import point_pb
    from lumenry.sources.samples import random_points

    pts = random_points(spark, 50)
    back = point_pb.parse(point_pb.encode(pts, 7).withColumnRenamed("body", "value"))
    key = lambda df: sorted(str((r.name, sorted(r.tags.items()), sorted((k, tuple(v)) for k, v in r.fields.items()), r.time_ns)) for r in df.collect())
    assert key(back) == key(pts)
    odd = point_pb.write_points([{"name": "m", "tags": {"t": "é"}, "fields": {"n": {"i": -5, "u": None, "f": None, "b": None, "d": None, "s": None}, "u": {"i": None, "u": (1 << 64) - 1, "f": None, "b": None, "d": None, "s": None}}, "time_ns": -1}])
    got = point_pb.read_points(odd)[0]
    assert got["tags"] == {"t": "é"} and got["fields"]["n"]["i"] == -5 and int(got["fields"]["u"]["u"]) == (1 << 64) - 1 and got["time_ns"] == -1


def test_protocol_assertions(spark):
    row = spark.createDataFrame([(200, "hello", {"server": "x"}, 10.0, 3.0, "pong", 5, 1.0, 0.0, 10, 1_000_000, "CN=a", "CA", "TLS1.3")], "status_code int, body string, headers map<string,string>, response_ms double, dns_ms double, message string, hops int, rtt_avg double, loss_percent double, packets int, not_after_s bigint, subject string, issuer string, tls_version string")
    ok = [assertions.http_assertions("200", "hell", ("server", "x"), 10), assertions.tcp_assertions(10.5, "pong"), assertions.ping_assertions({"avg": ("lt", 2)}, ("leq", 0), ("geq", 10)), assertions.ssl_assertions(F.lit(0), 11, "CN=a", "CA", "TLS1.3", 11), assertions.websocket_assertions("pong", ("server", "x"), 10), assertions.grpc_assertions("hello", 10)]
    bad = [assertions.http_assertions("404"), assertions.tcp_assertions(10), assertions.tcp_assertions(12, with_dns=True), assertions.ssl_assertions(F.lit(0), 12), assertions.websocket_assertions("ping"), assertions.grpc_assertions(time_ms=9.0)]
    out = row
    for i, reasons in enumerate([*ok, *bad]):
        out = out.withColumn(f"r{i}", assertions.fold(reasons)[0])
    got = out.first()
    assert [got[f"r{i}"] for i in range(len(ok) + len(bad))] == ["OK"] * len(ok) + ["FAIL"] * len(bad)
    results = assertions.result_rows(assertions.with_result(row, ok[0]), "http", ["subject"], ["response_ms"]).first()
    assert results.tags == {"subject": "CN=a", "status": "OK", "proto": "http"} and results.success == 1


def test_encryption_and_tag_merge(spark):
    row = spark.range(1).select(scalar.decrypt(scalar.encrypt(F.lit("secret é"), "phrase"), "phrase"), scalar.merge_tags(F.create_map(F.lit("a.b"), F.lit("1")), F.create_map(F.lit("a_b"), F.lit("2"), F.lit("c"), F.lit("3")))).first()
    assert row[0] == "secret é" and row[1] == {"a_b": "1", "c": "3"}


def test_registered_aggregates_and_unused_options(spark):
    rules.register_aggregate("Spread", lambda v: F.max(v) - F.min(v))
    assert rules.Algorithm("spread", "value").method == "spread"
    with pytest.raises(rules.RuleError):
        rules.register_aggregate("mean", F.avg)
    with pytest.raises(rules.RuleError):
        rules.Algorithm("expo_histogram", "value")
    text = '[[aggregate_rules]]\n[aggregate_rules.select]\ncategory = "metric"\n[aggregate_rules.algorithms.v]\nmethod = "histogram"\n[aggregate_rules.algorithms.v.histogram_opts]\nbuckets = [1.0]\n'
    with pytest.warns(UserWarning, match="histogram_opts"):
        assert rules.load_rules(text)[0].algorithms["v"].method == "histogram"


def test_odd_arrays_and_attributes(spark):
    from lumenry.functions import scalar
    from lumenry.sources import formats

    one = spark.range(1)
    none, few = F.expr("cast(array() as array<double>)"), F.expr("array(3D)")
    assert one.select(scalar.sample_stdev(none), scalar.sample_stdev(few), scalar.percentile_of(none, 50), scalar.percentile_of(few, 99), scalar.to_whole(F.lit(-1.5)), scalar.to_whole(F.lit(-1.5), "floor")).first() == (None, None, 0.0, 3.0, -1, -2)
    body = '{"resourceMetrics":[{"resource":{"attributes":[{"key":"a.b","value":{"doubleValue":1.5}},{"key":"l","value":{"kvlistValue":{"values":[{"key":"x","value":{"boolValue":true}}]}}},{"key":"t","value":{"boolValue":true}},{"key":"gone","value":{}}]},"scopeMetrics":[{"metrics":[{"name":"m","gauge":{"dataPoints":[{"asInt":"4"}]}}]}]}]}'
    tags = formats.otlp_metrics(spark.createDataFrame([(body,)], "value string")).first().tags
    assert tags == {"a_b": "1.500000", "t": "true", "l": '{"values":[{"key":"x","value":{"boolValue":true}}]}'}
    given = F.from_json(F.lit('{"a":[{"key":"keep","value":{"stringValue":"long text"}},{"key":"drop","value":{"stringValue":"x"}}]}'), f"struct<a: {formats._ATTRS}>")["a"]
    assert one.select(formats.attributes(given, ("drop",), 4)).first()[0] == {"keep": "long"}


def _part(spark, tmp_path, keys):
    rows = [(k, f"ring {k}", "Brand#7", "LARGE", 1) for k in keys]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_sizes_of_large_keys(spark, tmp_path):
    # the query's SQL knows no unit over M; the operator does
    want = {0: "0B", 1: "1000B", 2: "1.9531K", 1048: "1023.4375K", 1049: "1.0004M", 4096: "3.9062M", 12288: "11.7188M", 1_073_741: "1023.9992M", 1_073_742: "1024.0002M", 1_199_999: "1144.4082M", 3_000_000_000: "2861022.9492M"}
    got = queries.check_adjust_size_precision(spark, _part(spark, tmp_path, want))
    assert {r.p_partkey: r["size"] for r in got.collect()} == want
    sizes = [F.lit(n).cast("bigint") for n in (1 << 30, (1 << 30) - (1 << 20), 3 << 40, 1 << 50)]
    assert list(spark.range(1).select(*(scalar.size_format(n) for n in sizes)).first()) == ["1.0000G", "1023.0000M", "3.0000T", "1.0000P"]
    assert spark.range(1).select(scalar.size_format(F.lit(1536), "B")).first()[0] == "1536B"


def test_durations_of_large_keys(spark, tmp_path):
    # the query's SQL knows no unit over us; the operator does
    want = {0: "0ns", 99: "990ns", 100: "1.00us", 12345: "123.45us", 99_999: "999.99us", 100_000: "1000.00us", 1_199_999: "11999.99us", 100_000_000: "1000000.00us", 3_000_000_007: "30000000.07us"}
    got = queries.scalar_texts(spark, _part(spark, tmp_path, want))
    assert {r.p_partkey: r.took for r in got.collect()} == want
    times = [F.lit(n).cast("bigint") for n in (999, 1500, 999_990, 1_000_000, 2_500_000, 10**9, 90 * 10**9)]
    assert list(spark.range(1).select(*(scalar.format_duration(n) for n in times)).first()) == ["999ns", "1.50us", "999.99us", "1.00ms", "2.50ms", "1.00s", "90.00s"]
    assert spark.range(1).select(scalar.format_duration(F.lit(1500), "ns")).first()[0] == "1500ns"
