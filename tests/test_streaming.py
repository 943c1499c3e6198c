"""Streams give what batches give."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from lumenry.operators import rules, sampling
from lumenry.streaming.streams import Queue, sample_stream, windowed

T0 = dt.datetime(2024, 1, 1)


def _events(spark, path):
    rows = [(T0 + dt.timedelta(seconds=s), k, float(v)) for s, k, v in [(0, "a", 1), (60, "a", 2), (61, "b", 3), (119, "a", 4), (4000, "z", 0)]]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.parquet(path)
    return spark.readStream.schema("ts timestamp, k string, v double").parquet(path)


def test_windowed_stream_matches_batch(spark, tmp_path):
    stream = _events(spark, str(tmp_path / "in"))
    algorithms = {"v": rules.Algorithm("sum", "v", 60)}
    windowed(stream, "ts", ["k"], algorithms, "v", "0 seconds", 60).writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.window_end, r.k): r.v for r in spark.table("w").collect()}
    base = int(T0.replace(tzinfo=dt.UTC).timestamp())
    assert got == {(base, "a"): 1.0, (base + 60, "a"): 2.0, (base + 120, "b"): 3.0, (base + 120, "a"): 4.0}


def test_sampler_decides_after_quiet(spark, tmp_path):
    stream = _events(spark, str(tmp_path / "in"))
    pipes = [sampling.Pipeline("big", condition="{v >= 4.0}")]
    sample_stream(stream, "ts", "k", pipes, 300).writeStream.format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.group_key: (r.spans, r.decision) for r in spark.table("s").collect()}
    assert got == {"a": (3, "keep"), "b": (1, "drop")}


def test_queue(spark, tmp_path):
    queue, seen = Queue(spark, str(tmp_path / "q")), []
    queue.put(spark.createDataFrame([(b"1",), (b"2",)], "payload binary"))
    queue.drain(lambda batch: seen.extend(bytes(r[0]) for r in batch.collect()), str(tmp_path / "c"))
    queue.put(spark.createDataFrame([(b"3",)], "payload binary"))
    queue.drain(lambda batch: seen.extend(bytes(r[0]) for r in batch.collect()), str(tmp_path / "c"))
    assert sorted(seen) == [b"1", b"2", b"3"]
    assert queue.trim(0) >= 2


def test_seven_second_windows_match_the_batch_form(spark, tmp_path):
    stream = _events(spark, str(tmp_path / "in"))
    algorithms = {"v": rules.Algorithm("sum", "v", 7), "sd": rules.Algorithm("stdev", "v", 7), "q": rules.Algorithm("quantiles", "v", 7, [0.5, 0.9])}
    windowed(stream, "ts", ["k"], {k: algorithms[k] for k in ("v", "q")}, "v", "0 seconds", 7).writeStream.format("memory").queryName("w7").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rule = rules.Rule("r", "metric", [], [], ["k"], {"v": algorithms["v"]})
    batch = rules.run_rule(spark.read.parquet(str(tmp_path / "in")), rule, "ts")["v"]
    want = {(r.window_end, r.k): r.v for r in batch.collect() if r.k != "z"}
    assert {(r.window_end, r.k): r.v for r in spark.table("w7").collect() if r.k != "z"} == want and len(want) == 4
    # one value has no deviation, so no window gives a row
    windowed(stream, "ts", ["k"], {"sd": algorithms["sd"]}, "v", "0 seconds", 7).writeStream.format("memory").queryName("sd7").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sd7").count() == 0


def test_distinct_counts_are_refused_on_streams(spark, tmp_path):
    stream = _events(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="count_distinct"):
        windowed(stream, "ts", ["k"], {"n": rules.Algorithm("count_distinct", "v", 60)}, "v", "0 seconds", 60)


def test_late_rows_do_not_shorten_a_session(spark, tmp_path):
    path = str(tmp_path / "in")
    for batch in ([(100, "a", 1)], [(10, "a", 2)], [(380, "z", 0)], [(390, "a", 5)], [(4000, "z", 0)]):
        rows = [(T0 + dt.timedelta(seconds=s), k, float(v)) for s, k, v in batch]
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their seconds
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(path)
    pipes = [sampling.Pipeline("big", condition="{v >= 4.0}")]
    sample_stream(stream, "ts", "k", pipes, 300, "200 seconds").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    # the row at 10 s comes after that at 100 s, so the group lives until 400 s and the row at 390 s still joins it
    assert [(r.group_key, r.spans, r.decision) for r in spark.table("late").collect() if r.group_key == "a"] == [("a", 3, "keep")]
