from __future__ import annotations

import pytest

from tidelog.operators.windows import scan
from tidelog.plans.reference import FROM_MS, TO_MS
from tidelog.sources import layout
from tidelog.sources.cdclog import LogReader, Span, bucket_of


def test_stored_scan_prunes_and_agrees(spark, small, tmp_path):
    log = spark.read.parquet(f"{small}/scalar_scylla_cdc_log.parquet")
    path = str(tmp_path / "log")
    layout.store(log, path, buckets=8)
    streams = [bytes(r[0]) for r in log.select("cdc$stream_id").distinct().limit(3).collect()]
    for chosen in (None, streams, []):
        got = layout.stored_scan(spark, path, FROM_MS, TO_MS, chosen, buckets=8)
        want = scan(log, FROM_MS, TO_MS, chosen)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = layout.stored_scan(spark, path, FROM_MS, TO_MS, streams, buckets=8)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "log_day" in filters and "log_bucket" in filters
    assert spark.read.parquet(path).count() == log.count()
    with pytest.raises(ValueError, match="8 buckets"):
        layout.store(log, path, buckets=4)
    kept = {r[0]: bytes(r[1]) for r in spark.read.parquet(path).select("log_bucket", "cdc$stream_id").distinct().collect()}
    assert all(bucket_of(s, 8) == b for b, s in kept.items())
    reader = LogReader({"path": path})
    narrow = reader.partitions({"ms": FROM_MS}, {"ms": FROM_MS + 30_000})
    files = {f for x in narrow for f, _ in x.files}
    assert files and all("log_day=20473" in f for f in files)
    tasks = [Span(None, FROM_MS, TO_MS, [[streams[0]]])]
    reader.spans = lambda *_: tasks
    files = {f for x in reader.partitions({}, {}) for f, _ in x.files}
    assert files and all(f"log_bucket={bucket_of(streams[0], 8)}/" in f for f in files)


def test_stream_source_reads_the_layout(spark, small, tmp_path):
    from tidelog.streaming.engine import CdcEngine

    log = spark.read.parquet(f"{small}/scalar_scylla_cdc_log.parquet")
    layout.store(log, str(tmp_path / "log"), buckets=2)
    got = CdcEngine(spark, str(tmp_path / "log"), now_ms=1_771_545_600_000).read_once()
    assert got.columns == log.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, log.collect()))
