import datetime as dt

import pytest
from pyspark.sql import functions as F

from scriptwell.operators import governance, lineage
from scriptwell.schemas import ACCESS_LOG

NOW = dt.datetime(2030, 1, 1)


def access(i, path="/api/ai/ask", at=NOW, user="ann", status=200, ms=12.345):
    return (str(i), user, path, "GET", status, ms, "10.0.0.1", at)


@pytest.fixture(scope="module")
def log(spark):
    six = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([
        access(1, "/api/ai/ask", user=None), access(2, "/api/ai"), access(3, "/health"),
        access(4, "/api/rag/x", six - dt.timedelta(microseconds=1)),
        access(5, "/api/prescribers/1", six, status=503, ms=100.0)], ACCESS_LOG)


def test_extract_and_view(log):
    rows = {r.log_id: r for r in governance.audit_extract(log).collect()}
    assert set(rows) == {"1", "4", "5"} and rows["1"].username is None
    assert rows["1"].duration_ms == 12.35
    assert governance.get_phi_audit_logs(log, 10).first().log_id == "1"
    with pytest.raises(ValueError):
        governance.get_phi_audit_logs(log, 5)


def test_archive_twice(spark, log, folder):
    path = f"{folder}/archive"
    for _ in range(2):  # the first run makes the archive
        governance.archive_old(log, path, F.lit(NOW))
    assert [r.log_id for r in spark.read.parquet(path).collect()] == ["4"]


def test_append_access(spark, folder):
    governance.append_access(spark, f"{folder}/log", [
        {"username": "ann", "path": "/api/ai/x", "method": "GET", "status_code": 200,
         "duration_ms": 1.5, "client_ip": "10.0.0.1"}, {"path": "/api/rag/y"}])
    rows = spark.read.parquet(f"{folder}/log").collect()
    assert len({r.log_id for r in rows}) == 2 and all(r.accessed_at for r in rows)


def test_rollups(log):
    rows = governance.access_rollup(log).collect()
    assert sum(r.requests for r in rows) == 5 and sum(r.server_errors for r in rows) == 1
    assert {r.requests_per_second for r in rows} == {1 / 300}
    assert governance.request_counts(log).count() == 5
    quantiles = {r.path: (r.p50, r.p99) for r in governance.latency_quantiles(log).collect()}
    assert quantiles["/api/prescribers/1"] == (100.0, 100.0)


def test_lineage(spark, folder):
    path = f"{folder}/lineage"
    frame = spark.range(1)
    lineage.emit_layer_transition(spark, path, "clean", "bronze", "c", "silver", "c", 10, 9, frame)
    lineage.emit_layer_transition(spark, path, "build", "silver", "c", "gold", "d", 9, 0)
    events = spark.read.parquet(path)
    start = events.filter("event_type = 'START' AND job_name = 'clean'").first()
    done = events.filter("event_type = 'COMPLETE' AND job_name = 'clean'").first()
    assert start.outputs == [] and done.outputs[0].row_count == 9
    assert done.outputs[0].fields[0].name == "id" and done.inputs[0].row_count == 10
    assert start.run_id == done.run_id
    rows = {r.measure: r.value for r in lineage.graph_summary(events).collect()}
    assert rows == {"total_nodes": 3, "total_edges": 2, "healthy_count": 2}
    up = {r.dataset: r.distance for r in
          lineage.upstream(lineage.edges(events), "lake/gold/d").collect()}
    assert up == {"lake/silver/c": 1, "lake/bronze/c": 2}


def test_upstream_of_a_cycle_ends(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "source string, target string")
    assert {r.dataset for r in lineage.upstream(graph, "c").collect()} == {"a", "b"}
