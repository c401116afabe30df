"""Lineage: run events of layer transitions and the dataset graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptwell.schemas import LINEAGE_EVENT
from scriptwell.sources.workspace import write_once

NAMESPACE = "claims_lake"


def _dataset(root: str, layer: str, table: str, rows, columns) -> dict:
    return {"namespace": NAMESPACE, "name": f"{root}/{layer}/{table}", "row_count": rows,
            "fields": columns}


def transition_events(spark: SparkSession, job_name: str, in_layer: str, in_table: str,
                      out_layer: str, out_table: str, rows_in: int, rows_out: int,
                      out_frame: DataFrame | None = None, run_id: str | None = None,
                      root: str = "lake") -> DataFrame:
    """START and COMPLETE rows of one job; only COMPLETE names the output."""
    run = run_id or str(uuid.uuid4())
    columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in out_frame.schema
               ] if out_frame is not None else []
    source = _dataset(root, in_layer, in_table, rows_in, [])
    result = _dataset(root, out_layer, out_table, rows_out, columns)
    events = [
        {"event_type": kind, "event_time": None, "run_id": run, "job_namespace": NAMESPACE,
         "job_name": job_name, "inputs": [source], "outputs": outputs}
        for kind, outputs in (("START", []), ("COMPLETE", [result]))
    ]
    return spark.createDataFrame(events, LINEAGE_EVENT).withColumn(
        "event_time", F.current_timestamp())


def emit_layer_transition(spark: SparkSession, path: str, *args, **kwargs) -> None:
    transition_events(spark, *args, **kwargs).write.mode("append").parquet(path)


def edges(events: DataFrame) -> DataFrame:
    """Dataset to dataset edges of the completed runs, with their job."""
    done = events.filter(F.col("event_type") == "COMPLETE")
    pairs = done.select("job_name", F.explode("inputs").alias("i"), "outputs").select(
        "job_name", F.col("i.name").alias("source"), F.explode("outputs").alias("o"))
    return pairs.select("source", F.col("o.name").alias("target"), "job_name").distinct()


def nodes(events: DataFrame) -> DataFrame:
    """Datasets with their last seen row count; one with rows is healthy."""
    done = events.filter(F.col("event_type") == "COMPLETE")
    seen = done.select("event_time", F.explode(F.concat("inputs", "outputs")).alias("d"))
    return seen.groupBy(F.col("d.name").alias("name")).agg(
        F.max_by("d.row_count", "event_time").alias("row_count")
    ).withColumn("healthy", F.coalesce(F.col("row_count") > 0, F.lit(False)))


def graph_summary(events: DataFrame) -> DataFrame:
    node_row = nodes(events).agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if("healthy").alias("healthy_count"))
    edge_row = edges(events).agg(F.count(F.lit(1)).alias("total_edges"))
    rows = node_row.unpivot([], ["total_nodes", "healthy_count"], "measure", "value").unionByName(
        edge_row.unpivot([], ["total_edges"], "measure", "value"))
    return rows


def upstream(graph: DataFrame, target: str) -> DataFrame:
    """All datasets a dataset is built from, with their distance.

    Each round follows the edges of the last one and leaves out what is known, so cycles
    end. The known datasets are kept with their round; a table written per round keeps the plans
    short.
    """
    links = write_once(graph.select("source", "target").distinct(), "lineage_links")
    known = graph.sparkSession.createDataFrame([(target, 0)], "dataset string, distance int")
    round_no = 0
    while True:
        last = known.filter(F.col("distance") == round_no)
        found = last.join(links, last.dataset == links.target).select(
            F.col("source").alias("dataset")).distinct() \
            .join(known.select("dataset"), "dataset", "left_anti") \
            .withColumn("distance", F.lit(round_no + 1))
        known = write_once(known.unionByName(found), "lineage_known")
        round_no += 1
        if known.filter(F.col("distance") == round_no).isEmpty():
            return known.filter(F.col("distance") > 0)


def upstream_rows(events: DataFrame, target: str) -> DataFrame:
    """dataset, distance and last seen row_count of all datasets behind one."""
    seen = nodes(events).select(F.col("name").alias("dataset"), "row_count")
    return upstream(edges(events), target).join(seen, "dataset", "left")
