"""Exact dedup with a heavy-hitter split.

Digests of normalised texts are counted in a frequent-items sketch of the Misra-Gries family
(``approx_top_k``), whose counters are merged over all partitions. What it proposes is counted
exactly; verified winners, at most ``max_winners`` rows, are broadcast and settle their copies
where these lie. All other digests have a bounded share of the rows and are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.llm.common import BLANK, text_or_empty
from scriptwell.sources.workspace import write_once


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = 4096, max_winners: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Ids that are null come after
    all others, so such a row stays only in a group without another id (keep_id is then null).
    Of rows that repeat both id and text exactly one is marked kept. An empty table gives an
    empty result; columns other than the two named are not read.
    """
    rows = write_once(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.regexp_replace(text_or_empty(text_col), BLANK, " "), 256).alias("digest"),
        F.monotonically_increasing_id().alias("row_id")), "exact-digests")

    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_id")
    total = rows.agg(F.count("*").alias("total"))
    proposed = rows.agg(F.expr(f"approx_top_k(digest, {max_winners}, {counters})").alias("top")) \
        .select(F.explode("top.item").alias("digest"))
    winners = rows.join(F.broadcast(proposed), "digest") \
        .groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("first")) \
        .join(F.broadcast(total), F.col("group_size") * counters > F.col("total")) \
        .where("group_size > 1").select("digest", "group_size", "first")

    split = rows.join(F.broadcast(winners), "digest", "left")
    heavy = split.where("first IS NOT NULL")
    alike = Window.partitionBy("digest")
    rest = split.where("first IS NULL").select(
        "digest", "doc_id", "row_id", F.count("*").over(alike).alias("group_size"),
        F.min(order).over(alike).alias("first"))
    return heavy.unionByName(rest).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("first.row_id") == F.col("row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))
