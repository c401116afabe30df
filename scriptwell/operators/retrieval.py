"""Vector collections: upsert, search, context bundles, similarity cache."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from scriptwell.fixed_values import (
    CACHE_MIN_SIMILARITY,
    CACHE_TTL_SECONDS,
    KNOWLEDGE_MIN_SIMILARITY,
    PAST_QUERY_MIN_SIMILARITY,
)
from scriptwell.functions.vectors import best_rows
from scriptwell.operators.ranking import top_per_group
from scriptwell.schemas import COLLECTION

# Vectors by question id, or a table with columns question_id (unique) and embedding.
Questions = Mapping[str, Sequence[float]] | DataFrame

# Questions compared in one pass over a collection; more questions take more passes.
QUESTIONS_PER_PASS = 1024
# Hits of all questions together that are broadcast to look up their documents; more are shuffled.
BROADCAST_HITS = 50_000


def upsert(collection: DataFrame, changes: DataFrame) -> DataFrame:
    """Collection after the changes: a changed id takes the newest of its changes, whatever the
    time of the row it replaces. Rows of the collection are only filtered by the changed ids."""
    newest = top_per_group(changes, ["id"], [F.desc("ts"), F.asc("document")], 1)
    return collection.join(newest.select("id"), "id", "left_anti").unionByName(newest)


def count(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count(F.lit(1)).alias("documents"))


def reset_collection(spark: SparkSession, path: str) -> None:
    """Overwrite a stored collection with no rows."""
    spark.createDataFrame([], COLLECTION).write.mode("overwrite").parquet(path)


def where(collection: DataFrame, conditions: Mapping[str, str] | None) -> DataFrame:
    """Rows whose metadata holds all the given values."""
    for key, value in (conditions or {}).items():
        collection = collection.filter(F.element_at("metadata", key) == F.lit(value))
    return collection


def _blocks(questions: Questions) -> Iterator[tuple[list[str], np.ndarray]]:
    """Ids and vectors of questions, in blocks of about QUESTIONS_PER_PASS of one length. A table
    is dealt into blocks by a hash of the id, and only one block at a time is on the driver."""
    if not isinstance(questions, DataFrame):
        names = list(questions)
        for at in range(0, len(names), QUESTIONS_PER_PASS):
            block = names[at:at + QUESTIONS_PER_PASS]
            yield block, np.array([questions[n] for n in block], dtype=np.float64)
        return
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = questions.select(F.col("question_id").cast("string").alias("question_id"),
                             vector.alias("embedding")).filter(finite)
    for size, n in sorted(whole.groupBy(F.size("embedding")).count().collect()):
        blocks = -(-n // QUESTIONS_PER_PASS)
        number = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
        for block in range(blocks):
            rows = whole.filter((F.size("embedding") == size) & (number == block)).collect()
            if rows:
                yield [r["question_id"] for r in rows], np.array([r["embedding"] for r in rows])


def _ranked(rows: DataFrame, questions: Questions, k: int,
            group: str | None = None) -> tuple[DataFrame, int]:
    """(id, question_id, similarity, rank) of the k best rows of each question, within each value
    of a group column if there is one; and how many questions there are."""
    columns = ["id"] + ([group] if group else [])
    schema = "id string, question_id string, similarity double" + (
        f", {group} string" if group else "")
    passes, asked = [], 0
    for names, vectors in _blocks(questions):
        kernel = best_rows(names, vectors, "id", "embedding", k, group)
        passes.append(rows.select(*columns, "embedding").mapInArrow(kernel, schema))
        asked += len(names)
    found = reduce(DataFrame.unionByName, passes) if passes else \
        rows.sparkSession.createDataFrame([], schema)
    best_first = Window.partitionBy("question_id", *([group] if group else [])).orderBy(
        F.desc("similarity"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best_first)).filter(
        F.col("rank") <= k), asked


def search(collection: DataFrame, questions: Questions, k: int = 5,
           conditions: Mapping[str, str] | None = None,
           min_similarity: float | None = None) -> DataFrame:
    """The k most similar documents of each question, exact cosine, best first by `rank`.

    A block of question vectors goes to the tasks, which compare ids and vectors only and keep
    their best k rows per question while batches pass; more blocks take more passes. Documents and
    metadata are then looked up for the few hits, which are broadcast up to BROADCAST_HITS. Ids must
    be unique, as `upsert` keeps them. Questions whose vector is null or holds null or non-finite
    values find nothing; no question finds documents of another vector length.
    """
    rows = where(collection, conditions)
    ranked, asked = _ranked(rows, questions, k)
    hits = ranked.withColumn("similarity", F.round("similarity", 4))
    if min_similarity is not None:
        hits = hits.filter(F.col("similarity") >= min_similarity)
    if asked * k <= BROADCAST_HITS:
        hits = F.broadcast(hits)  # k rows per question at most
    return rows.select("id", "document", "metadata").join(hits, "id").select(
        "question_id", "id", "document", "metadata", "similarity", "rank")


def rejected_vectors(collection: DataFrame, dim: int) -> DataFrame:
    """Rows that no search of dim dimensions can compare, with the reason."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), "null") \
        .when(F.size(v) != dim, "length").when(odd, "not finite")
    return collection.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def retrieve_knowledge(collection: DataFrame, questions: Questions, k: int = 3) -> DataFrame:
    return search(collection, questions, k, min_similarity=KNOWLEDGE_MIN_SIMILARITY)


def retrieve_past_queries(collection: DataFrame, questions: Questions, k: int = 3) -> DataFrame:
    return search(collection, questions, k, min_similarity=PAST_QUERY_MIN_SIMILARITY)


def context_bundle(questions: Questions, knowledge: DataFrame, schemas: DataFrame,
                   history: DataFrame, k: int = 3,
                   history_similarity: float = PAST_QUERY_MIN_SIMILARITY) -> DataFrame:
    """Per question the retrieved knowledge, tables and past queries with their counts.

    The three collections are scored in one pass, each with its own best rows.
    """
    spark = knowledge.sparkSession
    asked = questions.select(F.col("question_id").cast("string").alias("question_id")) if isinstance(
        questions, DataFrame) else spark.createDataFrame([(q,) for q in questions],
                                                         "question_id string")
    shapes = {
        "domain_knowledge": (knowledge, KNOWLEDGE_MIN_SIMILARITY, "knowledge_chunks",
                             F.col("document")),
        "relevant_tables": (schemas, KNOWLEDGE_MIN_SIMILARITY, "schema_chunks", F.struct(
            F.element_at("metadata", "table").alias("table"),
            F.col("document").alias("description"))),
        "similar_past_queries": (history, history_similarity, "query_examples", F.struct(
            F.element_at("metadata", "question").alias("question"),
            F.element_at("metadata", "sql").alias("sql"), "similarity")),
    }
    rows = reduce(DataFrame.unionByName, [
        df.select("id", "document", "metadata", "embedding", F.lit(name).alias("kind"))
        for name, (df, _, _, _) in shapes.items()])
    ranked, n = _ranked(rows, questions, k, "kind")
    least = reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1][1]), shapes.items(), F)
    hits = ranked.withColumn("similarity", F.round("similarity", 4)).filter(
        F.col("similarity") >= least)
    if n * k * len(shapes) <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    found = rows.select("kind", "id", "document", "metadata").join(hits, ["kind", "id"])
    # At most k hits per question and collection are gathered.
    gathered = found.groupBy("question_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == name, F.struct(
            "rank", shape.alias("hit"))))).alias(name)
        for name, (_, _, _, shape) in shapes.items()])
    bundle = asked.join(gathered, "question_id", "left")
    for name, (_, _, counted, _) in shapes.items():
        bundle = bundle.withColumn(
            name, F.coalesce(F.transform(name, lambda x: x["hit"]), F.array())
        ).withColumn(counted, F.size(name))
    return bundle


def cache_entry(df: DataFrame, question: str, embedding: str, sql: str, summary: str,
                row_count: str, now: Column) -> DataFrame:
    """Rows to append to a cache collection; the id is stable across runs."""
    return df.select(
        F.format_string("cache_%d_%d", F.abs(F.xxhash64(question)),
                        F.unix_seconds(now.cast("timestamp"))).alias("id"),
        F.col(question).alias("document"),
        F.create_map(
            F.lit("sql"), F.col(sql), F.lit("summary"), F.col(summary),
            F.lit("row_count"), F.col(row_count).cast("string"),
        ).alias("metadata"),
        F.col(embedding).alias("embedding"), now.cast("timestamp_ntz").alias("ts"))


def history_entry(df: DataFrame, question: str, embedding: str, sql: str, row_count: str,
                  now: Column) -> DataFrame:
    """Rows to append to the collection of answered questions."""
    return df.select(
        F.format_string("q_%d", F.abs(F.xxhash64(question))).alias("id"),
        F.col(question).alias("document"),
        F.create_map(
            F.lit("question"), F.col(question), F.lit("sql"), F.col(sql),
            F.lit("row_count"), F.col(row_count).cast("string"),
        ).alias("metadata"),
        F.col(embedding).alias("embedding"), now.cast("timestamp_ntz").alias("ts"))


def _age_seconds(now: Column) -> Column:
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))


def cache_lookup(cache: DataFrame, questions: Questions, now: Column,
                 min_similarity: float = CACHE_MIN_SIMILARITY,
                 ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Fresh cached answers. Only the best hit counts: if it is too old, it is a miss."""
    with_time = cache.withColumn(
        "metadata", F.map_concat("metadata", F.create_map(
            F.lit("age_seconds"), _age_seconds(now).cast("string"))))
    best = search(with_time, questions, 1, min_similarity=min_similarity)
    fresh = best.filter(F.element_at("metadata", "age_seconds").cast("bigint") <= ttl)
    return fresh.select(
        "question_id", "id", F.element_at("metadata", "sql").alias("generated_sql"),
        F.element_at("metadata", "summary").alias("summary"),
        F.coalesce(F.element_at("metadata", "row_count").cast("bigint"), F.lit(0))
        .alias("row_count"),
        F.lit(True).alias("from_cache"), F.col("similarity").alias("cache_similarity"))


def fresh_entries(cache: DataFrame, now: Column, ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    return cache.filter(_age_seconds(now) <= ttl)


def evict_expired_entries(cache: DataFrame, now: Column, path: str,
                          ttl: int = CACHE_TTL_SECONDS) -> int:
    """Write the cache without expired rows to a new path; returns how many it dropped."""
    seen = Observation()
    expired = _age_seconds(now) > ttl
    observed = cache.observe(seen, F.count_if(expired).alias("dropped"))
    observed.filter(~expired).write.mode("errorifexists").parquet(path)
    return seen.get["dropped"]
