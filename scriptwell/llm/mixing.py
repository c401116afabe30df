"""Mixing sources to target weights.

Documents get hash-random keys. Within a source they are sorted by ranges of the key; the keys
are uniform, so equal ranges of the hash, as many as the source's size asks for, are balanced
without sampling. Sums per range give each range's offset, a window inside the range the rest:
a prefix sum that no task holds whole. A source's budget is cut exactly at its prefix sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.llm.common import WORD, text_or_empty, unused
from scriptwell.sources.workspace import write_once

KEY_RANGE = 16**15
#: Tables of at most this many rows, counted when stored, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 20_000


def source_targets(sources: DataFrame, cycle: int = 3, most_epochs: int = 3) -> DataFrame:
    """source, source_size -> with weight and target.

    Weights 1..cycle repeat along the sources' code-point order, null last. All sizes together
    are shared by weight; a source takes at most most_epochs times its size. With the sources in
    the order in which their ceilings are met as the level rises, the final level is the first at
    which the next ceiling holds.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn(
        "weight", (F.row_number().over(ordered) - 1) % cycle + 1) \
        .withColumn("ceiling", F.col("source_size") * most_epochs)
    rising = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onwards = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighed \
        .withColumn("left", F.sum("source_size").over(everything)
                    - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) \
        .withColumn("level", F.col("left") / F.sum("weight").over(onwards)) \
        .withColumn("holds", F.col("level") <= F.col("ceiling") / F.col("weight"))
    level = F.min(F.when(F.col("holds"), F.struct(F.col("ceiling") / F.col("weight"),
                                                  F.col("level")))).over(everything)["level"]
    return levels.withColumn("final", level).select(
        "source", "source_size", "weight",
        F.least(F.col("ceiling").cast("double"),
                F.coalesce(F.col("final") * F.col("weight"), F.lit(0.0))).alias("target"))


def _range_of(key: Column, ranges: Column) -> Column:
    return F.floor(key / F.lit(float(KEY_RANGE)) * ranges)


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast where its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", seed: int = 11, rows_per_range: int = 20_000,
                cycle: int = 3, most_epochs: int = 3) -> DataFrame:
    """One row per input row: doc_id, text_hash, source, size, source_size, target, taken.

    size counts the words of the text (null: 0). Whole epochs come first, the rest of the target
    is cut in key order; the document at the cut gives part of its words, so a source's taken
    words are its target rounded down. Documents without words take nothing. Null sources are one
    source, sorted last; null ids are ordinary rows. Repeated rows count as often as they occur.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sized = write_once(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat(
            F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
            text_or_empty(text_col))), 1, 15), 16, 10).cast("long").alias("key")),
        "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                          F.count("*").alias("n"))
    targets = write_once(
        source_targets(sources.select("source", "source_size"), cycle, most_epochs)
        .join(sources.select(F.col("source").alias("s"), "n"),
              F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")

    right = _small(targets).select(F.col("source").alias("s"), "source_size", "target", "n")
    keyed = sized.join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s") \
        .withColumn("piece", _range_of(F.col("key"), F.ceil(F.col("n") / rows_per_range)))
    earlier = Window.partitionBy("p_source").orderBy("p_piece") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_once(keyed.groupBy(F.col("source").alias("p_source"), F.col("piece").alias("p_piece")) \
        .agg(F.sum("size").alias("words")) \
        .withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words"),
        "mix-offsets")
    inside = Window.partitionBy("source", "piece").orderBy("key", "doc_id", "text_hash", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .join(_small(offsets), F.col("source").eqNullSafe(F.col("p_source"))
              & (F.col("piece") == F.col("p_piece")))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inner")))
    return placed.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"))


def mixture(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """The mixed corpus: each document as often as it was taken, the one at a source's cut
    shortened to its first words (joined by one space). Columns are those of docs."""
    id_, hash_, size_, taken_, copy_ = unused(
        docs.columns, "_id", "_hash", "_size", "_taken", "_copy")
    counts = taken.where("taken > 0").select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_),
        F.col("size").alias(size_), F.col("taken").alias(taken_)).distinct()
    found = docs.join(counts, docs[id_col].eqNullSafe(F.col(id_))
                      & (F.xxhash64(docs[text_col]) == F.col(hash_)))
    times = F.ceil(F.col(taken_) / F.col(size_)).cast("int")
    part = F.col(taken_) - (F.col(copy_) - 1) * F.col(size_)
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)),
                    F.lit(1), part.cast("int"))
    cut = F.when(part < F.col(size_), F.array_join(words, " ")).otherwise(F.col(text_col))
    return found.withColumn(copy_, F.explode(F.sequence(F.lit(1), times))) \
        .withColumn(text_col, cut).select(*docs.columns)
