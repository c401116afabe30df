"""Ranks, top-n per group and first-row-per-key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.functions.columns import amount_band


def rank_desc(df: DataFrame, groups: Sequence[str], metric: str, name: str) -> DataFrame:
    """Plain window rank, for inputs already reduced to few rows per group."""
    window = Window.partitionBy(*groups).orderBy(F.desc(metric))
    return df.withColumn(name, F.rank().over(window))


def banded_rank_desc(df: DataFrame, groups: Sequence[str], metric: str, name: str) -> DataFrame:
    """Same ranks as `rank_desc` when one group may hold a large share of all rows.

    Rows fall into narrow value bands. Equal values collapse to one counted row before
    the shuffle, each (group, band) is ranked on its own, and the rows above a band are
    added from a small per-band total. No task ever sees a whole group. `df` is read
    twice, so hand in a stored table rather than a long lineage.
    """
    band = f"__{name}_band"
    keyed = df.withColumn(band, amount_band(metric))
    tallies = keyed.groupBy(*groups, band, metric).agg(F.count(F.lit(1)).alias("__n"))

    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, band).orderBy(F.desc(metric)).rowsBetween(*before)
    across = Window.partitionBy(*groups).orderBy(F.desc(band)).rowsBetween(*before)
    band_totals = (
        tallies.groupBy(*groups, band).agg(F.sum("__n").alias("__n"))
        .withColumn("__above", F.coalesce(F.sum("__n").over(across), F.lit(0)))
        .drop("__n")
    )
    positions = tallies.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    ranks = _join_null_safe(positions, band_totals, [*groups, band], "inner").select(
        *groups, band, metric, (F.col("__above") + F.col("__inside") + 1).cast("int").alias(name)
    )
    return _join_null_safe(keyed, ranks, [*groups, band, metric], "left").drop(band)


def quantiles(df: DataFrame, groups: Sequence[str], value: str,
              wanted: Mapping[str, str]) -> DataFrame:
    """Exact discrete quantiles per group; `wanted` gives a column name per fraction.

    As in `banded_rank_desc`, equal values collapse before the shuffle. Band totals tell
    which band holds a quantile, and only values inside that band are put in order.
    """
    tallies = (
        df.filter(F.col(value).isNotNull()).withColumn("__band", amount_band(value))
        .groupBy(*groups, "__band", value).agg(F.count(F.lit(1)).alias("__n")))
    group, ordered = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("__band")
    upto = F.sum("__n").over(ordered)
    fractions = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).cast("decimal(9,8)").alias("p"))
        for name, p in wanted.items()])
    place = F.greatest(F.ceil(F.col("__q.p") * F.col("__total")), F.lit(1)).cast("bigint")
    targets = (
        tallies.groupBy(*groups, "__band").agg(F.sum("__n").alias("__n"))
        .withColumns({"__before": upto - F.col("__n"), "__total": F.sum("__n").over(group)})
        .withColumn("__q", F.explode(fractions))
        .withColumn("__place", place - F.col("__before"))
        .filter((F.col("__place") > 0) & (F.col("__place") <= F.col("__n")))
        .select(*groups, "__band", F.col("__q.name").alias("__name"), "__place"))
    inside = Window.partitionBy(*groups, "__band").orderBy(value)
    running = tallies.withColumn("__upto", F.sum("__n").over(inside))
    found = _join_null_safe(running, targets, [*groups, "__band"], "inner").filter(
        (F.col("__place") <= F.col("__upto"))
        & (F.col("__place") > F.col("__upto") - F.col("__n")))
    return found.groupBy(*groups).agg(*[
        F.max(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in wanted])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b,
                  [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                  n: int) -> DataFrame:
    """First n rows of each group; Spark cuts to n per task before it shuffles."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
    )


def first_per_key(df: DataFrame, keys: Sequence[str],
                  order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key; by default the least by all other columns, so reruns agree."""
    rest = order or [F.asc(c) for c in df.columns if c not in keys]
    return top_per_group(df, keys, rest or [F.asc(k) for k in keys], 1)
