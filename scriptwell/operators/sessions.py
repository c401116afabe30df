"""Chat sessions: newest turns and idle sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptwell.fixed_values import SESSION_CONTEXT_TURNS, SESSION_MAX_TURNS, SESSION_TTL_SECONDS
from scriptwell.operators.ranking import top_per_group


def get_history(turns: DataFrame, n: int = SESSION_MAX_TURNS,
                session: str = "session_id", order: str = "turn") -> DataFrame:
    """The newest n turns of each session."""
    return top_per_group(turns, [session], [F.desc(order)], n)


def context_turns(turns: DataFrame, n: int = SESSION_CONTEXT_TURNS,
                  order: str = "turn") -> DataFrame:
    """The newest n turns of each session as one array, oldest first."""
    return get_history(turns, n, order=order).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct(order, "role", "content"))).alias("turns"))


def _last_active(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.max("ts").alias("last_active"))


def idle_sessions(turns: DataFrame, now: Column, ttl: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Sessions with no activity for more than ttl seconds."""
    idle = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(
        F.col("last_active").cast("timestamp"))
    return _last_active(turns).withColumn("idle_seconds", idle).filter(
        F.col("idle_seconds") > ttl)


def evict_idle(turns: DataFrame, now: Column, ttl: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Turns of the sessions that stay."""
    return turns.join(idle_sessions(turns, now, ttl), "session_id", "left_anti")
