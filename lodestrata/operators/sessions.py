"""Conversations as a table of turns: history, context and carried-over mentions; and the provider's rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 5


def history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """Adds ``context``: the questions of the last ``n`` turns before each turn, oldest first."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-n, -1)
    lines = F.transform(F.collect_list("question").over(w), lambda q: F.concat(F.lit("Q: "), q))
    return turns.withColumn("context", F.array_join(lines, "\n"))


def carried(turns: DataFrame) -> DataFrame:
    """Adds ``used``: the turn's own mentions, or where it has none those linked in the turn before."""
    w = Window.partitionBy("session_id").orderBy("turn")
    empty = F.array().cast("array<string>")
    before = F.coalesce(F.lag("linked").over(w), empty)
    return turns.withColumn("used", F.when(F.size(F.coalesce("mentions", empty)) == 0, before).otherwise(F.col("mentions")))


def clear(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    return turns.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def rolling_calls(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Adds ``in_window``: calls of the same provider in the ``seconds`` up to each call, itself included."""
    w = Window.partitionBy("provider").orderBy("at").rangeBetween(-(seconds - 1), 0)
    return calls.withColumn("in_window", F.count("*").over(w))


def quota(calls: DataFrame, per_minute: int, share: float = 0.85) -> DataFrame:
    """Calls beyond the share of the provider's limit that is used."""
    return rolling_calls(calls).where(F.col("in_window") > int(per_minute * share))


def quota_stats(calls: DataFrame, per_minute: int, share: float = 0.85, seconds: int = 60) -> DataFrame:
    """``provider, calls, over, over_percent``: how many calls went over the share of the limit that is used."""
    over = F.count(F.when(F.col("in_window") > int(per_minute * share), 1))
    return rolling_calls(calls, seconds).groupBy("provider").agg(F.count("*").alias("calls"), over.alias("over")).withColumn(
        "over_percent", 100.0 * F.col("over") / F.col("calls"))
