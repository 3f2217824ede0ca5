"""Counters in time: minute and day buckets, trends, heat, and ranking by salience and heat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.config import NOW
from recallgrid.functions.scoring import effective_salience


def buckets(events: DataFrame, seconds: int, key: str = "lex_id") -> DataFrame:
    """(key, bucket, n): events (key, ts in seconds) per span of time."""
    return events.groupBy(key, F.floor(F.col("ts") / seconds).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def retained(minutes: DataFrame, now: float, keep: int = 60) -> DataFrame:
    return minutes.where(F.col("bucket") >= int(now // 60) - keep)


def trending(minutes: DataFrame, now: float, window: int = 15, limit: int = 1000, key: str = "lex_id") -> DataFrame:
    """(key, velocity, rank) over the buckets from ``window`` minutes ago (that one included) to now."""
    v = minutes.where((F.col("bucket") >= int(now // 60) - window) & (F.col("bucket") <= int(now // 60))).groupBy(key).agg(F.sum("n").cast("double").alias("velocity"))
    return v.where("velocity >= 1").orderBy(F.desc("velocity"), key).limit(limit)


def heatmap(trend: DataFrame, key: str = "lex_id") -> DataFrame:
    """(cue, lift): log10(1 + velocity), 2 at most, over 0.1; ``cue:`` is cut off and the greatest counts."""
    lift = F.least(F.log10(1.0 + F.col("velocity")), F.lit(2.0))
    return trend.select(F.regexp_replace(key, "^cue:", "").alias("cue"), lift.alias("lift")).where("lift > 0.1").groupBy("cue").agg(F.max("lift").alias("lift"))


def by_salience_and_heat(memories: DataFrame, heat: DataFrame, now: float = NOW) -> DataFrame:
    """(memory_id, score): effective salience and the lift of all cues."""
    lift = memories.select("memory_id", F.explode("cues").alias("cue")).join(heat, "cue").groupBy("memory_id").agg(F.sum("lift").alias("lift"))
    eff = effective_salience(F.col("intrinsic_salience"), F.col("dynamic_salience"), F.col("last_boosted_at"), now)
    return memories.join(lift, "memory_id", "left").select("memory_id", F.round(eff + F.coalesce("lift", F.lit(0.0)), 6).alias("score"))


def ripple(memories: DataFrame, results: DataFrame, token_col: str = "tokens", sources: int = 5, each: int = 10, amount: float = 0.5) -> DataFrame:
    """(query_id, memory_id, amount): what a recall sets off in other memories. The tokens of each of the best ``sources``
    results of a query (query_id, memory_id, rank) are asked with recall_fast for ``each`` memories; what comes, but for
    the source itself, is boosted once a query."""
    from recallgrid.operators.recall import recall_fast

    src = results.where(F.col("rank") <= sources).select(F.col("query_id").alias("asked_by"), "memory_id").distinct()
    own = src.select("memory_id").distinct().join(memories.select("memory_id", F.explode(token_col).alias("cue")), "memory_id")
    hit = recall_fast(memories, own.select(F.col("memory_id").alias("query_id"), "cue", F.lit(1.0).alias("weight")), limit=each).where("memory_id <> query_id")
    to = hit.select(F.col("query_id").alias("source_id"), "memory_id")
    return src.withColumnRenamed("memory_id", "source_id").join(to, "source_id").select(F.col("asked_by").alias("query_id"), "memory_id").distinct().withColumn("amount", F.lit(amount))
