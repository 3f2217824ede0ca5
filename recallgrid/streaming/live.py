"""Streams: tumbling and sliding counters, sessions, episodes and reinforcement, for any streaming DataFrame of events.

The reference semantics are those of a wall clock without late data; here event time rules, and the watermark is what
bounds the state (60 minutes of minute buckets unless told otherwise).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETENTION = "60 minutes"


def read_events(spark: SparkSession, folder: str, name: str, max_files: int = 100) -> DataFrame:
    """A file stream over ``<folder>/<name>``: a file, or a folder that new files come to."""
    like = spark.read.parquet(posixpath.join(folder, name))
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(posixpath.join(folder, f"{name}*"))


def minute_counts(events: DataFrame, key: str, ts: str = "ts", span: str = "1 minute", late: str = RETENTION) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, span).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def trending(events: DataFrame, key: str, ts: str = "ts", span: str = "15 minutes", slide: str = "1 minute", late: str = RETENTION) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, span, slide).alias("w"), key).agg(F.count("*").alias("velocity")).select(F.col("w.start").alias("start"), key, "velocity")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "2 seconds", late: str = RETENTION) -> DataFrame:
    """Ingestion sessions: they close after ``gap`` without a write."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def episodes(events: DataFrame, key: str, gap_s: float = 300.0, overlap: float = 0.5) -> DataFrame:
    """``events`` (key, memory_id, seconds, ord, cues) -> (memory_id, episode); the state of a key is its last event."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for m, t, o, c in sorted((r for f in frames for r in f[["memory_id", "seconds", "ord", "cues"]].itertuples(index=False, name=None)), key=lambda r: (r[1], r[2])):
            cues = list(c)
            near = last is not None and t - last[1] < gap_s and len(set(cues) & set(last[2])) / max(len(cues), 1) > overlap
            rows.append((m, f"episode:{last[0]}" if near else None))
            last = (m, float(t), cues)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["memory_id", "episode"])

    return events.groupBy(key).applyInPandasWithState(step, "memory_id string, episode string", "memory_id string, seconds double, cues array<string>", "append", GroupStateTimeout.NoTimeout)


def reinforced(events: DataFrame, key: str) -> DataFrame:
    """``events`` (key, seconds, ord, amount) -> (key, dynamic_salience, reinforcement_count) after each batch, the saturating
    boost folded in time order within the batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d, n = state.get if state.exists else (0.0, 0)
        for _, _, a in sorted(r for f in frames for r in f[["seconds", "ord", "amount"]].itertuples(index=False, name=None)):
            d, n = d + a / (1 + d), n + 1
        state.update((float(d), int(n)))
        yield pd.DataFrame([(k[0], d, n)], columns=[key, "dynamic_salience", "reinforcement_count"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, dynamic_salience double, reinforcement_count bigint", "d double, n bigint", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str, fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its result: for ``complete`` the last batch, else all batches.

    Every batch is written under its number, so that a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    base = posixpath.join(folder, f"stream-{uuid.uuid4().hex}")
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        done.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    out = [f"{base}/out/batch={n}" for n in (sorted(set(done))[-1:] if mode == "complete" else sorted(set(done)))]
    if not out:
        return spark.createDataFrame([], stream.schema)
    got = spark.read.parquet(*out)
    return fold(got) if fold else got


def refresh_heatmap(stream: DataFrame, path: str, seconds: int = 60):
    """Starts the query that keeps a heat map (cue, lift) at ``path`` up to date, every ``seconds``; gives the query back."""
    from recallgrid.operators.dynamics import heatmap

    def write(batch: DataFrame, number: int) -> None:
        heatmap(batch.groupBy("lex_id").agg(F.max("velocity").cast("double").alias("velocity"))).write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("update").foreachBatch(write).trigger(processingTime=f"{seconds} seconds").start()


def latency(query, keep: int = 1000) -> dict[str, float]:
    """Number, mean and 99th percentile (nearest rank) of the batch durations, in ms, of a stream's last ``keep`` batches."""
    ms = sorted(float(p["durationMs"].get("triggerExecution", 0)) for p in query.recentProgress[-keep:])
    return {"samples": len(ms), "avg_ms": sum(ms) / len(ms) if ms else 0.0, "p99_ms": ms[max(0, -(-99 * len(ms) // 100) - 1)] if ms else 0.0}


def watch(spark: SparkSession, folder: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """New and changed files of a folder as (path, modificationTime, content); deletions come from sync.changes."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
