"""Operations: statistics, latency, jobs, tenants, payloads, metrics text."""

from __future__ import annotations

import resource

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.seal import decompressed, is_compressed
from recallgrid.operators.index import postings


def project_stats(memories: DataFrame, cooc: DataFrame | None = None) -> DataFrame:
    """(project_id, total_memories, total_cues, total_postings)."""
    m = memories.groupBy("project_id").agg(F.count("*").alias("total_memories"))
    p = postings(memories).groupBy("project_id").agg(F.countDistinct("cue").alias("total_cues"), F.count("*").alias("total_postings"))
    return m.join(p, "project_id", "left")


def latency(samples: DataFrame, by: str = "metric", keep: int = 1000) -> DataFrame:
    """(by, samples, avg_ms, p99_ms) over the last ``keep`` samples (by, seq, ms); p99 is the nearest rank."""
    last = samples.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("r") <= keep)
    return last.groupBy(by).agg(F.count("*").alias("samples"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY ms)").alias("p99_ms"))


def job_progress(sessions: DataFrame) -> DataFrame:
    """Totals over sessions (phase, total, completed): one row, with what is pending."""
    return sessions.agg(F.count("*").alias("sessions"), F.sum("total").alias("total"), F.sum("completed").alias("completed"), (F.sum("total") - F.sum("completed")).alias("pending"), F.count_if(F.col("phase") == "done").alias("done_sessions"))


def valid_project(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}_-]+$") & F.octet_length(name).between(3, 64)


def encrypted(content: Column, key: Column) -> Column:
    return F.aes_encrypt(content, key, F.lit("GCM"))


def opened(plain: Column) -> Column:
    """Text of what a payload holds: a zstd frame is unpacked; a mark where there is nothing."""
    text = F.when(is_compressed(plain), decompressed(plain)).otherwise(plain)
    return F.coalesce(text.cast("string"), F.lit("<decryption failed>"))


def readable(payload: Column, key: Column) -> Column:
    """Text of a payload; a mark where it can't be decrypted."""
    return opened(F.try_aes_decrypt(payload, key, F.lit("GCM")))


def authorized(api_key: Column, keys: tuple[str, ...]) -> Column:
    """Whether a request's key is one of ``keys``; all are let in where there are none."""
    return F.coalesce(api_key.isin(*keys), F.lit(False)) if keys else F.lit(True)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """(line): ``metrics`` (name, help, kind, value) in the text format that scrapers read."""
    lines = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"), F.concat("name", F.lit(" "), F.format_string("%.6f", F.col("value").cast("double"))))
    return metrics.select("name", F.posexplode(lines).alias("ord", "line"))


def rss_bytes() -> int:
    """Memory that this process has now (its peak where the system doesn't tell)."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    except OSError:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
