"""Change capture between two states of a file set, ids from contents, and snapshots."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def content_id(source: Column, content: Column) -> Column:
    return F.concat(source, F.lit(":"), F.sha2(content.cast("binary"), 256))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunks`` with memory_id ``file:<path>:<start>-<end>[:n]``; n numbers repeats of one place from 1."""
    n = F.row_number().over(Window.partitionBy("path", "start_line", "end_line").orderBy("ord")) - 1
    base = F.concat(F.lit("file:"), F.lower("path"), F.lit(":"), "start_line", F.lit("-"), "end_line")
    return chunks.withColumn("memory_id", F.when(n > 0, F.concat(base, F.lit(":"), n)).otherwise(base))


def changes(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, change, hash): added, changed, removed or same, by SHA-256 of the content; one full outer join on the key."""
    o = old.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("old_hash"), F.lit(True).alias("was"))
    n = new.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.lit(True).alias("is"))
    j = o.join(n, key, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("hash")), "same").otherwise("changed")
    return j.select(key, kind.alias("change"), "hash")


def apply_changes(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The state after the sync: new rows, changed ones replaced, removed ones gone."""
    same = changes(old, new, key).where("change = 'same'").select(key)
    return old.join(same, key, "left_semi").unionByName(new.join(same, key, "left_anti"))


def stale(memories: DataFrame, valid: DataFrame) -> DataFrame:
    """Memories of a file (id ``file:``) that the file has no more."""
    return memories.where(F.col("memory_id").startswith("file:")).join(valid.select("memory_id"), "memory_id", "left_anti")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, aside: str, path: str) -> None:
    """Moves ``aside`` to ``path``; what was there is kept until the move is done, and put back if it fails."""
    old = path.rstrip("/") + "._before"
    (new_p, fs), (to, _), (old_p, _) = _hadoop(spark, aside), _hadoop(spark, path), _hadoop(spark, old)
    fs.delete(old_p, True)
    had = fs.exists(to)
    if had and not fs.rename(to, old_p):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new_p, to):
        if had:
            fs.rename(old_p, to)
        raise OSError(f"the snapshot could not be moved to {path}")
    fs.delete(old_p, True)


def save_snapshot(memories: DataFrame, path: str, version: int = 1) -> None:
    """The memory table as Parquet by project, written aside and then moved into place; works on any file system of Spark."""
    aside = path.rstrip("/") + "._writing"
    memories.withColumn("snapshot_version", F.lit(version)).write.mode("overwrite").partitionBy("project_id").parquet(aside)
    _replace(memories.sparkSession, aside, path)


def save_state(memories: DataFrame, path: str) -> None:
    """The table of a single tenant in one folder, without projects."""
    aside = path.rstrip("/") + "._writing"
    memories.drop("project_id").write.mode("overwrite").parquet(aside)
    _replace(memories.sparkSession, aside, path)


def load_state(spark: SparkSession, path: str, project: str = "default") -> DataFrame:
    return spark.read.parquet(path).withColumn("project_id", F.lit(project))


def inspect_snapshot(memories: DataFrame) -> DataFrame:
    """(project_id, memory_id, cues, content_kind) of every memory, sorted by memory_id: what a snapshot holds, without
    its contents."""
    from recallgrid.functions.seal import is_compressed

    content = F.col("content")
    kind = F.when(content.isNull(), "null").when(is_compressed(content.cast("binary")), "zstd").otherwise("text or sealed")
    return memories.select("project_id", "memory_id", F.array_join("cues", ",").alias("cues"), kind.alias("content_kind")).orderBy("memory_id")


def copy_snapshot(spark: SparkSession, source: str, target: str) -> None:
    """Copies a snapshot between any two file systems that Spark's configuration knows (an upload or a download)."""
    (a, fa), (b, fb) = _hadoop(spark, source), _hadoop(spark, target)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, True, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} could not be copied to {target}")


def load_snapshot(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).drop("snapshot_version")
    return df.where(F.col("project_id") == project) if project else df


def list_snapshots(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _hadoop(spark, folder)
    return sorted(posixpath.basename(s.getPath().toString()) for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_snapshot(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.delete(p, True)


def folder_changes(known: DataFrame, files: DataFrame) -> DataFrame:
    """(path, change, hash) of a folder since ``known`` (path, hash), from its ``files`` (path, content) now; a file that is
    no more there is ``removed``, so that its memories can go."""
    now = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.lit(True).alias("is"))
    j = known.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was")).join(now, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("hash")), "same").otherwise("changed")
    return j.select("path", kind.alias("change"), "hash")


def forget_removed(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """``memories`` (with path) without those of files that were removed or changed; changed ones come anew from chunking."""
    gone = changes.where(F.col("change").isin("removed", "changed")).select("path")
    return memories.join(gone, "path", "left_anti")
