"""Vectors and synonyms: cosine, neighbours, mean context, expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recallgrid.functions.cues import NO_EXPANSION, cue_key
from recallgrid.functions.scoring import cosine


def neighbours(queries: DataFrame, items: DataFrame, k: int = 5, floor: float = 0.6, block: int = 1 << 14) -> DataFrame:
    """(query_id, item_id, similarity, rank) for ``queries`` (query_id, vec) over ``items`` (item_id, vec), not itself.

    Every pair is scored, exactly: blocks of queries meet blocks of items as matrices, which leave the items of each query
    that come to its k-th similarity less what rounding may hide; those few are scored again and ranked over all blocks.
    Vectors of other lengths than the query's, and those with nulls, have no similarity. The work is the product of the two
    sides, in tasks of bounded memory.
    """
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    key = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    q, i = queries.where(whole), items.where(whole)
    nq, ni = (max(1, -(-d.count() // block)) for d in (q, i))
    size = F.size("vec").alias("size")
    q = q.select("query_id", "vec", size, key("query_id", nq, "qb"), F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("ib"))
    i = i.select("item_id", "vec", size, key("item_id", ni, "ib"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def unit(table):
        n = len(table)
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        m = flat.reshape(n, -1) if n else flat.reshape(0, 0)
        norm = np.sqrt((m * m).sum(1))
        return np.where(norm[:, None] < 1e-6, 0.0, m / np.where(norm < 1e-6, 1.0, norm)[:, None])

    def near(left, right):
        asked, have = left.column("query_id").combine_chunks(), right.column("item_id").combine_chunks()
        rows, cols = [], []
        if len(left) and len(right):
            with np.errstate(all="ignore"):
                a, b = unit(left), unit(right)
                for lo in range(0, len(a), 256):
                    s = a[lo : lo + 256] @ b.T
                    s = np.where(np.isnan(s), np.inf, s)  # as the engine orders them
                    m = min(k + 1, s.shape[1])  # one may be the query itself
                    bar = np.maximum(np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m], floor) - 1e-8
                    r, c = np.nonzero(s >= bar[:, None])
                    rows.append(r + lo)
                    cols.append(c)
        r, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
        return pa.table([asked.take(pa.array(r)), left.column("vec").combine_chunks().take(pa.array(r)), have.take(pa.array(c)), right.column("vec").combine_chunks().take(pa.array(c))], names=["query_id", "qv", "item_id", "vec"])

    schema = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("qv", q.schema["vec"].dataType), StructField("item_id", i.schema["item_id"].dataType), StructField("vec", i.schema["vec"].dataType)])
    on = ["size", "qb", "ib"]
    with_few = q.groupBy(*on).cogroup(i.groupBy(*on)).applyInArrow(near, schema).where(F.col("query_id") != F.col("item_id"))
    s = with_few.withColumn("similarity", cosine(F.col("qv"), F.col("vec"))).where(F.col("similarity") >= floor)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "item_id"))
    return s.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


def mean_vector(rows: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """(by, mean): mean of the vectors by place, in double precision."""
    e = rows.select(by, F.posexplode(F.transform(vec, lambda x: x.cast("double"))).alias("i", "x"))
    return e.groupBy(by, "i").agg(F.avg("x").alias("m")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("mean"))


def synonyms(cues: DataFrame, thesaurus: DataFrame, limit: int | None = None) -> DataFrame:
    """(memory_id, cue, ord): synonyms of the cues' words (``thesaurus``: word, synonym), but for keys that name things, the
    word itself and synonyms with a space."""
    key = F.coalesce(cue_key(F.col("cue")), F.lit(""))
    word = F.when(F.instr("cue", ":") > 0, F.substring_index("cue", ":", -1)).otherwise(F.col("cue"))
    c = cues.where(~key.isin(*NO_EXPANSION)).select("memory_id", word.alias("word")).distinct()
    s = c.join(thesaurus, "word").where((F.col("synonym") != F.col("word")) & ~F.contains("synonym", F.lit(" ")) & (F.length("synonym") > 2))
    s = s.select("memory_id", F.col("synonym").alias("cue")).distinct().withColumn("ord", F.row_number().over(Window.partitionBy("memory_id").orderBy("cue")))
    return s if limit is None else s.where(F.col("ord") <= limit)


def nouns_and_adjectives(words: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of ``words`` (word) whose tag (``tags``: word, tag) is a noun or an adjective."""
    return words.join(tags.where(F.col("tag").rlike("^(NN|JJ)")).select("word").distinct(), "word", "left_semi")


def read_vectors(spark, path: str) -> DataFrame:
    """(word, vec) from a text file of word vectors; a header of two numbers is skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("word"), F.transform(F.expr("slice(p, 2, size(p) - 1)"), lambda x: x.cast("float")).alias("vec"))
