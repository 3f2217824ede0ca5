"""Choosing memories for a token budget, the context block, and its signature."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from recallgrid.functions.scoring import estimate_tokens, stamp


def select_memories(results: DataFrame, budget: int = 2048) -> DataFrame:
    """``results`` (query_id, rank, memory_id, content, score, intersection_count, match_integrity, created_at, source) in rank
    order with tokens, chosen, place (of chosen ones, from 1), left (budget before it), why and reason.

    A memory that doesn't fit is passed over and later ones may still fit, so the fold runs over each query's rows in
    order: they come sorted to one task, which keeps the room left, the place and the query, and nothing else. A null
    content is neither chosen nor excluded.
    """
    fields = ["rank", "memory_id", "content", "score", "intersection_count", "match_integrity", "created_at", "source"]
    r = results.select("query_id", *fields).withColumn("tokens", estimate_tokens(F.col("content")))
    ordered = r.repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id").sortWithinPartitions("query_id", *fields)

    def fold(batches):
        now, left, place = object(), budget, 0
        for b in batches:
            ok, room, places = [], [], []
            for q, n in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if q != now:
                    now, left, place = q, budget, 0
                room.append(left)
                fits = None if n is None else n <= left
                if fits:
                    left, place = left - n, place + 1
                ok.append(fits)
                places.append(place)
            made = [pa.array(ok, pa.bool_()), pa.array(room, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "chosen", "left", "place"])

    schema = StructType([StructField(f.name, f.dataType) for f in r.schema]).add("chosen", BooleanType()).add("left", LongType()).add("place", IntegerType())
    flat = ordered.mapInArrow(fold, schema)
    why = F.format_string("Ranked #%d with score %.2f (%d matches, integrity %.2f)", "place", "score", "intersection_count", "match_integrity")
    reason = F.format_string("Exceeds remaining token budget (needs %d, has %d)", "tokens", "left")
    return flat.withColumn("why", F.when(F.col("chosen"), why)).withColumn("reason", F.when(~F.col("chosen"), reason))


def excluded(selection: DataFrame, top: int = 5) -> DataFrame:
    return selection.where(~F.col("chosen")).where(F.col("rank") - F.col("place") <= top)


def context_block(selection: DataFrame) -> DataFrame:
    """(query_id, block): the chosen memories in order; empty text where none was chosen."""
    line = F.format_string("(%d) %s (source=%s, id=%s, score=%.2f, ts=%s)", "place", "content", "source", "memory_id", "score", stamp(F.col("created_at")))
    c = selection.withColumn("line", F.when(F.col("chosen"), F.struct("place", line.alias("l"))))
    g = c.groupBy("query_id").agg(F.array_sort(F.collect_list("line")).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["l"]), "\n")
    return g.select("query_id", F.when(F.size("a") > 0, F.concat(F.lit("[VERIFIED CONTEXT]\n"), body, F.lit("\n[/VERIFIED CONTEXT]"))).otherwise(F.lit("")).alias("block"))


def signed(blocks: DataFrame, key: bytes, column: str = "block") -> DataFrame:
    """``blocks`` with signature: HMAC-SHA256 in hex."""

    @F.arrow_udf("string")
    def sign(a: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else hmac.new(key, x.as_py().encode(), hashlib.sha256).hexdigest() for x in a], pa.string())

    return blocks.withColumn("signature", sign(F.col(column)))
