"""Queries over edits of a memory table: insert, upsert, attach, delete, reinforcement and its trace in the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators import index as I
from recallgrid.plans.registry import query
from recallgrid.plans.views import MEM_PARTS, mem_orders, mem_parts, read, sql_cooc, sql_orders, sql_postings

_M = f"WITH mem AS ({MEM_PARTS})"
_CH = "ch AS (SELECT 'part:' || ps AS memory_id, 'by ' || n AS content, ['supplier', 'nation:' || k] AS cues FROM (SELECT s_suppkey * 3 AS ps, s_name AS n, s_nationkey AS k FROM supplier))"


def _changes(spark, sf):
    """A supplier's row for every third part: some meet a part, some are new."""
    s = read(spark, sf, "supplier")
    cues = F.array(F.lit("supplier"), F.concat(F.lit("nation:"), "s_nationkey"))
    new = s.select(F.lit("parts").alias("project_id"), F.concat(F.lit("part:"), F.col("s_suppkey") * 3).alias("memory_id"), F.concat(F.lit("by "), "s_name").alias("content"), cues.alias("cues"))
    return new.withColumns({"seq": F.lit(0).cast("bigint"), "created_at": F.lit(0.0), "intrinsic_salience": F.lit(1.0), "dynamic_salience": F.lit(0.0), "last_boosted_at": F.lit(0).cast("bigint"), "reinforcement_count": F.lit(0).cast("bigint")})


def _memories(spark, sf):
    return mem_parts(spark, sf).drop("tokens")


def _shown(df):
    return df.select("memory_id", "content", F.array_join(F.array_sort("cues"), ",").alias("cues"), F.round("dynamic_salience", 6).alias("dynamic_salience"), "reinforcement_count")


def _sql_upsert(cues: str) -> str:
    return f"""{_M}, {_CH} SELECT coalesce(m.memory_id, ch.memory_id) AS memory_id, coalesce(ch.content, m.content) AS content,
  array_to_string(list_sort(CASE WHEN ch.memory_id IS NULL THEN m.cues WHEN m.memory_id IS NULL THEN ch.cues ELSE {cues} END), ',') AS cues,
  round(coalesce(m.dynamic_salience, 0.0), 6) AS dynamic_salience, coalesce(m.reinforcement_count, 0) AS reinforcement_count FROM mem m FULL JOIN ch ON m.memory_id = ch.memory_id"""


@query(_sql_upsert("ch.cues"))
def memory_upsert(spark, sf):
    return _shown(I.upsert(_memories(spark, sf), _changes(spark, sf)))


@query(_sql_upsert("list_distinct(list_concat(m.cues, ch.cues))"))
def memory_upsert_merged(spark, sf):
    return _shown(I.upsert(_memories(spark, sf), _changes(spark, sf), overwrite_cues=False))


@query(f"{_M}, {_CH} SELECT mem.memory_id, array_to_string(list_sort(CASE WHEN ch.memory_id IS NULL THEN mem.cues ELSE list_distinct(list_concat(mem.cues, ch.cues)) END), ',') AS cues FROM mem LEFT JOIN ch ON mem.memory_id = ch.memory_id")
def memory_attach_cues(spark, sf):
    added = _changes(spark, sf).select("project_id", "memory_id", F.col("cues").alias("new_cues"))
    return _shown(I.attach_cues(_memories(spark, sf), added)).select("memory_id", "cues")


@query(f"{_M}, {_CH}, p AS ({sql_postings()}) SELECT cue, count(*) AS df FROM p WHERE memory_id NOT IN (SELECT memory_id FROM ch) GROUP BY 1")
def memory_delete(spark, sf):
    """Document frequencies once the changed memories are gone."""
    gone = _changes(spark, sf).select("project_id", "memory_id")
    return I.frequency(I.postings(I.delete(_memories(spark, sf), gone))).select("cue", "df")


_T = """t AS (SELECT 'ord:' || l_orderkey AS memory_id, ['status:' || o_orderstatus, 'priority:' || o_orderpriority] AS cues, l_orderkey * 10 + l_linenumber AS event_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""


def _touches(spark, sf):
    """A reinforcement of an order for each of its lines that came back."""
    li, o = read(spark, sf, "lineitem").where("l_returnflag = 'R'"), read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cues = F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("priority:"), "o_orderpriority"))
    return j.select(F.lit("orders").alias("project_id"), F.concat(F.lit("ord:"), "l_orderkey").alias("memory_id"), cues.alias("cues"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"))


@query(f"""WITH mem AS ({sql_orders()}), p AS ({sql_postings()}), {_T},
u AS (SELECT memory_id, cue, max(event_id) AS last FROM (SELECT memory_id, event_id, unnest([lower(c), lower(split_part(c, ':', 2))]) AS cue FROM (SELECT memory_id, event_id, unnest(cues) AS c FROM t)) GROUP BY 1, 2)
SELECT cue, p.memory_id, row_number() OVER (PARTITION BY cue ORDER BY (last IS NOT NULL) DESC, last DESC, seq DESC, p.memory_id) - 1 AS pos FROM p LEFT JOIN u USING (memory_id, cue)""")
def reinforced_positions(spark, sf):
    """Places in the lists once reinforcement has moved memories to the front."""
    post = I.touched_postings(I.postings(mem_orders(spark, sf)), _touches(spark, sf))
    return I.positioned(post).select("cue", "memory_id", F.col("pos").cast("bigint").alias("pos"))


@query(f"WITH mem AS (SELECT project_id, memory_id, cues FROM ({sql_orders()}) UNION ALL SELECT 'orders', 'ev:' || row_number() OVER (), cues FROM (WITH {_T} SELECT * FROM t)) SELECT cue_a, cue_b, sum(n)::BIGINT AS n FROM ({sql_cooc()}) GROUP BY 1, 2")
def reinforced_cooccurrence(spark, sf):
    """Co-occurrence of the orders grown by each reinforcement."""
    return I.grown_cooccurrence(I.cooccurrence(mem_orders(spark, sf)), _touches(spark, sf)).select("cue_a", "cue_b", "n")
