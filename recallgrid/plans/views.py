"""Memory views over the driver's tables, as DataFrames and as SQL (``WITH`` bodies for the oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.config import NOW
from recallgrid.functions import fast
from recallgrid.functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def _stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Deterministic statistics, so that every term of the score counts."""
    s = F.col(seq)
    return df.withColumns({"intrinsic_salience": F.lit(1.0), "dynamic_salience": (s % 7) / 7.0, "last_boosted_at": F.lit(NOW).cast("bigint") - (s % 48) * 600, "reinforcement_count": s % 13})


_STATS = f"1.0::DOUBLE AS intrinsic_salience, (seq % 7) / 7.0 AS dynamic_salience, {NOW} - (seq % 48) * 600 AS last_boosted_at, seq % 13 AS reinforcement_count"


def mem_doc_tokens(spark, sf_dir) -> DataFrame:
    """Documents with the tokens of their texts as cues."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    return _stats(d.select(F.lit("docs").alias("project_id"), F.concat(F.lit("doc:"), "doc_id").alias("memory_id"), F.col("text").alias("content"), fast.tokens(F.col("text")).alias("cues"), F.col("doc_id").alias("seq"), (F.col("doc_id") + F.lit(1704067200)).cast("double").alias("created_at"), "source", "lang"))


def mem_orders(spark, sf_dir, by_segment: bool = False) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    cues = F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("priority:"), "o_orderpriority"), F.concat(F.lit("year:"), F.year("o_orderdate")), F.concat(F.lit("segment:"), "c_mktsegment"))
    project = F.lower("c_mktsegment") if by_segment else F.lit("orders")
    return _stats(j.select(project.alias("project_id"), F.concat(F.lit("ord:"), "o_orderkey").alias("memory_id"), F.concat(F.lit("order "), "o_orderkey", F.lit(" of customer "), "o_custkey").alias("content"), cues.alias("cues"), F.col("o_orderkey").alias("seq"), F.floor(micros("o_orderdate") / 1e6).cast("double").alias("created_at")))


def sql_orders(by_segment: bool = False) -> str:
    project = "lower(c_mktsegment)" if by_segment else "'orders'"
    return f"""SELECT *, {_STATS} FROM (
  SELECT {project} AS project_id, 'ord:' || o_orderkey AS memory_id, 'order ' || o_orderkey || ' of customer ' || o_custkey AS content,
         ['status:' || o_orderstatus, 'priority:' || o_orderpriority, 'year:' || year(o_orderdate), 'segment:' || c_mktsegment] AS cues,
         o_orderkey AS seq, floor(epoch(o_orderdate))::DOUBLE AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)"""


def mem_parts(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    cues = F.array_distinct(F.concat(T.tokens(F.col("p_name")), F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"))))
    return _stats(p.select(F.lit("parts").alias("project_id"), F.concat(F.lit("part:"), "p_partkey").alias("memory_id"), F.col("p_name").alias("content"), cues.alias("cues"), F.col("p_partkey").alias("seq"), F.lit(1704067200.0).alias("created_at"), T.tokens(F.col("p_name")).alias("tokens")))


#: The list functions of the two engines order differently, so lists that are compared are sorted on both sides.
MEM_PARTS = f"""SELECT *, {_STATS} FROM (
  SELECT 'parts' AS project_id, 'part:' || p_partkey AS memory_id, p_name AS content, list_distinct(list_concat({T.sql_tokens("p_name")}, ['brand:' || p_brand, 'type:' || p_type])) AS cues,
         p_partkey AS seq, 1704067200.0::DOUBLE AS created_at, list_distinct({T.sql_tokens("p_name")}) AS tokens FROM part)"""


def mem_events(spark, sf_dir) -> DataFrame:
    """Events as memories of the project of their user; created_at and seq follow (ts, event_id)."""
    e = read(spark, sf_dir, "events")
    ts = micros("ts") / 1e6
    cues = F.array(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("k:"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))))
    return _stats(e.select(F.lit("events").alias("project_id"), F.concat(F.lit("ev:"), "event_id").alias("memory_id"), F.concat("event_type", F.lit(" by "), "user_id").alias("content"), cues.alias("cues"), F.col("event_id").alias("seq"), ts.alias("created_at"), "user_id"))


MEM_EVENTS = f"""SELECT *, {_STATS} FROM (
  SELECT 'events' AS project_id, 'ev:' || event_id AS memory_id, event_type || ' by ' || user_id AS content,
         ['type:' || event_type, 'user:' || user_id, 'k:' || coalesce(json_extract_string(props, '$.k'), '')] AS cues, event_id AS seq, epoch_us(ts) / 1e6 AS created_at, user_id FROM events)"""

MEM_DOC_TOKENS = f"""SELECT *, {_STATS} FROM (
  SELECT 'docs' AS project_id, 'doc:' || doc_id AS memory_id, text AS content, list_distinct({T.sql_tokens("text")}) AS cues,
         doc_id AS seq, (doc_id + 1704067200)::DOUBLE AS created_at, source, lang FROM documents WHERE text IS NOT NULL)"""


def sql_postings(mem: str = "mem") -> str:
    return f"""SELECT DISTINCT * FROM (SELECT project_id, memory_id, seq, unnest(CASE WHEN instr(c, ':') > 0 AND trim(substr(c, instr(c, ':') + 1)) <> '' THEN [c, trim(substr(c, instr(c, ':') + 1))] ELSE [c] END) AS cue
  FROM (SELECT project_id, memory_id, seq, trim(lower(unnest(cues))) AS c FROM {mem})) WHERE cue <> ''"""


def sql_cooc(mem: str = "mem") -> str:
    return f"""SELECT project_id, cue_a, cue_b, count(*) AS n FROM (
    SELECT a.project_id, a.c AS cue_a, b.c AS cue_b FROM (SELECT project_id, memory_id, trim(lower(c)) AS c, i FROM (SELECT project_id, memory_id, unnest(cues) AS c, generate_subscripts(cues, 1) AS i FROM {mem})) a
    JOIN (SELECT project_id, memory_id, trim(lower(c)) AS c, i FROM (SELECT project_id, memory_id, unnest(cues) AS c, generate_subscripts(cues, 1) AS i FROM {mem})) b
      ON a.project_id = b.project_id AND a.memory_id = b.memory_id AND a.i <> b.i AND a.c <> b.c AND a.c <> '' AND b.c <> '') GROUP BY ALL"""


def sql_recall(mem: str, queries: str, limit: int = 10, min_intersection: int | None = None, completion: bool = False, salience: bool = True, consolidation: bool = True, heat: str | None = None, scan_cap: bool = False, across: bool = False, head: str = "") -> str:
    """The whole recall as one statement; ``queries`` selects query_id, cue, weight."""
    fifth = ""
    q = "q"
    if completion:
        fifth = f""", co AS ({sql_cooc()}),
aq AS (SELECT DISTINCT q.query_id, q.cue, q.weight, p.project_id FROM q JOIN p ON p.cue = q.cue),
inf AS (SELECT aq.project_id, aq.query_id, co.cue_b AS cue, sum(co.n) AS total FROM aq JOIN co ON co.project_id = aq.project_id AND co.cue_a = aq.cue
        WHERE NOT contains(co.cue_b, ':') AND NOT contains(co.cue_b, co.cue_a) AND NOT EXISTS (SELECT 1 FROM aq z WHERE z.project_id = aq.project_id AND z.query_id = aq.query_id AND z.cue = co.cue_b) GROUP BY ALL),
q2 AS (SELECT project_id, query_id, cue, weight FROM aq UNION ALL
       SELECT project_id, query_id, cue, 0.1 FROM (SELECT *, row_number() OVER (PARTITION BY project_id, query_id ORDER BY total DESC, cue) AS r FROM inf) WHERE r <= 5)"""
        q = "q2"
    on = "x.cue = k.cue" + (" AND x.project_id = k.project_id" if completion else "")
    lift = f"LEFT JOIN (SELECT memory_id, sum(lift) AS lift FROM (SELECT memory_id, unnest(cues) AS cue FROM mem) JOIN ({heat}) h USING (cue) GROUP BY 1) l USING (memory_id)" if heat else ""
    sal = f"intrinsic_salience + dynamic_salience * pow(2.0, -greatest({NOW} - last_boosted_at, 0) / 3600.0) + {'coalesce(lift, 0.0)' if heat else '0.0'}" if salience else "0.0"
    where = ["true"] + ([f"least_pos < {min(limit * 100, 2000)}"] if scan_cap else []) + ([f"matches >= {min_intersection}"] if min_intersection else []) + ([] if consolidation else ["NOT list_contains(cues, 'type:summary')"])
    by = "query_id" if across else "project_id, query_id"
    return f"""WITH {head} mem AS ({mem}), p AS ({sql_postings()}), q AS (SELECT query_id, trim(lower(cue)) AS cue, max(weight) AS weight FROM ({queries}) GROUP BY 1, 2){fifth},
x AS (SELECT *, row_number() OVER (PARTITION BY project_id, cue ORDER BY seq DESC, memory_id) - 1 AS pos, count(*) OVER (PARTITION BY project_id, cue) AS len FROM p),
n AS (SELECT project_id, count(*) AS total FROM mem GROUP BY 1),
m AS (SELECT x.project_id, k.query_id, memory_id, pos, len, pos / sqrt(len) AS r, weight * greatest(CASE WHEN total - len + 0.5 > 0 THEN ln((total - len + 0.5) / (len + 0.5)) ELSE 0.1 END, 0.1) AS aw
      FROM x JOIN {q} k ON {on} JOIN n ON n.project_id = x.project_id),
c AS (SELECT project_id, query_id, memory_id, sum(aw) AS w, count(*) AS matches, avg(1.0 / (pos + 1.0)) AS rec, avg(20.0 / (r + 1.0)) AS w_rec, avg(1.0 + 5.0 * (1.0 - 1.0 / (r + 1.0))) AS w_freq, min(pos) AS least_pos FROM m GROUP BY 1, 2, 3),
s AS (SELECT c.*, seq, created_at, cues, CASE WHEN reinforcement_count > 0 THEN log10(reinforcement_count) ELSE 0.0 END AS f, {sal} AS sal FROM c JOIN mem USING (project_id, memory_id) {lift} WHERE {" AND ".join(where)}),
t AS (SELECT *, 100 * w + rec * w_rec + f * w_freq + 10 * sal AS score, least(1.0, 0.5 * w / greatest(matches, 1) + 0.3 * matches / len(cues) + 0.2 * least(f / 2, 1.0)) AS mi FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, seq DESC, memory_id) AS rk FROM t)
SELECT project_id, query_id, memory_id, round(score, 6) AS score, round(mi, 6) AS match_integrity, matches AS intersection_count, round(rec, 6) AS recency_score, round(f, 6) AS reinforcement_score, round(sal, 6) AS salience_score,
       created_at, round(w, 6) AS intersection_weighted, rk::INTEGER AS rank FROM o WHERE rk <= {limit}"""
