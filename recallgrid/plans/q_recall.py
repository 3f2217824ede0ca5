"""Queries over postings and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.functions.scoring import idf
from recallgrid.operators import index as I
from recallgrid.operators import recall as R
from recallgrid.plans.registry import query
from recallgrid.plans.views import MEM_DOC_TOKENS, MEM_EVENTS, MEM_PARTS, mem_doc_tokens, mem_events, mem_orders, mem_parts, read, sql_orders, sql_postings, sql_recall

_O = f"WITH mem AS ({sql_orders()}), p AS ({sql_postings()}) "
_OX = _O.rstrip()


@query(_O + "SELECT cue, count(*) AS df FROM p GROUP BY 1")
def cue_frequency(spark, sf):
    return I.frequency(I.postings(mem_orders(spark, sf))).select("cue", "df")


@query(_OX + ", n AS (SELECT count(*) AS total FROM mem), d AS (SELECT cue, count(*) AS df FROM p GROUP BY 1) SELECT cue, round(greatest(CASE WHEN total + 0.5 > df THEN ln((0.5 + total - df) / (0.5 + df)) ELSE 0.1 END, 0.1), 6) AS idf FROM d, n")
def idf_weights(spark, sf):
    m = mem_orders(spark, sf)
    n = m.agg(F.count("*").alias("total"))
    return I.frequency(I.postings(m)).crossJoin(F.broadcast(n)).select("cue", F.round(idf(F.col("total"), F.col("df")), 6).alias("idf"))  # n is one row


@query(_O + "SELECT cue, memory_id, row_number() OVER (PARTITION BY cue ORDER BY seq DESC, memory_id) - 1 AS pos, count(*) OVER (PARTITION BY cue) AS len FROM p")
def posting_positions(spark, sf):
    return I.positioned(I.postings(mem_orders(spark, sf))).select("cue", "memory_id", F.col("pos").cast("bigint").alias("pos"), "len")


@query(_O + "SELECT cue, memory_id, pos FROM (SELECT cue, memory_id, row_number() OVER (PARTITION BY cue ORDER BY seq DESC, memory_id) - 1 AS pos FROM p) WHERE pos < 20")
def recent_postings(spark, sf):
    return I.recent(I.postings(mem_orders(spark, sf)), 20).select("cue", "memory_id", F.col("pos").cast("bigint").alias("pos"))


@query(f"WITH mem AS ({sql_orders()}) SELECT memory_id, content, created_at FROM mem WHERE memory_id IN ('ord:1', 'ord:77', 'ord:5000')")
def point_lookup(spark, sf):
    return mem_orders(spark, sf).where(F.col("memory_id").isin("ord:1", "ord:77", "ord:5000")).select("memory_id", "content", "created_at")


def _q(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, cue string, weight double")


def _values(rows) -> str:
    return "SELECT query_id::BIGINT AS query_id, cue, weight FROM (VALUES " + ", ".join(f"({a}, '{c}', {w}::DOUBLE)" for a, c, w in rows) + ") v(query_id, cue, weight)"


ORDERS_Q = [(1, "segment:BUILDING", 1.0), (1, "priority:1-URGENT", 1.0), (2, "year:1996", 1.0), (2, "o", 1.0), (2, "segment:machinery", 1.0), (3, "status:f", 1.0), (3, " Status:F ", 1.0), (3, "nothing:here", 1.0)]
WEIGHTED_Q = [(1, "segment:building", 2.0), (1, "priority:5-low", 0.5), (2, "year:1996", 1.5), (2, "year:1997", 0.25), (2, "p", 3.0)]


@query(sql_recall(sql_orders(), _values(ORDERS_Q)))
def recall_basic(spark, sf):
    return R.recall(mem_orders(spark, sf), _q(spark, ORDERS_Q))


@query(sql_recall(sql_orders(), _values(WEIGHTED_Q), limit=25))
def recall_weighted(spark, sf):
    return R.recall(mem_orders(spark, sf), _q(spark, WEIGHTED_Q), limit=25)


@query(sql_recall(sql_orders(), _values(ORDERS_Q), min_intersection=2))
def recall_min_intersection(spark, sf):
    return R.recall(mem_orders(spark, sf), _q(spark, ORDERS_Q), min_intersection=2)


@query(sql_recall(sql_orders(), _values(ORDERS_Q), salience=False))
def recall_no_salience(spark, sf):
    return R.recall(mem_orders(spark, sf), _q(spark, ORDERS_Q), salience_bias=False)


@query(sql_recall(f"SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN list_append(cues, 'type:summary') ELSE cues END AS cues) FROM ({sql_orders()})", _values(ORDERS_Q), consolidation=False))
def recall_exclude_summaries(spark, sf):
    m = mem_orders(spark, sf).withColumn("cues", F.when(F.col("seq") % 3 == 0, F.array_append("cues", F.lit("type:summary"))).otherwise(F.col("cues")))
    return R.recall(m, _q(spark, ORDERS_Q), systems_consolidation=False)


@query(sql_recall(sql_orders(), _values(WEIGHTED_Q), limit=3, scan_cap=True))
def recall_scan_cap(spark, sf):
    return R.recall(mem_orders(spark, sf), _q(spark, WEIGHTED_Q), limit=3, scan_cap=True)


@query("SELECT query_id, memory_id, rank, concat_ws(' ', round(e.score, 2), e.n) AS explain_text, content FROM (SELECT *, {'score': score, 'n': intersection_count} AS e FROM (" + sql_recall(sql_orders(), _values(ORDERS_Q)) + f")) JOIN (SELECT memory_id, content FROM ({sql_orders()})) USING (memory_id)")
def recall_explain(spark, sf):
    m = mem_orders(spark, sf)
    r = R.with_content(R.explained(R.recall(m, _q(spark, ORDERS_Q))), m)
    return r.select("query_id", "memory_id", "rank", F.concat_ws(" ", F.round("explain.score", 2), "explain.intersection_count").alias("explain_text"), "content")


_BATCH = f"SELECT item_id AS query_id, unnest({T.sql_tokens('text')}) AS cue, 1.0::DOUBLE AS weight FROM benchmark"


@query(sql_recall(MEM_DOC_TOKENS, _BATCH))
def recall_batch(spark, sf):
    """Every benchmark passage as a query over all documents, in one plan."""
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("cue"), F.lit(1.0).alias("weight"))
    return R.recall(I.stored(mem_doc_tokens(spark, sf).drop("content")), q)


@query(sql_recall(sql_orders(by_segment=True), _values(ORDERS_Q), limit=5))
def recall_cross_project(spark, sf):
    return R.recall(mem_orders(spark, sf, by_segment=True), _q(spark, ORDERS_Q), limit=5)


@query(sql_recall(sql_orders(by_segment=True), _values(WEIGHTED_Q), limit=12, across=True))
def recall_across_ranked(spark, sf):
    return R.recall(mem_orders(spark, sf, by_segment=True), _q(spark, WEIGHTED_Q), limit=12, across=True)


_FAST = [(1, "segment:building", 1.0), (1, "year:1996", 1.0), (2, "o", 1.0)]


@query(_OX + f""", q AS ({_values(_FAST)}), h AS (SELECT DISTINCT project_id, query_id, memory_id FROM (SELECT p.*, row_number() OVER (PARTITION BY project_id, cue ORDER BY seq DESC, memory_id) AS rn FROM p) JOIN q USING (cue) WHERE rn <= 20),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.project_id, query_id ORDER BY reinforcement_count DESC, intrinsic_salience + dynamic_salience DESC, created_at DESC, seq DESC, memory_id) AS rk FROM h JOIN mem USING (memory_id))
SELECT project_id, query_id, memory_id, 1.0::DOUBLE AS score, rk::INTEGER AS rank FROM r WHERE rk <= 10""")
def recall_fast(spark, sf):
    return R.recall_fast(mem_orders(spark, sf), _q(spark, _FAST))


@query(_OX + f""", q AS ({_values(WEIGHTED_Q)}), x AS (SELECT p.*, row_number() OVER (PARTITION BY cue ORDER BY seq DESC, memory_id) - 1 AS pos, count(*) OVER (PARTITION BY cue) AS len FROM p),
j AS (SELECT x.*, query_id, weight FROM x JOIN q USING (cue)), l AS (SELECT query_id, cue, max(len) AS len FROM j GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len, cue) AS r, count(*) OVER (PARTITION BY query_id) AS lists FROM l),
c AS (SELECT j.project_id, j.query_id, memory_id, seq, lists, sum(weight) AS w, count(*) AS matches, min(CASE WHEN j.cue = f.cue THEN pos END) AS dp FROM j JOIN f ON f.query_id = j.query_id AND f.r = 1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY project_id, query_id ORDER BY round(w, 9) DESC, seq DESC, memory_id) AS rk FROM c WHERE dp < 100)
SELECT project_id, query_id, memory_id, round(100 * w, 6) AS score, round(matches / lists, 6) AS match_integrity, matches AS intersection_count, rk::INTEGER AS rank FROM o WHERE rk <= 10""")
def recall_intersection(spark, sf):
    return R.recall_intersection(mem_orders(spark, sf), _q(spark, WEIGHTED_Q))


_COMPLETE = "SELECT n_nationkey AS query_id, 'brand:Brand#' || (11 + n_nationkey) AS cue, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, 'brand#' || (11 + n_nationkey * 2), 1.0 FROM nation"


@query(sql_recall(MEM_PARTS, _COMPLETE, completion=True))
def pattern_completion(spark, sf):
    n = read(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("brand:Brand#"), F.col("n_nationkey") + 11).alias("cue"), F.lit(1.0).alias("weight"))
    b = n.select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("brand#"), F.col("n_nationkey") * 2 + 11).alias("cue"), F.lit(1.0).alias("weight"))
    return R.recall(mem_parts(spark, sf), a.unionByName(b), completion=True)


_EV_Q = [(1, "type:purchase", 1.0), (1, "user:7", 1.0), (2, "type:error", 1.0), (2, "user:11", 2.0)]


@query("SELECT query_id, memory_id, match_integrity, intersection_count, rank FROM (" + sql_recall(MEM_EVENTS, _values(_EV_Q), limit=20) + ")")
def match_integrity(spark, sf):
    return R.recall(mem_events(spark, sf), _q(spark, _EV_Q), limit=20).select("query_id", "memory_id", "match_integrity", "intersection_count", "rank")


_HEAT = "SELECT 'type:' || event_type AS cue, least(log10(1 + count(*)), 2.0) AS lift FROM events GROUP BY 1 UNION ALL SELECT 'user:' || user_id, least(log10(1 + count(*)), 2.0) FROM events GROUP BY 1"


@query(sql_recall(MEM_EVENTS, _values(_EV_Q), heat=_HEAT))
def recall_heatmap(spark, sf):
    e = read(spark, sf, "events")
    lift = F.least(F.log10(1 + F.count("*")), F.lit(2.0)).alias("lift")
    heat = e.groupBy(F.concat(F.lit("type:"), "event_type").alias("cue")).agg(lift).unionByName(e.groupBy(F.concat(F.lit("user:"), "user_id").alias("cue")).agg(lift))
    return R.recall(mem_events(spark, sf), _q(spark, _EV_Q), heatmap=heat)


HOP_Q = [(1, "segment:building", 1.0), (1, "year:1996", 1.0), (2, "priority:1-urgent", 1.0)]
_hop1 = sql_recall(sql_orders(), _values(HOP_Q))
_hop2 = sql_recall(sql_orders(), f"SELECT query_id, cue, weight FROM q0 UNION ALL SELECT query_id, unnest(cues), 0.5 FROM best JOIN ({sql_orders()}) USING (memory_id)", limit=5, head=f"q0 AS ({_values(HOP_Q)}), h1 AS ({_hop1}), best AS (SELECT query_id, memory_id FROM h1 WHERE rank = 1),")


@query(f"""WITH a AS (SELECT *, 1 AS hop FROM ({_hop1}) UNION ALL SELECT *, 2 AS hop FROM ({_hop2})),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id, query_id, memory_id ORDER BY hop, rank) AS k FROM a)
SELECT * EXCLUDE (k) REPLACE (row_number() OVER (PARTITION BY project_id, query_id ORDER BY score DESC, hop, memory_id)::INTEGER AS rank) FROM b WHERE k = 1""")
def recall_multihop(spark, sf):
    return R.recall_multihop(mem_orders(spark, sf), _q(spark, HOP_Q))
