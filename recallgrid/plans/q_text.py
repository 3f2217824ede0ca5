"""Queries over text and cue functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.config import Normalization, Rule, Taxonomy
from recallgrid.functions import cues as C
from recallgrid.functions import fast
from recallgrid.functions import text as T
from recallgrid.functions.scoring import estimate_tokens, label
from recallgrid.operators.ops import valid_project
from recallgrid.plans.registry import query
from recallgrid.plans.views import MEM_EVENTS, mem_events, mem_orders, read, sql_orders, sql_postings


@query(f"SELECT doc_id, {T.sql_normalize('text')} AS normalized FROM documents")
def normalize_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT page_id, {T.sql_sanitize('url')} AS sanitized FROM pages")
def sanitize_url(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.sanitize_text(F.col("url")).alias("sanitized"))


@query(f"SELECT DISTINCT doc_id, unnest({T.sql_tokens('text')}) AS token FROM documents")
def tokenize(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g')), '[a-z][0-9a-z]*'))) AS w FROM documents)
SELECT doc_id, w AS token FROM t WHERE length(w) > 6 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]')""")
def hash_like_filter(spark, sf):
    w = F.explode(F.array_distinct(F.regexp_extract_all(T.normalize_text(F.col("text")), F.lit(T.TOKEN), 0))).alias("token")
    return read(spark, sf, "documents").select("doc_id", w).where(T.hash_like(F.col("token")))


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all({T.sql_normalize('text')}, '[a-z][0-9a-z]*')) AS w FROM documents)
SELECT w AS token, count(*) AS n FROM t WHERE w NOT IN ({T._sql_list(T.stop_list('python'))}) GROUP BY 1""")
def stopword_filter(spark, sf):
    w = F.explode(F.regexp_extract_all(T.normalize_text(F.col("text")), F.lit(T.TOKEN), 0)).alias("token")
    return read(spark, sf, "documents").select(w).where(~F.col("token").isin(*T.stop_list("lang:py"))).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all({T.sql_normalize('text')}, '[a-z][0-9a-z]*')) AS w FROM documents) SELECT w AS word, {T.sql_lemma('w')} AS lemma FROM t""")
def lemmatize(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(F.regexp_extract_all(T.normalize_text(F.col("text")), F.lit(T.TOKEN), 0)).alias("word")).distinct()
    return w.select("word", T.lemma(F.col("word")).alias("lemma"))


_PH = """WITH r AS (SELECT doc_id, {ph} AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS phrase, generate_subscripts(l, 1) AS i FROM r),
f AS (SELECT doc_id, phrase, min(i) AS i FROM e GROUP BY 1, 2),
g AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM f)"""


@query(_PH.format(ph=T.sql_phrases("text")) + " SELECT doc_id, phrase, ord::INTEGER AS ord FROM g WHERE ord <= 15")
def rake_phrases(spark, sf):
    p = F.posexplode(T.phrases(T.sanitize_text(F.col("text")))).alias("ord", "phrase")
    return read(spark, sf, "documents").select("doc_id", p).select("doc_id", "phrase", (F.col("ord") + 1).alias("ord"))


@query(_PH.format(ph=T.sql_phrases("text")) + f""", tok AS (SELECT DISTINCT doc_id, unnest({T.sql_tokens('text')}) AS cue FROM documents)
SELECT doc_id, cue FROM tok UNION SELECT doc_id, phrase FROM g WHERE ord <= 15""")
def tokenize_to_cues(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(fast.cues(F.col("text"))).alias("cue"))


RULES = Normalization(rules=(Rule("dash", "-", "_"), Rule("urgent", "^priority:([0-9])_urgent$", "urgent:$1"), Rule("year_prefix", "^year:(\\d\\d)(\\d\\d)$", "y:$2")))


@query(rf"""WITH mem AS ({sql_orders()}), c AS (SELECT memory_id, unnest(cues) AS raw FROM mem),
a AS (SELECT *, trim(lower(raw)) AS c0 FROM c), b AS (SELECT *, regexp_replace(c0, '-', '_', 'g') AS c1 FROM a),
d AS (SELECT *, regexp_replace(c1, '^priority:([0-9])_urgent$', 'urgent:\1', 'g') AS c2 FROM b), e AS (SELECT *, regexp_replace(c2, '^year:(\d\d)(\d\d)$', 'y:\2', 'g') AS c3 FROM d)
SELECT memory_id, raw, c3 AS normalized, concat_ws(',', CASE WHEN c1 <> c0 THEN 'dash' END, CASE WHEN c2 <> c1 THEN 'urgent' END, CASE WHEN c3 <> c2 THEN 'year_prefix' END) AS applied FROM e""")
def normalize_cue_rules(spark, sf):
    c = mem_orders(spark, sf).select("memory_id", F.explode("cues").alias("raw"))
    n, trace = C.normalize_cue(F.col("raw"), RULES)
    return c.select("memory_id", "raw", n.alias("normalized"), F.array_join(trace, ",").alias("applied"))


TAX = Taxonomy(keys=("type", "user", "k"), values={"type": ("click", "view", "purchase")}, prefixes={"user": ("1", "2")})
_TAX = f"""WITH mem AS ({MEM_EVENTS}), c AS (SELECT memory_id, unnest(list_concat(cues, ['plain', 'stray:x', 'broken:'])) AS cue FROM mem),
d AS (SELECT *, split_part(cue, ':', 1) AS k, CASE WHEN instr(cue, ':') > 0 THEN substr(cue, instr(cue, ':') + 1) END AS v FROM c),
e AS (SELECT *, CASE WHEN instr(cue, ':') = 0 THEN NULL WHEN k = '' OR v = '' THEN 'bad_format' WHEN k NOT IN ('type', 'user', 'k') THEN 'unknown_key'
  WHEN k = 'type' AND v NOT IN ('click', 'view', 'purchase') THEN 'unknown_value' WHEN k = 'user' AND NOT (starts_with(v, '1') OR starts_with(v, '2')) THEN 'unknown_value' END AS code FROM d)"""


def _taxonomy(spark, sf):
    extra = F.array(F.lit("plain"), F.lit("stray:x"), F.lit("broken:"))
    c = mem_events(spark, sf).select("memory_id", F.explode(F.concat("cues", extra)).alias("cue"))
    return c.withColumn("code", C.taxonomy_code(F.col("cue"), TAX))


@query(_TAX + " SELECT memory_id, cue FROM e WHERE code IS NULL")
def taxonomy_validate(spark, sf):
    return _taxonomy(spark, sf).where("code is null").select("memory_id", "cue")


@query(_TAX + " SELECT memory_id, cue, code FROM e WHERE code IS NOT NULL")
def taxonomy_rejects(spark, sf):
    return _taxonomy(spark, sf).where("code is not null").select("memory_id", "cue", "code")


@query(f"WITH mem AS ({MEM_EVENTS}) SELECT memory_id, cue FROM (SELECT memory_id, unnest(list_concat(cues, ['Path:/a', 'id:' || seq, 'source:web'])) AS cue FROM mem) WHERE NOT regexp_matches(lower(cue), '{C.UNTRAINABLE}')")
def lexicon_trainable(spark, sf):
    c = mem_events(spark, sf).select("memory_id", F.explode(F.concat("cues", F.array(F.lit("Path:/a"), F.concat(F.lit("id:"), "seq"), F.lit("source:web")))).alias("cue"))
    return c.where(C.trainable(F.col("cue")))


@query(f"WITH mem AS ({sql_orders()}) {sql_postings()}")
def double_index(spark, sf):
    from recallgrid.operators.index import postings

    return postings(mem_orders(spark, sf))


@query("""WITH p AS (SELECT DISTINCT p_brand AS a FROM part), c AS (SELECT 'brand:' || lower(a) AS a FROM p UNION SELECT lower(a) FROM p),
t AS (SELECT a, list_filter(regexp_split_to_array(lower(a), '[:_-]'), lambda x: strlen(x) >= 3) AS k FROM c)
SELECT x.a AS cue_a, y.a AS cue_b, CASE WHEN regexp_matches(x.a, '(?s)^[^:]+:.+') AND NOT regexp_matches(y.a, '(?s)^[^:]+:.+') THEN x.a WHEN regexp_matches(y.a, '(?s)^[^:]+:.+') AND NOT regexp_matches(x.a, '(?s)^[^:]+:.+') THEN y.a ELSE least(x.a, y.a) END AS canonical
FROM t x JOIN t y ON x.a < y.a WHERE contains(x.a, y.a) OR contains(y.a, x.a) OR list_has_any(x.k, y.k)""")
def lexical_gate_pairs(spark, sf):
    p = read(spark, sf, "part").select(F.lower("p_brand").alias("a")).distinct()
    c = p.unionByName(p.select(F.concat(F.lit("brand:"), "a").alias("a"))).distinct()  # one row per brand, twice
    j = c.toDF("cue_a").join(c.toDF("cue_b"), F.col("cue_a") < F.col("cue_b")).where(C.lexical_gate(F.col("cue_a"), F.col("cue_b")))
    return j.withColumn("canonical", C.canonical_of(F.col("cue_a"), F.col("cue_b")))


@query(r"""SELECT conv_id, turn, unnest(CASE WHEN turn % 3 = 0 THEN ['topic:t' || conv_id, 'role:' || role] WHEN turn % 3 = 1 THEN ['lang:x', 'k:' || turn] ELSE ['ab:' || turn] END) AS cue FROM conversations""")
def parse_proposals(spark, sf):
    c = read(spark, sf, "conversations")
    plain = F.concat(F.lit('["topic:t'), "conv_id", F.lit('", "role:'), "role", F.lit('"]'))
    fenced = F.concat(F.lit('Here:\n```json\n{"cues": ["lang:x", {"key": "k", "value": "'), "turn", F.lit('"}]}\n```'))
    loose = F.concat(F.lit('maybe "ab:'), "turn", F.lit('" fits'))
    r = F.when(F.col("turn") % 3 == 0, plain).when(F.col("turn") % 3 == 1, fenced).otherwise(loose)
    return c.select("conv_id", "turn", F.explode(C.proposed_cues(r)).alias("cue"))


@query(r"SELECT kind, id, name, regexp_matches(name, '^[\p{L}\p{N}_-]+$') AND strlen(name) BETWEEN 3 AND 64 AS valid FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'source', doc_id, source FROM documents)")
def validate_project_id(spark, sf):
    sides = [("customer", "customer", "c_custkey", "c_name"), ("part", "part", "p_partkey", "p_name"), ("source", "documents", "doc_id", "source")]
    rows = [read(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name")) for kind, t, i, n in sides]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("valid", valid_project(F.col("name")))


@query("SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens, CASE WHEN strlen(text) > 50 THEN left(text, 50) || '...' ELSE text END AS label FROM documents")
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"), label(F.col("text")).alias("label"))
