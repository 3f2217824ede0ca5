"""Queries over sources: chunking, web pages, change capture, snapshots."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.plans.registry import query
from recallgrid.plans.views import mem_orders, read, sql_orders
from recallgrid.session import shared_dir
from recallgrid.sources import chunks as C
from recallgrid.sources import sync as Y
from recallgrid.sources import web as W

_EXTS = ["py", "md", "csv", "json", "docx", "tar", "HTML", "yaml"]
_PATHS = f"SELECT doc_id, source || CASE WHEN doc_id % 11 = 0 THEN '/WhatsApp chat.' WHEN doc_id % 13 = 0 THEN '/chrome_History.' ELSE '/file.' END || ({_EXTS})[doc_id % 8 + 1] AS path FROM documents"


def _paths(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 11 == 0, "/WhatsApp chat.").when(F.col("doc_id") % 13 == 0, "/chrome_History.").otherwise("/file.")
    return read(spark, sf, "documents").select("doc_id", F.concat("source", name, ext).alias("path"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TYPES.items())
_CATS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CATEGORIES.items())


@query(rf"""WITH p AS ({_PATHS}) SELECT doc_id, CASE WHEN regexp_matches(lower(path), 'whatsapp|instagram|youtube') OR (contains(lower(path), 'chrome') AND contains(lower(path), 'history')) THEN 'SocialExport' ELSE CASE regexp_extract(path, '\.([^./]+)$', 1) {_CASES} END END AS kind,
CASE WHEN regexp_matches(lower(path), 'whatsapp|instagram|youtube') THEN 'Conversation' ELSE CASE regexp_extract(path, '\.([^./]+)$', 1) {_CATS} ELSE 'Prose' END END AS category FROM p""")
def detect_type(spark, sf):
    return _paths(spark, sf).select("doc_id", C.detect_type(F.col("path")).alias("kind"), C.category(F.col("path")).alias("category"))


_SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|\n|$)'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""WITH a AS (SELECT doc_id, trim(text) AS t, {_SENT} AS s FROM documents), b AS (SELECT *, len(s) <= 3 OR strlen(t) < 50 AS whole FROM a),
c AS (SELECT doc_id, whole, s, CASE WHEN whole THEN [t] ELSE list_transform(range(0, len(s), 2), lambda i: array_to_string(s[i + 1 : i + 3], ' ')) END AS w FROM b), d AS (SELECT doc_id, whole, unnest(w) AS content, generate_subscripts(w, 1) - 1 AS win FROM c)
SELECT doc_id, win::INTEGER AS win, left(content, 2000) AS content FROM d WHERE (whole AND content <> '') OR (NOT whole AND strlen(content) >= 50)""")
def chunk_text_windows(spark, sf):
    return C.text_windows(read(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENT} AS s FROM documents), f(doc_id, i, cur, n, done) AS (SELECT doc_id, 0, '', 0, NULL::VARCHAR FROM s UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN i + 1 > len(s) THEN '' WHEN (n > 0 AND (strlen(cur) + strlen(s[i + 1]) + 2 > 500 OR n >= 3)) OR n = 0 THEN s[i + 1] ELSE cur || ' ' || s[i + 1] END,
    CASE WHEN i + 1 > len(s) THEN 0 WHEN n > 0 AND (strlen(cur) + strlen(s[i + 1]) + 2 > 500 OR n >= 3) THEN 1 ELSE n + 1 END,
    CASE WHEN n > 0 AND (i + 1 > len(s) OR strlen(cur) + strlen(s[i + 1]) + 2 > 500 OR n >= 3) AND strlen(cur) >= 80 THEN cur END
  FROM f JOIN s USING (doc_id) WHERE i <= len(s))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ord, done AS content FROM f WHERE done IS NOT NULL""")
def chunk_sentence_pack(spark, sf):
    return C.pack_sentences(read(spark, sf, "documents"), "doc_id", "text")


_MD = "SELECT conv_id, string_agg('# ' || role || ' ' || turn || ' #' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"


@query(rf"""WITH d AS (SELECT conv_id, string_split('intro' || chr(10) || text, chr(10)) AS l FROM ({_MD})), e AS (SELECT conv_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS section FROM e),
g AS (SELECT conv_id, section::INTEGER AS section, arg_min(line, pos) AS f, min(pos)::INTEGER AS start_line, max(pos)::INTEGER AS end_line, trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10) || chr(9) || chr(13)) AS content FROM s GROUP BY 1, 2)
SELECT conv_id, section, CASE WHEN starts_with(f, '#') THEN trim(regexp_replace(f, '^#+|#+$', '', 'g')) ELSE 'root' END AS header, start_line, end_line, content FROM g WHERE content <> ''""")
def chunk_markdown(spark, sf):
    c = read(spark, sf, "conversations").withColumn("m", F.concat(F.lit("# "), "role", F.lit(" "), "turn", F.lit(" #\n"), "text"))
    d = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("a")).select("conv_id", F.concat(F.lit("intro\n"), F.array_join(F.transform("a", lambda x: x["m"]), "\n")).alias("text"))
    return C.markdown_sections(d, "conv_id", "text")


_CELLS = ["c_name", "c_mktsegment", "phone", "mail"]
_CELL_SQL = r"strlen(v) > 3 AND NOT (contains(v, '@') AND contains(v, '.')) AND NOT regexp_matches(v, '^[\d.,+\-\s]+$') AND NOT regexp_matches(v, '^[0-9a-fA-F-]{8,}$') AND length(regexp_replace(v, '[^0-9]', '', 'g')) <= 0.5 * length(v)"


@query(f"""WITH c AS (SELECT c_custkey, [{{'n': 'c_name', 'v': c_name}}, {{'n': 'c_mktsegment', 'v': c_mktsegment}}, {{'n': 'phone', 'v': '12-' || c_custkey}}, {{'n': 'mail', 'v': 'a' || c_custkey || '@b.org'}}] AS a FROM customer),
f AS (SELECT c_custkey, list_filter(a, lambda x: {_CELL_SQL.replace('(v', '(x.v').replace('v, ', 'v, ')}) AS a FROM c)
SELECT c_custkey, array_to_string(list_transform(a, lambda x: x.v), ' | ') AS content, 'type:csv_row,file:data,' || array_to_string(list_transform(a, lambda x: 'column:' || x.n), ',') AS cues FROM f WHERE len(a) > 0""")
def chunk_csv(spark, sf):
    c = read(spark, sf, "customer").withColumn("phone", F.concat(F.lit("12-"), "c_custkey")).withColumn("mail", F.concat(F.lit("a"), "c_custkey", F.lit("@b.org")))
    return C.table_rows(c, _CELLS, "c_custkey").select("c_custkey", "content", F.array_join("cues", ",").alias("cues"))


@query("""SELECT event_id, k AS key, '"' || k || '": ' || coalesce(json_extract_string(props, '$.' || k), 'null') AS content FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)""")
def chunk_json(spark, sf):
    return C.json_entries(read(spark, sf, "events").where("props is not null"), "event_id", "props")


_WA = "SELECT conv_id, string_agg('[' || (1 + turn % 12) || '/' || (1 + conv_id % 28) || '/24, 10:0' || (turn % 10) || ':00] ' || role || ' one: ' || CASE WHEN turn % 5 = 4 THEN 'image omitted' ELSE replace(text, chr(10), ' ') END, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1"


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ord, lower(role) || '_one' AS sender, (1 + turn % 12) || '-' || (1 + conv_id % 28) || '-24' AS day, trim(replace(text, chr(10), ' ')) AS content FROM conversations QUALIFY turn % 5 <> 4 AND length(trim(replace(text, chr(10), ' '))) >= 3 AND NOT contains(lower(text), 'omitted')")
def chunk_whatsapp(spark, sf):
    c = read(spark, sf, "conversations")
    body = F.when(F.col("turn") % 5 == 4, "image omitted").otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    line = F.concat(F.lit("["), F.col("turn") % 12 + 1, F.lit("/"), F.col("conv_id") % 28 + 1, F.lit("/24, 10:0"), F.col("turn") % 10, F.lit(":00] "), "role", F.lit(" one: "), body)
    t = c.withColumn("l", line).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "l"))).alias("a")).select("conv_id", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("t"))
    return C.whatsapp_messages(t, "conv_id", "t")


@query()
def chunk_files(spark, sf):
    """Documents as files of eight types, through the dispatcher and its parsers."""
    f = _paths(spark, sf).join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return C.chunk_files(f, "path", "text").select("path", "ord", "content", "context", F.array_join("cues", ",").alias("cues"), "category")


@query()
def chunk_html(spark, sf):
    p = read(spark, sf, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), "html")
    return C.chunk_files(p, "path", "html").select("path", "ord", "context", F.array_join("cues", ",").alias("cues"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", W.page_title(F.col("html")).alias("title"))


@query()
def page_metadata(spark, sf):
    return W.page_cues(read(spark, sf, "pages"))


@query()
def page_articles(spark, sf):
    return W.articles(read(spark, sf, "pages"))


@query()
def page_links(spark, sf):
    return W.links(read(spark, sf, "pages"))


@query()
def web_chunks(spark, sf):
    return W.web_chunks(read(spark, sf, "pages"))


_LINKS = r"""l AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"#]+)"', 1))) AS href FROM pages),
e AS (SELECT url, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS link FROM l WHERE regexp_matches(href, '^(/|https?://)'))"""
_NORM = "lower(regexp_replace(regexp_replace({0}, '#.*$', ''), '/$', ''))"
_NON = "|".join(e.replace(".", r"\.") for e in W.NON_HTML)


@query(f"WITH {_LINKS} SELECT url, link FROM e")
def all_links(spark, sf):
    return W.all_links(read(spark, sf, "pages"))


@query(rf"""WITH RECURSIVE {_LINKS}, n AS (SELECT DISTINCT {_NORM.format('url')} AS src, {_NORM.format('link')} AS dst FROM e), g AS (SELECT * FROM n WHERE NOT regexp_matches(dst, '{_NON}') AND regexp_extract(src, '^https?://([^/:]+)', 1) = regexp_extract(dst, '^https?://([^/:]+)', 1)),
c(url, depth) AS (SELECT min({_NORM.format('url')}), 0 FROM pages GROUP BY regexp_extract(url, '^https?://([^/:]+)', 1) UNION SELECT dst, depth + 1 FROM c JOIN g ON src = url WHERE depth < 2)
SELECT url, min(depth)::INTEGER AS depth FROM c GROUP BY 1""")
def crawl_frontier(spark, sf):
    p = read(spark, sf, "pages")
    e = W.all_links(p).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    seeds = p.groupBy(F.regexp_extract("url", r"^https?://([^/:]+)", 1)).agg(F.min(W.normalize_url(F.col("url"))).alias("url"))
    return W.crawl(seeds.select("url"), e, 2)  # from one page of each host


@query(f"SELECT page_id, {_NORM.format('url')} AS normalized FROM pages")
def url_normalize(spark, sf):
    return read(spark, sf, "pages").select("page_id", W.normalize_url(F.col("url")).alias("normalized"))


@query(f"SELECT page_id, regexp_matches(lower(url || CASE WHEN page_id % 3 = 0 THEN '/a.PDF?x' ELSE '' END), '{_NON}') AS skipped FROM pages")
def url_non_html(spark, sf):
    u = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a.PDF?x").otherwise(""))
    return read(spark, sf, "pages").select("page_id", W.non_html(u).alias("skipped"))


_QW = ["than", "hein", "ere", "onour"]


@query(f"""WITH c AS (SELECT doc_id, text AS content, ['lang:' || lang, 'source:' || source] AS cues FROM documents), s AS (SELECT *, (10 * len(list_intersect(list_distinct({T.sql_tokens('content')}), {_QW})) + 5 * list_sum(list_transform(cues, lambda c: len(list_filter({_QW}, lambda t: contains(lower(c), t))))))::DOUBLE AS score FROM c)
SELECT doc_id, score FROM (SELECT * FROM s ORDER BY score DESC, doc_id, content LIMIT 10) WHERE score > 0""")
def web_recall(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("cues"))
    return W.web_recall(d, _QW).select("doc_id", "score")


_V2 = "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 50 = 1"


def _versions(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    new = d.where("path % 10 <> 0").withColumn("content", F.when(F.col("path") % 7 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    return d, new.unionByName(d.where("path % 50 = 1").withColumn("path", F.col("path") + 1000000))


@query(f"WITH o AS (SELECT doc_id AS path, text FROM documents), n AS ({_V2}) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN sha256(text) = sha256(content) THEN 'same' ELSE 'changed' END AS change, sha256(content) AS hash FROM o FULL JOIN n ON o.path = n.path")
def cdc_changes(spark, sf):
    return Y.changes(*_versions(spark, sf))


@query(f"SELECT path, content FROM ({_V2})")
def cdc_upsert(spark, sf):
    return Y.apply_changes(*_versions(spark, sf))


@query("SELECT 'file:' || doc_id || ':1-1' AS memory_id FROM documents WHERE doc_id % 10 = 0")
def verify_file(spark, sf):
    old, new = _versions(spark, sf)
    ident = F.concat(F.lit("file:"), "path", F.lit(":1-1")).alias("memory_id")
    return Y.stale(old.select(ident), new.select(ident))


@query("SELECT doc_id, 'web:' || sha256(text) AS memory_id FROM documents")
def content_hash_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id", Y.content_id(F.lit("web"), F.col("text")).alias("memory_id"))


@query("SELECT path, 'file:' || lower(path) || ':' || l || '-' || l || CASE WHEN n > 0 THEN ':' || n ELSE '' END AS memory_id FROM (SELECT 'C' || o_custkey AS path, year(o_orderdate) AS l, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1 AS n FROM orders)")
def chunk_ids(spark, sf):
    o = read(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("path"), F.year("o_orderdate").alias("start_line"), F.year("o_orderdate").alias("end_line"), F.col("o_orderkey").alias("ord"))
    return Y.chunk_ids(o).select("path", "memory_id")


@query(f"SELECT project_id, memory_id, content, array_to_string(cues, ',') AS cues, seq FROM ({sql_orders(True)})")
def snapshot_roundtrip(spark, sf):
    path = posixpath.join(shared_dir(spark), f"snapshot-{uuid.uuid4().hex}")
    Y.save_snapshot(mem_orders(spark, sf, by_segment=True), path)
    return Y.load_snapshot(spark, path).select("project_id", "memory_id", "content", F.array_join("cues", ",").alias("cues"), "seq")
