"""Pages, links and the crawl frontier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.sources.chunks import batched, input_rows

NON_HTML = tuple(f".{e}" for e in "avi css dmg exe gif gz ico jpeg jpg js json mov mp3 mp4 pdf png svg tar webp woff xml zip".split())


def normalize_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", ""))


def non_html(url: Column) -> Column:
    return F.lower(url).rlike("|".join(e.replace(".", r"\.") for e in NON_HTML))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def _per_page(pages: DataFrame, id_col: str, url_col: str, html_col: str, schema: str, make) -> DataFrame:
    def run(batches):
        yield from batched((r for i, u, h in input_rows(batches) if h is not None for r in make(i, u or "", h)), kinds)

    to = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = pa.schema([(f.split()[0], to[f.split()[1]]) for f in schema.split(", ")])
    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)


def articles(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, article)"""

    def make(i, u, h):
        from recallgrid.sources.parsers import article

        return [(i, article(h))]

    return _per_page(pages, id_col, url_col, html_col, "page_id bigint, article string", make)


def links(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, link, ord): content links, resolved, in order, once."""

    def make(i, u, h):
        from recallgrid.sources.parsers import content_links

        return [(i, u, x, k) for k, x in enumerate(content_links(h, u))]

    return _per_page(pages, id_col, url_col, html_col, "page_id bigint, url string, link string, ord int", make)


def all_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, link): every root-relative or absolute href of a page, navigation included, by expressions alone."""
    href = F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit('<a href="([^"#]+)"'), 1)))
    l = pages.select(F.col(url_col).alias("url"), href.alias("href"))
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return l.where(F.col("href").rlike("^(/|https?://)")).select("url", F.when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.col("href")).alias("link"))


def page_cues(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, cue)"""

    def make(i, u, h):
        from recallgrid.sources.parsers import page_cues

        return [(i, c) for c in page_cues(h, u)]

    return _per_page(pages, id_col, url_col, html_col, "page_id bigint, cue string", make)


def web_chunks(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", parallel: bool = True) -> DataFrame:
    """(page_id, ord, content)"""

    def make(i, u, h):
        from recallgrid.sources.parsers import web_page

        return [(i, k, c.content) for k, c in enumerate(web_page(h, u, parallel))]

    return _per_page(pages, id_col, url_col, html_col, "page_id bigint, ord int, content string", make)


def crawl(start: DataFrame, edges: DataFrame, depth: int, same_domain: bool = True) -> DataFrame:
    """(url, depth): breadth-first from ``start`` (url) over ``edges`` (src, dst), normalised, without what isn't HTML.

    A loop over depth (small); each round is a join with what the last one found, less what was seen.
    """
    host = lambda c: F.regexp_extract(c, r"^https?://([^/:]+)", 1)
    e = edges.select(normalize_url(F.col("src")).alias("src"), normalize_url(F.col("dst")).alias("dst")).where(~non_html(F.col("dst"))).distinct()
    if same_domain:
        e = e.where(host(F.col("src")) == host(F.col("dst")))
    seen = front = start.select(normalize_url(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        front = front.join(e, front["url"] == e["src"]).select(F.col("dst").alias("url"), F.lit(d).alias("depth")).distinct().join(seen.select("url"), "url", "left_anti")
        seen = seen.unionByName(front)
    return seen


def crawl_counts(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(pages_crawled, links_found, links_skipped) of a crawl of one domain a start: links of the pages that it opens, and
    those of them that lead to another host, to what isn't HTML, or to a page it has already."""
    host = lambda c: F.regexp_extract(c, r"^https?://([^/:]+)", 1)
    seen = crawl(start, edges, depth)
    links = edges.select(normalize_url(F.col("src")).alias("src"), normalize_url(F.col("dst")).alias("dst")).join(seen.where(F.col("depth") < depth).select(F.col("url").alias("src")), "src")
    new = links.where(~non_html(F.col("dst")) & (host(F.col("src")) == host(F.col("dst")))).select("dst").distinct().join(start.select(normalize_url(F.col("url")).alias("dst")), "dst", "left_anti")
    pages, found, opened = seen.agg(F.count("*").alias("pages_crawled")), links.agg(F.count("*").alias("links_found")), new.agg(F.count("*").alias("opened"))
    return pages.crossJoin(found).crossJoin(opened).select("pages_crawled", "links_found", (F.col("links_found") - F.col("opened")).alias("links_skipped"))  # a row each


def web_recall(chunks: DataFrame, query: list[str], limit: int = 10) -> DataFrame:
    """Chunks (id, ord, content, cues) by 10 x common words + 5 x query words within their cues; positive scores only."""
    from recallgrid.functions.text import tokens

    q = F.array(*[F.lit(t) for t in query])
    overlap = F.size(F.array_intersect(tokens(F.col("content")), q))
    inside = F.aggregate(F.transform("cues", lambda c: F.size(F.filter(q, lambda t: F.contains(F.lower(c), t)))), F.lit(0), lambda a, b: a + b)
    s = chunks.withColumn("score", (10 * overlap + 5 * inside).cast("double"))
    return s.orderBy(F.desc("score"), *[c for c in chunks.columns if c != "cues"]).limit(limit).where("score > 0")
