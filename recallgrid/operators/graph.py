"""Expansion over co-occurrence, graph views, lexicon and aliases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.config import Normalization, Taxonomy, Tuning
from recallgrid.functions import cues as C
from recallgrid.functions import text as T
from recallgrid.functions.scoring import label
from recallgrid.operators.index import cooccurrence, frequency, postings


def context_expand(cooc: DataFrame, queries: DataFrame, limit: int = 20, min_score: float = 0.0) -> DataFrame:
    """(project_id, query_id, term, score, n, sources): cues that occur with the query's, n over all of them, which is the
    score. Terms with a colon, terms of the query and, for each of its cues, terms that contain it are left out.
    ``min_score`` applies after the limit."""
    q = queries.select("query_id", C.index_form(F.col("cue")).alias("cue")).where("cue <> ''").distinct()
    near = cooc.join(q, cooc["cue_a"] == q["cue"]).drop("cue").where(~F.contains("cue_b", F.lit(":")) & ~F.contains("cue_b", "cue_a"))
    asked = q.select("query_id", F.col("cue").alias("cue_b"))
    t = near.join(asked, ["query_id", "cue_b"], "left_anti").groupBy("project_id", "query_id", F.col("cue_b").alias("term")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("cue_a")).alias("sources"))
    by = Window.partitionBy("project_id", "query_id")
    t = t.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "term")).cast("int")).withColumn("score", F.col("n").cast("double")).where(F.col("rank") <= limit)
    return t.where(F.col("score") >= min_score)


def text_cues(texts: DataFrame, normalization: Normalization = Normalization(), lang: str = "default") -> DataFrame:
    """(query_id, token, cue) of ``texts`` (query_id, text): tokens and phrases, and what the rules make of them."""
    t = texts.select("query_id", F.explode(T.cues(F.col("text"), lang)).alias("token"))
    return t.withColumn("cue", C.normalize_cue(F.col("token"), normalization)[0])


def context_expand_text(cooc: DataFrame, texts: DataFrame, limit: int = 20, min_score: float = 0.0, normalization: Normalization = Normalization()) -> DataFrame:
    """context_expand of the cues of ``texts`` (query_id, text)."""
    return context_expand(cooc, text_cues(texts, normalization), limit, min_score)


def graph_nodes(memories: DataFrame, limit: int = 100) -> DataFrame:
    """Memory nodes (the most recently touched, 0: all) and the cue nodes that they have."""
    top = memories.orderBy(F.desc("created_at"), F.desc("seq"), "memory_id")
    top = top.limit(limit) if limit else top
    mem = top.select(F.col("memory_id").alias("id"), F.lit("memory").alias("kind"), label(F.col("content")).alias("label"))
    cue = top.select(F.explode("cues").alias("c")).select(F.concat(F.lit("cue:"), "c").alias("id"), F.lit("cue").alias("kind"), F.col("c").alias("label")).distinct()
    return mem.unionByName(cue)


def graph_links(memories: DataFrame, limit: int = 100, budget: int = 10_000) -> DataFrame:
    """memory - cue links, then co-occurrence links between shown cues, the heaviest, up to ``budget`` links in all."""
    top = memories.orderBy(F.desc("created_at"), F.desc("seq"), "memory_id")
    top = top.limit(limit) if limit else top
    own = top.select(F.col("memory_id").alias("source"), F.explode(F.array_distinct("cues")).alias("c")).select("source", F.concat(F.lit("cue:"), "c").alias("target"), F.lit(1).cast("bigint").alias("weight"), F.lit("has").alias("kind"))
    shown = own.select(F.expr("substring(target, 5)").alias("c")).distinct()
    co = cooccurrence(memories).where("cue_a < cue_b").join(shown.withColumnRenamed("c", "cue_a"), "cue_a", "left_semi").join(shown.withColumnRenamed("c", "cue_b"), "cue_b", "left_semi")
    co = co.select(F.concat(F.lit("cue:"), "cue_a").alias("source"), F.concat(F.lit("cue:"), "cue_b").alias("target"), F.col("n").alias("weight"), F.lit("with").alias("kind"))
    rn = F.row_number().over(Window.orderBy(F.desc("weight"), "source", "target"))  # links among the cues of the shown memories
    count = own.agg(F.count("*").alias("used"))
    return own.unionByName(co.withColumn("rn", rn).crossJoin(F.broadcast(count)).where(F.col("rn") <= F.greatest(F.lit(budget) - F.col("used"), F.lit(0))).select(*own.columns))


def train_lexicon(memories: DataFrame, token_col: str = "tokens", synonyms: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """(lex_id, canonical, token): identity entries of all tokens, their synonyms, and canonical cues with the tokens of
    the memories that accepted them but for those that the cue contains."""
    t = memories.select("memory_id", F.explode(token_col).alias("token"))
    ident = t.select("token").distinct().select(F.col("token").alias("lex_id"), F.col("token").alias("canonical"), "token")
    out = ident
    if synonyms is not None:
        out = out.unionByName(ident.select("token").join(synonyms, ident["token"] == synonyms["word"]).select(F.col("synonym").alias("lex_id"), F.col("token").alias("canonical"), F.col("synonym").alias("token")).distinct())
    if accepted is not None:
        a = accepted.where(C.trainable(F.col("cue"))).join(t, "memory_id").where(~F.contains("cue", "token"))
        out = out.unionByName(a.select(F.concat(F.lit("cue:"), "cue").alias("lex_id"), F.col("cue").alias("canonical"), "token").distinct())
    return out.distinct()


def resolve(lexicon: DataFrame, texts: DataFrame, limit: int = 64, normalization: Normalization = Normalization(), taxonomy: Taxonomy | None = None) -> DataFrame:
    """(query_id, cue): canonical cues of each text's tokens (``texts``: query_id, tokens), the tokens themselves where the
    lexicon has none of them; then the rules of ``normalization``, and what ``taxonomy`` rejects goes. The ``limit``
    entries with most tokens of the text count, then by name."""
    t = texts.select("query_id", F.explode("tokens").alias("token"))
    hit = t.join(lexicon, "token").groupBy("query_id", "canonical").agg(F.countDistinct("token").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "canonical"))
    top = hit.withColumn("r", rank).where(F.col("r") <= limit).select("query_id", F.col("canonical").alias("cue"))
    raw = top.unionByName(t.join(hit, "query_id", "left_anti").select("query_id", F.col("token").alias("cue")))
    out = raw.select("query_id", C.normalize_cue(F.col("cue"), normalization)[0].alias("cue")).distinct()
    return out if taxonomy is None else out.where(C.taxonomy_code(F.col("cue"), taxonomy).isNull())


def inspect_lexicon(memories: DataFrame, lexicon: DataFrame, cue: str, token_col: str = "tokens") -> DataFrame:
    """(token, affected): tokens that lead to ``cue``, and the memories that have the token but not the cue."""
    mine = lexicon.where(F.col("canonical") == cue).select("token").distinct()
    m = memories.select("memory_id", "cues", F.explode(token_col).alias("token"))
    return mine.join(m.join(mine, "token", "left_semi"), "token", "left").groupBy("token").agg(F.count_if(F.col("memory_id").isNotNull() & ~F.array_contains("cues", cue)).alias("affected"))


def lexicon_graph(lexicon: DataFrame) -> DataFrame:
    """(token, canonicals, links): canonicals of each token and how many differ from it."""
    return lexicon.groupBy("token").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"), F.countDistinct(F.when(F.col("canonical") != F.col("token"), F.col("canonical"))).alias("links"))


def expand_aliases(queries: DataFrame, tokens: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, cue, weight): query cues at 1 and the active aliases of those that are tokens of the query at their
    downweight; each cue once at its greatest weight, and only cues that the index has."""
    active = aliases.where("status = 'active'").select("from_cue", "to_cue", F.coalesce("downweight", F.lit(0.85)).alias("downweight"))
    mine = queries.join(tokens, ["query_id", "cue"], "left_semi").join(active, queries["cue"] == active["from_cue"])
    rank = F.row_number().over(Window.partitionBy("query_id", "cue").orderBy(F.desc("downweight"), "to_cue"))
    new = mine.withColumn("r", rank).where("r <= 8").select("query_id", F.col("to_cue").alias("cue"), F.col("downweight").alias("weight"))
    both = queries.select("query_id", "cue", F.lit(1.0).alias("weight")).unionByName(new)
    return both.groupBy("query_id", "cue").agg(F.max("weight").alias("weight")).join(index.select("cue").distinct(), "cue", "left_semi").select("query_id", "cue", "weight")


def alias_row(from_cue, to_cue, downweight, status="active", reason="manual") -> dict:
    return {"from_cue": from_cue, "to_cue": to_cue, "downweight": downweight, "status": status, "reason": reason}


def merge_aliases(aliases: DataFrame, cues: DataFrame, to_cue: str) -> DataFrame:
    """Aliases with every cue of ``cues`` leading to ``to_cue`` at full weight; earlier ones of the same pair go."""
    new = cues.select(F.col("cue").alias("from_cue"), F.lit(to_cue).alias("to_cue"), F.lit(1.0).alias("downweight"), F.lit("active").alias("status"), F.lit("merge").alias("reason")).where(F.col("from_cue") != to_cue)
    return aliases.join(new.select("from_cue", "to_cue"), ["from_cue", "to_cue"], "left_anti").unionByName(new)


def alias_id(alias: Column, canonical: Column) -> Column:
    """The UUID (version 5, OID namespace) of ``alias->canonical``."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_OID.hex)), F.concat(alias, F.lit("->"), canonical).cast("binary")))
    kind = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(kind, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def alias_candidates(memories: DataFrame, low: int = 3, high: int = 5000, top: int = 500, sample: int = 50, size_ratio: float = 0.5, overlap: float = 0.65) -> DataFrame:
    """(project_id, canonical, alias, overlap, alias_id): pairs of cues whose memories largely coincide and whose names agree.

    Cues of three bytes or more with ``low`` to ``high`` memories; the most frequent hundredth is left out and the ``top``
    next are compared, as the operator defines. A pair first has to overlap by ``overlap`` - 0.15 in the newest ``sample``
    memories of each; its overlap is then exact, from a self join of those cues' postings.
    """
    post = postings(memories)
    df = frequency(post).where((F.octet_length("cue") >= 3) & (F.col("df") >= low) & (F.col("df") <= high))
    by = Window.partitionBy("project_id")
    ranked = df.withColumn("rn", F.row_number().over(by.orderBy(F.desc("df"), "cue"))).withColumn("cut", F.floor(F.count("*").over(by) * 0.01))
    some = ranked.where((F.col("rn") > F.col("cut")) & (F.col("rn") <= F.col("cut") + top)).select("project_id", "cue", "df")
    newest = F.row_number().over(Window.partitionBy("project_id", "cue").orderBy(F.desc("seq"), "memory_id")) <= sample  # lists of ``high`` at most
    p = post.join(some, ["project_id", "cue"]).select("project_id", "memory_id", "cue", "df", newest.alias("newest"))
    a, b = p.toDF("project_id", "memory_id", "a", "df_a", "new_a"), p.toDF("project_id", "memory_id", "b", "df_b", "new_b")
    gate = (F.col("a") < F.col("b")) & (F.abs(F.col("df_a") - F.col("df_b")) / F.greatest("df_a", "df_b") <= size_ratio) & C.lexical_gate(F.col("a"), F.col("b"))
    pairs = a.join(b, ["project_id", "memory_id"]).where(gate).groupBy("project_id", "a", "b", "df_a", "df_b").agg(F.count("*").alias("both"), F.count_if(F.col("new_a") & F.col("new_b")).alias("new"))
    seen = F.col("new") / F.least("df_a", "df_b", F.lit(sample)) >= F.lit(overlap) - 0.15
    share = F.col("both") / F.least("df_a", "df_b")
    canon = C.canonical_of(F.col("a"), F.col("b"))
    out = pairs.where(seen & (share >= overlap)).select("project_id", canon.alias("canonical"), F.when(canon == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("alias"), F.round(share, 6).alias("overlap"))
    return out.withColumn("alias_id", alias_id(F.col("alias"), F.col("canonical")))


def expandable(df: DataFrame, total: int, t: Tuning = Tuning()) -> DataFrame:
    """Cues rare enough to expand: df <= max(a tenth of all memories, 20), and not of a key that names things."""
    key = F.coalesce(C.cue_key(F.col("cue")), F.lit(""))
    return df.where((F.col("df") <= max(total * t.expansion_fraction, t.idf_min_count)) & ~key.isin(*C.NO_EXPANSION))


def propose_cues(sources: list[DataFrame], t: Tuning = Tuning()) -> DataFrame:
    """(memory_id, cue): proposals of the sources (memory_id, cue, ord), earlier sources first, three bytes at least, once
    whatever the case, at most ``max_proposed_cues`` a memory."""
    all_ = None
    for i, s in enumerate(sources):
        s = s.select("memory_id", "cue", F.lit(i).alias("src"), "ord")
        all_ = s if all_ is None else all_.unionByName(s)
    ok = all_.where(F.octet_length("cue") >= 3).withColumn("low", F.lower("cue"))
    once = ok.withColumn("k", F.row_number().over(Window.partitionBy("memory_id", "low").orderBy("src", "ord", "cue"))).where("k = 1")
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy("src", "ord", "cue"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= t.max_proposed_cues).select("memory_id", "cue", "rank")
