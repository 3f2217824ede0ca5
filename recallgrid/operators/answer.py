"""From a text to memories and to a signed context: the steps of a request, for a batch of texts in one plan.

``texts`` has query_id and text. Tokens and phrases of a text are looked up in the lexicon, canonical cues go through the
rules and the taxonomy, active aliases of the text's own tokens join at their weight, and recall answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.config import Normalization, Taxonomy
from recallgrid.functions import cues as C
from recallgrid.functions import text as T
from recallgrid.operators import grounding as GR
from recallgrid.operators.graph import expand_aliases, resolve
from recallgrid.operators.index import postings
from recallgrid.operators.recall import recall_multihop, with_content
from recallgrid.operators.recall import recall as recall_cues


def query_cues_of_text(texts: DataFrame, lexicon: DataFrame, index: DataFrame, aliases: DataFrame | None = None, normalization: Normalization = Normalization(), taxonomy: Taxonomy | None = None, own_tokens: bool = True, lang: str = "default") -> DataFrame:
    """(query_id, cue, weight) of each text. ``own_tokens`` asks the text's tokens besides what the lexicon has for them.
    Only cues that ``index`` (cue) has are kept where aliases are given."""
    tokens = texts.select("query_id", T.cues(F.col("text"), lang).alias("tokens"))
    cues = resolve(lexicon, tokens, normalization=normalization, taxonomy=taxonomy)
    flat = tokens.select("query_id", F.explode("tokens").alias("cue"))
    if own_tokens:
        cues = cues.unionByName(flat.select("query_id", C.normalize_cue(F.col("cue"), normalization)[0].alias("cue"))).distinct()
    if aliases is None:
        return cues.withColumn("weight", F.lit(1.0))
    return expand_aliases(cues, flat, aliases, index)


def recall_text(memories: DataFrame, texts: DataFrame, lexicon: DataFrame, aliases: DataFrame | None = None, limit: int = 10, depth: int = 1, normalization: Normalization = Normalization(), taxonomy: Taxonomy | None = None, **how) -> DataFrame:
    """The best memories of each text, over ``depth`` hops; columns as those of recall."""
    q = query_cues_of_text(texts, lexicon, postings(memories), aliases, normalization, taxonomy)
    return recall_cues(memories, q, limit=limit, **how) if depth <= 1 else recall_multihop(memories, q, depth=depth, limit=limit, **how)


def grounded(memories: DataFrame, texts: DataFrame, lexicon: DataFrame, aliases: DataFrame | None = None, limit: int = 10, budget: int = 2048, normalization: Normalization = Normalization(), taxonomy: Taxonomy | None = None, source: str = "memory", **how) -> DataFrame:
    """(query_id, rank, memory_id, chosen, why, reason, ...): the selection of grounding.select_memories from max(limit, 20)
    results of each text; context_block and signed make the signed context of it."""
    q = query_cues_of_text(texts, lexicon, postings(memories), aliases, normalization, taxonomy, own_tokens=False)
    found = with_content(recall_cues(memories, q, limit=max(limit, 20), **how), memories)
    return GR.select_memories(found.select("query_id", "rank", "memory_id", "content", "score", "intersection_count", "match_integrity", "created_at", F.lit(source).alias("source")), budget)


def grounded_context(memories: DataFrame, texts: DataFrame, lexicon: DataFrame, key: bytes, **how) -> DataFrame:
    """(query_id, block, signature)"""
    return GR.signed(GR.context_block(grounded(memories, texts, lexicon, **how)), key)
