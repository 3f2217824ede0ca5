"""Temperature mixing of sources: token shares to an exponent, found by bisection, realised as budgeted block permutations.

Each source is cut into blocks of about ``block_tokens`` by a hash of doc_id. An epoch of a source is a permutation of
its blocks; a budget is spent on whole epochs, then on whole blocks of one more permutation, then on a beginning of the
next block in the order of its hashes. Only one row per source goes to the driver; the schedule has one row per block
and epoch and is joined to the documents, whose texts stay where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._arrow import fresh, shared_dir
from recallgrid.llm.packing import token_count

BLOCK_TOKENS = 1 << 20
STEPS = 60


def key(*parts) -> Column:
    """60 bits of the MD5 of the parts joined by '|': the same in any SQL engine."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("bigint")


def weights(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    total = sum(tokens.values())
    power = {s: (t / total) ** alpha for s, t in tokens.items()}
    z = sum(power.values())
    return {s: p / z for s, p in power.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(p * math.log2(p) for p in w.values() if p > 0)


def exponent(tokens: dict[str, int], target_entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None) -> float:
    """By bisection: the exponent in [0, 1] whose weights have ``target_entropy`` bits, or the least one with which no
    source is repeated more than ``max_repeat`` times. Without a budget repetition is counted against the least
    repeated source; a target out of reach gives the nearer end."""
    total = sum(tokens.values())

    def flat_enough(a: float) -> bool:  # True while a smaller exponent is still allowed
        w = weights(tokens, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        times = [w[s] * (budget or total) / t for s, t in tokens.items()]
        return max(times) / (1 if budget else min(times)) <= max_repeat

    lo, hi = 0.0, 1.0
    if flat_enough(lo):
        return lo
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if flat_enough(mid) else (mid, hi)
    return hi


@dataclass(frozen=True)
class Mix:
    alpha: float
    tokens: dict[str, int]
    weights: dict[str, float]
    budgets: dict[str, int]


def plan_mix(tokens: dict[str, int], target_entropy: float | None = None, max_repeat: float | None = 2.0, budget: int | None = None) -> Mix:
    """Budgets in tokens by source. Without ``budget`` the total is the least that uses all of every source once."""
    tokens = {s: t for s, t in tokens.items() if t > 0}
    if not tokens:
        return Mix(1.0, {}, {}, {})
    alpha = exponent(tokens, target_entropy, max_repeat, budget)
    w = weights(tokens, alpha)
    total = budget if budget is not None else max(t / w[s] for s, t in tokens.items())
    return Mix(alpha, tokens, w, {s: round(total * w[s]) for s in tokens})


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, **how) -> DataFrame:
    """``docs``, each row as often as the mix has it, with epoch (from 0), block_rank (place of its block in that epoch of its source)
    and shuffle_key (order within the block).

    An input column of one of these three names stays what it is, and the new one gets a name with '_' behind it. A null
    source counts as the empty one. Null and empty texts have no token; they go with the block that their id falls in, at
    no cost. Rows that repeat a doc_id tie in (shuffle_key, doc_id), as all rows without one do, and are in or out
    together. A source without a token is taken once. The last, partial block never exceeds the budget; a text longer than
    a block is a block that is longer. An empty table gives no row.
    """
    epoch, rank, shuffle = names = fresh(docs.columns, "epoch", "block_rank", "shuffle_key")
    src, tok, blk, hsh, cut, cut_id, nb, partial = fresh([*docs.columns, *names], "mix_source", "mix_tokens", "mix_block", "mix_hash", "mix_cut", "mix_cut_id", "mix_blocks", "mix_partial")
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    hashed = key("doc", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    shared_dir(spark)
    light = docs.select(source.alias(src), F.col(id_col).alias("mix_id"), hashed.alias(hsh), token_count(F.col(text_col).cast("string")).alias(tok)).checkpoint()  # tokens are counted once
    sums = {r[0]: int(r[1]) for r in light.groupBy(src).agg(F.sum(tok)).collect()}  # a row per source
    mix = plan_mix(sums, **how)
    rows = [(s, max(1, -(-t // block_tokens)), t, mix.budgets.get(s, 0)) for s, t in sums.items()]
    per_source = spark.createDataFrame(rows, f"{src} string, {nb} bigint, source_tokens bigint, budget bigint")
    light = light.join(per_source.select(src, nb), src).withColumn(blk, F.col(hsh) % F.col(nb))
    blocks = light.groupBy(src, blk).agg(F.sum(tok).alias("block_sum")).join(per_source, src)
    epochs = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest("source_tokens", F.lit(1)))).cast("int")
    order = Window.partitionBy(src, epoch).orderBy(key("block", F.col(src), F.col(epoch), F.col(blk)), blk)
    schedule = (
        blocks.select("*", F.explode(F.sequence(F.lit(0), epochs - 1)).alias(epoch))
        .withColumn(rank, F.row_number().over(order) - 1)
        .withColumn("before", F.sum("block_sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_sum"))
        .withColumn("room", F.col("budget") - F.col(epoch) * F.col("source_tokens") - F.col("before"))
        .where("room > 0 or source_tokens = 0")
        .select(src, blk, epoch, rank, "room", (F.col("room") < F.col("block_sum")).alias(partial))
    )
    part = schedule.where(F.col(partial)).select(src, blk, epoch, "room")  # one block per source at most
    running = F.sum(tok).over(Window.partitionBy(src, blk, epoch).orderBy(hsh, F.col("mix_id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0))
    ties = light.join(F.broadcast(part) if len(sums) <= 10_000 else part, [src, blk]).groupBy(src, blk, epoch, "room", hsh, "mix_id").agg(F.sum(tok).alias(tok))  # rows that tie are one before the window
    last = (
        ties.withColumn("run", running)
        .where("run <= room").groupBy(src, blk, epoch).agg(F.max(F.struct(hsh, "mix_id")).alias("top")).select(src, blk, epoch, F.col(f"top.{hsh}").alias(cut), F.col("top.mix_id").alias(cut_id))
    )
    schedule = schedule.join(last, [src, blk, epoch], "left").select(src, blk, epoch, rank, partial, cut, cut_id)
    inside = ~F.col(partial) | (F.col(hsh) < F.col(cut)) | ((F.col(hsh) == F.col(cut)) & F.coalesce(F.col(id_col) <= F.col(cut_id), F.col(id_col).isNull()))
    placed = docs.withColumns({src: source, hsh: hashed}).join(per_source.select(src, nb), src).withColumn(blk, F.col(hsh) % F.col(nb))
    return placed.join(schedule, [src, blk]).where(inside).withColumn(shuffle, F.col(hsh)).select(*docs.columns, *names)


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(doc_id, source, epoch, block_rank, shuffle_key) of every row that the mix takes, once per epoch; nulls, ties and
    empty tables as in ``mixed``, and no other column is read."""
    three = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return mixed(three, **how).select("doc_id", "source", "epoch", "block_rank", "shuffle_key")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS tok,
         CAST('0x' || substr(md5('doc|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (SELECT s, sum(tok)::BIGINT AS tokens FROM t GROUP BY s),
pos AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM src) AS p FROM src WHERE tokens > 0),
ends AS (SELECT min(p) AS p_min, max(p) AS p_max FROM pos),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN pow(p_max / p_min, 1.0) <= 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM ends
  UNION ALL
  SELECT i + 1, CASE WHEN pow(p_max / p_min, 1 - (lo + hi) / 2) <= 2 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(p_max / p_min, 1 - (lo + hi) / 2) <= 2 THEN (lo + hi) / 2 ELSE hi END
  FROM bis, ends WHERE i < 60),
w AS (SELECT s, tokens, pow(p, a) / sum(pow(p, a)) OVER () AS w FROM pos, (SELECT hi AS a FROM bis WHERE i = 60)),
total AS (SELECT max(tokens / w) AS b FROM w),
per AS (SELECT src.s, src.tokens, coalesce(round(b * w), 0)::BIGINT AS budget, greatest(1, (src.tokens + 1048575) // 1048576)::BIGINT AS nb
        FROM src LEFT JOIN w USING (s), total),
d AS (SELECT t.*, h % nb AS blk, per.tokens, budget FROM t JOIN per USING (s)),
b AS (SELECT s, blk, any_value(tokens) AS tokens, any_value(budget) AS budget, sum(tok)::BIGINT AS bs FROM d GROUP BY s, blk),
e AS (SELECT *, unnest(range(0, greatest(1, ceil(budget / greatest(tokens, 1)))::BIGINT)) AS epoch FROM b),
o AS (SELECT *, CAST('0x' || substr(md5('block|' || s || '|' || epoch || '|' || blk), 1, 15) AS BIGINT) AS bh FROM e),
sch AS (SELECT s, blk, epoch, bs, row_number() OVER q - 1 AS block_rank, budget - epoch * tokens - (sum(bs) OVER q - bs) AS room, tokens
        FROM o WINDOW q AS (PARTITION BY s, epoch ORDER BY bh, blk ROWS UNBOUNDED PRECEDING)),
taken AS (
  SELECT d.doc_id, d.source, sch.epoch, sch.block_rank, d.h, sch.room, sch.bs,
         sum(d.tok) OVER (PARTITION BY d.s, d.blk, sch.epoch ORDER BY d.h, d.doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM d JOIN sch USING (s, blk) WHERE sch.room > 0 OR sch.tokens = 0)
SELECT doc_id, source, epoch::INTEGER AS epoch, block_rank::INTEGER AS block_rank, h AS shuffle_key FROM taken WHERE room >= bs OR run <= room
"""
