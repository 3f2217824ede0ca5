"""Memories and their inverted index: postings, document frequency, co-occurrence, and the edits of a memory table.

A memory table has project_id, memory_id, content, cues, seq, created_at, intrinsic_salience, dynamic_salience,
last_boosted_at, reinforcement_count. Postings are a pure function of it.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.cues import index_form, index_keys
from recallgrid.session import shared_dir


def postings(memories: DataFrame) -> DataFrame:
    """(project_id, memory_id, seq, cue), one row per memory and index key; empty cues are dropped."""
    whole = F.transform("cues", index_form)
    values = F.transform(whole, lambda c: F.when(F.instr(c, ":") > 0, F.trim(F.substring(c, F.instr(c, ":") + 1, F.length(c)))).otherwise(F.lit("")))
    # as index_keys says, with each form worked out once; outer, as the optimizer else makes the array twice to see if it is empty
    return memories.select("project_id", "memory_id", "seq", F.explode_outer(F.array_distinct(F.concat(whole, values))).alias("cue")).where("cue <> ''")


def stored(df: DataFrame, name: str = "memories") -> DataFrame:
    """``df`` written once to the folder that all executors share, for plans that read it several times."""
    path = posixpath.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def positioned(post: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Postings with pos (0: newest of its cue) and len.

    A cue's list is ranked in stretches of ``span`` values of seq, each moved on by the lengths of the newer ones, so that
    a cue which a third of all memories have is no single task's work.
    """
    p = post.withColumn("stretch", F.floor(F.col("seq") / span))
    key = ["project_id", "cue"]
    sizes = post.select(*key, F.floor(F.col("seq") / span).alias("stretch")).groupBy(*key, "stretch").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*key)
    newer = sizes.select(*key, "stretch", (F.sum("n").over(by.orderBy(F.desc("stretch"))) - F.col("n")).alias("newer"), F.sum("n").over(by).alias("len"))
    within = F.row_number().over(Window.partitionBy(*key, "stretch").orderBy(F.desc("seq"), "memory_id")) - 1
    return p.withColumn("within", within).join(newer, [*key, "stretch"]).withColumn("pos", F.col("within") + F.col("newer")).select(*post.columns, "pos", "len")


def build(memories: DataFrame, path: str) -> DataFrame:
    """Writes the postings with their places, sorted by cue so that files and row groups can be passed over, and reads them."""
    positioned(postings(memories)).repartitionByRange("cue", "pos").sortWithinPartitions("cue", "pos").write.mode("overwrite").parquet(path)
    return memories.sparkSession.read.parquet(path)


def frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("project_id", "cue").agg(F.count("*").alias("df"))


def recent(post: DataFrame, limit: int, span: int = 1 << 16) -> DataFrame:
    """The newest ``limit`` postings of each cue. Only stretches of ``span`` values of seq that have fewer than ``limit``
    newer ones are sorted, so that no task sorts what it throws away."""
    key = ["project_id", "cue"]
    p = post.withColumn("stretch", F.floor(F.col("seq") / span))
    sizes = p.groupBy(*key, "stretch").agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.partitionBy(*key).orderBy(F.desc("stretch"))) - F.col("n")
    need = sizes.withColumn("newer", newer).where(F.col("newer") < limit).select(*key, "stretch")
    w = Window.partitionBy(*key).orderBy(F.desc("seq"), "memory_id")
    return p.join(need, [*key, "stretch"], "left_semi").select(*post.columns).withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < limit)


def cooccurrence(memories: DataFrame) -> DataFrame:
    """(project_id, cue_a, cue_b, n), both directions: unordered pairs of a memory's cue list, repeats counted.

    Pairs are made inside the row, one side after the other, so that no row holds them all; only counted pairs are
    shuffled, after a partial count on the map side.
    """
    c = F.filter(F.transform("cues", index_form), lambda x: x != "")
    side = memories.select("project_id", c.alias("c")).select("project_id", "c", F.posexplode("c").alias("i", "x"))
    one = side.select("project_id", "x", F.explode(F.slice("c", F.col("i") + 2, F.greatest(F.size("c") - F.col("i") - 1, F.lit(0)))).alias("y")).where("x <> y")
    half = one.groupBy("project_id", F.least("x", "y").alias("cue_a"), F.greatest("x", "y").alias("cue_b")).agg(F.count("*").alias("n"))
    return half.select("project_id", "n", F.explode(F.array(F.struct("cue_a", "cue_b"), F.struct(F.col("cue_b").alias("cue_a"), F.col("cue_a").alias("cue_b")))).alias("p")).select("project_id", "p.cue_a", "p.cue_b", "n")


def upsert(memories: DataFrame, changes: DataFrame, overwrite_cues: bool = True) -> DataFrame:
    """``memories`` with ``changes`` (same columns) put in by (project_id, memory_id): content is replaced, cues replaced or
    united, statistics and creation kept for what was there; new rows are added as they are."""
    key = ["project_id", "memory_id"]
    new = changes.select(*key, F.col("content").alias("n_content"), F.col("cues").alias("n_cues"))
    mixed = F.col("n_cues") if overwrite_cues else F.array_union("cues", "n_cues")
    kept = memories.join(new, key, "left").withColumn("cues", F.when(F.col("n_cues").isNotNull(), mixed).otherwise(F.col("cues"))).withColumn("content", F.coalesce("n_content", "content"))
    return kept.select(*memories.columns).unionByName(changes.join(memories.select(*key), key, "left_anti").select(*memories.columns))


def attach_cues(memories: DataFrame, added: DataFrame) -> DataFrame:
    """``added`` (project_id, memory_id, new_cues): cues not there yet go to the end, in order."""
    return memories.join(added, ["project_id", "memory_id"], "left").withColumn("cues", F.array_union("cues", F.coalesce("new_cues", F.array().cast("array<string>")))).select(*memories.columns)


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids, ["project_id", "memory_id"], "left_anti")


def prune_low_salience(memories: DataFrame, least: float, reinforced: int = 5) -> DataFrame:
    """What stays when weak memories (salience under ``least``, seldom reinforced) go."""
    weak = (F.col("intrinsic_salience") + F.col("dynamic_salience") < least) & (F.col("reinforcement_count") < reinforced)
    return memories.where(~weak)


def reinforce(memories: DataFrame, events: DataFrame, manual: bool = False) -> DataFrame:
    """Fold of reinforcement events (project_id, memory_id, ts, event_id, amount) in (ts, event_id) order.

    manual: intrinsic + 0.1 a time; else dynamic + amount / (1 + dynamic). Both add to the count; the last ts is the
    boost time of a dynamic one. The touched memories' seq is not changed here: recency is the order of the event log.
    """
    e = events.groupBy("project_id", "memory_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "amount"))).alias("ev"), F.count("*").alias("k"), F.max("ts").alias("last"))
    j = memories.join(e, ["project_id", "memory_id"], "left")
    k = F.coalesce("k", F.lit(0))
    if manual:
        out = j.withColumn("intrinsic_salience", F.col("intrinsic_salience") + k * 0.1)
    else:
        from recallgrid.functions.scoring import boosted

        out = j.withColumn("dynamic_salience", F.when(F.col("ev").isNull(), F.col("dynamic_salience")).otherwise(boosted(F.col("dynamic_salience"), F.transform("ev", lambda x: x["amount"])))).withColumn("last_boosted_at", F.coalesce("last", "last_boosted_at"))
    return out.withColumn("reinforcement_count", F.col("reinforcement_count") + k).select(*memories.columns)


def touched_postings(post: DataFrame, touches: DataFrame) -> DataFrame:
    """``post`` with the places that reinforcement gives: a memory moves to the front of the lists of the cues that it was
    reinforced with (``touches``: project_id, memory_id, cues, event_id), value keys too, in the order of the events.

    A moved posting's seq is the greatest seq of all plus the event's number, so that ``positioned`` ranks it first; cues
    that the memory doesn't have move nothing.
    """
    t = touches.select("project_id", "memory_id", "event_id", F.explode(F.flatten(F.transform("cues", index_keys))).alias("cue"))
    last = t.groupBy("project_id", "memory_id", "cue").agg(F.max("event_id").alias("last"))
    top = post.groupBy("project_id").agg(F.max("seq").alias("top"))
    moved = post.join(last, ["project_id", "memory_id", "cue"], "left").join(top, "project_id")
    return moved.withColumn("seq", F.when(F.col("last").isNotNull(), F.col("top") + 1 + F.col("last")).otherwise(F.col("seq"))).select(*post.columns)


def grown_cooccurrence(cooc: DataFrame, touches: DataFrame) -> DataFrame:
    """``cooc`` with the pairs of each reinforcement's cues (``touches``: project_id, cues) counted on top."""
    return cooc.unionByName(cooccurrence(touches)).groupBy("project_id", "cue_a", "cue_b").agg(F.sum("n").alias("n"))


def episodes(events: DataFrame, gap_s: float = 300.0, overlap: float = 0.5, by: str = "project_id") -> DataFrame:
    """``events`` (by, memory_id, ts, cues, seq) with episode: ``episode:<previous id>`` where the event before is at most
    ``gap_s`` older and shares more than ``overlap`` of this one's cues, else null."""
    w = Window.partitionBy(by).orderBy("seq")
    before = F.lag(F.struct("memory_id", "ts", "cues")).over(w)
    e = events.withColumn("before", before)
    share = F.size(F.array_intersect("cues", "before.cues")) / F.greatest(F.size("cues"), F.lit(1))
    return e.withColumn("episode", F.when((F.col("ts") - F.col("before.ts") < gap_s) & (share > overlap), F.concat(F.lit("episode:"), F.col("before.memory_id")))).drop("before")


def first_cue(cues: Column) -> Column:
    return F.get(cues, F.lit(0))


def similar_sets(classes: DataFrame, theta: float) -> DataFrame:
    """(project_id, a, b): pairs, a < b, of ``classes`` (project_id, id, cues: distinct) whose Jaccard reaches ``theta``.

    Only sets that share one of their rarest cues are compared: with theta of a set of n cues in common at least, the
    first n - ceil(theta n) + 1 in the order of frequency can't all be missing from the other (prefix filter).
    """
    c = classes.select("project_id", "id", "cues", F.explode("cues").alias("cue"))
    df = c.groupBy("project_id", "cue").agg(F.count("*").alias("df"))
    rare = c.join(df, ["project_id", "cue"]).groupBy("project_id", "id").agg(F.array_sort(F.collect_list(F.struct("df", "cue"))).alias("o"))
    head = rare.select("project_id", "id", F.size("o").alias("n"), F.explode(F.slice("o", 1, F.size("o") - F.ceil(F.size("o") * theta - 1e-9).cast("int") + 1)).alias("o")).select("project_id", "id", "n", "o.cue")
    a, b = head.toDF("project_id", "a", "na", "cue"), head.toDF("project_id", "b", "nb", "cue")
    near = a.join(b, ["project_id", "cue"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * theta - 1e-9)).select("project_id", "a", "b").distinct()
    sets = classes.select("project_id", "id", "cues")
    full = near.join(sets.toDF("project_id", "a", "ca"), ["project_id", "a"]).join(sets.toDF("project_id", "b", "cb"), ["project_id", "b"])
    both = F.size(F.array_intersect("ca", "cb"))
    return full.where(both / (F.size("ca") + F.size("cb") - both) >= theta).select("project_id", "a", "b")


def consolidate(memories: DataFrame, theta: float = 0.9) -> DataFrame:
    """(project_id, group_id, memory_id), one row per member: greedy groups in the order of seq.

    A memory that is in no group yet leads one with all such memories that have its first cue in their postings (in any
    place, or as the value of a cue) and a Jaccard of their cues of ``theta`` at least with it; groups have two members at
    least. Summaries (cue type:summary) and memories without cues are left out. Memories of equal cues always go together,
    so they are one class led by the first of them; of classes only similar ones meet, and each connected set of them is
    resolved in one task, which holds its classes and links, never its memories.
    """
    from recallgrid.operators.components import components

    some = memories.where((F.size("cues") > 0) & ~F.array_contains("cues", "type:summary")).select("project_id", "memory_id", "seq", F.array_sort(F.array_distinct("cues")).alias("k"), index_form(first_cue(F.col("cues"))).alias("first"))
    cls = some.groupBy("project_id", F.col("k").alias("cues")).agg(F.min(F.struct("seq", "memory_id", "first")).alias("lead"), F.count("*").alias("n")).select("project_id", "cues", F.col("lead.memory_id").alias("id"), "lead.seq", "lead.first", "n")
    cls = stored(cls, "classes")  # which every step below reads
    pairs = similar_sets(cls, theta)
    keys = F.array_distinct(F.flatten(F.transform("cues", index_keys)))
    side = cls.select("project_id", "id", "first", keys.alias("keys"))
    x, y = (side.select("project_id", F.col("id").alias(v), F.col("first").alias(f"first_{v}"), F.col("keys").alias(f"keys_{v}")) for v in "ab")
    links = pairs.join(x, ["project_id", "a"]).join(y, ["project_id", "b"]).select("project_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.expr("array_contains(keys_b, first_a)").alias("ok")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.expr("array_contains(keys_a, first_b)").alias("ok")))).alias("l")).where("l.ok").select("project_id", "l.src", "l.dst")
    links = stored(links, "links")
    node = lambda c: F.struct("project_id", F.col(c).alias("id"))
    parts = components(links.select(node("src").alias("a"), node("dst").alias("b")))
    parts = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    joined = cls.join(parts.select("node.project_id", "node.id", "root"), ["project_id", "id"]).join(links.groupBy("project_id", F.col("src").alias("id")).agg(F.collect_list("dst").alias("to")), ["project_id", "id"], "left")

    def resolve(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["seq", "id"])
        seen, rows = set(), []
        for c, n, to in zip(pdf["id"], pdf["n"], pdf["to"]):
            if c in seen:
                continue
            got = [d for d in (to if to is not None else []) if d not in seen]
            if n > 1 or got:
                seen.update([c, *got])
                rows += [(c, d) for d in [c, *got]]
        return pd.DataFrame([(pdf["project_id"].iloc[0], g, m) for g, m in rows], columns=["project_id", "group_id", "id"])

    led = joined.select("project_id", "root", "id", "seq", "n", "to").groupBy("project_id", "root").applyInPandas(resolve, "project_id string, group_id string, id string")
    alone = cls.where("n > 1").join(parts.select("node.project_id", "node.id"), ["project_id", "id"], "left_anti").select("project_id", F.col("id").alias("group_id"), "id")
    of = led.unionByName(alone).join(cls.select("project_id", "id", F.col("cues").alias("k")), ["project_id", "id"])
    return some.select("project_id", "memory_id", "k").join(of, ["project_id", "k"]).select("project_id", "group_id", "memory_id")


def summaries(memories: DataFrame, groups: DataFrame, limit: int = 1000) -> DataFrame:
    """A summary row per group (``groups``: project_id, group_id, memory_id): a head line and the contents in the order of
    seq, cues united with type:summary, salience averaged and raised by a fifth.

    A group's text stops at ``limit`` characters, to which a group's first limit / 5 members are enough (each brings a
    line between), so that no more of them are gathered however many it has.
    """
    m = groups.join(memories, ["project_id", "memory_id"])
    key = ["project_id", "group_id"]
    agg = m.groupBy(*key).agg(F.avg("intrinsic_salience").alias("i"), F.max("dynamic_salience").alias("d"), F.sum("reinforcement_count").alias("r"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("seq", "memory_id"))
    lines = m.select(*key, "seq", "memory_id", "content").withColumn("rn", rank).where(F.col("rn") <= limit // 5 + 2)
    texts = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "memory_id", "content"))).alias("g"))
    cues = m.select(*key, F.explode("cues").alias("cue")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("cue")).alias("cues"))
    text = F.concat(F.lit("[Consolidated Memory]\n"), F.array_join(F.transform("g", lambda x: x["content"]), "\n---\n"))
    short = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("... [truncated]"))).otherwise(text)
    every = F.array_union("cues", F.array(F.lit("type:summary")))
    return agg.join(texts, key).join(cues, key).select("project_id", F.concat(F.lit("summary:"), F.col("group_id")).alias("memory_id"), short.alias("content"), every.alias("cues"), (F.col("i") * 1.2).alias("intrinsic_salience"), F.col("d").alias("dynamic_salience"), F.col("r").alias("reinforcement_count"), F.col("n").alias("original_count"))
