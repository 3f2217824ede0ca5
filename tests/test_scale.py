"""What must hold at any size: plans and folds that don't grow faster than their input."""

from pyspark.sql import functions as F

from recallgrid.functions import fast
from recallgrid.functions import text as T
from recallgrid.operators import grounding as G
from recallgrid.operators import index as I
from recallgrid.operators import recall as R
from recallgrid.operators import semantic as SE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_selection_is_a_streamed_fold(spark):
    n = 30_000
    r = spark.range(n).select((F.col("id") % 2).alias("query_id"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("m"), "id").alias("memory_id"), F.when(F.col("id") != 4, F.repeat(F.lit("x"), (F.col("id") % 40 + 1).cast("int"))).alias("content"), F.lit(1.0).alias("score"), F.lit(1).alias("intersection_count"), F.lit(1.0).alias("match_integrity"), F.lit(1.0).alias("created_at"), F.lit("s").alias("source"))
    s = G.select_memories(r, 100)
    assert "collect_list" not in plan(s)
    want = {}
    for q in (0, 1):
        left, place = 100, 0
        for i in range(q, n, 2):
            t = None if i == 4 else -(-(i % 40 + 1) // 4)
            ok, before = None if t is None else t <= left, left
            left, place = (left - t, place + 1) if ok else (left, place)
            want[i] = (q, ok, before, place)
    assert {x["rank"]: (x["query_id"], x["chosen"], x["left"], x["place"]) for x in s.collect()} == want


def test_neighbours_over_blocks(spark):
    import random

    rng = random.Random(3)
    vecs = [[float(rng.randrange(-3, 4)) for _ in range(3)] for _ in range(400)] + [[0.0, 0.0, 0.0], [1.0, 2.0], [1.0, None, 2.0], None]
    items = spark.createDataFrame(list(enumerate(vecs)), "item_id bigint, vec array<float>")
    queries = items.where("item_id % 20 = 0 or item_id > 395").withColumnRenamed("item_id", "query_id")
    df = SE.neighbours(queries, items, 5, 0.2, block=64)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    cos = lambda a, b: (lambda p, q: 0.0 if p < 1e-6 or q < 1e-6 else sum(x * y for x, y in zip(a, b)) / (p * q))(sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5)
    want = []
    for q in [i for i in range(404) if i % 20 == 0 or i > 395]:
        if vecs[q] is None or None in vecs[q]:
            continue
        got = sorted((-round(c, 9), i, round(c, 6)) for i, v in enumerate(vecs) if i != q and v is not None and None not in v and len(v) == len(vecs[q]) and (c := cos(vecs[q], v)) >= 0.2)
        want += [(q, i, c, n) for n, (_, i, c) in enumerate(got[:5], 1)]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


TEXTS = [None, "", "Running queries; the children's (Ästhetik) NAÏVE word99abc abc1234567 http://www.ab-c.example.org/x?y=1 z", "İSTANBUL ΣΊΣΥΦΟΣ ½ x² naïve space tab\tnew line_under a|b||c d e f g h", "visits glasses mixing sizes enabling planned tried indices bus agreed being sting", "état-major çedilla ñandú été's don't we'll l'été 中文字 字符 words,more words. more words", "\x1cone\x1ftwo\x85three four\x0bfive six"]


def test_lists_of_texts_are_those_of_the_expressions(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS * 40)), "i int, t string")
    r = d.select(T.tokens(F.col("t")).alias("a"), fast.tokens(F.col("t")).alias("b"), T.cues(F.col("t")).alias("c"), fast.cues(F.col("t")).alias("d")).collect()
    assert all(x.a == x.b and x.c == x.d for x in r)
    words = spark.createDataFrame([(w,) for w in "passes ties flies boxes gas cats running hopping rating fizzed stopped dated seed need thing was his".split()], "w string")
    assert all(fast.lemma(x.w) == x.l for x in words.select("w", T.lemma(F.col("w")).alias("l")).collect())


def test_whole_tables_of_texts_take_the_arrow_functions(spark):
    from recallgrid.plans.catalog import QUERIES

    assert "ArrowEvalPython" in plan(QUERIES["tokenize_to_cues"](spark, "/root/testdata/sf0.001"))


def test_recent_postings_sort_only_the_newest_stretches(spark):
    m = spark.range(1000).selectExpr("'p' AS project_id", "concat('m', id) AS memory_id", "id AS seq", "IF(id % 2 = 0, array('a:x', 'X '), array('b', '', ':')) AS cues")
    p = I.postings(m)
    assert {(r.memory_id, r.cue) for r in p.where("seq < 2").collect()} == {("m0", "a:x"), ("m0", "x"), ("m1", "b"), ("m1", ":")}
    r = I.recent(p, 7, span=4)
    assert "left_semi" in r._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")
    assert sorted((x.cue, x.seq, x.pos) for x in r.where("cue in ('x', 'b')").collect()) == sorted((c, s - 2 * i, i) for c, s in (("x", 998), ("b", 999)) for i in range(7))


def test_postings_are_made_once(spark):
    m = spark.range(10).selectExpr("'p' AS project_id", "concat('m', id) AS memory_id", "id AS seq", "array(concat('a:', id)) AS cues")
    assert plan(I.postings(m)).count("array_distinct") == 1


def test_intersection_orders_no_whole_list(spark):
    m = spark.range(100).selectExpr("'p' AS project_id", "concat('m', id) AS memory_id", "id AS seq", "IF(id % 3 = 0, array('a', 'b'), array('b')) AS cues")
    q = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "query_id bigint, cue string, weight double")
    r = R.recall_intersection(m, q, 2)
    assert [(x.memory_id, x.score, x.match_integrity) for x in r.orderBy("rank").collect()] == [("m99", 300.0, 1.0), ("m96", 300.0, 1.0)]
    assert "within" not in r._jdf.queryExecution().optimizedPlan().toString()
