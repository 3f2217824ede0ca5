"""Operators on small hand-made inputs."""

import hashlib
import hmac

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recallgrid import config
from recallgrid.functions import cues as C
from recallgrid.functions import scoring as S
from recallgrid.functions import text as T
from recallgrid.operators import grounding as G
from recallgrid.operators import index as I
from recallgrid.operators import recall as R
from recallgrid.operators import semantic as SE
from recallgrid.sources import chunks, parsers, sync
from recallgrid.sources import web as W


def memories(spark, rows):
    """rows: (content, cues) or (content, cues, intrinsic, count), in insertion order."""
    made = []
    for i, r in enumerate(rows):
        content, cues, salience, count = (*r, 1.0, 0)[:2] + ((r[2] if len(r) > 2 else 1.0), (r[3] if len(r) > 3 else 0))
        made.append(("p", f"m{i}", content, cues, i, float(i), salience, 0.0, 0, count))
    return spark.createDataFrame(made, "project_id string, memory_id string, content string, cues array<string>, seq bigint, created_at double, intrinsic_salience double, dynamic_salience double, last_boosted_at bigint, reinforcement_count bigint")


def ask(spark, *cues):
    return spark.createDataFrame([(1, c, 1.0) for c in cues], "query_id bigint, cue string, weight double")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("The quick brown fox", {"quick", "fox"}), ("", set()), ("   ", set()), ("!!! @@@ ###", set()), ("added comment", {"add", "comment", "add_comment"}), ("adding comments", {"add", "comment", "add_comment"}), ("this line adds a comment", {"add", "comment"}), ("Directly export a function expression instead of using a declaration", {"directly", "export", "expression", "declaration"}), ("const result = await fetch(url)", {"result", "fetch", "url"}), ("see https://github.com/user/repo for details", {"github"})],
)
def test_cues(spark, text, want):
    got = set(value(spark, T.cues(F.lit(text))))
    assert want <= got if want else not got
    assert not {"user", "repo", "https"} & got


def test_null_text_has_no_cues(spark):
    assert value(spark, T.cues(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("raw", "want"), [("  HELLO   WORLD  ", "hello world"), ("Mixed-Case_With_Dots.com", "mixed case with dots com")])
def test_normalize(spark, raw, want):
    assert value(spark, T.normalize_text(F.lit(raw))) == want


def test_cue_rules(spark):
    n = config.Normalization(rules=(config.Rule("dash", "-", "_"), config.Rule("tag", "^([a-z_]+)$", "tag:$1")))
    cue, trace = C.normalize_cue(F.lit(" My-Value "), n)
    assert value(spark, cue) == "tag:my_value" and value(spark, trace) == ["dash", "tag"]


@pytest.mark.parametrize(("cue", "code"), [("status:active", None), ("plain", None), ("incomplete:", "bad_format"), (":x", "bad_format"), ("unknown:v", "unknown_key"), ("status:no", "unknown_value"), ("user:id_1", None), ("user:admin", "unknown_value")])
def test_taxonomy(spark, cue, code):
    t = config.Taxonomy(("status", "user"), {"status": ("active",)}, {"user": ("id_",)})
    assert value(spark, C.taxonomy_code(F.lit(cue), t)) == code


def test_proposals(spark):
    cases = {'["a:b", "c"]': ["a:b", "c"], '```json\n{"cues": ["x", {"value": "v", "key": "k"}]}\n```': ["x", "k:v"], 'so "topic:rust" it is': ["topic:rust"], "nothing": []}
    assert {k: value(spark, C.proposed_cues(F.lit(k))) for k in cases} == cases


def test_newest_first_and_gradient(spark):
    r = R.recall(memories(spark, [(f"c{i}", ["grad"]) for i in range(10)]), ask(spark, "grad")).orderBy("rank").collect()
    assert [x.memory_id for x in r] == [f"m{i}" for i in range(9, -1, -1)]
    assert all(a.score > b.score for a, b in zip(r, r[1:])) and r[1].recency_score == 0.5


def test_reinforcement_salience_integrity(spark):
    r = {x.memory_id: x for x in R.recall(memories(spark, [("f", ["cue"], 1.0, 100), ("r", ["cue"], 1.0, 10)]), ask(spark, "cue")).collect()}
    assert r["m0"].reinforcement_score == 2.0 and r["m1"].reinforcement_score == 1.0
    r = R.recall(memories(spark, [("s", list("abcde"), 50.0), ("l", ["a"])]), ask(spark, "a")).orderBy("rank").first()
    assert r.memory_id == "m0"
    r = {x.memory_id: x for x in R.recall(memories(spark, [("x", ["a", "b"]), ("y", ["a", "c", "d", "e"])]), ask(spark, "a", "b")).collect()}
    assert r["m0"].match_integrity > r["m1"].match_integrity


def test_double_index_and_delete(spark):
    m = memories(spark, [("t", ["type:function", "name:ComputeTax"]), ("s", ["category:secret"])])
    for cue in ("name:ComputeTax", "ComputeTax", "function"):
        assert R.recall(m, ask(spark, cue)).count() == 1
    gone = I.delete(m, m.where("memory_id = 'm1'").select("project_id", "memory_id"))
    assert R.recall(gone, ask(spark, "secret", "category:secret")).count() == 0


def test_completion_never_infers_pairs(spark):
    m = memories(spark, [("1", ["cue:a", "cue:b"]), ("2", ["x", "y"]), ("3", ["x", "y"]), ("4", ["y"])])
    assert R.recall(m, ask(spark, "cue:b"), completion=True).count() == 1
    assert R.recall(m, ask(spark, "x"), completion=True).count() == 3


def test_same_rows_whatever_the_partitioning(spark):
    m = memories(spark, [(str(i), [f"k{i % 3}", f"z{i % 5}"]) for i in range(60)])
    want = R.recall(m, ask(spark, "k1", "z2")).orderBy("rank").collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert R.recall(m.orderBy(F.rand(5)), ask(spark, "k1", "z2")).orderBy("rank").collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_edits(spark):
    m = memories(spark, [("one", ["a"]), ("two", ["b"])])
    new = memories(spark, [("ONE", ["c"]), ("x", ["b"]), ("three", ["d"])]).where("memory_id <> 'm1'")
    got = {r.memory_id: (r.content, r.cues) for r in I.upsert(m, new).collect()}
    assert got == {"m0": ("ONE", ["c"]), "m1": ("two", ["b"]), "m2": ("three", ["d"])}
    assert {r.memory_id: r.cues for r in I.upsert(m, new, overwrite_cues=False).collect()}["m0"] == ["a", "c"]
    added = spark.createDataFrame([("p", "m0", ["b", "a", "c"])], "project_id string, memory_id string, new_cues array<string>")
    assert {r.memory_id: r.cues for r in I.attach_cues(m, added).collect()} == {"m0": ["a", "b", "c"], "m1": ["b"]}


def test_consolidation(spark):
    m = memories(spark, [("x", ["type:report", "month:jan"]), ("y", ["type:report", "month:jan"]), ("z", ["other"])])
    g = I.consolidate(m, 0.6)
    s = I.summaries(m, g).collect()
    assert {(r.group_id, r.memory_id) for r in g.collect()} == {("m0", "m0"), ("m0", "m1")}
    a = memories(spark, [("1", ["a", "b", "c"]), ("2", ["a", "b", "c", "d"]), ("3", ["a", "b", "c", "d", "e"]), ("4", ["a", "b", "c", "d", "e", "f"])])
    assert {(r.group_id, r.memory_id) for r in I.consolidate(a, 0.75).collect()} == {("m0", "m0"), ("m0", "m1"), ("m2", "m2"), ("m2", "m3")}
    assert len(s) == 1 and "x" in s[0].content and "y" in s[0].content and "type:summary" in s[0].cues and s[0].original_count == 2


def test_budget_skips_and_goes_on(spark):
    rows = [(1, i + 1, f"m{i}", "x" * n, 1.0, 1, 0.5, 0.0, "s") for i, n in enumerate([400, 4000, 400])]
    r = spark.createDataFrame(rows, "query_id int, rank int, memory_id string, content string, score double, intersection_count int, match_integrity double, created_at double, source string")
    sel = G.select_memories(r, 250)
    assert [x.chosen for x in sel.orderBy("rank").collect()] == [True, False, True]
    assert G.excluded(sel).first().reason == "Exceeds remaining token budget (needs 1000, has 150)"
    b = G.signed(G.context_block(sel), b"k").first()
    assert b.block.startswith("[VERIFIED CONTEXT]\n(1) x") and b.signature == hmac.new(b"k", b.block.encode(), hashlib.sha256).hexdigest()
    assert G.context_block(G.select_memories(r, 1)).first().block == ""


def test_scoring_values(spark):
    assert value(spark, S.idf(F.lit(1), F.lit(5))) == 0.1
    assert value(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert abs(value(spark, S.effective_salience(F.lit(1.0), F.lit(2.0), F.lit(0), 3600)) - 2.0) < 1e-9


SAMPLES = {
    "a.py": ("def total(): return 1", "lang:python type:function name:total", None), "a.rs": ("pub struct Order { id: u8 }", "lang:rust type:struct name:Order", None), "a.ts": ("export interface Options { n: number }", "lang:typescript type:interface name:Options", None),
    "a.js": ("class Panel { }", "lang:javascript type:class name:Panel", None), "a.go": ("package main\nfunc main() {}", "lang:go type:function name:main", "function_declaration:main"), "A.java": ("public class Shop {}", "lang:java type:class name:Shop", "class_declaration:Shop"),
    "a.php": ("<?php function go() { }", "lang:php type:function name:go", None), "a.css": (".box{margin:0}", "lang:css selector:.box", "rule_set:.box"), "a.md": ("# Part\nText", "type:markdown_section header:Part", None), "a.json": ('{"api": 1}', "type:json_entry key:api", "json_key:api"),
    "a.yaml": ("stage: test", "type:yaml_entry key:stage", None), "a.xml": ("<list id='7'><x>y</x></list>", "lang:xml tag:list id:7 attr:id", None), "a.txt": ("One short.\n\nTwo short.", "lang:text type:text_content", None), "a.html": ("<html><body><p id='x'>x</p></body></html>", "lang:html tag:html", "html:html"),
}


@pytest.mark.parametrize("path", SAMPLES)
def test_chunkers(path):
    content, cues, context = SAMPLES[path]
    c = parsers.chunk(path, content)
    assert set(cues.split()) <= set(c[0].cues) and (context is None or c[0].context == context)


def test_chunker_edges():
    assert parsers.chunk("a.pptx", b"x") == [] and parsers.chunk("dummy.pdf", b"%PDF") == [] and parsers.chunk("x.unknown", "text") == []
    rows = parsers.chunk("data.csv", "id,name\n1,alice\n2,bob")
    assert [r.content for r in rows] == ["alice"]
    spec = parsers.chunk("s.json", '{"swagger": "2.0", "info": {"title": "T"}, "paths": {"/a": {"get": {"summary": "S", "operationId": "o", "tags": ["x"]}}}}')
    assert spec[0].content == "GET /a - S" and "operation:o" in spec[0].cues
    chat = parsers.chunk("whatsapp.txt", "[1/2/24, 10:00:00] Ann Lee: hello there\nmore\n[1/2/24, 10:01:00] Bo: image omitted")
    assert len(chat) == 1 and "sender:ann_lee" in chat[0].cues and "date:1-2-24" in chat[0].cues
    assert len(parsers.chunk("chrome_history.json", '{"Browser History": [{"title": "A", "url": "http://x.org/1", "time_usec": 0}, {"title": "A", "url": "http://x.org/1"}, {"title": "Untitled", "url": "u"}]}')) == 1
    assert parsers.pack_sentences(["x" * 90, "y" * 90, "z" * 90, "w" * 10]) == [" ".join(["x" * 90, "y" * 90, "z" * 90])]
    assert parsers.content_links("<article><a href='/a#x'>1</a><p>a</p><p>b</p><p>c</p><p>d</p><p>e</p><a href='#t'>2</a><nav><a href='/n'>3</a></nav></article>", "http://h.org/z") == ["http://h.org/a#x"]


def test_sync_and_snapshot(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string")
    assert {r.path: r.change for r in sync.changes(old, new).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    assert sorted(map(tuple, sync.apply_changes(old, new).collect())) == [("a", "1"), ("b", "x"), ("d", "4")]
    m = memories(spark, [("x", ["a"])])
    for _ in range(2):
        sync.save_snapshot(m, f"file://{tmp_path}/s")
    assert sync.load_snapshot(spark, f"file://{tmp_path}/s", "p").count() == 1 and sync.list_snapshots(spark, f"file://{tmp_path}") == ["s"]
    assert sync.delete_snapshot(spark, f"file://{tmp_path}/s")


def test_files_and_web(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / ".hidden").write_text("x")
    got = chunks.chunk_files(chunks.read_files(spark, str(tmp_path))).collect()
    assert [r.context for r in got] == ["function_definition:f"]
    e = spark.createDataFrame([("http://a.org/", "http://a.org/b#1"), ("http://a.org/b", "http://a.org/c"), ("http://a.org/b", "http://z.org/")], "src string, dst string")
    s = spark.createDataFrame([Row(url="http://a.org")])
    assert {r.url: r.depth for r in W.crawl(s, e, 1).collect()} == {"http://a.org": 0, "http://a.org/b": 1}


def test_vectors_from_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 2\none 1 0\ntwo 0.5 0.5\n")
    assert {r.word: r.vec for r in SE.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"one": [1.0, 0.0], "two": [0.5, 0.5]}


def test_profiles():
    assert config.layered({"idf_floor": 0.2}, {"idf_floor": 0.3}).idf_floor == 0.3
    with pytest.raises(TypeError):
        config.layered({"nope": 1})
