"""Sealed payloads, ignore rules, snapshots, folder changes and reinforcement in the index."""

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import seal as E
from recallgrid.operators import index as I
from recallgrid.operators import ops as O
from recallgrid.sources import sync
from recallgrid.sources.ignore import ignored
from tests.test_core import memories, value


def test_poly1305_of_the_rfc():
    key = bytes.fromhex("85d6be7857556d337f4452fe42d506a80103808afb0db2fd4abff6af4149f51b")
    assert E.poly1305(key, b"Cryptographic Forum Research Group").hex() == "a8061dc1305136c6c22b8baf0c0127a9"


def test_chacha_poly_of_the_rfc():
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    key, nonce, extra = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    got = E.seal(key, text, nonce, extra)
    assert got[12:28].hex() == "d31a8d34648e60db7b86afbc53ef7ec2" and got[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert E.unseal(key, got, extra) == text and E.unseal(key, got, b"other") is None
    assert E.unseal(key, got[:-1] + bytes([got[-1] ^ 1]), extra) is None and E.unseal(key, b"short") is None


@pytest.mark.parametrize("data", [b"", b"x", b"y" * 64, b"z" * 1000])
def test_sealed_column(spark, data):
    key = E.derived_key("words", b"salt", 10)
    df = spark.createDataFrame([(data,), (None,)], "b binary").withColumn("s", E.sealed(F.col("b"), key))
    got = df.select(E.unsealed(F.col("s"), key).alias("o"), E.unsealed(F.col("s"), bytes(32)).alias("w"), F.length("s").alias("n")).collect()
    assert [None if r.o is None else bytes(r.o) for r in got] == [data, None] and got[0].w is None and got[0].n == len(data) + 28


def test_compressed_payloads_are_read(spark):
    df = spark.createDataFrame([(b"text " * 50,), (None,)], "b binary").withColumn("z", E.compressed(F.col("b")))
    got = df.select(O.opened(F.col("z")).alias("t"), O.opened(F.col("b")).alias("p"), E.is_compressed(F.col("z")).alias("is")).collect()
    assert got[0].t == got[0].p == "text " * 50 and got[0]["is"] and got[1].t == "<decryption failed>"
    assert value(spark, E.decompressed(F.lit(bytes.fromhex("28b52ffd00")))) is None
    assert df.select(E.decompressed(F.expr("substring(z, 1, length(z) - 3)")).alias("c")).first().c is None


def test_keys_that_are_let_in(spark):
    assert value(spark, O.authorized(F.lit("a"), ("a", "b"))) and not value(spark, O.authorized(F.lit(None).cast("string"), ("a",))) and value(spark, O.authorized(F.lit("x"), ()))


def test_resident_memory():
    assert O.rss_bytes() > 1 << 20


RULES = ["# comment", "", "*.log", "!keep.log", "/build/", "docs/**/x.txt", "tmp/", "[ab]?.py", "\\#odd"]


@pytest.mark.parametrize(
    ("path", "out"),
    [("a.log", True), ("d/e.log", True), ("keep.log", False), ("d/keep.log", False), ("build/x", True), ("d/build/x", False), ("docs/x.txt", True), ("docs/a/b/x.txt", True), ("docs/x.txt.bak", False), ("d/tmp/keep.log", True), ("tmp", False), ("a1.py", True), ("c1.py", False), ("#odd", True), ("a.log.txt", False)],
)
def test_ignore_rules(spark, path, out):
    assert value(spark, ignored(F.lit(path), RULES)) is out


def test_snapshots_are_replaced_copied_and_looked_into(spark, tmp_path):
    a, b = memories(spark, [("one", ["k:v"])]), memories(spark, [("two", ["x", "y"]), ("three", [])])
    path, other = f"file://{tmp_path}/snap", f"file://{tmp_path}/copy"
    sync.save_snapshot(a, path)
    sync.save_snapshot(b, path)
    assert {r.content for r in sync.load_snapshot(spark, path).collect()} == {"two", "three"}
    sync.copy_snapshot(spark, path, other)
    assert sync.list_snapshots(spark, f"file://{tmp_path}") == ["copy", "snap"]
    assert [(r.memory_id, r.cues, r.content_kind) for r in sync.inspect_snapshot(sync.load_snapshot(spark, other)).collect()] == [("m0", "x,y", "text or sealed"), ("m1", "", "text or sealed")]
    assert sync.delete_snapshot(spark, path) and sync.list_snapshots(spark, f"file://{tmp_path}") == ["copy"]
    sync.save_state(a, f"file://{tmp_path}/state")
    assert [(r.project_id, r.content) for r in sync.load_state(spark, f"file://{tmp_path}/state").collect()] == [("default", "one")]


def test_folder_changes(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    before = files([("a", b"1"), ("b", b"2"), ("c", b"3")])
    known = before.select("path", F.sha2("content", 256).alias("hash"))
    ch = sync.folder_changes(known, files([("a", b"1"), ("b", b"9"), ("d", b"4")]))
    assert {r.path: r.change for r in ch.collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, n int")
    assert [r.path for r in sync.forget_removed(m, ch).collect()] == ["a"]


def test_reinforcement_moves_to_the_front_and_counts(spark):
    m = memories(spark, [("1", ["a", "k:v"]), ("2", ["a", "k:v"]), ("3", ["a"])])
    t = spark.createDataFrame([("p", "m0", ["k:v", "a"], 1), ("p", "m1", ["k:v"], 2), ("p", "m2", ["k:v"], 3)], "project_id string, memory_id string, cues array<string>, event_id bigint")
    at = {(r.cue, r.memory_id): r.pos for r in I.positioned(I.touched_postings(I.postings(m), t)).collect()}
    assert at == {("a", "m0"): 0, ("a", "m2"): 1, ("a", "m1"): 2, ("k:v", "m1"): 0, ("k:v", "m0"): 1, ("v", "m1"): 0, ("v", "m0"): 1}
    n = {(r.cue_a, r.cue_b): r.n for r in I.grown_cooccurrence(I.cooccurrence(m), t).collect()}
    assert n == {("a", "k:v"): 3, ("k:v", "a"): 3}
