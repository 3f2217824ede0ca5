import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from recallgrid.llm import simhash as H
from recallgrid.llm import suffix as X
from recallgrid.llm import superkmer as S
from recallgrid.llm._arrow import Words

SCHEMA = "doc_id bigint, text string, hi string, fp int, bucket int"


def table(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], SCHEMA)


def normal(text):
    out = []
    for w in re.split(r"[ \t\n\r\x0b\x0c]+", text or ""):
        b = w.encode()
        c = bytes(x + 32 if 65 <= x <= 90 else x for x in b if x >= 128 or chr(x).isalnum())
        out += [c or b] if b else []
    return out


def spans_by_hand(items, k):
    where = collections.defaultdict(list)
    for n, (i, t) in enumerate(items):
        w = normal(t)
        if i is not None:
            for a in range(len(w) - k + 1):
                where[tuple(w[a : a + k])].append((i, a))
    marks, copies = collections.defaultdict(set), {}
    for v in where.values():
        if len({i for i, _ in v}) > 1:
            for i, a in v:
                marks[i].add(a)
                copies[i, a] = max(copies.get((i, a), 0), len(v))
    out = set()
    for i, s in marks.items():
        for a in s:
            if a - 1 not in s:
                b = a
                while b + 1 in s:
                    b += 1
                out.add((i, a, b + k, max(copies[i, x] for x in range(a, b + 1))))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "a-b", "|", "**"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [text(12) for _ in range(4)]
    items = []
    for i in range(60):
        t = text(r.randrange(0, 30))
        for _ in range(r.randrange(3)):
            t += " " + r.choice(shared) + " " + text(r.randrange(6))
        items.append((i, t))
    items += [(100, items[3][1].upper()), (101, items[3][1] + "!"), (102, None), (103, ""), (104, "one"), (None, items[3][1]), (5, items[5][1]), (105, "z " * 300), (106, "z " * 9), (107, "q " * 40)]
    return items


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed):
    items = corpus(seed)
    want = spans_by_hand(items, 8)
    assert want
    for f, how in ((S.repeated_spans, {}), (X.suffix_repeats, {"pile_words": 200})):
        got = f(table(spark, items).repartition(5), k=8, m=3, **how)
        assert got.columns == ["doc_id", "span_start", "span_end", "copies"]
        assert {tuple(r) for r in got.collect()} == want


def test_no_rows(spark):
    for f in (S.repeated_spans, X.suffix_repeats):
        assert f(table(spark, [(1, "x")]).where("false")).count() == 0
        assert f(table(spark, [(1, None), (2, "")])).count() == 0


def test_suffix_order_against_sorting(tmp_path):
    r = random.Random(3)
    for n in range(12):
        strings = [[r.randrange(1, 4) for _ in range(r.randrange(1, 12))] for _ in range(r.randrange(1, 9))]
        begin = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        files = X.Files(f"file://{tmp_path}/{n}")
        who, size, lcp = X.suffix_order(np.array(sum(strings, []), np.int32), begin, files)
        files.close()
        want = sorted((tuple(s[len(s) - k :]), i) for i, s in enumerate(strings) for k in range(len(s) + 1))
        got = [tuple(strings[i][len(strings[i]) - k :]) for i, k in zip(who.tolist(), size.tolist())]
        assert got == [w for w, _ in want]
        common = [0] + [next((j for j, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(got, got[1:])]
        assert lcp.tolist() == common


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 7, 8, 46):
        assert S.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(50 - w + 1)]


def test_words_of_a_slice():
    arr = pa.array(["skip", "Ab, c!", None, "", " ** x\ny", "é-É"]).slice(1)
    w = Words(arr, space=True)
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.off, w.off[1:])] == ["ab", "c", "**", "x", "y", "éÉ"]
    assert np.diff(w.doc).tolist() == [2, 0, 0, 3, 1]


def brute_pairs(fp, fp2):
    a, b = (np.bitwise_count(x[:, None] ^ x[None]).astype(int) for x in (fp, fp2))
    d = (a <= H.RADIUS) & (a + b <= H.TOTAL)
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(d)) if a < b}


def components_by_hand(pairs):
    of = {}
    for a, b in pairs:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for v in y:
                of[v] = x
    return {frozenset(v) for v in of.values()}


def near_fingerprints(n=3000):
    r = np.random.default_rng(4)
    fp = r.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(0, n, 3):
        for j in (i + 1, i + 2):
            for b in r.choice(64, r.integers(0, 12), replace=False):
                fp[j if j < n else i] = fp[i] ^ (np.uint64(1) << np.uint64(b))
            fp[j if j < n else i] = fp[i]
            for b in r.choice(64, r.integers(1, 13), replace=False):
                fp[j if j < n else i] ^= np.uint64(1) << np.uint64(b)
    return fp, np.zeros(n, np.uint64)


def test_index_finds_every_pair_of_a_bucket():
    fp, fp2 = near_fingerprints()
    i, j = (np.concatenate(x) for x in zip(*H.bucket_pairs(np.zeros(len(fp), np.uint64), fp, fp2, H.RADIUS, H.TOTAL)))
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert got == brute_pairs(fp, fp2) and len(i) == len(got)


def test_recall_at_every_distance_of_the_radius(spark):
    fp, fp2 = near_fingerprints()
    e = spark.createDataFrame([(int(i), int(a), 0) for i, a in enumerate(fp.view(np.int64))], "rep bigint, fp bigint, fp2 bigint")
    found = [(r.a, r.b) for r in H.near_pairs(e, len(fp)).collect()]
    got = set(found)
    assert len(got) == len(found) and got <= brute_pairs(fp, fp2)
    links = collections.Counter(x for p in got for x in p)
    sums, union = collections.Counter(), []
    for r in H.near_links(e, len(fp)).collect():
        sums[r.rep] += r.links
        union += [(r.rep, r.to)] if r.rep != r.to else []
    assert sums == links and components_by_hand(union) == components_by_hand(got)
    apart = collections.defaultdict(list)
    for p in brute_pairs(fp, fp2):
        apart[int(np.bitwise_count(fp[p[0]] ^ fp[p[1]]))].append(p in got)
    assert max(apart) == H.RADIUS and all(np.mean(v) >= 0.85 for v in apart.values()) and np.mean(sum(apart.values(), [])) >= 0.9


@pytest.mark.parametrize("entries", [3000, 1_000_000, 5_000_000, 30_000_000])
def test_recall_of_the_plan_at_any_size(entries):
    m, r = H.masks(*H.table_plan(entries)), np.random.default_rng(3)
    for d in (8, 10, 11, 12):
        x = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, d, replace=False).astype(np.uint64)) for _ in range(4000)])
        assert ((x[:, None] & m[None]) == 0).any(1).mean() >= 0.89  # 0.9 but for the draw


def test_gray_rank_is_the_inverse_of_the_gray_code():
    x = np.arange(1000, dtype=np.uint64)
    assert H.gray_rank(x ^ (x >> np.uint64(1))).tolist() == x.tolist()


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (5, 6), (20, 21), (21, 22), (6, 22)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in H.components(pairs).collect()} == {(n, 1) for n in (2, 3, 4, 5, 6, 20, 21, 22)} | {(11, 10)}
    assert H.components(pairs.where("false")).count() == 0


def test_groups_and_dropping(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [[r.choice(vocab) for _ in range(200)] for _ in range(8)]
    items = [(i, " ".join(w)) for i, w in enumerate(base[:6])]
    for i in range(3):
        w = list(base[i])
        w[17] = "changed"
        items += [(50 + i, " ".join(w)), (60 + i, items[i][1])]
    other, none = " ".join(base[6]), " ".join(base[7])
    items += [(70, None), (71, ""), (72, "!!!"), (None, none), (None, none), (4, items[4][1]), (4, other), (80, other), (None, None), (70, None), (None, items[5][1]), (90, "long " + " ".join(base[6] * 100))]
    d = table(spark, items)
    out = H.near_duplicate_groups(d).collect()
    g = {(r.doc_id, r.group_id, r.is_kept, r.copies) for r in out}
    # 4 stands for two groups, each with a row of its own; the rows without an id are grouped too
    want = {(i, i, True, 2 if i != 3 else 1) for i in range(6)} | {(50 + i, i, False, 1) for i in range(3)} | {(60 + i, i, False, 2) for i in range(3)}
    want |= {(4, 4, True, 2), (80, 4, False, 2), (70, 70, True, 2), (71, 71, True, 1), (72, 72, True, 1), (None, None, True, 2), (None, None, True, 1), (None, 5, False, 2)}
    assert g == want | {x for x in g if x[0] == 90} and len(out) == len(g) + 1  # 4 twice
    assert {r.links for r in out if r.doc_id in (0, 1, 2, 50, 51, 52)} == {1} and {r.links for r in out if r.doc_id in (3, 5, 70)} == {0}
    kept = H.drop_near_duplicates(d)
    assert kept.columns == d.columns
    text = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
    stay = [*[(False, i, items[i][1]) for i in range(6)], (False, 4, other), (False, 70, ""), (False, 71, ""), (False, 72, "!!!"), (True, 0, none), (True, 0, "")]
    assert text(r for r in kept.collect() if r.doc_id != 90) == sorted(stay)
    assert H.drop_near_duplicates(d.where("false")).count() == 0 and H.near_duplicate_groups(d.where("false")).count() == 0


def test_a_dense_bucket_of_near_copies(spark):
    """Thousands of different texts within the radius of each other: rows stay linear, every one gets into the group."""
    r = np.random.default_rng(2)
    fp = np.unique(np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(2500)]))
    e = spark.createDataFrame([(int(i), int(a), 0) for i, a in enumerate(fp.view(np.int64))], "rep bigint, fp bigint, fp2 bigint")
    found = H.near_links(e, len(fp)).checkpoint()
    n, most = found.count(), H.table_plan(len(fp))[1] * len(fp)
    assert n <= most and {x.root for x in H.components(found.where("rep <> to").select("to", "rep").toDF("a", "b").distinct()).collect()} == {0}
    assert found.agg({"links": "sum"}).first()[0] >= 2 * 0.9 * len(fp) * (len(fp) - 1) / 2
