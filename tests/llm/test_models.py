import random

import numpy as np
import pyarrow as pa
import pytest

from recallgrid.llm import quality as Q
from recallgrid.llm import secrets as C
from recallgrid.llm import toxicity as T
from recallgrid.llm._arrow import bounded_sample

SF = "/root/testdata/sf0.01"


def table(spark, items):
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in items], "doc_id bigint, text string, quality int, score string, quality_score double")


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "light", "and", "the", "walks", "over", "quiet", "hills", "with"]) for _ in range(n)).capitalize() + "."


# ---- quality ----


def test_statistics_of_known_texts():
    x = Q.statistics_block(pa.array(["Ab cd. AB cd", None, "", "x\nx\nyy"]))
    f = {n: x[0, i] for i, n in enumerate(Q.FEATURES)}
    assert f["upper_share"] == pytest.approx(3 / 12) and f["stop_share"] == pytest.approx(1 / 12) and f["distinct_words"] == pytest.approx(0.5) and f["top_word"] == pytest.approx(0.5) and f["end_share"] == pytest.approx(0.25)
    assert not x[1].any() and not x[2].any()
    assert x[3, Q.FEATURES.index("distinct_lines")] == pytest.approx(2 / 3)


def test_flat_trees_are_the_recursive_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.grow(x[:300], y[:300], trees=30, depth=3)

    def walk(t, row, node=0, level=0):
        if level == 3:
            return m.leaf[t, node - 7]
        return walk(t, row, 2 * node + 1 + int(row[m.feature[t, node]] > m.cut[t, node]), level + 1)

    assert np.allclose(m.margin(x[:20]), [m.base + sum(walk(t, r) for t in range(30)) for r in x[:20]])
    assert ((m.score(x[300:]) > 0.5) == (y[300:] > 0.5)).mean() > 0.9


def test_trees_are_grown_as_a_plain_search_would(sf):
    """Splits by trying every cut of every feature on the rows of each node."""
    rng = np.random.default_rng(4)
    n, f, depth, rate, l2, least = 300, 4, 3, 0.2, 1.0, 3.0
    x = np.round(rng.normal(size=(n, f)), 2).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3) > 0).astype(float)
    got = Q.grow(x, y, trees=6, depth=depth, bins=16, rate=rate, l2=l2, least=least)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])).astype(np.float32) for j in range(f)]
    mean = y.mean()
    margin = np.full(n, np.log(mean / (1 - mean)))

    def grown(rows, level, g, h):
        if level == depth:
            return {int(r): -rate * g[rows].sum() / (h[rows].sum() + l2) for r in rows}
        best, gt, ht = (1e-9, None, None), g[rows].sum(), h[rows].sum()
        for j in range(f):
            for c in cuts[j]:
                left = rows[x[rows, j] <= c]
                gl, hl = g[left].sum(), h[left].sum()
                if hl < least / 10 or ht - hl < least / 10:
                    continue
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                if gain > best[0] + 1e-12:
                    best = (gain, j, c)
        go = x[rows, best[1]] > best[2] if best[1] is not None else np.zeros(len(rows), bool)
        return grown(rows[~go], level + 1, g, h) | grown(rows[go], level + 1, g, h)

    for _ in range(6):
        p = 1 / (1 + np.exp(-margin))
        leaf = grown(np.arange(n), 0, p - y, np.maximum(p * (1 - p), 1e-6))
        margin = margin + np.array([leaf[i] for i in range(n)])
    assert np.allclose(got.margin(x), margin, atol=1e-9)


def test_quality_on_held_out_rows(sf):
    docs, labels = sf
    x, y = Q.labelled_features(docs, labels, "quality")
    held = np.arange(len(y)) % 3 == 0
    p = Q.grow(x[~held], y[~held]).score(x[held])
    assert ((p > 0.5) == (y[held] > 0.5)).mean() >= 0.97


def test_quality_keeps_good_rows(spark, sf):
    docs, labels = sf
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    lab = labels.collect()
    good = [got[r.doc_id].is_kept for r in lab if r.quality == 1]
    assert len(got) == docs.count() and np.mean(good) >= 0.99 and np.mean([got[r.doc_id].is_kept for r in lab if r.quality == 0]) <= 0.1


def test_quality_edges(spark, sf):
    docs, labels = sf
    odd = table(spark, [(1, None), (2, ""), (3, "The quiet hills walk over the river. " * 2000), (None, "x"), (3, "The quiet hills.")])
    no = labels.where("false")
    assert [r.is_kept for r in Q.quality_scores(odd, no).orderBy("doc_id", "quality_score").collect()].count(False) == 2
    kept = Q.keep_good(odd, no)
    assert kept.columns == odd.columns and kept.count() == 3
    assert Q.keep_good(odd.where("false"), labels).count() == 0


def test_bounded_sample_is_bounded_and_stable(spark):
    d = spark.range(5000).withColumnRenamed("id", "k")
    a, b = bounded_sample(d, "k", 200).collect(), bounded_sample(d.repartition(9), "k", 200).collect()
    assert len(a) == 200 and sorted(a) == sorted(b)
    assert bounded_sample(d, "k", 9000).count() == 5000


# ---- secrets ----


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    return C.train([prose(rng, 60).encode() for _ in range(40)], constructed_rows=3000, epochs=5)


def test_candidates_and_windows():
    text = ["no", "k=" + "a1" * 20, None, "é" + "b" * 16 + "é", "c" * 200]
    from recallgrid.llm._arrow import utf8_parts

    raw, off = utf8_parts(pa.array(text))
    row, a, b = C.candidates(raw, off)
    assert row.tolist() == [1, 3, 4] and (b - a).tolist() == [42, 16, 200]
    sym, zone = C.windows(raw, off, row, a, b)
    assert (zone == 1).sum(1).tolist() == [42, 16, 64] and (zone[1] == 0).sum() == 2


def test_gradients(net):
    rng = random.Random(4)
    rows = C.constructed(rng, 6, ["alpha", "beta"])
    off = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    sym, zone = C.windows(raw, off, np.arange(6), off[:-1] + [r[1] for r in rows], off[:-1] + [r[2] for r in rows])
    y = np.array([r[3] for r in rows], np.float32)
    n = C.Network({k: v.astype(np.float64) for k, v in C.Network.new(3).w.items()})
    loss = lambda: float(np.mean(np.logaddexp(0, n.logits(sym, zone)) - y * n.logits(sym, zone)))
    g = n.gradients(sym, zone, y)
    for k, at in (("c", (3, 5)), ("h", (2, 1)), ("o", (0,)), ("ob", (0,)), ("hb", (1,))):
        old = n.w[k][at]
        n.w[k][at] = old + 1e-4
        up = loss()
        n.w[k][at] = old - 1e-4
        down = loss()
        n.w[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_the_forward_pass_is_the_plain_one(net):
    """The vectorised convolution, maxima and layers against loops over places and filters."""
    rng = random.Random(12)
    rows = C.constructed(rng, 4, ["alpha", "beta"])
    off = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    sym, zone = C.windows(raw, off, np.arange(4), off[:-1] + [r[1] for r in rows], off[:-1] + [r[2] for r in rows])
    w, want = net.w, []
    for s, z in zip(sym, zone):
        pool = np.zeros((3, C.FILTERS))
        for at in range(C.LENGTH - C.WIDTH + 1):
            k = z[at + C.WIDTH // 2]
            if k < 3:
                for f in range(C.FILTERS):
                    v = w["cb"][f] + sum(float(w["e"][s[at + t], e]) * float(w["c"][t * C.EMBED + e, f]) for t in range(C.WIDTH) for e in range(C.EMBED))
                    pool[k, f] = max(pool[k, f], v)
        hid = np.maximum(pool.ravel() @ w["h"] + w["hb"], 0)
        want.append(float(hid @ w["o"] + w["ob"][0]))
    assert np.allclose(net.logits(sym, zone), want, atol=1e-3)


def test_held_out_findings(net):
    rng = random.Random(99)
    rows = C.constructed(rng, 1200, ["river", "stone", "light", "walks", "hills", "quiet"])
    off = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    p = net.score(*C.windows(raw, off, np.arange(len(rows)), off[:-1] + [r[1] for r in rows], off[:-1] + [r[2] for r in rows])) >= net.threshold
    y = np.array([r[3] for r in rows]) > 0
    assert p[y].mean() >= 0.97 and p[~y].mean() <= 0.06


def test_findings_and_redaction(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(40)] + [(50, f'The river é token = "{key}" walks'), (51, None), (52, ""), (None, f'x api_key = "{key[::-1]}"'), (53, prose(rng, 20000) + f' secret = "{key}"')]
    d = table(spark, items)
    got = C.findings(d).collect()
    text = dict(items)
    hits = {(r.doc_id, text[r.doc_id].encode()[r.byte_start : r.byte_start + r.byte_length].decode()) for r in got}
    assert {(50, key), (53, key), (None, key[::-1])} <= hits and not {i for i, _ in hits} & set(range(40))
    red = C.redact(d, size_col=None)
    out = {r.doc_id: r.text for r in red.collect()}
    assert red.columns == d.columns and out[50] == 'The river é token = "[SECRET]" walks' and out[51] is None and out[52] == "" and all(out[i] == text[i] for i in range(40))
    assert C.redact(d.where("false"), size_col=None).count() == 0 and C.findings(d.where("false")).count() == 0


def test_a_key_in_the_middle_of_a_long_run(spark):
    rng = random.Random(5)
    long = lambda n: "/".join(rng.choice(["river", "stone", "light", "walks", "quiet", "hills"]) for _ in range(n))[: 6 * n - n]
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    items = []
    for i in range(30):
        items += [(i, f"{prose(rng, 8)} {long(15 + i)}/api_key={key()}/{long(15 + i % 7)} {prose(rng, 8)}"), (100 + i, f"{prose(rng, 8)} {long(45)} {'=-'[i % 2] * (70 + 9 * i)} {prose(rng, 8)}")]
    d = table(spark, items)
    hits = {(r.doc_id, r.byte_length > 64) for r in C.findings(d).collect()}
    assert sum((i, True) in hits for i in range(30)) >= 28 and sum((100 + i, True) in hits for i in range(30)) <= 1
    out = {r.doc_id: r.text for r in C.redact(d, size_col=None).collect()}
    assert sum("api_key" not in out[i] for i in range(30)) >= 28


# ---- toxicity ----


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(3)
    n, terms = 1500, 30
    w = r.normal(size=terms)
    row, term = np.repeat(np.arange(n), 6), r.integers(0, terms, 6 * n)
    z = np.bincount(row, w[term], n)
    grade = np.searchsorted([0.5, 2.0, 4.0], z + r.logistic(size=n) * 0.3)
    got, cuts = T.fit_ordinal(row, term, np.ones(6 * n), grade, terms)
    assert np.all(np.diff(cuts) > 0) and np.corrcoef(got, w)[0, 1] > 0.98
    assert np.corrcoef(np.bincount(row, got[term], n), grade)[0, 1] > 0.85


def test_grades_are_those_of_the_formula(spark):
    """severity() row by row: a sum over the words of a text, and the differences of four sigmoids."""
    r = random.Random(3)
    items = [(i, " ".join(r.choice(["stupid", "calm", "river", "stupidly", "fool", "the"]) for _ in range(r.randrange(1, 40)))) for i in range(60)]
    labels = spark.createDataFrame([(i, int("fool" in t)) for i, t in items], "doc_id bigint, toxic int")
    d = table(spark, items)
    m = T.train_on(d, labels)
    assert len(m.terms)
    got = {x.doc_id: x for x in T.severity(d, labels).collect()}
    for i, t in items:
        _, h, times, words = T.term_block(pa.array([t]))
        z = sum(float(m.weight[list(m.terms).index(a)]) * np.log1p(n) * np.log1p(400 * n / words[0]) / 4 for a, n in zip(h, times) if a in m.terms)
        p = [1.0, *(1 / (1 + np.exp(-(z - c))) for c in m.cuts), 0.0]
        grades = [p[k] - p[k + 1] for k in range(4)]
        assert got[i].p_toxic == pytest.approx(p[1], abs=1e-5) and got[i].expected_severity == pytest.approx(sum(k * g for k, g in enumerate(grades)), abs=1e-5)
        assert got[i].severity_grade == int(np.argmax(grades)) or sorted(grades)[-1] - sorted(grades)[-2] < 1e-5
        assert got[i].is_toxic == (p[1] >= m.threshold)


def test_known_terms_are_those_of_the_block():
    arr = pa.array(["Idiots and idiots, idiotically", None, "", "none of it"])
    row, h, times, words = T.term_block(arr)
    terms = np.unique(h)
    r2, t2, n2, w2 = T.known_terms(arr, terms)
    assert sorted(zip(row.tolist(), h.tolist(), times.tolist())) == sorted(zip(r2.tolist(), terms[t2].tolist(), n2.tolist())) and words.tolist() == w2.tolist() == [4, 0, 0, 3]


def test_toxic_rows_are_found(spark):
    r = random.Random(8)
    bad = ["moronik", "trashy", "scumbag"]
    items, labels = [], []
    for i in range(400):
        w = prose(r, 60).split()
        toxic = i % 4 == 0
        for _ in range(r.randrange(1, 8) if toxic else 0):
            w[r.randrange(60)] = r.choice(bad)
        items.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, int(toxic)))
    items += [(900, None), (901, ""), (None, "scumbag moronik trashy " * 3), (902, "!!")]
    d, lab = table(spark, items), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = T.severity(d, lab)
    assert got.count() == len(items)
    by = {x.doc_id: x for x in got.collect()}
    assert all(by[i].is_toxic == (i % 4 == 0) for i in range(300, 400)) and by[None].is_toxic
    assert all(not by[i].is_toxic and by[i].expected_severity == 0 for i in (900, 901, 902))
    few, many = [[by[i].expected_severity for i in range(0, 400, 4) if lo <= sum(items[i][1].count(b) for b in bad) <= hi] for lo, hi in ((1, 2), (5, 9))]
    assert np.mean(many) > np.mean(few) + 0.5
    assert not T.severity(d, lab.where("false")).where("is_toxic").count() and T.severity(d.where("false"), lab).count() == 0


def test_toxicity_of_the_driver_table(sf):
    docs, labels = sf
    got = {r.doc_id: r.is_toxic for r in T.severity(docs, labels).collect()}
    lab = labels.collect()
    assert np.mean([got[r.doc_id] for r in lab if r.toxic == 0]) <= 0.01 and np.mean([got[r.doc_id] for r in lab if r.toxic == 1]) >= 0.7
