import numpy as np
import pytest

import corpus_pipeline as CP
from recallgrid.llm import jpeg as J
from recallgrid.llm import mtree as M
from recallgrid.llm import queries
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"


# ---- media ----


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_round_trip(sampling, restart):
    r = np.random.default_rng(len(sampling) * 7 + restart)
    for _ in range(4):
        w, h = (int(v) for v in r.integers(1, 80, 2))
        hm, vm = max(a for a, _ in sampling), max(b for _, b in sampling)
        mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
        planes = [r.integers(0, 256, (mh * v * 8, mw * x * 8)).astype(float) for x, v in sampling]
        quant = int(r.integers(1, 32))
        got = J.luminance_dc(J.encode(planes, sampling, w, h, quant, restart))
        p = planes[0]
        mean = p.reshape(p.shape[0] // 8, 8, -1, 8).mean((1, 3))
        assert got[:3] == (w, h, len(sampling)) and got[3].shape == (-(-h * sampling[0][1] // (8 * vm)), -(-w * sampling[0][0] // (8 * hm)))
        assert np.abs(mean[: got[3].shape[0], : got[3].shape[1]] - got[3]).max() <= quant / 16 + 0.51


def test_broken_bytes_have_a_status():
    good = J.page_picture(b"some page" * 40)
    assert J.describe(good)[0] == "ok" and J.describe(None)[0] == "null" and J.describe(b"")[0] == "not_jpeg" and J.describe(b"GIF89a..")[0] == "not_jpeg"
    assert J.describe(good[: len(good) // 2])[:3] == ("corrupt", *J.describe(good)[1:3]) and J.describe(good.replace(b"\xff\xc0", b"\xff\xc2", 1))[0] == "unsupported"
    r = np.random.default_rng(1)
    for _ in range(300):
        b = bytearray(good)
        b[int(r.integers(2, len(b)))] = int(r.integers(0, 256))
        assert J.describe(bytes(b))[0] in ("ok", "corrupt", "unsupported", "not_jpeg")


def test_a_scan_for_each_component():
    r = np.random.default_rng(9)
    w, h = 45, 37
    y, u = r.integers(0, 256, (48, 48)).astype(float), r.integers(0, 256, (24, 24)).astype(float)
    body = lambda b: b[b.index(b"\xff\xda") :]
    one = [J.encode([p], [(1, 1)], a, b, 5) for p, a, b in ((y[:40, :48], w, h), (u, 23, 19), (u[::-1], 23, 19))]
    both = J.encode([np.pad(y, ((0, 0), (0, 0))), u, u[::-1]], [(2, 2), (1, 1), (1, 1)], w, h, 5)
    head = both[: both.index(b"\xff\xda")]
    scans = [body(b)[:-2].replace(b"\xff\xda\x00\x08\x01\x01", b"\xff\xda\x00\x08\x01" + bytes([i + 1]), 1) for i, b in enumerate(one)]
    got, want = J.luminance_dc(head + scans[1] + scans[0] + scans[2] + b"\xff\xd9"), J.luminance_dc(both)
    assert got[:3] == want[:3] == (w, h, 3) and (got[3] == want[3]).all()


@pytest.mark.parametrize(("width", "height", "quality"), [(64, 48, 0.9), (133, 71, 0.5), (9, 200, 0.75), (8, 8, 0.95)])
def test_pictures_of_another_writer(spark, width, height, quality):
    """Files written and read by the JDK's own JPEG codec."""
    jvm = spark._jvm
    io = jvm.javax.imageio
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    yy, xx = np.mgrid[:height, :width]
    rgb = np.stack([128 + 100 * np.sin(xx / 13), 128 + 90 * np.cos(yy / 9), (xx * 3 + yy * 5) % 256], -1).astype(int)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, int(rgb[y, x, 0] << 16 | rgb[y, x, 1] << 8 | rgb[y, x, 2]))

    def written(progressive):
        writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
        how = writer.getDefaultWriteParam()
        how.setCompressionMode(2)
        how.setCompressionQuality(quality)
        how.setProgressiveMode(1 if progressive else 0)
        out = jvm.java.io.ByteArrayOutputStream()
        stream = io.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, io.IIOImage(image, None, None), how)
        stream.flush()
        return bytes(out.toByteArray())

    data = written(False)
    back = io.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    seen = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(width)] for y in range(height)])
    luma = 0.299 * (seen >> 16) + 0.587 * (seen >> 8 & 255) + 0.114 * (seen & 255)
    w, h, n, pix = J.luminance_dc(data)
    assert (w, h, n) == (width, height, 3) and pix.shape == (-(-height // 8), -(-width // 8))
    whole = luma[: height // 8 * 8, : width // 8 * 8].reshape(height // 8, 8, width // 8, 8).mean((1, 3))
    assert np.abs(pix[: height // 8, : width // 8] - whole).max() <= 3 and np.abs(pix[: height // 8, : width // 8] - whole).mean() < 1
    assert J.describe(written(True))[:4] == ("unsupported", width, height, 3)


def test_long_scans_cross_chunks(monkeypatch):
    p = np.random.default_rng(2).integers(0, 256, (96, 96)).astype(float)
    data = J.encode([p], [(1, 1)], 96, 96, 1)
    want = J.luminance_dc(data)[3]
    monkeypatch.setattr(J, "CHUNK", 64)
    assert (J.luminance_dc(data)[3] == want).all()


def test_hash_of_gradients():
    up = np.tile(np.arange(9, dtype=np.uint8) * 20, (8, 1))
    assert J.dhash(up) == -1 and J.dhash(up[:, ::-1]) == 0 and J.dhash(np.zeros((1, 1), np.uint8)) == 0


def test_media_columns(spark):
    pages = spark.createDataFrame([(1, "<html>a</html>", "x"), (2, None, "y"), (3, "", "z"), (1, "<html>a</html>", "x")], "page_id bigint, html string, status string")
    got = J.media_columns(J.with_picture(pages), "media", "page_id").orderBy("page_id").collect()
    assert [r.status for r in got] == ["ok", "ok", "null", "ok"] and got[0] == got[1] and got[0].width in (24, 32, 40, 48, 56)
    assert J.media_columns(J.with_picture(pages.where("false")), "media", "page_id").count() == 0


# ---- exact search ----


def nearest_by_hand(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = set()
    for i, a in enumerate(ids):
        best = sorted((round(float(d[i, j]), 9), b) for j, b in enumerate(ids) if b != a)[:k]
        out |= {(a, r + 1, b, round(v, 6)) for r, (v, b) in enumerate(best)}
    return out


def test_tree_bounds_and_pruning():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 3)) + 12 * r.integers(0, 5, (3000, 1))
    t = M.MTree(np.arange(3000), x, page=32, fan=4)

    def below(i):
        return np.arange(t.first[i], t.end[i]) if i < t.pages else np.concatenate([below(c) for c in range(t.first[i], t.end[i])])

    assert len(t.radius) > t.pages + 20 and sorted(np.concatenate([below(i) for i in t.roots])) == list(range(3000))
    for i in range(len(t.radius)):
        d = np.sqrt(((t.x[below(i)] - t.x[t.route[i]]) ** 2).sum(1))
        assert d.max() == pytest.approx(t.radius[i])
        if i < t.pages:
            assert len(d) <= 32 and np.allclose(d, t.to_page[below(i)])
        else:
            c = np.arange(t.first[i], t.end[i])
            assert np.allclose(np.sqrt(((t.x[t.route[c]] - t.x[t.route[i]]) ** 2).sum(1)), t.to_parent[c])
    d, at, cost = t.search(x[:200], np.arange(200), 5, np.full(200, np.inf))
    full = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(-1))
    full[np.arange(200), np.arange(200)] = np.inf
    assert np.allclose(np.sort(full, 1)[:, :5], d, atol=1e-9) and cost < 0.1 * 200 * 3000


@pytest.mark.parametrize("page", [4, 16, 256])
def test_random_ties_against_brute_force(page):
    r = np.random.default_rng(11)
    for _ in range(100):
        n = int(r.integers(1, 300))
        x, ids = r.integers(0, 2, (n, 4)).astype(float), r.permutation(n) + 5
        who = r.integers(0, n, 15)
        t = M.MTree(ids, x, page=page, fan=3)
        d, at, _ = t.search(x[who], ids[who], 10, np.full(15, np.inf))
        for w, dd, aa in zip(who, d, at):
            want = sorted((round(float(np.linalg.norm(x[w] - x[j])), 9), int(ids[j])) for j in range(n) if j != w)[:10]
            assert [(round(float(v), 9), int(t.ids[a])) for v, a in zip(dd, aa) if a >= 0] == want


def test_many_ties_in_a_page():
    r = np.random.default_rng(7)
    for near in (0, 3, 8):
        x = np.concatenate((np.full((50, 3), 2.0), r.normal(size=(near, 3)) * 0.1, np.zeros((1, 3))))
        ids = r.permutation(len(x)) + 100
        t = M.MTree(ids, x)
        assert len(t.radius) == 1
        d, at, _ = t.search(x, ids, 10, np.full(len(x), np.inf))
        got = {(int(ids[i]), c + 1, int(t.ids[at[i, c]]), round(float(d[i, c]), 6)) for i in range(len(x)) for c in range(10)}
        assert got == nearest_by_hand(ids.tolist(), x, 10)


def test_nearest_with_odd_rows(spark):
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(90, 4)), 1)
    x[10:20] = x[0]
    data = [(i, v.tolist(), "a", 1.0) for i, v in enumerate(x)]
    odd = [(200, None, "a", 1.0), (201, [], "a", 1.0), (202, [1.0, 2.0], "a", 1.0), (203, [1.0, None, 2.0, 3.0], "a", 1.0), (204, [float("nan")] * 4, "a", 1.0), (None, [1.0] * 4, "a", 1.0), data[5]]
    d = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>, g string, tau double")
    want = nearest_by_hand(list(range(90)), x, 6)
    assert {tuple(q) for q in M.nearest(d, k=6, every=1, shard_rows=20, block_rows=7).collect()} == want
    assert {tuple(q) for q in M.nearest(d, k=6, every=5, shard_rows=20, block_rows=7).collect()} == {w for w in want if w[0] % 5 == 0}
    assert M.nearest(d.where("false")).count() == 0
    assert M.nearest(d.where("vec_id < 3"), k=6, every=1).count() == 6
    assert M.nearest(d.where("vec_id in (1, 2)")).count() == 0


def test_a_vector_that_most_rows_share(spark):
    r = np.random.default_rng(8)
    x = np.concatenate((np.full((400, 3), 1.0), r.normal(size=(60, 3))))
    d = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, s string")
    got = {tuple(q) for q in M.nearest(d, k=6, every=20, shard_rows=16, block_rows=5).collect()}
    assert got == {w for w in nearest_by_hand(list(range(460)), np.asarray(x, np.float32).astype(float), 6) if w[0] % 20 == 0}


# ---- registered queries and the pipeline ----


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck(SF).execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01" if name.startswith("op3_") else SF).count() > 0  # the least size has no secret


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in CP.STAGES:
        was, docs = docs, stage(spark, docs, SF)
        if name != CP.STAGES[-1][0]:
            assert docs.columns == was.columns
            docs = docs.checkpoint()
            seen[name] = docs.toPandas()
    assert [n for n, _ in CP.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(seen["quality"].doc_id)
    assert np.mean([i in kept for i in labels[labels == 1].index]) >= 0.99
    assert not seen["near_duplicates"].text.duplicated().any()
    assert set(seen["secrets"].doc_id) == set(seen["near_duplicates"].doc_id) == set(seen["mixing"].doc_id)
    assert seen["mixing"].groupby("doc_id").size().max() <= 2
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(seen["mixing"].doc_id) and (packed.bin_offset + packed.piece_tokens).max() <= 2048
    assert rows(CP.run(spark, SF).toPandas()) == rows(packed)


def test_stages_with_nothing_and_with_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"
    odd = spark.createDataFrame([(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, 1.0), (3, "Quiet hills and rivers walk with the light over stones.", None, None, 55, 1.0), (3, "Quiet hills and rivers walk with the light over stones.", None, None, 55, 1.0), (None, "Another calm text of the same kind, about the sea.", "en", "s", 49, None), (4, "word " * 30000, "en", "s", 150000, 1.0)], schema)
    for d in (odd, odd.where("false")):
        for name, stage in CP.STAGES:
            out = stage(spark, d, SF)
            assert (out.columns == d.columns) == (name != "packing")
            assert out.count() > 0 or d is not odd
