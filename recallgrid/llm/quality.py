"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over the bytes of a block of texts; the trees are grown on the driver over
a bounded sample of labelled rows and flattened into arrays, which a block of rows walks level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm._arrow import IS_DIGIT, IS_HIGH, IS_LOWER, IS_SPACE, IS_UPPER, Words, bounded_sample, fresh, row_slices, utf8_parts

_CODE = np.arange(256)
_CLASSES = {
    "upper": IS_UPPER, "lower": IS_LOWER, "digit": IS_DIGIT, "space": IS_SPACE, "high": IS_HIGH, "newline": _CODE == 10, "stop": np.isin(_CODE, [46, 44]),
    "bang": _CODE == 33, "bar": _CODE == 124, "mark": np.isin(_CODE, [ord(c) for c in "*$%#&~^=+<>_\\@"]), "bracket": np.isin(_CODE, [ord(c) for c in "()[]{}"]), "quote": np.isin(_CODE, [34, 39, 96]),
}
FEATURES = ["log_bytes", *(f"{c}_share" for c in _CLASSES), "word_mean", "short_words", "long_words", "distinct_words", "top_word", "word_repeat", "line_mean", "distinct_lines", "end_share"]
SAMPLE_ROWS = 20_000


def statistics_block(arr: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all zero for a null or empty one."""
    raw, off = utf8_parts(arr)
    n, size = len(arr), np.diff(off)
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not len(raw):
        return out
    safe = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return total[off[1:]] - total[off[:-1]]

    for j, lut in enumerate(_CLASSES.values(), 1):
        out[:, j] = per_text(lut[raw]) / safe
    at = 1 + len(_CLASSES)
    w = Words(arr, space=True)
    count = np.diff(w.doc)
    doc = np.repeat(np.arange(n), count)
    length = np.diff(w.off)
    some = np.maximum(count, 1)
    out[:, at] = np.bincount(doc, length, n) / some
    out[:, at + 1] = np.bincount(doc, length <= 2, n) / some
    out[:, at + 2] = np.bincount(doc, length >= 16, n) / some
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    if len(d):
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        times = np.diff(np.append(new, len(d)))
        out[:, at + 3] = np.bincount(d[new], minlength=n) / some
        top = np.zeros(n)
        np.maximum.at(top, d[new], times)
        out[:, at + 4] = top / some
        again = np.concatenate((w.hash[1:] == w.hash[:-1], [False])) & np.concatenate((doc[1:] == doc[:-1], [False]))
        out[:, at + 5] = np.bincount(doc, again, n) / some
        # lines: a hash of the words between line breaks
        brk = np.concatenate(([0], np.cumsum(raw == 10)))
        line = brk[w.raw_start] + doc
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        lh = np.add.reduceat(w.hash * (2 * place.astype(np.uint64) + np.uint64(1)), first)
        ld = doc[first]
        lines = np.maximum(np.bincount(ld, minlength=n), 1)
        lo = np.lexsort((lh, ld))
        ln = np.concatenate(([True], (lh[lo][1:] != lh[lo][:-1]) | (ld[lo][1:] != ld[lo][:-1])))
        out[:, at + 6] = np.log1p(size / lines)
        out[:, at + 7] = np.bincount(ld[lo][ln], minlength=n) / lines
        ends = raw[w.raw_end - 1]
        out[:, at + 8] = np.bincount(doc, (ends == 46) | (ends == 44), n) / some
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right if the value is greater
    leaf: np.ndarray  # trees x leaves
    base: float
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.leaf[trees, node - (2**depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are found on histograms of quantile bins."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) if n else np.zeros(0, np.float32) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, f), np.int64)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    m = np.full(n, base)
    flat = code + np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (f * bins) + flat).ravel()
            hg = np.bincount(key, np.repeat(g, f), width * f * bins).reshape(width, f, bins)
            hh = np.bincount(key, np.repeat(h, f), width * f * bins).reshape(width, f, bins)
            gl, hl = hg.cumsum(2)[:, :, :-1], hh.cumsum(2)[:, :, :-1]
            gt, ht = hg.sum(2)[:, :, None], hh.sum(2)[:, :, None]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least / 10) | (ht - hl < least / 10)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins - 1)
                if gain[i, j, b] > 1e-9:
                    feature[t, first + i], cut[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        m += leaf[t][at]
    return Trees(feature, cut, leaf, base)


def _with_statistics(docs: DataFrame, text: str, out: str) -> DataFrame:
    @F.arrow_udf("array<float>")
    def stats(arr: pa.Array) -> pa.Array:
        x = np.concatenate([statistics_block(arr.slice(i, j - i)) for i, j in row_slices(arr)]) if len(arr) else np.zeros((0, len(FEATURES)), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    return docs.withColumn(out, stats(F.col(text).cast("string")))


def labelled_features(docs: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample_rows`` labelled documents, in the order of their ids."""
    want = bounded_sample(labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).select(F.col(id_col).cast("bigint").alias("lab_id"), F.col(target).cast("double").alias("lab_y")).distinct(), "lab_id", sample_rows)
    have = docs.select(F.col(id_col).cast("bigint").alias("lab_id"), F.col(text_col).cast("string").alias("lab_text")).where("lab_text is not null and lab_text <> ''")
    rows = _with_statistics(have.join(F.broadcast(want), "lab_id"), "lab_text", "x").select("lab_id", "lab_y", "x").orderBy("lab_id", "lab_y", "x").toPandas()  # want has sample_rows rows at most
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    return x, rows["lab_y"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keep_recall: float = 0.998) -> Trees:
    """Trees fitted on four of five labelled rows; on the fifth, the threshold (0.5 at most) is set so that at least
    ``keep_recall`` of the good rows are kept. Without labelled rows every score is 0.5 and all is kept."""
    x, y = labelled_features(docs, labels, "quality", id_col, text_col, sample_rows)
    held = np.arange(len(y)) % 5 == 4
    model = grow(x[~held], y[~held])
    good = np.sort(model.score(x[held & (y > 0.5)]))
    limit = min(0.5, float(good[int((1 - keep_recall) * len(good))])) if len(good) else 0.5
    return Trees(model.feature, model.cut, model.leaf, model.base, limit)


def with_score(docs: DataFrame, model: Trees, text_col: str, out: str) -> DataFrame:
    """``docs`` with a column ``out``: the probability that the text is good; 0 for a null or empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, whatever the corpus

    @F.arrow_udf("double")
    def score(arr: pa.Array) -> pa.Array:
        parts = [np.where(np.diff(utf8_parts(arr.slice(i, j - i))[1]) > 0, shared.value.score(statistics_block(arr.slice(i, j - i))), 0.0) for i, j in row_slices(arr)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, score(F.col(text_col).cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, quality_score, is_kept) of every row; null and empty texts score 0 and aren't kept. Rows that repeat are
    scored each, texts of any length whole; an empty table gives no row, and without labels every score is 0.5."""
    model = train(docs, labels, id_col, text_col, **how)
    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(one, model, "text", "quality_score").select("doc_id", "quality_score", (F.col("quality_score") >= model.threshold).alias("is_kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that quality_scores keeps: null and empty texts go, of rows that repeat all stay or
    none. An empty table stays empty."""
    model = train(docs, labels, id_col, text_col, **how)
    (s,) = fresh(docs.columns, "quality_score")
    return with_score(docs, model, text_col, s).where(F.col(s) >= model.threshold).drop(s)
