"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades 0 .. 3.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector for all ordered cuts. Features are words and word beginnings
whose frequency in the labelled sample differs clearly between toxic and other texts; a text is scored by the hashes of
its words alone, block by block. ``labels`` has toxic as 0 or 1, so the grades of toxic training texts are thirds of
their share of marked words (1: least); grade 0 is what isn't toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm._arrow import _BYTE_CODE, Words, bounded_sample, mix64, powers, row_slices, shared_dir

SAMPLE_ROWS, GRADES = 20_000, 3
PREFIXES = (5, 6, 7, 8)
U = np.uint64


def term_block(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text row, hash, times) of the distinct words and word beginnings of a block, and the words of each text."""
    w = Words(arr, space=False)
    n = len(arr)
    count = np.diff(w.doc)
    doc = np.repeat(np.arange(n), count)
    length = np.diff(w.off)
    docs, hashes = [doc], [w.hash]
    for p in PREFIXES:  # the first p bytes of longer words
        long = np.flatnonzero(length > p)
        at = w.off[long][:, None] + np.arange(p)
        h = (_BYTE_CODE[w.data[at]] * powers(p)[None, :]).sum(1, dtype=U) if len(long) else np.zeros(0, U)
        docs.append(doc[long])
        hashes.append(mix64(h + U(p * 0xD1B54A32D192ED03 & (2**64 - 1))))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(d) else np.zeros(0, np.int64)
    return d[new], h[new], np.diff(np.append(new, len(d))), count


def known_terms(arr: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As term_block, but only the sorted ``terms``, as their numbers."""
    w = Words(arr, space=False)
    n = len(arr)
    count = np.diff(w.doc)
    doc = np.repeat(np.arange(n), count)
    length = np.diff(w.off)
    got = []
    if len(terms) and len(doc):
        at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
        hit = terms[at] == w.hash
        got.append(doc[hit] * len(terms) + at[hit])
        for p in PREFIXES:
            long = np.flatnonzero(length > p)
            if not len(long):
                continue
            h = np.zeros(len(long), U)
            pw = powers(p)
            for k in range(p):
                h += _BYTE_CODE[w.data[w.off[long] + k]] * pw[k]
            h = mix64(h + U(p * 0xD1B54A32D192ED03 & (2**64 - 1)))
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            hit = terms[at] == h
            got.append(doc[long[hit]] * len(terms) + at[hit])
    both = np.concatenate(got) if got else np.zeros(0, np.int64)
    key, times = np.unique(both, return_counts=True)
    return key // max(len(terms), 1), key % max(len(terms), 1), times, count


def values(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Feature value of a term: grows with its number and with its share of the text."""
    return np.log1p(times) * np.log1p(400 * times / np.maximum(words, 1)) / 4


@dataclass(frozen=True)
class Ordinal:
    terms: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray  # ascending
    threshold: float = 0.5

    def at_least(self, arr: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES; zero for a text without words."""
        row, term, times, count = known_terms(arr, self.terms)
        z = np.bincount(row, self.weight[term] * values(times, count[row]), len(arr)) if len(row) else np.zeros(len(arr))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))
        p[count == 0] = 0
        return p


def fit_ordinal(row: np.ndarray, term: np.ndarray, x: np.ndarray, grade: np.ndarray, terms: int, steps: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by Adam on the likelihood of the grades; cuts are the first one plus positive gaps."""
    n = len(grade)
    w, c = np.zeros(terms), np.array([1.0] + [0.0] * (GRADES - 1))
    m1, m2 = [np.zeros(terms), np.zeros(GRADES)], [np.zeros(terms), np.zeros(GRADES)]
    for t in range(1, steps + 1):
        cuts = np.concatenate(([c[0]], c[0] + np.cumsum(np.exp(c[1:]))))
        z = np.bincount(row, w[term] * x, n)
        s = 1 / (1 + np.exp(-np.clip(cuts[None, :] - z[:, None], -30, 30)))  # P(grade <= k)
        full = np.concatenate((np.zeros((n, 1)), s, np.ones((n, 1))), 1)
        p = np.maximum(full[np.arange(n), grade + 1] - full[np.arange(n), grade], 1e-9)
        ds = np.concatenate((np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))), 1)
        up, lo = ds[np.arange(n), grade + 1] / p, ds[np.arange(n), grade] / p
        gz = (up - lo) / n  # of minus the log likelihood
        gcut = np.zeros(GRADES + 2)
        np.add.at(gcut, grade + 1, -up / n)
        np.add.at(gcut, grade, lo / n)
        gcut = gcut[1:-1]
        gc = np.concatenate(([gcut.sum()], [gcut[k:].sum() * np.exp(c[k]) for k in range(1, GRADES)]))
        gw = np.bincount(term, gz[row] * x, terms) + l2 * w
        for k, (v, g) in enumerate(((w, gw), (c, gc))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            v -= 0.1 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-9)
    return w, np.concatenate(([c[0]], c[0] + np.cumsum(np.exp(c[1:]))))


NONE = Ordinal(np.zeros(0, U), np.zeros(0), np.arange(1.0, GRADES + 1), 0.5)


def fit(terms: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, words: np.ndarray, toxic: np.ndarray, held: np.ndarray, precision: float = 0.98) -> Ordinal:
    """The model from the known terms (row, term, times) of labelled texts; on the held-out ones the threshold on
    P(grade >= 1) is placed: the least one (0.2 to 0.8) that has ``precision`` there."""
    x = values(times, words[row])
    share = np.bincount(row, times, len(words)) / np.maximum(words, 1)
    grade = np.zeros(len(words), np.int64)
    marked = toxic > 0
    grade[marked] = 1 + np.searchsorted(np.quantile(share[marked], [1 / 3, 2 / 3]), share[marked], side="right")
    use, at = ~held[row], np.cumsum(~held) - 1
    weight, cuts = fit_ordinal(at[row[use]], term[use], x[use], grade[~held], len(terms))
    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weight[term] * x, len(words)) - cuts[0], -40, 40)))
    best = 0.8
    for t in np.arange(0.8, 0.19, -0.02):
        said = held & (p >= t)
        if said.any() and toxic[said].mean() < precision:
            break
        best = float(t)
    return Ordinal(terms, weight, cuts, best)


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, z_least: float = 3.0, docs_least: int = 3) -> Ordinal:
    """The model from at most ``sample_rows`` labelled documents, half of them toxic where there are as many.

    A fifth is held out. Terms are counted where the texts are; the driver gets the terms that tell (z of the log odds
    ``z_least`` at least, in ``docs_least`` toxic texts at least) and, of each text, only those terms.
    """
    lab = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).cast("bigint").alias("lab_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("lab_y")).distinct()
    want = bounded_sample(lab.where("lab_y = 1"), "lab_id", sample_rows // 2).unionByName(bounded_sample(lab.where("lab_y = 0"), "lab_id", sample_rows // 2))
    have = docs.select(F.col(id_col).cast("bigint").alias("lab_id"), F.col(text_col).cast("string").alias("lab_text")).where("lab_text is not null and lab_text <> ''")
    held = (F.pmod(F.xxhash64("lab_id"), F.lit(5)) == 4).cast("int").alias("held")
    shared_dir(docs.sparkSession)
    few = have.join(F.broadcast(want), "lab_id").select("lab_id", "lab_y", held, "lab_text").checkpoint()  # want has sample_rows rows at most; documents are read once for them

    def count(batches):
        for b in batches:
            y = b.column(1).to_numpy()
            for i, j in row_slices(b.column(3)):
                row, h, _, _ = term_block(b.column(3).slice(i, j - i))
                terms, of = np.unique(h, return_inverse=True)
                a = np.bincount(of, y[i:j][row], len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(a), pa.array(np.bincount(of, minlength=len(terms)) - a)], names=["h", "a", "b"])

    fitted = few.where("held = 0")
    sides = {r["lab_y"]: r["count"] for r in fitted.groupBy("lab_y").count().collect()}
    na, nb = sides.get(1, 0), sides.get(0, 0)
    if not na or not nb:
        return NONE
    odds = F.ln((F.col("a") + 0.5) / (F.lit(na) - F.col("a") + 0.5)) - F.ln((F.col("b") + 0.5) / (F.lit(nb) - F.col("b") + 0.5))
    df = fitted.mapInArrow(count, "h bigint, a bigint, b bigint").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= docs_least).withColumn("odds", odds)
    told = df.where((F.col("odds") > 1.5) & (F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)) >= z_least)).select("h").collect()  # bounded by the sample
    terms = np.sort(np.array([r[0] for r in told], np.int64).view(U))
    if not len(terms):
        return NONE

    def known(batches):
        for b in batches:
            for i, j in row_slices(b.column(3)):
                row, term, times, words = known_terms(b.column(3).slice(i, j - i), terms)
                off = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.array(words), pa.ListArray.from_arrays(off, pa.array(term)), pa.ListArray.from_arrays(off, pa.array(times))], names=["lab_id", "lab_y", "held", "words", "term", "times"])

    rows = few.mapInArrow(known, "lab_id bigint, lab_y int, held int, words bigint, term array<bigint>, times array<bigint>").orderBy("lab_id", "lab_y", "words").toPandas()  # sample_rows rows of a few numbers
    size = rows["term"].map(len).to_numpy()
    flat = [np.concatenate(rows[c].tolist()).astype(np.int64) if size.sum() else np.zeros(0, np.int64) for c in ("term", "times")]
    return fit(terms, np.repeat(np.arange(len(rows)), size), *flat, rows["words"].to_numpy(), rows["lab_y"].to_numpy(), rows["held"].to_numpy() > 0)


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, p_toxic, expected_severity, severity_grade, is_toxic) of every row.

    expected_severity is the mean grade, 0 to 3; severity_grade the most likely one; is_toxic whether P(grade >= 1)
    reaches the calibrated threshold. Texts without a word (null, empty) have grade 0. Without labels nothing is toxic.
    Rows that repeat are graded each, texts of any length whole; an empty table gives no row.
    """
    model = train_on(docs, labels, id_col, text_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB, bounded by the sample

    def run(batches):
        m = shared.value
        for b in batches:
            for i, j in row_slices(b.column(1)):
                p = m.at_least(b.column(1).slice(i, j - i))
                mass = np.concatenate((1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]), 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.round(p[:, 0], 6)), pa.array(np.round(p.sum(1), 6)), pa.array(mass.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= m.threshold)],
                    names=["doc_id", "p_toxic", "expected_severity", "severity_grade", "is_toxic"],
                )

    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id bigint, p_toxic double, expected_severity double, severity_grade int, is_toxic boolean")
