"""SimHash near-duplicates: Gray-order hierarchical index over 64-bit fingerprints.

Every text gets two fingerprints: ``fp`` over its distinct words and ``fp2`` over its distinct word pairs. Two texts are
near duplicates when ``fp`` differs in at most ``radius`` bits and both together in at most ``total``: word pairs tell
short texts apart that merely use the same common words.

Equal (fp, fp2) are folded first, so that thousands of copies are one entry. Entries are sent to buckets by masked
patterns of ``fp`` (one table per random mask); in each bucket they are sorted by Gray rank, cut into leaves whose common
masked bits make a node, leaves into upper nodes; a query carries the differences counted so far, and a node whose
accumulated differences exceed the radius is dropped with all below it. The bits per mask grow with the logarithm of
the number of entries and the number of tables follows from the wanted recall, so that buckets stay small at any size.

A pair that agrees on several masks counts in the first of them only, so pairs are never gathered to be made distinct:
a task returns one row per entry that has a link there, with the number of its links and an entry that its links lead to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._arrow import Words, fresh, mix64, partitions, row_slices, shared_dir
from recallgrid.operators.components import components

RADIUS, TOTAL = 12, 23
LEAF, FAN = 16, 8
PART_ROWS = 2_000_000  # of all tables that a task matches, about
U = np.uint64


def _bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of groups of hashes; ``first`` is where each (non-empty) group begins."""
    out = np.zeros(len(first), U)
    size = np.diff(np.append(first, len(hashes)))
    step = 1 << 17
    g = 0
    while g < len(first):  # whole groups of about step hashes
        e = max(g + 1, int(np.searchsorted(first, first[g] + step)))
        lo, hi = first[g], first[e] if e < len(first) else len(hashes)
        ones = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(ones, first[g:e] - lo, axis=0, dtype=np.int32)
        out[g:e] = np.packbits(2 * ones > size[g:e, None], axis=1, bitorder="little").view("<u8").ravel()
        g = e
    return out


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def fingerprint_block(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fp, fp2 and whether the text has any word."""
    w = Words(arr, space=False)
    n = len(arr)
    doc = np.repeat(np.arange(n), np.diff(w.doc))
    fp, fp2, any_word = np.zeros(n, U), np.zeros(n, U), np.diff(w.doc) > 0
    if len(doc):
        same = doc[1:] == doc[:-1]
        pair = mix64(w.hash[:-1] * U(0x9E3779B97F4A7C15) + w.hash[1:])[same]
        for out, (d, h) in ((fp, _distinct(doc, w.hash)), (fp2, _distinct(doc[1:][same], pair))):
            if len(d):
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                out[d[first]] = _bits(h, first)
    return fp, fp2, any_word


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, fp2) of every row; fp and fp2 are null where the text is null or has no letter and no digit."""
    schema = "doc_id bigint, text_hash bigint, fp bigint, fp2 bigint"

    def run(batches):
        for b in batches:
            text = b.column(2)
            for i, j in row_slices(text):
                fp, fp2, ok = fingerprint_block(text.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(fp.view(np.int64), mask=~ok), pa.array(fp2.view(np.int64), mask=~ok)], names=["doc_id", "text_hash", "fp", "fp2"]
                )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order (Gray code to binary)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(s)
    return x


def masks(bits: int, tables: int) -> np.ndarray:
    """Masks dealt from shuffled bits: those of one deal are disjoint, so that all bits are asked about equally often."""
    rng, each, out = np.random.default_rng(20240), 64 // bits, []
    while len(out) < tables:
        deal = rng.permutation(64)[: each * bits].reshape(each, bits).astype(U)
        out += np.bitwise_or.reduce(U(1) << deal, axis=1).tolist()
    return np.array(out[:tables], U)


def table_plan(entries: int, design: int = RADIUS, recall: float = 0.9) -> tuple[int, int]:
    """Bits per mask and number of tables for that many entries: buckets of about 64, and ``recall`` at ``design`` bits
    apart (nearer pairs are found more surely). A mask holds distinct bits, so it misses all that differ with the chance
    C(64 - design, bits) / C(64, bits)."""
    bits = min(32, max(12, math.ceil(math.log2(max(entries, 1) / 64 + 1))))
    p = math.comb(64 - design, bits) / math.comb(64, bits)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _nodes(fp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of the bits that all of each group share."""
    both, either = np.bitwise_and.reduceat(fp, first), np.bitwise_or.reduceat(fp, first)
    return both, ~(both ^ either)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each range repeated by its size, and the numbers in the ranges."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def bucket_pairs(bucket: np.ndarray, fp: np.ndarray, fp2: np.ndarray, radius: int, total: int, chunk: int = 1 << 21):
    """Blocks of pairs (i, j) of row numbers, i and j in one bucket and within both bounds, by the hierarchical index."""
    order = np.lexsort((gray_rank(fp), bucket))
    b, x, y = bucket[order], fp[order], fp2[order]
    n = len(b)
    if n < 2:
        return
    seg = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    seg_of = np.repeat(np.arange(len(seg)), np.diff(np.append(seg, n)))
    within = np.arange(n) - seg[seg_of]
    leaf = np.flatnonzero(within % LEAF == 0)
    leaf_end = np.append(leaf[1:], n)
    leaf_pat, leaf_mask = _nodes(x, leaf)
    upper = np.flatnonzero((within[leaf] // LEAF) % FAN == 0)  # as leaf numbers
    upper_end = np.append(upper[1:], len(leaf))
    up_pat, up_mask = _nodes(x, leaf[upper])
    up_seg = seg_of[leaf[upper]]
    seg_up_end = np.searchsorted(up_seg, np.arange(len(seg)), side="right")
    up_of_leaf = np.repeat(np.arange(len(upper)), upper_end - upper)
    up_of_row = np.repeat(up_of_leaf, leaf_end - leaf)
    at = 0
    fan = seg_up_end[seg_of] - up_of_row  # a row asks its own node and those after it: every pair once
    cum = np.concatenate(([0], np.cumsum(fan)))
    while at < n:
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + chunk // (FAN * 2), side="right")) - 1)
        rows = np.arange(at, min(to, n))
        at = int(rows[-1]) + 1
        o, node = _spread(up_of_row[rows], seg_up_end[seg_of[rows]])
        q = rows[o]
        acc = np.bitwise_count((x[q] ^ up_pat[node]) & up_mask[node])
        ok = acc <= radius
        q, node, acc = q[ok], node[ok], acc[ok]
        o, lf = _spread(upper[node], upper_end[node])
        q, acc, node = q[o], acc[o], node[o]
        acc = acc + np.bitwise_count((x[q] ^ leaf_pat[lf]) & leaf_mask[lf] & ~up_mask[node])
        ok = (acc <= radius) & (leaf_end[lf] - 1 > q)
        q, lf, acc = q[ok], lf[ok], acc[ok]
        o, row = _spread(np.maximum(leaf[lf], q + 1), leaf_end[lf])
        q, acc, lf = q[o], acc[o], lf[o]
        acc = acc + np.bitwise_count((x[q] ^ x[row]) & ~leaf_mask[lf])
        hit = acc <= radius
        hit[hit] = acc[hit] + np.bitwise_count(y[q[hit]] ^ y[row[hit]]) <= total
        if hit.any():
            yield order[q[hit]], order[row[hit]]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (the least member of each one's component) after the pairs (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _matched(entries: DataFrame, count: int, radius: int, total: int, recall: float, result, schema: str) -> DataFrame:
    """``result`` (the entries of a task: their numbers, blocks of pairs of rows) over all tables; a pair comes once."""
    bits, tables = table_plan(count, radius, recall)
    ms = masks(bits, tables)
    parts = max(partitions(entries.sparkSession), -(-count * tables // PART_ROWS))

    def send(batches):
        for b in batches:
            rep, fp, fp2 = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            u = fp.view(U)
            for t, m in enumerate(ms):
                key = mix64((u & m) + U((t * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
                part = (key >> U(33)) % U(parts)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(u), t, np.int16)), b.column(0), b.column(1), b.column(2)], names=["part", "key", "t", "rep", "fp", "fp2"])

    def match(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, first, rep, fp, fp2 = (t.column(k).to_numpy() for k in ("key", "t", "rep", "fp", "fp2"))
        fp, fp2 = fp.view(U), fp2.view(U)

        def pairs():
            for i, j in bucket_pairs(key, fp, fp2, radius, total):
                x, t = fp[i] ^ fp[j], first[i]
                new = np.ones(len(i), bool)
                for s in range(int(t.max())):  # does an earlier mask have the pair?
                    new &= (x & ms[s] != 0) | (t <= s)
                if new.any():
                    yield i[new], j[new]

        yield from result(rep, pairs())

    sent = entries.select("rep", "fp", "fp2").mapInArrow(send, "part int, key bigint, t smallint, rep bigint, fp bigint, fp2 bigint")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(match, schema)


def near_pairs(entries: DataFrame, count: int, radius: int = RADIUS, total: int = TOTAL, recall: float = 0.9) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``entries`` (rep, fp, fp2) within both bounds."""

    def result(rep, pairs):
        for i, j in pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])

    return _matched(entries, count, radius, total, recall, result, "a bigint, b bigint")


def near_links(entries: DataFrame, count: int, radius: int = RADIUS, total: int = TOTAL, recall: float = 0.9) -> DataFrame:
    """(rep, to, links): of each entry, task by task, its number of links there and the least entry that they lead to."""

    def result(rep, pairs):
        known, of = np.unique(rep, return_inverse=True)
        label, links = np.arange(len(known)), np.zeros(len(known), np.int64)
        for i, j in pairs:
            i, j = of[i], of[j]
            links += np.bincount(i, minlength=len(known)) + np.bincount(j, minlength=len(known))
            label = join_labels(label, i, j)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(known[some]), pa.array(known[label[some]]), pa.array(links[some])], names=["rep", "to", "links"])

    return _matched(entries, count, radius, total, recall, result, "rep bigint, to bigint, links bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int, total: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp, fp2), written once, and classes of equal fingerprints (fp, fp2, head, links, copies),
    head being the least (no doc_id, doc_id, fp, fp2) of the class's group."""
    shared_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    some = rows.where("fp is not null").groupBy("fp", "fp2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), F.count("*").alias("copies"))
    entries = some.select(F.monotonically_increasing_id().alias("rep"), "fp", "fp2", "least", "copies").checkpoint()
    found = near_links(entries, entries.count(), radius, total, recall).checkpoint()
    roots = components(found.where("rep <> to").select(F.col("to").alias("a"), F.col("rep").alias("b")).distinct())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = entries.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left").select("fp", "fp2", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.struct("least.none", "least.doc_id", "fp", "fp2").alias("own"))
    heads = named.groupBy("root").agg(F.min("own").alias("head"))
    return rows, named.join(heads, "root").select("fp", "fp2", "head", "links", "copies")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, total: int = TOTAL, recall: float = 0.9) -> DataFrame:
    """(doc_id, group_id, is_kept, links, copies): one row for every distinct pair of doc_id and fingerprints.

    ``copies`` counts the rows of equal fingerprints (this one among them), ``links`` the other fingerprints within both
    bounds. group_id is the least doc_id of the group (null last), and one row of that doc_id is the kept one. A text that
    is null, empty or without letters and digits is a group of its own, one row for each doc_id. Rows that repeat a doc_id
    with the same fingerprints are one row here; with others, they are compared as rows of their own. Texts are read
    whole, whatever their length; an empty table gives no row.
    """
    rows, classes = _classes(docs, id_col, text_col, radius, total, recall)
    head = F.col("head")
    out = rows.where("fp is not null").groupBy("doc_id", "fp", "fp2").agg(F.lit(1)).join(classes, ["fp", "fp2"])
    kept = F.col("doc_id").eqNullSafe(head["doc_id"]) & (F.col("fp") == head["fp"]) & (F.col("fp2") == head["fp2"])
    bare = rows.where("fp is null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    return out.select("doc_id", head["doc_id"].alias("group_id"), kept.alias("is_kept"), "links", "copies").unionByName(
        bare.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("is_kept"), F.lit(0).cast("bigint").alias("links"), "copies")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, total: int = TOTAL, recall: float = 0.9) -> DataFrame:
    """``docs``, all columns, one row of each group: of those with the group's least doc_id (null last) and that class's
    fingerprints, the one of the least text hash. Texts that are null, empty or without letters and digits all stay, but
    for rows that repeat both doc_id and text; of these one stays in any case, the least by a hash of all its columns.

    What stays is decided on ids and hashes; the texts are moved once, to meet the decision. An empty table stays empty.
    """
    rows, classes = _classes(docs, id_col, text_col, radius, total, recall)
    per = rows.groupBy("doc_id", "text_hash", "fp", "fp2").agg(F.count("*").alias("times"))
    heads = classes.select("head").distinct().select(*[F.col(f"head.{c}").alias(f"head_{c}") for c in ("doc_id", "fp", "fp2")])
    first = per.join(heads, F.col("doc_id").eqNullSafe(F.col("head_doc_id")) & (F.col("fp") == F.col("head_fp")) & (F.col("fp2") == F.col("head_fp2")))
    first = first.groupBy("doc_id", "fp", "fp2").agg(F.min(F.struct("text_hash", "times")).alias("m")).select("doc_id", "m.text_hash", "m.times")
    stay = first.unionByName(per.where("fp is null").select("doc_id", "text_hash", "times"))
    i, h, t, rn, sid, sh = fresh(docs.columns, "row_id", "row_hash", "row_times", "row_no", "stay_id", "stay_hash")
    stay = stay.select(F.col("doc_id").alias(sid), F.col("text_hash").alias(sh), F.col("times").alias(t)).checkpoint()
    keyed = docs.withColumns({i: F.col(id_col).cast("bigint"), h: F.xxhash64(F.col(text_col).cast("string"))})
    on = F.col(i).eqNullSafe(F.col(sid)) & (F.col(h) == F.col(sh))
    single = keyed.join(stay.where(F.col(t) == 1), on).select(*docs.columns)
    order = Window.partitionBy(i, h).orderBy(F.xxhash64(*docs.columns))
    many = keyed.join(stay.where(F.col(t) > 1), on).withColumn(rn, F.row_number().over(order)).where(F.col(rn) == 1).select(*docs.columns)
    return single.unionByName(many)
