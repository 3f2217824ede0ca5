"""Substring dedup by super-k-mers: windows of k words that several documents share, counted exactly.

Windows that follow each other and share a minimiser (the same m words at the same place) travel to the minimiser's
bucket as one packed string, so that a window costs far less than k words of shuffle; the strings that one task sends
to one bucket share one compressed blob. Equal strings of a block are folded into one with its first and last document
and its number, and a bucket folds them again as they stream in, so that a passage which a third of all documents have
is one string there. Equal windows have equal minimisers, so a bucket sees all copies of its windows; there they are
sorted and runs of equal windows are counted, word by word, with no hash in the comparison. A bucket returns the runs of
each string; a second pass over the documents gives every occurrence of a string, by 128 bits of hash, its runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._arrow import Words, mix64, partitions, powers, row_slices, stored_bytes

K, M = 50, 5
U = np.uint64
FLUSH_BYTES = 12 << 20
MOST_PARTITIONS = 100_000
HEAD = np.dtype([("key", "<u8"), ("h1", "<i8"), ("h2", "<i8"), ("low", "<i8"), ("high", "<i8"), ("many", "<i8"), ("windows", "<i4"), ("at", "<i4"), ("size", "<i4")])
_STEPS = (U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F | 1))
_BACK = tuple(U(pow(int(r), -1, 1 << 64)) for r in _STEPS)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row, by doubling."""
    have, step = x, 1
    while step * 2 <= w:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    return np.minimum(have[: len(x) - w + 1], have[w - step : w - step + len(x) - w + 1])


def super_kmers(words: Words, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(doc row, first word in the doc, number of windows, first word's number, minimiser's word, its hash) of every
    super-k-mer; windows never cross documents."""
    n = len(words.hash)
    empty = tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, U),)
    if n < k:
        return empty
    gram = np.zeros(n - m + 1, U)
    for j in range(m):
        gram = gram * U(0x9E3779B97F4A7C15) + words.hash[j : n - m + 1 + j]
    gram = mix64(gram)
    low = U(24)
    if len(gram) < 1 << 24:  # the hash and the place in one number
        least = sliding_min((gram >> low << low) | np.arange(len(gram), dtype=U), k - m + 1)
        pos = (least & U((1 << 24) - 1)).astype(np.int64)
    else:  # the rank of the hash and the place
        rank = np.unique(gram >> low, return_inverse=True)[1].astype(U)
        pos = (sliding_min(rank << U(32) | np.arange(len(gram), dtype=U), k - m + 1) & U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(words.doc) - 1), np.diff(words.doc))
    ok = doc[: n - k + 1] == doc[k - 1 :]
    change = np.ones(len(pos), bool)
    change[1:] = (pos[1:] != pos[:-1]) | ~ok[:-1]
    first = np.flatnonzero(change & ok)
    if not len(first):
        return empty
    stops = np.append(np.flatnonzero(change | ~ok), len(pos))
    count = stops[np.searchsorted(stops, first, side="right")] - first
    d = doc[first]
    return d, first - words.doc[d], count, first, pos[first], gram[pos[first]]


def string_hashes(words: Words, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of words, from sums over all words before."""
    out = []
    for seed, (step, back) in enumerate(zip(_STEPS, _BACK)):
        n = len(words.hash)
        total = np.zeros(n + 1, U)
        np.cumsum(mix64(words.hash + U(seed)) * powers(n, step), out=total[1:])
        out.append(mix64((total[first + length] - total[first]) * powers(n + 1, back)[first] + length.astype(U)).view(np.int64))
    return out[0], out[1]


def _pack(head: list[np.ndarray], body: list[bytes]) -> bytes:
    h = np.concatenate(head)
    raw = np.int64(len(h)).tobytes() + h.tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpack(blob: memoryview) -> tuple[np.ndarray, bytes, int]:
    """Heads, bytes, and where in them the strings begin."""
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, HEAD, n, 8), raw, 8 + n * HEAD.itemsize


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _blocks(batches: Iterator[pa.RecordBatch], k: int, m: int):
    """(words, ids, super-k-mers) of blocks of texts."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in row_slices(batch.column(1)):
            words = Words(batch.column(1).slice(i, j - i), space=True)
            got = super_kmers(words, k, m)
            if len(got[0]):
                yield words, ids[i:j], got


def shuffled_super_kmers(docs: DataFrame, id_col: str, text_col: str, k: int, m: int) -> DataFrame:
    """(bucket, blob): the super-k-mers of all texts; a partition holds whole buckets, one after the other.

    The number of buckets follows from the stored bytes of the texts: a quarter of what a task reads each. Beyond
    MOST_PARTITIONS only buckets are added, so that what a bucket holds stays the same at any size.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    buckets = max(partitions(spark), -(-4 * stored_bytes(texts, "text") // int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))))
    parts = min(buckets, max(MOST_PARTITIONS, partitions(spark)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies, held = {}, {}, 0

        def flush():
            names = sorted(heads)
            step = 256
            for i in range(0, len(names), step):
                some = names[i : i + step]
                blobs = [_pack(heads[b], bodies[b]) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([b % parts for b in some], pa.int32()), pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "bucket", "blob"])
            heads.clear()
            bodies.clear()

        for words, ids, (d, _, windows, first, at, key) in _blocks(batches, k, m):
            h1, h2 = string_hashes(words, first, windows + k - 1)
            doc = ids[d]
            bucket = (mix64(key) % U(buckets)).astype(np.int64)
            order = np.lexsort((h2, h1, bucket))
            new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
            run = np.flatnonzero(new)
            one = order[run]  # one of each string
            text, begin = words.spaced()
            lo, hi = begin[first[one]], begin[first[one] + windows[one] + k - 1] - 1
            h = np.zeros(len(one), HEAD)
            h["key"], h["h1"], h["h2"], h["windows"], h["at"], h["size"] = key[one], h1[one], h2[one], windows[one], (at - first)[one], hi - lo
            h["low"], h["high"], h["many"] = np.minimum.reduceat(doc[order], run), np.maximum.reduceat(doc[order], run), np.diff(np.append(run, len(order)))
            cut = np.flatnonzero(np.diff(bucket[one])) + 1
            for rows in np.split(np.arange(len(one)), cut):
                b = int(bucket[one[rows[0]]])
                heads.setdefault(b, []).append(h[rows])
                bodies.setdefault(b, []).append(b"".join([text[x:y] for x, y in zip(lo[rows].tolist(), hi[rows].tolist())]))
            held += len(text)
            if held > FLUSH_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    sent = texts.mapInArrow(send, "part int, bucket bigint, blob binary").repartitionById(parts, F.col("part"))
    return sent.select("bucket", "blob") if buckets == parts else sent.select("bucket", "blob").sortWithinPartitions("bucket")


class Group:
    """The super-k-mers of one minimiser: distinct strings, with the first and last document that has them and how often
    they occur."""

    __slots__ = ("text", "at", "windows", "low", "high", "many", "hash")

    def __init__(self):
        self.text, self.at, self.windows, self.low, self.high, self.many, self.hash = [], [], [], [], [], [], []


def shared_groups(blobs: Iterator[tuple[int, memoryview]]) -> Iterator[Group]:
    """Groups of super-k-mers of one minimiser that occurs in two documents at least, from (bucket, blob) by bucket."""
    have: dict[bytes, list] = {}
    now = None

    def groups():
        by: dict[int, list] = {}
        for text, e in have.items():
            by.setdefault(e[0], []).append((text, e))
        for found in by.values():
            if min(e[3] for _, e in found) == max(e[4] for _, e in found):
                continue
            g = Group()
            for text, (_, h1, h2, low, high, many, windows, at) in sorted(found):
                g.text.append(text)
                g.at.append(at)
                g.windows.append(windows)
                g.low.append(low)
                g.high.append(high)
                g.many.append(many)
                g.hash.append((h1, h2))
            yield g
        have.clear()

    for bucket, blob in blobs:
        if bucket != now:
            yield from groups()
            now = bucket
        head, raw, at = _unpack(blob)
        for *entry, size in head.tolist():
            text = raw[at : at + size]
            at += size
            old = have.get(text)
            if old is None:
                have[text] = entry
            else:
                old[3], old[4], old[5] = min(old[3], entry[3]), max(old[4], entry[4]), old[5] + entry[5]
    yield from groups()


def windows_shared(g: Group, k: int) -> list[np.ndarray]:
    """For each distinct string, the number of occurrences of each of its windows, 0 where only one document has it:
    windows as word strings, sorted, with runs of equal ones counted."""
    if len(g.text) == 1:
        return [np.full(g.windows[0], g.many[0] if g.low[0] != g.high[0] else 0)]
    out, todo = [np.zeros(w, np.int64) for w in g.windows], []
    for i, t in enumerate(g.text):
        space = [-1, *np.flatnonzero(np.frombuffer(t, np.uint8) == 32).tolist(), len(t)]
        todo += [(g.at[i] - o, t[space[o] + 1 : space[o + k]], i, o) for o in range(g.windows[i])]
    todo.sort()
    a = 0
    while a < len(todo):
        b, (rel, text, _, _) = a + 1, todo[a]
        while b < len(todo) and todo[b][0] == rel and todo[b][1] == text:
            b += 1
        who = [i for _, _, i, _ in todo[a:b]]
        if min(g.low[i] for i in who) != max(g.high[i] for i in who):
            n = sum(g.many[i] for i in who)
            for _, _, i, o in todo[a:b]:
                out[i][o] = n
        a = b
    return out


def runs(g: Group, counts: list[np.ndarray], into: list[list]) -> None:
    """Appends (two hashes, first window, window after the last, copies) of the runs of shared windows of each string."""
    for i, c in enumerate(counts):
        on = np.concatenate(([0], (c > 0).view(np.int8), [0]))
        a, b = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
        if len(a):
            for row in zip([g.hash[i][0]] * len(a), [g.hash[i][1]] * len(a), a.tolist(), b.tolist(), np.maximum.reduceat(c, a).tolist()):
                into.append(row)


def spans(docs: DataFrame, count: Callable[[Iterator[Group], int], Iterator[tuple[Group, list[np.ndarray]]]], id_col: str, text_col: str, k: int, m: int) -> DataFrame:
    """(doc_id, span_start, span_end, copies) of all maximal spans of shared windows; words count from 0, span_end is
    exclusive, copies is the largest number of occurrences of any of its windows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = ((n, memoryview(x.as_buffer())) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1)))
        names, into = ["h1", "h2", "a", "b", "n"], []
        for g, counts in count(shared_groups(blobs), k):
            runs(g, counts, into)
            if len(into) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*into)], names=names)
                into.clear()
        if into:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*into)], names=names)

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, (d, start, windows, first, _, _) in _blocks(batches, k, m):
            h1, h2 = string_hashes(words, first, windows + k - 1)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids[d]), pa.array(start)], names=["h1", "h2", "doc_id", "start"])

    shared = shuffled_super_kmers(docs, id_col, text_col, k, m).mapInArrow(reduce, "h1 bigint, h2 bigint, a bigint, b bigint, n bigint")
    where = _texts(docs, id_col, text_col).mapInArrow(occur, "h1 bigint, h2 bigint, doc_id bigint, start bigint")
    found = where.join(shared, ["h1", "h2"]).groupBy("doc_id", (F.col("start") + F.col("a")).alias("lo"), (F.col("start") + F.col("b") + (k - 1)).alias("hi")).agg(F.max("n").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.when(F.col("lo") <= before - (k - 1), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "island").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end"), F.max("n").alias("copies")).drop("island")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """Spans of ``k`` words or more that two documents at least share, by super-k-mers.

    A word is a run without white space, compared by its letters and digits in lower case (by itself if it has none).
    A window that only one doc_id has is not shared, however often it has it; rows that repeat a doc_id are one document.
    Rows with a null doc_id or null, empty or shorter texts give no span; longer ones are read whole, whatever their
    length; other columns are not read. An empty table gives no row.
    """

    def count(groups, k):
        for g in groups:
            yield g, windows_shared(g, k)

    return spans(docs, count, id_col, text_col, k, m)
