"""Suffix-array dedup: column-wise (right to left) construction of the suffix order of many strings at once.

The strings are the super-k-mers of a bucket whose minimiser occurs in two documents at least. Each round inserts one
symbol (word) of every string: the new suffixes' places among all come from the rank of the symbol in the collection's
Burrows-Wheeler transform, and their common prefixes from the least common prefix between neighbours with the same
symbol. Transform and common prefixes live in files of the shared folder; each round reads them from
end to end and writes their successors. Intervals of the final order with common prefixes of k words or more that
belong to two documents at least are the shared spans.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from recallgrid.llm._arrow import shared_dir
from recallgrid.llm.superkmer import Group, K, M, spans, windows_shared

PILE_WORDS = 200_000


class Files:
    """Arrays as files of a folder, read and written as streams; a successor is a new file and its predecessor goes."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.now: dict[str, str] = {}
        self.made = 0

    def write(self, name: str, x: np.ndarray) -> None:
        path, self.made = posixpath.join(self.path, f"{name}-{self.made}"), self.made + 1
        with self.fs.open_output_stream(path) as f:
            f.write(x.data)
        if name in self.now:
            self.fs.delete_file(self.now[name])
        self.now[name] = path

    def read(self, name: str, dtype) -> np.ndarray:
        with self.fs.open_input_stream(self.now[name]) as f:
            return np.frombuffer(f.read(), dtype)

    def close(self) -> None:
        self.fs.delete_dir(self.path)


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo:hi] for every pair (not empty), by a sparse table."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out, have = np.empty(len(lo), x.dtype), x
    for j in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == j)
        if len(at):
            out[at] = np.minimum(have[lo[at]], have[hi[at] - (1 << j)])
        have = np.minimum(have[: -(1 << j)], have[1 << j :]) if len(have) > 1 << j else have
    return out


def suffix_order(flat: np.ndarray, begin: np.ndarray, files: Files) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) of all suffixes in order, ties by string number.

    ``flat`` holds the symbols (numbers from 1) of the strings one after the other, ``begin`` where each starts. The
    empty suffixes come first.
    """
    length = np.diff(begin)
    m, rounds = len(length), int(np.diff(begin).max()) if len(begin) > 1 else 0
    symbols = np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.uint32  # 16 bits sort by radix
    prefixes = np.uint8 if rounds < 1 << 8 else np.uint32
    place = np.arange(m)
    files.write("bwt", np.where(length > 0, flat[np.maximum(begin[1:] - 1, 0)], 0).astype(symbols))
    files.write("lcp", np.zeros(m, prefixes))
    for done in range(rounds):
        bwt, lcp = files.read("bwt", symbols), files.read("lcp", prefixes)
        live = np.flatnonzero(length > done)
        at = place[live]
        order = np.argsort(bwt, kind="stable")
        order = order[len(bwt) - np.count_nonzero(bwt) :]  # strings that are complete have no symbol
        target = np.empty(len(bwt), np.int64)
        target[order] = m + np.arange(len(order))
        symbol = bwt[order]
        same = symbol[1:] == symbol[:-1]
        new_at = target[at]
        # common prefix with the neighbour before and after that starts with the same symbol
        spot = new_at - m
        pre, post = np.zeros(len(at), prefixes), np.zeros(len(at), prefixes)
        has = np.flatnonzero((spot > 0) & np.concatenate(([False], same))[spot])
        pre[has] = 1 + _range_min(lcp, order[spot[has] - 1] + 1, at[has] + 1)
        nxt = np.flatnonzero((spot < len(order) - 1) & np.concatenate((same, [False]))[spot])
        post[nxt] = 1 + _range_min(lcp, at[nxt] + 1, order[spot[nxt] + 1] + 1)
        total = len(bwt) + len(live)
        old = np.ones(total, bool)
        old[new_at] = False
        left = length[live] - done - 1
        before = np.where(left > 0, flat[np.maximum(begin[live] + left - 1, 0)], 0)
        next_bwt, next_lcp = np.empty(total, symbols), np.empty(total, prefixes)
        next_bwt[old], next_bwt[new_at] = bwt, before
        next_lcp[old], next_lcp[new_at] = lcp, pre
        ok = new_at + 1 < total
        ok[ok] &= old[new_at[ok] + 1]
        next_lcp[new_at[ok] + 1] = post[ok]
        place = np.flatnonzero(old)[place]
        place[live] = new_at
        files.write("bwt", next_bwt)
        files.write("lcp", next_lcp)
    bwt = files.read("bwt", symbols)
    order = np.argsort(bwt, kind="stable")
    order = order[len(bwt) - np.count_nonzero(bwt) :]
    to = np.empty(len(bwt), np.int64)
    to[order] = m + np.arange(len(order))
    who, size = np.empty(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    at, live = np.arange(m), np.arange(m)
    who[at] = live
    for done in range(rounds):  # from each empty suffix to the longer ones, by the transform alone
        go = length[live] > done
        live, at = live[go], to[at[go]]
        who[at], size[at] = live, done + 1
    return who, size, files.read("lcp", prefixes)


def pile_counts(pile: list[Group], k: int, files: Files) -> list[list[np.ndarray]]:
    """For each group and distinct string the occurrences of each window, 0 where one document alone has it."""
    texts = [t.split(b" ") for g in pile for t in g.text]
    names = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    flat = np.fromiter((names[w] for t in texts for w in t), np.int32, int(begin[-1]))
    who, size, lcp = suffix_order(flat, begin, files)
    low, high, many = (np.array([x for g in pile for x in v(g)], np.int64) for v in (lambda g: g.low, lambda g: g.high, lambda g: g.many))
    first = np.flatnonzero(lcp < k)
    lo, hi, n = np.minimum.reduceat(low[who], first), np.maximum.reduceat(high[who], first), np.add.reduceat(many[who], first)
    of = np.cumsum(lcp < k) - 1
    windows = np.array([w for g in pile for w in g.windows], np.int64)
    offset = np.concatenate(([0], np.cumsum(windows)))
    out = np.zeros(int(offset[-1]), np.int64)
    start = np.diff(begin)[who] - size
    hit = (size >= k) & (lo[of] != hi[of])
    out[offset[who[hit]] + start[hit]] = n[of[hit]]
    each, i = [], 0
    for g in pile:
        each.append([out[offset[i + j] : offset[i + j + 1]] for j in range(len(g.text))])
        i += len(g.text)
    return each


def suffix_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, pile_words: int = PILE_WORDS) -> DataFrame:
    """Spans of ``k`` words or more that two documents at least share, by suffix order and common prefixes.

    Same columns, same words and same treatment of nulls, empty, short and long texts, repeated rows and empty tables as
    superkmer.repeated_spans. A pile is a set of whole minimiser groups of about ``pile_words`` words: groups share no
    window, so that a pile has all copies of its windows; a round holds the arrays of one pile.
    """
    folder = posixpath.join(shared_dir(docs.sparkSession), f"bwt-{uuid.uuid4().hex}")

    def count(groups: Iterator[Group], k: int):
        task = TaskContext.get()
        files = None
        pile, words = [], 0
        try:
            for g in groups:
                if len(g.text) == 1:  # equal strings are one already
                    yield g, windows_shared(g, k)
                    continue
                files = files or Files(f"{folder}/{task.partitionId()}-{task.taskAttemptId()}")
                pile.append(g)
                words += sum(g.windows) + (k - 1) * len(g.windows)
                if words >= pile_words:
                    yield from zip(pile, pile_counts(pile, k, files))
                    pile, words = [], 0
            if pile:
                yield from zip(pile, pile_counts(pile, k, files))
        finally:
            if files:
                files.close()

    return spans(docs, count, id_col, text_col, k, m)
