"""Vectorised text primitives over Arrow string buffers, and small Spark helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.session import shared_dir as shared_dir

_CODE = np.arange(256)
IS_SPACE = np.isin(_CODE, [9, 10, 11, 12, 13, 32])
IS_UPPER = (_CODE >= 65) & (_CODE <= 90)
IS_LOWER = (_CODE >= 97) & (_CODE <= 122)
IS_DIGIT = (_CODE >= 48) & (_CODE <= 57)
IS_HIGH = _CODE >= 128
IS_WORDCH = IS_UPPER | IS_LOWER | IS_DIGIT | IS_HIGH
LOWER = np.where(IS_UPPER, _CODE + 32, _CODE).astype(np.uint8)
_BYTE_CODE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def utf8_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(arr: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes of text each; a longer text has a range of its own."""
    _, off = utf8_parts(arr)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of a block of texts.

    space=True: the runs between white space, each normalised to its lower-cased letters and digits (a run with none of
    them stays as it is). space=False: the runs of letters and digits, lower-cased (ASCII; other bytes stay).
    ``data``/``off`` hold the normalised words one after the other, ``hash`` a 64-bit hash of each, ``doc`` the first
    word of each text (one more entry than texts).
    """

    def __init__(self, arr: pa.Array, space: bool):
        raw, off = utf8_parts(arr)
        inside = ~IS_SPACE[raw] if space else IS_WORDCH[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if len(raw) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(start, off)
        keep = inside
        if space and len(start):
            solid = IS_WORDCH[raw]
            total = np.concatenate(([0], np.cumsum(solid)))
            bare = total[end] == total[start]
            keep = solid & inside
            if bare.any():
                flag = np.zeros(len(raw) + 1, np.int32)
                np.add.at(flag, start[bare], 1)
                np.add.at(flag, end[bare], -1)
                keep = keep | (np.cumsum(flag[:-1]) > 0)
        where = np.flatnonzero(keep)
        self.data = LOWER[raw[where]]
        self.off = np.append(np.searchsorted(where, start), len(where)).astype(np.int64)
        self.raw_start, self.raw_end = start, end
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        n = len(self.off) - 1
        if not n:
            return np.zeros(0, np.uint64)
        length = np.diff(self.off)
        pos = np.arange(len(self.data)) - np.repeat(self.off[:-1], length)
        value = _BYTE_CODE[self.data] * powers(int(length.max()))[pos]
        return mix64(np.add.reduceat(value, self.off[:-1]) + length.astype(np.uint64))

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """The normalised words with a space after each, and where each begins."""
        n = len(self.off) - 1
        begin = self.off + np.arange(n + 1)
        out = np.full(int(begin[-1]) if n else 0, 32, np.uint8)
        if n:
            out[np.arange(len(self.data)) + np.repeat(np.arange(n), np.diff(self.off))] = self.data
        return out.tobytes(), begin


def fresh(df_columns, *bases: str) -> list[str]:
    """Column names that no column of the input has, whatever the case."""
    taken, out = {c.lower() for c in df_columns}, []
    for b in bases:
        name = b
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of what ``df`` reads, as the optimizer knows them from its files; where it doesn't, the bytes of the texts."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: those whose hashed key is least, the same whatever the partitioning.

    Hashes are even, so rows beyond one and a half times the wanted share of all hashes are left out before the sort, and
    little more than the sample leaves its partition at any size.
    """
    h, *_ = fresh(df.columns, "sample_hash")
    hashed = df.withColumn(h, F.xxhash64(F.lit(17), F.col(key)))
    share = (1.5 * rows + 20) / max(df.count(), 1)
    if share < 1:
        hashed = hashed.where(F.col(h) <= int(-(2**63) + 2**64 * share))
    return hashed.orderBy(h, key).limit(rows).drop(h)
