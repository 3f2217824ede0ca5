"""Best-fit packing of token sequences into bins of one capacity, after Martello-Toth dominance reduction.

Sizes are whole numbers up to the capacity, so the corpus enters the plan as a histogram of at most ``capacity`` counts,
whatever its size. On the histogram the reduction fixes bins that some best packing has (small sets that dominate every
other way to fill the bin of an item), all equal ones at once; best-fit decreasing then packs what remains. Both work on
kinds of bins, of which there are a few per size, and documents find their bins by their place among those of their size.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._arrow import shared_dir

CAPACITY, SHARD_ROWS = 2048, 100_000
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def token_count(text: F.Column) -> F.Column:
    """Tokens of a text, words and single marks; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Plan:
    """Runs of equal bins. kinds: (bins, {size: how many}); fixed: how many of the kinds come from the reduction."""

    kinds: list[tuple[int, tuple[tuple[int, int], ...]]]
    fixed: int

    @property
    def bins(self) -> int:
        return sum(n for n, _ in self.kinds)


class _Counts:
    """A multiset of sizes."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0 and s > 0}
        self.sizes = sorted(self.n)

    def take(self, s: int, k: int) -> None:
        self.n[s] -= k
        if not self.n[s]:
            del self.n[s]
            self.sizes.pop(bisect.bisect_left(self.sizes, s))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k least sizes when one item of size ``without`` is set aside."""
        out = []
        for s in self.sizes:
            out += [s] * min(self.n[s] - (s == without), k - len(out))
            if len(out) >= k:
                break
        return out

    def largest_upto(self, limit: int, without: int) -> int | None:
        i = bisect.bisect_right(self.sizes, limit) - 1
        while i >= 0:
            s = self.sizes[i]
            if s != without or self.n[s] > 1:
                return s
            i -= 1
        return None

    def best_pair(self, room: int, without: int) -> tuple[int, int] | None:
        """Sizes a >= b of the two items that fill ``room`` best; the larger a first among equals."""
        s = np.array(self.sizes)
        c = np.array([self.n[x] - (x == without) for x in self.sizes])
        s, c = s[c > 0], c[c > 0]
        if not len(s):
            return None
        at = np.searchsorted(s, np.minimum(room - s, s), side="right") - 1  # b for each a
        own = at == np.arange(len(s))
        at = np.where(own & (c < 2), at - 1, at)
        ok = (at >= 0) & (s <= room)
        if not ok.any():
            return None
        total = np.where(ok, s + s[np.maximum(at, 0)], -1)
        i = int(len(total) - 1 - total[::-1].argmax())
        return int(s[i]), int(s[at[i]])


def _dominating(have: _Counts, j: int, c: int) -> tuple[int, ...] | None:
    """A set with an item of size j that dominates every other feasible set with it, by the Martello-Toth rules."""
    room = c - j
    low = have.smallest(3, j)
    k = 0
    while k < len(low) and sum(low[: k + 1]) <= room:
        k += 1
    if k == 0:
        return (j,)
    star = have.largest_upto(room, j)
    if k == 1 or star == room:
        return (j, star)
    if k == 2:
        a, b = have.best_pair(room, j)
        if star >= a + b:
            return (j, star)
        if star == a:
            more = []  # the two least items over b, but for one item of size a
            for s in have.sizes[bisect.bisect_right(have.sizes, b) :]:
                if s > a:
                    break
                more += [s] * min(have.n[s] - (s == j) - (s == a), 2 - len(more))
                if len(more) == 2:
                    break
            if len(more) < 2 or sum(more) > room:
                return (j, a, b)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[tuple[int, int], ...]]], dict[int, int]]:
    """(fixed bins, what remains): applied to the sizes from the largest down, again until nothing more is fixed."""
    have, fixed, again = _Counts(counts), [], True
    while again:
        again = False
        for j in reversed(have.sizes.copy()):
            while j in have.n:
                kind = _dominating(have, j, capacity)
                if kind is None:
                    break
                need = {s: kind.count(s) for s in kind}
                times = min(have.n[s] // q for s, q in need.items())
                if len(kind) == 3:
                    times = 1 if len(set(kind)) > 1 and times > 1 and not sum(kind) == capacity else times
                for s, q in need.items():
                    have.take(s, q * times)
                fixed.append((times, tuple(sorted(need.items(), reverse=True))))
                again = True
    return fixed, dict(have.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing over kinds of bins: each item goes where the least room is left, equal items at once."""
    bins: dict[int, list] = {}  # room left -> [(number, content)]
    rooms: list[int] = []

    def add(room: int, n: int, content: dict) -> None:
        if n:
            if room not in bins:
                bins[room] = []
                bisect.insort(rooms, room)
            bins[room].append((n, content))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in rooms[bisect.bisect_left(rooms, s) :]:
            if not left:
                break
            q = room // s
            groups = bins.pop(room)
            rooms.pop(bisect.bisect_left(rooms, room))
            for n, content in groups:
                full = min(n, left // q)
                add(room - q * s, full, {**content, s: q})
                left -= full * q
                part = left if full < n else 0
                if part:
                    add(room - part * s, 1, {**content, s: part})
                    left = 0
                    full += 1
                add(room, n - full, content)
        if left:
            q = capacity // s
            add(capacity - q * s, left // q, {s: q})
            if left % q:
                add(capacity - left % q * s, 1, {s: left % q})
    return [(n, tuple(sorted(content.items(), reverse=True))) for room in rooms for n, content in bins[room]]


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    fixed, rest = reduce_instance(counts, capacity)
    return Plan(fixed + best_fit(rest, capacity), len(fixed))


def _runs(plan: Plan) -> dict[int, list[np.ndarray]]:
    """For each size: first place, first bin, how many a bin, where in the bin they begin."""
    out: dict[int, list] = {}
    place: dict[int, int] = {}
    first = 0
    for n, content in plan.kinds:
        at = 0
        for s, q in content:
            out.setdefault(s, []).append((place.get(s, 0), first, q, at))
            place[s] = place.get(s, 0) + n * q
            at += s * q
        first += n
    return {s: np.array(v, np.int64).T for s, v in out.items()}


def _copies(per: DataFrame) -> DataFrame:
    """``per`` (doc_id, tokens, in checkpointed partitions) with copy_no: rows of one doc_id are numbered partition by
    partition, each by size, so that a doc_id that many rows repeat is never sorted in one task."""
    known = per.withColumn("part_no", F.spark_partition_id())
    many = per.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("many_id"))
    tied = known.join(many, F.col("doc_id").eqNullSafe(F.col("many_id")), "left_semi")
    before = tied.groupBy("doc_id", "part_no").count()
    first = before.select(F.col("doc_id").alias("many_id"), F.col("part_no").alias("many_part"), (F.sum("count").over(Window.partitionBy("doc_id").orderBy("part_no")) - F.col("count")).alias("first"))
    within = F.row_number().over(Window.partitionBy("doc_id", "part_no").orderBy("tokens")) - 1
    numbered = tied.withColumn("within", within).join(first, F.col("doc_id").eqNullSafe(F.col("many_id")) & (F.col("part_no") == F.col("many_part"))).select("doc_id", "tokens", (F.col("within") + F.col("first")).cast("int").alias("copy_no"))
    single = known.join(many, F.col("doc_id").eqNullSafe(F.col("many_id")), "left_anti").select("doc_id", "tokens", F.lit(0).alias("copy_no"))
    return single.unionByName(numbered)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(bin_id, bin_offset, doc_id, copy_no, piece_no, piece_tokens): where each piece of each row goes.

    A text of more tokens than ``capacity`` is cut into full pieces, each a bin of its own, and a rest. Rows without a
    token (null or empty texts) take no room and give no row; a null doc_id is carried as null. Rows that repeat a doc_id
    are numbered by copy_no. Pieces of one size are ranked by a hash of their document in shards of about
    ``shard_rows`` pieces; a shard's first rank comes from the counts of those before it. An empty table gives no row.
    """
    spark = docs.sparkSession
    per = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), token_count(F.col(text_col).cast("string")).alias("tokens")).where("tokens > 0")
    shared_dir(spark)
    per = _copies(per.checkpoint()).checkpoint()  # the texts are read once
    last = F.ceil(F.col("tokens") / capacity).cast("bigint")
    pieces = (
        per.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)).alias("piece_no"))
        .select("doc_id", "copy_no", "piece_no", F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).cast("int").alias("piece_tokens"))
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("piece_tokens").count().collect()}  # capacity rows at most
    plan = make_plan(counts, capacity)
    shared = spark.sparkContext.broadcast(_runs(plan))  # a few runs per size
    shards = F.create_map(*[F.lit(x) for s, n in sorted(counts.items()) for x in (s, -(-n // shard_rows))]) if counts else F.create_map(F.lit(0), F.lit(1))
    shard = F.pmod(F.xxhash64("doc_id", "copy_no", "piece_no"), F.element_at(shards, F.col("piece_tokens"))).cast("int")
    pieces = pieces.withColumn("shard", shard)
    sizes = pieces.groupBy("piece_tokens", "shard").agg(F.count("*").alias("n"))
    first = sizes.select(F.col("piece_tokens").alias("s"), F.col("shard").alias("h"), (F.sum("n").over(Window.partitionBy("piece_tokens").orderBy("shard")) - F.col("n")).alias("first"))
    w = Window.partitionBy("piece_tokens", "shard").orderBy(F.xxhash64("doc_id"), "doc_id", "copy_no", "piece_no")
    ranked = pieces.withColumn("rn", F.row_number().over(w) - 1).join(first, (F.col("piece_tokens") == F.col("s")) & (F.col("shard") == F.col("h"))).withColumn("rank", F.col("rn") + F.col("first"))

    def place(batches):
        runs = shared.value
        for b in batches:
            size, all_ranks = b.column(0).to_numpy(), b.column(1).to_numpy()
            bin_id, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                rank = all_ranks[rows]
                start, begin_bin, q, begin = runs[s]
                i = np.searchsorted(start, rank, side="right") - 1
                bin_id[rows] = begin_bin[i] + (rank - start[i]) // q[i]
                at[rows] = begin[i] + (rank - start[i]) % q[i] * s
            yield pa.RecordBatch.from_arrays([pa.array(bin_id), pa.array(at), *(b.column(k) for k in (2, 3, 4, 0))], names=["bin_id", "bin_offset", "doc_id", "copy_no", "piece_no", "piece_tokens"])

    return ranked.select("piece_tokens", "rank", "doc_id", "copy_no", "piece_no").mapInArrow(place, "bin_id bigint, bin_offset bigint, doc_id bigint, copy_no int, piece_no bigint, piece_tokens int")
