"""Exact top-k search: an M-tree searched best first, over vectors partitioned by routing objects.

Every vector belongs to the group of its nearest routing object; a group is cut into shards of bounded size by a hash of
the vector, and a shard is a tree of paged nodes: pages hold objects, inner nodes hold nodes; every entry stores its
distance to its parent and every node a radius that covers all below it. Each query has a queue of nodes in the order of
their lower bounds. A node enters by the bound that stored distances give (no distance is computed for it), returns to
the queue with the bound of its own distance, and is opened when it is the nearest of the queue; a query ends at the first
node that can't hold a neighbour. A query is first asked in the shard of its own vector; the k-th distance there bounds
which others have to be asked at all, and those meet it in blocks of queries from one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm._arrow import bounded_sample, shared_dir

K, PAGE, FAN = 10, 256, 8
SHARD, BLOCK, ROUTES, EVERY = 8192, 4096, 1024, 20
SLACK = 1e-7  # of the largest norm, for the rounding of distances that come from dot products
DENSE = 0.2  # share of a page's distances from which one matrix product is cheaper than the single ones


def dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each range repeated by its size, and the numbers in the ranges."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


class MTree:
    """Paged metric nodes in arrays. Nodes are numbered level by level, pages first; ``first``/``end`` are objects of a page
    and nodes of an inner node; ``route`` is a node's routing object, ``radius`` covers all objects below it, ``to_parent``
    is the distance of its routing object to its parent's, ``to_page`` the distance of an object to its page's."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE, fan: int = FAN):
        n = len(x)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        parts = [np.arange(n)] if n else []
        done: list[np.ndarray] = []
        while parts:  # split by two far objects until a page holds the part
            p = parts.pop()
            if len(p) <= page:
                done.append(p)
                continue
            d = dist(x[p[:1]], x[p])[0]
            a = int(d.argmax())
            da = dist(x[p[a : a + 1]], x[p])[0]
            b = int(da.argmax())
            near = da - dist(x[p[b : b + 1]], x[p])[0]
            half = np.argsort(near, kind="stable")
            cut = min(max(int((near < 0).sum()), len(p) // 4), len(p) - len(p) // 4)
            parts += [p[half[cut:]], p[half[:cut]]]
        self.order = np.concatenate(done) if done else np.zeros(0, np.int64)
        self.ids, self.x = ids[self.order], x[self.order]
        self.xx = (self.x * self.x).sum(1)
        cuts = np.concatenate(([0], np.cumsum([len(p) for p in done]))).astype(np.int64)
        self.pages = len(done)
        first, end, low, high, level = cuts[:-1].tolist(), cuts[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), list(range(self.pages))
        while len(level) > fan:  # inner nodes of neighbouring nodes, up to a root list of fan nodes
            above = []
            for i in range(0, len(level), fan):
                a, b = level[i], level[min(i + fan, len(level)) - 1]
                above.append(len(first))
                first.append(a)
                end.append(b + 1)
                low.append(low[a])
                high.append(high[b])
            level = above
        self.roots = np.array(level, np.int64)
        self.first, self.end = np.array(first, np.int64), np.array(end, np.int64)
        m = len(first)
        self.route, self.radius, self.to_page = np.zeros(m, np.int64), np.zeros(m), np.zeros(n)
        for i, (a, b) in enumerate(zip(low, high)):
            self.route[i] = a + int(dist(self.x[a:b].mean(0, keepdims=True), self.x[a:b])[0].argmin())
            d = _norms(self.x[a:b] - self.x[self.route[i]])
            self.radius[i] = d.max()
            if i < self.pages:
                self.to_page[a:b] = d
        self.to_parent = np.zeros(m)
        for i in range(self.pages, m):
            a, b = self.first[i], self.end[i]
            self.to_parent[a:b] = _norms(self.x[self.route[a:b]] - self.x[self.route[i]])

    def search(self, q: np.ndarray, own: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, places) of the k nearest objects of each query but those with its own id, within ``limit``;
        empty places are -1 with an infinite distance. The last value counts all distances that were computed."""
        n, m = len(q), len(self.radius)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        tau, qq = limit.astype(np.float64).copy(), (q * q).sum(1)
        slack = SLACK * (1 + float(np.sqrt(max(qq.max(initial=0), self.xx.max(initial=0)))))
        if not m or not n:
            return best_d, best_i, 0
        queue = np.full((n, m), np.inf)  # a query's queue: lower bounds of the nodes that wait
        to_route = np.full((n, m), np.nan)  # distances to routing objects, where computed
        to_route[:, self.roots] = dist(q, self.x[self.route[self.roots]])
        queue[:, self.roots] = np.maximum(to_route[:, self.roots] - self.radius[None, self.roots], 0)
        cost, active = n * len(self.roots), np.arange(n)
        while len(active):
            node = queue[active].argmin(1)
            least = queue[active, node]
            go = (least <= tau[active] + slack) & (least < np.inf)
            active, node = active[go], node[go]  # all that waits is farther still
            if not len(active):
                break
            was = queue[active, node]
            queue[active, node] = np.inf
            new = np.isnan(to_route[active, node])
            if new.any():  # back with the bound of its own distance
                r, v = active[new], node[new]
                d = _norms(q[r] - self.x[self.route[v]])
                cost += len(r)
                to_route[r, v] = d
                queue[r, v] = np.maximum(was[new], d - self.radius[v])
            inner = ~new & (node >= self.pages)
            if inner.any():  # children by stored distances alone
                r, v, w = active[inner], node[inner], was[inner]
                of, child = _ranges(self.first[v], self.end[v])
                queue[r[of], child] = np.maximum(w[of], np.abs(to_route[r, v][of] - self.to_parent[child]) - self.radius[child])
            leaf = np.flatnonzero(~new & (node < self.pages))
            if len(leaf):
                by = leaf[np.argsort(node[leaf], kind="stable")]
                for rows in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
                    cost += self._page(int(node[rows[0]]), active[rows], q, qq, own, k, to_route, tau, slack, best_d, best_i)
        return best_d, best_i, cost

    def _page(self, page, who, q, qq, own, k, to_route, tau, slack, best_d, best_i) -> int:
        """Asks the objects of a page that the stored distances don't rule out; the number of distances computed."""
        a, b = self.first[page], self.end[page]
        may = (np.abs(to_route[who, page][:, None] - self.to_page[None, a:b]) <= tau[who][:, None] + slack) & (self.ids[a:b][None, :] != own[who][:, None])
        some = np.flatnonzero(may.any(0))
        if not len(some):
            return 0
        at, may = some + a, may[:, some]
        if may.mean() >= DENSE:
            cost = may.size
            d = np.where(may, np.sqrt(np.maximum(qq[who][:, None] + self.xx[at][None, :] - 2 * (q[who] @ self.x[at].T), 0)), np.inf)
        else:
            r, c = np.nonzero(may)
            cost = len(r)
            d = np.full(may.shape, np.inf)
            d[r, c] = _norms(q[who[r]] - self.x[at[c]])
        d[d > tau[who][:, None] + slack] = np.inf
        new = np.flatnonzero((d < np.inf).any(1))
        if not len(new):
            return cost
        who, d = who[new], d[new]
        at = np.broadcast_to(at, d.shape)
        if d.shape[1] > k:  # all that may tie with the k-th stay, however many
            d[d > np.partition(d, k - 1, 1)[:, k - 1 : k] + slack] = np.inf
            few = np.argsort(d, 1)[:, : max(k, int((d < np.inf).sum(1).max()))]
            d, at = np.take_along_axis(d, few, 1), np.take_along_axis(at, few, 1)
        r, c = np.nonzero(d < np.inf)
        d[r, c] = _norms(q[who[r]] - self.x[at[r, c]])  # exact for what may be a neighbour
        both_d = np.concatenate((best_d[who], d), 1)
        both_i = np.concatenate((best_i[who], np.where(np.isinf(d), -1, at)), 1)
        rank = np.lexsort((np.where(both_i >= 0, self.ids[both_i], np.iinfo(np.int64).max), np.round(both_d, 9)), axis=1)[:, :k]
        best_d[who], best_i[who] = np.take_along_axis(both_d, rank, 1), np.take_along_axis(both_i, rank, 1)
        tau[who] = np.minimum(tau[who], best_d[who, k - 1])
        return cost


def _vectors(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return np.asarray(col.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _greatest(vectors: np.ndarray) -> float:
    """Largest squared norm."""
    return float((vectors * vectors).sum(1).max(initial=0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, neighbor_rank, neighbor_id, distance): the k nearest others of every vector whose id is divisible by
    ``every``, over all vectors, exactly.

    Distances are Euclidean, in double precision, rounded to 9 places for order and to 6 in the result; ties go to the
    lesser id. Rows with a null id, a null, empty or non-finite vector, or of another length than most (the lesser length
    among equally frequent ones) are left out as queries and as neighbours; of rows that repeat an id the one with the
    least vector counts. Of equal vectors only the k + 1 of least id can be neighbours, so that a vector which many rows
    share is k + 1 objects. With k or fewer other rows all of them are neighbours; an empty table gives no row.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    kind = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    v = F.transform(F.col(vector_col), lambda e: e.cast(kind))  # floats travel as they are; distances are in double precision
    clean = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    one = clean.groupBy("id").agg(F.min("v").alias("v")).checkpoint()
    sizes = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id bigint, neighbor_rank int, neighbor_id bigint, distance double"
    if sizes is None:
        return spark.createDataFrame([], out)
    one, total = one.where(F.size("v") == sizes["n"]), sizes["count"]
    routes = min(ROUTES, -(-total // shard_rows))
    route = np.array([r["v"] for r in bounded_sample(one, "id", routes).orderBy("id").collect()], np.float64)  # ROUTES vectors at most
    shared = spark.sparkContext.broadcast(route)
    few = one.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rn") <= k + 1).select("id", "v", F.lit(False).alias("asks"))
    asked = one.where(F.col("id") % every == 0).select("id", "v", F.lit(True).alias("asks"))

    def assign(batches):
        for b in batches:
            x = _vectors(b.column(1))
            if len(x):
                d = dist(x, shared.value)
                g = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(d[np.arange(len(x)), g]), b.column(0), b.column(1), b.column(2)], names=["g", "d", "id", "v", "asks"])

    placed = few.unionByName(asked).mapInArrow(assign, f"g int, d double, id bigint, v array<{kind}>, asks boolean").checkpoint()
    about = placed.groupBy("g").agg(F.count_if(~F.col("asks")).alias("n"), F.count_if("asks").alias("q"), F.max(F.when(~F.col("asks"), F.col("d"))).alias("r")).collect()  # ROUTES rows at most
    shards, reach, blocks = np.ones(len(route), np.int64), np.full(len(route), -np.inf), np.ones(len(route), np.int64)
    for g, n, q, r in about:
        shards[g], reach[g], blocks[g] = max(1, -(-n // shard_rows)), -np.inf if r is None else r, max(1, -(-q // block_rows))
    known = spark.sparkContext.broadcast((shards, reach))

    def part(seed: int, counts: np.ndarray):  # copies of a vector meet in one shard
        return F.pmod(F.xxhash64(F.lit(seed), "v" if seed == 1 else "id"), F.element_at(F.array(*[F.lit(int(c)) for c in counts]), F.col("g") + 1)).cast("int")

    placed = placed.withColumn("s", part(1, shards))
    objects, queries = placed.where("not asks").select("g", "s", "id", "v"), placed.where("asks").withColumn("block", part(2, blocks))

    def search(key, objects: pa.Table, queries: pa.Table) -> pa.Table:
        rows = []
        if len(objects) and len(queries):
            tree = MTree(objects.column("o_id").to_numpy(), _vectors(objects.column("o_v")))
            q, own, limit = _vectors(queries.column("v")), queries.column("id").to_numpy(), queries.column("tau").to_numpy()
            d, at, _ = tree.search(q, own, k, limit)
            r, c = np.nonzero(at >= 0)
            rows = [own[r], tree.ids[at[r, c]], d[r, c]]
        a, b, e = rows or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "neighbor_id": pa.array(b, pa.int64()), "d": pa.array(e, pa.float64())})

    found = "query_id bigint, neighbor_id bigint, d double"

    def ask(these: DataFrame) -> DataFrame:
        """These queries (g, s, of, block, id, v, tau) in the shards that they name; a shard goes to the blocks that ask it."""
        keys = ["g", "s", "of", "block"]
        wanted = objects.join(these.select(*keys).distinct(), ["g", "s"]).select(*[F.col(c).alias(f"o_{c}") for c in keys], F.col("id").alias("o_id"), F.col("v").alias("o_v"))
        return wanted.groupBy(*[f"o_{c}" for c in keys]).cogroup(these.groupBy(*keys)).applyInArrow(search, found)

    home = ask(queries.select("g", "s", F.col("g").alias("of"), "block", "id", "v", F.lit(float("inf")).alias("tau"))).checkpoint()
    kth = home.groupBy(F.col("query_id").alias("id")).agg(F.max("d").alias("tau"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")

    def visit(batches):
        shards, reach = known.value
        for b in batches:
            (g, s, block, tau), x = (b.column(i).to_numpy() for i in (0, 1, 2, 5)), _vectors(b.column(4))
            if not len(x):
                continue
            d = dist(x, shared.value)
            slack = SLACK * (1 + np.sqrt(max(_greatest(x), _greatest(shared.value))))
            go = d - reach[None, :] <= tau[:, None] + slack
            # the hyperplane between two routing objects bounds the distance as well
            go &= (d - d[np.arange(len(x)), g][:, None]) / 2 <= tau[:, None] + slack
            row, to = np.nonzero(go)
            of, shard = _ranges(np.zeros(len(row), np.int64), shards[to])
            row, to = row[of], to[of]
            other = (to != g[row]) | (shard != s[row])
            row, to, shard = row[other], to[other], shard[other]
            for i in range(0, len(row), 20_000):
                at = row[i : i + 20_000]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 20_000].astype(np.int32)), pa.array(shard[i : i + 20_000].astype(np.int32)), pa.array(g[at]), pa.array(block[at]), b.column(3).take(take), b.column(4).take(take), pa.array(tau[at])], names=["g", "s", "of", "block", "id", "v", "tau"])

    bounded = queries.join(kth, "id", "left").select("g", "s", "block", "id", "v", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    away = ask(bounded.mapInArrow(visit, f"g int, s int, of int, block int, id bigint, v array<{kind}>, tau double").checkpoint())
    order = Window.partitionBy("query_id").orderBy(F.round("d", 9), "neighbor_id")
    both = home.unionByName(away).withColumn("neighbor_rank", F.row_number().over(order)).where(F.col("neighbor_rank") <= k)
    return both.select("query_id", F.col("neighbor_rank").cast("int").alias("neighbor_rank"), "neighbor_id", F.round("d", 6).alias("distance"))


ORACLE = """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.id AS query_id, b.id AS neighbor_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
      FROM e a JOIN e b ON a.id <> b.id AND a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), neighbor_id)::INTEGER AS neighbor_rank FROM p)
SELECT query_id, neighbor_rank, neighbor_id, round(d, 6) AS distance FROM r WHERE neighbor_rank <= 10
"""
