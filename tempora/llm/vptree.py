"""Nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes least distance by one more coordinate: with M the
greatest norm of all vectors, x is extended by sqrt(M^2 - |x|^2) and a query by
0, so |x' - q'|^2 = M^2 + |q|^2 - 2 q.x. Vectors are dealt to shards by a hash
of their id and shuffled once; the task that owns a shard builds its tree once
and then streams the queries past it, batch by batch, so it holds one shard and
one batch of queries. A batch is answered in one walk down the tree: a subtree
is skipped for the queries
whose best `k` so far lie nearer than the subtree's shell, by the triangle
inequality. `relax` widens the shell distance that counts as too far: 1 skips
only what cannot hold a better answer (exact), more skips sooner. Answers of
all shards are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SHARD_ROWS = 16384
QUERY_BATCH = 4096
LEAF = 512
K = 20
QUERY_EVERY = 20


class Node:
    __slots__ = ("far", "high", "low", "near", "rows", "vantage")

    def __init__(self, rows=None, vantage=-1, low=None, high=None, near=None, far=None):
        self.rows, self.vantage, self.low, self.high, self.near, self.far = rows, vantage, low, high, near, far


def build(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """Tree over points[rows]: inner nodes keep the least and greatest distance of either half to the vantage point.

    The vantage point, the first row of a node, stays in the halves; each half
    has at least one row, so equal points end in leaves too.
    """
    if len(rows) <= leaf:
        return Node(rows=rows)
    vantage = int(rows[0])
    d = np.sqrt(np.maximum(((points[rows] - points[vantage]) ** 2).sum(axis=1), 0))
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    a, b = order[:half], order[half:]
    return Node(vantage=vantage, low=(d[a[0]], d[b[0]]), high=(d[a[-1]], d[b[-1]]), near=build(points, rows[a], leaf), far=build(points, rows[b], leaf))


class Shard:
    """The tree of a shard, built once. ids ascend with the row, so ties fall to the smaller id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, top: float):
        order = np.argsort(ids)
        self.points, self.ids, self.top = points[order], ids[order], top
        norms = (self.points**2).sum(axis=1)
        self.lifted = np.hstack([self.points, np.sqrt(np.maximum(top * top - norms, 0))[:, None]])
        self.root = build(self.lifted, np.arange(len(self.points)))


class Search:
    """The best k of a shard for a batch of queries."""

    def __init__(self, shard: Shard, queries: np.ndarray, query_ids: np.ndarray, k: int, relax: float):
        self.points, self.ids, self.lifted = shard.points, shard.ids, shard.lifted
        self.queries, self.query_ids, self.k, self.relax = queries, query_ids, k, relax
        self.asked = np.hstack([queries, np.zeros((len(queries), 1))])
        self.base = shard.top**2 + (queries**2).sum(axis=1)
        self.slack = np.sqrt((queries**2).sum(axis=1)) * shard.top * 1e-12  # far above the rounding of a product
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.walk(shard.root, np.arange(len(queries)))

    def reach(self, asking: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, with a little room for rounding so that ties are looked at."""
        kth = self.score[asking, -1]
        far = np.sqrt(np.maximum(self.base[asking] - 2 * kth, 0)) * (1 + 1e-9) + 1e-9
        return np.where(np.isinf(kth), np.inf, far)

    def walk(self, node: Node, asking: np.ndarray) -> None:
        if not len(asking):
            return
        if node.rows is not None:
            self.look(node.rows, asking)
            return
        v = self.lifted[node.vantage]
        d = np.sqrt(np.maximum((self.asked[asking] ** 2).sum(axis=1) + v @ v - 2 * self.asked[asking] @ v, 0))
        gaps = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi in zip(node.low, node.high, strict=True)]
        first = gaps[0] <= gaps[1]
        for child, gap, chosen in ((node.near, gaps[0], first), (node.far, gaps[1], ~first), (node.near, gaps[0], ~first), (node.far, gaps[1], first)):
            part = np.flatnonzero(chosen)
            if len(part):
                part = part[gap[part] * self.relax <= self.reach(asking[part])]
                self.walk(child, asking[part])

    def look(self, rows: np.ndarray, asking: np.ndarray) -> None:
        """Score a leaf: a matrix product finds what may belong to the best, whose scores are then summed in one fixed order, so equal vectors tie exactly."""
        for at in range(0, len(asking), 1024):
            who = asking[at : at + 1024]
            rough = self.queries[who] @ self.points[rows].T
            rough[self.query_ids[who][:, None] == self.ids[rows][None, :]] = -np.inf  # a query's own row
            slack = self.slack[who]
            border = self.score[who, -1] - slack
            if len(rows) > self.k:
                border = np.maximum(border, np.partition(rough, -self.k, axis=1)[:, -self.k] - 2 * slack)
            i, j = np.nonzero((rough >= border[:, None]) & np.isfinite(rough))
            if not len(i):
                continue
            exact = np.concatenate([(self.queries[who[i[c : c + 65536]]] * self.points[rows[j[c : c + 65536]]]).sum(axis=1) for c in range(0, len(i), 65536)])
            asked, start, count = np.unique(i, return_index=True, return_counts=True)
            width = int(count.max())
            scores, found = np.full((len(asked), width), -np.inf), np.full((len(asked), width), np.iinfo(np.int64).max)
            row, column = np.repeat(np.arange(len(asked)), count), np.arange(len(i)) - np.repeat(start, count)
            scores[row, column], found[row, column] = exact, self.ids[rows[j]]
            scores, found = np.hstack([self.score[who[asked]], scores]), np.hstack([self.found[who[asked]], found])
            order = np.lexsort((found, -scores), axis=1)[:, : self.k]
            self.score[who[asked]] = np.take_along_axis(scores, order, 1)
            self.found[who[asked]] = np.take_along_axis(found, order, 1)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part: an id, no null or non-finite component, not all zero."""
    ok = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists(embedding, v -> v <> 0)"
    return vectors.select("vec_id", "embedding").where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def _stretches(batches):
    """(shard, whether queries, ids, vectors) for each run of equal shard, dim and kind within a batch."""
    for batch in batches:
        shard, dim, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "kind", "vec_id"))
        changes = (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1])
        cuts = [0, *(np.flatnonzero(changes) + 1), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                x = batch.column("x").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                yield (int(dim[a]), int(shard[a])), bool(kind[a]), ids[a:b], x.reshape(b - a, -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of largest inner product, its own id left out.

    `vectors` and `queries` have vec_id and embedding. Null, zero and
    non-finite vectors take no part; of rows with equal ids one (with the
    greatest components) counts; vectors of another length than the longest
    group's never meet. Ties go to the smaller id; no queries give no rows.
    """
    pool = staged(clean_vectors(vectors).groupBy("vec_id").agg(F.max("x").alias("x")).withColumn("dim", F.size("x")), "vectors")
    asked = clean_vectors(queries).groupBy("vec_id").agg(F.max("x").alias("x")).withColumn("dim", F.size("x"))
    stats = pool.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("top")).first()
    n, top = stats["n"], float(np.sqrt(stats["top"] or 0.0)) * (1 + 1e-12)
    shards = max(1, -(-n // shard_rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(int(shards))).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1))).alias("shard")
    mine = pool.select("dim", own, F.lit(0).alias("kind"), "vec_id", "x")
    met = mine.unionByName(asked.select("dim", every, F.lit(1).alias("kind"), "vec_id", "x"))

    def search(batches):
        key, held, shard = None, [], None
        for at, asking, ids, x in _stretches(batches):
            if at != key:
                key, held, shard = at, [], None
            if not asking:
                held.append((ids, x))
                continue
            if not held:
                continue  # no vector of this length in the shard
            shard = shard or Shard(np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held]), top)
            for i in range(0, len(ids), QUERY_BATCH):
                s = Search(shard, x[i : i + QUERY_BATCH], ids[i : i + QUERY_BATCH], k, relax)
                some = np.isfinite(s.score)
                found = [pa.array(np.repeat(s.query_ids, k)[some.ravel()], pa.int64()), pa.array(s.found[some], pa.int64()), pa.array(s.score[some], pa.float64())]
                yield pa.RecordBatch.from_arrays(found, names=["query_id", "vec_id", "score"])

    dealt = met.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP4_SQL = """
with v as (
  select vec_id, embedding::double[] as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
