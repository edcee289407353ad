"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

The largest inner product becomes the smallest distance: every vector of a
shard gets one more coordinate that lifts it to the shard's largest norm, and
queries get a zero there. A tree parts its points at the median distance from
a vantage point and keeps the range of distances on both sides, so by the
triangle inequality each leaf has a lower bound for each query. A leaf is left
out if its bound times ``factor`` exceeds the k-th distance found so far:
factor 1 is exact, larger ones leave out more.

Every row counts: rows that repeat an id or a whole row are candidates and
queries of their own, null ids are candidates that come last among equal
scores. Equal vectors are one point with several rows, so large groups of
copies cost one comparison. Vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do those of another dimension than the
most frequent (of equally frequent ones the smallest), with which the others
have no inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.llm.common import quoted, written

LEAF = 64
SHARD_ROWS = 8192
FACTOR = 1.5
QUERY_BLOCK = 512
FIRST_LEAVES = 2
#: Of the largest norm: more than rounding can add to a distance.
SLACK = 1e-7
#: Possible neighbours of a block of queries that are held before they are sifted.
HELD = 1 << 20


class Tree:
    """A vantage-point tree over distinct points in double precision."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        self.points = points
        # inner nodes: vantage point, (inner child, outer child), ranges of distance; a child below 0 is leaf ~child
        self.vantage: list[int] = []
        self.children: list[list[int]] = []
        self.ranges: list[tuple[float, float, float, float]] = []
        self.leaves: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        open_parts: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
        self.root = 0
        while open_parts:
            part, parent, side = open_parts.pop()
            if len(part) <= leaf:
                name = ~len(self.leaves)
                self.leaves.append(part)
            else:
                name = len(self.vantage)
                v = int(part[rng.integers(len(part))])
                far = np.linalg.norm(points[part] - points[v], axis=1)
                order = np.argsort(far, kind="stable")
                half = len(part) // 2
                inner, outer = order[:half], order[half:]
                self.vantage.append(v)
                self.children.append([0, 0])
                self.ranges.append((far[inner].min(), far[inner].max(), far[outer].min(), far[outer].max()))
                open_parts += [(part[outer], name, 1), (part[inner], name, 0)]
            if parent < 0:
                self.root = name
            else:
                self.children[parent][side] = name

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance from each query to each leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not self.vantage:
            return out
        at = self.points[self.vantage]
        far = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (at**2).sum(1) - 2 * queries @ at.T, 0))
        held: list[tuple[int, np.ndarray]] = [(self.root, np.zeros(len(queries)))]
        while held:
            name, low = held.pop()
            if name < 0:
                out[:, ~name] = low
                continue
            d, (a, b, c, e) = far[:, name], self.ranges[name]
            for child, lo, hi in ((self.children[name][0], a, b), (self.children[name][1], c, e)):
                held.append((child, np.maximum(low, np.maximum(d - hi, lo - d))))
        return out

    def search(self, queries: np.ndarray, k: int, factor: float, by_product: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, point, distance) of every point that rounding and ties leave
        possible among the k nearest of a query, at least its k nearest found,
        and how many distances were computed.

        ``by_product``: for points of one norm, the order is that of inner
        products, whose digits a large norm doesn't take, and these are given,
        negated; distances only spare leaves."""
        n, seen = len(queries), 0
        k = min(k, len(self.points))
        best = np.full((n, k), np.inf)
        low = self.bounds(queries) * factor
        squares, own = (queries**2).sum(1), (self.points**2).sum(1)
        slack = SLACK * np.sqrt(max(squares.max(initial=0), own.max(initial=0)))
        # twice what summing in another order can change in an inner product
        doubt = 4 * (queries.shape[1] + 2) * np.finfo(float).eps * np.sqrt(squares * own.max(initial=0)) if by_product else np.full(n, slack)
        first = np.argpartition(low, min(FIRST_LEAVES, low.shape[1]) - 1, axis=1)[:, :FIRST_LEAVES]
        done = np.zeros(low.shape, bool)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def sift() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, p, far = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            near = far <= (best.max(axis=1) + doubt)[q]
            return q[near], p[near], far[near]

        def visit(which: np.ndarray, name: int) -> None:
            nonlocal seen, waiting, held
            part = self.leaves[name]
            seen += len(which) * len(part)
            far = -(queries[which] @ self.points[part].T)
            if not by_product:
                far = np.sqrt(np.maximum(squares[which][:, None] + own[part] + 2 * far, 0))
            best[which] = np.partition(np.concatenate((best[which], far), axis=1), k - 1, axis=1)[:, :k]
            q, at = np.nonzero(far <= (best[which].max(axis=1) + doubt[which])[:, None])
            held.append((which[q], part[at], far[q, at]))
            waiting += len(q)
            if waiting > HELD:
                held = [sift()]
                waiting = 0

        for name in np.unique(first):
            which = np.flatnonzero((first == name).any(axis=1))
            visit(which, name)
            done[which, name] = True
        for name in np.argsort(low.mean(axis=0)):
            worst = best.max(axis=1)
            if by_product:
                worst = np.sqrt(np.maximum(squares + own.max() + 2 * worst, 0))
            which = np.flatnonzero(~done[:, name] & (low[:, name] <= worst + slack))
            if len(which):
                visit(which, name)
        return *sift(), seen


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


class Shard:
    """A shard's tree over its distinct vectors, with the rows of each."""

    def __init__(self, names: np.ndarray, ids: np.ndarray, none: np.ndarray, copies: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.vectors, point = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((names, ids, none, point.reshape(-1)))
        point = point.reshape(-1)[order]
        begin = np.searchsorted(point, np.arange(len(self.vectors) + 1))
        # k + 1 rows of a point are enough: the query's own may be among them
        before = np.cumsum(copies[order]) - copies[order]
        few = before - before[begin[point]] <= k
        self.names, self.ids, self.none, self.copies = (x[order][few] for x in (names, ids, none, copies))
        self.begin = np.searchsorted(point[few], np.arange(len(self.vectors) + 1))
        scaled = self.vectors / np.abs(self.vectors).max()
        squares = (scaled**2).sum(1)
        self.tree = Tree(np.column_stack((scaled, np.sqrt(np.maximum(squares.max() - squares, 0)))))

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """(query's name, id, whether it is none, score) of this shard's nearest, in order."""
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        at, point, _, _ = self.tree.search(np.column_stack((scaled, np.zeros(len(queries)))), k + 1, factor, by_product=True)
        # summed component by component, so the last digit is the same whatever the batch, and equal vectors tie
        score = np.zeros(len(at))
        for i in range(queries.shape[1]):
            score += self.vectors[point, i] * queries[at, i]
        sizes = np.diff(self.begin)[point]
        row = np.arange(sizes.sum()) + np.repeat(self.begin[point] - np.cumsum(sizes) + sizes, sizes)
        at, score = np.repeat(at, sizes), np.repeat(score, sizes)
        copies = self.copies[row] - (self.names[row] == names[at])
        order = np.lexsort((self.ids[row], self.none[row], -score, at))
        order = order[copies[order] > 0]
        at, score, row, copies = at[order], score[order], row[order], copies[order]
        before = np.cumsum(copies) - copies
        rank = before - before[np.searchsorted(at, at)]
        times = np.clip(k - rank, 0, copies)
        return tuple(np.repeat(x, times) for x in (names[at], self.ids[row], self.none[row], score))


def _search_shards(k: int, factor: float):
    """Arrow map over (shard, kind, name, id, copies, vector) sorted by shard
    and kind: a shard's vectors come first and are kept, its queries stream by
    in blocks."""

    def table(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        flat = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = batch.column(3)
        plain = [batch.column(i).to_numpy() for i in (0, 1, 2)]
        return *plain, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), flat.reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, kind, *rest = table(batch)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)]):
                if shard[a] != now:
                    now, held, tree = shard[a], [], None
                if kind[a] == 0:
                    held.append([x[a:b] for x in rest])
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = Shard(*(np.concatenate(x) for x in zip(*held)), k)
                    held = []
                for at in range(a, b, QUERY_BLOCK):
                    part = slice(at, min(b, at + QUERY_BLOCK))
                    name, ids, none, score = tree.nearest(rest[0][part], rest[4][part], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(ids, mask=none), pa.array(score)], names=["name", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: float = FACTOR,
    key: str = "vec_id",
    column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for
    which ``is_query`` holds, by inner product, among all rows but its own.

    Ties go to the smaller id. Every valid row is indexed, in shards of about
    ``shard_rows``; each shard's tree is built once, in one task, and all
    queries stream past it in blocks. Each shard gives at most k rows a query.
    Equal rows are searched for once and their result is repeated.
    """
    if factor < 1 or k < 1:
        raise ValueError("factor and k must be at least 1")
    rows = vectors.where(valid(F.col(quoted(column)))).select(
        F.col(quoted(key)).cast("long").alias("id"),
        # a negative zero is a zero
        F.transform(F.col(quoted(column)).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    once = rows.groupBy("id", "vector", "query").agg(F.count(F.lit(1)).alias("copies"))
    rows, _ = written(once.withColumn("name", F.monotonically_increasing_id()), "vectors")
    bound = rows.groupBy(F.size("vector").alias("width")).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n"), "width").first()
    n, width = (bound["rows"], bound["width"]) if bound else (0, 0)
    shards = max(1, -(-n // shard_rows))
    rows = rows.where(F.size("vector") == F.lit(width))
    laid = ("name", "id", "copies", "vector")
    stored = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), *laid)
    asked = rows.where("query").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), *laid)
    dealt = stored.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "name")
    found = dealt.mapInArrow(_search_shards(k, factor), "name long, vec_id long, score double")
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = rows.where("query").select(F.col("name").alias("asked"), F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return ranked.join(told, F.col("name") == F.col("asked")).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20) -> str:
    """DuckDB SQL of the query by brute force over all pairs of rows."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(v.x, q.x) AS score FROM v q JOIN v ON q.row <> v.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
