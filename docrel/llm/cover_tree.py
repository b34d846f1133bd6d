"""Exact top-k inner-product search with cover trees over queries and data.

Vectors are dealt to the cells of a bounded set of pivots, cells to blocks of bounded size, and each block is indexed
by a cover tree once. Query vectors, one per distinct vector, are blocked and indexed the same way. A block of queries
first searches the data blocks of its own cell; its worst kth score there bounds what any other cell must offer, so
whole cells are ruled out by centre and covering radius before anything is sent. What remains is joined by cell and
searched tree against tree: a pair of nodes is dropped when
    <cq, cd> + Rq |cd| + Rd |cq| + Rq Rd  <  the worst kth score in the query node.
Only block pairs meet, never all pairs of rows. Equal vectors are kept k + 1 times at most (smallest ids), which is
all that a top-k can show of them.

Vectors that are null or empty, hold null or non-finite components, or have no id take no part; a query sees only
vectors of its own length. Ties go to the smaller id. An id that repeats stays a candidate for each of its rows.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Bounds: pivots (and so cells), rows of a data block, of a query block, of a tree's leaf.
MOST_PIVOTS, DATA_ROWS, QUERY_ROWS, LEAF = 1024, 4096, 512, 64
BLOCK = "cell int, dim int, radius double, rows long, tree binary"


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    start: int
    end: int
    children: list


class CoverTree:
    """Each child covers, within half its parent's radius, what no earlier sibling covers; a node's own centre is its
    first child's. Nodes that fall apart into mostly single points stay leaves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.order: list[np.ndarray] = []
        self.at = 0
        x = points.astype(np.float64)
        every = np.arange(len(x))
        self.root = self._node(x, every, 0, np.sqrt(((x - x[0]) ** 2).sum(1)))
        order = np.concatenate(self.order)
        self.ids, self.points = ids[order], points[order]
        del self.order

    def _node(self, x, rows, centre, far) -> Node:
        radius, start = float(far.max()), self.at
        groups = []
        if len(rows) > LEAF and radius > 0:
            rest, centre_now, to = rows, centre, far
            while len(rest):
                near = to <= radius / 2
                groups.append((rest[near], centre_now, to[near]))
                rest = rest[~near]
                if len(groups) > len(rows) // 8:
                    groups = []
                    break
                if len(rest):
                    centre_now = rest[0]
                    to = np.sqrt(((x[rest] - x[centre_now]) ** 2).sum(1))
        if not groups:
            self.order.append(rows)
            self.at += len(rows)
            children = []
        else:
            children = [self._node(x, *g) for g in groups]
        return Node(x[centre], float(np.sqrt((x[centre] ** 2).sum())), radius, start, self.at, children)


class DualSearch:
    """The k best of one data tree for every query of one query tree, by score, then smaller id."""

    def __init__(self, queries: CoverTree, k: int, floor: float = -math.inf):
        n = len(queries.ids)
        self.q, self.k = queries, k
        self.scores = [np.zeros(0, np.int64)] * n
        self.found = [np.zeros(0, np.int64)] * n
        self.worst = np.full(n, floor)
        self.floor = floor
        self.pruned = 0

    def run(self, data: CoverTree) -> None:
        self.d = data
        span = np.abs(data.points).max(initial=0).astype(float) * np.abs(self.q.points).max(initial=0) * data.points.shape[1]
        kind = np.float64 if span < 2**52 else np.int64
        self.dx, self.qx = data.points.astype(kind), self.q.points.astype(kind)
        self.norms = np.sqrt((data.points.astype(np.float64) ** 2).sum(1))
        self._visit(self.q.root, data.root)

    def _bound(self, q: Node, d: Node) -> float:
        b = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
        return b + 1e-9 * abs(b) + 1e-6

    def _visit(self, q: Node, d: Node) -> None:
        if self._bound(q, d) < self.worst[q.start : q.end].min():
            self.pruned += 1
            return
        if d.children and (not q.children or d.radius >= q.radius):
            for child in sorted(d.children, key=lambda c: -self._bound(q, c)):
                self._visit(q, child)
        elif q.children:
            for child in q.children:
                self._visit(child, d)
        else:
            self._leaves(q, d)

    def _leaves(self, q: Node, d: Node) -> None:
        bound = self.dx[d.start : d.end] @ q.centre + q.radius * self.norms[d.start : d.end]
        near = d.start + np.flatnonzero(bound + 1e-9 * np.abs(bound) + 1e-6 >= self.worst[q.start : q.end].min())
        if not len(near):
            return
        scores = self.qx[q.start : q.end] @ self.dx[near].T
        for row in np.flatnonzero((scores >= self.worst[q.start : q.end, None]).any(1)):
            at, line = q.start + row, scores[row]
            new = np.flatnonzero(line >= self.worst[at])
            score = np.concatenate([self.scores[at], line[new].astype(np.int64)])
            ids = np.concatenate([self.found[at], self.d.ids[near[new]]])
            best = np.lexsort((ids, -score))[: self.k]
            self.scores[at], self.found[at] = score[best], ids[best]
            if len(best) == self.k:
                self.worst[at] = max(self.floor, float(score[best[-1]]))

    def rows(self) -> pd.DataFrame:
        n = [len(s) for s in self.scores]
        return pd.DataFrame({"query": np.repeat(self.q.ids, n), "vec_id": np.concatenate(self.found), "score": np.concatenate(self.scores)})


def whole_vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector): components times ``scale``, rounded down."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    sound = df.where(F.col("vec_id").isNotNull() & (F.size(x) > 0)).where(F.coalesce(finite, F.lit(False)))
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))


def blocks(vectors: DataFrame, id_column: str, pivots: dict[int, np.ndarray], most_rows: int) -> DataFrame:
    """One row per block: its cell, length of vectors, covering radius around the cell's pivot, and its tree."""

    def deal(batches):
        for batch in batches:
            out = []
            for dim, part in batch.groupby(batch["vector"].map(len), sort=False):
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                p = pivots.get(dim)
                if p is None:
                    cell = np.zeros(len(x), np.int32)
                else:
                    cell = ((p**2).sum(1)[None] - 2 * x @ p.T).argmin(1).astype(np.int32)
                out.append(part.assign(cell=cell, dim=np.int32(dim)))
            if out:
                yield pd.concat(out)[[id_column, "vector", "cell", "dim"]]

    dealt = vectors.select(id_column, "vector").mapInPandas(deal, f"{id_column} long, vector array<long>, cell int, dim int").persist()
    sizes = {(r["cell"], r["dim"]): math.ceil(r["count"] / most_rows) for r in dealt.groupBy("cell", "dim").count().collect()}
    cuts = F.create_map(*[F.lit(v) for (c, d), n in sizes.items() for v in (f"{c}/{d}", n)]) if sizes else F.create_map(F.lit(""), F.lit(1))
    part = F.pmod(F.xxhash64(id_column), cuts[F.concat_ws("/", "cell", "dim")])

    def index(key, rows: pd.DataFrame) -> pd.DataFrame:
        cell, dim, _ = key
        x = np.stack(rows["vector"].to_numpy())
        x = x.astype(np.int32) if np.abs(x).max() < 2**31 else x
        ids = rows[id_column].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        tree = CoverTree(ids[order], x[order])
        p = pivots.get(dim)
        p = np.zeros(dim) if p is None else p[cell]
        far = np.sqrt(((x - p) ** 2).sum(1))
        return pd.DataFrame({"cell": [cell], "dim": [dim], "radius": [float(far.max())], "rows": [len(x)], "tree": [pickle.dumps(tree)]})

    out = materialize(dealt.withColumn("part", part).groupBy("cell", "dim", "part").applyInPandas(index, BLOCK))
    dealt.unpersist()
    return out


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: (query_tree, floor, tree)."""

    def run(batches):
        for batch in batches:
            for q, floor, d in zip(batch["query_tree"], batch["floor"], batch["tree"], strict=True):
                search = DualSearch(pickle.loads(q), k, floor)
                search.run(pickle.loads(d))
                yield search.rows()

    return pairs.select("query_tree", "floor", "tree").mapInPandas(run, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 2) -> DataFrame:
    """queries: rows of vectors (vec_id, vector). Returns query_id, rank, vec_id, score without the query's own id."""
    spark = vectors.sparkSession
    first = Window.partitionBy("vector").orderBy("vec_id")
    data = vectors.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).drop("__n")
    data, asked = materialize(data), materialize(queries.groupBy("vector").agg(F.min("vec_id").alias("query")))
    total = data.count()
    sample = data.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(min(MOST_PIVOTS, max(1, total // 2048))).collect()
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(len(r["vector"]), []).append(r["vector"])
    pivots = {d: np.array(p, np.float64) for d, p in pivots.items()}
    data_blocks = blocks(data, "vec_id", pivots, DATA_ROWS)
    query_blocks = blocks(asked, "query", pivots, QUERY_ROWS).withColumnRenamed("tree", "query_tree").withColumn("block", F.monotonically_increasing_id())
    query_blocks = materialize(query_blocks)

    home = materialize(best(search_pairs(query_blocks.withColumn("floor", F.lit(-math.inf)).join(data_blocks.select("cell", "dim", "tree"), ["cell", "dim"]), k + 1), k + 1))
    kth = home.where(F.col("rank") == k + 1).select("query", F.col("score").cast("double").alias("kth"))
    cells = [tuple(r) for r in data_blocks.groupBy("cell", "dim").agg(F.max("radius")).collect()]

    def members(batches):
        for batch in batches:
            for block, tree in zip(batch["block"], batch["query_tree"], strict=True):
                yield pd.DataFrame({"block": block, "query": pickle.loads(tree).ids})

    in_block = query_blocks.select("block", "query_tree").mapInPandas(members, "block long, query long")
    floors = in_block.join(kth, "query", "left").groupBy("block").agg(F.min(F.coalesce("kth", F.lit(-math.inf))).alias("floor"))

    def reach(batches):
        """The other cells that may hold a better score for some query of the block."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                root = pickle.loads(row.query_tree).root
                for cell, dim, radius in cells:
                    if dim != row.dim or cell == row.cell:
                        continue
                    p = pivots[dim][cell] if dim in pivots else np.zeros(dim)
                    bound = float(root.centre @ p) + root.radius * float(np.sqrt((p**2).sum())) + radius * (root.norm + root.radius)
                    if bound + 1e-9 * abs(bound) + 1e-6 >= row.floor:
                        out.append((cell, dim, row.query_tree, row.floor))
            yield pd.DataFrame(out, columns=["cell", "dim", "query_tree", "floor"])

    others = query_blocks.join(floors, "block").select("cell", "dim", "query_tree", "floor").mapInPandas(reach, "cell int, dim int, query_tree binary, floor double")
    away = search_pairs(others.join(data_blocks.select("cell", "dim", "tree"), ["cell", "dim"]), k + 1)
    found = best(home.select("query", "vec_id", "score").unionAll(away), k + 1).drop("rank")
    named = queries.select(F.col("vec_id").alias("query_id"), "vector").join(asked, "vector").select("query_id", "query")
    own = named.join(found, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) as bigint) as score
  from v as q join v on v.vec_id <> q.vec_id and len(v.x) = len(q.x) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
