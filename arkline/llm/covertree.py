"""Exact top-k search by inner product with dual cover trees.

Vectors fall into regions around a few of them, regions into shells by their distance from
that pivot, and shells that are still large split by hash into blocks of about BLOCK rows, so a
vector that a third of the rows hold fills many equal blocks. Every block of rows and every
block of queries gets a cover tree by levels: level i is a net of radius R / 2**i, which holds
the net before it (nesting), whose points are further apart than that radius (separation) and
which has a point within it of every vector (covering); a net point's parent is the nearest of
the level above. All levels come from one farthest-first order. Points with fewer than SMALL
below them are kept together, as a node's bundle, and scored at once.

Queries and rows are searched together: a pair of nodes with centres a, b and covering radii
r, s cannot score above a.b + r|b| + s|a| + r s, and is dropped if that is below the worst kth
score so far of the queries in its query node. The same bound drops whole pairs of blocks:
each query block first searches its most promising block and carries its queries' kth scores
to the rest, which then stream by it in order of their bounds, PER_TASK blocks a task; a task
keeps k rows a query.

Vectors without structure (in many dimensions, at nearly equal distances) leave nothing to
prune: every row is then scored, block by block.

Scores are exact integers: float64 products while these stay below 2**53, else Python's
integers; one that needs more than 64 bits raises. The index holds every row. The pivots of
regions are a bounded sample and only steer which rows share a block.

Defined results: rows with a null id, a null vector, or a null or non-finite component take
no part; rows with the query's id are its own and no candidates for it; a query id that
repeats is one query, by the vector that is first in byte order; candidates that repeat
count each; vectors of unequal length compare as if filled up with zeros; empty vectors
score 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

BLOCK = 1024
QUERY_BLOCK = 1024
PIVOTS = 1024
SHELLS = 64
PER_TASK = 64
SCAN = 512
SMALL = 16
EXACT = float(1 << 53)


@dataclass
class Node:
    """A net point of a level with all that is below it: lo:hi of the tree's order, of which lo:bundle
    belong to no child: itself, if nothing deeper is its own, and small subtrees."""

    center: int
    radius: float
    level: int
    lo: int
    hi: int
    bundle: int
    children: list = field(default_factory=list)


class CoverTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray):
        norms = (points * points).sum(1)
        squares = norms[:, None] + norms[None, :] - 2 * (points @ points.T)
        apart = np.sqrt(np.maximum(squares, 0))
        n, start = len(ids), int(apart.max(1).argmin())
        self.top = float(apart[start].max())
        # farthest first: entered[k] is how far the kth point was from those before it
        nearest, greedy, entered = apart[start].copy(), [start], [np.inf]
        nearest[start] = -1
        while len(greedy) < n and nearest.max() > 0:
            far = int(nearest.argmax())
            greedy.append(far)
            entered.append(float(nearest[far]))
            nearest = np.minimum(nearest, apart[far])
            nearest[far] = -1
        copies = np.flatnonzero(nearest == 0)  # of a net point: further rows of its bundle
        entered = np.array(entered)
        # level i holds the points that entered beyond top / 2**i
        level = np.zeros(len(greedy), np.int64)
        if len(greedy) > 1:
            level[1:] = np.floor(np.log2(self.top / entered[1:])).astype(np.int64) + 1
            level[1:] += self.top / np.exp2(level[1:]) >= entered[1:]  # rounding
        self.net = list(zip(greedy, level.tolist(), strict=True))
        below: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, len(greedy)):
            above = greedy[: int(np.searchsorted(level, level[k], side="left"))]
            below[above[int(apart[greedy[k], above].argmin())]].append(k)
        twins: list[list[int]] = [[] for _ in range(n)]
        for c in copies.tolist():
            twins[greedy[int(apart[c, greedy].argmin())]].append(c)
        self._made = greedy, level, below, twins, apart, 4e-8 * float(np.sqrt(norms.max(initial=0)))
        self.order: list[int] = []
        self.root = self._node(start, [(k, int(level[k])) for k in below[start]], 0)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.parent = {int(place[greedy[k]]): int(place[p]) for p in range(n) for k in below[p]}
        self.levels = {int(place[g]): int(v) for g, v in self.net}
        self.ids, self.points = ids[self.order], points[self.order]
        stack = [self.root]
        while stack:
            node = stack.pop()
            node.center = int(place[node.center])
            stack += node.children
        self.norms = np.sqrt((self.points * self.points).sum(1))
        del self.order, self.net, self._made

    def _subtree(self, center: int, most: int) -> list[int] | None:
        """All that is below a net point with itself, or None if that is more than most."""
        greedy, _, below, twins, _, _ = self._made
        found, stack = [], [center]
        while stack:
            c = stack.pop()
            found += [c, *twins[c]]
            if len(found) > most and below[c]:
                return None
            stack += [greedy[k] for k in below[c]]
        return found if len(found) <= most or not below[center] else None

    def _node(self, center: int, own: list[tuple[int, int]], level: int) -> Node:
        """center with its net points from ``own`` on (numbers in greedy order, with their levels)."""
        greedy, levels, below, twins, apart, slack = self._made
        node = Node(center, 0.0, level, len(self.order), 0, 0)
        next_level = min((v for _, v in own), default=level)
        rest = [(k, v) for k, v in own if v > next_level]
        parts = []
        for c in (greedy[k] for k, v in own if v == next_level):
            small = self._subtree(c, SMALL)
            if small is None:
                parts.append((c, [(k, int(levels[k])) for k in below[c]]))
            else:
                self.order += small
        if not rest:
            self.order += [center, *twins[center]]
        node.bundle = len(self.order)
        if rest:
            parts.append((center, rest))
        for c, deeper in parts:
            node.children.append(self._node(c, deeper, next_level))
        node.hi = len(self.order)
        node.radius = float(apart[center, self.order[node.lo : node.hi]].max()) + slack
        return node

    def packed(self) -> bytes:
        """A pickle with the points in the smallest type that holds them."""
        small = next((k for k in (np.int16, np.int32) if (self.points == self.points.astype(k)).all()), np.float64) if np.abs(self.points).max(initial=0) < 1 << 31 else np.float64
        state = dict(self.__dict__, points=self.points.astype(small), parent=None, levels=None)
        return pickle.dumps(state, protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(data))
        tree.points = tree.points.astype(np.float64)
        return tree


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Search:
    """The k best rows for each query of a tree, from any number of trees of rows. floor: what a
    query's kth score is known to reach already. scored: pairs whose product was taken."""

    def __init__(self, queries: CoverTree, k: int, floor: np.ndarray):
        self.q, self.k, self.exact, self.scored = queries, k, True, 0
        n = len(queries.ids)
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor

    def run(self, rows: CoverTree) -> None:
        width = max(self.q.points.shape[1], rows.points.shape[1])
        self.x, self.qp, self.xp = rows, _widened(self.q.points, width), _widened(rows.points, width)
        top = max(np.abs(self.qp).max(initial=0), np.abs(self.xp).max(initial=0))
        exact = top * top * max(width, 1) < EXACT
        if self.exact and not exact:  # from here on Python's integers
            self.score, self.floor = self.score.astype(object), self.floor.astype(object)
        self.exact &= exact
        if not self.exact:
            self.qi, self.xi = (np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in (self.qp, self.xp))
        self._pair(self.q.root, rows.root)

    def worst(self, node: Node):
        own = slice(node.lo, node.hi)
        return np.maximum(self.score[own, -1], self.floor[own]).min()

    def bound(self, a: Node, b: Node, dot: float) -> float:
        value = dot + a.radius * self.x.norms[b.center] + b.radius * self.q.norms[a.center] + a.radius * b.radius
        return value + 1e-9 * (abs(value) + 1)

    def _pair(self, a: Node, b: Node) -> None:
        if self.bound(a, b, float(self.qp[a.center] @ self.xp[b.center])) < self.worst(a):
            return
        if not a.children and not b.children:
            self._scan(slice(a.lo, a.hi), slice(b.lo, b.hi), a)
        elif not b.children or a.children and a.radius > b.radius:
            if a.bundle > a.lo:
                self._pair(Node(a.center, a.radius, a.level, a.lo, a.bundle, a.bundle), b)
            for child in a.children:
                self._pair(child, b)
        else:
            parts = list(b.children)
            if b.bundle > b.lo:
                parts.append(Node(b.center, b.radius, b.level, b.lo, b.bundle, b.bundle))
            dots = self.xp[[p.center for p in parts]] @ self.qp[a.center]
            for i in sorted(range(len(parts)), key=lambda i: -self.bound(a, parts[i], float(dots[i]))):
                self._pair(a, parts[i])

    def _scan(self, own: slice, rows: slice, a: Node) -> None:
        for begin in range(rows.start, rows.stop, SCAN):
            part = slice(begin, min(rows.stop, begin + SCAN))
            self.scored += (own.stop - own.start) * (part.stop - part.start)
            got = self.qp[own] @ self.xp[part].T if self.exact else self.qi[own] @ self.xi[part].T
            ids = self.x.ids[part]
            got = np.where(self.q.ids[own][:, None] == ids[None, :], -np.inf, got)
            better = np.flatnonzero((got.max(1) >= np.maximum(self.score[own, -1], self.floor[own])).astype(bool))
            if not len(better):
                continue
            at = better + own.start
            score = np.concatenate([self.score[at], got[better]], 1)
            number = np.concatenate([self.id[at], np.broadcast_to(ids, (len(better), len(ids)))], 1)
            if self.exact:
                order = np.lexsort((number, -score), axis=-1)[:, : self.k]
            else:
                order = np.array([sorted(range(score.shape[1]), key=lambda j, r=r: (-score[r, j], number[r, j]))[: self.k] for r in range(len(at))])
            self.score[at] = np.take_along_axis(score, order, 1)
            self.id[at] = np.take_along_axis(number, order, 1)

    def found(self) -> Iterator[tuple[int, int, int]]:
        for i, query in enumerate(self.q.ids.tolist()):
            for s, x in zip(self.score[i], self.id[i], strict=True):
                if s != -np.inf and s >= self.floor[i]:
                    yield query, int(x), int(s)


# ---------------------------------------------------------------- Spark


def quantised(df: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """_id and _v: the vector's floor(factor * x) as float64 bytes, of the rows that take part."""
    source = df.select(df[id_col].cast("long").alias("_id"), df[vector_col].cast("array<double>").alias("_v")).where("_id IS NOT NULL AND _v IS NOT NULL")

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = v.values.to_numpy(zero_copy_only=False) if v.values.null_count == 0 else None
                if a is None or not np.isfinite(a).all() or not np.isfinite(a * factor).all():
                    continue
                ids.append(i)
                out.append(np.floor(a * factor).astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["_id", "_v"])

    return source.mapInArrow(run, "_id long, _v binary")


def _matrix(values) -> np.ndarray:
    rows = [np.frombuffer(v, np.float64) for v in values]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _with_region(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with their nearest pivot and the distance from it."""
    norms = (pivots * pivots).sum(1)

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(1).to_pylist())
            width = max(m.shape[1], pivots.shape[1])
            squares = norms[None, :] - 2 * (_widened(m, width) @ _widened(pivots, width).T)
            near = squares.argmin(1) if len(m) else np.zeros(0, np.int64)
            apart = np.sqrt(np.maximum(squares[np.arange(len(m)), near] + (m * m).sum(1), 0)) if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(apart, pa.float64())], names=["_id", "_v", "_region", "_apart"])

    return vectors.mapInArrow(run, "_id long, _v binary, _region int, _apart double")


def _blocks(rows: DataFrame, size: int, name: str, space: Workspace) -> DataFrame:
    """A row for each block: its number, tree, centre and radius. Of each region SHELLS quantiles, and
    of each shell a count, come to the driver: at most PIVOTS x SHELLS numbers."""
    spark = rows.sparkSession
    rows = space.table(rows)
    steps = F.percentile_approx("_apart", [i / SHELLS for i in range(1, SHELLS)], 1000).alias("q")
    regions = rows.groupBy("_region").agg(F.count("*").alias("n"), steps).collect()
    ends = {r["_region"]: [r["q"][round(SHELLS * i / m) - 1] for i in range(1, m)] for r in regions for m in [min(SHELLS, -(-r["n"] // size))]}
    borders = F.broadcast(spark.createDataFrame(list(ends.items()), "_r int, _ends array<double>"))
    shelled = rows.join(borders, F.col("_region") == F.col("_r")).select("_id", "_v", "_region", F.size(F.filter("_ends", lambda e: e < F.col("_apart"))).alias("_shell"))
    counts = [(r[0], r[1], -(-r[2] // size)) for r in shelled.groupBy("_region", "_shell").count().collect()]
    parts = F.broadcast(spark.createDataFrame(counts, "_r int, _s int, _parts int"))
    number = (F.col("_region").cast("long") * SHELLS + F.col("_shell")) * (1 << 32) + F.pmod(F.xxhash64("_id", "_v"), F.col("_parts"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "_v"])
        tree = CoverTree(group["_id"].to_numpy(np.int64), _matrix(group["_v"]))
        root = tree.root
        return pd.DataFrame({"block": [int(group["_block"].iloc[0])], "tree": [tree.packed()], "center": [tree.points[root.center].tolist()], "radius": [root.radius]})

    dealt = shelled.join(parts, (F.col("_region") == F.col("_r")) & (F.col("_shell") == F.col("_s"))).select("_id", "_v", number.alias("_block"))
    built = dealt.groupBy("_block").applyInPandas(build, "block long, tree binary, center array<double>, radius double")
    return space.table(built.select(*[F.col(c).alias(f"{name}_{c}") for c in built.columns]))


_STREAM = ("q_block", "shard", "place", "tree", "floors")


def _searched(pairs: DataFrame, q: DataFrame, x: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """The best rows, at most k a query and task, of pairs (q_block, x_block, place). A task gets a
    query block's tree first and then its blocks of rows by place."""
    nothing = F.lit(None).cast("array<struct<id: long, score: long>>")
    pairs = pairs.select("q_block", "x_block", "place", F.expr(f"place div {PER_TASK}").alias("shard"))
    head = pairs.select("q_block", "shard").distinct().join(q.select("q_block", F.col("q_tree").alias("tree")), "q_block")
    head = head.withColumn("floors", nothing) if floors is None else head.join(floors.select("q_block", "floors"), "q_block")
    body = pairs.join(x.select("x_block", F.col("x_tree").alias("tree")), "x_block").withColumn("floors", nothing)
    rows = head.withColumn("place", F.lit(-1).cast("long")).select(*_STREAM).unionByName(body.withColumn("place", F.col("place").cast("long")).select(*_STREAM))
    rows = rows.repartition("q_block", "shard").sortWithinPartitions("q_block", "shard", "place")

    def run(batches):
        search = None

        def found():
            return pd.DataFrame(list(search.found()), columns=["query_id", "vec_id", "score"]).astype("int64")

        for batch in batches:
            for place, tree, known in zip(batch["place"].to_pylist(), batch["tree"], batch["floors"], strict=True):
                tree = CoverTree.unpacked(tree.as_py())
                if place < 0:
                    if search is not None:
                        yield pa.RecordBatch.from_pandas(found(), preserve_index=False)
                    known = {f["id"]: f["score"] for f in known.as_py() or ()}
                    search = Search(tree, k, np.array([known.get(i, -np.inf) for i in tree.ids.tolist()]))
                else:
                    search.run(tree)
        if search is not None:
            yield pa.RecordBatch.from_pandas(found(), preserve_index=False)

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, space: Workspace, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 1.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to the smaller id."""
    vectors = space.table(quantised(df, id_col, vector_col, factor))
    wanted = quantised(queries, id_col, vector_col, factor).groupBy("_id").agg(F.min("_v").alias("_v"))
    total = vectors.count()
    count = max(1, min(PIVOTS, round((total / BLOCK) ** 0.5)))
    pivots = _matrix([bytes(r[0]) for r in vectors.orderBy(F.xxhash64("_id"), "_id", "_v").limit(count).select("_v").collect()])
    if not total:
        pivots = np.zeros((1, 0))
    x = _blocks(_with_region(vectors, pivots), BLOCK, "x", space)
    q = _blocks(_with_region(wanted, pivots), QUERY_BLOCK, "q", space)
    # the stated queries against all rows, in blocks: summaries of blocks meet, not rows
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: F.coalesce(u, F.lit(0.0)) * F.coalesce(v, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(dot(a, a))
    value = dot(F.col("q_center"), F.col("x_center")) + F.col("q_radius") * norm(F.col("x_center")) + F.col("x_radius") * norm(F.col("q_center")) + F.col("q_radius") * F.col("x_radius")
    met = q.drop("q_tree").crossJoin(x.drop("x_tree")).withColumn("bound", value + 1e-6 * (F.abs(value) + 1))
    place = F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("bound"), "x_block"))
    pairs = space.table(met.select("q_block", "x_block", "bound", place.alias("place")))
    first = space.table(_searched(pairs.where("place = 1"), q, x, None, k))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = _members(q).join(kth, F.col("member") == F.col("query_id"), "left").groupBy("q_block").agg(F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias("least"), F.collect_list(F.when(F.col("floor").isNotNull(), F.struct(F.col("member").alias("id"), F.col("floor").alias("score")))).alias("floors"))
    floors = space.table(floors)
    rest = pairs.where("place > 1").join(floors.select("q_block", "least"), "q_block").where(F.col("bound") >= F.col("least"))
    second = space.table(_searched(space.table(rest.select("q_block", "x_block", "place")), q, x, floors, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(q: DataFrame) -> DataFrame:
    """q_block and member, a row for each query of a block of at most about QUERY_BLOCK."""

    def run(batches):
        for batch in batches:
            for block, tree in zip(batch["q_block"], batch["q_tree"], strict=True):
                ids = CoverTree.unpacked(tree).ids
                yield pd.DataFrame({"q_block": np.full(len(ids), block), "member": ids})

    return q.select("q_block", "q_tree").mapInPandas(run, "q_block long, member long")


def op2(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0), Workspace(spark, "topk"), factor=64.0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
