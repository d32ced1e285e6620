"""Exact top-k inner-product search: KD-trees per shard.

Equal rows are counted first, so copies weigh once. Vectors are dealt into shards by a few median splits, learned
from a bounded sample (`SAMPLE` rows; it decides only who is dealt with whom), and leaves of over `shard_rows`
rows further by hash. Each shard's KD-tree (median splits, tight bounding boxes) is built once and written: points
in tree order, ids, boxes. A query searches its home shard best first: nodes by the largest inner product that
their box allows, until that is below the k-th best score so far. Then the k-th score found goes with the query
against the boxes of all shards, in blocks of both, and only to shards whose box allows at least that score. Ties go
on, so equal scores with smaller ids are found.

A task holds one shard's tree with at most about `block_rows` queries, or blocks of boxes and of queries. All
arithmetic is on integers (int64; exact Python integers where a product might not fit).

Defined results: rows whose vector is null or holds a null or non-finite component take no part, nor do
rows without an id; vectors of another length than the query's are no candidates. Repeated rows of other
ids are candidates each; all rows with the query's id count as its own; a repeated query is answered
once. A score beyond 64 bits raises. Only the named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

LEAF = 64
#: Vectors that the dealing into shards is learned from, and how many of them each of its leaves has at least.
SAMPLE, LEAF_SAMPLE = 16384, 16
#: Boxes of shards that one task holds.
BOXES = 2048


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 1024.0) -> DataFrame:
    """vec_id and v, the components as floor(factor * x); unusable rows are left out."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", F.transform("x", lambda x: F.floor(x * factor).cast("long")).alias("v"))


class KDTree:
    """Median splits on the widest dimension; every node keeps the tight box of its points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, copies: np.ndarray | None = None, leaf: int = LEAF):
        copies = np.ones(len(ids), np.int64) if copies is None else copies
        order = np.lexsort((ids,))
        self.start, self.end, self.child, lows, highs = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = len(self.start)
            if parent >= 0:
                self.child[parent].append(at)
            mine = points[order[a:b]]
            low, high = (mine.min(axis=0), mine.max(axis=0)) if b > a else (np.zeros(points.shape[1]), np.zeros(points.shape[1]))
            self.start.append(a), self.end.append(b), self.child.append([]), lows.append(low), highs.append(high)
            if b - a > leaf and points.shape[1] and (high > low).any():
                axis, mid = int((high.astype(np.float64) - low).argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, axis], mid, kind="introselect")]
                todo += [(a, a + mid, at), (a + mid, b, at)]
        self.points, self.ids, self.copies = points[order], ids[order], copies[order]
        self.low, self.high = np.array(lows), np.array(highs)

    def pack(self) -> dict[str, bytes]:
        kind = np.min_scalar_type(int(-np.abs(self.points).max(initial=1)) - 1) if self.points.dtype != object else np.int64
        nodes = np.array([[a, b, *(c or (-1, -1))] for a, b, c in zip(self.start, self.end, self.child)], np.int64)
        return {"kind": np.dtype(kind).str, "points": self.points.astype(kind).tobytes(), "ids": self.ids.tobytes(), "copies": self.copies.tobytes(), "nodes": nodes.tobytes(), "low": self.low.astype(np.int64).tobytes(), "high": self.high.astype(np.int64).tobytes()}

    @classmethod
    def unpack(cls, row: dict, dim: int) -> KDTree:
        out = cls.__new__(cls)
        out.ids, out.copies = (np.frombuffer(row[c], np.int64) for c in ("ids", "copies"))
        out.points = np.frombuffer(row["points"], np.dtype(row["kind"])).reshape(len(out.ids), dim).astype(np.int64)
        nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 4)
        out.low, out.high = (np.frombuffer(row[c], np.int64).reshape(len(nodes), dim) for c in ("low", "high"))
        out.start, out.end = nodes[:, 0].tolist(), nodes[:, 1].tolist()
        out.child = [[] if x < 0 else [x, y] for x, y in nodes[:, 2:].tolist()]
        return out

    def search(self, q: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to k (score, id) by score descending, then id; none below `least`."""
        bounds = allowed(q, self.low, self.high)
        found: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        queue = [(-bounds[0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            kth = found[0][0] if len(found) == k else None
            floor = kth if least is None else least if kth is None else max(kth, least)
            if floor is not None and -bound < floor:
                break
            if self.child[at]:
                for c in self.child[at]:
                    if floor is None or bounds[c] >= floor:
                        heapq.heappush(queue, (-bounds[c], c))
                continue
            a, b = self.start[at], self.end[at]
            scores, ids = self.points[a:b] @ q, self.ids[a:b]
            good = np.flatnonzero((ids != own) & (scores >= floor if floor is not None else True))
            for i in good:
                x = (int(scores[i]), -int(ids[i]))
                for _ in range(min(int(self.copies[a + i]), k)):
                    if len(found) < k:
                        heapq.heappush(found, x)
                    elif x > found[0]:
                        heapq.heapreplace(found, x)
        return sorted(((s, -i) for s, i in found), key=lambda x: (-x[0], x[1]))


def allowed(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product with q that each box allows."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _fitting(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are, or as exact Python integers where an int64 sum is not safe."""
    most = float(np.abs(points.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(points.shape[-1], 1)
    return (points, queries) if most < 2.0**62 else (points.astype(object), queries.astype(object))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), dim)


def top_splits(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Median splits of the sample into about so many leaves: nodes of (axis, value, left, right); a negative number is a leaf, -1 - its place."""
    nodes: list[list[int]] = []
    done = 0
    todo = [(np.arange(len(sample)), leaves, -1, 0)]
    while todo:
        rows, want, parent, side = todo.pop()
        mine = sample[rows]
        spread = mine.max(axis=0).astype(np.float64) - mine.min(axis=0) if len(rows) else np.zeros(1)
        if want <= 1 or len(rows) < 2 * LEAF_SAMPLE or not spread.size or not spread.max():
            at, done = -1 - done, done + 1
        else:
            axis = int(spread.argmax())
            value = int(np.sort(mine[:, axis])[len(rows) // 2])
            if not (mine[:, axis] < value).any():  # over half are the smallest
                value = int(mine[mine[:, axis] > value, axis].min())
            left = mine[:, axis] < value
            at = len(nodes)
            nodes.append([axis, value, 0, 0])
            todo += [(rows[left], want // 2, at, 2), (rows[~left], want - want // 2, at, 3)]
        if parent >= 0:
            nodes[parent][side] = at
    return [tuple(n) for n in nodes]


def leaves_of(points: np.ndarray, splits: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The leaf of each point."""
    out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))] if splits else []
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -1 - at
        elif len(rows):
            axis, value, left, right = splits[at]
            below = points[rows, axis] < value
            todo += [(left, rows[below]), (right, rows[~below])]
    return out


TREE = "dim int, shard int, kind string, points binary, ids binary, copies binary, nodes binary, low binary, high binary"


def _build(table: pa.Table) -> pa.Table:
    dim, shard = (table.column(c)[0].as_py() for c in ("dim", "shard"))
    tree = KDTree(_matrix(table.column("v"), dim), table.column("vec_id").to_numpy(), table.column("copies").to_numpy())
    packed = tree.pack()
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "kind": [packed.pop("kind")], **{c: pa.array([b], pa.binary()) for c, b in packed.items()}})


def _search(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if trees.num_rows and queries.num_rows:
            dim = trees.column("dim")[0].as_py()
            tree = KDTree.unpack({c: trees.column(c)[0].as_py() for c in trees.column_names}, dim)
            tree.points, q = _fitting(tree.points, _matrix(queries.column("v"), dim))
            if q.dtype == object:
                tree.low, tree.high = tree.low.astype(object), tree.high.astype(object)
            least = queries.column("least").to_pylist()
            for i, own in enumerate(queries.column("query_id").to_pylist()):
                out += [(own, s, c) for s, c in tree.search(q[i], own, k, least[i])]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "score": pa.array([x[1] for x in out], pa.int64()), "vec_id": pa.array([x[2] for x in out], pa.int64())})

    return run


ASKED = "query_id long, v array<long>, dim int, shard int, block int, least long"


def _route(boxes: pa.Table, queries: pa.Table) -> pa.Table:
    """The queries once for each shard, but their home, whose box allows the score that they bring."""
    shards: list[int] = []
    rows: list[int] = []
    if boxes.num_rows and queries.num_rows:
        dim = boxes.column("dim")[0].as_py()
        low, high = (np.stack([np.frombuffer(x, np.int64)[:dim] for x in boxes.column(c).to_pylist()]) for c in ("low", "high"))
        reach, q = _fitting(np.maximum(np.abs(low), np.abs(high)), _matrix(queries.column("v"), dim))
        low, high = low.astype(reach.dtype), high.astype(reach.dtype)
        home, least, there = queries.column("shard").to_pylist(), queries.column("least").to_pylist(), boxes.column("shard").to_numpy()
        for i in range(len(q)):
            ok = there != home[i]
            if least[i] is not None:
                ok = ok & (allowed(q[i], low, high) >= least[i]).astype(bool)
            to = there[ok].tolist()
            shards += to
            rows += [i] * len(to)
    got = queries.select(["query_id", "v", "dim", "block", "least"]).take(pa.array(rows, pa.int64()))
    return got.add_column(3, "shard", pa.array(shards, pa.int32())).cast(pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("dim", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("least", pa.int64())]))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; every task keeps k a query before anything is shuffled (a limit below the window)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def dealt(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """The rows (vec_id, v, dim, ...) with their shard, and how many shards each dimension has."""
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(r.v)
    splits = {d: top_splits(np.array(v, np.int64).reshape(len(v), d), -(-counts[d] // shard_rows)) for d, v in sample.items() if counts[d] > shard_rows}

    def place(batches):
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            v, leaf = b.column(b.schema.get_field_index("v")), np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                leaf[at] = leaves_of(_matrix(v.take(pa.array(at)), int(d)), splits.get(int(d), []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], [*b.schema.names, "leaf"])

    small_batches(rows.sparkSession)
    placed = stored(rows.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", leaf int"), "placed")
    # a row a leaf: SAMPLE / LEAF_SAMPLE at most for each length of vectors
    sizes = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n")).orderBy("dim", "leaf").collect()
    shards: dict[int, int] = {}
    table = []
    for r in sizes:
        parts = -(-r.n // shard_rows)
        table.append((r.dim, r.leaf, shards.get(r.dim, 0), parts))
        shards[r.dim] = shards.get(r.dim, 0) + parts
    if not table:
        return placed.withColumn("shard", F.col("leaf")), shards
    of_leaf = rows.sparkSession.createDataFrame(table, "dim int, leaf int, base int, parts int")
    shard = (F.col("base") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")
    return placed.join(F.broadcast(of_leaf), ["dim", "leaf"]).withColumn("shard", shard).drop("leaf", "base", "parts"), shards


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (vec_id, v) where is_query holds, against all others."""
    single = vectors.select("vec_id", "v", F.size("v").alias("dim"), is_query.alias("asked")).groupBy("vec_id", "v", "dim", "asked").agg(F.count("*").alias("copies"))
    rows, shards = dealt(single, shard_rows)
    trees = stored(rows.groupBy("dim", "shard").applyInArrow(_build, TREE), "trees")
    queries = rows.where("asked")
    blocks = max(1, -(-queries.count() // block_rows))
    block = F.pmod(F.xxhash64("vec_id", F.lit(blocks)), F.lit(blocks)).cast("int").alias("block")
    asked = stored(queries.select(F.col("vec_id").alias("query_id"), "v", "dim", "shard", block, F.lit(None).cast("long").alias("least")), "asked")

    def searched(q: DataFrame) -> DataFrame:
        key = ["dim", "shard", "block"]
        # only where there are queries does a tree go
        there = trees.join(q.select(*key).distinct(), ["dim", "shard"])
        there, q = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (there, q))
        return there.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_search(k), "query_id long, score long, vec_id long")

    at_home = stored(searched(asked), "home")
    if max(shards.values(), default=0) <= 1:
        return _best(at_home, k)
    kth = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = asked.drop("least").join(kth, "query_id", "left")
    # a row a length of vectors
    many = vectors.sparkSession.createDataFrame([(d, -(-n // BOXES)) for d, n in shards.items()], "dim int, parts int")
    boxes = trees.select("dim", "shard", "low", "high", F.floor(F.col("shard") / BOXES).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    spread = known.join(F.broadcast(many), "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    cell = ["dim", "part", "block"]
    boxes, spread = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (boxes, spread))
    away = stored(boxes.groupBy(*cell).cogroup(spread.groupBy(*cell)).applyInArrow(_route, ASKED), "away")
    return _best(at_home.unionByName(searched(away)), k)
