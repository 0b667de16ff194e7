"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a sample of SAMPLE directions at most; every vector is then
sent down it to its leaf. Equal vectors are one row with their SAME smallest
numbers, as no more can be among a query's nearest. Leaves are laid on shelves
of about SHELF vectors, a crowded leaf on several. A query goes through the
tree with a priority queue, always into the nearest subtree that is still
closed, and so meets the leaves in an order of its own. How many it visits is
calibrated: for some of the queries the true nearest are found by brute
force over all vectors, and visits are widened until TARGET of them lie in
the leaves visited. A query goes once to each shelf with leaves that it visits,
where blocks of queries meet blocks of vectors in matrix products, and takes
its best with it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, spread, unplaced

EVERY, NEAREST = 50, 5
#: Sampled directions, children of a node, directions of a leaf, rounds of k-means.
SAMPLE, BRANCHES, LEAF, ROUNDS = 32_768, 16, 128, 8
#: Queries of the calibration, and the share of their true nearest that must be found.
CALIBRATED, TARGET = 256, 0.97
#: Vectors of a shelf, and queries that meet it at once and are dealt together.
SHELF, BLOCK, DEALT = 8192, 512, 1 << 18
#: Numbers kept of equal vectors: a query's own and the nearest ones.
SAME = NEAREST + 1


class Tree(NamedTuple):
    """Nodes as arrays; 0 is the root. first and count: the children, which are
    consecutive; leaf: the leaf's number or -1."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray


def directions(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def split(x: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """The cluster of each row, by k-means on directions; None if they are all alike."""
    different = np.unique(x, axis=0)
    if len(different) < 2:
        return None
    z = different[rng.choice(len(different), min(BRANCHES, len(different)), replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        own = (x @ z.T).argmax(1)
        held = np.unique(own)
        z = np.stack([x[own == j].mean(0) for j in held])
        z = z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
    own = np.unique((x @ z.T).argmax(1), return_inverse=True)[1]
    return own if own.max() > 0 else None


def fit(x: np.ndarray, seed: int = 3) -> Tree:
    """The tree of directions x; nodes of LEAF rows at most aren't split. Leaves are
    numbered from left to right, so that those near one another have near numbers."""
    rng = np.random.default_rng(seed)
    mean = lambda rows: x[rows].mean(0) if len(rows) else np.zeros(x.shape[1])
    centre, first, count, parts = [mean(np.arange(len(x)))], [0], [0], [np.arange(len(x))]
    at = 0
    while at < len(parts):
        own = split(x[parts[at]], rng) if len(parts[at]) > LEAF else None
        if own is not None:
            first[at], count[at] = len(parts), int(own.max()) + 1
            for j in range(count[at]):
                parts.append(parts[at][own == j])
                centre.append(mean(parts[-1]))
                first.append(0)
                count.append(0)
        at += 1
    leaf, stack, n = np.full(len(parts), -1, np.int64), [0], 0
    while stack:
        node = stack.pop()
        if count[node]:
            stack += range(first[node] + count[node] - 1, first[node] - 1, -1)
        else:
            leaf[node], n = n, n + 1
    return Tree(np.array(centre), np.array(first), np.array(count), leaf)


def place(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: always into the nearest child."""
    node = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(tree.count[node])
    while len(open_):
        for parent in np.unique(node[open_]).tolist():
            rows = open_[node[open_] == parent]
            children = slice(tree.first[parent], tree.first[parent] + tree.count[parent])
            z = tree.centre[children]
            node[rows] = tree.first[parent] + ((z * z).sum(1)[None, :] - 2 * x[rows] @ z.T).argmin(1)
        open_ = open_[tree.count[node[open_]] > 0]
    return tree.leaf[node]


def visits(tree: Tree, q: np.ndarray, most: int) -> list[int]:
    """The first leaves that a query meets, best bin first."""
    distance = ((tree.centre - q) ** 2).sum(1).tolist()
    queue, out = [(0.0, 0)], []
    while queue and len(out) < most:
        node = heapq.heappop(queue)[1]
        if tree.count[node]:
            for child in range(tree.first[node], tree.first[node] + tree.count[node]):
                heapq.heappush(queue, (distance[child], child))
        else:
            out.append(int(tree.leaf[node]))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _placed(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = place(tree, directions(_matrix(batch.column("v")))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    return run


def best_of(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of x nearest to each row of q: numbers of queries and rows, and cosines.
    Of the rows found the cosine is summed anew row by row, so that it doesn't hang
    on the block."""
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    scores = q @ x.T
    k = min(k, len(x))
    rows = np.argpartition(-scores, k - 1, axis=1)[:, :k].reshape(-1)
    asked = np.repeat(np.arange(len(q)), k)
    return asked, rows, (q[asked] * x[rows]).sum(1)


def _true(q: np.ndarray):
    """The nearest of a task's vectors to each of a few queries: query, score, leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                asked, rows, scores = best_of(directions(_matrix(batch.column("v"))), q, SAME)
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(scores), batch.column("leaf").take(pa.array(rows))], names=["query", "score", "leaf"])

    return run


def calibrated(tree: Tree, index: DataFrame, q: np.ndarray) -> int:
    """Leaves that a query visits: so many that TARGET of the true nearest of the queries q
    lie in them. The truth comes from all vectors."""
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), "leaf")
    found = index.mapInArrow(_true(q), "query int, score double, leaf int").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= SAME).collect()
    order = [{leaf: i for i, leaf in enumerate(visits(tree, x, 1 << 30))} for x in q]
    # The first is the query's own vector.
    needed = np.sort([order[r["query"]][r["leaf"]] + 1 for r in found if r["nth"] > 1])
    return int(needed[int(np.ceil(TARGET * len(needed))) - 1]) if len(needed) else len(order[0]) if order else 1


class Shelves(NamedTuple):
    """Of each leaf, the first shelf with its vectors and how many there are."""

    first: np.ndarray
    count: np.ndarray


def shelves(sizes: np.ndarray) -> Shelves:
    """Neighbouring leaves share a shelf until it has SHELF vectors; a larger leaf has as
    many shelves of its own as it needs."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    shelf, held = 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > SHELF:
            shelf, held = shelf + 1, 0
        first[leaf], count[leaf] = shelf, max(1, -(-n // SHELF))
        held += n
        if count[leaf] > 1:
            shelf, held = shelf + int(count[leaf]), 0
    return Shelves(first, count)


def _asked(tree: Tree, laid: Shelves, most: int, blocks: int):
    """Queries, once for each shelf that they visit, with the leaves that they visit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = directions(_matrix(batch.column("v"))) if len(batch) else np.zeros((0, 1))
            row, shelf, leaves = [], [], []
            for i, q in enumerate(v):
                met: dict[int, list[int]] = {}
                for leaf in visits(tree, q, most):
                    for s in range(laid.first[leaf], laid.first[leaf] + laid.count[leaf]):
                        met.setdefault(s, []).append(leaf)
                row += [i] * len(met)
                shelf += met.keys()
                leaves += met.values()
            part, n = batch.take(pa.array(row, pa.int32())), len(row)
            block = np.mod(part.column("id1").to_numpy(zero_copy_only=False), blocks) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelf, pa.int64()), pa.array(block, pa.int32()), pa.array(np.ones(n), pa.int32()), part.column("id1"), part.column("id2"), part.column("v"), pa.nulls(n, pa.list_(pa.int64())), pa.array(leaves, pa.list_(pa.int32()))],
                names=["shelf", "block", "kind", "id1", "id2", "v", "ids", "leaves"],
            )

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shelf, block and kind: a shelf's vectors, then its queries."""
    key, kept, x, leaf = None, [], np.zeros((0, 1)), np.zeros(0)

    def nearest(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = directions(_matrix(part.column("v")))
        wanted = [np.array(w) for w in part.column("leaves").to_pylist()]
        flat, owner = np.concatenate(wanted), np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        asked, rows, scores = [], [], []
        for one in np.unique(flat).tolist():
            mine, there = owner[flat == one], np.flatnonzero(leaf == one)
            a, r, s = best_of(x[there], q[mine], SAME)
            asked.append(mine[a])
            rows.append(there[r])
            scores.append(s)
        asked, rows, scores = np.concatenate(asked), np.concatenate(rows), np.concatenate(scores)
        order = np.lexsort((-scores, asked))
        asked, rows, scores = asked[order], rows[order], scores[order]
        nth = np.arange(len(asked)) - np.searchsorted(asked, asked)
        keep = nth < SAME
        asked, rows, scores = asked[keep], rows[keep], scores[keep]
        take = pa.array(asked, pa.int32())
        mark = [[kept[i][c] for i in rows.tolist()] for c in range(3)]
        yield pa.RecordBatch.from_arrays([part.column("id1").take(take), part.column("id2").take(take), pa.array(scores), pa.array(mark[0], pa.int64()), pa.array(mark[1], pa.int64()), pa.array(mark[2], pa.list_(pa.int64()))], names=["id1", "id2", "score", "of1", "of2", "ids"])

    parts: list[np.ndarray] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shelf", "block", "kind")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, own, kind = batch.slice(a, b - a), tuple(keys[a, :2].tolist()), int(keys[a, 2])
            if own != key:
                key, kept, parts, x, leaf = own, [], [], np.zeros((0, 1)), np.zeros(0)
            if kind == 0:
                parts.append(directions(_matrix(part.column("v"))))
                kept += [(i, j, k, n[0]) for i, j, k, n in zip(*(part.column(c).to_pylist() for c in ("id1", "id2", "ids", "leaves")), strict=True)]
                continue
            if parts:
                x, leaf, parts = np.concatenate(parts), np.array([k[3] for k in kept]), []
            for lo in range(0, len(part), BLOCK):
                if len(x):
                    yield from nearest(part.slice(lo, BLOCK))


def _valid(table: DataFrame, vector: str) -> DataFrame:
    """vec_id, v, size of the vectors that take part, and two hashes of them."""
    number = "double" if "double" in dict(table.dtypes)[vector] else "float"
    # Zeros of either sign are equal.
    v = F.transform(vector, lambda c: c.cast(number) + F.lit(0.0).cast(number))
    rows = spread(table).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda c: c != 0))
    return rows.select("vec_id", "v", F.size("v").alias("size"), F.xxhash64("v").alias("id1"), F.xxhash64(F.lit(SAMPLE), "v").alias("id2"))


def _sample(rows: DataFrame) -> np.ndarray:
    """SAMPLE distinct vectors at most, those with the least hashes; only their share of the
    rows reaches the task that picks."""
    share = min(1.0, (2 * SAMPLE + 400) / max(rows.count(), 1))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    some = rows.where(F.col("id1") <= F.lit(bound).cast("long")).groupBy("id1", "id2").agg(F.any_value("v").alias("v"))
    return np.array([r["v"] for r in some.orderBy("id1", "id2").limit(SAMPLE).collect()], np.float64)


def build_index(rows: DataFrame, tree: Tree) -> DataFrame:
    """id1, id2, v, ids, leaf of each distinct vector; ids are its SAME smallest numbers."""
    kind = dict(rows.dtypes)["v"]
    same = Window.partitionBy("id1", "id2").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= SAME)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda s: s["vec_id"])
    distinct = few.groupBy("id1", "id2").agg(F.any_value("v").alias("v"), ids.alias("ids"))
    return materialize(distinct.mapInArrow(_placed(tree), f"id1 long, id2 long, v {kind}, ids array<long>, leaf int"), "vector-index")


def _search(rows: DataFrame, every: int, nearest: int) -> DataFrame:
    """The search among vectors of one size: query_id, rank, vec_id, score."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["v"]
    sample = _sample(rows)
    tree = fit(directions(sample))
    index = build_index(rows, tree)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = materialize(queries.groupBy("id1", "id2").agg(F.any_value("v").alias("v")), "queries")
    tried = asked.orderBy(F.xxhash64("id2"), "id2").limit(CALIBRATED).select("v").collect()
    most = calibrated(tree, index, directions(np.array([r["v"] for r in tried], np.float64))) if tried else 1
    sizes = np.zeros(int(tree.leaf.max()) + 1, np.int64)
    for r in index.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    laid, blocks = shelves(sizes), 1 + asked.count() // DEALT
    of = lambda x: F.get(F.array(*[F.lit(int(i)) for i in x]), F.col("leaf"))
    shelf = (of(laid.first) + F.pmod("id1", of(laid.count))).cast("long")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = index.select(shelf.alias("shelf"), every_block.alias("block"), F.lit(0).alias("kind"), "id1", "id2", "v", "ids", F.array("leaf").alias("leaves"))
    going = asked.repartition(shuffle_width(spark), "id1").mapInArrow(_asked(tree, laid, most, blocks), f"shelf long, block int, kind int, id1 long, id2 long, v {kind}, ids array<long>, leaves array<int>")
    dealt = held.unionByName(going).repartition(shuffle_width(spark), "shelf", "block").sortWithinPartitions("shelf", "block", "kind")
    met = dealt.mapInArrow(_met, "id1 long, id2 long, score double, of1 long, of2 long, ids array<long>")
    flat = met.select("id1", "id2", "score", ((F.col("id1") == F.col("of1")) & (F.col("id2") == F.col("of2"))).alias("own"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("id1", "id2").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = flat.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAME)
    listed = best.groupBy("id1", "id2").agg(F.array_sort(F.collect_list(F.struct("nth", "own", "vec_id", "score"))).alias("found"))
    # Dealt anew for the join: one vector may be that of many queries.
    each = queries.select(F.col("vec_id").alias("query_id"), "id1", "id2").join(listed.select(unplaced(F.col("id1")).alias("id1"), "id2", "found"), ["id1", "id2"])
    # Of the rows with the query's vector and number one is the query itself.
    at = F.array_position(F.transform("found", lambda s: s["own"] & F.coalesce(s["vec_id"] == F.col("query_id"), F.lit(False))), True)
    others = F.filter(F.transform("found", lambda s, i: F.struct((i + 1).alias("i"), s.alias("s"))), lambda x: (at == 0) | (x["i"] != at))
    out = each.select("query_id", F.posexplode(F.slice(others, 1, nearest)).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.s.vec_id").alias("vec_id"), F.col("x.s.score").alias("score"))


def nearest_vectors(table: DataFrame, vector: str = "embedding", every: int = EVERY) -> DataFrame:
    """A row a query and neighbour: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id `every` divides, each row once; the row itself
    is no neighbour of its own, a row that repeats it is. Vectors that are null or
    zero, or hold a null or a component that isn't finite, take no part. Vectors of
    different sizes never meet. Ties go to the smaller vec_id, a null one being
    the largest. With fewer candidates than NEAREST all are returned, without one none.
    """
    spark, rows = table.sparkSession, _valid(table, vector)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(rows.select("size").distinct().collect()):
        out = out.unionByName(_search(rows.where(F.col("size") == r["size"]), every, NEAREST))
    return out
