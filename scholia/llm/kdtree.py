"""Centroid clustering: k-means whose rounds filter centroids down kd-trees.

Vectors become integers once, and each task builds kd-trees of CHUNK of them,
which are written: with each node its count, the sums of its components and its
box. A round takes all nodes of a level at once. Of a node's candidates the one
nearest to the middle of its box is kept, and each other goes that is strictly
farther from the whole box: farther from that corner which lies most in its
direction. Where one candidate is left, the node's count and sums are its own;
at the leaves the vectors themselves are compared with the candidates left. All is
integer arithmetic, so the result doesn't hang on how the table is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Vectors of a tree, and of a leaf at most.
CHUNK, LEAF = 8192, 32
#: Components are smaller: the squared distances of larger ones don't fit a long.
LARGEST = 1 << 27


def kept_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and the integer components (v) of vectors that have DIM of them, none null or
    not finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * SCALE) < LARGEST)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = spread(table).where(x.isNotNull() & (F.size(x) == DIM) & F.coalesce(finite, F.lit(False)))
    too_large = F.raise_error(F.concat(F.lit("a component is too large for squared distances: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, whole).otherwise(too_large.cast("array<long>")).alias("v"))


def seeds(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors with the smallest hashes of their number; a null one counts as an empty
    text there, and vectors of one number go by their components."""
    mark: Column = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIM)


def _levels(n: int) -> int:
    """How often n vectors are halved until LEAF are left."""
    return max(0, int(n - 1).bit_length() - LEAF.bit_length() + 1) if n > LEAF else 0


def _bounds(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1) * n >> level


def build(v: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """An order of the vectors in which nodes are runs, and of each level the nodes' least
    and largest components and their sums. A node is halved along its longest side."""
    n, order = len(v), np.arange(len(v))
    for level in range(_levels(n)):
        cuts = _bounds(n, level)
        for a, b, cut in zip(cuts[:-1].tolist(), cuts[1:].tolist(), _bounds(n, level + 1)[1::2].tolist(), strict=True):
            rows = v[order[a:b]]
            along = int(np.argmax(rows.max(0) - rows.min(0)))
            order[a:b] = order[a:b][np.argpartition(rows[:, along], cut - a, kind="introselect")]
    v, out = v[order], []
    for level in range(_levels(n) + 1):
        at = _bounds(n, level)[:-1]
        out.append((np.minimum.reduceat(v, at), np.maximum.reduceat(v, at), np.add.reduceat(v, at)))
    return order, out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    held: list[np.ndarray] = []
    n = 0

    def out() -> pa.RecordBatch:
        v = np.concatenate(held)
        order, levels = build(v)
        flat = [np.concatenate([x[i] for x in levels]) for i in range(3)]
        as_bytes = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), as_bytes(v[order], "<i4"), as_bytes(flat[0], "<i4"), as_bytes(flat[1], "<i4"), as_bytes(flat[2], "<i8")], names=["ids", "v", "low", "high", "sums"])

    for batch in batches:
        column = batch.column("v")
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            while len(part):
                take = min(CHUNK - n, len(part))
                held.append(part[:take])
                ids += batch.column("vec_id").slice(at + (min(CHUNK, len(rows) - at) - len(part)), take).to_pylist()
                n, part = n + take, part[take:]
                if n == CHUNK:
                    yield out()
                    ids, held, n = [], [], 0
    if n:
        yield out()


def trees(kept: DataFrame) -> DataFrame:
    """A row a tree: ids and components (v) of its vectors, and of its nodes, level by level,
    the boxes and sums. A node's count follows from its place."""
    return materialize(kept.mapInArrow(_trees, "ids array<long>, v binary, low binary, high binary, sums binary"), "kd-trees")


def _squares(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of z."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(z).max(initial=0)))
    if largest < 1 << 22:  # all numbers stay below 2 ** 53
        a, b = x.astype(np.float64), z.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in z.astype(np.int64)], axis=1)


def filtered(v: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], z: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """The nodes that are given as a whole to one centroid, as (first row, end, centroid,
    sums), and the leaves' vectors, as (row, row + 1, centroid, None)."""
    n, k = len(v), len(z)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level, (low, high, sums) in enumerate(levels):
        cuts = _bounds(n, level)
        lo, hi = low[nodes].astype(np.int64), high[nodes].astype(np.int64)
        middle = np.stack([((lo + hi - 2 * c) ** 2).sum(1) for c in z], axis=1)
        best = np.where(open_, middle, np.iinfo(np.int64).max).argmin(1)
        own = z[best]
        for j in range(k):
            corner = np.where(z[j] > own, hi, lo)
            worse = ((z[j] - corner) ** 2 - (own - corner) ** 2).sum(1) > 0
            open_[:, j] &= ~(worse & (best != j))
        alone = open_.sum(1) == 1
        for node, j in zip(nodes[alone].tolist(), best[alone].tolist(), strict=True):
            yield int(cuts[node]), int(cuts[node + 1]), j, sums[node]
        nodes, open_ = nodes[~alone], open_[~alone]
        if level + 1 < len(levels):
            nodes, open_ = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([open_, open_])
            continue
        for node, candidates in zip(nodes.tolist(), open_, strict=True):
            a, b, left = int(cuts[node]), int(cuts[node + 1]), np.flatnonzero(candidates)
            # The first of equal distances is that of the smaller number.
            for i, j in enumerate(left[_squares(v[a:b].astype(np.int64), z[left]).argmin(1)].tolist()):
                yield a + i, a + i + 1, j, None


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Of a batch of trees: ids, vectors, levels."""
    for i in range(len(batch)):
        v, low, high = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i4").reshape(-1, DIM) for c in ("v", "low", "high"))
        sums, levels, at = np.frombuffer(batch.column("sums")[i].as_buffer(), "<i8").reshape(-1, DIM), [], 0
        for level in range(_levels(len(v)) + 1):
            part = slice(at, at + (1 << level))
            levels.append((low[part], high[part], sums[part]))
            at += 1 << level
        yield batch.column("ids")[i], v, levels


def _round(z: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(z), np.int64), np.zeros((len(z), DIM), np.int64)
        for batch in batches:
            for _, v, levels in _opened(batch):
                single: list[tuple[int, int]] = []
                for a, b, j, sums in filtered(v, levels, z):
                    count[j] += b - a
                    if sums is None:
                        single.append((a, j))
                    else:
                        total[j] += sums
                rows, own = (np.array(x, np.int64) for x in (zip(*single, strict=True) if single else ([], [])))
                np.add.at(total, own, v[rows].astype(np.int64))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def moved(forest: DataFrame, z: np.ndarray) -> np.ndarray:
    """The centroids after a round: of each that has vectors, the floor of their mean."""
    parts = forest.mapInArrow(_round(z), "cluster int, n long, sums array<long>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(DIM)]
    out = z.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(DIM)]
    return out


def _assigned(z: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, levels in _opened(batch):
                cluster = np.zeros(len(v), np.int64)
                for a, b, j, _ in filtered(v, levels, z):
                    cluster[a:b] = j
                distance = ((v.astype(np.int64) - z[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(table: DataFrame, vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """A row a kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256.

    Vectors without exactly DIM components, or with a null or not finite one, are left
    out. Rows that repeat count as often as they are there; a null vec_id stays. With
    fewer vectors than k there are as many centroids; without any there is no row. A
    component of LARGEST / SCALE or more stops the job.
    """
    kept = kept_vectors(table, vector)
    z, forest = seeds(kept, k), trees(kept)
    for _ in range(rounds if len(z) else 0):
        z = moved(forest, z)
    rows = materialize(forest.mapInArrow(_assigned(z), "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster"))
    own = of([sums.get(j, 0) for j in range(len(z))], "long")
    return rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))
