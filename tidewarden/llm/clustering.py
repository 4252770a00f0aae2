"""Lloyd's algorithm over two trees: a cover tree over the vectors, built once, and one over the centroids, each round.

A node of either tree is a ball: one of its own points as centre, and the distance to its farthest point. Pairs of nodes are
walked from the roots down. Any vector of a node lies within (distance of the centres + the node's radius) of the centroid
in the middle of the other ball, so a pair whose balls lie farther apart than the least such bound can hold no nearest
centroid and is dropped; bounds are handed down. A node left with one centroid is assigned whole, without looking at its
vectors. Vectors are compared with the centroids left at leaves, exactly, in integers.

Vectors are dealt to blocks of bounded size, a tree each. Only centroids (k vectors) and their sums pass the driver.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle, unused

#: Vectors of a block, and of a leaf at most.
BLOCK, LEAF = 2048, 8
#: Scaled components beyond it count as it: squared distances of up to 512 of them stay below 2**63.
LARGEST = 2**26


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the distances of rows can be, whatever rounding does."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    d = a - b
    d2 = np.einsum("ij,ij->i", d, d)
    slack = (a.shape[1] + 8) * 2.0**-50
    return np.sqrt(d2 * (1 - slack)), np.sqrt(d2 * (1 + slack))


class CoverTree:
    """Points in the order of the tree: a node's are those from ``start`` to ``end``, its centre the first of them. Node 0 is
    the root; the children of a node are numbered from ``first`` on, ``count`` of them (0: a leaf).

    Each level halves the radius: a node's centre and the first point that no child covers, again and again, become
    children, so siblings' centres lie farther apart than the radius that they cover."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        x = points.astype(np.float64)
        self.order = np.arange(n)
        self.start, self.end, self.radius, self.first, self.count = ([0], [n], [0.0], [0], [0]) if n else ([], [], [], [], [])
        todo = [0] if n else []
        while todo:
            node = todo.pop()
            a, b = self.start[node], self.end[node]
            own = self.order[a:b]
            far = self._upper(x[own[:1]], x[own])[0]
            self.radius[node] = float(far.max())
            if b - a <= leaf or self.radius[node] == 0:
                continue
            cover, left, parts = self.radius[node] / 2, np.arange(b - a), []
            apart = self._upper(x[own], x[own])
            while len(left):  # the first left is the node's centre at first
                near = apart[left[0], left] <= cover
                near[0] = True
                parts.append(left[near])
                left = left[~near]
            self.first[node], self.count[node] = len(self.start), len(parts)
            self.order[a:b] = own[np.concatenate(parts)]
            for part in parts:
                todo.append(len(self.start))
                self.start.append(a)
                self.end.append(a := a + len(part))
                self.radius.append(0.0)
                self.first.append(0)
                self.count.append(0)
        self.start, self.end, self.first, self.count = (np.array(v, np.int64) for v in (self.start, self.end, self.first, self.count))
        self.radius = np.array(self.radius)

    @staticmethod
    def _upper(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that the distances of all pairs of rows can be; sums below 2**53 are exact."""
        na, nb = np.square(a).sum(1)[:, None], np.square(b).sum(1)[None, :]
        d2 = na + nb - 2 * (a @ b.T)
        exact = max(na.max(initial=0), nb.max(initial=0)) < 2.0**51
        return np.sqrt(d2) * (1 + 2.0**-50) if exact else np.sqrt(np.maximum(d2, 0) + (a.shape[1] + 8) * 2.0**-50 * (na + nb))


def _children(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every child of the nodes given by row."""
    row = np.repeat(np.arange(len(first)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, int]:
    """(the nearest centroid of each point, ties to the smaller number; exact comparisons made). ``points`` are in the order
    of ``tree``; ``centroids`` in their own, which ``over.order`` leads back to."""
    out = np.full(len(points), -1)
    sorted_c = centroids[over.order]
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.full(len(tree.start), np.inf)
    compared = 0
    while len(q):
        low, high = between(points[tree.start[q]], sorted_c[over.start[r]])
        np.minimum.at(bound, q, high + tree.radius[q])
        alive = low - tree.radius[q] - over.radius[r] <= bound[q]
        q, r = q[alive], r[alive]
        single = over.end[r] - over.start[r] == 1
        left = np.bincount(q, minlength=len(bound))
        settled = (left[q] == 1) & single
        for node, c in zip(q[settled], over.order[over.start[r[settled]]], strict=True):
            out[tree.start[node] : tree.end[node]] = c
        q, r, single = q[~settled], r[~settled], single[~settled]
        # A pair is at its end when both are leaves; a leaf's end is exact comparison with all centroids that are left to it.
        bottom = (tree.count[q] == 0) & (over.count[r] == 0)
        open_pairs = np.bincount(q, weights=~bottom, minlength=len(bound))
        ready = bottom & (open_pairs[q] == 0)
        if ready.any():
            compared += _compare(points, tree, centroids, over, q[ready], r[ready], out)
        q, r, bottom = q[~ready], r[~ready], bottom[~ready]
        # Centroid nodes open first; where none is left to open, the vectors' node does.
        opens = np.bincount(q, weights=over.count[r] > 0, minlength=len(bound))[q] > 0
        row, child = _children(over.first[r], np.where(opens, over.count[r], 0))
        stay = opens & (over.count[r] == 0)
        down, below = _children(tree.first[q], np.where(opens, 0, tree.count[q]))
        np.minimum.at(bound, below, bound[q[down]])
        q, r = np.concatenate([q[row], q[stay], below]), np.concatenate([child, r[stay], r[down]])
    return out, compared


def _compare(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree, q: np.ndarray, r: np.ndarray, out: np.ndarray) -> int:
    """Exact comparison of the vectors of leaves with the centroids of leaves."""
    sizes, widths = tree.end[q] - tree.start[q], over.end[r] - over.start[r]
    pair, c = _children(over.start[r], widths)
    row, point = _children(tree.start[q][pair], sizes[pair])
    number = over.order[c[row]]
    d = squared(points[point], centroids[number])
    best = np.lexsort((number, d, point))
    firsts = best[np.unique(point[best], return_index=True)[1]]
    out[point[firsts]] = number[firsts]
    return len(d)


def whole_vectors(embeddings: DataFrame, width: int, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<int>), v = floor(scale * component), of the vectors with ``width`` components, none of them null
    or non-finite; other rows are left out. Null and repeated ids are kept."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    limit = float(LARGEST)
    whole = F.transform(x, lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c)) * scale).cast("double"))).cast("int"))
    kept = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) == width) & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The k vectors that come first by ``order``, then by their components; all, if fewer."""
    rows = vectors.select(order.alias("o"), "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


BLOCK_ROW = "ids array<long>, v binary, tree_start array<int>, tree_end array<int>, first array<int>, count array<int>, radius array<double>"


def tree_blocks(vectors: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row for each block of about ``block_rows`` vectors: ids and vectors in the order of the block's cover tree, and the
    tree. Stored in the shared folder."""
    stored = settle(vectors.withColumn("nth", F.monotonically_increasing_id()), "vectors")  # a row's block is now fixed
    blocks = max(1, -(-stored.count() // block_rows))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
        tree = CoverTree(x)
        ids = [None if pd.isna(i) else int(i) for i in rows["vec_id"].iloc[tree.order]]
        return pd.DataFrame([[ids, x[tree.order].astype(np.int32).tobytes(), tree.start, tree.end, tree.first, tree.count, tree.radius]], columns=[c.split()[0] for c in BLOCK_ROW.split(", ")])

    # Rows are dealt by their place in the stored table, so blocks are even whatever ids and vectors are.
    dealt = stored.select(F.pmod(F.xxhash64("nth"), F.lit(blocks)).alias("block"), F.col("vec_id").cast("decimal(19,0)").alias("vec_id"), "v")
    return settle(dealt.groupBy("block").applyInPandas(build, BLOCK_ROW), "trees")


def _read(row, width: int) -> tuple[np.ndarray, CoverTree]:
    tree = CoverTree(np.zeros((0, width), np.int64))
    tree.start, tree.end, tree.first, tree.count = (np.array(v, np.int64) for v in (row.tree_start, row.tree_end, row.first, row.count_))
    tree.radius = np.array(row.radius)
    return np.frombuffer(row.v, np.int32).astype(np.int64).reshape(-1, width), tree


def _walked(frames: Iterator[pd.DataFrame], centroids: np.ndarray):
    """(ids, vectors, nearest centroids) of each block."""
    over = CoverTree(centroids, leaf=1)
    for frame in frames:
        for row in frame.rename(columns={"count": "count_"}).itertuples(index=False):
            points, tree = _read(row, centroids.shape[1])
            yield row.ids, points, nearest(points, tree, centroids, over)[0]


def _sums(blocks: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, place, sum, n) over all vectors, added up in each task first."""
    k, width = centroids.shape

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, points, near in _walked(frames, centroids):
            here = np.unique(near)
            order = np.argsort(near, kind="stable")
            total[here] += np.add.reduceat(points[order], np.searchsorted(near[order], here))
            n += np.bincount(near, minlength=k)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "sums": list(total[used])})

    parts = blocks.mapInPandas(add, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    return each.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect()


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the componentwise floor of each cluster's mean; those of empty clusters stay."""
    out = centroids.copy()
    for r in _sums(blocks, centroids):
        out[r.cluster, r.place] = int(r.s) // r.n
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (vec_id, cluster, distance), distance squared."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, points, near in _walked(frames, centroids):
            yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "cluster": near.astype(np.int32), "distance": squared(points, centroids[near])})

    return blocks.mapInPandas(rows, "vec_id long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int = 3, block_rows: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) for each row (vec_id, v) of ``vectors``, the final centroids) after ``rounds`` rounds and
    one more assignment. Ties go to the smaller centroid. Repeated rows and ids count as often as they occur; a null id
    stays null; no vectors or no centroids give no rows. All vectors are as long as the centroids."""
    if not len(centroids):
        none = vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
        return none, centroids
    blocks = tree_blocks(vectors, block_rows)
    centroids = functools.reduce(lambda c, _: moved(blocks, c), range(rounds), centroids)
    return settle(assigned(blocks, centroids), "assigned"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia and inertia (sums of distances over the cluster and over all) and centroid_sha256."""
    spark, name = found.sparkSession, unused("of", found)
    each = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    every = sum(each.values())
    rows = [(int(c), s, every, digest(centroids[c])) for c, s in each.items()]  # one for each centroid at most
    facts = spark.createDataFrame(rows, f"{name} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), found["cluster"] == facts[name]).drop(name)
