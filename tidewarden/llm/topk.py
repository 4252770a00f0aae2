"""Exact top-k inner products by no-random-access aggregation (NRA).

Every dimension is a list of a block's candidates sorted by value, cut into slices. A query reads each list slice by slice
from the end that its sign favours, deeper where its component is larger. What is read of a candidate bounds its score:
unread components lie between the list's far end and the depth reached, and together they can't exceed the product of the
lengths that the query and the candidate have left (a candidate's length is read first). After each depth the candidates that
can't reach the k-th lower bound are left behind, and deeper reading looks at the others only. It stops when hardly any are
left; the scores of those are then resolved exactly, ties going to smaller ids.

Candidates are dealt to blocks of bounded size, once; queries go to every block, in streams, so no task holds a side. The
k best of the blocks of a query hold its k best over all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a block, and queries whose bounds are held at once.
CANDIDATES, TOGETHER = 16384, 128
#: Slices of a list.
SLICES = 4
#: Shares of a query's squared length that may be unread when its bounds are looked at.
UNREAD = (0.04, 0.015, 0.004)
#: Candidates left for each of the k at which reading stops.
LEFT = 8
#: Depths that a query's schedule is chosen from: slices read of the list with its largest component, others in proportion.
DEPTHS = tuple(SLICES * 2.0 ** (i / 4) for i in range(-8, 29))
#: What rounding of single-precision sums may hide, as a share of a squared length, or of the product of the lengths.
SLACK = 2e-5


class Lists:
    """The sorted lists of a block of candidates (n x d)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        n, _ = x.shape
        self.ids, self.x = ids, x.astype(np.float64)  # whole numbers below 2**53, so sums are exact
        order = np.argsort(x, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], 0)
        first = [-(-n * i // SLICES) for i in range(SLICES + 1)]
        slices = [(place >= a) & (place < b) for a, b in zip(first, first[1:], strict=False)]
        self.member = [m.astype(np.float32).T for m in slices]
        self.values = [np.where(m, self.x, 0.0).astype(np.float32).T for m in slices]
        self.squares = [v * v for v in self.values]
        self.norms = np.square(self.x).sum(1).astype(np.float32)
        listed = np.take_along_axis(self.x, order, 0)
        # The edges of the slices, from either end; a list read to its end leaves nothing.
        self.least = np.vstack([listed[np.minimum(first[:-1], n - 1)], np.zeros_like(listed[:1])])
        self.most = np.vstack([np.zeros_like(listed[:1]), listed[np.maximum(np.array(first[1:]) - 1, 0)]])
        self.slice_of = np.empty(x.shape, np.int8)
        for i, m in enumerate(slices):
            self.slice_of[m] = i
        self.entries_read = self.unstopped = 0

    def levels(self, q: np.ndarray, unread: float) -> np.ndarray:
        """Slices of each list that each query reads (m x d): the least depth that leaves ``unread`` of its squared length."""
        size = np.abs(q)
        share = size / np.maximum(size.max(1, keepdims=True), 1e-300)
        out, todo = np.full(q.shape, SLICES), np.arange(len(q))
        for depth in DEPTHS if unread else ():
            level = np.minimum(SLICES, np.ceil(depth * share[todo])).astype(int)
            enough = (q[todo] ** 2 * (1 - level / SLICES)).sum(1) <= unread * (q[todo] ** 2).sum(1)
            out[todo[enough]] = level[enough]
            todo = todo[~enough]
        out[q == 0] = SLICES
        return out

    def bounds(self, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the scores (m x n) after reading each list to its level."""
        m, n = len(q), len(self.ids)
        up, columns = q > 0, np.arange(q.shape[1])
        unread = level < SLICES
        best = np.where(unread, q * np.where(up, self.most[SLICES - level, columns], self.least[level, columns]), 0.0)
        worst = np.where(unread, q * np.where(up, self.least[0], self.most[SLICES]), 0.0)
        score, known, squares = (np.zeros((i * m, n), np.float32) for i in (1, 3, 1))
        for i in range(SLICES):
            read = np.where(up, i >= SLICES - level, i < level)
            score += (q * read).astype(np.float32) @ self.values[i]
            squares += read.astype(np.float32) @ self.squares[i]
            known += np.vstack([best * read, worst * read, q * q * read]).astype(np.float32) @ self.member[i]
        high, low, read_q = known[:m], known[m : 2 * m], known[2 * m :]
        length = np.square(q).sum(1, keepdims=True).astype(np.float32)
        ends = [(np.abs(x).sum(1, keepdims=True) * SLACK).astype(np.float32) for x in (worst, best)]
        reach = np.sqrt(np.maximum(0, self.norms - squares) + SLACK * self.norms) * np.sqrt(np.maximum(0, length - read_q) + SLACK * length)
        reach += SLACK * np.sqrt(length * self.norms)
        lower = np.maximum(score + (worst.sum(1, keepdims=True).astype(np.float32) - low) - ends[0] - SLACK * np.sqrt(length * self.norms), score - reach)
        upper = np.minimum(score + (best.sum(1, keepdims=True).astype(np.float32) - high) + ends[1] + SLACK * np.sqrt(length * self.norms), score + reach)
        return lower, upper

    def bounds_of(self, q: np.ndarray, level: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``bounds`` of one query for some candidates, from what is read of them."""
        up, columns, x = q > 0, np.arange(len(q)), self.x[live]
        read = np.where(up, self.slice_of[live] >= SLICES - level, self.slice_of[live] < level)
        best = q * np.where(up, self.most[SLICES - level, columns], self.least[level, columns])
        worst = q * np.where(up, self.least[0], self.most[SLICES])
        seen = x * read
        score, known, length = seen @ q, read @ (q * q), q @ q
        reach = np.sqrt(np.maximum(0, self.norms[live].astype(float) * (1 + SLACK) - (seen * seen).sum(1)) * np.maximum(0, length * (1 + SLACK) - known))
        slack = SLACK * np.sqrt(length * self.norms[live])
        return np.maximum(score + (~read) @ worst, score - reach) - slack, np.minimum(score + (~read) @ best, score + reach) + slack

    def narrowed(self, q: np.ndarray, live: np.ndarray, bar: float, k: int) -> np.ndarray:
        """Of the candidates, those that may be among the k best: few as soon as a depth tells."""
        for unread in UNREAD[1:]:
            if len(live) <= LEFT * k:
                return live
            level = self.levels(q[None, :], unread)[0]
            lower, upper = self.bounds_of(q, level, live)
            bar = max(bar, np.partition(lower, len(live) - k)[len(live) - k])
            live = live[upper >= bar]
            self.entries_read += int(level.sum() - self._level.sum()) * len(self.ids) // SLICES
            self._level = level
        self.unstopped += len(live) > max(LEFT * k, len(self.ids) // 64)
        return live

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(row of the query, id, score) of the k best for each query, ids equal to its own left out."""
        n, out = len(self.ids), []
        for at in range(0, len(queries), TOGETHER):
            q = queries[at : at + TOGETHER].astype(np.float64)
            level = self.levels(q, UNREAD[0])
            lower, upper = self.bounds(q, level)
            itself = own[at : at + TOGETHER][:, None] == self.ids[None, :]
            lower = np.where(itself, -np.inf, lower)
            place = max(n - k, 0)
            bar = np.partition(lower, place, axis=1)[:, place]
            alive = (upper >= bar[:, None]) & ~itself  # a tie may still win by its id
            self.entries_read += int(level.sum()) * n // SLICES
            for i in range(len(q)):
                self._level = level[i]
                left = self.narrowed(q[i], np.flatnonzero(alive[i]), bar[i], k)
                scores = self.x[left] @ q[i]
                out += [(at + i, int(self.ids[left[j]]), int(scores[j])) for j in np.lexsort((self.ids[left], -scores))[:k]]
        return out


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<long>) with v = floor(256 * component); null vectors and those that hold a null or a
    non-finite component, and rows with a null id, are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = embeddings.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


class _Block:
    """A block as its rows arrive: candidates first, then queries, answered some at a time."""

    def __init__(self, k: int):
        self.k, self.lists = k, None
        self.ids: list[int] = []
        self.vectors: list[np.ndarray] = []

    def close_candidates(self) -> None:
        if self.lists is None:
            self.width = max(map(len, self.vectors), default=0)
            self.lists = Lists(np.array(self.ids, np.int64), _matrix(self.vectors, self.width)) if self.ids else False
            self.ids, self.vectors = [], []

    def answers(self) -> pd.DataFrame:
        rows = []
        if self.lists and self.ids:  # beyond the longest candidate a query meets zeros only
            asked = np.array(self.ids, np.int64)
            rows = [(int(asked[i]), c, s) for i, c, s in self.lists.top(_matrix(self.vectors, self.width), self.k, asked)]
        self.ids, self.vectors = [], []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_inner_products(candidates: DataFrame, queries: DataFrame, k: int = 5, candidate_rows: int = CANDIDATES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates (vec_id, v) of each query (vec_id, v) by integer inner
    product, its own id left out; all, if fewer. Ties go to the smaller id. A repeated candidate counts as often as it
    occurs; rows that repeat a query's id are one query, of whose scores the k best over all its rows stay. Shorter vectors
    are zero beyond their end; no candidates or no queries give no rows.

    A block holds about ``candidate_rows`` candidates. Each candidate is sent once, each query to every block. Components up
    to 2**22 in size are exact."""
    blocks = max(1, -(-candidates.count() // candidate_rows))
    nth = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")  # whatever the ids are, blocks are even
    right = candidates.select("vec_id", "v", nth.alias("block"), F.lit(False).alias("asks"))
    left = queries.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    rows = right.unionByName(left).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block = None, None
        for frame in frames:
            for number, asks, vec_id, v in zip(frame.block, frame.asks, frame.vec_id, frame.v, strict=True):
                if number != now:
                    if block:
                        block.close_candidates()
                        yield block.answers()
                    now, block = number, _Block(k)
                if asks:
                    block.close_candidates()
                block.ids.append(vec_id)
                block.vectors.append(v)
                if asks and len(block.ids) == TOGETHER:
                    yield block.answers()
        if block:
            block.close_candidates()
            yield block.answers()

    found = rows.mapInPandas(answer, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of a query from each task
    return found.select("query_id", F.row_number().over(place).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
