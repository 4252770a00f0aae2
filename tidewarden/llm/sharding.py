"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform permutation sends a random number of each block's rows to each shard; together these counts are a random matrix with
the blocks' sizes as row sums and the shards' as column sums. So the matrix is drawn first, from its exact law; then each block
permutes its rows and cuts them by its row of the matrix, rows are exchanged, and each shard permutes what it got.

No matrix is stored: blocks are the leaves of a binary tree, a node draws how many rows of each shard lie in its left half, with
random numbers of its own, and any task comes from the root to the row of its block in a few draws. Only the blocks' sizes are
sent to tasks: at most ``BLOCKS`` and one for each ``ROWS`` rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle, unused

#: Tasks that the table is first stored by at most; rows of a block at most; rows that a task puts in order, about.
BLOCKS, ROWS, PIECE = 65536, 2**20, 2**13
#: Populations below it are drawn by numpy, which takes no larger ones.
DIRECT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, direct: int = DIRECT) -> int:
    """How many of n things drawn without replacement from good + bad are good. Exact at any size.

    Beyond ``direct`` each thing is drawn by itself with probability n / (good + bad), which gives about n; those too many are
    a random part of the drawn, those too few of the rest: a hypergeometric draw again, of about the root of n."""
    if not n or not good:
        return 0
    if not bad:
        return n
    if good < direct and bad < direct:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    some, others = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    over = some + others - n
    if over >= 0:
        return some - hypergeometric(rng, some, others, over, direct)
    return some + hypergeometric(rng, good - some, bad - others, -over, direct)


def shares(rng: np.random.Generator, sizes: tuple[int, ...], n: int) -> tuple[int, ...]:
    """How many of n things drawn from groups of these sizes come from each."""
    out, rest = [], sum(sizes)
    for size in sizes:
        rest -= size
        out.append(hypergeometric(rng, size, rest, n))
        n -= out[-1]
    return tuple(out)


class Matrix:
    """Rows of the communication matrix between blocks of these sizes and shards of these sizes, drawn when asked for."""

    def __init__(self, blocks: list[int], shards: list[int], seed: int):
        self.before = [0, *np.cumsum(blocks, dtype=np.int64).tolist()]
        self.shards, self.seed = tuple(shards), seed
        self._node = functools.lru_cache(maxsize=4096)(self._drawn)

    def _drawn(self, low: int, high: int, columns: tuple[int, ...]) -> tuple[int, ...]:
        middle = (low + high) // 2
        return shares(np.random.default_rng([self.seed, 0, low, high]), columns, self.before[middle] - self.before[low])

    def row(self, block: int) -> tuple[int, ...]:
        low, high, columns = 0, len(self.before) - 1, self.shards
        while high - low > 1:
            left, middle = self._node(low, high, columns), (low + high) // 2
            if block < middle:
                high, columns = middle, left
            else:
                low, columns = middle, tuple(a - b for a, b in zip(columns, left, strict=True))
        return columns


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that are at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shuffle(df: DataFrame, shards: int = 16, seed: int = 1, piece_rows: int = PIECE, block_rows: int = ROWS) -> DataFrame:
    """The rows of ``df`` with ``shard`` (int, from 0; rows of shards are at most one apart) and ``slot`` (long, gapless from 0
    within a shard), columns of these names replaced. Each order of all rows is as likely as any other, whatever the rows hold:
    equal rows and null columns are dealt like others. No rows give none.

    The table is stored once, so that a row's place, which its draw hangs on, is the same in every task that asks again; the
    same stored order and seed give the same shards. A shard is put in order by many tasks: its rows get hashes of their
    place, hashes are cut into pieces of about ``piece_rows`` rows, and a piece begins where those before it end."""
    block_bits = (block_rows - 1).bit_length()
    kept = df.drop("shard", "slot")
    at, key, piece, first = (unused(c, kept) for c in ("at", "key", "piece", "first"))
    stored = settle(kept.coalesce(BLOCKS).withColumn(at, F.monotonically_increasing_id()), "to_shuffle")
    counts = stored.groupBy(F.shiftright(at, block_bits).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted((r.block, r.n) for r in counts.collect())  # as many as the docstring of the module says
    ids, held = np.array([b for b, _ in sizes], np.int64), [n for _, n in sizes]
    columns = shard_sizes(sum(held), shards)

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matrix, last = Matrix(held, columns, seed), None
        for batch in batches:
            places = batch.to_numpy(np.int64)
            block, out = np.searchsorted(ids, places >> block_bits), np.empty(len(places), np.int32)
            for b in np.unique(block).tolist():
                if b != last:
                    last, cuts, order = b, np.cumsum(matrix.row(b)), np.random.default_rng([seed, 1, b]).permutation(held[b])
                here = block == b
                out[here] = np.searchsorted(cuts, order[places[here] & (1 << block_bits) - 1], side="right")
            yield pd.Series(out)

    most = max(1, -(-columns[0] // piece_rows))  # shards are alike in rows, so in pieces
    dealt = stored.withColumns({"shard": shard_of(at), key: F.xxhash64(F.col(at), F.lit(seed))})
    dealt = dealt.withColumn(piece, F.least(F.floor(F.shiftrightunsigned(key, 1) / F.lit(2.0**63) * most), F.lit(most - 1)).cast("int"))
    n, before = unused("n", kept), Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", piece).agg(F.count(F.lit(1)).alias(n))
    starts = settle(starts.select("shard", piece, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first)), "starts")
    placed = dealt.join(starts, ["shard", piece]).withColumn("slot", F.col(first) + F.row_number().over(Window.partitionBy("shard", piece).orderBy(key, at)) - 1)
    return placed.select(*kept.columns, "shard", "slot")


def write_shards(dealt: DataFrame, path: str) -> None:
    """Writes each shard to a folder of its own, ``shard=N``, each file in order of slots."""
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
