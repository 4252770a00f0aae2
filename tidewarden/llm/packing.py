"""Best-fit packing planned over the histogram of piece lengths.

1. Encode each document, add the end id, cut what is longer than a sequence into pieces.
2. Count pieces by length: at most ``capacity`` counts, whatever the corpus holds.
3. Best-fit decreasing over counts: all pieces of a length are placed at once into groups of equally full sequences.
   The plan has a few rows for each length; it never sees a document.
4. Each piece takes the slot of its rank within its length. Ranks come from counts of (length, lane) and row numbers
   inside a lane, so a length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle
from .tokens import chunk_ids

CAPACITY = 4096
END_ID = 1
SEED = 1
#: Rows that one lane ranks, about; lanes are counted from the table, so their rows stay bounded as it grows.
LANE_ROWS = 200_000


def cut(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document; a null text is empty and has the end id only.
    ``ids`` are the piece's ids as little-endian uint32 bytes."""
    shape = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    @F.pandas_udf(f"array<struct<{shape}>>")
    def pieces(texts: pd.Series) -> pd.Series:
        encode = chunk_ids(public_tokenizers.path(tokenizer)).ids
        out = []
        for x in texts:
            ids = encode(x) + end
            rows = []
            for n, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                rows.append((n, at >> 2, len(part) >> 2, zlib.crc32(part), *[part] * keep_ids))
            out.append(rows)
        return pd.Series(out)

    got = docs.select(F.col(id_col).alias("doc_id"), F.explode(pieces(F.col(text))).alias("p"))
    return got.select("doc_id", "p.*")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (length -> pieces). Rows (length, first_rank, pieces, first_sequence, each, offset):
    the pieces ranked from ``first_rank`` fill sequences from ``first_sequence`` on, ``each`` to a sequence, the first of
    a sequence at ``offset``.

    Sequences of equal fill form groups; a length goes to the fullest groups that still take it, then to new sequences.
    Each step splits one group in three at most, so the plan has O(number of lengths) rows.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    order: list[int] = []  # the keys of room, sorted
    rows, sequences = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(order, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        if length <= 0 or length > capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")

        def put(first: int, n: int, each: int, left: int, length: int = length) -> None:
            nonlocal todo, rank
            rows.append((length, rank, n * each, first, each, capacity - left))
            todo, rank = todo - n * each, rank + n * each
            keep(left - each * length, first, n)

        while todo:
            i = bisect.bisect_left(order, length)
            if i == len(order):  # new sequences
                each = min(capacity // length, todo)
                n = todo // each
                put(sequences, n, each, capacity)
                sequences += n
                continue
            left = order[i]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], order[i]
            each = min(left // length, todo)
            full = min(n, todo // each)
            put(first, full, each, left)
            keep(left, first + full, n - full)
    return rows


def ranked(pieces: DataFrame, lanes: int) -> DataFrame:
    """Adds ``rank``, the place of a piece among those of its length, from 0 without gaps. A piece's lane follows from its
    ``spread``, a number from 0 to 1, so pieces alike in everything are spread as well."""
    lane = F.floor(F.col("spread") * lanes).alias("lane")
    rows = pieces.select("*", lane)
    sizes = rows.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "lane").orderBy("spread", "doc_id", "piece", "ids_crc32")
    return (
        rows.withColumn("n", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "lane"])
        .withColumn("rank", F.col("n") + F.col("before"))
        .drop("n", "before", "lane", "spread")
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Rows of :func:`cut` with sequence_id and offset. Sequences have no gaps, and none holds more than ``capacity``.

    Null texts are empty; null or repeated ids are packed like others, row by row; an empty table gives no rows; columns
    beside the id and the text are left out, whatever their names. Which of the pieces of a length takes which slot is drawn."""
    pieces = cut(docs, id_col, text, tokenizer, capacity, end_id, keep_ids).withColumn("spread", F.rand(SEED))
    pieces = settle(pieces, "pieces")  # what was drawn stays, whatever is read again
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for length, *slot in rows:
        by_length.setdefault(length, []).append(slot)
    slots = {length: np.array(x, dtype=np.int64).T for length, x in by_length.items()}  # O(capacity) numbers

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def slot(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            first_rank, _, first, each, start = slots[int(length[at[0]])]
            i = np.searchsorted(first_rank, rank[at], side="right") - 1
            nth = rank[at] - first_rank[i]
            sequence[at] = first[i] + nth // each[i]
            offset[at] = start[i] + nth % each[i] * length[at]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    lanes = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // LANE_ROWS)
    out = ranked(pieces, lanes).withColumn("slot", slot("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "slot.sequence_id", "slot.offset")
