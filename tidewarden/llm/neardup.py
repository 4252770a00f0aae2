"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: a direct sum of perfect block codes over the 64 bits, so every 64-bit word is
within the covering radius R of an anchor. Two fingerprints at most t bits apart have a midpoint at most ceil(t/2) from
both; an anchor within R of the midpoint is within R + ceil(t/2) of both. So each fingerprint goes to every anchor within
the radius plus its half of the threshold, and every linked pair meets at an anchor. Inside a block only errors beyond
the block's own radius count against that half, which prunes anchors without losing a pair.

Anchors that more than ``GROUP`` fingerprints share are refined by the finest covering code, all 64-bit words (R = 0):
there a fingerprint goes to itself and its 64 neighbours, at most 65 distinct fingerprints can meet, and all that meet
at one are linked for t = 2. Nothing is capped, and no group grows with the data.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import settle, unused

SHINGLE = 3
THRESHOLD = 2
#: Fingerprints compared with each other at one anchor; more are refined.
GROUP = 4096

#: The binary Golay code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Blocks of the anchor code by the number of distinct fingerprints it serves: 2^26, 2^28 and 2^34 anchors.
CODES = (
    (2**30, (("golay", 23), ("golay", 23), ("repeat", 9), ("repeat", 9))),
    (2**33, (("golay", 23), ("golay", 23), ("repeat", 7), ("repeat", 7), ("repeat", 3), ("repeat", 1))),
    (None, (("golay", 23), ("golay", 23), ("hamming", 7), ("hamming", 7), ("repeat", 3), ("repeat", 1))),
)


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """64-bit fingerprint of the words' shingles, as a signed integer; 0 without words."""
    words = (text or "").encode().lower().split()  # on bytes both are ASCII only
    if not words:
        return 0
    parts = [words[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
    digest, over, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(parts[-1])
    shingles = map(b" ".join, zip(*parts, strict=False)) if len(parts) > 1 else iter(parts[0])
    while block := list(itertools.islice(shingles, 16384)):
        hashes = np.fromiter((digest(s, 42) for s in block), np.uint64, len(block))
        over += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big", signed=True)


def _fp(width: int):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, width) for x in texts], dtype="int64")

    return fp


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp long): one for each row, whatever its id; null and empty texts have 0."""

    return docs.select(F.col(id_col).alias("doc_id"), _fp(width)(F.col(text)).alias("fp"))


class Block:
    """A perfect block code, as syndrome tables of the errors up to its radius and up to ``extra`` beyond it."""

    def __init__(self, kind: str, n: int, extra: int):
        self.n, self.extra = n, extra
        if kind == "golay":
            column, self.checks = 1, []
            for _ in range(n):
                self.checks.append(column)
                column = (column << 1) ^ (GOLAY if column >> 10 & 1 else 0)
            self.radius = 3
        elif kind == "hamming":
            self.checks, self.radius = list(range(1, n + 1)), 1
        else:
            self.checks, self.radius = [1 << i for i in range(n - 1)] + [(1 << (n - 1)) - 1], n // 2
        errors: dict[int, list[list[int]]] = {}
        for weight in range(min(n, self.radius + extra) + 1):
            for bits in itertools.combinations(range(n), weight):
                syndrome = functools.reduce(lambda s, i: s ^ self.checks[i], bits, 0)
                beyond = max(0, weight - self.radius)
                errors.setdefault(syndrome, [[] for _ in range(extra + 1)])[beyond].append(sum(1 << i for i in bits))
        size = max(errors) + 1
        #: For each number of errors beyond the radius: (first, count) by syndrome, and the error words.
        self.tables = []
        for beyond in range(extra + 1):
            lists = [errors[s][beyond] if s in errors else [] for s in range(size)]
            counts = np.array([len(x) for x in lists], np.int64)
            self.tables.append((np.cumsum(counts) - counts, counts, np.array([e for x in lists for e in x], np.int64)))

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, check in enumerate(self.checks):
            out ^= (words >> i & 1) * check
        return out

    def near(self, words: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
        """Code words exactly ``beyond`` bits past the radius (0: within it), with the place of the word each is near."""
        first, counts, errors = self.tables[beyond]
        s = self.syndromes(words)
        n = counts[s]
        place = np.repeat(np.arange(len(words)), n)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, words[place] ^ errors[first[s][place] + nth]


@functools.lru_cache(maxsize=4)
def _blocks(spec: tuple, extra: int) -> tuple[Block, ...]:
    assert sum(n for _, n in spec) == 64
    return tuple(Block(kind, n, extra) for kind, n in spec)


def anchors(fps: np.ndarray, spec: tuple = CODES[0][1], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(place, anchor) of every anchor within the covering radius plus half the threshold of each fingerprint (int64)."""
    extra = (threshold + 1) // 2
    blocks, at = _blocks(spec, extra), 0
    place, anchor, spent = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    for block in blocks:
        words = fps >> at & ((1 << block.n) - 1)
        grown = []
        for beyond in range(extra + 1):
            left = np.flatnonzero(spent + beyond <= extra)
            of, code = block.near(words[place[left]], beyond)
            grown.append((place[left][of], anchor[left][of] | code << at, spent[left][of] + beyond))
        place, anchor, spent = (np.concatenate(x) for x in zip(*grown, strict=True))
        at += block.n
    return place, anchor


def _groups(fps: np.ndarray, threshold: int):
    """Edges (fp, smallest fp of its local component) among the distinct fingerprints of one anchor, compared in blocks."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return
    near = np.zeros((len(fps), len(fps)), bool)
    for i in range(0, len(fps), 256):
        near[i : i + 256] = np.bitwise_count(fps[i : i + 256, None] ^ fps[None, :]) <= threshold
    if near.sum() == len(fps):
        return
    root = np.full(len(fps), -1)
    for i in range(len(fps)):
        if root[i] < 0:
            wave = np.array([i])
            root[i] = i
            while len(wave):
                wave = np.flatnonzero(near[wave].any(0) & (root < 0))
                root[wave] = i
    for i in np.flatnonzero(root != np.arange(len(fps))):
        yield int(fps[i]), int(fps[root[i]])


def links(distinct: DataFrame, threshold: int = THRESHOLD, spec: tuple | None = None, group: int = GROUP) -> DataFrame:
    """Edges (u, v) that connect the same distinct fingerprints (column fp) as all pairs within ``threshold`` bits do.

    ``spec``: blocks of the anchor code; by default the one for the table's row count."""
    if threshold > 2:
        raise ValueError("the finest code links at most 2 differing bits")
    if spec is None:
        n = distinct.count()
        spec = next(code for most, code in CODES if most is None or n <= most)

    def spread(batches):
        for batch in batches:
            for i in range(0, len(batch), 50_000):
                fps = batch.column(0).to_numpy(zero_copy_only=False)[i : i + 50_000]
                place, anchor = anchors(fps, spec, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[place])], ["anchor", "fp"])

    def compare(batches):
        key, held, hot = None, [], False

        def close():
            if hot or not held:
                return []
            return list(_groups(np.concatenate(held), threshold))

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            out: list[tuple] = []
            for j in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys))) if len(keys) else []:
                k, part = int(keys[starts[j]]), fps[starts[j] : ends[j]]
                if k != key:
                    out += close()
                    key, held, hot = k, [], False
                held.append(part)
                if hot or sum(map(len, held)) > group:
                    out += [(int(x), None) for y in held for x in y]
                    held, hot = [], True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])
        rest = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rest], pa.int64()), pa.array([x[1] for x in rest], pa.int64())], ["u", "v"])

    copies = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    met = copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")
    met = settle(met, "met")
    return met.where("v is not null").distinct().unionByName(_refined(met.where("v is null").select(F.col("u").alias("fp")).distinct(), threshold))


def _refined(fps: DataFrame, threshold: int) -> DataFrame:
    """Edges among fingerprints of crowded anchors, by the code of all 64-bit words."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    if threshold < 2:  # what meets at a word may differ in 2 bits: keep links through the word itself
        near = near.join(fps.select(F.col("fp").alias("word")), "word") if threshold else near.where("fp = word")
        return near.where("fp <> word").select(F.greatest("fp", "word").alias("u"), F.least("fp", "word").alias("v")).distinct()
    met = near.groupBy("word").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("all"))  # 65 at most
    return met.where(F.size("all") > 1).select(F.explode("all").alias("u"), "v").where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``; component_id is the smallest id reachable.

    Exact copies share a fingerprint, so links are sought among distinct fingerprints only. Null and empty texts have
    fingerprint 0 and are linked like others; a null id keeps its row and counts for no minimum (a component of null ids
    only has a null component_id); repeated rows come back each; an empty table gives no rows; other columns are left out.
    """
    fps = settle(fingerprints(docs, id_col, text, width), "fingerprints")
    return attach(fps, threshold)


def _rooted(classes: DataFrame, threshold: int) -> DataFrame:
    """``classes`` (fp, one row each, and other columns) with ``root``, the smallest fingerprint reachable."""
    roots = components(links(classes.select("fp"), threshold))
    rooted = classes.join(roots, classes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    return settle(rooted, "rooted")


def attach(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (doc_id, fp, component_id) of the rows (doc_id, fp)."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    rooted = _rooted(classes, threshold)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = settle(rooted.join(smallest, "root").select("fp", "component_id", "n"), "by_fp")
    # Fingerprints that more than a thousandth of all rows share are a thousand at most: their rows aren't shuffled.
    least = fps.count() // 1000
    hot = by_fp.where(F.col("n") > least).select("fp", "component_id")
    cold = by_fp.where(F.col("n") <= least).select("fp", "component_id")
    of_hot = fps.join(F.broadcast(hot), "fp")
    of_cold = fps.join(F.broadcast(hot), "fp", "left_anti").join(cold, "fp")
    return of_hot.unionByName(of_cold).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays, in all its columns.

    Null ids come after all others. Where rows of a component share the smallest id, the one with the smallest hash of its
    text stays; of rows alike in id and text, one. Null and empty texts are a component like others. Texts go through one
    shuffle, by a key of id and text, at every size."""
    keys = [unused(f"_key{i}", docs) for i in range(3)]
    # Two hashes of id and text are one key of 128 bits, which a null is part of like any value.
    as_text = F.col(id_col).cast("string")
    hashes = [F.xxhash64(F.lit(i), as_text.isNull(), as_text, F.col(text)) for i in range(2)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *(h.alias(f"h{i}") for i, h in enumerate(hashes)), F.col(text).alias("text"))
    fps = settle(rows.select("doc_id", "h0", "h1", _fp(SHINGLE)("text").alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h0", "h1"))
    rooted = _rooted(fps.groupBy("fp").agg(first.alias("least")), THRESHOLD)
    kept = settle(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.h0", "least.h1"), "kept")
    kept = kept.select(F.col("h0").alias(keys[0]), F.col("h1").alias(keys[1]))
    marked = docs.withColumns(dict(zip(keys, hashes, strict=False)))
    once = Window.partitionBy(*keys[:2]).orderBy(keys[0])
    unique = marked.withColumn(keys[2], F.row_number().over(once)).where(F.col(keys[2]) == 1)
    return unique.join(kept.hint("shuffle_hash"), keys[:2], "left_semi").select(docs.columns)
