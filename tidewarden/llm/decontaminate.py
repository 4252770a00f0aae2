"""Benchmark decontamination by latent semantic retrieval.

1. Whole texts become arrays of word ids of the benchmark's vocabulary (0: another word), once, in the shared folder.
2. TF-IDF of passages over that vocabulary (other words weigh nothing in any item); the weights come from the document
   counts of all documents; words that are in most of them weigh little, but never nothing.
3. Randomised SVD of the passage matrix A, distributed: each task multiplies its passages' A'(A W) for one random W, tasks'
   sums are added up in a tree, and the driver decomposes the fixed-size result (Nystroem, so one pass over the passages).
4. Candidates: windows whose latent cosine with a passage of an item is high enough and that share enough of its words' weight.
5. Checks on the words themselves: the longest common subsequence of the item with the text around the candidate, and
   how much of the item's answer, its last sentence, is in it. Paraphrases keep most words in order; chance doesn't.

The benchmark is dealt with in parts of ``PART`` items and ``PART_WORDS`` words, ``ROUND`` of them in each round over the
corpus, so what tasks receive has a bound whatever its size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import settle

#: Words of a passage, and from one window to the next.
PASSAGE, STEP = 32, 8
DIMENSIONS, OVERSAMPLE, SEED = 32, 4, 7
#: Latent cosine for a passage of full length (shorter ones fill a window less), and share of its words' weight.
COSINE, SHARED = 0.25, 0.5
#: Least weight of an item's word: even one that is in every document counts, since copies of a leak make its words frequent.
LEAST_IDF = 0.05
#: What rounding may take from a sum.
ROUNDING = 1 - 1e-9
#: Share of an item's words, in order, that makes a leak; or less with so much of its answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.65, 0.55, 0.9
#: Items of a part; parts that share a round's passes over the corpus; words that a task handles at once; blocks that the
#: tasks' sums are cut into.
PART, ROUND, BATCH, BLOCKS = 500, 8, 65536, 16
#: Words of a part's items, about (a longer item is a part by itself or shares one); bytes of a table of passages by words.
PART_WORDS, TABLE = 30_000, 1 << 26
#: Words of a window, the heaviest ones, that are looked at before the others.
HEAVIEST = 6
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

# Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower case.
_IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_PRIME = np.uint64(0x100000001B3)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes of texts that are hashed at once; powers of the prime and of its inverse modulo 2^64, for so many places.
PIECE = 1 << 16
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_POWERS = _powers(_PRIME, PIECE), _powers(_INVERSE, PIECE)
_BYTE = np.where(_IN_WORD, np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(0))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of the words, their 64-bit hashes): sums of byte values times powers of a prime by the place in the word.
    The powers run on over all bytes, and each word's sum is divided by the power that it began with."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 1, bool)
    inside[1:] = _IN_WORD[codes]
    starts = np.flatnonzero(inside[1:] > inside[:-1])
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    powers, inverse = _POWERS if len(codes) <= PIECE else (_powers(_PRIME, len(codes)), _powers(_INVERSE, len(codes)))
    return starts, np.add.reduceat(_BYTE[codes] * powers[: len(codes)], starts) * inverse[starts]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    return _hashed((text or "").lower().encode())[1]


class Vocabulary:
    """Word hash -> id from 1, 0 for other words; looked up by the hash's low bits, then compared."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        self.bits = np.uint64(max(12, 4 + int(self.size).bit_length()))
        self.kind = np.uint16 if self.size < 65536 else np.uint32
        self.rest = np.sort(hashes)
        slot = self._slot(self.rest)
        self.first = np.zeros(1 << int(self.bits), np.uint32)
        self.known = np.concatenate([np.zeros(1, np.uint64), self.rest])
        self.first[slot] = np.arange(1, self.size + 1)
        kept = np.zeros(self.size + 1, bool)
        kept[self.first[slot]] = True
        self.others = self.rest[~kept[1:]]  # few: they share a slot with another word

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> (np.uint64(64) - self.bits)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = self.first[self._slot(hashes)]
        wrong = np.flatnonzero((out > 0) & (self.known[out] != hashes))
        if len(wrong):
            at = np.searchsorted(self.rest, hashes[wrong])
            out[wrong] = np.where(self.rest[np.minimum(at, self.size - 1)] == hashes[wrong], at + 1, 0)
        return out.astype(self.kind)


def _coded(texts, vocabulary: Vocabulary):
    """The word ids of each text; as many texts are looked up at once as ``PIECE`` holds."""
    held, size = [], 0
    for text in texts:
        data = (text or "").lower().encode()
        if held and size + len(data) >= PIECE:
            yield from _looked_up(held, vocabulary)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    yield from _looked_up(held, vocabulary)


def _looked_up(texts: list[bytes], vocabulary: Vocabulary):
    starts, hashes = _hashed(b"\n".join(texts))
    cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])).tolist()
    ids = vocabulary.ids(hashes)
    return (ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False))


def words_of(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, words binary): the word ids of whole texts."""

    def coded(batches):
        for batch in batches:
            coded = [x.tobytes() for x in _coded(batch.column(1).to_pylist(), vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], ["doc_id", "words"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(coded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, words binary")


def _batches(rows, kind):
    """Texts joined up to about BATCH words (a single long one may be longer): their ids, words, and first words."""
    held, size = [], 0
    for i, raw in rows:
        words = np.frombuffer(raw, kind)
        if len(words):
            held.append((i, words))
            size += len(words)
        if size >= BATCH:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    return [i for i, _ in held], np.concatenate([w for _, w in held]), np.cumsum([0, *(len(w) for _, w in held)])


def _windows(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of the passages of each text, ``step`` words apart."""
    n = np.diff(first)
    counts = np.maximum(1, -(-(n - PASSAGE) // step) + 1) if step < PASSAGE else -(-n // step)
    of = np.repeat(np.arange(len(n)), counts)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * step + first[of]
    return at, np.minimum(at + PASSAGE, first[of + 1]), of


def _sums(words: np.ndarray, first: np.ndarray, at: np.ndarray, end: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each window, which begins at a step of its text: by running sums over the steps. Words
    with id 0 weigh nothing."""
    steps = -(-np.diff(first) // STEP)
    offset = np.cumsum(steps) - steps  # steps before each text
    laid = np.zeros((int(steps.sum()), STEP), words.dtype)
    laid.ravel()[np.arange(len(words)) + np.repeat(offset * STEP - first[:-1], np.diff(first))] = words
    running = np.zeros((len(laid) + 1, table.shape[1]), np.float32)
    for place in laid.T:
        running[1:] += table[place]
    np.cumsum(running, axis=0, out=running)
    a = offset[of] + (at - first[of]) // STEP
    return running[a - (at - end) // STEP] - running[a]


def document_counts(texts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """(documents that have each word, all documents)."""
    size, kind = vocabulary.size + 1, vocabulary.kind

    def count(batches):
        seen, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n += 1
                here = np.zeros(size, bool)
                here[np.frombuffer(raw, kind)] = True
                seen[:-1] += here
        seen[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(seen, pa.int64())], ["c", "n"])

    rows = texts.select("words").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()  # the round's vocabulary
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r.c] = r.n
    return out[:-1], int(out[-1])


def _summed(parts: DataFrame, lanes: int) -> DataFrame:
    """Adds up the vectors (block, v binary) of each block in ``lanes`` lanes; a task holds one sum for each of its blocks."""

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, lane, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                v = np.frombuffer(raw, np.float64)
                sums[block, lane] = sums[block, lane] + v if (block, lane) in sums else v.copy()
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["block", "lane", "v"])

    dealt = parts.select("block", F.pmod("lane", F.lit(lanes)).alias("lane"), "v")
    return dealt.repartition("block", "lane").mapInArrow(add, "block int, lane int, v binary")


def latent_bases(texts: DataFrame, parts: list[Items], dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """For each part, words x dimensions: the leading right singular vectors of the TF-IDF matrix of all passages (unit
    length each) over the part's words. One pass over the texts serves all parts."""
    widths = [min(dimensions + OVERSAMPLE, len(p.idf)) for p in parts]
    sizes = [-(-len(p.idf) // BLOCKS) * BLOCKS for p in parts]
    randoms = [np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(p.idf), w)))[0] for p, w in zip(parts, widths, strict=True)]
    weighted = [(r * p.idf[:, None]).astype(np.float32) for r, p in zip(randoms, parts, strict=True)]
    kind = parts[0].coded

    def multiply(batches):
        from pyspark import TaskContext

        outs = [np.zeros((size, width)) for size, width in zip(sizes, widths, strict=True)]
        for _, coded, first in _batches(((None, raw) for batch in batches for raw in batch.column(0).to_pylist()), kind):
            at, _, _ = _windows(first, PASSAGE)
            for part, weights, out in zip(parts, weighted, outs, strict=True):
                words = part.own(coded)
                where = np.flatnonzero(words)
                if not len(where):
                    continue
                words = words[where]
                passage = np.searchsorted(at, where, side="right") - 1
                starts = np.flatnonzero(np.diff(passage, prepend=-1))
                scores = np.add.reduceat(weights[words], starts, axis=0) / np.add.reduceat(np.square(part.idf)[words], starts)[:, None]
                order = np.argsort(words, kind="stable")
                cuts = np.flatnonzero(np.diff(words[order].astype(np.int64), prepend=0) > 0)
                nth = (np.cumsum(np.diff(passage, prepend=passage[0]) > 0))[order]
                out[words[order[cuts]]] += np.add.reduceat(scores[nth], cuts, axis=0)
        task = TaskContext.get().partitionId()
        for i, (part, out) in enumerate(zip(parts, outs, strict=True)):
            out[: len(part.idf)] *= part.idf[:, None]
            blocks = pa.array(range(i * BLOCKS, (i + 1) * BLOCKS), pa.int32())
            yield pa.RecordBatch.from_arrays([blocks, pa.array([task] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in np.split(out, BLOCKS)], pa.binary())], ["block", "lane", "v"])

    tasks = texts.select("words").mapInArrow(multiply, "block int, lane int, v binary")
    sums = {r.block: np.frombuffer(r.v, np.float64) for r in _summed(_summed(tasks, 64), 1).collect()}  # the round's vocabulary x width numbers
    out = []
    for i, (part, random, width) in enumerate(zip(parts, randoms, widths, strict=True)):
        y = np.concatenate([sums[i * BLOCKS + j] for j in range(BLOCKS)]).reshape(-1, width)[: len(part.idf)] if sums else np.zeros(random.shape)
        if not y.any():
            out.append(random[:, :dimensions])
            continue
        y = y + np.finfo(np.float64).eps * np.linalg.norm(y) * 100 * random
        inner = random.T @ y
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        keep = values > values.max() * 1e-10
        left, _, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
        out.append(left[:, :dimensions])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def common_words(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, in bit-parallel form."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    rest = full
    for w in text:
        if hit := masks.get(w, 0) & rest:
            rest = (rest + hit | rest - hit) & full
    return len(item) - rest.bit_count()


class Items:
    """A part of the benchmark: words, answers, and the latent vectors of its passages. Word ids are the part's own."""

    def __init__(self, rows: list[tuple]):
        hashed = [(i, word_hashes(text), len(word_hashes(_SENTENCE.split(text.strip())[-1]))) for i, text in rows]
        hashed = [x for x in hashed if len(x[1])]
        every = np.unique(np.concatenate([h for _, h, _ in hashed])) if hashed else np.zeros(0, np.uint64)
        self.vocabulary = Vocabulary(every)
        self.ids = [i for i, _, _ in hashed]
        self.words = [self.vocabulary.ids(h) for _, h, _ in hashed]
        self.answers = [min(len(h), max(3, last)) for _, h, last in hashed]

    def join(self, vocabulary: Vocabulary, seen: np.ndarray, documents: int) -> None:
        """Takes its place in a round: texts come in the ids of the round's ``vocabulary``, which has these document counts."""
        there = vocabulary.ids(self.vocabulary.known[1:])
        self.coded = vocabulary.kind
        self.local = None
        if vocabulary.size != self.vocabulary.size:
            self.local = np.zeros(vocabulary.size + 1, self.vocabulary.kind)
            self.local[there] = np.arange(1, self.vocabulary.size + 1)
        self.idf = np.concatenate([[0.0], np.log((documents + 1) / (seen[there] + 0.5)).clip(LEAST_IDF)])

    def own(self, coded: np.ndarray) -> np.ndarray:
        """The round's word ids as this part's."""
        return coded if self.local is None else self.local[coded]

    def place(self, basis: np.ndarray, cosine: float, verdict: tuple[float, float, float] = (LCS, LCS_WITH_ANSWER, ANSWER)) -> None:
        self.lcs, self.lcs_with_answer, self.answer = verdict
        self.table = (basis * self.idf[:, None]).astype(np.float32)
        self.ranked = np.argsort(-self.idf, kind="stable")  # words from the heaviest to those that weigh nothing
        self.rank = np.empty(len(self.idf), self.vocabulary.kind)
        self.rank[self.ranked] = np.arange(len(self.idf))
        _, words, first = _joined(list(zip(self.ids, self.words, strict=True)))
        at, end, self.of = _windows(first, STEP)
        self.vectors = _unit(_sums(words, first, at, end, self.of, self.table))
        self.sets = [np.unique(words[a:b]) for a, b in zip(at, end, strict=True)]
        self.least = np.array([SHARED * self.idf[x].sum() for x in self.sets]) * ROUNDING
        self.bars = (cosine * np.minimum(1, np.sqrt((end - at) / (0.75 * PASSAGE)))).astype(np.float32)

    def check(self, k: int, words: np.ndarray, at: int) -> tuple[float, float]:
        """(share of item k found in order around the passage at ``at``, share of its answer)."""
        item = self.words[k]
        around = words[max(0, at - len(item)) : at + PASSAGE + len(item)]
        here = np.zeros(self.vocabulary.size + 1, bool)
        here[around] = True
        if (share := here[item].mean()) < self.lcs_with_answer:  # no more words in order than words
            return float(share), 0.0
        item, around = item.tolist(), around.tolist()
        return common_words(item, around) / len(item), common_words(item[-self.answers[k] :], around) / self.answers[k]

    def find(self, coded: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(text, item id, cosine, lcs, answer) of the windows of the joined texts that hold an item."""
        words = self.own(coded)
        at, end, of = _windows(first, STEP)
        some = np.concatenate([[0], np.cumsum(self.idf[words])])
        heavy = some[end] - some[at]
        full = np.flatnonzero(heavy >= self.least.min())  # a window shares no more weight than it has
        if not len(full):
            return []
        at, end, of, heavy = at[full], end[full], of[full], heavy[full]
        near = _unit(_sums(words, first, at, end, of, self.table)) @ self.vectors.T
        which, passage = np.divmod(np.flatnonzero((near >= self.bars) & (heavy[:, None] >= self.least)), near.shape[1])
        place = at[:, None] + np.arange(PASSAGE)
        ranks = self.rank[np.where(place < end[:, None], words[np.minimum(place, len(words) - 1)], 0)]
        ranks.sort(axis=1)
        held = self.ranked[ranks]
        weights = self.idf[held]
        rest = weights[:, HEAVIEST:].sum(1)
        # What the heaviest words share and all the others weigh settles most pairs.
        maybe = self.shared(which, passage, held[:, :HEAVIEST], weights[:, :HEAVIEST]) + rest[which] >= self.least[passage] * ROUNDING
        which, passage = which[maybe], passage[maybe]
        enough = self.shared(which, passage, held, weights) >= self.least[passage]
        out, done = [], set()
        for w, p in zip(which[enough].tolist(), passage[enough].tolist(), strict=True):
            doc, k = int(of[w]), int(self.of[p])
            if (doc, k) in done:
                continue
            share, answer = self.check(k, words[first[doc] : first[doc + 1]], int(at[w] - first[doc]))
            if share >= self.lcs or share >= self.lcs_with_answer and answer >= self.answer:
                if share == 1:
                    done.add((doc, k))
                out.append((doc, self.ids[k], float(near[w, p]), share, answer))
        return out

    def shared(self, which: np.ndarray, passage: np.ndarray, held: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weight of each pair's window's words that its passage has."""
        out, width = np.zeros(len(which)), self.vocabulary.size + 1
        for x in range(0, len(which), 16384):
            y = slice(x, x + 16384)
            out[y] = np.einsum("ij,ij->i", self.holds(passage[y, None] * width + held[which[y]]), weights[which[y]])
        return out

    def holds(self, pairs: np.ndarray) -> np.ndarray:
        """Which of the pairs (passage * width + word) are of a passage and a word that it has. Looked up in a table of all pairs
        where that is small, else among the sorted pairs that are; either is made where it is used."""
        if "_pairs" not in self.__dict__:
            width = self.vocabulary.size + 1
            held = np.concatenate([np.zeros(0, np.int64), *(i * width + words.astype(np.int64) for i, words in enumerate(self.sets))])
            self._dense = len(self.sets) * width <= TABLE
            if self._dense:
                self._pairs = np.zeros(len(self.sets) * width, bool)
                self._pairs[held] = True
            else:
                self._pairs = np.sort(held)
        if self._dense:
            return self._pairs.take(pairs)
        return self._pairs.take(np.searchsorted(self._pairs, pairs), mode="clip") == pairs


def _rounds(benchmark: DataFrame, item_col: str, item_text: str, part_items: int):
    """(item id's type, the parts of each round)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    n, words = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    parts = max(1, -(-n // part_items), -(-words // PART_WORDS))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def rounds():
        for at in range(0, parts, ROUND):
            rows: dict[int, list[tuple]] = {}
            for r in items.where((F.col("part") >= at) & (F.col("part") < at + ROUND)).collect():  # part_items * ROUND, about
                rows.setdefault(r.part, []).append((r.item_id, r.text))
            if group := [p for p in map(Items, rows.values()) if p.ids]:
                yield group

    return items.schema["item_id"].dataType, rounds()


def _fitted(docs: DataFrame, group: list[Items], cosine: float, verdict: tuple[float, float, float]) -> tuple[DataFrame, Vocabulary]:
    """The coded texts of ``docs`` (doc_id, text) and their vocabulary; the parts are ready to find their items."""
    vocabulary = Vocabulary(np.unique(np.concatenate([p.vocabulary.known[1:] for p in group])))
    texts = settle(words_of(docs, vocabulary), "words")
    seen, n = document_counts(texts, vocabulary)
    for part in group:
        part.join(vocabulary, seen, n)
    for part, basis in zip(group, latent_bases(texts, group), strict=True):
        part.place(basis, cosine, verdict)
    return texts, vocabulary


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, part_items: int = PART, verdict: tuple[float, float, float] = (LCS, LCS_WITH_ANSWER, ANSWER)) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer): the documents that hold an item, or a paraphrase of it that keeps
    most of its words in order, with the best of their passages; a pair comes once, repeated ids as one document.
    ``verdict``: the share of its words in order that makes a leak, or a lower one with that share of its answer.

    Null and empty texts and items hold nothing and are held by nothing; null ids are kept; empty tables give no rows;
    other columns are left out, whatever their names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    item_type, rounds = _rounds(benchmark, item_col, item_text, part_items)
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, cosine double, lcs double, answer double"
    out = docs.sparkSession.createDataFrame([], shape)
    for group in rounds:
        texts, vocabulary = _fitted(rows, group, cosine, verdict)
        out = out.unionByName(texts.mapInArrow(_searcher(group, vocabulary.kind, to_arrow_type(item_type)), shape))
    best = F.max_by(F.struct("cosine", "lcs", "answer"), F.struct("lcs", "answer", "cosine"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _searcher(group: list[Items], kind, item_kind: pa.DataType):
    def search(batches):
        for batch in batches:
            out: list[tuple] = []
            for ids, coded, first in _batches(zip(range(len(batch)), batch.column(1).to_pylist(), strict=True), kind):
                for part in group:
                    out += [(ids[doc], *rest) for doc, *rest in part.find(coded, first)]
            doc_ids = batch.column(0).take(pa.array([r[0] for r in out], pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([r[1] for r in out]).cast(item_kind) if out else pa.array([], item_kind), *(pa.array([r[i] for r in out], pa.float64()) for i in (2, 3, 4))], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return search


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", cosine: float = COSINE, part_items: int = PART, verdict: tuple[float, float, float] = (LCS, LCS_WITH_ANSWER, ANSWER)) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, in all their columns, whatever their names. Rows are
    judged by their own text: null ids and rows that repeat an id make no difference. Nothing is joined or shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    for group in _rounds(benchmark, "item_id", "text", part_items)[1]:
        _, vocabulary = _fitted(rows, group, cosine, verdict)
        docs = docs.where(~_holds(group, vocabulary)(F.col(text)))
    return docs


def _holds(group: list[Items], vocabulary: Vocabulary):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        coded = enumerate(_coded(texts, vocabulary))
        for ids, words, first in _batches(coded, vocabulary.kind):
            for part in group:
                for found in part.find(words, first):
                    out[ids[found[0]]] = True
        return pd.Series(out)

    return holds
