"""Token encoding with public vocabularies, and the exact length histogram over it."""

from __future__ import annotations

import functools
import re
import sys
from array import array

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.llm.store import settle

#: Distinct white-space chunks whose ids a Python worker remembers; beyond it chunks are encoded anew each time.
CACHE_ENTRIES = 400_000
#: Letters that a chunk may have to be remembered.
REMEMBERED = 48

# The vocabulary's pre-tokenizer, for printable ASCII and Latin letters. These are normalised already, but
# for the dotted capital I, whose lower case is two characters; chunks with others are left to the tokenizer as a whole.
_LETTERS, _NUMERALS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+").fullmatch
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^{_LETTERS}{_NUMERALS}]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class ChunkIds(dict):
    """Chunk of UTF-8 without ASCII white space -> its ids as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so the ids of a text are the ids of its
    chunks one after another. Most running text repeats a small set of chunks, hence the memory; a chunk of plain letters
    goes to the merges at once, without the tokenizer's normaliser.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def _encode(self, chunk: str) -> list[int]:
        if not _PLAIN(chunk) or "<|" in chunk:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out = []
        for piece in _PIECES(chunk.lower()):
            if not piece.isascii():
                piece = "".join(map(self.letters.__getitem__, piece.encode()))
            out += [t.id for t in self.merge(piece)]
        return out

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(self) < CACHE_ENTRIES and len(chunk) <= REMEMBERED:
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        data = (text or "").encode()
        # Lower case could turn other text into a control string, or let a letter meet a mark (their first bytes: CC, CD)
        # that it has one character with in lower case only.
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


@functools.lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """text -> number of tokens, for each kind of vocabulary file of the installed package."""
    if path.endswith("word_bpe_49k.json"):
        ids = chunk_ids(path).ids
        return lambda text: len(ids(text)) >> 2
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: len(whole.encode(text or "", add_special_tokens=False).ids)
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(own.encode_ordinary(text or ""))
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(pieces.encode(text or "", num_threads=1))


def token_count(text, tokenizer: str = "word_bpe_49k.json"):
    """Column: number of tokens of a text column; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        n = counter(public_tokenizers.path(tokenizer))
        return texts.map(n)

    return count(text)


def length_histogram(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text: str = "text") -> DataFrame:
    """Rows (n_tokens, n_docs): how many documents have each encoded length. Null texts count as empty; an empty table
    gives no rows; repeated rows count each time. The partial sums leave at most one row per length and task to shuffle."""
    return docs.select(token_count(F.col(text), tokenizer).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


#: Lengths that share a block in the two-level running sums.
BLOCK = 512


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every context limit at which anything changes (each length that occurs), from the histogram alone:

    docs_within / tokens_within: documents of at most ``n_tokens`` tokens and their tokens; docs_over / tokens_over: the
    suffix sums above it; truncated_tokens: tokens left if every document is cut at the limit; quantile: share of the
    documents within it. A limit between two lengths L < m < next gives truncated_tokens(L) + (m - L) * docs_over(L).

    Running sums go in two levels (within a block of lengths, then over block totals), so no task holds all lengths. The
    histogram is read twice for that, so it is written first: no text is encoded twice.
    """
    histogram = settle(histogram, "length_histogram")
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    here = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(every).alias("docs"),
        F.sum("t").over(every).alias("tokens"),
    )
    sums = h.select(
        "block", "n_tokens", "n_docs",
        F.sum("n_docs").over(here).alias("d"),
        F.sum(F.col("n_docs") * F.col("n_tokens")).over(here).alias("t"),
    ).join(blocks, "block")
    within, inside = F.col("d") + F.col("docs_before"), F.col("t") + F.col("tokens_before")
    return sums.select(
        "n_tokens", "n_docs",
        within.alias("docs_within"), inside.alias("tokens_within"),
        (F.col("docs") - within).alias("docs_over"), (F.col("tokens") - inside).alias("tokens_over"),
        (inside + F.col("n_tokens") * (F.col("docs") - within)).alias("truncated_tokens"),
        (within / F.col("docs")).alias("quantile"),
    )
