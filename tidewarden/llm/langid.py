"""Language identification by compression with one zstandard raw-content dictionary per language.

A text costs fewest bytes under the dictionary of its own language. Whole texts count: they are compressed in blocks, so
that a long text doesn't become its own dictionary, and the sizes are added. Where the runner-up costs hardly more, the
decision is marked as rejected.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fit's bounded sample for each language: distinct whole texts, and bytes of the dictionary that they fill.
SAMPLE_TEXTS, DICTIONARY_BYTES = 160, 131_072
#: Bytes of text that one compression call sees.
BLOCK = 4096
LEVEL = 3
#: Share of its cost by which the runner-up must be dearer.
MARGIN = 0.004
NO_LETTER = "und"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Dictionary content by language: whole texts, at most ``sample_texts`` distinct ones of each language, in the order of
    their hashes, as long as they fit ``DICTIONARY_BYTES``.

    Rows with a null text or language are passed over; copies count once; without any row left there is no language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.octet_length("text") < DICTIONARY_BYTES).withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(1.5 * sample_texts / n))))  # the counts are off by some
    picked = rows.where(F.pmod("h", F.lit(1 << 40)) / F.lit(1 << 40) < F.element_at(rate, F.col("lang"))).distinct()
    texts: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    for r in picked.collect():  # twice sample_texts at most, but for chance
        texts[r.lang].append((r.h, r.text))
    return {k: _content([x.encode() for _, x in sorted(v)[:sample_texts]]) for k, v in texts.items() if v}


def _content(texts: list[bytes]) -> bytes:
    out, room = [], DICTIONARY_BYTES
    for x in texts:
        if len(x) < room:
            out.append(x)
            room -= len(x) + 1
    return b"\n".join(out)


@functools.lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    out = []
    for lang, content in model:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False).compress))
    return out


_LETTER = re.compile(r"[^\W\d_]")


def identify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, rejected). Score: from 0.5 (no margin) to 1; 0 for a text without letters."""
    if not text or not _LETTER.search(text) or not model:
        return NO_LETTER, 0.0, True
    data = text.encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    costs = sorted((sum(len(c(b)) for b in blocks), lang) for lang, c in _compressors(model))
    if len(costs) == 1:
        return costs[0][1], 1.0, False
    saved = costs[1][0] - costs[0][0]
    return costs[0][1], 1 / (1 + math.exp(-saved / 4)), saved < MARGIN * costs[0][0]


def detect(text, model: dict[str, bytes]):
    """Column struct (lang, score, rejected) of a text column; null texts and texts without a letter are ``und``."""
    fixed = tuple(sorted(model.items()))

    @F.pandas_udf("struct<lang string, score double, rejected boolean>")
    def languages(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(x, fixed) for x in texts], columns=["lang", "score", "rejected"])

    return languages(text)


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, rejected), one for each row of ``docs``; repeated rows, null ids and an empty table
    are passed through, other columns left out."""
    return docs.select(F.col(id_col).alias("doc_id"), detect(F.col(text), model).alias("p")).select("doc_id", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def accepted(docs: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected, in all their columns, whatever their names: those by a narrow
    margin, and null texts and texts without a letter. Repeated rows and null ids are kept as others are."""
    return docs.where(~F.coalesce(detect(F.col(text), model)["rejected"], F.lit(True)))
