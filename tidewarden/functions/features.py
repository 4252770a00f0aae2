"""Lexical features of canonical, classified names."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewarden import dims
from tidewarden.functions import lexicon
from tidewarden.functions import text as T
from tidewarden.functions.text import bound


@functools.lru_cache(maxsize=1)
def _lexicon() -> frozenset[str]:
    return frozenset(dims.inflected(dims.WORDS))


def coverage_of(label: str | None) -> float:
    """Share of a label's letters covered by words of 14 to 3 letters, longest first from the left."""
    letters = "".join(c for c in label or "" if "a" <= c <= "z")
    words, i, covered = _lexicon(), 0, 0
    while i < len(letters):
        n = next((n for n in range(min(14, len(letters) - i), 2, -1) if letters[i : i + n] in words), 0)
        covered, i = covered + n, i + max(1, n)
    return covered / len(letters) if letters else 0.0


@F.pandas_udf(DoubleType())
def dictionary_coverage(labels: pd.Series) -> pd.Series:
    return labels.map(coverage_of)


def typo_budget(brand: str) -> int:
    return 2 if len(brand) >= 8 else 1


def below_suffix(domain: Column, suffix: Column) -> Column:
    """A name without its public suffix; a bare suffix as it is."""
    cut = F.length(domain) - F.length(suffix) - 1
    return F.when(domain.endswith(F.concat(F.lit("."), suffix)), F.substring(domain, F.lit(1), cut)).otherwise(domain)


def brand_match(analysed: Column, sld: Column, registrable: Column, bad_suffix: Column, keyword: Column) -> Column:
    """struct(brand, how): the first brand of the list that is the registrable label, a token of the name below its suffix,
    or the label but for few edits; without any, the first that is contained.

    A brand's own domains don't match it. A bare label is the brand's own but on a suspicious suffix; a token counts beside
    such a suffix or a keyword (``keyword``); a near miss counts by itself."""
    brands = [(b, own, typo_budget(b)) for b, own in dims.BRANDS.items() if len(b) >= 5]
    tokens = T.tokens(analysed)
    found, contained = [], []
    for b, own, budget in brands:
        how = (
            F.when(registrable.isin(own), F.lit(None).cast("string"))
            .when(sld == b, F.when(bad_suffix, "brand_on_suspicious_tld").otherwise("brand_owned"))
            .when(F.array_contains(tokens, b), F.when(bad_suffix | keyword, "token").otherwise("brand_token_uncorroborated"))
            .when(F.levenshtein(sld, F.lit(b), budget) >= 0, "typosquat")
        )
        found.append(F.when(how.isNotNull(), F.struct(F.lit(b).alias("brand"), how.alias("how"))))
        inside = ~registrable.isin(own) & F.contains(analysed, F.lit(b))
        contained.append(F.when(inside, F.struct(F.lit(b).alias("brand"), F.lit("substring").alias("how"))))
    return F.coalesce(*found, *contained)


def lookup(table: dict[str, float], key: Column) -> Column:
    """The number of a small literal table; 0 for other keys."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(0.0))


def featurize(df: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Adds ``feat``. Shares of digits and hyphens are of the whole name without dots, those of vowels and consonants of its
    letters; runs of consonants go by label. ``label_*``: the registrant's label, which coverage is of. ``words``: a lexicon
    of any size, in place of the short one of ``dims``."""
    domain, suffix = F.coalesce("name.domain", F.lit("")), F.coalesce("name.public_suffix", F.lit(""))
    df = df.withColumns(
        {
            "_domain": domain, "_flat": F.replace(domain, F.lit("."), F.lit("")), "_sld": F.coalesce("name.sld", F.lit("")),
            "_labels": F.coalesce("name.labels", F.array().cast("array<string>")), "_analysed": below_suffix(domain, suffix),
            "_bad_suffix": suffix.isin(list(dims.TLD_WEIGHTS)),
        }
    )
    df = df.withColumns(
        {
            "_semantic": F.coalesce(F.nullif("cls.scopes.semantic_text", F.lit("")), "_analysed"), "_h": T.entropy(F.col("_flat")), "_n": F.greatest(F.length("_flat"), F.lit(1)),
            "_digits": T.count_of(F.col("_flat"), "0-9"), "_hyphens": T.count_of(F.col("_flat"), "-"), "_vowels": T.count_of(F.col("_flat"), T.VOWELS), "_letters": T.count_of(F.col("_flat"), "a-z"),
        }
    )
    df = df.withColumn("_keywords", T.minimal_matches(F.col("_semantic"), list(dims.KEYWORDS)))
    if words is not None:
        df = lexicon.coverage(df.withColumnRenamed("_letters", "_alphas"), words, "_sld").withColumnsRenamed({"_alphas": "_letters", "coverage": "_covered"})
    n, letters, flat = F.col("_n"), F.col("_letters"), F.col("_flat")
    keyword = F.exists(F.array(*map(F.lit, dims.KEYWORDS)), lambda k: F.contains("_analysed", k))
    weights = F.create_map(*(F.lit(x) for kv in dims.KEYWORDS.items() for x in kv))
    brand = brand_match(F.col("_analysed"), F.col("_sld"), F.coalesce("name.registrable_domain", F.lit("")), F.col("_bad_suffix"), keyword)
    depth = F.when(F.length("name.subdomain") > 0, F.size(F.split("name.subdomain", r"\."))).otherwise(0)
    feat = F.struct(
        F.length("_domain").alias("length"), F.length("_sld").alias("sld_length"), F.size("_labels").alias("label_count"), depth.alias("subdomain_depth"),
        F.coalesce(F.array_max(F.transform("_labels", F.length)), F.lit(0)).alias("max_label_length"),
        (F.length("_flat") / F.greatest(F.size("_labels"), F.lit(1))).alias("mean_label_length"),
        (F.col("_digits") / n).alias("digit_ratio"), (F.col("_hyphens") / n).alias("hyphen_ratio"), F.col("_hyphens").alias("hyphens"),
        F.when(letters > 0, F.col("_vowels") / letters).otherwise(0.0).alias("vowel_ratio"),
        F.when(letters > 0, (letters - F.col("_vowels")) / letters).otherwise(0.0).alias("consonant_ratio"),
        (letters / n).alias("letter_ratio"), F.greatest(F.lit(0.0), 1 - (letters + F.col("_digits") + F.col("_hyphens")) / n).alias("other_ratio"),
        (F.size(F.array_distinct(F.filter(F.split(flat, ""), lambda c: c != ""))) / n).alias("unique_ratio"),
        F.coalesce(F.array_max(F.transform("_labels", lambda x: T.max_run(x, T.CONSONANTS))), F.lit(0)).alias("consonant_run"),
        T.max_run(flat, "0-9").alias("digit_run"), T.max_repeat(flat).alias("repeat_run"),
        F.col("_h").alias("entropy"), T.entropy(F.col("_sld")).alias("sld_entropy"), F.when(n > 1, F.col("_h") / F.log2(n)).otherwise(0.0).alias("normalized_entropy"),
        (dictionary_coverage("_sld") if words is None else F.col("_covered")).alias("coverage"), lookup(dims.TLD_WEIGHTS, F.col("name.tld")).alias("tld_weight"), F.col("_keywords").alias("keywords"),
        F.coalesce(F.array_max(F.transform("_keywords", lambda k: F.element_at(weights, k))), F.lit(0.0)).alias("keyword_weight"),
        F.when(F.col("name.is_ip_literal"), F.lit(None)).otherwise(brand).alias("brand"), F.col("name.is_punycode").alias("is_punycode"),
    )
    return df.withColumn("feat", bound(feat)).drop("_domain", "_flat", "_sld", "_labels", "_analysed", "_bad_suffix", "_semantic", "_h", "_n", "_digits", "_hyphens", "_vowels", "_letters", "_keywords", "_covered")


def shown(df: DataFrame) -> DataFrame:
    """The features of each name as an interface shows them: rounded to three digits, weights to two."""
    threes = ("mean_label_length", "digit_ratio", "hyphen_ratio", "vowel_ratio", "consonant_ratio", "letter_ratio", "other_ratio", "unique_ratio", "entropy", "sld_entropy", "normalized_entropy", "coverage")
    twos = ("tld_weight", "keyword_weight")
    f = df.schema["feat"].dataType.names
    rounded = {c: F.round(F.col(f"feat.{c}"), 3 if c in threes else 2).alias(c) for c in threes + twos}
    return df.select("name.domain", *(rounded.get(c, F.col(f"feat.{c}").alias(c)) for c in f))
