"""Word lists of any size: inflections, and how much of a label words cover.

A label's pieces of 3 to 14 letters are joined to the words; what comes back is the longest word at each place, so greedy
covering from the left is a fold over at most 63 numbers. A label has at most 700 pieces, and each distinct label is
looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.dims import word_list

#: Words up to which they are broadcast (a word is some 30 bytes); more are joined by a shuffle.
BROADCAST_WORDS = 500_000
# Lengths of words that count, and the endings that inflected words have.
SHORTEST, LONGEST = 3, 14
ENDINGS = ("ing", "ers", "ed", "es", "er", "ly", "s")
VOWELS, ELISION = "aeiou", 6


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word): words of text files, with their inflections, lower-cased."""
    return inflections(word_list(spark, path).select(F.lower("word").alias("word")))


def inflections(words: DataFrame) -> DataFrame:
    """Rows (word), distinct: the words, with plain endings, doubled consonants, dropped e, and one vowel left out of longer ones."""
    w = F.col("word")
    doubled = F.concat(w, F.right(w, F.lit(1)))
    shortened = F.when(w.endswith("e") & (F.length(w) >= 4), F.expr("left(word, length(word) - 1)"))
    stems = F.filter(F.array(w, doubled, shortened), lambda s: s.isNotNull())
    ended = F.flatten(F.transform(stems, lambda s: F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(s, e))))
    places = F.sequence(F.lit(1), F.length(w))
    elided = F.transform(F.filter(places, lambda i: F.instr(F.lit(VOWELS), w.substr(i, F.lit(1))) > 0), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    every = F.concat(F.array(w), ended, F.when(F.length(w) >= ELISION, elided).otherwise(F.array().cast("array<string>")))
    return words.where("word <> ''").select(F.explode(every).alias("word")).distinct()


def _letters(label: Column) -> Column:
    return F.regexp_replace(F.coalesce(label, F.lit("")), "[^a-z]", "")


def coverage(df: DataFrame, lexicon: DataFrame, label: Column | str) -> DataFrame:
    """Adds ``coverage``: the share of the label's letters (a to z, others left out) that words cover, the longest word of 3 to
    14 letters first, from the left. 0 for null labels and those without letters. ``lexicon``: rows (word)."""
    label = F.col(label) if isinstance(label, str) else label
    df = df.withColumn("_letters", _letters(label))
    keys = df.select(F.col("_letters").alias("_k")).where(F.length("_k") >= SHORTEST).distinct()
    starts = keys.select("_k", F.explode(F.sequence(F.lit(1), F.length("_k") - SHORTEST + 1)).alias("_at"))
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("_k") - F.col("_at") + 1))
    pieces = starts.select("_k", "_at", F.explode(sizes).alias("_n")).withColumn("word", F.col("_k").substr(F.col("_at"), F.col("_n")))
    words = lexicon.select("word").where(F.length("word").between(SHORTEST, LONGEST)).distinct()
    if words.count() <= BROADCAST_WORDS:
        words = F.broadcast(words)
    longest = pieces.join(words, "word", "left_semi").groupBy("_k", "_at").agg(F.max("_n").alias("_n"))
    found = longest.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("_words"))  # one for each letter at most
    start = F.struct(F.lit(1).alias("free"), F.lit(0).alias("covered"))

    def step(state: Column, word: Column) -> Column:
        taken = F.struct((word["_at"] + word["_n"]).alias("free"), (state["covered"] + word["_n"]).alias("covered"))
        return F.when(word["_at"] >= state["free"], taken).otherwise(state)

    covered = F.aggregate("_words", start, step)["covered"]
    out = df.join(found, df["_letters"] == found["_k"], "left")
    return out.withColumn("coverage", F.coalesce(covered / F.length("_letters"), F.lit(0.0))).drop("_letters", "_k", "_words")
