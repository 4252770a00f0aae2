"""Letter-pair model for generated names: counts, smoothing and calibration as aggregations."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-"
SMOOTHING = 0.1


def pair_counts(labels: DataFrame, column: str = "label") -> DataFrame:
    """Rows (prev, next, n) of the letter pairs of all labels, ends marked ^ and $."""
    marked = F.concat(F.lit("^"), F.regexp_replace(F.lower(column), "[^a-z0-9-]", ""), F.lit("$"))
    rows = labels.select(marked.alias("s")).where("length(s) > 2")
    pairs = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.col("s").substr(i, F.lit(2)))).alias("p"))
    return pairs.groupBy(F.substring("p", 1, 1).alias("prev"), F.substring("p", 2, 1).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """Rows (prev, next, log_prob) over the full grid, add-0.1 smoothed; each row of the grid sums to 1."""
    spark = counts.sparkSession
    prev = spark.createDataFrame([(c,) for c in "^" + ALPHABET], "prev string")
    following = spark.createDataFrame([(c,) for c in ALPHABET + "$"], "next string")
    grid = prev.crossJoin(F.broadcast(following))  # 38 x 38 letters
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    full = grid.join(counts, ["prev", "next"], "left").join(totals, "prev", "left")
    size = len(ALPHABET) + 1
    return full.select("prev", "next", F.log((F.coalesce("n", F.lit(0)) + SMOOTHING) / (F.coalesce("total", F.lit(0)) + SMOOTHING * size)).alias("log_prob"))


def bigram_model(labels: DataFrame, column: str = "label") -> dict:
    """{log_probs, uniform, mean, std}: 38 x 38 numbers and the corpus' mean and population deviation under them. The corpus
    is scored with its digits, which names are scored without, as the model that this one follows does."""
    from tidewarden.operators.scorers import bigram_llr

    table = log_probabilities(pair_counts(labels, column))
    log_probs = {r["prev"] + r["next"]: r["log_prob"] for r in table.collect()}  # 38 x 38
    uniform = -math.log(len(ALPHABET) + 1)
    scored = labels.select(bigram_llr(F.lower(column), log_probs, uniform, digits=True).alias("x"))
    r = scored.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).first()
    return {"log_probs": log_probs, "uniform": uniform, "mean": r["mean"] or 0.0, "std": r["std"] or 1.0}


def separation(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each family: mean, median (the element at n // 2), and the share from the threshold on.

    Approximate quantiles bracket each median, so that only a sliver of a family's scores is ranked."""
    rows = scored.where("score is not null").select("family", "score")
    near = F.percentile_approx("score", [0.49, 0.51], 10000)
    out = rows.groupBy("family").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"), near.alias("near"), F.avg((F.col("score") >= threshold).cast("int")).alias("share"))
    inside = rows.join(F.broadcast(out.select("family", "n", "near")), "family")  # one row a family
    below = inside.groupBy("family").agg(F.count_if(F.col("score") < F.element_at("near", 1)).alias("below"))
    place = Window.partitionBy("family").orderBy("score")
    ranked = inside.where(F.col("score").between(F.element_at("near", 1), F.element_at("near", 2))).withColumn("nth", F.row_number().over(place) - 1)
    middle = ranked.join(F.broadcast(below), "family").where(F.col("nth") + F.col("below") == F.floor(F.col("n") / 2)).select("family", F.col("score").alias("median"))
    return out.join(middle, "family").select("family", "mean", "median", "share")


#: Letters that each family draws from, with repeats where one is likelier, and its shortest and longest name.
FAMILIES = {
    "letters": ("abcdefghijklmnopqrstuvwxyz", 10, 18), "letters_digits": ("abcdefghijklmnopqrstuvwxyz0123456789", 10, 18),
    "few_vowels": ("bcdfghjklmnpqrstvwxz" * 23 + "aeiou" * 20, 9, 15), "hexadecimal": ("0123456789abcdef", 12, 20),
}


def drawn(*parts: Column | str) -> Column:
    """A number below 2**32 for the parts, the same in every run and on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def generated_names(spark: SparkSession, n: int, words: list[str], seed: int = 0) -> DataFrame:
    """Rows (family, i, name): ``n`` names of each of five families, random ones by ``FAMILIES`` and pairs of ``words``."""
    rows = spark.range(n).withColumnRenamed("id", "i")

    def random(family: str, letters: str, least: int, most: int) -> DataFrame:
        at = lambda p: drawn(F.lit(f"{seed}:{family}"), F.col("i"), p)
        size = (at(F.lit("n")) % (most - least + 1) + least).cast("int")
        picked = F.transform(F.sequence(F.lit(1), size), lambda p: F.lit(letters).substr((at(p) % len(letters) + 1).cast("int"), F.lit(1)))
        return rows.select(F.lit(family).alias("family"), "i", F.array_join(picked, "").alias("name"))

    of = lambda p: F.element_at(F.array(*map(F.lit, words)), (drawn(F.lit(f"{seed}:word_pair"), F.col("i"), F.lit(p)) % len(words) + 1).cast("int"))
    pairs = rows.select(F.lit("word_pair").alias("family"), "i", F.concat(of("1"), of("2")).alias("name"))
    return functools.reduce(DataFrame.unionByName, [*(random(f, *x) for f, x in FAMILIES.items()), pairs])
