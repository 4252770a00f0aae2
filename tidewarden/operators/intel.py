"""Threat intelligence: the most specific suffix of a name that a list knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.policy import POLICY, Policy

#: Rows of a list up to which it is broadcast; longer ones are joined by shuffling both sides.
BROADCAST_ROWS = 200_000


def candidates(indicators: DataFrame, trusted: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Indicators and trusted names as one table; on the same name the indicator comes first."""
    bad = indicators.select("indicator", "verdict", "categories", "confidence", F.lit(0).alias("priority"))
    good = trusted.select(
        F.col("domain").alias("indicator"), F.lit("TRUSTED").alias("verdict"), F.array(F.lit("allowlisted")).alias("categories"),
        F.lit(policy.get("intel.trusted_confidence")).alias("confidence"), F.lit(1).alias("priority"),
    )
    rows = bad.unionByName(good)
    first = Window.partitionBy("indicator").orderBy("priority", F.desc("confidence"), "verdict")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suffixes(domain: F.Column, registrable: F.Column) -> F.Column:
    """The name and its parents down to the registrable domain."""
    labels = F.split(domain, r"\.")
    n, least = F.size(labels), F.size(F.split(registrable, r"\."))
    return F.transform(F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def lookup(names: DataFrame, known: DataFrame, domain: str = "domain", registrable: str = "registrable_domain", policy: Policy = POLICY) -> DataFrame:
    """Adds ``intel``: struct(verdict, indicator, match_type, categories, confidence); UNKNOWN with confidence 0 without a hit.

    Looked up for each distinct name once. A null name is unknown."""
    keys = names.select(F.col(domain).alias("_d"), F.col(registrable).alias("_r")).where("_d is not null and _r is not null").distinct()
    probes = keys.select("_d", F.posexplode(suffixes(F.col("_d"), F.col("_r"))).alias("_depth", "indicator"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hit = F.struct("_depth", "priority", "verdict", "indicator", "categories", "confidence")
    best = probes.join(known, "indicator").groupBy("_d").agg(F.min_by(hit, F.struct("_depth", "priority")).alias("_hit"))
    parent = F.col("_hit._depth") > 0
    is_trusted = F.col("_hit.verdict") == "TRUSTED"
    confidence = (
        F.when(is_trusted, F.when(parent, policy.get("intel.trusted_parent_confidence")).otherwise(F.col("_hit.confidence")))
        .when(parent, F.round(F.col("_hit.confidence") * policy.get("intel.parent_factor"), 3))
        .otherwise(F.col("_hit.confidence"))
    )
    found = best.select("_d", F.struct(F.col("_hit.verdict").alias("verdict"), F.col("_hit.indicator").alias("indicator"), F.when(parent, "PARENT_DOMAIN").otherwise("EXACT").alias("match_type"), F.col("_hit.categories").alias("categories"), confidence.alias("confidence")).alias("_intel"))
    none = F.struct(F.lit("UNKNOWN").alias("verdict"), F.lit(None).cast("string").alias("indicator"), F.lit(None).cast("string").alias("match_type"), F.array().cast("array<string>").alias("categories"), F.lit(0.0).alias("confidence"))
    return names.join(found, names[domain] == found["_d"], "left").withColumn("intel", F.coalesce("_intel", none)).drop("_d", "_intel")


def statistics(indicators: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows (what, name, n): how many names each verdict and each category has; trusted names are a verdict of their own."""
    count = F.count(F.lit(1)).alias("n")
    verdicts = indicators.select("verdict").unionByName(trusted.select(F.lit("TRUSTED").alias("verdict"))).groupBy(F.lit("verdict").alias("what"), F.col("verdict").alias("name")).agg(count)
    categories = indicators.select(F.explode("categories").alias("name")).groupBy(F.lit("category").alias("what"), "name").agg(count)
    return verdicts.unionByName(categories).orderBy("what", "name")
