"""Names to assessed names: each stage appends a struct; every distinct name is scored once."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden import dims
from tidewarden.functions.features import featurize
from tidewarden.functions.names import canonicalize, classify
from tidewarden.operators import detectors, fusion, intel, scorers, training
from tidewarden.policy import POLICY, Policy


@functools.lru_cache(maxsize=1)
def default_model(spark) -> dict:
    """The letter-pair model of the seed words, fitted once for a session."""
    return training.bigram_model(spark.createDataFrame([(w,) for w in dims.WORDS], "label string"))


def features(df: DataFrame, raw: str = "raw", suffixes: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``suffixes``: rules from files (see sources.suffix_rules); ``lexicon``: words (see functions.lexicon)."""
    return featurize(classify(canonicalize(df, raw, suffixes)), lexicon)


def analyze(df: DataFrame, raw: str = "raw", query_type: str | None = None, history: DataFrame | None = None, known: DataFrame | None = None, model: dict | None = None, policy: Policy = POLICY, suffixes: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds name, cls, feat, intel, the five signals and ``assessment``.

    ``history``: rows (registrable_domain, total, distinct_names, nxdomain, blocked), one a domain. ``suffixes``, ``lexicon``:
    see ``features``. A name that is none keeps its error code and has no evidence."""
    spark = df.sparkSession
    known = intel.candidates(dims.indicators(spark), dims.trusted(spark), policy) if known is None else known
    out = features(df, raw, suffixes, lexicon).withColumns({"_domain": F.col("name.domain"), "_registrable": F.col("name.registrable_domain")})
    out = intel.lookup(out, known, "_domain", "_registrable", policy)
    if history is not None:
        out = out.join(history.withColumnRenamed("registrable_domain", "_registrable"), "_registrable", "left")
    else:
        out = out.withColumns({c: F.lit(0) for c in scorers.HISTORY})
    own = {
        "behavioral": lambda df: scorers.behavioral(df, policy), "ti": lambda df: scorers.intel(df, policy), "dga": lambda df: scorers.dga(df, model or default_model(spark), policy), "lexical": lambda df: scorers.lexical(df, policy), "tunnel": lambda df: scorers.tunnel(df, query_type, policy),
    }
    for n, add in own.items():
        registered = detectors.replacing(spark, n)
        out = registered.add(out) if registered else add(out)
    for d in detectors.beside(spark):
        out = d.add(out)
    if "tunnel_indicators" not in out.columns:
        out = out.withColumn("tunnel_indicators", F.array().cast("array<string>"))
    return fusion.assess(out.drop(*scorers.HISTORY, "_domain", "_registrable", "max_risk"), policy, detectors.weights(spark, policy))


def capture_report(queries: DataFrame, limit: int | None = None, findings: int = 100, rejected: int = 25, model: dict | None = None, policy: Policy = POLICY) -> dict[str, DataFrame]:
    """Tables of a capture (domain, query_type, source_ip, is_response, seq): the ``findings`` names of highest risk, sources,
    types, totals (one row), and the first names that are none, ``rejected``, in order of arrival.

    Questions count, not responses, unless there are only responses. ``limit``: names scored, in order of arrival."""
    asked = queries.agg(F.coalesce(F.bool_or(~F.col("is_response")), F.lit(False)).alias("_any"))  # one row
    rows = queries.crossJoin(F.broadcast(asked)).where("not is_response or not _any").drop("_any")
    rows = rows.withColumn("key", F.lower(F.regexp_replace("domain", r"\.+$", "")))
    names = rows.where("key is not null").groupBy("key").agg(F.min("seq").alias("seq"))
    if limit is not None:
        names = names.orderBy("seq").limit(limit)
    judged = analyze(names, "key", model=model, policy=policy)
    codes = F.transform("assessment.factors", lambda f: f["code"])
    judged = judged.select(
        "key", "seq", "name.error_code", F.col("name.domain").alias("domain"), "name.registrable_domain", F.col("cls.kind").alias("name_kind"), "assessment.score", "assessment.classification", "assessment.decision",
        F.col("intel.verdict").alias("verdict"), F.round("dga.score", 1).alias("dga_score"), F.arrays_overlap(codes, F.array(F.lit("DGA_HIGH"), F.lit("DGA_MODERATE"))).alias("is_generated"),
        F.round("tunnel.score", 1).alias("tunnel_score"), (F.size("tunnel_indicators") > 0).alias("is_tunnel"), "tunnel_indicators",
    )
    valid = judged.where("error_code is null")
    back = rows.join(valid.select("key", "decision"), "key", "left")
    count, decided = F.count(F.lit(1)), lambda d: F.count_if(F.col("decision") == d)
    sources = back.groupBy(F.coalesce("source_ip", F.lit("unknown")).alias("source_ip")).agg(
        count.alias("queries"), F.count_distinct("key").alias("domains"), decided("BLOCK").alias("blocked"), decided("MONITOR").alias("monitored"), decided("ALLOW").alias("allowed"),
    )
    sources = sources.withColumn("threat_rate", F.round(100 * F.col("blocked") / F.col("queries"), 1)).orderBy(F.desc("blocked"), F.desc("queries"), "source_ip")
    types = rows.groupBy("query_type").agg(count.alias("n")).orderBy(F.desc("n"), "query_type")
    classed = lambda c: F.count_if(F.col("classification") == c)
    total = judged.groupBy().agg(
        count.alias("names"), F.count_if(F.col("error_code").isNotNull()).alias("rejected"),
        *(F.count_if(F.col("error_code").isNull() & x).alias(n) for n, x in (
            ("malicious", F.col("classification") == "MALICIOUS"), ("suspicious", F.col("classification") == "SUSPICIOUS"), ("safe", F.col("classification") == "SAFE"), ("blocked", F.col("decision") == "BLOCK"),
            ("monitored", F.col("decision") == "MONITOR"), ("generated", F.col("is_generated")), ("tunnels", F.col("is_tunnel")), ("listed", F.col("verdict").isin("MALICIOUS", "SUSPICIOUS")),
        )),
    )
    return {
        "findings": valid.drop("error_code", "seq").orderBy(F.desc("score"), "key").limit(findings), "sources": sources, "types": types,
        "totals": total.crossJoin(rows.agg(count.alias("queries"))), "rejected": judged.where("error_code is not null").orderBy("seq").select("key", "error_code").limit(rejected),
    }
