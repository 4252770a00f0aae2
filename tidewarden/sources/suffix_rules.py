"""Public-suffix rules from files, and the longest rule of each name by one equi-join.

The file format is that of the public suffix list: a rule a line, up to the first white space; ``//`` begins a comment;
``*.`` stands for any one label; ``!`` marks an exception to a wildcard. Comments ``===BEGIN ICANN DOMAINS===`` and ``===BEGIN
PRIVATE DOMAINS===`` begin the sections of registries and of providers.

A rule is kept by its ``base``, the labels without ``*.`` or ``!``, and by how many labels a match adds to it: a plain rule none,
a wildcard one, an exception takes one away. So all three kinds match where a name's last labels equal the base, and no rule
is tried on a name that doesn't end with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to which they are broadcast (a rule is some 40 bytes); more are joined by a shuffle.
BROADCAST_RULES = 200_000
# The marks of the file format.
SECTIONS = {"===BEGIN ICANN DOMAINS===": "registry", "===BEGIN PRIVATE DOMAINS===": "provider"}
LABEL = r"[^.\s*!/]+"
SHAPE = rf"^(\*\.|!)?{LABEL}(\.{LABEL})*$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): ``at`` orders the lines of a file, however it was split."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.trim("value").alias("value")).where("value <> ''")


def _marked(spark: SparkSession, path: str) -> DataFrame:
    """(text, section) of each line that is no comment; the section is that of the last mark before it in its file."""
    lines = _lines(spark, path)
    section = F.coalesce(*(F.when(F.contains("value", F.lit(mark)), name) for mark, name in SECTIONS.items()))
    # A file has a handful of marks, so they are gathered, and joined to its lines.
    marks = lines.where(F.col("value").startswith("//") & section.isNotNull()).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", section.alias("section")))).alias("marks"))
    rules = lines.where(~F.col("value").startswith("//")).join(F.broadcast(marks), "file", "left")
    last = F.try_element_at(F.filter("marks", lambda m: m["at"] < F.col("at")), F.lit(-1))["section"]
    text = F.lower(F.regexp_extract("value", r"^(\S+)", 1))
    return rules.select(F.regexp_replace(text, r"^\.|\.$", "").alias("text"), F.coalesce(last, F.lit("registry")).alias("section"))


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rows (base, extra, exception, section), one for each distinct rule of the files at ``path``; of one that is in both
    sections the registry's counts. Rules beyond ASCII are in the form that names have in DNS. Lines that are no rule are
    left out; ``rejected_rules`` shows them."""
    from tidewarden.functions.names import to_punycode

    rules = _marked(spark, path).where(F.col("text").rlike(SHAPE))
    base = F.regexp_replace("text", r"^(\*\.|!)", "")
    beyond = base.rlike(r"[^\x00-\x7F]")
    rules = rules.select(
        F.coalesce(to_punycode(F.when(beyond, base)), base).alias("base"), F.when(F.col("text").startswith("*."), 1).when(F.col("text").startswith("!"), -1).otherwise(0).alias("extra"), "section",
    )
    return rules.groupBy("base", "extra").agg((F.col("extra") < 0).alias("exception"), F.max("section").alias("section")).where("base <> ''")


def rejected_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text): lines that are neither comments nor rules, as those with a wildcard inside."""
    return _marked(spark, path).where(~F.col("text").rlike(SHAPE)).select("text")


def listed(spark: SparkSession, registry: list[str], provider: list[str] = ()) -> DataFrame:
    """Plain rules from lists."""
    rows = [(s, 0, False, "registry") for s in registry] + [(s, 0, False, "provider") for s in provider]
    return spark.createDataFrame(rows, "base string, extra int, exception boolean, section string")


def matched(df: DataFrame, rules: DataFrame, labels: Column | str = "labels") -> DataFrame:
    """Adds ``suffix``: struct(public_suffix, section, rule) of the array of labels. An exception wins over other rules, then
    the rule with the most labels does, then the registry's; without any the last label is the suffix, its section null. A
    null or empty array has none. Looked up for each distinct array once; other columns stay as they are."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    df = df.withColumn("_labels_of", labels)
    keys = df.select(F.col("_labels_of").alias("_k")).where(F.size("_k") > 0).distinct()
    # A name of n labels has n ends; one with d labels matches rules that have d labels as their base.
    depth = F.explode(F.sequence(F.lit(1), F.size("_k")))
    ends = keys.select("_k", depth.alias("_d")).withColumn("base", F.array_join(F.slice("_k", -F.col("_d"), F.col("_d")), "."))
    rules = rules.select("base", "extra", "section")
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    hits = ends.join(rules, "base").withColumn("_n", F.col("_d") + F.col("extra")).where((F.col("_n") <= F.size("_k")) & (F.col("_n") > 0))
    best = hits.groupBy("_k").agg(F.max_by(F.struct("_n", "section", "base", "extra"), F.struct(F.col("extra") < 0, "_n", "section")).alias("_hit"))
    text = F.concat(F.when(F.col("_hit.extra") > 0, "*.").when(F.col("_hit.extra") < 0, "!").otherwise(""), "_hit.base")
    n = F.coalesce("_hit._n", F.lit(1))
    suffix = F.when(F.size("_labels_of") > 0, F.struct(F.array_join(F.slice("_labels_of", -n, n), ".").alias("public_suffix"), F.col("_hit.section").alias("section"), text.alias("rule")))
    return df.join(best, df["_labels_of"] == best["_k"], "left").withColumn("suffix", suffix).drop("_labels_of", "_k", "_hit")
