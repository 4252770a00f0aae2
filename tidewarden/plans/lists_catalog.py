"""Queries over lists that are read from files, and their SQL. The files are written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden import dims
from tidewarden.functions import lexicon
from tidewarden.functions.names import canonicalize, classify
from tidewarden.plans.views import PAGE_HOSTS_SQL, page_hosts
from tidewarden.shared import shared_folder
from tidewarden.sources import suffix_rules


def suffix_file(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A file of suffix rules: for each nation its own suffix, some with a second level, some with a wildcard and its
    exception; for each market segment a provider's."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cc, n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_nationkey")
    own = F.array(cc, F.when(n % 2 == 0, F.concat(F.lit("co."), cc)), F.when(n % 3 == 0, F.concat(F.lit("*."), cc)), F.when(n % 3 == 0, F.concat(F.lit("!machinery."), cc)))
    registry = nation.select(F.explode(own).alias("value")).where("value is not null")
    segment = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lower("c_mktsegment").alias("s")).distinct()
    provider = segment.select(F.explode(F.array(F.concat("s", F.lit(".cloud  // a provider's")), F.concat(F.lit("*."), "s", F.lit(".hosting")))).alias("value"))
    for name, rules, mark in (("registry", registry, "// ===BEGIN ICANN DOMAINS==="), ("provider", provider, "// ===BEGIN PRIVATE DOMAINS===")):
        head = spark.range(1).select(F.lit(0).alias("nth"), F.lit(mark).alias("value"))
        lines = head.unionByName(rules.select(F.lit(1).alias("nth"), "value")).repartition(1).sortWithinPartitions("nth", "value")  # a list is small
        lines.select("value").write.text(f"{path}/{name}")


def suffix_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (raw): names of customers below such suffixes, and the hosts of the pages."""
    k, cc, s = F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lower("c_mktsegment")
    label = F.concat(F.lit("c"), k.cast("string"))
    forms = [(label, cc), (F.lit("www"), label, F.lit("co"), cc), (F.lit("a.b"), label, cc), (s, cc), (label, s, F.lit("cloud")), (F.lit("co"), cc), (label, F.lit("x"), s, F.lit("hosting")), (F.lit("www"), s, cc), (label, F.lit("unlisted"))]
    names = F.element_at(F.array(*(F.concat_ws(".", *f) for f in forms)), (k % len(forms) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(names.alias("raw")).unionByName(page_hosts(spark, sf_dir).select("raw")).distinct()


def _suffix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "suffixes")
    suffix_file(spark, sf_dir, path)
    rules = suffix_rules.read_suffix_rules(spark, f"{path}/*/")
    out = classify(canonicalize(suffix_hosts(spark, sf_dir), "raw", rules))
    return out.select("raw", "name.public_suffix", "name.suffix_section", "name.registrable_domain", "name.sld", "name.subdomain", "cls.kind", "cls.suffix_kind")


def words_file(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The words of the documents, a line each."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("value")).where("length(value) between 3 and 9").distinct()
    spark.range(1).select(F.lit("# words of the documents").alias("value")).unionByName(words).write.text(path)


def coverage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (label): the labels of the pages' hosts and the parts' names as labels."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("label"))
    hosts = page_hosts(spark, sf_dir).select(F.explode(F.split("raw", r"\.")).alias("label"))
    return parts.unionByName(hosts).distinct()


def _lexicon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "words")
    words_file(spark, sf_dir, path)
    out = lexicon.coverage(coverage_labels(spark, sf_dir), lexicon.read_lexicon(spark, path), "label")
    return out.select("label", F.round("coverage", 6).alias("coverage"))


def _lexicon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words, with their inflections, have each length."""
    path = shared_folder(spark, "words")
    words_file(spark, sf_dir, path)
    return lexicon.read_lexicon(spark, path).groupBy(F.length("word").alias("letters")).agg(F.count(F.lit(1)).alias("words"))


def queries() -> dict:
    return {"suffix_split": _suffix_split, "lexicon_coverage": _lexicon_coverage, "lexicon_sizes": _lexicon_sizes}


_FORMS = """[label || '.' || cc, 'www.' || label || '.co.' || cc, 'a.b.' || label || '.' || cc, s || '.' || cc, label || '.' || s || '.cloud', 'co.' || cc, label || '.x.' || s || '.hosting', 'www.' || s || '.' || cc, label || '.unlisted']"""
_LOCAL = ", ".join(f"'{s}'" for s in dims.LOCAL_SUFFIXES)
_WORDS = """
    plain as (select distinct w as word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) where length(w) between 3 and 9),
    stems as (
        select word, word as stem from plain union select word, word || word[-1] from plain union select word, word[:-2] from plain where ends_with(word, 'e') and length(word) >= 4
    ), words as (
        select word from plain union select stem || e from stems, (select unnest(['ing', 'ers', 'ed', 'es', 'er', 'ly', 's']) as e)
        union select word[:i - 1] || word[i + 1:] from plain, range(1, 10) r(i) where length(word) >= 6 and i <= length(word) and word[i] in ('a', 'e', 'i', 'o', 'u')
    )"""
ORACLE_SQL = {
    "suffix_split": f"""
        with {PAGE_HOSTS_SQL}, customers as (select 'c' || c_custkey as label, 'n' || c_nationkey as cc, lower(c_mktsegment) as s, c_custkey % 9 + 1 as form from customer),
        names as (select distinct ({_FORMS})[form] as raw from customers union select raw from hosts),
        rules as (
            select 'n' || n_nationkey as base, 0 as extra, 'registry' as section from nation union all select 'co.n' || n_nationkey, 0, 'registry' from nation where n_nationkey % 2 = 0
            union all select 'n' || n_nationkey, 1, 'registry' from nation where n_nationkey % 3 = 0 union all select 'machinery.n' || n_nationkey, -1, 'registry' from nation where n_nationkey % 3 = 0
            union all select distinct lower(c_mktsegment) || '.cloud', 0, 'provider' from customer union all select distinct lower(c_mktsegment) || '.hosting', 1, 'provider' from customer
        ),
        l as (select raw, string_split(raw, '.') as labels from names),
        fits as (select raw, section, extra, len(string_split(base, '.')) + extra as depth from l join rules on raw = base or ends_with(raw, '.' || base) where len(string_split(base, '.')) + extra <= len(labels)),
        best as (select *, row_number() over (partition by raw order by extra < 0 desc, depth desc, section desc) as nth from fits),
        cut as (select l.raw, labels, coalesce(depth, 1) as depth, section from l left join (select * from best where nth = 1) b on l.raw = b.raw),
        own as (select *, case when len(labels) > depth then len(labels) - depth else 1 end as own, array_to_string(labels[-depth:], '.') as public_suffix from cut)
        select raw, public_suffix, section as suffix_section, case when len(labels) = 1 then raw else array_to_string(labels[own:], '.') end as registrable_domain, labels[own] as sld, array_to_string(labels[:own - 1], '.') as subdomain,
            case when len(labels) = 1 then case when raw in ({_LOCAL}) then 'LOCAL_NAME' else 'SINGLE_LABEL' end when labels[-1] in ({_LOCAL}) then 'LOCAL_NAME' when section = 'provider' then 'PROVIDER_HOST' else 'REGISTRY_DOMAIN' end as kind,
            case when section = 'provider' then 'provider' when public_suffix in ({_LOCAL}) then 'unregistered' when section = 'registry' then 'registry' else 'unknown' end as suffix_kind
        from own""",
    "lexicon_coverage": f"""
        with recursive {PAGE_HOSTS_SQL}, {_WORDS},
        labels as (select distinct regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') as label from part union select unnest(string_split(raw, '.')) from hosts),
        l as (select label, regexp_replace(label, '[^a-z]', '', 'g') as k from labels),
        longest as (
            select k, i, max(n) as n from (select distinct k from l), range(1, 64) r(i), range(3, 15) s(n)
            where i + n - 1 <= length(k) and substr(k, i, n) in (select word from words) group by 1, 2
        ),
        walk as (select k, 1::bigint as at, 0::bigint as covered from (select distinct k from l) union all select w.k, w.at + greatest(1, coalesce(n, 0)), w.covered + coalesce(n, 0) from walk w left join longest g on g.k = w.k and g.i = w.at where w.at <= length(w.k))
        select label, round(coalesce((select max(covered) from walk w where w.k = l.k) / nullif(length(k), 0), 0), 6) as coverage from l""",
    "lexicon_sizes": f"with {_WORDS} select length(word)::int as letters, count(*) as words from words group by 1",
}
