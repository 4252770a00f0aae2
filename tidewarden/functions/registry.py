"""Measures of names for SQL, as temporary functions: expressions that Spark inlines, and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewarden import dims


def register(spark: SparkSession) -> list[str]:
    """Makes entropy(text), registrable_domain(name), classify_name(name) and dns_suffixes(name) known to the session's SQL,
    for names in canonical form. Returns their names."""
    listed = ", ".join(f"'{s}'" for s in sorted({s for s in dims.REGISTRY_SUFFIXES + dims.PROVIDER_SUFFIXES if "." in s}))
    provider, local = (", ".join(f"'{s}'" for s in x) for x in (dims.PROVIDER_SUFFIXES, dims.LOCAL_SUFFIXES))
    address = r"'^\\d+\\.\\d+\\.\\d+\\.\\d+$'"
    bodies = {
        "entropy(t STRING) RETURNS DOUBLE": "aggregate(array_distinct(filter(split(t, ''), c -> c <> '')), 0.0D, (h, c) -> h - (length(t) - length(replace(t, c, ''))) / length(t) * log2((length(t) - length(replace(t, c, ''))) / length(t)))",
        "suffix_depth(n STRING) RETURNS INT": f"CASE WHEN substring_index(n, '.', -3) IN ({listed}) AND size(split(n, '[.]')) >= 3 THEN 3 WHEN substring_index(n, '.', -2) IN ({listed}) AND size(split(n, '[.]')) >= 2 THEN 2 ELSE 1 END",
        "registrable_domain(n STRING) RETURNS STRING": f"CASE WHEN n RLIKE {address} THEN n ELSE substring_index(n, '.', -1 - suffix_depth(n)) END",
        "classify_name(n STRING) RETURNS STRING": (
            f"CASE WHEN n RLIKE {address} THEN 'IP_LITERAL' WHEN n NOT LIKE '%.%' THEN CASE WHEN n IN ({local}) THEN 'LOCAL_NAME' ELSE 'SINGLE_LABEL' END WHEN substring_index(n, '.', -1) = 'arpa' THEN 'INFRASTRUCTURE' "
            f"WHEN substring_index(n, '.', -1) IN ({local}) THEN 'LOCAL_NAME' WHEN substring_index(n, '.', -suffix_depth(n)) IN ({provider}) THEN 'PROVIDER_HOST' ELSE 'REGISTRY_DOMAIN' END"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION dns_suffixes(n STRING) RETURNS TABLE (depth INT, suffix STRING) "
        "RETURN SELECT pos, col FROM (SELECT posexplode(transform(sequence(1, size(split(n, '[.]'))), i -> array_join(slice(split(n, '[.]'), i, 64), '.'))))"
    )
    return [head.split("(")[0] for head in bodies] + ["dns_suffixes"]
