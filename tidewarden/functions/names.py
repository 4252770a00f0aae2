"""Canonical DNS names and their classification.

Everything is built-in but for three things no built-in knows, each an Arrow UDF that sees null unless it is needed:
punycode (only names beyond ASCII or with ``xn--``), IPv6 text (only names with a colon), and Unicode scripts.
"""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from tidewarden import dims
from tidewarden.functions.text import bound
from tidewarden.sources import suffix_rules

LABEL = r"^[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?$"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


@F.pandas_udf(StringType())
def to_punycode(hosts: pd.Series) -> pd.Series:
    def encode(host: str | None) -> str | None:
        if host is None:
            return None
        try:
            return ".".join(x if x.isascii() else x.lower().encode("idna").decode() for x in host.split("."))
        except UnicodeError:
            return ""

    return hosts.map(encode, na_action="ignore")


@F.pandas_udf(StringType())
def from_punycode(hosts: pd.Series) -> pd.Series:
    """Null if a label can't be decoded or nothing changes."""

    def decode(host: str | None) -> str | None:
        try:
            out = ".".join(x[4:].encode().decode("punycode") if x.startswith("xn--") else x for x in host.split("."))
        except (UnicodeError, AttributeError):
            return None
        return out if out != host else None

    return hosts.map(decode, na_action="ignore").astype("object")


@F.pandas_udf(StructType().add("version", IntegerType()).add("private", BooleanType()))
def ip_facts(hosts: pd.Series) -> pd.DataFrame:
    def facts(host: str | None) -> tuple[int | None, bool | None]:
        try:
            address = ipaddress.ip_address(host) if host else None
        except ValueError:
            address = None
        return (address.version, address.is_private or address.is_loopback or address.is_link_local) if address else (None, None)

    return pd.DataFrame([facts(h) for h in hosts], columns=["version", "private"])


@F.pandas_udf(ArrayType(StringType()))
def scripts_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted({unicodedata.name(c, "?").split(" ")[0].capitalize() for c in t if c.isalpha()}), na_action="ignore")


@F.pandas_udf(StringType())
def ipv6_of_nibbles(names: pd.Series) -> pd.Series:
    def decode(name: str) -> str | None:
        nibbles = name.split(".")
        try:
            return str(ipaddress.IPv6Address(int("".join(reversed(nibbles)), 16))) if len(nibbles) == 32 else None
        except ValueError:
            return None

    return names.map(decode, na_action="ignore").astype("object")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def host_of(raw: Column) -> tuple[Column, Column]:
    """(host, whether a URL was given): without scheme, userinfo, port and brackets."""
    text = stripped(F.btrim(stripped(raw), F.lit("\"'<>")))
    is_url = text.contains("://")
    rest = F.when(is_url, F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)).otherwise(text)
    was_url = is_url | rest.rlike("[/?#@]")
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    authority = F.regexp_replace(authority, r"(?s)^.*@", "")
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    colons = F.length(authority) - F.length(F.replace(authority, F.lit(":"), F.lit("")))
    return F.when(bracketed != "", bracketed).when(colons == 1, F.substring_index(authority, ":", 1)).otherwise(authority), was_url


def canonicalize(df: DataFrame, raw: str = "raw", suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: struct of domain, labels, tld, registrable_domain, sld, subdomain, public_suffix and its section, flags and
    error_code.

    A name that is no valid one has an error code and no domain; nothing raises. Null is EMPTY_INPUT. ``suffixes``: rules as
    ``suffix_rules.read_suffix_rules`` gives them, in place of the short list of ``dims``."""
    host, was_url = host_of(F.col(raw))
    df = df.withColumns({"_host": bound(F.coalesce(host, F.lit(""))), "_was_url": F.coalesce(was_url, F.lit(False))})
    odd = F.col("_host").rlike(r"[^\x00-\x7F]")
    df = df.withColumn("_ascii", F.coalesce(to_punycode(F.when(odd, F.col("_host"))), F.col("_host")))
    df = df.withColumn("_domain", bound(F.lower(F.regexp_replace("_ascii", r"\.+$", ""))))
    df = df.withColumns({"_ip": ip_facts(F.when(F.col("_domain").contains(":"), F.col("_domain"))), "_labels": bound(F.split("_domain", r"\."))})
    domain, labels = F.col("_domain"), F.col("_labels")
    is_ip = domain.rlike(IPV4) | F.col("_ip.version").isNotNull()
    label_error = F.transform(
        labels,
        lambda x: F.when(x == "", "EMPTY_LABEL").when(F.length(x) > 63, "LABEL_TOO_LONG").when(~x.rlike(LABEL), "INVALID_LABEL_FORMAT"),
    )
    error = (
        F.when(F.length(stripped(F.coalesce(F.col(raw), F.lit("")))) == 0, "EMPTY_INPUT")
        .when(F.length(raw) > 2048, "INPUT_TOO_LARGE")
        .when(F.col("_host") == "", F.when(F.col("_was_url"), "INVALID_URL").otherwise("EMPTY_INPUT"))
        .when(F.col("_ascii") == "", "IDN_ENCODING_FAILED")
        .when(is_ip, F.lit(None))
        .when(F.length(domain) > 253, "DOMAIN_TOO_LONG")
        .otherwise(F.coalesce(F.try_element_at(F.filter(label_error, lambda e: e.isNotNull()), F.lit(1)), F.when((F.size(labels) > 1) & F.element_at(labels, -1).rlike(r"^\d+$"), "NUMERIC_TLD")))
    )
    df = df.withColumns({"_error": bound(error), "_is_ip": bound(is_ip)})
    if suffixes is None:
        df = df.withColumn("_suffix", bound(public_suffix(labels)))
        section = F.when(F.col("_suffix").isin(dims.PROVIDER_SUFFIXES), "provider").when(F.col("_suffix").isin(dims.REGISTRY_SUFFIXES), "registry")
    else:
        df = suffix_rules.matched(df.withColumn("_split", F.when(~F.col("_is_ip") & F.col("_error").isNull(), labels)), suffixes, "_split")
        df = df.withColumns({"_suffix": F.coalesce("suffix.public_suffix", F.element_at("_labels", -1)), "_section": F.col("suffix.section")}).drop("suffix", "_split")
        section = F.col("_section")
    depth = F.size(F.split("_suffix", r"\."))
    n = F.size("_labels")
    own = F.when(n > depth, n - depth).otherwise(F.lit(1))  # labels before the suffix; a bare suffix keeps its first
    registrable = F.array_join(F.slice("_labels", own, n), ".")
    named = ~F.col("_is_ip") & F.col("_error").isNull()
    name = F.struct(
        F.when(F.col("_error").isNull(), F.col("_domain")).alias("domain"),
        F.when(named, F.col("_labels")).alias("labels"),
        F.when(named, F.element_at("_labels", -1)).alias("tld"),
        F.when(F.col("_is_ip"), F.col("_domain")).when(named, F.when(n == 1, F.col("_domain")).otherwise(registrable)).alias("registrable_domain"),
        F.when(named, F.element_at("_labels", own)).alias("sld"),
        F.when(named, F.array_join(F.slice("_labels", F.lit(1), own - 1), ".")).alias("subdomain"),
        F.when(named, F.col("_suffix")).alias("public_suffix"),
        F.when(named, section).alias("suffix_section"),
        F.col("_is_ip").alias("is_ip_literal"),
        F.exists("_labels", lambda x: x.startswith("xn--")).alias("is_punycode"),
        (named & (n == 1)).alias("is_single_label"),
        F.col("_domain").contains("_").alias("has_underscore"),
        F.col("_was_url").alias("was_url"),
        F.col("_error").alias("error_code"),
        F.col("_ip").alias("ip"),
    )
    return df.withColumn("name", bound(name)).drop("_host", "_was_url", "_ascii", "_domain", "_ip", "_labels", "_error", "_is_ip", "_suffix", "_section")


def public_suffix(labels: Column) -> Column:
    """Longest listed suffix of three or two labels, else the last label."""
    listed = sorted({s for s in dims.REGISTRY_SUFFIXES + dims.PROVIDER_SUFFIXES if "." in s})

    def last(n: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")

    return F.when((F.size(labels) >= 3) & last(3).isin(listed), last(3)).when((F.size(labels) >= 2) & last(2).isin(listed), last(2)).otherwise(last(1))


def classify(df: DataFrame) -> DataFrame:
    """Adds ``cls``: kind, suffix_kind, the six spans, reverse-DNS target, address facts and scripts. ``df`` has ``name``."""
    domain, labels, suffix = F.col("name.domain"), F.col("name.labels"), F.col("name.public_suffix")
    last = F.element_at(labels, -1)
    section = F.coalesce("name.suffix_section", F.lit(""))
    provider = section == "provider"
    kind = (
        F.when(F.col("name.error_code").isNotNull(), F.lit(None))
        .when(F.col("name.is_ip_literal"), "IP_LITERAL")
        .when(F.size(labels) == 1, F.when(last.isin(dims.LOCAL_SUFFIXES), "LOCAL_NAME").otherwise("SINGLE_LABEL"))
        .when(last == "arpa", "INFRASTRUCTURE")
        .when(last.isin(dims.LOCAL_SUFFIXES), "LOCAL_NAME")
        .when(provider, "PROVIDER_HOST")
        .otherwise("REGISTRY_DOMAIN")
    )
    suffix_kind = F.when(provider, "provider").when(suffix == "arpa", "infrastructure").when(suffix.isin(dims.LOCAL_SUFFIXES), "unregistered").when(section == "registry", "registry").otherwise("unknown")
    df = df.withColumn("_kind", kind)
    has_label = F.col("_kind").isin("REGISTRY_DOMAIN", "PROVIDER_HOST", "SINGLE_LABEL")
    chosen = (F.col("_kind") == "REGISTRY_DOMAIN") | suffix.isin(dims.REGISTRANT_SHAPED) | (F.col("_kind") == "SINGLE_LABEL")
    label = F.when(has_label, F.col("name.sld"))
    delegated = F.when(F.col("_kind").isin("REGISTRY_DOMAIN", "PROVIDER_HOST"), F.col("name.subdomain"))
    controlled = F.when(F.col("_kind").isin("REGISTRY_DOMAIN", "PROVIDER_HOST"), F.concat_ws(".", F.nullif(F.col("name.subdomain"), F.lit("")), F.col("name.sld")))
    decoded = from_punycode(F.when(F.col("name.is_punycode"), domain))
    df = df.withColumn("_decoded", decoded)
    shown = F.coalesce("_decoded", domain)
    semantic = F.when(has_label, F.expr("substring(_shown, 1, greatest(0, length(_shown) - length(name.public_suffix) - if(size(name.labels) > 1, 1, 0)))"))
    df = df.withColumn("_shown", shown)
    zone4, zone6 = ".in-addr.arpa", ".ip6.arpa"
    octets = F.slice(labels, F.lit(1), F.lit(4))
    four = F.array_join(F.reverse(octets), ".")
    target = F.when(domain.endswith(zone4) & (F.size(labels) == 6) & four.rlike(IPV4), four).when(
        domain.endswith(zone6), ipv6_of_nibbles(F.when(domain.endswith(zone6), F.regexp_replace(domain, r"\.ip6\.arpa$", "")))
    )
    v4 = domain.rlike(IPV4) & F.col("name.is_ip_literal")
    private4 = domain.rlike(r"^(10|127)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^0\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\.|^198\.1[89]\.")
    cls = F.struct(
        F.col("_kind").alias("kind"),
        F.when(has_label | (F.col("_kind") == "INFRASTRUCTURE") | (F.col("_kind") == "LOCAL_NAME"), suffix_kind).alias("suffix_kind"),
        F.struct(
            domain.alias("full_name"), F.col("name.registrable_domain").alias("registrable_domain"), label.alias("registrant_label"),
            delegated.alias("delegated_span"), controlled.alias("controlled_span"), semantic.alias("semantic_text"),
        ).alias("scopes"),
        (F.coalesce(chosen, F.lit(False)) & label.isNotNull()).alias("scope_is_registrant_chosen"),
        (F.col("_kind") == "INFRASTRUCTURE").alias("is_reverse_dns"),
        target.alias("reverse_target"),
        F.when(v4, 4).otherwise(F.col("name.ip.version")).alias("ip_version"),
        F.when(v4, private4).otherwise(F.col("name.ip.private")).alias("ip_is_private"),
        F.when(F.col("_decoded").isNotNull(), scripts_of(F.col("_decoded"))).when(domain.rlike("[a-z]"), F.array(F.lit("Latin"))).otherwise(F.array().cast("array<string>")).alias("scripts"),
    )
    return df.withColumn("cls", bound(cls)).drop("_kind", "_decoded", "_shown")


#: Kinds of spans that a detector may read, and those that lie inside them. Keys of other kinds contain nothing.
LABEL_SPAN, DELEGATED_SPAN, CONTROLLED_SPAN = "registrant_label", "delegated_span", "controlled_span"
CONTAINED = {CONTROLLED_SPAN: (DELEGATED_SPAN, LABEL_SPAN)}


def scope_contains(outer: Column, inner: Column) -> Column:
    """Whether whoever read the span ``outer`` has read ``inner`` too."""
    inside = F.lit(False)
    for span, parts in CONTAINED.items():
        inside = inside | ((outer == span) & inner.isin(list(parts)))
    return (outer != "") & (inner != "") & ((outer == inner) | inside)


def independent_scopes(keys: Column) -> Column:
    """Of an array of span kinds, those that no other one contains; empty ones are left out."""
    distinct = F.array_distinct(F.filter(keys, lambda k: k != ""))
    return F.filter(distinct, lambda k: ~F.exists(distinct, lambda o: (o != k) & scope_contains(o, k)))
