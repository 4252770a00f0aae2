"""Zeek ``dns.log`` files in tab-separated form, by built-in functions only.

A log's own header names its columns and its marks for absent values. Each line is read by the header lines that stand
before it in its file, so logs that were joined to one file are read right as well. Lines aren't sorted or gathered: a
file's header lines, a handful, are joined to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names that a log may use, in order of preference, and what holds without a header line.
QUERY, TYPE, SOURCE, DEST, TIME, RCODE = ("query",), ("qtype_name", "qtype"), ("id.orig_h", "orig_h"), ("id.resp_h", "resp_h"), ("ts",), ("rcode_name", "rcode")
SEPARATOR, UNSET, EMPTY = "\t", "-", "(empty)"

#: Files whose headers are broadcast; beyond that, lines and headers are joined by a shuffle.
BROADCAST_FILES = 20_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value): ``at`` orders the lines of a file, however it was split."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), at.alias("at"), "value").where("value <> ''")


def _directive(value: Column) -> Column:
    """struct(name, value) of a header line."""
    whole = r"^#\s*(\S+)\s*(.*)$"
    return F.struct(F.regexp_extract(value, whole, 1).alias("name"), F.regexp_extract(value, whole, 2).alias("value"))


def _separator(text: Column) -> Column:
    r"""Separators are written escaped, as ``\x09``."""
    code = F.regexp_extract(text, r"^\\x([0-9A-Fa-f]{2})$", 1)
    plain = F.when(text == r"\t", "\t").otherwise(text)
    return F.coalesce(F.nullif(F.when(code != "", F.decode(F.unhex(code), "ISO-8859-1")).otherwise(plain), F.lit("")), F.lit(SEPARATOR))


def _headers(lines: DataFrame) -> DataFrame:
    """One row a file: its states (at, separator, unset, empty, log, fields) after each header line, in order, and what
    is wrong with it."""
    comment = F.col("value").startswith("#")
    d = _directive(F.col("value"))
    known = d["name"].isin("separator", "unset_field", "empty_field", "path", "fields")
    per_file = lines.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(comment & known, F.struct("at", d["name"].alias("name"), d["value"].alias("value"))))).alias("said"),
        F.min(F.when(~comment, F.col("at"))).alias("first_row"),
        F.min(F.when(comment & (d["name"] == "fields"), F.col("at"))).alias("first_fields"),
        F.min_by(F.substring(F.ltrim("value"), 1, 1), F.when(F.trim("value") != "", F.col("at"))).alias("first_char"),
    )

    def state(now: Column) -> Column:
        last = lambda name: F.try_element_at(F.filter("said", lambda s: (s["at"] <= now["at"]) & (s["name"] == name)), F.lit(-1))["value"]
        separator = F.coalesce(_separator(F.trim(last("separator"))), F.lit(SEPARATOR))
        fields = last("fields")
        named = F.filter(F.split(fields, F.concat(F.lit(r"\Q"), separator, F.lit(r"\E"))), lambda f: f != "")
        return F.struct(
            now["at"].alias("at"), separator.alias("separator"), F.coalesce(F.trim(last("unset_field")), F.lit(UNSET)).alias("unset"),
            F.coalesce(F.trim(last("empty_field")), F.lit(EMPTY)).alias("empty"), F.trim(last("path")).alias("log"), named.alias("fields"),
        )

    wrong = (
        F.when(F.col("first_char").isin("{", "["), "JSON_NOT_SUPPORTED")
        .when(F.col("first_fields").isNull() | (F.col("first_row") < F.col("first_fields")), "NO_FIELDS_HEADER")
    )
    return per_file.select("path", F.transform("said", state).alias("states"), wrong.alias("error"))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path)
    headers = _headers(lines)
    if len(spark.read.text(path).inputFiles()) <= BROADCAST_FILES:
        headers = F.broadcast(headers)
    rows = lines.where(~F.col("value").startswith("#")).join(headers.where("error is null"), "path")
    rows = rows.withColumn("h", F.element_at(F.filter("states", lambda s: s["at"] <= F.col("at")), -1)).drop("states")

    def pick(names: tuple[str, ...]) -> Column:
        """The first of the columns that the log has and that is set in this line."""
        found = []
        for name in names:
            i = F.array_position("h.fields", F.lit(name)).cast("int")
            value = F.when(i > 0, F.split_part("value", F.col("h.separator"), F.greatest(i, F.lit(1))))
            found.append(F.when((value != "") & (value != F.col("h.unset")), value))
        return F.coalesce(*found)

    rows = rows.withColumn("asked", pick(QUERY)).where("asked is not null and asked <> h.empty")
    return rows.select(
        "path", F.col("at").alias("seq"), F.regexp_replace("asked", r"\.+$", "").alias("domain"), F.coalesce(pick(TYPE), F.lit("A")).alias("query_type"),
        pick(SOURCE).alias("source_ip"), pick(DEST).alias("dest_ip"), F.expr("cast(null as string)").alias("transport"),
        pick(TIME).try_cast("double").alias("timestamp"), F.lit(False).alias("is_response"), pick(RCODE).alias("rcode"),
    )


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, seq, domain, query_type, source_ip, dest_ip, transport, timestamp, is_response, rcode), one for each
    query of the logs at ``path`` (a file, folder or pattern).

    Lines without a query are left out; no type means ``A``; a time that is no number is null. Files that are no such log
    give no rows; ``zeek_errors`` names them."""
    return _rows(spark, path)


def zeek_errors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, error), one for each file that can't be read: JSON_NOT_SUPPORTED, NO_FIELDS_HEADER, or NOT_A_DNS_LOG for
    another kind of log without queries. Spark's readers pass over files of no bytes, so these have no row."""
    headers = _headers(_lines(spark, path)).select("path", "error", F.try_element_at("states", F.lit(-1))["log"].alias("log"))
    some = _rows(spark, path).select("path").distinct().withColumn("some", F.lit(True))
    other = F.when((F.col("log") != "dns") & F.col("some").isNull(), "NOT_A_DNS_LOG")
    return headers.join(some, "path", "left").select("path", F.coalesce("error", other).alias("error")).where("error is not null")
