"""URL rules as sort-merge range joins over reversed hosts and over paths, in built-in functions only.

A host's canonical key is its labels in reverse, each followed by a dot: ``www.example.org`` -> ``org.example.www.``. A
rule on a host covers the interval of keys that begin with its own, and one on a path the interval of paths that begin
with its own; intervals of either kind nest or are disjoint. Rules and urls are sorted together, and a running ``last``
hands each url what was opened last. Since intervals nest, what is open at a url is that entry and those around it, less
those closed before the url: each entry carries this stack, and a url drops what is closed.

Two sweeps are made. The first, over host keys, gives each url those of its ancestors that have rules. The second, over
(host, path), gives each of these pairs the rules of that host around the url's path, so a url meets no rule of a path
that isn't its own, however many its host has. Of all these the longest wins.

The sweeps run in lanes. A url's lane is a hash of its row, so a host that holds a third of all urls is spread evenly;
the rules are sent to every lane, and the lanes follow from the number of urls, so that this costs rules / LANE_ROWS for
each url at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANE_ROWS = 250_000
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url):
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rules(rules: DataFrame) -> DataFrame:
    """Rows (key, path, length, depth, rule, verdict). Rows with a null are passed over; of rules alike in host and path ``block`` wins."""
    own = rules.select(F.lower("host").alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return own.select(host_key(F.col("host")).alias("key"), "path", (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("depth"), F.concat("host", "path").alias("rule"), "verdict")


def host_stacks(own: DataFrame) -> DataFrame:
    """Rows (key, stack): for each host that has rules, itself and its ancestors that have some."""
    hosts = own.select("key").distinct()
    labels = F.slice(F.split("key", r"\."), F.lit(1), F.size(F.split("key", r"\.")) - 1)  # the key ends with a dot
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    pairs = hosts.select("key", F.explode(F.array_distinct(above)).alias("above"))
    return pairs.join(hosts.select(F.col("key").alias("above")), "above").groupBy("key").agg(F.collect_set("above").alias("stack"))


def path_stacks(own: DataFrame) -> DataFrame:
    """Rows (key, path, stack): for each rule, itself and the rules of its host whose paths its own begins with."""
    entry = F.struct("length", "depth", "rule", "verdict", "path")
    starts = own.select("key", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left("path", n))).alias("start"))
    around = starts.join(own.select("key", F.col("path").alias("start"), entry.alias("entry")), ["key", "start"])
    return around.groupBy("key", "path").agg(F.collect_list("entry").alias("stack"))


def _last_opened(urls: DataFrame, opens: DataFrame, lanes: int, *order: str) -> DataFrame:
    """The urls, with ``open``: the stack of the entry of ``opens`` that comes last before each, in its lane."""
    every = opens.select("*", F.lit(0).alias("is_url"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    sweep = Window.partitionBy("lane").orderBy(*order, "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = urls.withColumn("is_url", F.lit(1)).unionByName(every, allowMissingColumns=True)
    return both.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1").drop("is_url", "stack")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = DEFAULT, lanes: int | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, of equally long
    ones that of the longer host. Without one, rule is null and the verdict is ``default``. Null urls have an empty host
    and path; a rule whose host is empty fits these only. Null ids and repeated rows come back each; empty tables on either
    side and clashing names do no harm."""
    spark = pages.sparkSession
    if lanes is None:
        lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // LANE_ROWS))
    own = _rules(rules)
    lane = F.pmod(F.xxhash64(F.col(id_col), F.col(url)), F.lit(lanes)).cast("int")
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), lane.alias("lane"), F.monotonically_increasing_id().alias("row"))
    hosts = _last_opened(urls.withColumn("key", host_key(F.col("host"))), host_stacks(own), lanes, "key")
    ancestors = F.filter("open", lambda h: F.col("key").startswith(h))
    pairs = hosts.select("page_id", "host", "path", "lane", "row", F.explode_outer(ancestors).alias("key"))
    met = _last_opened(pairs, path_stacks(own), lanes, "key", "path")
    around = F.filter("open", lambda r: F.col("path").startswith(r["path"]) & (host_key(F.substring(r["rule"], F.lit(1), r["depth"])) == F.col("key")))
    best = F.array_max(F.transform(around, lambda r: F.struct(r["length"].alias("length"), r["depth"].alias("depth"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    # A url's pairs are in its lane, so they are gathered where they are.
    out = met.withColumn("best", best).groupBy("lane", "row").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max("best").alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
