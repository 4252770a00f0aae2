"""History of domains and clients over trailing windows of the event table.

Every DNS row is an observation; of other rows each distinct name counts once. Blocked rows are no NXDOMAIN.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.operators.scorers import behavioral
from tidewarden.policy import POLICY, Policy


def measures(scope: Column | None = None, prefix: str = "") -> list[Column]:
    """total, distinct_names, max_risk, blocked, nxdomain of the rows of ``scope`` (all by default), in one aggregation."""
    inside = F.lit(True) if scope is None else scope
    dns = inside & (F.col("event_type") == "dns")
    other = inside & (F.col("event_type") != "dns")
    return [
        (F.count_if(dns) + F.count_distinct(F.when(other, F.col("domain")))).alias(prefix + "total"),
        F.count_distinct(F.when(inside, F.col("domain"))).alias(prefix + "distinct_names"),
        F.coalesce(F.max(F.when(inside, F.col("risk_score"))), F.lit(0)).alias(prefix + "max_risk"),
        F.count_if(inside & F.col("blocked")).alias(prefix + "blocked"),
        F.count_if(inside & (F.col("response_code") == "NXDOMAIN") & ~F.col("blocked")).alias(prefix + "nxdomain"),
    ]


def since(events: DataFrame, now: datetime.datetime, minutes: int) -> DataFrame:
    """Rows from ``minutes`` before ``now`` on, whole seconds, the start included."""
    start = now.replace(microsecond=0) - datetime.timedelta(minutes=minutes)
    return events.where(F.col("ts") >= F.lit(start))


def domain_histories(events: DataFrame, now: datetime.datetime, minutes: int = 60) -> DataFrame:
    return since(events, now, minutes).groupBy("registrable_domain").agg(*measures())


def client_histories(events: DataFrame, now: datetime.datetime, minutes: int = 60) -> DataFrame:
    """For each client and domain; rows without a client are nobody's."""
    rows = since(events, now, minutes).where("client_address is not null and event_type = 'dns'")
    return rows.groupBy("client_address", "registrable_domain").agg(*measures())


def history_pair(events: DataFrame, client: str, now: datetime.datetime, minutes: int = 60) -> DataFrame:
    """Each domain's history beside one client's slice of it, from one scan."""
    own = F.coalesce((F.col("client_address") == client) & (F.col("event_type") == "dns"), F.lit(False))
    return since(events, now, minutes).groupBy("registrable_domain").agg(*measures(), *measures(own, "client_"))


def trailing(events: DataFrame, minutes: int = 60, keys: tuple[str, ...] = ("registrable_domain",)) -> DataFrame:
    """Each event with the history of its key over the minutes before it; rows of the same microsecond aren't before it.

    A key's rows are dealt to buckets as long as the window, each with a copy of the bucket before it, so a task holds two
    windows of a key and a busy key is many tasks. Inside a bucket a row adds to running sums when it comes and takes
    off again when it leaves the window; a name is counted from its first row until its last one in a row leaves."""
    span = minutes * 60_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    need = [*keys, "us", "domain", "risk_score", "is_dns", "blocked", "failed"]
    failed = F.coalesce((F.col("response_code") == "NXDOMAIN") & ~F.col("blocked"), F.lit(False))
    rows = events.select(F.struct(*events.columns).alias("e"), *keys, us.alias("us"), "domain", "risk_score", (F.col("event_type") == "dns").alias("is_dns"), F.col("blocked").alias("blocked"), failed.alias("failed"))
    rows = rows.withColumn("bucket", F.floor(F.col("us") / span))
    dealt = rows.unionByName(rows.select(*need, (F.col("bucket") + 1).alias("bucket")), allowMissingColumns=True)
    deltas = {"dns": F.col("is_dns").cast("int"), "blocked_before": F.coalesce("blocked", F.lit(False)).cast("int"), "nxdomain": F.col("failed").cast("int")}
    coming, leaving = dict(deltas), dict(deltas)
    for name, same, counts in (("distinct_names", ["domain"], F.col("domain").isNotNull()), ("others", ["domain", "is_dns"], F.col("domain").isNotNull() & ~F.col("is_dns"))):
        order = Window.partitionBy(*keys, "bucket", *same).orderBy("us")
        dealt = dealt.withColumns({f"prev_{name}": F.lag("us").over(order), f"next_{name}": F.lead("us").over(order)})
        before, after = F.col(f"prev_{name}"), F.col(f"next_{name}")
        coming[name] = (counts & (before.isNull() | (before < F.col("us") - span))).cast("int")
        leaving[name] = (counts & (after.isNull() | (after > F.col("us") + span))).cast("int")
    own, none = F.col("risk_score"), F.lit(None).cast(events.schema["risk_score"].dataType)
    comes = F.struct(F.col("us").alias("at"), F.col("e").isNotNull().alias("asks"), F.when(F.col("e").isNotNull(), own).alias("new_risk"), none.alias("old_risk"), *(x.alias(c) for c, x in coming.items()))
    leaves = F.struct((F.col("us") + span).alias("at"), F.lit(False).alias("asks"), none.alias("new_risk"), own.alias("old_risk"), *((-x).alias(c) for c, x in leaving.items()))
    moves = dealt.select("e", *keys, "bucket", F.explode(F.when(F.col("e").isNull(), F.array(comes, leaves)).otherwise(F.array(comes))).alias("m")).select("e", *keys, "bucket", "m.*")
    so_far = Window.partitionBy(*keys, "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    to_come = Window.partitionBy(*keys, "bucket").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    total = {c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in coming}
    # The window holds the bucket's rows so far, and those of the bucket before that are still to leave.
    highest = F.coalesce(F.greatest(F.max("new_risk").over(so_far), F.max("old_risk").over(to_come)), F.lit(0))
    summed = moves.withColumns({f"sum_{c}": x for c, x in total.items()} | {"max_risk": highest}).where("asks")
    measures = [(F.col("sum_dns") + F.col("sum_others")).alias("total"), F.col("sum_distinct_names").alias("distinct_names"), "max_risk", F.col("sum_blocked_before").alias("blocked_before"), F.col("sum_nxdomain").alias("nxdomain")]
    return summed.select("e.*", *measures)


def client_behaviour(events: DataFrame, now: datetime.datetime, minutes: int = 60, policy: Policy = POLICY) -> DataFrame:
    """The strongest domain of each client by behavioural score; ties go to the first by name."""
    scored = behavioral(client_histories(events, now, minutes), policy)
    best = F.max_by(F.struct("registrable_domain", F.col("behavioral.score").alias("score"), F.col("behavioral.verdict").alias("verdict"), "total"), F.struct(F.col("behavioral.score"), F.col("_tie")))
    names = Window.partitionBy("client_address").orderBy(F.desc("registrable_domain"))
    ranked = scored.withColumn("_tie", F.row_number().over(names))
    enough = F.max(F.col("behavioral.verdict") != "INSUFFICIENT_HISTORY")
    out = ranked.groupBy("client_address").agg(best.alias("b"), enough.alias("enough"), F.max(F.col("behavioral.verdict") == "ANOMALOUS").alias("odd"))
    verdict = F.when(F.col("odd"), "ANOMALOUS").when(F.col("enough"), "NORMAL").otherwise("INSUFFICIENT_HISTORY")
    return out.select("client_address", F.col("b.registrable_domain").alias("registrable_domain"), F.col("b.score").alias("score"), F.col("b.total").alias("total"), verdict.alias("verdict"))
