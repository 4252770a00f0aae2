"""Fusion of the signals into one explained score: a fold of columns, no UDF.

Every override that moves the score by at least ``least_move`` is a factor of its own, so the contributions of all factors
add up to the raw score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.names import independent_scopes
from tidewarden.functions.text import bound
from tidewarden.policy import POLICY, Policy

SIGNALS = ("ti", "dga", "lexical", "tunnel", "behavioral")


def band(score: Column, what: int, policy: Policy = POLICY) -> Column:
    """Classification (0) or decision (1) of a score, rounded half to even; bands are inclusive."""
    rounded, out = F.bround(score, 0), None
    for row in policy.get("bands"):
        test = (rounded >= row[2]) & (rounded <= row[3])
        out = F.when(test, row[what]) if out is None else out.when(test, row[what])
    return out.otherwise(["SUSPICIOUS", "MONITOR"][what])


def _step(step, least: float):
    """A score after one rule; moves below ``least`` are none."""

    def after(x: Column) -> Column:
        moved = F.coalesce(step(x), x)
        return F.when(F.abs(moved - x) >= least, moved).otherwise(x)

    return after


def prose(names: Column) -> Column:
    """"a", "a and b", "a, b and c"; empty without names."""
    n = F.size(names)
    most = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(F.concat(most, F.lit(" and "), F.try_element_at(names, F.lit(-1))))


def advice(decision: Column, verdict: Column, dga: Column, contributing: Column, informed: Column) -> Column:
    """What to do about a name, in a sentence or two: by decision, then by what the decision rests on."""
    named, trusted = prose(contributing), verdict == "TRUSTED"
    blocked = F.when(verdict == "MALICIOUS", "Block: a listed malicious name. Isolate the hosts that asked for it and look for others of the same campaign.").otherwise(
        "Block and raise an alert: no list knows this name yet, so it is a candidate for one."
    )
    watched = F.when(dga >= 50, "Allow and watch: the name looks generated. Compare how often and when it is asked for.").otherwise(
        "Allow and watch: the evidence is mixed. Look again if it comes back or more hosts ask for it."
    )
    allowed = (
        F.when((F.size(contributing) > 0) & trusted, F.concat(F.lit("Allow: a trusted name, though risk was reported by "), named, F.lit("; look again if it comes back.")))
        .when(F.size(contributing) > 0, F.concat(F.lit("Allow: risk was reported by "), named, F.lit(", but too little to act on.")))
        .when(~informed, "Allow: nothing is known about this name, which is no proof of safety.")
        .when(trusted, "Allow: a trusted name.")
        .otherwise("Allow: whatever could judge this name found no risk.")
    )
    return F.when(decision == "BLOCK", blocked).when(decision == "MONITOR", watched).otherwise(allowed)


def let(x: Column, f) -> Column:
    """f(x) with x evaluated, and written into the plan, once."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


# The code of each override's factor.
OVERRIDES = {
    "ti_malicious_floor": "OVERRIDE_TI_FLOOR", "brand_impersonation_floor": "OVERRIDE_BRAND_FLOOR", "corroboration_bonus": "OVERRIDE_CORROBORATION", "tld_dga_bonus": "OVERRIDE_TLD_DGA",
    "corroborated_floor": "OVERRIDE_CORROBORATED_FLOOR", "ti_trusted_ceiling": "OVERRIDE_TRUSTED_CEILING", "clamp": "OVERRIDE_CLAMP", "allowlist_set_aside": "OVERRIDE_ALLOWLIST_SET_ASIDE",
}
NAMES = {"ti": "threat_intel"}


def assess(df: DataFrame, policy: Policy = POLICY, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``assessment``: struct(score, raw_score, classification, decision, confidence, coverage, factors, overrides).

    ``df`` has a signal column for each detector; a null signal abstains. ``weights``: the detectors and their weights, the
    built-in ones and any others (see ``detectors``); by default the policy's."""
    w, p = weights or policy.get("weights"), policy.get("fusion")
    signals = tuple(dict.fromkeys([*SIGNALS, *w]))
    s = {n: (F.coalesce(F.col(f"{n}.score"), F.lit(0.0)), F.coalesce(F.col(f"{n}.confidence"), F.lit(0.0))) for n in signals}
    has = lambda n, code: F.exists(F.coalesce(F.col(f"{n}.factors"), F.array()), lambda f: f["code"] == code)
    trusted, malicious = (F.coalesce(F.col("ti.verdict") == v, F.lit(False)) for v in ("TRUSTED", "MALICIOUS"))
    loud = lambda n: (s[n][1] > 0) & (s[n][0] >= p["set_aside"])
    df = df.withColumn("_aside", trusted & (loud("tunnel") | loud("behavioral")))
    df = df.withColumns({f"_c_{n}": F.when(F.col("_aside"), 0.0).otherwise(c) if n == "ti" else c for n, (_, c) in s.items()})
    weight = {n: w[n] * F.col(f"_c_{n}") for n in signals}
    total = sum(weight.values(), F.lit(0.0))
    df = df.withColumn("_w", total)
    base = F.when(F.col("_w") > 0, sum((weight[n] * s[n][0] for n in signals), F.lit(0.0)) / F.col("_w")).otherwise(0.0)
    df = df.withColumn("_s0", base)

    def shares(n: str) -> Column:
        """A signal's part of the score, dealt out by its factors' points."""
        part = F.when(F.col("_w") > 0, weight[n] * s[n][0] / F.col("_w")).otherwise(0.0)
        factors = F.coalesce(F.col(f"{n}.factors"), F.array().cast("array<struct<code:string,severity:string,raw_points:double>>"))
        positive = lambda f: F.greatest(F.lit(0.0), F.coalesce(f["raw_points"], F.lit(0.0)))
        whole = F.aggregate(factors, F.lit(0.0), lambda t, f: t + positive(f))
        even = F.when(F.size(factors) > 0, part / F.size(factors)).otherwise(0.0)
        dealt = F.transform(
            factors,
            lambda f: F.struct(
                f["code"].alias("code"), F.lit(n).alias("signal"), f["severity"].alias("severity"), f["raw_points"].alias("raw_points"),
                F.when(whole > 0, part * positive(f) / whole).otherwise(even).alias("contribution"),
            ),
        )
        lone = F.array(F.struct(F.lit(n.upper()).alias("code"), F.lit(n).alias("signal"), F.lit("info").alias("severity"), part.alias("raw_points"), part.alias("contribution")))
        return F.when(F.size(factors) > 0, dealt).otherwise(F.when(part > 0, lone).otherwise(F.filter(lone, lambda x: F.lit(False))))

    df = df.withColumn("_factors", bound(F.flatten(F.array(*(shares(n) for n in signals)))))
    names, conf = list(signals), {n: F.col(f"_c_{n}") for n in signals}
    strong = F.filter(
        F.array(*(F.when((conf[n] > 0) & (s[n][0] >= p["corroboration"][0]), F.coalesce(F.nullif(F.col(f"{n}.scope_key"), F.lit("")), F.lit(f"#{n}"))) for n in names)),
        lambda k: k.isNotNull(),
    )

    def counts_for(n: str):
        return lambda f: (f["signal"] == n) & (f["contribution"] > 0)

    several = F.lit(False)
    for n in names:
        codes = F.array_distinct(F.transform(F.filter("_factors", counts_for(n)), lambda f: f["code"]))
        several = several | ((conf[n] > 0) & (s[n][0] >= p["single"][0]) & (F.size(codes) >= p["single"][1]))
    steps = [
        ("ti_malicious_floor", lambda x: F.when(malicious & (conf["ti"] >= p["ti_floor_confidence"]), F.greatest(x, F.lit(float(p["ti_floor"]))))),
        ("brand_impersonation_floor", lambda x: F.when(has("lexical", "BRAND_IMPERSONATION"), F.greatest(x, F.lit(float(p["brand_floor"]))))),
        ("corroboration_bonus", lambda x: F.when(F.size(independent_scopes(strong)) >= 2, x + p["corroboration"][1])),
        ("tld_dga_bonus", lambda x: F.when(has("lexical", "SUSPICIOUS_TLD") & (s["dga"][0] >= 100 * p["tld_dga"][0]), x + p["tld_dga"][1])),
        ("corroborated_floor", lambda x: F.when(several, F.greatest(x, F.lit(float(p["single"][2]))))),
        ("ti_trusted_ceiling", lambda x: F.when(trusted & ~F.col("_aside"), F.least(x, F.lit(float(p["trusted_ceiling"]))))),
        ("clamp", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))),
    ]
    moved = []
    for i, (name, step) in enumerate(steps, 1):
        before = F.col(f"_s{i - 1}")
        df = df.withColumn(f"_s{i}", let(before, _step(step, p["least_move"])))
        delta = F.col(f"_s{i}") - before
        moved.append(F.when(delta != 0, F.struct(F.lit(OVERRIDES[name]).alias("code"), F.lit("override").alias("signal"), F.lit("info").alias("severity"), delta.alias("raw_points"), delta.alias("contribution"))))
    marker = F.when(F.col("_aside"), F.struct(F.lit(OVERRIDES["allowlist_set_aside"]).alias("code"), F.lit("override").alias("signal"), F.lit("info").alias("severity"), F.lit(0.0).alias("raw_points"), F.lit(0.0).alias("contribution")))
    df = df.withColumn("_moved", bound(F.filter(F.array(*moved, marker), lambda f: f.isNotNull())))
    ordered = F.transform(F.concat("_factors", "_moved"), lambda f, i: F.struct((-f["contribution"]).alias("k"), i.alias("i"), f.alias("f")))
    ordered = F.transform(F.array_sort(ordered), lambda x: x["f"])
    nothing = F.array(F.struct(F.lit("NO_EVIDENCE").alias("code"), F.lit("none").alias("signal"), F.lit("info").alias("severity"), F.lit(0.0).alias("raw_points"), F.lit(0.0).alias("contribution")))
    raw = F.col(f"_s{len(steps)}")
    confidence = F.greatest(*conf.values())
    names_of = F.create_map(*(F.lit(x) for name, code in OVERRIDES.items() for x in (code, name)))
    contributing = F.filter(F.array(*(F.when(weight[n] * s[n][0] > 0, NAMES.get(n, n)) for n in signals)), lambda x: x.isNotNull())
    assessment = F.struct(
        F.bround(raw, 0).cast("int").alias("score"), raw.alias("raw_score"), band(raw, 0, policy).alias("classification"), band(raw, 1, policy).alias("decision"),
        confidence.alias("confidence"), (F.col("_w") / sum(w.values())).alias("coverage"),
        F.when(F.col("_w") > 0, ordered).otherwise(F.concat(ordered, nothing)).alias("factors"),
        F.transform(F.filter("_moved", lambda f: f["code"] != OVERRIDES["clamp"]), lambda f: F.element_at(names_of, f["code"])).alias("overrides"),
        advice(band(raw, 1, policy), F.coalesce("ti.verdict", F.lit("UNKNOWN")), s["dga"][0], contributing, F.col("_w") > 0).alias("recommendation"),
    )
    return df.withColumn("assessment", bound(assessment)).drop("_aside", "_w", "_factors", "_moved", *(f"_c_{n}" for n in signals), *(f"_s{i}" for i in range(len(steps) + 1)))


def top_factors(factors: Column, k: int = 5) -> Column:
    """The first factors with a contribution, rounded for display."""
    some = F.slice(F.filter(factors, lambda f: f["contribution"] > 0), 1, k)
    return F.transform(some, lambda f: F.struct(f["code"].alias("code"), f["severity"].alias("severity"), F.round(f["contribution"], 2).alias("contribution")))


#: What ``blocks`` needs of a row, so that the verdict follows from the behavioural signal alone.
TERMS = (
    "trusted boolean, tunnel_loud boolean, weight double, weighed double, weight_aside double, weighed_aside double, ti_floor boolean, brand boolean, scopes int, scopes_aside int, "
    "tld_dga boolean, several boolean"
)


def terms(policy: Policy = POLICY) -> list[Column]:
    """The columns of ``TERMS`` from the signals ti, dga, lexical and tunnel; those that end in _aside are for a row whose
    trusted entry is set aside."""
    w, p = policy.get("weights"), policy.get("fusion")
    score = {n: F.coalesce(F.col(f"{n}.score"), F.lit(0.0)) for n in SIGNALS[:-1]}
    conf = {n: F.coalesce(F.col(f"{n}.confidence"), F.lit(0.0)) for n in SIGNALS[:-1]}
    factors = {n: F.coalesce(F.col(f"{n}.factors"), F.array().cast("array<struct<code:string,severity:string,raw_points:double>>")) for n in SIGNALS[:-1]}
    is_verdict = lambda v: F.coalesce(F.col("ti.verdict") == v, F.lit(False))
    has = lambda n, code: F.exists(factors[n], lambda f: f["code"] == code)
    strong = {n: F.when((conf[n] > 0) & (score[n] >= p["corroboration"][0]), F.coalesce(F.nullif(F.col(f"{n}.scope_key"), F.lit("")), F.lit(f"#{n}"))) for n in SIGNALS[:-1]}
    scopes = lambda names: F.size(independent_scopes(F.filter(F.array(*(strong[n] for n in names)), lambda k: k.isNotNull())))
    several = F.lit(False)
    for n in SIGNALS[:-1]:
        pointed = F.filter(factors[n], lambda f: F.coalesce(f["raw_points"], F.lit(0.0)) > 0)
        counting = F.when(F.size(pointed) > 0, pointed).otherwise(factors[n])  # without points they share alike
        several = several | ((conf[n] > 0) & (score[n] >= p["single"][0]) & (F.size(F.array_distinct(F.transform(counting, lambda f: f["code"]))) >= p["single"][1]))

    def summed(of, names) -> Column:
        out = F.lit(0.0)
        for n in names:  # in the order that ``assess`` adds them
            out = out + of(n)
        return out

    weigh = lambda n: w[n] * conf[n]
    every, rest = SIGNALS[:-1], SIGNALS[1:-1]
    columns = (
        is_verdict("TRUSTED"), (conf["tunnel"] > 0) & (score["tunnel"] >= p["set_aside"]), summed(weigh, every), summed(lambda n: weigh(n) * score[n], every), summed(weigh, rest), summed(lambda n: weigh(n) * score[n], rest),
        is_verdict("MALICIOUS") & (conf["ti"] >= p["ti_floor_confidence"]), has("lexical", "BRAND_IMPERSONATION"), scopes(every), scopes(rest),
        has("lexical", "SUSPICIOUS_TLD") & (score["dga"] >= 100 * p["tld_dga"][0]), several,
    )
    return [c.alias(t.split()[0]) for c, t in zip(columns, TERMS.split(", "), strict=True)]


def blocks(t, score: float, confidence: float, policy: Policy = POLICY) -> bool:
    """Whether ``assess`` decides BLOCK for a row with these terms and this behavioural signal; the tests hold the two together."""
    w, p = policy.values["weights"]["behavioral"], policy.values["fusion"]
    aside = t.trusted and (t.tunnel_loud or confidence > 0 and score >= p["set_aside"])
    own = w * confidence
    weight, weighed, scopes = (t.weight_aside, t.weighed_aside, t.scopes_aside) if aside else (t.weight, t.weighed, t.scopes)
    x = (weighed + own * score) / (weight + own) if weight + own > 0 else 0.0
    loud = scopes + (confidence > 0 and score >= p["corroboration"][0])
    for holds, to in (
        (t.ti_floor and not aside, lambda x: max(x, p["ti_floor"])), (t.brand, lambda x: max(x, p["brand_floor"])), (loud >= 2, lambda x: x + p["corroboration"][1]), (t.tld_dga, lambda x: x + p["tld_dga"][1]),
        (t.several, lambda x: max(x, p["single"][2])), (t.trusted and not aside, lambda x: min(x, p["trusted_ceiling"])), (True, lambda x: max(0.0, min(100.0, x))),
    ):
        if holds and abs(to(x) - x) >= p["least_move"]:
            x = to(x)
    return next((row[1] for row in policy.values["bands"] if row[2] <= round(x) <= row[3]), "MONITOR") == "BLOCK"
