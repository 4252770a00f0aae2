"""The five detectors as columns: each gives a signal, struct(name, score, confidence, scope_key, verdict, factors).

A detector without evidence abstains: confidence 0, so fusion leaves it out of both sums.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import text as T
from tidewarden.functions.text import bound
from tidewarden.functions.names import CONTROLLED_SPAN, DELEGATED_SPAN, LABEL_SPAN
from tidewarden.policy import POLICY, Policy

FACTOR = "struct<code:string,severity:string,raw_points:double>"
SIGNAL = f"struct<name:string,score:double,confidence:double,scope_key:string,verdict:string,factors:array<{FACTOR}>>"


def factor(when: Column, code: str, severity: Column | str, points: Column | float) -> Column:
    points = points if isinstance(points, Column) else F.lit(float(points))
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), points.cast("double").alias("raw_points")))


def present(*factors: Column) -> Column:
    return F.filter(F.array(*factors), lambda f: f.isNotNull())


def points(factors: Column) -> Column:
    return T.clamp(F.aggregate(factors, F.lit(0.0), lambda total, f: total + f["raw_points"]))


def signal(name: str, score: Column, confidence: Column, scope: Column, verdict: Column, factors: Column) -> Column:
    out = F.struct(
        F.lit(name).alias("name"), score.cast("double").alias("score"), confidence.cast("double").alias("confidence"),
        scope.cast("string").alias("scope_key"), verdict.cast("string").alias("verdict"), factors.alias("factors"),
    ).cast(SIGNAL)
    return bound(out)


def indicated(*tests: tuple[Column, str, float]) -> Column:
    """The indicators whose test holds, with their points."""
    return present(*(factor(test, name, "medium", p) for test, name, p in tests))


def summed(any_fired: Column, code: str, severity: Column, otherwise: Column | str) -> Column:
    """One finding with the whole score (column ``_score``), or one that nothing was found."""
    code, quiet = F.when(any_fired, code), otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.array(F.struct(F.coalesce(code, quiet).alias("code"), F.when(any_fired, severity).otherwise("info").alias("severity"), F.col("_score").alias("raw_points")))


def gates(df: DataFrame) -> tuple[Column, Column]:
    """(whether the shape of a name says anything, whether its words do)."""
    kind = F.coalesce(F.col("cls.kind"), F.lit(""))
    semantic = ~kind.isin("IP_LITERAL", "INFRASTRUCTURE", "")
    encoded = F.col("name.is_punycode")
    return semantic & (kind != "LOCAL_NAME") & ~encoded & F.col("cls.scopes.registrant_label").isNotNull(), semantic


def lexical(df: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds ``lexical``. Rules on shape need a registrant's label; rules on words need a name that someone chose."""
    p = policy.get("lexical")
    shape, semantic = gates(df)
    f = lambda c: F.col(f"feat.{c}")
    entropy = F.greatest(f("sld_entropy"), f("entropy"))
    n_keywords = F.size(f("keywords"))
    how = F.coalesce(f("brand.how"), F.lit(""))
    impersonates = how.isin("brand_on_suspicious_tld", "token", "typosquat")

    def at_least(x: Column, code: str, severity: str, gate: Column = shape) -> Column:
        return factor(gate & (x >= p[code][0]), code, severity, p[code][1])

    first, more, most = p["SUSPICIOUS_KEYWORD"]
    keyword_points = F.least(F.lit(float(most)), f("keyword_weight") * first + (n_keywords - 1) * more)
    factors = present(
        at_least(entropy, "ENTROPY_HIGH", "medium"),
        at_least(entropy, "ENTROPY_VERY_HIGH", "high"),
        factor(shape & (f("sld_length") >= p["normalized_min_length"]) & (f("normalized_entropy") >= p["ENTROPY_NORMALIZED_HIGH"][0]), "ENTROPY_NORMALIZED_HIGH", "medium", p["ENTROPY_NORMALIZED_HIGH"][1]),
        at_least(f("digit_ratio"), "DIGIT_RATIO_HIGH", "medium"),
        at_least(f("digit_ratio"), "DIGIT_RATIO_VERY_HIGH", "high"),
        at_least(f("length"), "LENGTH_LONG", "low"),
        at_least(f("length"), "LENGTH_VERY_LONG", "medium"),
        at_least(f("hyphens"), "HYPHEN_MANY", "low"),
        at_least(f("subdomain_depth"), "SUBDOMAIN_DEEP", "medium"),
        at_least(f("consonant_run"), "CONSONANT_RUN_LONG", "medium"),
        factor(shape & (f("sld_length") >= p["vowel_min_length"]) & (f("vowel_ratio") <= p["VOWEL_RATIO_LOW"][0]), "VOWEL_RATIO_LOW", "medium", p["VOWEL_RATIO_LOW"][1]),
        factor(shape & (f("sld_length") >= p["words_min_length"]) & (f("coverage") <= p["NO_DICTIONARY_WORDS"][0]), "NO_DICTIONARY_WORDS", "medium", p["NO_DICTIONARY_WORDS"][1]),
        factor(shape & (f("tld_weight") > 0), "SUSPICIOUS_TLD", F.when(f("tld_weight") < p["tld_medium"], "low").otherwise("medium"), f("tld_weight") * p["SUSPICIOUS_TLD"]),
        factor(semantic & (n_keywords > 0) & (keyword_points >= 1), "SUSPICIOUS_KEYWORD", F.when(f("keyword_weight") < p["keyword_medium"], "low").otherwise("medium"), keyword_points),
        factor(semantic & impersonates, "BRAND_IMPERSONATION", "high", p["BRAND_IMPERSONATION"]),
        factor(semantic & (how == "substring"), "BRAND_SUBSTRING", "low", p["BRAND_SUBSTRING"]),
        factor(semantic & f("is_punycode"), "PUNYCODE", "medium", p["PUNYCODE"]),
    )
    df = df.withColumn("_f", bound(factors))
    fired = F.size("_f") > 0
    full, short = p["confidence"]
    confidence = F.when(~fired, 0.0).when(f("sld_length") < p["short_label"], short).otherwise(full)
    quiet = F.array(F.struct(F.when(semantic, "LEXICAL_CLEAN").otherwise("LEXICAL_NOT_APPLICABLE").alias("code"), F.lit("info").alias("severity"), F.lit(0.0).alias("raw_points")))
    verdict = F.when(fired, "SCORED").otherwise("ABSTAINED")
    return df.withColumn("lexical", signal("lexical", points(F.col("_f")), confidence, F.lit(LABEL_SPAN), verdict, F.when(fired, F.col("_f")).otherwise(quiet))).drop("_f")


def tunnel(df: DataFrame, query_type: str | None = None, policy: Policy = POLICY) -> DataFrame:
    """Adds ``tunnel``: does the part of a name that its holder controls look like carried data? ``tunnel_indicators`` are
    what speaks for it; in the signal they are one finding."""
    p = policy.get("tunnel")
    kind = F.coalesce(F.col("cls.kind"), F.lit(""))
    applies = ~kind.isin("IP_LITERAL", "INFRASTRUCTURE", "")
    delegated = F.coalesce("cls.scopes.delegated_span", F.lit(""))
    wide = (delegated != "") & ~F.coalesce("cls.scope_is_registrant_chosen", F.lit(False))
    df = df.withColumn("_span", F.when(~applies, "").when(wide, F.coalesce("cls.scopes.controlled_span", F.lit(""))).otherwise(delegated))
    df = df.withColumn("_key", F.when(wide, CONTROLLED_SPAN).otherwise(DELEGATED_SPAN))
    span = F.col("_span")
    labels = F.filter(F.split(span, r"\."), lambda x: x != "")
    flat = F.replace(span, F.lit("."), F.lit(""))
    asked = F.upper(F.col(query_type)) if query_type else F.lit(None).cast("string")
    fired = indicated(
        (F.length(span) >= p["long_subdomain"][0], "long_subdomain", p["long_subdomain"][1]),
        (F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)) >= p["long_label"][0], "long_label", p["long_label"][1]),
        ((F.length(span) >= p["entropy_min_length"]) & (F.round(T.entropy(flat), 3) >= p["entropy"][0]), "high_subdomain_entropy", p["entropy"][1]),
        (F.size(labels) >= p["many_labels"][0], "many_labels", p["many_labels"][1]),
        (F.exists(labels, lambda x: T.encoding_alphabet(x).isNotNull()), "encoded_payload", p["encoded_payload"]),
    )
    df = df.withColumn("_f", bound(fired))
    carried = indicated(((F.size("_f") > 0) & F.coalesce(asked.isin(p["record_types"]), F.lit(False)), "high_capacity_record", p["high_capacity_record"]))
    df = df.withColumn("_f", bound(F.concat("_f", carried)))
    n = F.size("_f")
    one, two, three = p["confidence"]
    confidence = F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, two).otherwise(three)
    df = df.withColumns({"tunnel_indicators": F.transform("_f", lambda f: f["code"]), "_score": points(F.col("_f"))})
    found = summed(n > 0, "DNS_TUNNEL_INDICATORS", F.when(n >= 3, "high").otherwise("medium"), "DNS_TUNNEL_NONE")
    return df.withColumn("tunnel", signal("tunnel", F.col("_score"), confidence, F.col("_key"), F.when(n > 0, "SCORED").otherwise("ABSTAINED"), found)).drop("_f", "_span", "_key", "_score")


#: Letters of a label, and its ends.
PAIR_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789-^$"


def bigram_llr(label: Column, log_probs: dict[str, float], uniform: float, digits: bool = False) -> Column:
    """Mean log-probability of a label's letter pairs, with ends marked, and digits left out but for ``digits``, less that of
    chance."""
    clean = F.concat(F.lit("^"), F.regexp_replace(F.lower(label), "[^a-z0-9-]" if digits else "[^a-z-]", ""), F.lit("$"))
    n = len(PAIR_LETTERS)
    grid = [log_probs.get(a + b, uniform) for a in PAIR_LETTERS for b in PAIR_LETTERS]
    table = F.from_json(F.lit(json.dumps(grid)), "array<double>")  # one literal, read by place
    place = lambda i: F.instr(F.lit(PAIR_LETTERS), clean.substr(i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.length(clean) - 1), lambda i: F.get(table, (place(i) - 1) * n + place(i + 1) - 1))
    total = F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x)
    return F.when(F.length(clean) > 2, total / F.size(pairs) - uniform).otherwise(0.0)


DGA_TERMS = ("bigram_implausibility", "no_dictionary_words", "digit_density")


def dga(df: DataFrame, model: dict, policy: Policy = POLICY) -> DataFrame:
    """Adds ``dga`` (score 0 to 100 in the signal), ``dga_score`` (0 to 1) and ``dga_contributors``, the terms that push the
    score up, the strongest first. ``model``: see training.bigram_model. With the policy's ``word_composed`` share set, a
    label that words cover more than that gets no vote."""
    p = policy.get("dga")
    shape, _ = gates(df)
    label = F.coalesce(F.col("cls.scopes.registrant_label"), F.lit(""))
    llr = bigram_llr(label, model["log_probs"], model["uniform"])
    z = bound(T.clamp((model["mean"] - llr) / max(model["std"], 1e-9), p["z_low"], p["z_high"]))
    n = F.length(F.regexp_replace(F.lower(label), "[^a-z0-9-]", ""))
    df = df.withColumns(
        {
            "_bigram_implausibility": p["bigram"] * z * F.least(F.lit(1.0), n / p["full_length"]),
            "_no_dictionary_words": p["coverage"] * ((1 - F.col("feat.coverage")) - p["coverage_mid"]),
            "_digit_density": p["digits"] * (F.col("feat.digit_ratio") - p["digits_mid"]),
        }
    )
    logit = F.col("_bigram_implausibility") + F.col("_no_dictionary_words") + F.col("_digit_density") + p["bias"]
    df = df.withColumn("dga_score", F.when(shape, T.sigmoid(logit)))
    terms = F.array(*(F.struct((-F.col(f"_{c}")).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(DGA_TERMS)))
    pushing = F.transform(F.array_sort(F.filter(terms, lambda t: t["k"] < 0)), lambda t: t["name"])
    df = df.withColumn("dga_contributors", F.when(shape, pushing).otherwise(F.array().cast("array<string>")))
    score = F.coalesce("dga_score", F.lit(0.0))
    bar = F.when(n >= p["long"], p["moderate"]).otherwise(p["high"])
    long, short, least = p["confidence"]
    composed = F.lit(p["word_composed"] is not None) & (F.col("feat.coverage") > (p["word_composed"] or 1.0))
    confidence = F.when(~shape | (score < bar) | composed, 0.0).when(n >= p["long"], long).when(n >= p["short"], short).otherwise(least)
    code = F.when(~shape, "DGA_NOT_APPLICABLE").when(score >= p["high"], "DGA_HIGH").when(score >= p["moderate"], "DGA_MODERATE").otherwise("DGA_LOW")
    severity = F.when(score >= p["high"], "high").when(score >= p["moderate"], "medium").otherwise("info")
    factors = F.array(F.struct(code.alias("code"), severity.alias("severity"), (score * 100).alias("raw_points")))
    df = df.drop(*(f"_{c}" for c in DGA_TERMS))
    return df.withColumn("dga", signal("dga", score * 100, confidence, F.lit(LABEL_SPAN), F.when(confidence > 0, "SCORED").otherwise("ABSTAINED"), factors))


HISTORY = ("total", "distinct_names", "nxdomain", "blocked")


def behavioral(df: DataFrame, policy: Policy = POLICY, prefix: str = "") -> DataFrame:
    """Adds ``behavioral`` from the columns total, distinct_names, nxdomain and blocked (null: none), and what was odd as
    ``behavioral_indicators``; in the signal it is one finding."""
    p = policy.get("behavioral")
    total, names, missing, blocked = (F.coalesce(F.col(prefix + c), F.lit(0)) for c in HISTORY)
    enough = total >= p["min_events"]
    fired = indicated(
        (enough & (total >= p["burst"][0]), "query_burst", p["burst"][1]),
        (enough & (names >= p["fanout"][0]), "subdomain_fanout", p["fanout"][1]),
        (enough & (total >= p["nxdomain_min_events"]) & (missing / F.greatest(total, F.lit(1)) >= p["nxdomain"][0]), "high_nxdomain_ratio", p["nxdomain"][1]),
        (enough & (blocked >= p["blocked"][0]), "repeatedly_blocked", p["blocked"][1]),
    )
    df = df.withColumn("_f", bound(fired))
    n = F.size("_f")
    base, step, most = p["confidence"]
    confidence = F.when(n > 0, F.least(F.lit(most), base + step * total)).otherwise(0.0)
    verdict = F.when(~enough, "INSUFFICIENT_HISTORY").when(n > 0, "ANOMALOUS").otherwise("NORMAL")
    df = df.withColumns({"behavioral_indicators": F.transform("_f", lambda f: f["code"]), "_score": points(F.col("_f"))})
    found = summed(n > 0, "BEHAVIORAL_ANOMALY", F.when(n >= 2, "high").otherwise("medium"), F.when(enough, "BEHAVIORAL_NORMAL").otherwise("BEHAVIORAL_NO_HISTORY"))
    return df.withColumn("behavioral", signal("behavioral", F.col("_score"), confidence, F.lit(None), verdict, found)).drop("_f", "_score")


def behaved(total: int, names: int, missing: int, blocked: int, policy: Policy = POLICY) -> tuple[float, float]:
    """(score, confidence) that ``behavioral`` gives for these counts; for scans that go row by row."""
    p = policy.values["behavioral"]
    if total < p["min_events"]:
        return 0.0, 0.0
    ratio = missing / max(total, 1)
    fired = [points for holds, points in (
        (total >= p["burst"][0], p["burst"][1]), (names >= p["fanout"][0], p["fanout"][1]), (total >= p["nxdomain_min_events"] and ratio >= p["nxdomain"][0], p["nxdomain"][1]), (blocked >= p["blocked"][0], p["blocked"][1]),
    ) if holds]
    base, step, most = p["confidence"]
    return (float(max(0.0, min(100.0, sum(fired)))), min(most, base + step * total)) if fired else (0.0, 0.0)


def intel(df: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds ``ti`` from the column ``intel``. Trusted names vote 0 with confidence; unknown ones abstain."""
    p = policy.get("intel")
    verdict = F.col("intel.verdict")
    score = F.when(verdict == "MALICIOUS", float(p["malicious"])).when(verdict == "SUSPICIOUS", float(p["suspicious"])).otherwise(float(p["trusted"]))
    confidence = F.when(verdict == "UNKNOWN", 0.0).otherwise(F.col("intel.confidence"))
    factors = present(
        factor(verdict == "MALICIOUS", "TI_MALICIOUS", "critical", score), factor(verdict == "SUSPICIOUS", "TI_SUSPICIOUS", "high", score),
        factor(verdict == "TRUSTED", "TI_TRUSTED", "info", 0.0), factor(verdict == "UNKNOWN", "TI_NO_MATCH", "info", 0.0),
    )
    return df.withColumn("ti", signal("ti", score, confidence, F.lit(None), verdict, factors))
