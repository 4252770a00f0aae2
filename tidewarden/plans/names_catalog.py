"""Queries over names and their SQL: hosts of the pages, and names of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden import dims
from tidewarden.operators import intel, scorers, training
from tidewarden.plans import analysis
from tidewarden.plans.views import PAGE_HOSTS_SQL, page_hosts
from tidewarden.policy import POLICY

#: Names beside the pages' hosts: kinds, brands, carried data, generated labels.
NAMES = (
    "login.paypal.de paypal.tk office-appla-note.org secure-paypal-login.com paypa1.com mypaypalhelp.net paypal-news.org deadbeef.cdn.example.com 1234_5678.example.com "
    "facadeface.example.net d1a2b3c4e5f6g7.cloudfront.net foo.cloudfront.net payload.foo.pages.dev a.b.c.d.e.example.co.uk xkqzvwpfhjd.info q1w2e3r4t5y6.biz bcdfghjk.com "
    "9f8e7d6c5b4a39281706f5e4d3c2b1a0.t.example.org mfrggzdfmztwq2lk.data.example.net mfrggzdfmztwq2lkmzxw6ytboi.ge4dkmzrgq2tsnbyg4ztsobqgeztcnrv.q7.tunnelpath.xyz printer.local wpad "
    "42.1.168.192.in-addr.arpa 8.8.8.8 192.168.1.10 amazon.de www.github.com gitlab.com weather-report-online.com free-bank-login-verify.top malware-drop.example.net x.evil-phish.test.com"
).split()
LETTERS = "[a-z]"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(n,) for n in NAMES], "raw string")
    return page_hosts(spark, sf_dir).select("raw").unionByName(listed).distinct()


def _codes(column: str):
    return F.array_join(F.array_sort(F.transform(F.col(f"{column}.factors"), lambda f: f["code"])), ",")


def _r(c: str):
    return F.round(F.col(c), 6)


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorers.lexical(analysis.features(hosts(spark, sf_dir)))
    return out.select("raw", _r("lexical.score").alias("score"), "lexical.confidence", "lexical.scope_key", _codes("lexical").alias("codes"))


def _tunnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorers.tunnel(analysis.features(hosts(spark, sf_dir)).withColumn("asked", F.lit("txt")), "asked")
    return out.select("raw", _r("tunnel.score").alias("score"), "tunnel.confidence", "tunnel.scope_key", F.array_join("tunnel_indicators", ",").alias("indicators"))


def _dga(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorers.dga(analysis.features(hosts(spark, sf_dir)), analysis.default_model(spark))
    return out.select("raw", _r("dga.score").alias("score"), "dga.confidence", _codes("dga").alias("codes"), F.array_join("dga_contributors", ",").alias("contributors"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = analysis.features(hosts(spark, sf_dir))
    plain = "sld_length label_count subdomain_depth max_label_length hyphens consonant_run digit_run repeat_run".split()
    real = "mean_label_length digit_ratio hyphen_ratio vowel_ratio consonant_ratio letter_ratio other_ratio unique_ratio entropy sld_entropy normalized_entropy coverage tld_weight keyword_weight".split()
    return f.select("raw", *(F.col(f"feat.{c}").cast("long").alias(c) for c in plain), *(_r(f"feat.{c}").alias(c) for c in real), F.array_join(F.array_sort("feat.keywords"), ",").alias("keywords"))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.features(hosts(spark, sf_dir)).select("raw", "feat.brand.brand", "feat.brand.how")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = analysis.features(hosts(spark, sf_dir))
    spans = ("registrant_label", "delegated_span", "controlled_span", "semantic_text")
    return f.select("raw", "cls.kind", "cls.suffix_kind", *(f"cls.scopes.{c}" for c in spans), "cls.scope_is_registrant_chosen", "cls.is_reverse_dns", "cls.reverse_target", "cls.ip_version", "cls.ip_is_private")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.features(hosts(spark, sf_dir)).select("raw", _r("feat.coverage").alias("coverage"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.analyze(hosts(spark, sf_dir))
    return out.select("raw", "assessment.score", _r("assessment.raw_score").alias("raw_score"), "assessment.classification", "assessment.decision", _r("assessment.confidence").alias("confidence"), _r("assessment.coverage").alias("coverage"), F.array_join("assessment.overrides", ",").alias("overrides"), "assessment.recommendation")


def _intel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.statistics(dims.indicators(spark), dims.trusted(spark))


def queries() -> dict:
    return {
        "name_kinds": _kinds, "name_features": _features, "brand_matches": _brands, "dictionary_coverage": _coverage, "lexical_scores": _lexical, "tunnel_scores": _tunnel,
        "dga_scores": _dga, "assessed_hosts": _assessed, "intel_statistics": _intel_totals,
    }


def _values(rows) -> str:
    return ", ".join(f"({', '.join(r)})" for r in rows)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


def _in(xs) -> str:
    return ", ".join(map(_text, sorted(xs)))


_LISTED = {s for s in dims.REGISTRY_SUFFIXES + dims.PROVIDER_SUFFIXES if "." in s}


def _entropy(of: str) -> str:
    return f"coalesce((select -sum(p * log2(p)) from (select count(*) / length({of}) as p from (select unnest(string_split({of}, '')) as c) where c <> '' group by c)), 0)"


def _count(of: str, kind: str) -> str:
    return f"length(regexp_replace({of}, '[^{kind}]', '', 'g'))"


def _run(of: str, kind: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({of}, '[{kind}]+'), lambda x: length(x))), 0)"


#: Names with their parts and kinds.
NAMES_SQL = f"""
    {PAGE_HOSTS_SQL},
    every as (select raw from hosts union select * from (values {_values([_text(n)] for n in NAMES)}) t(raw)),
    parts as (
        select *, string_split(raw, '.') as labels, regexp_matches(raw, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') as is_ip from every
    ), cut as (
        select *, case when len(labels) >= 3 and array_to_string(labels[-3:], '.') in ({_in(_LISTED)}) then 3 when len(labels) >= 2 and array_to_string(labels[-2:], '.') in ({_in(_LISTED)}) then 2 else 1 end as depth from parts
    ), named as (
        select *, case when len(labels) > depth then len(labels) - depth else 1 end as own, array_to_string(labels[-depth:], '.') as any_suffix, replace(raw, '.', '') as flat from cut
    ), split as (
        select *, case when not is_ip then any_suffix end as suffix, case when is_ip then '' else labels[own] end as sld, case when is_ip then '' else array_to_string(labels[:own - 1], '.') end as subdomain,
            case when is_ip or len(labels) = 1 then raw else array_to_string(labels[own:], '.') end as registrable,
            case when is_ip then 'IP_LITERAL' when len(labels) = 1 then case when raw in ({_in(dims.LOCAL_SUFFIXES)}) then 'LOCAL_NAME' else 'SINGLE_LABEL' end when labels[-1] = 'arpa' then 'INFRASTRUCTURE'
                when labels[-1] in ({_in(dims.LOCAL_SUFFIXES)}) then 'LOCAL_NAME' when any_suffix in ({_in(dims.PROVIDER_SUFFIXES)}) then 'PROVIDER_HOST' else 'REGISTRY_DOMAIN' end as kind
        from named
    ), kinds as (
        select *, kind in ('REGISTRY_DOMAIN', 'PROVIDER_HOST', 'SINGLE_LABEL') as has_label, kind in ('REGISTRY_DOMAIN', 'PROVIDER_HOST') as has_spans,
            case when suffix is not null and ends_with(raw, '.' || suffix) then raw[:length(raw) - length(suffix) - 1] when is_ip then raw else raw end as analysed,
            kind in ('REGISTRY_DOMAIN', 'SINGLE_LABEL') or (kind = 'PROVIDER_HOST' and suffix in ({_in(dims.REGISTRANT_SHAPED)})) as chosen,
            kind in ('REGISTRY_DOMAIN', 'PROVIDER_HOST', 'SINGLE_LABEL') as shape, kind not in ('IP_LITERAL', 'INFRASTRUCTURE') as semantic
        from split
    ), spans as (
        select *, case when has_label then sld end as registrant_label, case when has_spans then subdomain end as delegated_span,
            case when has_spans then case when subdomain = '' then sld else subdomain || '.' || sld end end as controlled_span,
            case when has_label then case when len(labels) > 1 then raw[:length(raw) - length(suffix) - 1] else '' end end as semantic_text
        from kinds
    )
"""
_LEXICON = sorted(dims.inflected(dims.WORDS))
COVERAGE_SQL = f"""
    words as (select w from (values {_values([_text(w)] for w in _LEXICON)}) t(w) where length(w) between 3 and 14),
    letters as (select raw, regexp_replace(sld, '[^a-z]', '', 'g') as s from spans),
    hits as (select l.raw, i, max(length(w)) as n from letters l, range(1, 64) r(i) join words on starts_with(substr(l.s, i), w) where i <= length(l.s) group by 1, 2),
    greedy as (
        select raw, s, 1::bigint as i, 0::bigint as covered from letters
        union all select g.raw, g.s, g.i + greatest(1, coalesce(h.n, 0)), g.covered + coalesce(h.n, 0) from greedy g left join hits h on g.raw = h.raw and g.i = h.i where g.i <= length(g.s)
    ), coverage as (select raw, coalesce(max(covered) / nullif(max(length(s)), 0), 0) as coverage from greedy group by 1)
"""
_KEYS = _list(dims.KEYWORDS)
FEATURES_SQL = f"""
    {NAMES_SQL}, {COVERAGE_SQL},
    counted as (
        select s.*, c.coverage, case when is_ip then [] else labels end as ls, greatest(length(flat), 1) as n, {_count("flat", "0-9")} as digits, {_count("flat", "-")} as hyphens, {_count("flat", "aeiou")} as vowels, {_count("flat", "a-z")} as alphas,
            {_entropy("flat")} as entropy, {_entropy("sld")} as sld_entropy, coalesce(nullif(semantic_text, ''), analysed) as read
        from spans s join coverage c on s.raw = c.raw
    ), found as (
        select *, list_filter({_KEYS}, lambda k: contains(read, k)) as hits, len(list_filter({_KEYS}, lambda k: contains(analysed, k))) > 0 as has_keyword, coalesce(suffix in ({_in(dims.TLD_WEIGHTS)}), false) as bad_suffix from counted
    ), feats as (
        select *, list_filter(hits, lambda k: len(list_filter(hits, lambda o: o <> k and contains(o, k))) = 0) as keywords,
            coalesce(case when not is_ip then map({_list(dims.TLD_WEIGHTS)}, {list(dims.TLD_WEIGHTS.values())})[labels[-1]] end, 0)::double as tld_weight,
            digits / n as digit_ratio, hyphens / n as hyphen_ratio, coalesce(vowels / nullif(alphas, 0), 0) as vowel_ratio, coalesce((alphas - vowels) / nullif(alphas, 0), 0) as consonant_ratio,
            case when length(flat) > 1 then entropy / log2(n) else 0 end as normalized_entropy, len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) as subdomain_depth,
            coalesce(list_max(list_transform(ls, lambda l: {_run("l", "bcdfghjklmnpqrstvwxyz")})), 0) as consonant_run
        from found
    ), weighed as (
        select *, coalesce(list_max(list_transform(keywords, lambda k: map({_KEYS}, {list(dims.KEYWORDS.values())})[k])), 0)::double as keyword_weight from feats
    )
"""
_BRANDS = [(i, b, own) for i, (b, own) in enumerate(dims.BRANDS.items()) if len(b) >= 5]
BRANDS_SQL = f"""
    brands as (select * from (values {_values([str(i), _text(b), _list(own), str(2 if len(b) >= 8 else 1)] for i, b, own in _BRANDS)}) t(ord, brand, domains, budget)),
    tried as (
        select w.raw, b.ord, b.brand, contains(w.analysed, b.brand) as inside,
            case when w.sld = b.brand then case when bad_suffix then 'brand_on_suspicious_tld' else 'brand_owned' end
                when list_contains(regexp_split_to_array(w.analysed, '[^a-z0-9]+'), b.brand) then case when bad_suffix or has_keyword then 'token' else 'brand_token_uncorroborated' end
                when levenshtein(w.sld, b.brand) <= b.budget then 'typosquat' end as how
        from weighed w, brands b where not w.is_ip and not list_contains(b.domains, w.registrable)
    ), best as (select raw, arg_min(brand, ord) as brand, arg_min(how, ord) as how from tried where how is not null group by 1),
    within as (select raw, arg_min(brand, ord) as brand, 'substring' as how from tried where inside group by 1),
    branded as (select w.*, coalesce(b.brand, i.brand) as brand, coalesce(b.how, i.how) as how from weighed w left join best b on w.raw = b.raw left join within i on w.raw = i.raw)
"""
_L, _T, _D = POLICY.get("lexical"), POLICY.get("tunnel"), POLICY.get("dga")


def _rule(code: str, test: str, points) -> str:
    return f"case when {test} then {{'code': '{code}', 'points': ({points})::double}} end"


def _least(code: str, of: str) -> str:
    return _rule(code, f"shape and {of} >= {_L[code][0]}", _L[code][1])


_FIRST, _MORE, _MOST = _L["SUSPICIOUS_KEYWORD"]
_RULES = ", ".join([
    _least("ENTROPY_HIGH", "greatest(entropy, sld_entropy)"), _least("ENTROPY_VERY_HIGH", "greatest(entropy, sld_entropy)"),
    _rule("ENTROPY_NORMALIZED_HIGH", f"shape and length(sld) >= {_L['normalized_min_length']} and normalized_entropy >= {_L['ENTROPY_NORMALIZED_HIGH'][0]}", _L["ENTROPY_NORMALIZED_HIGH"][1]),
    _least("DIGIT_RATIO_HIGH", "digit_ratio"), _least("DIGIT_RATIO_VERY_HIGH", "digit_ratio"), _least("LENGTH_LONG", "length(raw)"), _least("LENGTH_VERY_LONG", "length(raw)"),
    _least("HYPHEN_MANY", "hyphens"), _least("SUBDOMAIN_DEEP", "subdomain_depth"), _least("CONSONANT_RUN_LONG", "consonant_run"),
    _rule("VOWEL_RATIO_LOW", f"shape and length(sld) >= {_L['vowel_min_length']} and vowel_ratio <= {_L['VOWEL_RATIO_LOW'][0]}", _L["VOWEL_RATIO_LOW"][1]),
    _rule("NO_DICTIONARY_WORDS", f"shape and length(sld) >= {_L['words_min_length']} and coverage <= {_L['NO_DICTIONARY_WORDS'][0]}", _L["NO_DICTIONARY_WORDS"][1]),
    _rule("SUSPICIOUS_TLD", "shape and tld_weight > 0", f"tld_weight * {_L['SUSPICIOUS_TLD']}"),
    _rule("SUSPICIOUS_KEYWORD", f"semantic and len(keywords) > 0 and least({_MOST}, keyword_weight * {_FIRST} + (len(keywords) - 1) * {_MORE}) >= 1", f"least({_MOST}, keyword_weight * {_FIRST} + (len(keywords) - 1) * {_MORE})"),
    _rule("BRAND_IMPERSONATION", "semantic and how in ('brand_on_suspicious_tld', 'token', 'typosquat')", _L["BRAND_IMPERSONATION"]),
    _rule("BRAND_SUBSTRING", "semantic and how = 'substring'", _L["BRAND_SUBSTRING"]),
])
LEXICAL_SQL = f"""
    ruled as (select *, list_filter([{_RULES}], lambda f: f is not null) as fired from branded),
    lexical as (
        select *, least(100, coalesce(list_sum(list_transform(fired, lambda f: f.points)), 0))::double as lexical_score,
            (case when len(fired) = 0 then 0 when length(sld) < {_L["short_label"]} then {_L["confidence"][1]} else {_L["confidence"][0]} end)::double as lexical_confidence,
            case when len(fired) = 0 then case when semantic then 'LEXICAL_CLEAN' else 'LEXICAL_NOT_APPLICABLE' end else array_to_string(list_sort(list_transform(fired, lambda f: f.code)), ',') end as lexical_codes
        from ruled
    )
"""


def _tunnel_sql(asked: str) -> str:
    encoded = """list_filter(pieces, lambda l: length(l) >= 8 and (regexp_matches(l, '^[0-9a-f]+$') or (regexp_matches(l, '^[a-z2-7]+$') and not regexp_matches(l[:12], '[aeiou]'))
        or (regexp_matches(l, '^[a-z0-9+/=_-]+$') and regexp_matches(l, '[a-z]') and length(regexp_replace(l, '[^aeiou]', '', 'g')) / length(regexp_replace(l, '[^a-z]', '', 'g')) < 0.15)))"""
    tests = ", ".join([
        _rule("long_subdomain", f"length(span) >= {_T['long_subdomain'][0]}", _T["long_subdomain"][1]),
        _rule("long_label", f"coalesce(list_max(list_transform(pieces, lambda x: length(x))), 0) >= {_T['long_label'][0]}", _T["long_label"][1]),
        _rule("high_subdomain_entropy", f"length(span) >= {_T['entropy_min_length']} and round(span_entropy, 3) >= {_T['entropy'][0]}", _T["entropy"][1]),
        _rule("many_labels", f"len(pieces) >= {_T['many_labels'][0]}", _T["many_labels"][1]), _rule("encoded_payload", f"len({encoded}) > 0", _T["encoded_payload"]),
    ])
    one, two, three = _T["confidence"]
    return f"""
    spanned as (select *, semantic and delegated_span <> '' and not chosen as wide, case when not semantic then '' when delegated_span <> '' and not chosen then controlled_span else coalesce(delegated_span, '') end as span from spans),
    pieced as (select *, list_filter(string_split(span, '.'), lambda x: x <> '') as pieces, replace(span, '.', '') as span_flat, {_entropy("replace(span, '.', '')")} as span_entropy from spanned),
    carried as (select *, list_filter([{tests}], lambda f: f is not null) as held from pieced),
    laden as (select *, case when len(held) > 0 and {asked} then list_append(held, {{'code': 'high_capacity_record', 'points': {_T["high_capacity_record"]}::double}}) else held end as signs from carried),
    tunnel as (
        select *, least(100, coalesce(list_sum(list_transform(signs, lambda f: f.points)), 0))::double as tunnel_score,
            (case len(signs) when 0 then 0 when 1 then {one} when 2 then {two} else {three} end)::double as tunnel_confidence, case when wide then 'controlled_span' else 'delegated_span' end as tunnel_key,
            array_to_string(list_transform(signs, lambda f: f.code), ',') as indicators
        from laden
    )"""


MODEL_SQL = f"""
    corpus as (select '^' || regexp_replace(w, '[^a-z0-9-]', '', 'g') || '$' as s from (values {_values([_text(w)] for w in dims.WORDS)}) t(w)),
    counts as (select s[i] as prev, s[i + 1] as next, count(*) as n from corpus, range(1, 64) r(i) where i < length(s) group by 1, 2),
    sums as (select prev, sum(n) as total from counts group by 1),
    grid as (
        select a.c || b.c as pair, ln((coalesce(n, 0) + 0.1) / (coalesce(total, 0) + 0.1 * 38)) as log_prob
        from (select unnest(string_split('^{training.ALPHABET}', '')) as c) a cross join (select unnest(string_split('{training.ALPHABET}$', '')) as c) b
        left join counts c on a.c = c.prev and b.c = c.next left join sums t on a.c = t.prev
    ), corpus_scores as (select rid, avg(log_prob) - ln(1 / 38) as x from (select row_number() over () as rid, s from corpus) c, range(1, 64) r(i) join grid on pair = s[i] || s[i + 1] where i < length(s) group by 1),
    model as (select avg(x) as mean, stddev_pop(x) as std from corpus_scores)
"""
DGA_SQL = f"""
    cleaned as (select raw, '^' || regexp_replace(coalesce(registrant_label, ''), '[^a-z-]', '', 'g') || '$' as s from spans),
    llr as (select raw, avg(log_prob) - ln(1 / 38) as llr from cleaned, range(1, 80) r(i) join grid on pair = s[i] || s[i + 1] where i < length(s) and length(s) > 2 group by 1),
    terms as (
        select w.*, length(regexp_replace(coalesce(registrant_label, ''), '[^a-z0-9-]', '', 'g')) as size, least({_D["z_high"]}, greatest({_D["z_low"]}, (mean - coalesce(llr, 0)) / std)) as z
        from weighed w left join llr on w.raw = llr.raw cross join model
    ), logits as (
        select *, {_D["bigram"]} * z * least(1, size / {_D["full_length"]}) as a, {_D["coverage"]} * ((1 - coverage) - {_D["coverage_mid"]}) as b, {_D["digits"]} * (digit_ratio - {_D["digits_mid"]}) as c from terms
    ), judged as (select *, case when shape then 1 / (1 + exp(-(a + b + c + {_D["bias"]}))) else 0 end as p from logits),
    dga as (
        select *, 100 * p as dga_score,
            (case when not shape or p < (case when size >= {_D["long"]} then {_D["moderate"]} else {_D["high"]} end) then 0 when size >= {_D["long"]} then {_D["confidence"][0]} when size >= {_D["short"]} then {_D["confidence"][1]} else {_D["confidence"][2]} end)::double as dga_confidence,
            case when not shape then 'DGA_NOT_APPLICABLE' when p >= {_D["high"]} then 'DGA_HIGH' when p >= {_D["moderate"]} then 'DGA_MODERATE' else 'DGA_LOW' end as dga_codes,
            case when shape then array_to_string(list_transform(list_filter(list_sort([{{'k': -a, 'i': 0, 'n': 'bigram_implausibility'}}, {{'k': -b, 'i': 1, 'n': 'no_dictionary_words'}}, {{'k': -c, 'i': 2, 'n': 'digit_density'}}]), lambda t: t.k < 0), lambda t: t.n), ',') else '' end as contributors
        from judged
    )
"""
_KNOWN = _values([[_text(i), _text(v), f"{c}::double", "0"] for i, v, _, c in dims.INDICATORS] + [[_text(d), "'TRUSTED'", "0.9::double", "1"] for d in dims.TRUSTED])
INTEL_SQL = f"""
    suffixes as (select raw, i - 1 as up, array_to_string(labels[i:], '.') as indicator from spans, range(1, 64) r(i) where i <= greatest(1, len(labels) - len(string_split(registrable, '.')) + 1)),
    known as (select * from (values {_KNOWN}) t(indicator, verdict, confidence, priority)),
    hit as (select s.raw, s.up, k.*, row_number() over (partition by s.raw order by up, priority) as nth from suffixes s join known k using (indicator)),
    ti as (
        select s.raw, coalesce(verdict, 'UNKNOWN') as verdict, (case verdict when 'MALICIOUS' then 95 when 'SUSPICIOUS' then 60 else 0 end)::double as ti_score,
            (case when verdict is null then 0 when verdict = 'TRUSTED' then case when up > 0 then 0.85 else 0.9 end when up > 0 then round(confidence * 0.9, 3) else confidence end)::double as ti_confidence
        from spans s left join (select * from hit where nth = 1) h on s.raw = h.raw
    )
"""
_W, _F = POLICY.get("weights"), POLICY.get("fusion")
_MOVE = f"abs({{to}} - {{x}}) >= {_F['least_move']}"


def _steps() -> tuple[str, str, list[str]]:
    """(CTEs of the steps, the last one's name, tests whether each moved the score)."""
    brand, tld = "list_contains(string_split(lexical_codes, ','), 'BRAND_IMPERSONATION')", "list_contains(string_split(lexical_codes, ','), 'SUSPICIOUS_TLD')"
    loud = f"(lc > 0 and lexical_score >= {_F['corroboration'][0]})", f"(dc > 0 and dga_score >= {_F['corroboration'][0]})", f"(tc > 0 and tunnel_score >= {_F['corroboration'][0]})", f"(ic > 0 and ti_score >= {_F['corroboration'][0]})"
    label = f"(({loud[0]} or {loud[1]}) and not ({loud[2]} and tunnel_key = 'controlled_span'))"
    scopes = f"{label}::int + {loud[2]}::int + {loud[3]}::int"
    several = f"lc > 0 and lexical_score >= {_F['single'][0]} and len(fired) >= {_F['single'][1]}"
    steps = [
        ("ti_malicious_floor", f"verdict = 'MALICIOUS' and ic >= {_F['ti_floor_confidence']}", f"greatest({{x}}, {_F['ti_floor']})"),
        ("brand_impersonation_floor", brand, f"greatest({{x}}, {_F['brand_floor']})"),
        ("corroboration_bonus", f"{scopes} >= 2", f"{{x}} + {_F['corroboration'][1]}"),
        ("tld_dga_bonus", f"{tld} and dga_score >= {100 * _F['tld_dga'][0]}", f"{{x}} + {_F['tld_dga'][1]}"),
        ("corroborated_floor", several, f"greatest({{x}}, {_F['single'][2]})"),
        ("ti_trusted_ceiling", "verdict = 'TRUSTED' and not aside", f"least({{x}}, {_F['trusted_ceiling']})"),
        ("clamp", "true", "greatest(0, least(100, {x}))"),
    ]
    ctes, moved = [], []
    for i, (name, test, to) in enumerate(steps):
        x = f"s{i}"
        step = to.format(x=x)
        ctes.append(f"step{i + 1} as (select *, (case when {test} and abs({step} - {x}) >= {_F['least_move']} then {step} else {x} end)::double as s{i + 1} from step{i})")
        if name != "clamp":
            moved.append(f"case when s{i + 1} <> s{i} then '{name}' end")
    return ", ".join(ctes), f"step{len(steps)}", [*moved, "case when aside then 'allowlist_set_aside' end"]


_CTES, _LAST, _MOVED = _steps()
_NAMED = "[case when dc * dga_score > 0 then 'dga' end, case when lc * lexical_score > 0 then 'lexical' end, case when tc * tunnel_score > 0 then 'tunnel' end]"
FUSION_SQL = f"""
    joined as (
        select l.raw, lexical_score, lexical_confidence as lc, lexical_codes, fired, dga_score, dga_confidence as dc, tunnel_score, tunnel_confidence as tc, tunnel_key, ti_score, ti_confidence, verdict,
            verdict = 'TRUSTED' and tunnel_confidence > 0 and tunnel_score >= {_F["set_aside"]} as aside
        from lexical l join dga d on l.raw = d.raw join tunnel t on l.raw = t.raw join ti i on l.raw = i.raw
    ), voted as (select *, case when aside then 0 else ti_confidence end as ic from joined),
    summed as (select *, {_W["ti"]} * ic + {_W["dga"]} * dc + {_W["lexical"]} * lc + {_W["tunnel"]} * tc as w from voted),
    step0 as (select *, case when w > 0 then ({_W["ti"]} * ic * ti_score + {_W["dga"]} * dc * dga_score + {_W["lexical"]} * lc * lexical_score + {_W["tunnel"]} * tc * tunnel_score) / w else 0 end as s0 from summed),
    {_CTES},
    final as (
        select *, round_even({_LAST.replace("step", "s")}, 0)::int as score, list_filter([case when ic * ti_score > 0 then 'threat_intel' end] || {_NAMED}, lambda x: x is not null) as who from {_LAST}
    ), decided as (
        select *, case when score < 30 then 'SAFE' when score < 70 then 'SUSPICIOUS' else 'MALICIOUS' end as classification, case when score < 30 then 'ALLOW' when score < 70 then 'MONITOR' else 'BLOCK' end as decision,
            case len(who) when 0 then '' when 1 then who[1] else array_to_string(who[:-2], ', ') || ' and ' || who[-1] end as named
        from final
    )
"""
_ADVICE = """
    case decision when 'BLOCK' then case when verdict = 'MALICIOUS' then 'Block: a listed malicious name. Isolate the hosts that asked for it and look for others of the same campaign.'
            else 'Block and raise an alert: no list knows this name yet, so it is a candidate for one.' end
        when 'MONITOR' then case when dga_score >= 50 then 'Allow and watch: the name looks generated. Compare how often and when it is asked for.'
            else 'Allow and watch: the evidence is mixed. Look again if it comes back or more hosts ask for it.' end
        else case when len(who) > 0 and verdict = 'TRUSTED' then 'Allow: a trusted name, though risk was reported by ' || named || '; look again if it comes back.'
            when len(who) > 0 then 'Allow: risk was reported by ' || named || ', but too little to act on.' when w = 0 then 'Allow: nothing is known about this name, which is no proof of safety.'
            when verdict = 'TRUSTED' then 'Allow: a trusted name.' else 'Allow: whatever could judge this name found no risk.' end end
"""
_PLAIN = "length(sld)::bigint as sld_length, len(ls)::bigint as label_count, subdomain_depth::bigint as subdomain_depth, coalesce(list_max(list_transform(ls, lambda x: length(x))), 0)::bigint as max_label_length, hyphens::bigint as hyphens, consonant_run::bigint as consonant_run"
ORACLE_SQL = {
    "name_kinds": f"""with {NAMES_SQL} select raw, kind, case when kind in ('IP_LITERAL') then null else case when any_suffix in ({_in(dims.PROVIDER_SUFFIXES)}) then 'provider' when any_suffix = 'arpa' then 'infrastructure'
        when any_suffix in ({_in(dims.LOCAL_SUFFIXES)}) then 'unregistered' when any_suffix in ({_in(dims.REGISTRY_SUFFIXES)}) then 'registry' else 'unknown' end end as suffix_kind,
        registrant_label, delegated_span, controlled_span, semantic_text, has_label and chosen as scope_is_registrant_chosen, kind = 'INFRASTRUCTURE' as is_reverse_dns,
        case when ends_with(raw, '.in-addr.arpa') and len(labels) = 6 then array_to_string(list_reverse(labels[1:4]), '.') end as reverse_target, case when is_ip then 4 end as ip_version,
        case when is_ip then regexp_matches(raw, '^(10|127)\\.|^192\\.168\\.') end as ip_is_private from spans""",
    "name_features": f"""with recursive {FEATURES_SQL} select raw, {_PLAIN}, {_run("flat", "0-9")}::bigint as digit_run,
        (select max(c) from (select count(*) as c from (select ch, i - row_number() over (partition by ch order by i) as g from (select unnest(string_split(flat, '')) as ch, generate_subscripts(string_split(flat, ''), 1) as i)) group by ch, g))::bigint as repeat_run,
        round(length(flat) / greatest(len(ls), 1), 6) as mean_label_length, round(digit_ratio, 6) as digit_ratio, round(hyphen_ratio, 6) as hyphen_ratio, round(vowel_ratio, 6) as vowel_ratio, round(consonant_ratio, 6) as consonant_ratio,
        round(alphas / n, 6) as letter_ratio, round(greatest(0, 1 - (alphas + digits + hyphens) / n), 6) as other_ratio, round(len(list_distinct(string_split(flat, ''))) / n, 6) as unique_ratio, round(entropy, 6) as entropy, round(sld_entropy, 6) as sld_entropy,
        round(normalized_entropy, 6) as normalized_entropy, round(coverage, 6) as coverage, round(tld_weight, 6) as tld_weight, round(keyword_weight, 6) as keyword_weight, array_to_string(list_sort(keywords), ',') as keywords from weighed""",
    "brand_matches": f"with recursive {FEATURES_SQL}, {BRANDS_SQL} select raw, brand, how from branded",
    "dictionary_coverage": f"with recursive {NAMES_SQL}, {COVERAGE_SQL} select raw, round(coverage, 6) as coverage from coverage",
    "lexical_scores": f"with recursive {FEATURES_SQL}, {BRANDS_SQL}, {LEXICAL_SQL} select raw, round(lexical_score, 6) as score, lexical_confidence as confidence, 'registrant_label' as scope_key, lexical_codes as codes from lexical",
    "tunnel_scores": f"with {NAMES_SQL}, {_tunnel_sql('true')} select raw, round(tunnel_score, 6) as score, tunnel_confidence as confidence, tunnel_key as scope_key, indicators from tunnel",
    "dga_scores": f"with recursive {FEATURES_SQL}, {MODEL_SQL}, {DGA_SQL} select raw, round(dga_score, 6) as score, dga_confidence as confidence, dga_codes as codes, contributors from dga",
    "assessed_hosts": f"""with recursive {FEATURES_SQL}, {BRANDS_SQL}, {LEXICAL_SQL}, {_tunnel_sql('false')}, {MODEL_SQL}, {DGA_SQL}, {INTEL_SQL}, {FUSION_SQL}
        select raw, score, round({_LAST.replace("step", "s")}, 6) as raw_score, classification, decision, round(greatest(ic, dc, lc, tc), 6) as confidence, round(w / {sum(_W.values())}, 6) as coverage,
            array_to_string(list_filter([{", ".join(_MOVED)}], lambda x: x is not null), ',') as overrides, {_ADVICE} as recommendation from decided""",
    "intel_statistics": f"""with i as (select * from (values {_values([_text(i), _text(v), _list(c)] for i, v, c, _ in dims.INDICATORS)}) t(indicator, verdict, categories))
        select 'verdict' as what, verdict as name, count(*) as n from i group by 2 union all select 'verdict', 'TRUSTED', {len(dims.TRUSTED)} union all
        select 'category', c, count(*) from (select unnest(categories) as c from i) group by 2""",
}
