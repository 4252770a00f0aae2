"""Rules and words from files, small and large, against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from tidewarden import dims
from tidewarden.functions import features, lexicon
from tidewarden.functions.names import canonicalize, classify
from tidewarden.plans import analysis
from tidewarden.sources import suffix_rules

RULES = """
// a comment
// ===BEGIN ICANN DOMAINS===
com
sg
com.sg
jp
*.kawasaki.jp
!city.kawasaki.jp
kobe.jp   trailing words
münchen.example
.led.example
a.*.example
two words stay one

// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
PAGES.dev
*.compute.example
com.sg
"""


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "list.dat"
    path.write_text(RULES)
    return suffix_rules.read_suffix_rules(spark, str(path)), str(path)


CASES = {
    "com.sg": ("com.sg", "registry"), "a.com.sg": ("com.sg", "registry"), "www.shop.kawasaki.jp": ("shop.kawasaki.jp", "registry"), "kawasaki.jp": ("jp", "registry"),
    "www.city.kawasaki.jp": ("kawasaki.jp", "registry"), "x.kobe.jp": ("kobe.jp", "registry"), "x.xn--mnchen-3ya.example": ("xn--mnchen-3ya.example", "registry"), "a.led.example": ("led.example", "registry"),
    "site.pages.dev": ("pages.dev", "provider"), "h.eu.compute.example": ("eu.compute.example", "provider"), "compute.example": ("example", None), "com": ("com", "registry"), "nowhere": ("nowhere", None),
    "x.two": ("two", "registry"),
}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_suffix_rules(spark, rules, monkeypatch, bound):
    monkeypatch.setattr(suffix_rules, "BROADCAST_RULES", bound)
    df = spark.createDataFrame([(d, d.split(".")) for d in CASES] * 2 + [(None, None), ("", [])], "d string, labels array<string>")
    out = suffix_rules.matched(df, rules[0])
    assert out.columns == ["d", "labels", "suffix"]
    got = out.collect()
    assert len(got) == 2 * len(CASES) + 2
    for r in got:
        if not r.d:
            assert r.suffix is None
        else:
            assert (r.suffix.public_suffix, r.suffix.section) == CASES[r.d], r.d


def test_lines_that_are_no_rule(spark, rules, tmp_path):
    assert {r.text for r in suffix_rules.rejected_rules(spark, rules[1]).collect()} == {"a.*.example"}
    (tmp_path / "none.dat").write_text("// nothing\n")
    none = suffix_rules.read_suffix_rules(spark, str(tmp_path / "none.dat"))
    one = spark.createDataFrame([(["a", "b"],)], "labels array<string>")
    assert suffix_rules.matched(one, none).first().suffix.public_suffix == "b"


def test_names_by_rules_from_a_file(spark, rules):
    raw = ["https://WWW.Shop.Kawasaki.jp/x", "site.pages.dev", "127.0.0.1", "bad..name", None, "münchen.example", "a.com.sg"]
    out = classify(canonicalize(spark.createDataFrame([(r,) for r in raw], "raw string"), "raw", rules[0]))
    got = {r.raw: (r.reg, r.kind, r.suffix_kind, r.error) for r in out.select("raw", F.col("name.registrable_domain").alias("reg"), "cls.kind", "cls.suffix_kind", F.col("name.error_code").alias("error")).collect()}
    assert got[raw[0]] == ("www.shop.kawasaki.jp", "REGISTRY_DOMAIN", "registry", None)
    assert got["site.pages.dev"] == ("site.pages.dev", "PROVIDER_HOST", "provider", None)
    assert got["127.0.0.1"][:2] == ("127.0.0.1", "IP_LITERAL") and got["bad..name"][3] == "EMPTY_LABEL" and got[None][3] == "EMPTY_INPUT"
    assert got["a.com.sg"][0] == "a.com.sg" and got["münchen.example"][0] == "xn--mnchen-3ya.example"


def test_inflections_equal_the_plain_ones(spark):
    words = spark.createDataFrame([(w,) for w in dims.WORDS[:60] + ["a", ""]], "word string")
    assert {r.word for r in lexicon.inflections(words).collect()} == {w for w in dims.inflected([*dims.WORDS[:60], "a"])}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_coverage_equals_the_plain_one(spark, monkeypatch, bound):
    monkeypatch.setattr(lexicon, "BROADCAST_WORDS", bound)
    rng = random.Random(6)
    labels = [None, "", "1-2", "ab", "x" * 63] + ["".join(rng.choice([*dims.WORDS, "q", "zz", "-", "7"]) for _ in range(rng.randint(1, 5)))[:63] for _ in range(80)]
    words = lexicon.inflections(spark.createDataFrame([(w,) for w in dims.WORDS], "word string"))
    out = lexicon.coverage(spark.createDataFrame([(x, "kept") for x in labels * 2], "label string, word string"), words, "label").collect()
    assert len(out) == 2 * len(labels)
    assert all(r.coverage == pytest.approx(features.coverage_of(r.label)) and r.word == "kept" for r in out)


def test_analysis_with_lists_of_its_own(spark, rules):
    """With rules and words of its own a name is judged by them; with those of the package as files, as without."""
    raw = spark.createDataFrame([("kawasaki.jp",), ("mail.example.com",), ("qzxkvbnmwr.com",)], "raw string")
    words = lexicon.inflections(spark.createDataFrame([(w,) for w in dims.WORDS], "word string"))
    listed = suffix_rules.listed(spark, dims.REGISTRY_SUFFIXES, dims.PROVIDER_SUFFIXES)
    plain = {r.raw: r.assessment.asDict() for r in analysis.analyze(raw).collect()}
    same = {r.raw: r.assessment.asDict() for r in analysis.analyze(raw, suffixes=listed, lexicon=words).collect()}
    assert {k: (v["score"], v["decision"]) for k, v in plain.items()} == {k: (v["score"], v["decision"]) for k, v in same.items()}
    more = words.unionByName(spark.createDataFrame([("kawasaki",)], "word string"))
    known = {r.raw: r for r in analysis.features(raw, suffixes=rules[0], lexicon=more).collect()}
    assert known["kawasaki.jp"].feat.coverage == 1.0
