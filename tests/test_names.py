import pytest

from tidewarden.functions.names import canonicalize, classify

#: Names around the borders of the grammar, made from its lengths: 63 for a label, 253 for a name, 2048 for the input.
LONG = ".".join(["n" * 49] * 5)  # 249
CASES = [
    ("\t<News.Shop.TEST.> ", "news.shop.test", None),
    ("ftp://anna:x@files.shop.co.uk:2121/a/b", "files.shop.co.uk", None),
    ("grün.shop.de", "grün.shop.de".encode("idna").decode(), None),
    ("[fe80::7]", "fe80::7", None),
    ("  ", None, "EMPTY_INPUT"),
    ("k" * 63 + ".net", "k" * 63 + ".net", None),
    ("k" * 64 + ".net", None, "LABEL_TOO_LONG"),
    (LONG + ".net", LONG + ".net", None),
    (LONG + ".nets", None, "DOMAIN_TOO_LONG"),
    ("k" * 2049, None, "INPUT_TOO_LARGE"),
    ("shop..net", None, "EMPTY_LABEL"),
    ("shop-.net", None, "INVALID_LABEL_FORMAT"),
    ("shop.404", None, "NUMERIC_TLD"),
]


def test_canonical_names(spark):
    rows = [(i, raw) for i, (raw, _, _) in enumerate(CASES)]
    got = {r.i: r for r in canonicalize(spark.createDataFrame(rows, "i int, raw string")).select("i", "name.domain", "name.error_code").collect()}
    for i, (raw, domain, error) in enumerate(CASES):
        assert (got[i].domain, got[i].error_code) == (domain, error), raw


@pytest.mark.parametrize(
    "raw, kind, label, delegated, controlled",
    [
        ("x.news.shop.co.uk", "REGISTRY_DOMAIN", "shop", "x.news", "x.news.shop"),
        ("v1.docs.github.io", "PROVIDER_HOST", "docs", "v1", "v1.docs"),
        ("nas.lan", "LOCAL_NAME", None, None, None),
        ("10.20.30.40", "IP_LITERAL", None, None, None),
    ],
)
def test_kinds(spark, raw, kind, label, delegated, controlled):
    r = classify(canonicalize(spark.createDataFrame([(raw,)], "raw string"))).select("cls.kind", "cls.scopes.*").first()
    assert (r.kind, r.registrant_label, r.delegated_span, r.controlled_span) == (kind, label, delegated, controlled)
