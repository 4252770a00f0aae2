"""Small reference tables: own seed lists, made of public names and generic words. Each is far below a broadcast's bound."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A few public suffixes, special-use names (RFC 6761, 6762, 8375), and seeds of the lookup tables.
REGISTRY_SUFFIXES = "com net org info biz io co me tv us uk de fr es it nl eu ch se no xyz top click gq tk ru cn in au jp br co.uk org.uk ac.uk gov.uk com.au net.au co.jp co.in com.br co.nz".split()
PROVIDER_SUFFIXES = "github.io gitlab.io pages.dev workers.dev netlify.app vercel.app herokuapp.com cloudfront.net web.app firebaseapp.com azurewebsites.net blogspot.com".split()
REGISTRANT_SHAPED = "github.io gitlab.io pages.dev blogspot.com".split()
LOCAL_SUFFIXES = "local localhost lan internal home test invalid example onion".split()
TLD_WEIGHTS = {"tk": 1.0, "gq": 0.9, "top": 0.7, "xyz": 0.6, "click": 0.6, "info": 0.3, "biz": 0.3, "ru": 0.3, "cn": 0.2}
KEYWORDS = {"login": 0.8, "signin": 0.8, "verify": 0.9, "account": 0.7, "secure": 0.7, "update": 0.6, "password": 0.9, "bank": 0.7, "wallet": 0.8, "invoice": 0.6, "free": 0.3, "support": 0.4, "confirm": 0.7, "billing": 0.7, "webmail": 0.6}
BRANDS = {"paypal": ["paypal.com"], "google": ["google.com", "google.de"], "microsoft": ["microsoft.com"], "amazon": ["amazon.com", "amazon.de"], "apple": ["apple.com"], "facebook": ["facebook.com"], "netflix": ["netflix.com"], "instagram": ["instagram.com"], "linkedin": ["linkedin.com"], "github": ["github.com"]}
WORDS = (
    "account air app art bank best big blog blue book box car card case chat city clean click cloud club code cook data day deal design dream earth easy face farm fast file film fish "
    "food free game garden gift girl gold good green group guide hand health help home hotel house job kids land learn light line link list live love mail map mark market media money "
    "music name news night office online page paper park party photo place plan play point power press price print product radio real report road rock room school science search secure "
    "service share shop show site smart social software sport star stock store story stream street student studio style sun support system table team tech test time tour town trade "
    "train travel tree video view voice water wave web week win wine wood word work world write year young example login update mobile network"
).split()
INDICATORS = [
    ("malware-drop.example.net", "MALICIOUS", ["malware"], 0.95),
    ("example.org", "SUSPICIOUS", ["spam"], 0.6),
    ("evil-phish.test.com", "MALICIOUS", ["phishing"], 0.9),
    ("blog.example.com", "SUSPICIOUS", ["scraping"], 0.5),
]
TRUSTED = ["example.com", "google.com", "github.com"]


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, "indicator string, verdict string, categories array<string>, confidence double")


def trusted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in TRUSTED], "domain string")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of text files: white-space separated, lines that begin with # skipped."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).where("word <> ''").distinct()


def inflected(words: Iterable[str]) -> set[str]:
    """The words, with plain inflections, doubled consonants, dropped e, and one vowel left out of longer words."""
    endings, out = ("ing", "ers", "ed", "es", "er", "ly", "s"), set(words)
    for w in list(out):
        stems = {w, w + w[-1]} | ({w[:-1]} if w.endswith("e") and len(w) >= 4 else set())
        out |= {s + e for s in stems for e in endings}
        if len(w) >= 6:
            out |= {w[:i] + w[i + 1 :] for i, c in enumerate(w) if c in "aeiou"}
    return out
