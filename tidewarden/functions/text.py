"""String measures in built-in functions: entropy, ratios, runs, tokens. They stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty string."""
    n = F.length(s)
    return -F.aggregate(
        F.array_distinct(F.split(s, "")),
        F.lit(0.0),
        lambda total, c: total + F.when(c == "", 0.0).otherwise(_plogp((n - F.length(F.replace(s, c, F.lit("")))) / F.greatest(n, F.lit(1)))),
    ) + F.lit(0.0)


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def normalized_entropy(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 1, entropy(s) / F.log2(n)).otherwise(0.0)


def count_of(s: Column, characters: str) -> Column:
    """Characters of a class, written as the inside of a bracket expression."""
    return F.length(F.regexp_replace(s, f"[^{characters}]", ""))


def ratio_of(s: Column, characters: str) -> Column:
    return count_of(s, characters) / F.greatest(F.length(s), F.lit(1))


def max_run(s: Column, characters: str) -> Column:
    runs = F.regexp_extract_all(s, F.lit(f"([{characters}]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def max_repeat(s: Column) -> Column:
    """Longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, "[^a-z0-9]+"), lambda t: t != "")


def minimal_matches(s: Column, words: list[str]) -> Column:
    """Words contained in the string, less those contained in another match."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))
    return F.filter(found, lambda w: ~F.exists(found, lambda o: (o != w) & F.contains(o, w)))


def encoding_alphabet(label: Column) -> Column:
    """hex, base32 or base64ish if a label of at least eight characters looks encoded, else null."""
    letters = count_of(label, "a-z")
    rare = (letters > 0) & (count_of(label, VOWELS) / F.greatest(letters, F.lit(1)) < 0.15)
    return F.when(F.length(label) >= 8, (
        F.when(label.rlike("^[0-9a-f]+$"), "hex")
        .when(label.rlike("^[a-z2-7]+$") & ~F.substring(label, 1, 12).rlike(f"[{VOWELS}]"), "base32")
        .when(label.rlike("^[a-z0-9+/=_-]+$") & rare, "base64ish")
    ))


def bound(x: Column) -> Column:
    """The same value, evaluated once: as the optimiser can't know that the condition holds for every row, it copies no part
    of the value into the expressions that use it."""
    return F.when(F.monotonically_increasing_id() >= 0, x)
