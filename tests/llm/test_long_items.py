"""Benchmark items of any length: parts by words, and both ways to look up which words a passage has."""

import random

import pytest

from tidewarden.llm import decontaminate


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 8))) for _ in range(n))


@pytest.mark.parametrize("table", [0, 1 << 26])
def test_long_and_short_items(spark, monkeypatch, table):
    monkeypatch.setattr(decontaminate, "TABLE", table)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 2000)
    rng = random.Random(41)
    items = [(i, words(rng, n)) for i, n in enumerate([40, 3000, 25, 2500, 60, 1])] + [(9, None), (10, "")]
    docs = [(i, words(rng, 120)) for i in range(60)]
    held = {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0), (5, 4)}
    for d, k in sorted(held):
        docs[d] = (d, f"{docs[d][1]} {items[k][1]} {words(rng, 30)}")
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.lcs for r in found.collect()}
    assert held <= set(got) and {k for _, k in set(got) - held} <= {5}  # an item of one word may be anywhere
    assert all(got[p] == 1 for p in held)
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:5], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {d for d, _ in held}


def test_parts_are_cut_by_words(spark):
    rng = random.Random(42)
    items = spark.createDataFrame([(i, words(rng, 12_000)) for i in range(20)], "item_id long, text string")
    groups = list(decontaminate._rounds(items, "item_id", "text", 500)[1])
    sizes = [sum(map(len, p.words)) for g in groups for p in g]
    assert sum(sizes) == 240_000 and max(sizes) < 90_000
