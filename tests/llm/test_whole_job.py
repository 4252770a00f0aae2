"""Inputs on which an operator could do less than the whole job: hot items, wrapped pages, long texts, words without spaces."""

import random

import pytest

from tidewarden.llm import decontaminate, langid, main_text, toxicity


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


def test_item_in_many_documents_is_found_in_each(spark):
    rng = random.Random(17)
    items = [(i, words(rng, 40) + ".") for i in range(4)]
    docs = [(i, words(rng, 80)) for i in range(200)]
    held = {(i, 0) for i in range(80)} | {(i, 1) for i in range(70, 200)} | {(150, 2)}
    for i, k in sorted(held):
        docs[i] = (i, docs[i][1] + " " + items[k][1] + " " + words(rng, 20))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == held


def test_wrapper_classes_keep_the_article():
    story = "".join(f"<p>Sentence {i} of the story, long enough to count as text.</p>" for i in range(8))
    plain = " ".join(f"Sentence {i} of the story, long enough to count as text." for i in range(8))
    side = "<div class=sidebar><a href=x>one</a> <a href=y>two</a></div>"
    for name in ("content has-sidebar", "no-comments", "share menu"):
        assert main_text.main_text(f"<body><div class='{name}'>{side}<article>{story}</article></div></body>") == plain
        assert main_text.main_text(f"<body><div class='{name}'>{side}<div>{story}</div></div></body>") == plain
    assert main_text.main_text(f"<body><div><div>{story}</div><div class=notice>Please accept this notice about cookies.</div></div></body>") == plain


def test_density_chooses_inside_main():
    story = "".join(f"<p>Sentence {i} of the story, long enough to count as text.</p>" for i in range(8))
    links = "".join(f"<li><a href=x{i}>other page {i}</a></li>" for i in range(12))
    got = main_text.main_text(f"<body><main><div><ul>{links}</ul></div><div>{story}</div></main></body>")
    assert "Sentence 0" in got and "Sentence 7" in got and "other page" not in got


def test_language_margin_holds_at_any_length(monkeypatch):
    costs = {"a": 5000, "b": 5010}
    monkeypatch.setattr(langid, "_compressors", lambda model: [(k, lambda _, n=n: b"x" * n) for k, n in costs.items()])
    assert langid.identify("some text", (("a", b""),))[2]
    costs["b"] = 5030
    assert langid.identify("some text", (("a", b""),)) == ("a", pytest.approx(1, abs=1e-3), False)


def test_terms_inside_tokens():
    lexicon = toxicity.Lexicon({"idiot$": 0.9, "fool$": 0.8, "vequ": 0.8, "白痴$": 0.9}, frozenset(["idio"]))
    for token in ("you,idiot,you", "well...idiot", "l'idiot", "you-idioot", "idiot/" + "x" * 80, "x" * 40 + "/" + "y" * 40 + "/idiot", "z" * 70 + "idiot" + "z" * 9, "你这个白痴很"):
        assert toxicity.Weights(lexicon)[token] > 0.7, token
    assert lexicon.weight("fool/idiot") == pytest.approx(0.98) and 0 < lexicon.weight("i.d.i.o.t") < 0.9
    assert lexicon.weight("idio/patriot") == lexicon.weight("a/b/c") == toxicity.Weights(lexicon)["x" * 500] == 0


def test_terms_between_marks_are_learned(spark):
    rng = random.Random(19)
    for term in ("idiot", "白痴"):
        rows = [(int(i % 4 == 0), words(rng, 40) + (f" x{words(rng, 1)},{term},{words(rng, 1)}" if i % 4 == 0 else "")) for i in range(400)]
        model = toxicity.fit(spark.createDataFrame(rows, "toxic int, text string"))
        docs = spark.createDataFrame([(1, f"aa {term}"), (2, words(rng, 30))], "doc_id long, text string")
        assert {r.doc_id: r.predicted for r in toxicity.predict(docs, model).collect()} == {1: 1, 2: 0}


def test_a_dollar_sign_within_a_term(spark):
    for term in ("idiot$x$", "idiot$xyz"):  # its other words are found as ever
        lexicon = toxicity.Lexicon({term: 0.9, "moron$": 0.9})
        assert lexicon.near("idiot") is None
        assert lexicon.weight("youmorons") == 0.9 and lexicon.weight("youidiots") == 0 and lexicon.near("moran") == (1, "moron$")
    rng = random.Random(23)
    rows = [(int(i % 4 == 0), words(rng, 40) + (" idiot$cash idiot" if i % 4 == 0 else " idiox" if i % 9 == 1 else "")) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "toxic int, text string"))
    docs = spark.createDataFrame([(1, "aa idiot$cash"), (2, words(rng, 30)), (3, "aa youidiots")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.predict(docs, model).collect()} == {1: 1, 2: 0, 3: 1}


def test_terms_inside_words_count_alike_at_every_length():
    lexicon = toxicity.Lexicon({"idiot$": 0.9, "fool$": 0.8, "vequ": 0.8}, frozenset(["patriotidiotic", "x" * 70 + "idiotic"]))
    for n in (3, 20, 58, 59, 60, 64, 70, 500):
        assert lexicon.weight("x" * n + "idiot") == lexicon.weight("x" * n + "idiot" + "y" * n) == 0.9
        assert lexicon.weight("x" * n + "fool") == 0  # too short a term to be told from a syllable
    assert lexicon.weight("patriotidiotic") == lexicon.weight("x" * 70 + "idiotic") == 0  # clean texts use them


def test_an_inch_mark_closes_no_quotation():
    words = ['"stray', *["plain"] * 1000, "you", "idiot", *["plain"] * 20, '5"', "wide"]
    assert not any(toxicity.quoted_words(words))
    assert toxicity.quoted_words(['"you', 'idiot"', "x"]) == [True, True, False] and toxicity.quoted_words(['"a', '5"', 'b"']) == [True, True, True]
