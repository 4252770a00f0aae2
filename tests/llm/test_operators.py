import random

import pytest
from pyspark.sql import functions as F

from tidewarden.llm import chat, decontaminate, langid, main_text, neardup, packing, tokens, topk, toxicity, url_rules


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


def test_lexicon_finds_terms_and_misspellings():
    lexicon = toxicity.Lexicon({"idiot$": 0.9, "vequ": 0.8}, frozenset(["idio"]))
    assert lexicon.weight("Idiot!") == 0.9 and lexicon.weight("vequation") == 0.8
    assert 0 < lexicon.weight("1diot") < 0.9 and 0 < lexicon.weight("i.d.i.o.t") < 0.9 and 0 < lexicon.weight("idioot") < 0.9
    assert lexicon.weight("idio") == 0 and lexicon.weight("patriot") == 0


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 8))) for _ in range(2))
        automaton = toxicity.Automaton(a, 2)
        state = automaton.start
        for c in b:
            state = automaton.step(state, c)
        d = distance(a, b)
        assert automaton.edits(state) == (d if d <= 2 else None)


def test_quotation_stays_below_the_bar():
    weights = toxicity.Weights(toxicity.Lexicon({"idiot$": 0.99}))
    assert toxicity.score("you idiot", weights, 0.0, 1.0) >= 0.5 > toxicity.score('she wrote "you idiot" there', weights, 0.0, 1.0)
    assert toxicity.score(None, weights, 0.1, 1.0) == toxicity.score("", weights, 0.1, 1.0) == 0.1


def test_main_text():
    page = "<body><nav><a href=x>menu item</a></nav><div class=ad>Buy now, a long advert.</div><article><h1>T</h1><p>One &amp; <b>tw</b>o.<p>Three<br>four</article><footer>f</footer>"
    assert main_text.main_text(page) == "T One & two. Three four"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<script>x</script>") == ""
    assert main_text.main_text("plain &lt; text") == "plain < text"


def test_leaks_against_substring_search(spark):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randint(16, 40)) + ".") for i in range(20)] + [(20, None), (21, "")]
    docs = [(i, words(rng, 200)) for i in range(60)]
    docs[5] = (5, docs[5][1] + " " + items[3][1] + " " + words(rng, 30))
    docs[9] = (9, items[7][1])
    docs += [(None, None), (61, ""), (9, items[7][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(5, 3), (9, 7)}
    assert decontaminate.leaks(d, b.limit(0)).count() == decontaminate.leaks(d.limit(0), b).count() == 0
    assert sorted(str(r.doc_id) for r in decontaminate.clean(d, b).collect()) == sorted(str(i) for i, _ in docs if i not in (5, 9))


def test_common_subsequence():
    assert decontaminate.common_words([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3


def test_fingerprints_link_as_brute_force_does(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps[:20]]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.component_id for r in neardup.attach(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")).collect()}
    assert got == {i: find(i) for i in range(len(fps))}


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(7)
    docs = [(i, words(rng, rng.randint(0, 60))) for i in range(80)] + [(80, None), (80, None), (None, "x")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.piece == 0 for r in rows) == len(docs)


def test_best_fit_plan():
    plan = packing.plan({3: 2, 2: 1, 1: 3}, 4)
    assert sum(n for _, _, n, _, _, _ in plan) == 6 and 1 + max(first + (n - 1) // each for _, _, n, first, each, _ in plan) == 3


def test_chat_round_trip(spark):
    text = "<|im_end|><|im_start|>assistant ok \\ n"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", None), (2, 0, None, "")]
    out = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.example): r for r in out}
    assert chat.parse(by[1, 1].formatted) == [("user", text), ("assistant", text), ("user", "")]
    r = by[1, 0]
    assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == text and by[1, 1].loss_start is None


def test_top_k_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(120)] + [(200, None), (201, [float("nan")] * 6), (202, [None] * 6)]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(v, v.where("vec_id % 20 = 0"), candidate_rows=50).collect()}
    good = [(i, [int(256 * c) for c in x]) for i, x in rows[:120]]
    for q, x in good[::20]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]


def test_languages(spark):
    rng = random.Random(11)
    vocabulary = {a: words(rng, 40, a).split() for a in ("abcdeklm", "fghijklm")}
    text = lambda a, n: " ".join(rng.choices(vocabulary[a], k=n))
    rows = [(text(a, 60), a) for a in vocabulary for _ in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, text("abcdeklm", 50)), (2, text("fghijklm", 50)), (3, None), (4, "123")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {1: "abcdeklm", 2: "fghijklm", 3: "und", 4: "und"}


def test_length_histogram(spark):
    docs = spark.createDataFrame([("a b",), ("a b",), (None,), ("a",)], "text string")
    h = tokens.length_histogram(docs)
    assert {r.n_tokens: r.n_docs for r in h.collect()} == {0: 1, 1: 1, 2: 2}
    got = {r.n_tokens: (r.docs_within, r.truncated_tokens) for r in tokens.context_limits(h).collect()}
    assert got == {0: (1, 0), 1: (2, 3), 2: (4, 5)}


@pytest.mark.parametrize("url, rule, verdict", [("http://WWW.example.org/en/12", "example.org/en/1", "block"), ("https://a.com/de/x", "com/de/", "block"), ("https://example.org", None, "allow"), (None, None, "allow"), ("x://notexample.org/es/", "org/", "allow")])
def test_url_rules(spark, url, rule, verdict):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")], "host string, path string, verdict string")
    r = url_rules.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), rules).first()
    assert (r.rule, r.verdict) == (rule, verdict)


def test_toxicity_of_labelled_texts(spark):
    rng = random.Random(13)
    rows = [(int(i % 4 == 0), words(rng, 40) + (" idiot" if i % 4 == 0 else "")) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "toxic int, text string"))
    docs = spark.createDataFrame([(1, "aa bb idiot"), (2, words(rng, 30)), (3, None), (None, "idi0t")], "doc_id long, text string").withColumn("score", F.lit("x"))
    assert {r.doc_id: r.predicted for r in toxicity.predict(docs, model).collect()} == {1: 1, 2: 0, 3: 0, None: 1}
    assert toxicity.fit(spark.createDataFrame([], "toxic int, text string"))
