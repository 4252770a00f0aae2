"""Operators against plain loops over the same rows."""

import itertools
import random
import time
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tidewarden.llm import chat, decontaminate, langid, main_text, neardup, packing, tokens, topk, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return lambda text: Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids


def test_chunk_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng, tokenizer, ids = random.Random(21), Tokenizer.from_file(WORD_BPE), tokens.ChunkIds(WORD_BPE)
    pool = list("abzXYZ İıſKåÉßẞǰJTHWY.,;:!?'’0129²½ªµ×÷ \u0085­̱̌̇́ \n\t\x0b\x1cΣς漢がไ👍‍<|>_-#") + ["'s", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "the ", "İ."]
    for i in range(20_000):
        text = "".join(rng.choices(pool, k=rng.randint(1, 12)) if i % 2 else (chr(rng.choice((rng.randint(33, 126), rng.randint(161, 591), rng.randint(32, 0x2FFF)))) for _ in range(rng.randint(1, 8))))
        assert ids.ids(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_lengths_and_limits(spark, whole):
    rng = random.Random(22)
    texts = [words(rng, rng.randint(0, 40)) for _ in range(120)] + [None, "", "x" * 5000, "same", "same"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    sizes = [len(whole(t)) for t in texts]
    got = {r.n_tokens: r for r in tokens.context_limits(tokens.length_histogram(docs)).collect()}
    assert set(got) == set(sizes)
    for limit, r in got.items():
        within = [n for n in sizes if n <= limit]
        assert (r.docs_within, r.tokens_within, r.docs_over, r.tokens_over) == (len(within), sum(within), len(sizes) - len(within), sum(sizes) - sum(within))
        assert r.truncated_tokens == sum(min(n, limit) for n in sizes) and r.quantile == pytest.approx(len(within) / len(sizes))
    assert tokens.context_limits(tokens.length_histogram(docs.limit(0))).count() == 0


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_packed_pieces_and_plan(spark, whole):
    rng = random.Random(23)
    docs = [(i, words(rng, rng.randint(0, 90))) for i in range(150)] + [(None, "x y"), (None, "x y"), (7, "again"), (200, None)]
    rows = packing.pack(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, length int"), capacity=64).collect()
    want = []
    for doc_id, text in docs:
        ids = [*whole(text), 1]
        want += [(doc_id, n, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    assert len({r.sequence_id for r in rows}) == best_fit([w[3] for w in want], 64)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 60))]
        plan = packing.plan({n: lengths.count(n) for n in lengths}, 20)
        assert max(first + (n - 1) // each for _, _, n, first, each, _ in plan) + 1 == best_fit(lengths, 20)


def simhash(text):
    parts = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(24)
    for text in [None, "", " \n", "One", "two WORDS", "É à b c\x0bd", "a b c a b c a b c", *(words(rng, rng.randint(1, 60), "abÄé") for _ in range(60))]:
        assert neardup.simhash(text) & (1 << 64) - 1 == simhash(text)


@pytest.mark.parametrize("code", range(3))
def test_linked_words_share_an_anchor(code):
    rng = np.random.default_rng(25)
    a = rng.integers(-(1 << 63), 1 << 63, 60)
    for flips in range(3):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, flips, replace=False):
                b[i] ^= np.int64(np.uint64(1) << np.uint64(bit))
        pa, wa = neardup.anchors(a, neardup.CODES[code][1])
        pb, wb = neardup.anchors(b, neardup.CODES[code][1])
        assert all(set(wa[pa == i]) & set(wb[pb == i]) for i in range(len(a)))


def components(fps):
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_crowded_anchors_lose_no_link(spark):
    rng = random.Random(26)
    base = rng.getrandbits(63)
    fps = sorted({base ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 3))) for _ in range(40)} | {rng.getrandbits(63) for _ in range(20)})
    edges = neardup.links(spark.createDataFrame([(f,) for f in fps], "fp long"), group=2)
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert [got.get(f, f) for f in fps] == [fps[r] for r in components(fps)]


def test_one_row_of_each_component(spark):
    near = words(random.Random(27), 400)
    rows = [(3, "a b c d", 1), (5, "a b c d", 2), (5, "q r s", 3), (5, "q r s", 4), (9, "q r s", 5), (None, "n n n", 6), (None, "n n n", 7), (None, "a b c d", 8), (7, None, 9), (8, "", 10), (20, near, 11), (21, near, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key0 int")
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(3, "a b c d"), (5, "q r s"), (None, "n n n"), (7, None), (20, near)], key=str)
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_near_terms_against_all_terms():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(28)
    terms = {"".join(rng.choices("abc", k=rng.randint(5, 11))) + "$": 0.9 for _ in range(12)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(400):
        word = "".join(rng.choices("abc", k=rng.randint(4, 12)))
        within = [(d, t) for t in terms if (d := distance(word, t[:-1])) <= lexicon.edits[t]]
        assert lexicon.near(word) == min(within, default=None)
        assert not within or lexicon.any_part(word)


def test_quotations_of_any_length():
    weights = toxicity.Weights(toxicity.Lexicon({"idiot$": 0.99}))
    long = "she wrote \"" + "word " * 300 + "idiot" + " word" * 300 + "\" there"
    assert toxicity.score(long, weights, 0.0, 1.0) < 0.5 <= toxicity.score(long.replace('"', ""), weights, 0.0, 1.0)
    assert toxicity.score('a "stray mark, you idiot and "a quotation"', weights, 0.0, 1.0) >= 0.5


def test_chat_ids_of_any_type(spark):
    rows = [("b", 0, "user", "q"), ("b", 1, "assistant", "a"), (None, 0, "assistant", "x"), (None, 0, "user", "y"), ("a", 5, "assistant", None)]
    out = chat.digests(chat.expand(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in out) == [("None", 1, 0), ("None", 1, 1), ("a", 1, 0), ("b", 2, 1)]
    assert chat.digests(chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_top_k_for_any_block_size(spark, block):
    rng = random.Random(29)
    rows = [(i // 2 if i < 20 else i, [rng.randint(-4, 4) for _ in range(rng.choice((5, 6)))]) for i in range(150)] + [(500, [])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(v, v.where("vec_id % 5 = 0"), k=5, candidate_rows=block).collect()}
    want = {}
    for q in {i for i, _ in rows if i % 5 == 0}:
        pairs = [(-sum(a * b for a, b in zip(x, y, strict=False)), j) for i, x in rows if i == q for j, y in rows if j != q]
        want |= {(q, n + 1): (j, -s) for n, (s, j) in enumerate(sorted(pairs)[:5])}
    assert got == want


def test_reading_stops_early():
    rng = np.random.default_rng(30)
    x = np.floor(rng.standard_normal((3000, 32)) * np.exp(-np.arange(32) / 4) * 300).astype(np.int64)
    lists = topk.Lists(np.arange(3000), x)
    lists.top(x[:50], 5, np.arange(50))
    assert lists.entries_read < 0.6 * 50 * x.size


def test_main_text_is_no_body_and_linear():
    story = "".join(f"<p>Sentence {i} of the story, long enough to count as text.</p>" for i in range(8))
    plain = " ".join(f"Sentence {i} of the story, long enough to count as text." for i in range(8))
    links = "<div>" + "".join(f"<a href=x>other page {i}</a> " for i in range(30)) + "</div>"
    assert main_text.main_text(f"<body>{links}<div>{story}</div>{links}</body>") == plain
    assert "kept" in main_text.main_text(f"<body><article>{story}<p class='promoted-idea'>This is kept.</p></article></body>")
    assert main_text.main_text(f"<body><div class=ad>{'Buy this now. ' * 90}</div><article>{story}</article></body>") == plain
    began = time.time()
    for page in ("<a" * 500_000, "<a \"'>" * 100_000, "<script>" + "</script x" * 100_000, "<!" * 400_000, "<div>" * 50_000 + "<li></li>" * 50_000):
        main_text.main_text(page)
    assert time.time() - began < 30


def test_paraphrases_and_parts(spark):
    rng = random.Random(31)
    vocabulary = words(rng, 500).split()
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(rng.randint(25, 50)) + ".") for i in range(30)]
    docs = [(i, prose(150)) for i in range(120)]
    for i, share in enumerate((0, 10, 15, 20)):
        for k in range(30):
            kept = [w for w in items[k][1].split() if rng.random() >= share / 100]
            docs.append((1000 * (i + 1) + k, f"{prose(60)} {' '.join(kept)} {prose(60)}"))
    d, b = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, _leak_id int"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert not [x for x in found if x[0] < 1000]
    assert all(sum((1000 * (i + 1) + k, k) in found for k in range(30)) >= 27 for i in range(4))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, part_items=7).collect()} >= {(1000 + k, k) for k in range(30)}
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in found}


def test_language_sample_is_whole_texts(spark):
    rng = random.Random(32)
    rows = [(words(rng, 300), "a") for _ in range(40)] + [("copied text", "b")] * 5000 + [("rare", "c"), ("x" * 200_000, "c"), (None, "d"), ("e", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model) == {"a", "b", "c"} and model["b"] == b"copied text" and model["c"] == b"rare"
    assert set(model["a"].decode().split("\n")) <= {t for t, _ in rows[:40]} and len(model["a"]) <= langid.DICTIONARY_BYTES
    assert langid.fit(spark.createDataFrame([], "text string, lang string")) == {}
