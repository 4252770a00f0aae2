"""Words are hashed alike wherever they stand, and windows are settled by few of their words, with what all of them would give."""

import re

import numpy as np

from tidewarden.llm import decontaminate


def plain_hash(word: bytes) -> int:
    return sum(int(decontaminate._BYTE[b]) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)


def test_words_are_hashed_alike_wherever_they_stand():
    long = "x" * (decontaminate.PIECE + 5)
    texts = ["", None, "A b, c-d", "...", "Ünïcode wörds 12ab", f"{long} a {long}", "end", "a\nb", "ΣΑΣ", "x " * 40_000 + "b", " ", "b"]
    words = sorted({w for t in texts for w in re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").lower().encode()) if len(w) < 100})
    known = decontaminate.Vocabulary(np.unique(np.array([plain_hash(w) for w in words[::2]], np.uint64)))
    for text in texts:
        found = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
        got = decontaminate.word_hashes(text).tolist()
        assert len(got) == len(found) and all(plain_hash(w) == h for w, h in zip(found, got, strict=True) if len(w) < 100)
    assert len(set(decontaminate.word_hashes(texts[5]).tolist())) == 2
    coded = list(decontaminate._coded(texts, known))
    assert [x.tolist() for x in coded] == [known.ids(decontaminate.word_hashes(x)).tolist() for x in texts]
    assert list(decontaminate._coded([], known)) == []


def test_most_windows_are_settled_by_their_heaviest_words(monkeypatch):
    rng = np.random.default_rng(29)
    names = [f"w{i}" for i in range(300)]
    often = 1 / np.arange(1, 301)
    drawn = lambda n: [names[i] for i in rng.choice(300, n, p=often / often.sum())]
    items = [(i, " ".join(drawn(30))) for i in range(60)]
    texts = [" ".join(drawn(200) + (items[i][1].split() if i % 3 == 0 else []) + drawn(20)) for i in range(60)]
    part = decontaminate.Items(items)
    coded = list(decontaminate._coded(texts, part.vocabulary))
    seen = np.bincount(np.concatenate([np.unique(x) for x in coded]), minlength=part.vocabulary.size + 1)
    part.join(part.vocabulary, seen, len(texts))
    part.place(np.linalg.qr(rng.standard_normal((len(part.idf), 32)))[0], 0.05)
    looked_up = []
    holds = part.holds
    monkeypatch.setattr(part, "holds", lambda pairs: (looked_up.append(pairs.shape), holds(pairs))[1])
    _, words, first = decontaminate._joined(list(enumerate(coded)))
    found = part.find(words, first)
    pairs = sum(n for n, width in looked_up if width == looked_up[0][1])
    assert pairs > 1000 and sum(n * width for n, width in looked_up) < 0.5 * pairs * decontaminate.PASSAGE
    assert {(doc, item) for doc, item, *_ in found} >= {(i, i) for i in range(0, 60, 3)}
    monkeypatch.setattr(decontaminate, "HEAVIEST", decontaminate.PASSAGE)  # every word at once
    assert part.find(words, first) == found
    sets = [set(x.tolist()) for x in part.sets]
    at, end, of = decontaminate._windows(first, decontaminate.STEP)
    near = decontaminate._unit(decontaminate._sums(words, first, at, end, of, part.table)) @ part.vectors.T
    plain = set()
    for w, p in zip(*np.nonzero(near >= part.bars), strict=True):
        here = words[at[w] : end[w]].tolist()
        if sum(part.idf[x] for x in here if x in sets[p]) >= part.least[p]:
            share, answer = part.check(int(part.of[p]), words[first[of[w]] : first[of[w] + 1]], int(at[w] - first[of[w]]))
            if share >= part.lcs or share >= part.lcs_with_answer and answer >= part.answer:
                plain.add((int(of[w]), part.ids[part.of[p]]))
    assert plain == {(doc, item) for doc, item, *_ in found}
