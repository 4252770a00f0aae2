"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, with context windows around each hit.

The lexicon holds whole words (``idiot$``) and stems whose continuations are toxic too. A word of a text that isn't in it
is looked up by its Levenshtein automaton (bit-parallel states) walked down the trie, so misspelled terms are found
without listing their variants; words that clean training texts use are no misspellings. Hits close to each other form a
window: plain use adds up, while a window that holds its terms in quotation marks only stays below the decision.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle

#: Bound of the fit's sample: rows of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000
#: A term is at least so many times more frequent in toxic texts; terms that chance may add, over all grams.
LEAST_ODDS, CHANCE = 20.0, 1.0
#: Least share of the toxic texts that a term is found in, and least number.
SUPPORT, LEAST_TEXTS = 0.01, 4
#: Clean words near a term beyond which its neighbourhood is too dense for misspellings; clean texts wrongly caught that
#: outweigh a toxic text missed.
NEIGHBOURS, WORTH = 1, 4
STEM = range(4, 8)
#: Rows that a task hands on at once.
BATCH = 20_000
#: Words between hits of one window; score of a window that only quotes.
WINDOW, QUOTED = 12, 0.4
#: Share of a term's weight left for each edit.
PER_EDIT = 0.9
#: Words whose verdict a worker remembers.
CACHE_ENTRIES = 400_000
OPENING, CLOSING = "\"“«„‹‟", "\"”»“›"
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W_]+")
#: Scripts written without spaces (Thai to Lao, Burmese, Khmer, kana and Han); their words are runs of 2 to 4 characters.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]{2,}")
RUNS = range(2, 5)
#: Letters of a term from which on it counts inside another word, of any length, that clean texts don't use.
INSIDE = 5
#: Letters beyond which a token isn't remembered; it is read like any other.
REMEMBERED = 64


def core(token: str) -> str:
    """The word without marks around it, in lower case."""
    return _CORE.sub("", token).lower()


def parts(word: str) -> list[str]:
    """The words between the marks in a word; the word itself without any."""
    return [x for x in _INSIDE.split(word) if len(x) > 2] if _INSIDE.search(word) else [word]


def runs(word: str) -> set[str]:
    """Runs of characters that may be words of a script without spaces."""
    return {x[i : i + n] for x in _UNSPACED.findall(word) for n in RUNS for i in range(len(x) - n + 1)}


def edits_allowed(term: str) -> int:
    """None for stems and short words, else one, and two from nine letters on."""
    n = len(term) - 1
    return 0 if not term.endswith("$") or n < 5 else 1 if n < 9 else 2


def evidence(weight: float) -> float:
    """Evidence of a weight: independent ones add up."""
    return -math.log(max(1e-9, 1 - weight))


class Automaton:
    """Accepts the strings within ``most`` edits of ``word``. A state is one bit set of word positions per edit count."""

    def __init__(self, word: str, most: int):
        self.n, self.most, self.masks = len(word), most, defaultdict(int)
        for i, c in enumerate(word):
            self.masks[c] |= 1 << i
        self.start = tuple((1 << (e + 1)) - 1 for e in range(most + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        mask, full, out, below = self.masks.get(c, 0), (1 << (self.n + 1)) - 1, [], 0
        for e, bits in enumerate(state):
            new = (bits & mask) << 1
            if e:  # insertion, substitution, deletion
                new |= below | below << 1 | out[-1] << 1
            out.append(new & full)
            below = bits
        return tuple(out)

    def edits(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, bits in enumerate(state) if bits >> self.n & 1), None)


class Lexicon:
    """terms: 'word$' or stem -> weight (0 to 1). loose: the terms that misspellings are sought of; by default all whole
    words. known: words that are no misspelling of any term."""

    def __init__(self, terms: dict[str, float], known: frozenset[str] = frozenset(), loose: frozenset[str] | None = None):
        self.terms, self.known = terms, known
        self.edits = {t: edits_allowed(t) if loose is None or t in loose else 0 for t in terms}
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        # A word within k edits keeps one of a term's k + 1 parts, at its place or next to it.
        self.parts: set[str] = set()
        for term in terms:
            if k := self.edits[term]:
                n = len(term) - 1
                cuts = [n * i // (k + 1) for i in range(k + 2)]
                self.parts |= {term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
        self.any_part = re.compile("|".join(map(re.escape, sorted(self.parts)))).search if self.parts else None
        self.most = max(self.edits.values(), default=0)
        within = sorted(t[:-1] for t, k in self.edits.items() if k and len(t) > INSIDE)
        self.any_inside = re.compile("|".join(map(re.escape, within))).search if within else None

    def exact(self, word: str) -> str | None:
        node = self.root
        for c in word + "$":
            node = node.get(c)
            if node is None:
                return None
            if "" in node:
                return node[""]
        return None

    def near(self, word: str, most: int | None = None) -> tuple[int, str] | None:
        """(edits, term) of the nearest whole-word term that allows these edits: the automaton and the trie, intersected."""
        automaton = Automaton(word, self.most if most is None else most)
        best: tuple[int, str] | None = None
        todo = [(self.root, automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    continue
                if c == "$" and "" in child:  # else a mark within a term
                    edits = automaton.edits(state)
                    if edits is not None and edits <= self.edits[child[""]] and (best is None or (edits, child[""]) < best):
                        best = edits, child[""]
                elif any(after := automaton.step(state, c)):
                    todo.append((child, after))
        return best

    def inside(self, word: str) -> list[str]:
        """The terms of ``INSIDE`` letters or more, of those that misspellings are sought of, that begin anywhere in a word, the
        longest at each place, none within another."""
        out, at = [], 0
        while at < len(word):
            node, found, end = self.root, None, at + 1
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                term = node.get("$", {}).get("")
                if term and i + 1 - at >= INSIDE and self.edits[term]:
                    found, end = term, i + 1
            if found:
                out.append(found)
            at = end
        return out

    def weight(self, token: str) -> float:
        """0 if the token is no term, nor near one, nor holds one between marks. Several terms add their evidence."""
        word = core(token)
        if _UNSPACED.search(word):
            if hits := [self.terms[t] for x in runs(word) if (t := x + "$") in self.terms]:
                return 1 - math.prod(1 - w for w in hits)
        if len(word) < 3:
            return 0.0
        if not _INSIDE.search(word):
            return self._weight(word)
        plain = _INSIDE.sub("", word)
        term = self.exact(plain)
        joined = self.terms[term] * PER_EDIT if term and term.endswith("$") else 0.0  # marks set between letters
        return max(joined, 1 - math.prod(1 - self._weight(x) for x in parts(word)))

    def _weight(self, word: str) -> float:
        if term := self.exact(word):
            return self.terms[term]
        if word in self.known:
            return 0.0
        if self.any_inside and self.any_inside(word) and (hits := [self.terms[t] for t in self.inside(word)]):
            return 1 - math.prod(1 - w for w in hits)
        if not self.any_part or not self.any_part(word):
            return 0.0
        found = self.near(word)
        return self.terms[found[1]] * PER_EDIT ** found[0] if found else 0.0


class Weights(dict):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        got = self.lexicon.weight(token)
        if len(self) < CACHE_ENTRIES and len(token) <= REMEMBERED:
            self[token] = got
        return got


def quoted_words(tokens: list[str]) -> list[bool]:
    """Which words are in quotation marks. A quotation ends at its closing mark, however far; a mark that another opening
    mark follows before any closing one opens nothing, and a straight mark after a digit (inches) closes nothing."""
    out, opened = [False] * len(tokens), None
    for i, token in enumerate(tokens):
        opens = token[0] in OPENING
        if opens:
            opened = i
        if opened is not None and any(c in CLOSING and not (c == '"' and k and token[k - 1].isdigit()) for k, c in enumerate(token) if k or not opens):
            out[opened : i + 1] = [True] * (i + 1 - opened)
            opened = None
    return out


def windows(tokens: list[str], weights: list[float]) -> list[tuple[float, bool]]:
    """(evidence, quoted only) of each window of hits."""
    quoted, out, last = quoted_words(tokens), [], None
    for i in (i for i, w in enumerate(weights) if w):
        if last is not None and i - last <= WINDOW:
            out[-1].append((weights[i], quoted[i]))
        else:
            out.append([(weights[i], quoted[i])])
        last = i
    marked = [(hits, all(q for _, q in hits)) for hits in out]
    return [(sum(evidence(w) for w, q in hits if only or not q), only) for hits, only in marked]


def found_evidence(text: str | None, weights: Weights) -> tuple[float, float]:
    """(evidence of plain use: that of all windows, evidence of quotation: that of the strongest window)."""
    tokens = (text or "").split()
    found = list(map(weights.__getitem__, tokens))
    if not any(found):
        return 0.0, 0.0
    plain, quoted = 0.0, 0.0
    for e, only_quotes in windows(tokens, found):
        if only_quotes:
            quoted = max(quoted, e)
        else:
            plain += e
    return plain, quoted


def score(text: str | None, weights: Weights, base: float, bar: float) -> float:
    """0 to 1; 0.5 where plain use reaches the evidence ``bar``. Quotations alone stay below it."""
    plain, quoted = found_evidence(text, weights)
    return max(base, plain / (plain + bar), QUOTED * quoted / (quoted + bar))


@functools.lru_cache(maxsize=2)
def _loaded(model: str) -> tuple[Weights, float, float]:
    m = json.loads(model)
    return Weights(Lexicon(m["terms"], frozenset(m["known"]), frozenset(m["loose"]))), m["base"], m["bar"]


def scored(text, model: str):
    """Column double: the toxicity of a text column; null and empty texts have the base rate."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        loaded = _loaded(model)
        return pd.Series([score(x, *loaded) for x in texts], dtype="float64")

    return toxicity(text)


def _grams(words: set[str]) -> set[str]:
    words = {w for w in words if "$" not in w}  # the sign ends whole words; between marks its parts are words as well
    out = {w + "$" for w in words}
    for n in STEM:
        out |= {w[:n] for w in words if len(w) >= n}
    return out


def _words(text: str) -> set[str]:
    out: set[str] = set()
    for w in map(core, set(text.split())):
        if len(w) > 2:
            out.add(w)
            if _INSIDE.search(w):
                out.update(parts(w))
        if _UNSPACED.search(w):
            out |= runs(w)
    return {w for w in out if not w.isdigit()}


def _sketch(text: str) -> list[int]:
    """Four pairs of minimal hashes over runs of five words: near copies share one."""
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    h = np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64)
    least = [int((h * np.uint64(2 * i + 1) ^ h >> np.uint64(2 * i + 3)).min()) for i in range(8)]
    return [xxhash.xxh64_intdigest(f"{i} {least[2 * i]} {least[2 * i + 1]}") >> 1 for i in range(4)]


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Rows (toxic, text): about ``toxic_rows`` + ``clean_rows`` labelled documents, chosen by a hash of the id. Rows with a
    null id, label or text are passed over."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label) > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.when(F.col("toxic") == 1, F.lit(toxic_rows / max(1, counts.get(1, 0)))).otherwise(F.lit(clean_rows / max(1, counts.get(0, 0))))
    picked = marks.where(share < rate)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).where("text is not null")
    return rows.join(F.broadcast(picked), "_id").select("toxic", "text")  # toxic_rows + clean_rows ids


def fit(labelled: DataFrame) -> str:
    """The model as JSON, from a bounded sample (toxic, text); without a toxic row it has no terms.

    A gram (word or stem) becomes a term if it is more frequent among toxic texts than chance explains. Near copies count
    as one text, so that no word becomes a term because one toxic text was copied often."""
    rows = settle(labelled.select("toxic", "text"), "labelled")

    def count(parts):
        toxic, clean = Counter(), Counter()
        for part in parts:
            for mark, text in zip(part.toxic, part.text, strict=True):
                (toxic if mark else clean).update(_grams(_words(text)))
        grams = list(toxic.keys() | clean.keys())
        for i in range(0, len(grams), BATCH):
            some = grams[i : i + BATCH]
            yield pd.DataFrame({"gram": some, "t": [toxic[g] for g in some], "c": [clean[g] for g in some]})

    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return json.dumps({"terms": {}, "known": [], "loose": [], "base": 0.0, "bar": 1.0})
    ratio = (F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1))
    totals = settle(rows.mapInPandas(count, "gram string, t long, c long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "grams")
    every = totals.count()
    candidates = {r.gram: r.c for r in totals.where((F.col("t") >= 3) & (ratio >= LEAST_ODDS)).collect()}
    names = sorted(candidates)
    place = {g: i for i, g in enumerate(names)}

    def present(parts):
        for part in parts:
            out = [([place[g] for g in _grams(_words(x)) if g in place], _sketch(x)) for x in part.text]
            yield pd.DataFrame(out, columns=["grams", "sketch"])

    groups: dict[int, int] = {}  # sketch -> first of its near copies

    def find(x: int) -> int:
        while groups.setdefault(x, x) != x:
            x = groups[x] = groups[groups[x]]
        return x

    toxic = rows.where("toxic = 1").mapInPandas(present, "grams array<int>, sketch array<long>").collect()  # the sample's bound
    for r in toxic:
        for s in r.sketch[1:]:
            groups[find(s)] = find(r.sketch[0])
    support: dict[str, set[int]] = defaultdict(set)
    for r in toxic:
        for i in r.grams:
            support[names[i]].add(find(r.sketch[0]))
    texts = len({find(r.sketch[0]) for r in toxic})
    chance = texts / (texts + n_clean)

    def is_term(gram: str) -> bool:
        x, y = len(support[gram]), candidates[gram]
        if x < max(LEAST_TEXTS, SUPPORT * texts) or (x + 0.5) / (texts + 1) < LEAST_ODDS * (y + 0.5) / (n_clean + 1):
            return False
        # Chernoff bound of x of x + y texts being toxic by chance, over all grams
        p = x / (x + y)
        rare = x * math.log(p / chance) + (y * math.log((1 - p) / (1 - chance)) if y else 0)
        return rare > math.log(every / CHANCE)

    good = {g for g in names if is_term(g)}
    children: dict[str, list[str]] = defaultdict(list)
    for g in good:
        if g.endswith("$"):
            up = [g[:n] for n in STEM if n < len(g)]
        else:
            up = [g[:-1]]
        if up and (parent := up[-1]) in good:
            children[parent].append(g)
    terms: dict[str, float] = {}
    todo = [g for g in good if not any(g[:n] in good for n in STEM if n < len(g))]
    while todo:
        g = todo.pop()
        x, y, below = len(support[g]), candidates[g], children[g]
        if explains := [c for c in below if len(support[c]) >= 0.9 * x]:
            todo.append(max(explains, key=lambda c: len(support[c])))
        elif y and below:  # clean texts use the stem too: only its toxic continuations count
            todo += below
        else:
            terms[g] = round((x + 0.5) / (x + y + 1), 4)
    known, loose = _neighbours(totals.where(F.col("gram").endswith("$") & (F.col("c") > 0) & (ratio < LEAST_ODDS)), terms)
    model = {"terms": terms, "known": known, "loose": loose, "base": 0.0, "bar": 1.0}
    draft = json.dumps(model)

    def evidences(parts):
        weights = _loaded(draft)[0]
        for part in parts:
            yield pd.DataFrame({"toxic": part.toxic, "e": [found_evidence(x, weights)[0] for x in part.text]})

    seen = [(r.e, r.toxic) for r in rows.mapInPandas(evidences, "toxic int, e double").collect()]  # the sample's bound
    model["bar"] = _bar(seen)
    quiet = [mark for e, mark in seen if not e]
    model["base"] = min(0.45, sum(quiet) / (len(quiet) + 1))
    return json.dumps(model)


def _neighbours(clean: DataFrame, terms: dict[str, float]) -> tuple[list[str], list[str]]:
    """(clean words near a term, terms with so few of them that a misspelling can be told)."""
    lexicon = Lexicon(terms)
    if not lexicon.any_part:
        return [], []

    def near(parts):
        for part in parts:
            words = [g[:-1] for g in part.gram]
            hits = [(w, hit[1]) for w in words if lexicon.any_part(w) and not lexicon.exact(w) and (hit := lexicon.near(w))]
            yield pd.DataFrame(hits, columns=["word", "term"])

    hits = clean.select("gram").mapInPandas(near, "word string, term string").collect()  # words of the sample
    crowd = Counter(r.term for r in hits)
    loose = {t for t in terms if edits_allowed(t) and crowd[t] <= NEIGHBOURS}
    return sorted(r.word for r in hits if r.term in loose), sorted(loose)


def _bar(seen: list[tuple[float, int]]) -> float:
    """The evidence from which a text counts as toxic: toxic texts caught less WORTH times the clean ones caught is most."""
    best, bar, gain = 0, 1.0, 0
    levels = sorted({e for e, _ in seen if e}, reverse=True)
    marks: dict[float, int] = defaultdict(int)
    for e, toxic in seen:
        marks[e] += 1 if toxic else -WORTH
    for i, e in enumerate(levels):
        gain += marks[e]
        if gain > best:
            below = levels[i + 1] if i + 1 < len(levels) else 0.0
            bar = (below + max(below, min(e, evidence(PER_EDIT)))) / 2  # a misspelled term alone passes, if nothing speaks against it
            best = gain
    return bar


def predict(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score, predicted), one for each row of ``docs``; predicted is 1 from a score of 0.5 on.

    Null and empty texts get the base score; null or repeated ids come back as they are; an empty table gives no rows;
    other columns are left out, whatever their names."""
    out = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` without the rows found toxic, in all their columns, whatever their names. Null and empty texts stay, as the
    base score is below the bar; repeated rows and null ids are kept as others are."""
    return docs.where(scored(F.col(text), model) < 0.5)
