"""Main text of web pages by composite text density.

Each page becomes a tree of elements. What its tag or role declares to be no article text (menus, headers, footers, forms)
is pruned. Every other block gets its composite text density, the characters for each tag, lowered by the share of links;
inline elements are part of their block's text. A block's density sum is that of its text and of the blocks right below
it, and the block with the largest sum is the article; a paragraph alone is none. Class and id names delete nothing:
a block that is named as a sidebar, notice, advert or comments has its density and sum lowered, as have blocks outside
the article or main element of a page that has one; both count.

The threshold is the least density on the way from the body to the chosen block. Inside it, lists of links and blocks with
lowered density are left out if they don't reach the threshold.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))|(?=[\s/>]|$))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML by their role, and the words of class and id names that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
NO_TEXT = frozenset("head nav footer aside form button select option input svg canvas object audio video menu dialog map".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BOILERPLATE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "footer masthead sidebar aside rail widget widgets related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice banner alert disclaimer popup modal overlay newsletter subscribe subscription signup login "
    "comment comments discussion disqus replies reply respond "
    "share sharing social skyscraper toolbar tags".split()
)
HEADERS = frozenset("header topbar".split())
#: Words that say nothing beside these: a name counts if all its other words do.
PLAIN = frozenset(
    "site page main global top bottom left right upper lower inner outer primary secondary mobile desktop sticky fixed fluid full "
    "block box wrap wrapper container holder section region area column col row panel module item items list links link bar group unit slot "
    "post posts article articles content entry entries reader user form thread button buttons icons".split()
)
ARTICLES = ("article", "main")
#: Elements that hold running text; their names say nothing about their part in the page.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption".split()) | INLINE
#: Depth beyond which elements are siblings, as in browsers; share of its density that a lowered block keeps.
DEPTH, LOWERED = 512, 0.25
#: What is left of a density that links have used up.
FLOOR = 1e-3
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Page:
    """Elements in page order: parent, tag, whether pruned; and the pieces of text with the element they are in (text None:
    a border of blocks)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.pruned, self.named = [-1], ["#root"], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self.body = 0
        self._read(source)

    def _read(self, source: str) -> None:
        stack, open_tags, at = [0], {}, 0
        parent, tag, pieces = self.parent, self.tag, self.pieces

        def close() -> None:
            name = tag[stack.pop()]
            open_tags[name] -= 1
            if name not in INLINE:
                pieces.append((stack[-1], None))

        n, last, quotes = len(source), source.rfind(">"), True
        while at < n:
            mark, m, end = at, None, 0
            while 0 <= (mark := source.find("<", mark)) <= last:  # beyond the last > there is no markup
                if source.startswith("<!--", mark):
                    end = source.find("-->", mark + 4) + 3
                    end = end if end > 2 else n
                elif source.startswith(("<!", "<?"), mark):
                    end = source.find(">", mark) + 1
                elif m := quotes and _TAG.match(source, mark) or _LOOSE_TAG.match(source, mark):
                    quotes = quotes and m.re is _TAG  # once quotation marks don't pair up, they count for nothing
                    end = m.end()
                if end:
                    break
                mark += 1
            text = source[at:mark] if end else source[at:]
            if text:
                pieces.append((stack[-1], html_lib.unescape(text) if "&" in text else text))
            if not end:
                return
            at = end
            if not m:
                continue
            name, attributes = m[2].lower(), m[3]
            if m[1]:
                if open_tags.get(name):
                    while tag[stack[-1]] != name:
                        close()
                    close()
                elif name in ("p", "br"):
                    pieces.append((stack[-1], " "))
                continue
            if name in VOID:
                if name not in INLINE:
                    pieces.append((stack[-1], " " if name == "br" else None))
                if name != "hr":
                    parent.append(stack[-1])
                    tag.append(name)
                    self.pruned.append(False)
                    self.named.append(False)
                continue
            if name in RAW:
                ends = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
                at = source.find(">", ends.end()) + 1 if ends and ends.end() <= last else n
                if name not in INLINE:
                    pieces.append((stack[-1], " "))
                continue
            if name in ("html", "body"):
                if name == "body" and not self.body and len(stack) == 1 + bool(open_tags.get("html")):
                    self.body = len(parent)
                elif open_tags.get(name) or name == "body":
                    continue
            if name in ENDS_P and open_tags.get("p"):
                while tag[stack[-1]] != "p":
                    close()
                close()
            if (rivals := SIBLINGS.get(name)) and any(map(open_tags.get, rivals)):
                depth = next((d for d in range(len(stack) - 1, 0, -1) if tag[stack[d]] in rivals or tag[stack[d]] in HOLDS), 0)
                if depth and tag[stack[depth]] in rivals:
                    while len(stack) > depth:
                        close()
            i = len(parent)
            parent.append(stack[-1])
            tag.append(name)
            pruned, named = self._is_boilerplate(name, attributes, open_tags)
            self.pruned.append(pruned)
            self.named.append(named)
            if attributes.endswith("/") and name in ("path", "circle", "rect"):
                continue
            if name not in INLINE:
                pieces.append((i, None))
            if len(stack) < DEPTH:
                stack.append(i)
                open_tags[name] = open_tags.get(name, 0) + 1

    @staticmethod
    def _is_boilerplate(name: str, attributes: str, open_tags: dict[str, int]) -> tuple[bool, bool]:
        """(whether the element is no article text, whether only its class or id says that it may be none)."""
        inside = any(open_tags.get(x) for x in ARTICLES)
        if name in NO_TEXT or name == "header" and not inside:
            return True, False
        if not attributes or name in ("html", "body"):
            return False, False
        named = False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if name not in ARTICLES and name not in PROSE:
                    marks = BOILERPLATE if inside else BOILERPLATE | HEADERS
                    for one in value.split():
                        words = {w.lower() for w in _NAME.findall(one)}
                        named = named or bool(words & marks) and words <= marks | PLAIN
            elif key == "role":
                if value.strip().lower() in NO_ROLE:
                    return True, False
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                return True, False
        return False, named

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density and density sum of every block; pruned and inline elements have none."""
        parent, tag, n = self.parent, self.tag, len(self.parent)
        out, link, block, held = [False] * n, [False] * n, list(range(n)), [False] * n
        for i in range(1, n):
            up = parent[i]
            out[i] = self.pruned[i] or out[up]
            link[i] = tag[i] == "a" or link[up]
            held[i] = tag[i] in ARTICLES or held[up]
            if tag[i] in INLINE:
                block[i] = block[up]
        chars, linked, own, tags, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for i, text in self.pieces:
            if text and not out[i] and (size := len(text.strip())):
                chars[i] += size
                if link[i]:
                    linked[i] += size
                else:
                    own[block[i]] += size
        for i in range(n - 1, 0, -1):
            if not out[i]:
                up, is_link = parent[i], tag[i] == "a"
                chars[up] += chars[i]
                linked[up] += linked[i]
                tags[up] += tags[i] + (is_link or tag[i] not in INLINE)
                links[up] += links[i] + is_link
        share = linked[self.body] / max(1, chars[self.body])

        def composite(c: int, lc: int, t: int, lt: int) -> float:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = c / max(1, lc) * t / max(1, lt)
            return c / t * max(FLOOR, math.log(ratio, max(base, 1 + 1e-9)) if ratio > 1 else 0.0)

        # What an article or main element holds, and what leads to it, is not lowered for being outside.
        told = any(tag[i] in ARTICLES and chars[i] and not out[i] for i in range(n))
        leads = [False] * n
        for i in range(n - 1, 0, -1):
            if tag[i] in ARTICLES and chars[i] and not out[i] or leads[i]:
                leads[parent[i]] = True
        named, outside, lowered = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            named[i] = tag[i] not in ARTICLES and (self.named[i] or named[parent[i]])
            outside[i] = told and not held[i] and not leads[i]
            lowered[i] = named[i] or outside[i]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if out[i] or not chars[i] or block[i] != i:
                continue
            weight = LOWERED ** (named[i] + outside[i])
            density[i] = weight * composite(chars[i], linked[i], max(1, tags[i]), links[i])
            if own[i]:
                total[i] += weight * composite(own[i], 0, 1, 0)
            if i:
                total[block[parent[i]]] += density[i]
        self.out, self.chars, self.linked, self.lowered, self.leads = out, chars, linked, lowered, leads
        return density, total

    def chosen(self) -> int | None:
        """The block whose text is the article's; what it holds that doesn't reach the threshold is marked as out."""
        density, total = self.densities()
        places = [i for i in range(self.body, len(self.parent)) if total[i] and (i == self.body or self.tag[i] not in PROSE)]
        if not places:
            return None
        best = max(places, key=lambda i: (total[i], -i))
        threshold, i = density[best], best
        while i > self.body:
            i = self.parent[i]
            threshold = min(threshold, density[i]) if density[i] else threshold
        for i in range(best + 1, len(self.parent)):
            if density[i] < threshold and self.tag[i] not in PROSE and self.tag[i] not in ARTICLES and not self.leads[i]:
                self.out[i] = self.out[i] or self.lowered[i] and not self.lowered[best] or 2 * self.linked[i] > self.chars[i] > 0
        return best

    def text(self) -> str:
        best = self.chosen()
        if best is None:
            return ""
        inside = [False] * len(self.parent)
        for i in range(best, len(self.parent)):
            inside[i] = not self.out[i] and (i == best or inside[self.parent[i]])
        blocks, line = [], []
        for i, text in self.pieces:
            if text is None:
                if line:
                    blocks.append("".join(line))
                    line = []
            elif inside[i]:
                line.append(text)
        blocks.append("".join(line))
        return " ".join(y for x in blocks if (y := " ".join(x.split())))


def main_text(source: str | None) -> str:
    """The article's text; empty for null and empty pages and for pages without any."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages``; null pages are empty; null or repeated ids come
    back as they are; an empty table gives no rows; other columns are left out, whatever their names."""

    @F.pandas_udf("string")
    def article(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in sources], dtype="object")

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), article(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
