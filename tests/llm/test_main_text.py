"""The article by density: pages whose menus, imprints and sidebars no name tells, and densities by a plain recursion."""

import math
import random
from html.parser import HTMLParser

import pytest

from tidewarden.llm import main_text


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def story(rng, tag="div"):
    """(html, text) of an article: a heading, paragraphs, a list."""
    parts = [("h1", sentence(rng, 6))] + [("p", sentence(rng, rng.randint(25, 80))) for _ in range(rng.randint(4, 9))]
    parts.insert(rng.randint(2, len(parts)), ("ul", [sentence(rng, 5) for _ in range(3)]))
    out, text = "", []
    for kind, x in parts:
        out += f"<ul>{''.join(f'<li>{y}</li>' for y in x)}</ul>" if kind == "ul" else f"<{kind}>{x}</{kind}>"
        text += x if kind == "ul" else [x]
    return f"<{tag}>{out}</{tag}>", " ".join(text)


def menu(rng):
    return "<div><ul>" + "".join(f"<li><a href=/{i}>{sentence(rng, 2)}</a></li>" for i in range(rng.randint(5, 15))) + "</ul></div>"


def imprint(rng):
    return f"<div><p>{sentence(rng, 12)}</p><p><a href=/i>{sentence(rng, 2)}</a></p></div>"


def sidebar(rng):
    return f"<div><h3>{sentence(rng, 2)}</h3><p>{sentence(rng, 15)}</p><ul><li><a href=/x>{sentence(rng, 5)}</a></li></ul></div>"


def test_unnamed_parts_are_left_out_by_density(monkeypatch):
    rng = random.Random(12)
    pages = []
    for i in range(60):
        article, text = story(rng, rng.choice(["div", "section"]))
        middle = f"<div>{article}{sidebar(rng)}</div>" if i % 2 else article + sidebar(rng)
        pages.append((f"<html><body>{menu(rng)}{middle}{imprint(rng)}</body></html>", text))
    right = sum(main_text.main_text(page) == text for page, text in pages)
    assert right == len(pages)
    choose = main_text.Page.densities

    def body_only(self):
        density, total = choose(self)
        return density, [t if i == self.body else 0.0 for i, t in enumerate(total)]

    monkeypatch.setattr(main_text.Page, "densities", body_only)
    assert sum(main_text.main_text(page) != text for page, text in pages) >= 0.9 * len(pages)


@pytest.mark.parametrize("name", "market-share-analysis popular-science comment-on-the-law rail-transport modal-verbs signup-story alert-level trending-history ad-hoc widget-making".split())
def test_names_that_only_sound_like_boilerplate(name):
    rng = random.Random(3)
    parts = [sentence(rng, 30) for _ in range(4)]
    page = f"<body><article><h1>Title of it.</h1><p>{parts[0]}</p><div class='{name}'><p>{parts[1]}</p></div><p>{parts[2]}</p><section id={name}><p>{parts[3]}</p></section></article></body>"
    assert main_text.main_text(page) == " ".join(["Title of it.", *parts])


@pytest.mark.parametrize("name", ["comments", "related-posts", "social-share", "ad", "cookie-notice", "newsletterSignup"])
def test_named_parts_don_t_reach_the_threshold(name):
    rng = random.Random(4)
    parts = [sentence(rng, 40) for _ in range(5)]
    said = "".join(f"<p>{sentence(rng, 12)}</p>" for _ in range(4))
    page = f"<body><article><h1>Title of it.</h1>{''.join(f'<p>{x}</p>' for x in parts)}<div class='{name}'>{said}</div></article><div class='{name}'>{said}</div></body>"
    assert main_text.main_text(page) == " ".join(["Title of it.", *parts])


def test_short_articles_and_linked_ones():
    rng = random.Random(5)
    imprint = sentence(rng, 40)
    assert main_text.main_text(f"<body><article><p>A short one.</p></article><div><p>{imprint}</p></div></body>") == "A short one."
    linked = [sentence(rng, 12) for _ in range(6)]
    assert main_text.main_text("<body><article>" + "".join(f"<p><a href=/x>{x}</a></p>" for x in linked) + "</article></body>") == " ".join(linked)
    assert main_text.main_text("<body><p>Only a paragraph.</p></body>") == "Only a paragraph."
    assert main_text.main_text("text without any markup") == "text without any markup"
    assert main_text.main_text("<p><b>One.<br><p>Two.<p>Three") == "One. Two. Three"
    for nothing in (None, "", "<html>", "<nav>menu</nav>", "<script>x</script>"):
        assert main_text.main_text(nothing) == ""


class Plain(HTMLParser):
    """A tree of (tag, children), text as strings, for well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.stack = [("#root", [])]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def plain_sums(page):
    """{start of a block's text: (density, sum)} by recursion over the tree."""
    body = next(x for x in Plain(page).stack[0][1][0][1] if x[0] == "body")

    def text(node, only_links=False, linked=False):
        linked = linked or node[0] == "a"
        return sum((len(x.strip()) if linked or not only_links else 0) if isinstance(x, str) else text(x, only_links, linked) for x in node[1])

    def tags(node):
        below = [x for x in node[1] if not isinstance(x, str)]
        return len(below) + sum(tags(x)[0] for x in below), sum(x[0] == "a" for x in below) + sum(tags(x)[1] for x in below)

    share = text(body, True) / text(body)

    def density(c, lc, t, lt):
        ratio = c / max(1, lc) * t / max(1, lt)
        return c / t * max(main_text.FLOOR, math.log(ratio) / math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e)) if ratio > 1 else 0)

    found = []

    def visit(node):
        if node[0] == "a":
            return 0.0
        own = sum(len(x.strip()) for x in node[1] if isinstance(x, str))
        total = sum(visit(x) for x in node[1] if not isinstance(x, str)) + (density(own, 0, 1, 0) if own else 0)
        t, lt = tags(node)
        d = density(text(node), text(node, True), max(1, t), lt) if text(node) else 0.0
        if text(node):
            found.append((node[0], round(d, 6), round(total, 6)))
        return d

    visit(body)
    return sorted(found)


def test_densities_equal_a_plain_recursion():
    rng = random.Random(6)
    for _ in range(30):
        page = f"<html><body>{menu(rng).replace('=/', '=')}{story(rng)[0]}{sidebar(rng)}<div>{sentence(rng, 9)}{imprint(rng)}</div></body></html>"
        p = main_text.Page(page)
        density, total = p.densities()
        got = sorted((p.tag[i], round(density[i], 6), round(total[i], 6)) for i in range(p.body, len(p.tag)) if density[i])
        assert got == plain_sums(page)
        best = max((x for x in got if x[0] not in main_text.PROSE), key=lambda x: x[2])
        assert (p.tag[p.chosen()], round(total[p.chosen()], 6)) == (best[0], best[2])
