"""URL rules against a plain loop: nested hosts and paths, many rules on one host, odd rows."""

import random
import time

from tidewarden.llm import url_rules


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_rules_equal_a_loop(spark):
    rng = random.Random(31)
    labels, parts = ["a", "b", "ab", "a-b", "c0"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/b", "/é", "/a/b/c", "//"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    verdicts = {}
    for _ in range(120):
        verdicts[host(), rng.choice(parts)] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in verdicts.items()]
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(['', 'x', '/b/c', '?q=/a', '#/a'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "http:///a", "HTTP://A.B/a", "x://a.b?://c", "http://a..b/a", "http://.a/"]
    pages = spark.createDataFrame([(i % 400, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    extra = [("a.b", None, "block"), (None, "/", "block")]
    table = spark.createDataFrame(rules + extra, "host string, path string, verdict string")
    got = url_rules.judge(pages, table, lanes=3)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(((i % 400, *plain(u, rules)) for i, u in enumerate(urls)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert url_rules.judge(pages, table.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0
    assert url_rules.judge(pages.limit(0), table).count() == 0


def test_many_path_rules_on_one_host(spark):
    """A url meets the rules around its path only, so ten times the rules cost little more."""
    took = []
    for n in (1000, 10_000):
        rules = [("one.example", f"/{i}/", "block") for i in range(n)] + [("example", "/7", "allow")]
        pages = spark.createDataFrame([(i, f"https://www.one.example/{i % n}/page") for i in range(2000)], "page_id long, url string")
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        began = time.time()
        got = {r.page_id: r.rule for r in url_rules.judge(pages, table, lanes=4).collect()}
        took.append(time.time() - began)
        assert got == {i: f"one.example/{i % n}/" for i in range(2000)}
    assert took[1] < 3 * took[0] + 3
