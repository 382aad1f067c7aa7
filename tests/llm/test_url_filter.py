"""URL filter: rules and parts against Python, the model against a direct computation."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import url_filter as U

ODD = [None, "", "nothing", "://", "http://A.COM", "http://a.com/", "https://x.Example.com/en/1", "https://www.example.com/en/1", "https://b.www.example.com/en/", "http://notexample.com/en/", "http://example.com?/en/", "http://x.net/es/a", "http://x.net/ES/a", "http://net/fr/", "http://u@x.net:80/fr/?q=://y", "http://x.org/a\nb", "ftp://ü.org/é😀", "http://x.org/" + "long" * 5000]


def parts(url):
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    host = rest[2]
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[2][len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(url):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def lower(url):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")


def pieces(url):
    padded = "\x02" * U.ORDER + lower(url) + "\x03"
    return [padded[k : k + U.ORDER + 1] for k in range(len(padded) - U.ORDER)]


def brute(urls):
    """Verdicts of the model, by a recursive definition."""
    out = {u: hashlib.md5((u or "").encode()).hexdigest() < U.HELD_OUT for u in urls}
    counts = {v: Counter(g[-k:] for u in urls if ruled(u)[1] == v and not out[u] for g in pieces(u) for k in range(1, U.ORDER + 2)) for v in ("allow", "block")}
    after = {v: defaultdict(lambda: [0, 0]) for v in counts}
    for v, own in counts.items():
        for g, n in own.items():
            after[v][len(g), g[:-1]][0] += n
            after[v][len(g), g[:-1]][1] += 1
    signs = len({g for own in counts.values() for g in own if len(g) == 1}) + 1

    def p(v, g):
        if not g:
            return 1 / signs
        n, t = after[v][len(g), g[:-1]]
        return p(v, g[1:]) if n == 0 else (counts[v][g] + t * p(v, g[1:])) / (n + t)

    def score(url):
        total, own = 0.0, pieces(url)
        for g in own:
            while g and not any(c[g] for c in counts.values()):
                g = g[1:]
            total += math.log(p("allow", g) / p("block", g)) if g else 0.0
        return round(total / len(own), 9)

    known = {v: [score(u) for u in urls if ruled(u)[1] == v and out[u]] for v in counts}
    limit = U.threshold({v: (len(s), sum(s), sum(x * x for x in s)) for v, s in known.items() if s})
    return [ruled(u)[1] or ("allow" if score(u) >= limit else "block") for u in urls]


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(2)
    made = []
    for _ in range(260):
        host = rng.choice(["a.com", "news.com", "example.com", "www.example.com", "shop.net", "x.org", "ads-track.example.org"])
        made.append(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'm.', 'blog.'])}{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 999)}{rng.choice(['', '/', '?p=1', '#top'])}")
    return made + ODD + made[:5]


def test_verdicts(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as ratio", "'h' as host", "'g' as gram", "0 as n")
    found = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert len(found) == len(urls)
    for k, url in enumerate(urls):
        assert (found[k]["host"], found[k]["path"]) == parts(url), url
        assert found[k]["rule"] == ruled(url)[0], url
    # lone halves of a code point beyond 16 bits count as a position of their own in Spark
    plain = [k for k, u in enumerate(urls) if "😀" not in (u or "")]
    expected = brute([urls[k] for k in plain])
    assert [found[k]["verdict"] for k in plain] == expected
    assert {"allow", "block"} == {found[k]["verdict"] for k in plain if found[k]["rule"] is None}


def test_repeated_rows_and_clashing_ids(spark, urls):
    rows = [(1, urls[0]), (1, urls[0]), (1, "http://x.org/1"), (1, "http://x.org/1"), (None, "http://x.org/2"), (2, None)]
    found = U.judge(spark.createDataFrame(rows + [(9, u) for u in urls], "page_id long, url string")).where("page_id is null or page_id < 9")
    assert sorted([(r["page_id"] or 0, r["url"] or "") for r in found.collect()]) == sorted((a or 0, b or "") for a, b in rows)


def test_without_labels_all_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in U.judge(pages).collect()} == {"allow"}
    assert U.judge(pages.limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark, urls, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    before = sorted(map(str, U.judge(pages).collect()))
    monkeypatch.setattr(U, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, U.judge(pages).collect())) == before


def test_plan_has_no_python(spark, urls):
    plan = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
