import re

import numpy as np


from fernglass.llm import urls as U

URLS = [None, "", "no scheme", "http://", "http://X.Example.ORG/es/1", "https://example.org/en/1", "https://a.example.org/en/12?x#y", "http://notexample.org/es/", "http://org/x", "http://a.org", "http://a.com/de/1", "http://a.com/fr/1", "http://a.com?u=://b.org/", "ftp://a.com:80/fr/", "http://É.ORG/", "x://y://z/fr", "http://a.com/DE/", "http://b.net/" + "p/" * 3000]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(U.UPPER, U.LOWER)), m[2]) if m else ("", "")
    best = None
    for rule, verdict in U.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules_like_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, path string")
    rows = U.judge_urls(df).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, best = brute(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None)
        assert r.verdict in ("allow", "block") and 0 <= r.score <= 1 and (best is None or r.verdict == best[1])
    by = {}
    for r in rows:
        by.setdefault(r.page_id % len(URLS), set()).add((r.verdict, r.score))
    assert all(len(v) == 1 for v in by.values())


def test_known_cases():
    assert brute("http://X.Example.ORG/es/1")[2] == ("example.org/es/", "block") and brute("http://notexample.org/es/")[2] == ("org/", "allow") and brute("http://a.org")[2] is None


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert U.judge_urls(df).first().verdict == "allow"
    assert U.judge_urls(df.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = U.Trees(x[:2000], y[:2000])
    assert ((t.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    good = [f"https://site{rng.integers(50)}.com/en/{rng.integers(99)}" for _ in range(400)]
    bad = [f"http://x{rng.integers(10**9)}.biz/{'a-' * int(rng.integers(5, 15))}{rng.integers(10**9)}?a=1&b={rng.integers(10**6)}&c=2" for _ in range(400)]
    rows = [(u, u in bad) for u in good + bad]
    df = spark.createDataFrame([(u, *brute(u)[:2], b) for u, b in rows[::2]], "url string, host string, path string, blocked boolean")
    rest = [u for u, _ in rows[1::2]]
    out = U.judge_urls(spark.createDataFrame(list(enumerate(rest)), "page_id long, url string"), rules=(), labelled=df).collect()
    assert np.mean([(r.verdict == "block") == (rest[r.page_id] in bad) for r in out]) > 0.98
