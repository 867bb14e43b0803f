"""URL filters: brute force for hosts, paths and rules; held-out accuracy for the trees."""

import random
from collections import Counter

from foliomill.llm.url_filters import RULES, fit, url_filter
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme/x", "http://", "HTTP://Sub.EXAMPLE.NET/en/a?b#c", "https://example.net/En/", "https://example.net", "ftp://a.net/x://y",
    "http://net/", "http://xnet/", "http://example.com/de/1", "http://a.example.com/de", "http://fr.org/fr/x", "http://org/fr/", "http://é.ORG/fr/\nx?y", "x://h?q=/de/", "a://b.net#/x", "://x.org/fr/",
]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for action, rule in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def urls(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.4
        host = "-".join(rng.choice(("win", "bet", "pill")) for _ in range(rng.randint(1, 4))) if bad else rng.choice(("news", "blog", "shop"))
        tld = rng.choice(("xyz", "com", "com")) if bad else rng.choice(("com", "org", "edu"))
        path = "/".join(str(rng.randint(0, 10**9)) if bad else "page" for _ in range(rng.randint(1, 4)))
        query = "?" + "&".join(f"k{j}={rng.randint(0, 99999)}" for j in range(rng.randint(1, 5))) if bad and rng.random() < 0.7 else ""
        out.append((i, f"https://{host}{i % 7}.{tld}/{path}{query}", int(bad)))
    return out


def test_rules_and_edges(spark):
    rows = list(enumerate(URLS)) + [(1, ""), (None, "http://q.org/fr/1")]
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in rows], "page_id long, url string, host string, suffix string")
    none = spark.createDataFrame([], "url string, bad int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, none).collect())
    want = Counter()
    for i, u in rows:
        host, path, best = brute(u)
        want[(i, host, path, best[1] if best else None, best[0] if best else "allow")] += 1
    assert got == want
    assert url_filter(pages.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    train = spark.createDataFrame(urls(3000, 1) + [(-1, "x://y", None), (-2, None, 1)], "page_id long, url string, bad int")
    test = spark.createDataFrame(urls(1000, 2), "page_id long, url string, bad int")
    judged = url_filter(test, train, rules=()).join(test, "page_id")
    right = judged.filter((F.col("verdict") == "block") == (F.col("bad") == 1)).count()
    assert right >= 950
    assert fit(train.filter("bad = 1")).trees == []
