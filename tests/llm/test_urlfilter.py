import re

import numpy as np
import pytest

from concord.llm import urlfilter

PAGES = "page_id long, url string, html string, host string, verdict int"


def slow_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    best = None
    for verdict, rule in urlfilter.RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/7/x?q#f", "http://example.com/en/7", "https://example.com/en/8", "http://notexample.com/en/", "http://com/en/", "http://com/EN/", "x://Ä.net/de/8",
    "http://a.example.net/de/81", "http://net/de/", "http://b.org/es", "http://b.org/es/", "http://b.org?x=/es/", "http://b.org#/es/", "ftp://u:p@h.org:80/es/a", "a://b://c.com/en/", "http:///en/", "http://x.com", "line\n://com/en/\n?x", "http://evilcom/en/",
]


def test_rules_as_brute_force(spark):
    rows = [(i, u, None, "x", 1) for i, u in enumerate(URLS)]
    got = {r["page_id"]: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = slow_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if verdict:
            assert got[i]["verdict"] == verdict


def test_rules_are_those_of_the_contract(spark):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/80": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame([(i, u, None, "x", 1) for i, u in enumerate(want)], PAGES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages).collect()}
    assert got == dict(enumerate(want.values()))


def slow_walk(seeds, edges, damping=0.85, rounds=40):
    hosts = sorted({h for h in seeds} | {h for e in edges for h in e[:2]})
    at = {h: i for i, h in enumerate(hosts)}
    p = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        p[at[a], at[b]] += n
    p = np.divide(p, p.sum(axis=1, keepdims=True), out=np.zeros_like(p), where=p.sum(axis=1, keepdims=True) > 0)
    start = np.array([seeds.get(h, 0.0) for h in hosts]) * (1 - damping)
    r = start
    for _ in range(rounds):
        r = start + damping * r @ p
    return dict(zip(hosts, r / r.sum()))


def test_walks_as_dense_algebra(spark):
    edges = [("a", "b", 3), ("b", "c", 1), ("c", "a", 2), ("b", "d", 1), ("e", "d", 4), ("f", "e", 1)]
    seeds = [("trust", "a", 2.0), ("distrust", "d", 1.0), ("distrust", "c", 3.0)]
    got = {(r["kind"], r["host"]): r["score"] for r in urlfilter.propagate(spark.createDataFrame(seeds, "kind string, host string, seed double"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    want = {("trust", h): s for h, s in slow_walk({"a": 2.0}, edges).items()} | {("distrust", h): s for h, s in slow_walk({"d": 1.0, "c": 3.0}, [(b, a, n) for a, b, n in edges]).items()}
    for key, score in want.items():
        assert got.get(key, 0.0) == pytest.approx(score, abs=1e-12)


def test_verdicts_follow_links(spark):
    link = lambda *hosts: " ".join(f'<a HREF = "https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://bad.com/en/1", None), (2, "http://example.com/en/7", link("friend.io", "example.com")),
        (3, "http://farm.io/p", link("bad.com", "BAD.com") + '<a href="/local">'), (4, "http://friend.io/p", None), (5, "http://quiet.io/p", ""), (5, "http://quiet.io/p", ""), (None, None, None),
    ]
    got = {(r["page_id"], r["verdict"]) for r in urlfilter.filter_urls(spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES)).collect()}
    assert got == {(1, "block"), (2, "allow"), (3, "block"), (4, "allow"), (5, "allow"), (None, "allow")}
    edges = {(r["src"], r["dst"], r["n"]) for r in urlfilter.host_edges(spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES)).collect()}
    assert edges == {("example.com", "friend.io", 1), ("farm.io", "bad.com", 2)}
    assert urlfilter.filter_urls(spark.createDataFrame([], PAGES)).collect() == []
