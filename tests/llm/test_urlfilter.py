import random

import pytest

from gaugeworks.llm import urlfilter
from gaugeworks.llm.queries import URL_RULES


def brute(url, rules):
    lower = {c: c + 32 for c in range(65, 91)}
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
        host = cut(rest, "/?#")
        path = cut(rest[len(host) :], "?#")
        host = host.translate(lower)
    best = None
    for verdict, rule in rules:
        rhost, rpath = rule.split("/", 1)
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rpath):
            key = (len(rule), len(rhost), rule, verdict)
            best = max(best, key) if best else key
    return host, path, best[2] if best else None, best[3] if best else "allow"


def urls(seed, n=400):
    rng = random.Random(seed)
    fixed = [None, "", "no scheme.com/", "://", "http://", "http://EXAMPLE.com/en/x?y#z", "http://com/", "http://com", "http://net/es/", "http://a.net?/es/", "http://a.net#/fr/", "http://xnet/fr/", "x://y://example.com/en/", "http://.com/", "http://a..com/", "http://www.example.com//en/", "http://É.COM/İ/", "http://a.b.c.d.e.f.example.com/en/" + "p/" * 3000, "line\nbreak://example.com/en/\nmore"]
    made = ["".join(rng.choice(["http://", "https://", ""]) + rng.choice(["www.", "", "a.b."]) + rng.choice(["example.com", "example.net", "net", "com", "Example.COM", "org"]) + rng.choice(["", "/", "/en", "/en/", "/fr/a/b", "/es/?q", "?/es/", "#x"])) for _ in range(n)]
    return fixed + made


@pytest.mark.parametrize("broadcast", [urlfilter.BROADCAST_RULES, 0])
@pytest.mark.parametrize("rules", [URL_RULES, [], [("block", "a.com/"), ("allow", "a.com/"), ("block", "com/en/x/"), ("allow", "example.com/en/")]])
def test_matches_brute_force(spark, monkeypatch, broadcast, rules):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", broadcast)
    rows = [(i, u) for i, u in enumerate(urls(3))] + [(None, "http://example.com/en/"), (1, "http://com/"), (1, "http://com/")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, rule string")
    got = sorted((tuple(r) for r in urlfilter.judge(df, urlfilter.rules_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=str)


def test_bad_rules_are_refused(spark):
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    for rule in ("example.com", "example.com/en", "/en/"):
        with pytest.raises(ValueError):
            urlfilter.judge(df, urlfilter.rules_table(spark, [("block", rule)]))


def test_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), urlfilter.rules_table(spark, URL_RULES)).collect() == []
