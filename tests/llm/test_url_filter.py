"""URL filters against a plain reading of the rules."""

import random

from critiq.llm.queries import RULES
from critiq.llm.url_filter import url_verdicts

RULE = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, spark.createDataFrame(rules, RULE), **more).collect()}
    assert got == {i: brute(u, rules, **more) for i, u in enumerate(urls)}


def test_rules_of_the_query(spark):
    urls = ["http://a.NET/x", "https://net/", "http://net", "http://xnet/", "http://example.net/en/1", "http://example.net/en", "http://b.example.net/en/?q=/de/", "http://example.com/de/#x", "http://www.example.com/DE/",
            "http://q.org/fr/a", "http://org/fr/", "http://q.org?/fr/", "nothing", "", None, "://", "a://b://c/d", "http:///fr/", "http://net:80/", "http://.net/", "http://ÄNET.net/ä\nb?c", "http://net./x", "HTTP://NET/" + "x" * 100_000]
    check(spark, urls, RULES)


def test_nested_rules_at_random(spark):
    rng = random.Random(3)
    labels = ["a", "b", "net", "a-b", "z", "aa"]
    host = lambda n: ".".join(rng.choices(labels, k=rng.randint(1, n)))
    rules = list({(host(3), rng.choice(["/", "/x/", "/x/y", "/a"])): None for _ in range(40)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{host(5)}{rng.choice(['', '/', '/x/', '/x/y/z', '/a?/x/'])}" for _ in range(400)]
    check(spark, urls, rules, default="block")


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://net/"), (1, "http://net/"), (None, None)], "page_id long, url string")
    got = url_verdicts(pages, spark.createDataFrame([], RULE))
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in got.collect()) == [("1", None, "allow"), ("1", None, "allow"), ("None", None, "allow")]
    assert url_verdicts(pages.limit(0), spark.createDataFrame(RULES, RULE)).count() == 0
    odd = spark.createDataFrame([("net", None, "block"), (None, "/", "block"), ("", "/", "block")], RULE)
    assert sorted(r.verdict for r in url_verdicts(pages, odd).collect()) == ["allow", "block", "block"]


def test_native(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    plan = url_verdicts(pages, spark.createDataFrame(RULES, RULE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
