import random

from cohortlab.llm import url_intervals

SCHEMA = "page_id long, url string, key string, stack string, host string, rule string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at : max(at, end)]


def brute(url, rules, default):
    host, path = parse(url)
    fits = [(len(h + (p or "")), h.count("."), v, h + (p or "")) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


def run(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "k", "s", "h", "r") for i, u in enumerate(urls)], SCHEMA)
    got = url_intervals.judge(pages, url_intervals.rule_table(spark, rules), default).collect()
    assert len(got) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


def test_rules_equal_brute_force(spark):
    draw = random.Random(4)
    labels = ["net", "org", "com", "example", "a", "b", "examples", "a-b", "exam", "é"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 5)))
    paths = ["", "/", "/en/", "/en/x", "/de/", "/e"]
    rules = sorted({(draw.choice(["block", "allow"]), host(), draw.choice(paths)) for _ in range(60)}) + [("block", "net", None), ("block", "", "/"), ("allow", "a.b", "/"), ("allow", "a.b", "/")]
    urls = [f"http{draw.choice(['', 's'])}://{draw.choice(['', 'www.', 'A.'])}{host()}{draw.choice(paths)}{draw.choice(['', '?q=/en/', '#/de/', 'deep/x?y'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "x://NET", "x://net/", "http://net./en/", "http://.net/", "http://a..b/", "a://b://c", "http://u@a.b:80/en/", "http://net?x://y"] + ["http://hot.example.net/en/1"] * 50
    got = run(spark, urls, rules, "hold")
    assert got == {i: brute(u, rules, "hold") for i, u in enumerate(urls)}


def test_no_rules_no_pages(spark):
    assert run(spark, ["http://a.b/"], []) == {0: ("a.b", "/", None, "allow")}
    assert run(spark, [], [("block", "net", "/")]) == {}
