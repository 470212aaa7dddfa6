import random
from collections import Counter

from graphloom.llm import url_filter as U


def parse(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return host, path[:end]


def brute(url, rules):
    host, path = parse(url)
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def got(df):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


URLS = [None, "", "no scheme.net/", "http://", "http://net/", "http://NET", "http://a.net/x", "https://example.net/en/1", "https://x.example.net/en/1?q#f",
        "https://example.net/en", "https://notexample.net/en/", "http://example.com/de/2", "http://example.comx/de/", "http://a.b.org/fr/", "http://org/fr/#x",
        "http://org?x=/fr/", "ftp://a.net#b://c", "http://a..net/", "http://.net/", "http://net./", "x://y://net/", "http://a.net\n/x"]


def test_registered_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.net/x"), (3, "http://a.net/x"), (3, "http://a.net/x")]
    pages = spark.createDataFrame([(i, u, "k", "h", 1, "o") for i, u in rows], "page_id long, url string, key string, host string, salt int, open string")
    out = U.judge_urls(pages, U.rules_frame(spark))
    assert got(out) == Counter((i, *brute(u, U.RULES)) for i, u in rows)


def test_nested_rules_against_brute_force(spark):
    rnd = random.Random(5)
    labels = ["a", "b", "ab", "c", "com", "net"]
    host = lambda n: ".".join(rnd.choice(labels) for _ in range(n))
    path = lambda n: "/" + "".join(rnd.choice(["x/", "y/", "x", "xy/"]) for _ in range(n))
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((host(rnd.randint(1, 4)), path(rnd.randint(0, 2))) for _ in range(150))}.values())
    urls = [(i, f"http://{host(rnd.randint(1, 6))}{path(rnd.randint(0, 4))}") for i in range(800)]
    out = U.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), U.rules_frame(spark, rules), salts=3)
    fits = lambda u: [(len(h + p), len(h)) for a, h, p in rules if (parse(u)[0] == h or parse(u)[0].endswith("." + h)) and parse(u)[1].startswith(p)]
    assert sum(len(fits(u)) > 1 for _, u in urls) > 50
    assert got(out) == Counter((i, *brute(u, rules)) for i, u in urls)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(pages, U.rules_frame(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert U.judge_urls(one, U.rules_frame(spark, []), default="block").first().verdict == "block"
