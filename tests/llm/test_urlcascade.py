from pyspark.sql import functions as F

from vitrine.llm import urlcascade

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    None, "", "no scheme", "http://", "http:///path", "http://EXAMPLE.org", "http://example.ORG/", "https://a.example.org/es/1?q=/de/",
    "https://a.example.org/es", "http://badexample.org/es/", "http://x.com/de/#/fr/", "http://x.com/fr/7", "http://com/de/", "http://x.com?/de/",
    "ftp://b.a.example.org/en/12", "http://example.org/en/2", "http://x.net/de/", "a://b://example.org/es/", "http://ÄÖ.com/de/\nx", "http://..org/", "http://x.com/DE/",
]


def judged(url, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def frames(spark, urls):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, keys string, rule string")
    return pages, spark.createDataFrame(RULES, "verdict string, host string, path string")


def test_judged_as_by_a_plain_loop(spark):
    got = urlcascade.judge(*frames(spark, URLS + URLS)).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(i, *judged(u)) for i, u in enumerate(URLS + URLS)}


def test_empty_tables(spark):
    pages, rules = frames(spark, [])
    assert urlcascade.judge(pages, rules).count() == 0
    pages, rules = frames(spark, URLS)
    assert {r.verdict for r in urlcascade.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_cascade_is_exact_over_its_universe_with_few_bits(spark):
    universe = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("cast(key as int) % 3 = 0 or key like '1%'")
    levels = urlcascade.build_cascade(universe, listed, max_bits=4096)
    assert len(levels) > 2
    got = universe.filter(urlcascade.listed_in(levels, F.col("key")))
    assert got.exceptAll(listed).count() == 0 and listed.exceptAll(got).count() == 0
