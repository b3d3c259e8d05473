from dayzero.llm.queries import URL_RULES
from dayzero.llm.url_rules import judge_urls, rule_table

RULES = [*URL_RULES, ("block", "example.com", "/de/ab/c"), ("allow", "example.com", "/de/ab/c"), ("block", None, "/"), ("allow", "a.b.c.org", "")]


def plain(url):
    """host, path, rule and verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for sign in "?#":
        rest = rest.split(sign, 1)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for v, h, p in RULES
        if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


def test_matches_trying_every_rule(spark, rows):
    urls = [
        None, "", "net", "://", "http://net", "HTTP://NET/", "http://A.example.net/en/1?x=/de/", "x://xnet/", "x://a.net/",
        "x://example.com/de", "x://example.com/de/ab/cd", "x://www.EXAMPLE.com/de/#/x", "x://b.org/fr/", "x://org/fr/a://b",
        "x://a.b.c.org", "x://z.a.b.c.org?", "x://É.net/é", "x://net:80/", "x://u@net/", "x://.net/", "x://net./", "x://net//",
    ] + ["x://" + ".".join(["a"] * 300) + ".net/" + "b/" * 300]
    pages = [(i, u, "h", "p") for i, u in enumerate(urls + urls[:6])]
    table = spark.createDataFrame(pages, "page_id long, url string, host string, prefix string")
    got = sorted(rows(judge_urls(table, rule_table(spark, RULES))))
    assert got == sorted((i, *plain(u)) for i, u, _, _ in pages)


def test_empty_tables(spark, rows):
    pages = spark.createDataFrame([(1, "x://net/")], "page_id long, url string")
    assert rows(judge_urls(pages.where("false"), rule_table(spark, RULES))) == []
    assert rows(judge_urls(pages, rule_table(spark, []))) == [(1, "net", "/", None, "allow")]


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "x://net/")], "page_id long, url string")
    plan = judge_urls(pages, rule_table(spark, RULES))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
