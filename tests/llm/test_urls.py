import re

from quern.llm import urls


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for act, text in urls.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (act, text)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://COM/en/", "https://x.Example.COM/en/71?a#b", "https://notexample.com/en/7", "http://example.net/de/8x", "http://a.example.net/de/9", "http://org/es/#", "http://e.org/es?/es/", "http://com?/en/",
    "http://com/en", "ftp://a://b/c", "http://ÉX.com/en/É", "http://m.bad.com/a.html", "https://www.bad.com/a/?utm_source=x#top", "http://bad.com/a?b=2&a=1", "http://bad.com/a?a=1&b=2&ref=z", "http://bad.com/b", "http://bad.com/\nq",
]


def test_rules_and_list(spark, way):
    blocks = urls.BROADCAST_BLOCKS if way == "broadcast" else 0
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3])], "page_id long, url string")
    listed = urls.parsed(spark.createDataFrame([("http://bad.com/a",), ("http://www.bad.com/a.html",), ("http://bad.com/a?a=1&b=2",), (None,)], "url string")).select("canon")
    got = urls.judged(pages, listed, broadcast_blocks=blocks).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, best = slow(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        if best:
            assert r["verdict"] == best[0]
    hits = {r["page_id"] for r in got if r["listed"]}
    assert hits == {15, 16, 17, 18}


def test_a_full_filter_gives_no_false_positive(spark):
    listed = spark.createDataFrame([(f"h{i}.com/x",) for i in range(500)], "canon string")
    pages = spark.createDataFrame([(i, f"http://h{i}.com/x") for i in range(2000)], "page_id long, url string")
    got = urls.judged(pages, listed, bits_per_url=1).where("listed").count()
    assert got == 500


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "canon string")
    assert urls.judged(pages, none).first()["verdict"] == "allow"
    assert urls.judged(pages.where("false"), none).count() == 0


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "z", "z", "z")], "page_id long, url string, host string, block string, canon string")
    assert urls.judged(pages, pages.select("canon")).first()["host"] == "a.com"
