import re

from pyspark.sql import functions as F

from lanternlake.llm import urls

URLS = [
    "http://A.Example.NET/en/x", "http://example.net/de/", "https://example.net", "http://net/", "http://xnet/", "net/",
    "http://www.example.com/de/a?b", "http://example.com/de", "http://www.x.org/fr/#c", "ftp://o.org/fr/", "http://org?fr/", None, "",
    "http://", "a://b://c.net/", "http://user@h.net:80/", "http://h.net/?/en/", "http://.net/", "http://example.net/en/" + "p" * 5000,
    "http://" + "a." * 400 + "net/q", "http://ex\nample.net/en/",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p) and "://" in (url or "")
    ]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def check(spark, rules):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])], "page_id long, url string")
    df = df.withColumn("rule", F.lit("clash"))
    got = urls.judge(df, urls.rules_table(spark, rules)).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert tuple(r)[2:] == brute(r.url, rules), r.url


def test_contract(spark):
    check(spark, urls.CONTRACT_RULES)


def test_other_rules(spark):
    check(spark, [("block", "b", "/"), ("allow", "net", "/e"), ("block", "net", "/e"), ("allow", "h.net:80", "/"), ("block", "example.net", "/en/ppp")])


def test_empty_and_native(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.op6(df.limit(0)).count() == 0
    none = urls.rules_table(spark).limit(0)
    assert urls.judge(df, none).first()["verdict"] == "allow"
    assert "Python" not in urls.op6(df.select("*"))._jdf.queryExecution().toString().replace("PythonRDD", "")
