import re

from postweave.llm.url_filter import RULES, UNWANTED, WANTED, judge


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(len(h + p), -i, h + p, v) for i, (v, h, p) in enumerate(RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def table(spark, urls):
    return spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_whole_table_and_odd_urls_against_plain_python(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "://", "a://b://c/d", "HTTP://WWW.Example.ORG/es/1", "http://example.org", "http://example.org?x=/en/1", "http://notexample.org/es/", "http://org/",
             "http://x.com/fr", "http://x.com/fr/", "ftp://ÄÖ.com/de/#a?b", "http://h\nost.com/de/\nx", "http://example.org/en/1" + "y" * 50_000, "http://a.example.org/en/12#/es/"]
    got = {r.page_id: r for r in judge(table(spark, urls)).collect()}
    for i, url in enumerate(urls):
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
        assert (got[i].score is None) == (rule is not None)


def test_learned_verdicts_on_urls_not_in_training(spark):
    bad = ["https://www.cheap-viagra-pills.test/buy", "http://spam-casino.test/win", "https://free-casino-slots.test/bonus", "http://www.cheap-pills.test/x", "https://link-farm-spam.test/p/1"]
    good = ["https://www.gardenclub.test/events", "https://blog.millstream.test/en/812", "https://docs.riverbank.test/guide", "http://thanion.test/en/512", "https://library.northfield.test/books"]
    verdicts = [r.verdict for r in judge(table(spark, bad + good), rules=[]).orderBy("page_id").collect()]
    assert verdicts.count("block") == 5 and verdicts[:5] == ["block"] * 5
    fitted = [r.verdict for r in judge(table(spark, UNWANTED + WANTED), rules=[]).orderBy("page_id").collect()]
    assert fitted == ["block"] * len(UNWANTED) + ["allow"] * len(WANTED)


def test_empty_table(spark):
    assert judge(table(spark, [])).collect() == []
