"""URL filters: explicit rules, then logistic regression on hashed character n-grams of host and path.  Columns only."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BUCKETS = 4096
GRAMS = (3, 4, 5)
# verdict, host, path: the rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# The small labelled table: URLs written for this purpose, wanted ones and unwanted ones.
WANTED = """
https://news.harbour.example/2024/05/council-vote https://www.riverlight.example/blog/garden-notes http://docs.openfield.example/guide/install.html
https://en.museum.example/collections/maps/12 https://library.stonebridge.example/catalog?item=81 https://m.weathervane.example/en/today
https://blog.thornhill.example/en/453 https://www.tionable.example/en/88.html http://therand.example/fr/120 https://ansteron.example/en/17
https://blog.erandish.example/es/204 http://www.ouredth.example/de/31/ https://inghaven.example/en/960 https://m.stedorin.example/fr/7
https://recipes.kitchenlore.example/soup/lentil https://www.townhall.example/minutes/2023 https://forum.cyclists.example/thread/5521
https://science.openpapers.example/abs/2101.00001 https://school.maple.example/about https://www.orchardpress.example/books/history
https://wiki.tramways.example/Line_4 https://www.birdcount.example/species/heron https://data.census.example/tables/p01
http://www.watermill.example/visit/opening-hours https://status.railnet.example/delays https://help.mailroom.example/en/faq/9
https://www.chessclub.example/games/1972 https://theatre.oldtown.example/programme https://www.hillwalkers.example/routes/north
https://astro.nightsky.example/en/comets https://radio.bluebird.example/shows/morning https://www.linguist.example/grammar/verbs
https://maps.coastpath.example/section/3 https://www.choralsociety.example/concerts https://blog.ndtharen.example/en/615 http://eanthol.example/en/42
https://www.thanation.example/en/700 https://reedand.example/de/53 https://blog.hearnt.example/fr/391 http://m.onerly.example/es/8
https://farm.greenacre.example/seasons https://www.quarry.example/geology/basalt https://dev.toolshed.example/api/reference
https://www.archivist.example/letters/1889 https://photo.lighthouse.example/gallery/12 https://www.debating.example/motions
""".split()
UNWANTED = """
http://www.cheap-meds.example/buy-now https://cheap-pills-online.example/order/cialis http://spam-links.example/page/1 https://best-casino-bonus.example/slots
http://www.free-money-fast.example/win https://hot-singles-tonight.example/chat https://replica-watches-sale.example/cheap
http://pills-discount.example/viagra https://casino-jackpot.example/free-spins https://www.win-prize-now.example/claim http://click-farm.example/ads/1
https://linkfarm-seo.example/backlinks https://www.loan-approved-today.example/apply http://xxx-videos-free.example/watch https://adult-cams.example/live
https://crack-keygen-download.example/serial http://free-movies-torrent.example/dl https://spamfarm.example/en/12 http://spam-farm-two.example/en/88
https://cheap-pills.rx.example/fr/5 https://buy-followers-cheap.example/likes http://miracle-weight-loss.example/pills https://bet-casino-online.example/odds
https://www.phishing-login.example/verify-account http://account-verify-secure.example/password https://cheap-essays-buy.example/order
http://malware-downloads.example/setup.exe https://free-gift-cards.example/claim https://spam-blog-network.example/post/9 http://poker-slots.example/bonus
https://cheapest-viagra.example/buy https://www.pills4cheap.example/en/450 http://farm-of-links.example/spam/3 https://lottery-winner-claim.example/prize
https://www.sex-dating-free.example/join http://clickbait-farm.example/shocking https://instant-cash-loans.example/apply http://fake-diploma-buy.example/order
https://casino-spam.example/en/302 http://cheap-farm-pills.example/de/77 https://www.spam-offers.example/es/61 https://pharma-cheap.example/en/9
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the
    end); both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, field: str) -> Column:
    """Hash buckets of the character n-grams of one field; ``^`` and ``$`` mark its ends."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(framed) - F.lit(n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(field), F.substring(framed, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
    return F.flatten(F.array(*[of_size(n) for n in GRAMS]))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of host and path."""
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def _fit(rows: list[tuple[list[int], int]], rounds: int = 300, rate: float = 0.5, shrink: float = 1e-3) -> list[float]:
    """Logistic regression by gradient steps on the small table; the last weight is the bias."""
    weights = [0.0] * (BUCKETS + 1)
    scale = [1 / math.sqrt(len(x)) for x, _ in rows]
    for _ in range(rounds):
        step: dict[int, float] = {}
        for (x, y), s in zip(rows, scale, strict=True):
            z = weights[-1] + s * sum(weights[i] for i in x)
            error = 1 / (1 + math.exp(-z)) - y
            for i in x:
                step[i] = step.get(i, 0.0) + error * s
            step[BUCKETS] = step.get(BUCKETS, 0.0) + error
        for i, g in step.items():
            weights[i] -= rate * (g / len(rows) * 10 + shrink * weights[i])
    return weights


@cache
def _weights(spark: SparkSession, wanted: tuple[str, ...], unwanted: tuple[str, ...]) -> tuple[float, ...]:
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for y, urls in ((0, wanted), (1, unwanted)) for u in urls) + " AS t(url, y)")
    host, path = host_and_path(F.col("url"))
    table_ = rows.select("url", "y", host.alias("host"), path.alias("path")).select("url", "y", features(F.col("host"), F.col("path")).alias("x"))
    return tuple(_fit([(r.x, r.y) for r in table_.orderBy("url", "y").collect()]))  # the labelled table: fixed and small


def train(spark: SparkSession, wanted: list[str] = WANTED, unwanted: list[str] = UNWANTED) -> tuple[float, ...]:
    """Weights from labelled URLs (a small table kept with the model); the features come from the same columns as in scoring."""
    return _weights(spark, tuple(wanted), tuple(unwanted))


def unwanted_score(host: Column, path: Column, weights: tuple[float, ...]) -> Column:
    """Log-odds that the URL is unwanted."""
    table_ = F.expr("array(" + ",".join(f"{w!r}D" for w in weights[:-1]) + ")")
    found = features(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(table_, i))
    return F.lit(weights[-1]) + total / F.sqrt(F.size(found))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", weights: tuple[float, ...] | None = None) -> DataFrame:
    """Judge every url: (key, host, path, rule, verdict, score).

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest fitting
    rule wins, ties go to the first in the list.  Without a rule, a logistic regression on hashed n-grams of host and path decides: blocked
    above even odds.  Null urls and urls without ``://`` have empty host and path and are judged like any other; other columns
    are ignored; rows stay one to one; an empty table gives no rows.
    """
    spark = urls.sparkSession
    weights = weights or train(spark)
    host, path = host_and_path(F.col(url))
    df = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in reversed(ordered):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    df = df.withColumns({"rule": rule, "by_rule": verdict})
    df = df.withColumn("score", F.when(F.col("rule").isNull(), unwanted_score(F.col("host"), F.col("path"), weights)))
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return df.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
