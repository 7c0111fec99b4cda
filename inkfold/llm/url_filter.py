"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Host and path are cut out of the url; a rule fits a host and its subdomains if the path starts with the rule's, and the
longest fitting rule decides. Urls without a rule are judged by a logistic regression that is trained on a small
labelled table when the operator runs. All work is done by SQL functions and the JVM's own learning library; urls are
judged where they are read, without a shuffle, so a very common host costs nothing extra.

Null urls and urls without `://` have an empty host and path; no rule fits them and the model judges the empty name.
Very long urls are judged whole, in time that grows with their length. Of two rules of one length that both fit, the one
that sorts first decides; a probability of exactly one half allows. Repeated rows get a row each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
NGRAMS = (3, 4, 5)
BUCKETS = 1 << 14
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The labelled table: names of hosts, most with a path. Block: gambling, pills, loans, adult, adverts, pirated goods.
BLOCKED = """
casino-royal.net/play best-casino.org/slots online-casino.info/bonus casinowin.org/win poker-win.net/join
win-big.org/prize free-bets.net/sport sportsbets.org/odds bets-online.net/live betting-tips.org/free jackpot.net/slots
slots-free.org/spin lottery-win.info/prize cheap-pills.net/buy pills-online.org/order cheap-meds.net/buy
viagra-cheap.org/buy pharmacy-pills.info/sale discount-pills.net/offer diet-pills.org/free payday-loans.net/apply
cheap-loans.org/now fast-loan.info/apply free-credit.net/loan adult-cams.org/live xxx-video.net/free sex-dates.info/join
escort-girls.org/city ads-server.net/click track-ads.org/pixel adstrack.info/banner click-tracker.net/ads
ad-banner.org/pop popup-ads.net/click tracking-pixel.org/t adclicks.info/redirect free-crack.net/keygen
warez-free.org/download keygen-crack.info/serial torrent-free.net/movies cheap-replica.org/watches
replica-bags.net/sale free-gift.org/win hack-tool.info/cheats seo-links.net/buy cheap-followers.org/buy
www.casino-slots.example.net/en/1204 m.adult-video.example.org/de/77.html www.adult-films.org/fr/9 m.cheap-loans.example.net/es/450/
ads-click.example.org/en/31 www.poker-bets.example.net/de/8080 pills-cheap.example.org/fr/605/ blog.xxx-free.example.net/en/2
""".split()
ALLOWED = """
citylibrary.org/catalogue national-museum.net/visit university.org/research science-journal.net/article/12
weather.org/today dailyherald.net/news/2024 morningpost.org/world history-archive.net/letters gardening.org/roses
recipes.net/bread travelnotes.org/lisbon theatre.net/season schoolboard.org/calendar health.net/heart
research-institute.org/papers citycouncil.net/minutes bookreview.org/fiction artgallery.net/modern nature.org/birds
oceanography.net/tides communitynews.org/local railwaystation.net/times mountains.org/routes chessclub.net/lessons
orchestra.org/concerts botany.net/ferns kindergarten.org/parents astronomy.net/comets engineering.org/bridges
parliament.net/debates lighthouse.org/history northerntimes.net/weather translation.org/glossary
theeveningreader.net/essays therestoration.org/notes anthology.net/poems otherhand.org/tools
thinkingaloud.net/posts nationalparks.org/trails blog.winterly.net/entry m.herenow.org/story
www.thoreau.org/walden blog.rationale.net/logic m.stationery.org/paper www.onion.org/soup edition.net/front
thatcher.org/memoirs www.thatched.net/cottages ththeory.org/lemma youth.org/club www.earthly.net/soil northern.org/lights
fourthestate.net/columns leather.org/boots healthed.net/courses truthhand.org/essays southwharf.net/boats width.org/units
breathless.net/film othello.org/play lengthly.net/letters thesaurus.org/words depthsea.net/dives blacksmith.org/forge
www.example.org/en/1204 m.example.net/de/77.html blog.example.org/fr/9 example.net/es/450/ www.station.example.org/en/31
m.northern.example.net/de/8080 thread.example.org/fr/605/ blog.wither.example.net/en/2 tables.example.org/en/77/ shore.example.net/it/4
www.thatwhich.example.org/en/512/ mouth.example.net/de/66 theshore.example.org/de/19/ blog.father.example.org/es/7303
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null if none fits."""
    rule = verdict = None
    for name, start, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = NGRAMS) -> Column:
    """Distinct character n-grams of the host (with its ends marked) and of the path (marked as such)."""
    def runs(mark: str, chars: Column, n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), *[chars[i + j] for j in range(n)]))

    def grams(mark: str, text: Column) -> Column:
        # the characters are bound once, and taken by place: substring() would count from the start each time
        chars = F.transform(F.array(F.struct(F.split(text, "").alias("c"))), lambda x: F.concat(*[runs(mark, x["c"], n) for n in sizes]))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(chars[0])

    texts = [("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)]
    return F.array_distinct(F.concat(*[grams(mark, text) for mark, text in texts]))


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: block)."""
    rows = ", ".join(f"('http://{u}', {y})" for y, own in ((1.0, BLOCKED), (0.0, ALLOWED)) for u in own)
    return spark.sql(f"SELECT url, CAST(label AS DOUBLE) AS label FROM VALUES {rows} AS t(url, label)")


def _features(df: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features")
    return hashing.transform(df.withColumn("__grams", ngrams(F.col("host"), F.col("path"))))


def train(table: DataFrame) -> LogisticRegressionModel:
    """A model from a labelled table (url, label); it is meant to be small and is read in one partition."""
    host, path = host_and_path(F.col("url"))
    rows = _features(table.coalesce(1).select("label", host.alias("host"), path.alias("path")))
    count = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    # both verdicts weigh the same
    weight = F.when(F.col("label") == 1, 1 / count.get(1.0, 1)).otherwise(1 / count.get(0.0, 1)) * F.lit(sum(count.values()) / 2)
    model = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="weight", regParam=0.01, maxIter=40)
    return model.fit(rows.withColumn("weight", weight))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, table: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the model's probability)."""
    model = train(labelled(pages.sparkSession) if table is None else table)
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    model.setProbabilityCol("__probability").setPredictionCol("__prediction").setRawPredictionCol("__raw")
    scored = model.transform(_features(cut)).withColumn("p_block", vector_to_array("__probability")[1])
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "p_block")
