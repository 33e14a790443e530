"""URL filter: prefix rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled URLs the default model is trained on.
LABELLED_BLOCK = (
    "http://casino-royal.example.info/play", "https://www.online-casino.example.biz/en/12",
    "http://best-casino-win.example.info/en/slots", "https://poker-win.example.biz/de/4410",
    "http://lucky-slots.example.info/spin/777", "https://betting-tips.example.biz/en/903.html",
    "http://free-bets-now.example.info/odds", "https://sport-bets.example.biz/fr/77/",
    "https://m.bet-win.example.info/free", "http://jackpot-winner.example.biz/es/31?page=2",
    "http://cheap-pills.example.info/order", "https://www.pills-online.example.biz/en/18820",
    "https://cheap-meds.example.info/pharmacy", "http://no-prescription-pills.example.biz/play",
    "https://diet-pills.example.info/lose-weight", "http://viagra-cheap.example.biz/order",
    "http://adult-video.example.info/xxx/1", "https://xxx-tube.example.biz/bonus/100",
    "http://adult-x-cams.example.info/live", "https://hot-porn.example.biz/en/5",
    "http://sexy-dating.example.info/join", "https://adult-dating.example.biz/en/12",
    "http://ads-server.example.info/banner/728", "https://ad-track.example.biz/de/4410",
    "https://click-track.example.info/redirect", "http://ads-click.example.biz/en/903.html",
    "http://popup-ads.example.info/pop", "https://tracker-ads.example.biz/fr/77/",
    "http://spam-blog.example.info/post/1", "https://link-farm.example.biz/es/31?page=2",
    "http://seo-spam-farm.example.info/backlinks", "https://spam-links.example.biz/en/18820",
    "http://free-money.example.info/win", "https://get-rich-quick.example.biz/play",
    "http://payday-loans.example.info/apply", "https://cheap-replica-watches.example.biz/order",
    "http://free-download-crack.example.info/keygen", "https://warez-crack.example.biz/bonus/100",
    "http://win-a-prize.example.info/claim", "https://free-gift-card.example.biz/en/5",
)
LABELLED_ALLOW = (
    "https://www.daily-news.example.info/world/2021", "http://news.example.edu/campus/article/12",
    "https://en.encyclopedia.example.info/wiki/River", "http://docs.example.dev/guide/install",
    "https://library.example.edu/catalog/8812", "http://www.city-council.example.gov/services",
    "https://museum.example.info/exhibitions/2020", "http://recipes.example.info/soup/onion",
    "https://blog.gardening.example.info/roses", "http://forum.cycling.example.info/thread/310",
    "https://www.school.example.edu/courses/math", "http://weather.example.gov/forecast",
    "https://shop.books.example.info/history/42", "http://m.travel.example.info/italy/rome",
    "https://research.example.edu/papers/1093", "http://www.hospital.example.info/visitors",
    "https://blog.chess.example.info/openings", "http://music.example.info/composers/bach",
    "https://www.bakery.example.info/about", "http://maps.example.info/en/1204",
    "https://archive.example.edu/de/448", "http://blog.photography.example.info/fr/77",
    "https://m.theatre.example.info/es/905", "http://www.university.example.edu/en/3310.html",
    "https://astronomy.example.edu/stars/vega", "http://parks.example.gov/trails/",
    "https://www.orchestra.example.info/season", "http://open-data.example.gov/sets/55",
    "https://kitchen.example.info/bread?page=2", "http://the-herald.example.info/en/9021",
    "https://literature.example.edu/poems/14", "http://history.example.info/de/610.html",
    "https://www.football-club.example.info/team", "http://blog.teaching.example.info/en/31",
    "https://hiking.example.info/alps/route/9", "http://language.example.edu/fr/lessons/3",
    "https://physics.example.edu/lectures/7", "http://www.family.example.info/es/280",
    "https://m.painting.example.info/en/76", "http://health-service.example.gov/clinics",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (
        F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER),
        F.regexp_extract(url, shape, 2),
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule ``host/path`` that fits; null where none does.

    A rule fits its host and that host's subdomains if the path starts with the rule's. Of two
    rules of one text the first given counts.
    """
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column) -> Column:
    """Marked character n-grams of host and path; digits count as one character."""

    def cut(chars: Column, mark: str) -> Column:
        # By place in the array of characters: a substring would count from the start each time.
        def at(n: int):
            return lambda _, i: F.concat(F.lit(mark), *(F.get(chars, i + k) for k in range(n)))

        whole = [F.filter(F.transform(chars, at(n)), lambda g: g.isNotNull()) for n in SIZES]
        return F.concat(*whole)

    def of(text: Column, mark: str) -> Column:
        text = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        return F.flatten(F.transform(F.array(F.split(text, "")), lambda chars: cut(chars, mark)))

    return F.concat(of(host, "h:"), of(path, "p:"))


def _features(urls: DataFrame) -> DataFrame:
    """Adds host, path and the hashed n-grams ``__x``."""
    host, path = host_and_path(F.col("url"))
    parts = urls.withColumns({"host": host, "path": path})
    parts = parts.withColumn("__grams", ngrams(F.col("host"), F.col("path")))
    hashing = HashingTF(inputCol="__grams", outputCol="__x", numFeatures=BUCKETS, binary=True)
    return hashing.transform(parts).drop("__grams")


def default_labelled(spark: SparkSession) -> DataFrame:
    rows = [(u, 1.0) for u in LABELLED_BLOCK] + [(u, 0.0) for u in LABELLED_ALLOW]
    return spark.createDataFrame(rows, "url string, label double")


def train(labelled: DataFrame, reg: float = 0.003, iterations: int = 60) -> LogisticRegressionModel:
    """``labelled``: url, label (1: block), a small table. Rows without label are left out."""
    rows = _features(labelled.filter(F.col("label").isNotNull())).select("__x", "label")
    return LogisticRegression(featuresCol="__x", labelCol="label", regParam=reg, maxIter=iterations).fit(rows)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    model: LogisticRegressionModel,
    threshold: float = 0.5,
    key: str = "page_id",
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score (probability of block).

    The longest fitting rule decides, else the score: block from ``threshold`` on. A null url has
    empty host and path and is judged by the model like any other. Only ``key`` and ``url`` are
    read; nothing is shuffled.
    """
    scored = model.transform(_features(pages.select(F.col(key), "url")))
    score = vector_to_array("probability")[1]
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.select(
        key,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
