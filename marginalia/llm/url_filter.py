"""URL filter: an allow/block list in front of logistic regression on hashed character n-grams of host and path.

Native: SQL functions judge every url inside its scan; nothing is shuffled. Spark ML fits the model on the small
labelled table, whose features the same SQL functions make, and the weights (2**11 numbers, whatever the input) go
into the plan as one literal.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path is the rest up
to `?`, `#` or the end. A rule `host/path` fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's; the longest fitting rule decides, and the model decides where none fits.

Nulls and edge cases: a null url, or one without `://`, has an empty host and path; the model then judges by its
intercept. Repeated rows are judged each; very long urls take time in proportion to their length; an empty table
gives no rows. The rules are a list in the driver's memory, meant for up to a few hundred.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 1 << 11, (3, 4, 5)

# The contract's rules, and a small labelled table of invented urls.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ALLOWED = """https://www.cityhistory.org/articles/old-harbour.html
https://news.northpaper.net/world/2021/05/report
https://docs.opentools.org/guide/install.html
https://en.freecyclopedia.org/wiki/Granite
https://blog.gardenplants.org/roses/pruning
https://library.stateuni.edu/catalog/physics
http://www.mathnotes.edu/algebra/groups.pdf
https://recipes.slowkitchen.net/soup/lentil
https://www.museum-of-glass.org/visit/hours
https://forum.birdwatch.net/topic/1182
https://research.oceanlab.edu/papers/currents
https://www.localcouncil.gov/services/waste
https://weather.mountainview.net/forecast/week
https://school.riverside.edu/courses/biology
https://www.trainmuseum.org/engines/steam
https://medium-reads.net/essays/on-walking
https://api.devhandbook.org/reference/http
https://archive.countypapers.org/1911/march/7
https://health.clinic.gov/advice/vaccines
https://www.classicalradio.org/programme/evening
https://stories.bookshelf.net/chapter/12
https://dev.codejournal.org/posts/sorting.html
https://www.geologytoday.net/volcano/iceland
https://help.postoffice.gov/letters/abroad
http://www.chessclub.org/games/annotated
https://data.statistics.gov/tables/population
https://lectures.openphysics.edu/waves/3
https://hiking.trailmap.net/routes/valley
https://www.linguistics.edu/grammar/verbs
https://art.gallerynotes.org/painters/dutch""".split("\n")
BLOCKED = """http://best-casino-bonus.biz/free-spins/win
http://xxx-hot-cams.info/live/girls
http://cheap-pills-online.biz/viagra/order
http://freecracks.download/keygen/warez.exe
http://poker-jackpot.win/casino/slots
http://adult-dating-now.info/xxx/signup
http://buy-followers.click/cheap/likes
http://secure-login-verify.info/bank/account/update
http://hotsex-videos.xxx/porn/free
http://win-big-bets.biz/betting/bonus
http://torrent-pirate.click/download/movie.torrent
http://payday-loans-fast.biz/apply/cash
http://replica-watches.biz/cheap/rolex
http://miracle-diet-pills.info/lose-weight/buy
http://crypto-doubler.click/invest/free-bitcoin
http://casino-slots.win/bonus/register
http://porn-tube.xxx/watch/hot
http://escort-girls.info/xxx/city
http://free-iphone-winner.click/claim/prize
http://malware-update.download/flash/setup.exe
http://essay-cheap.biz/buy/homework
http://live-betting.win/poker/odds
http://viagra-discount.biz/pills/cheap
http://verify-account.click/login/password
http://warez-cracks.download/serial/keygen
http://hot-singles.info/adult/chat
http://seo-backlinks.biz/buy/links
http://jackpot-lotto.win/prize/claim
http://cams-xxx.click/girls/free
http://steroids-shop.biz/order/cheap""".split("\n")


def labelled(spark: SparkSession) -> DataFrame:
    """The small table: url, label (1: block)."""
    rows = json.dumps([{"url": u, "label": y} for y, urls in ((0.0, ALLOWED), (1.0, BLOCKED)) for u in urls])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url string, label double>>")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def _grams(kind: str, text: Column, sizes: Sequence[int], buckets: int) -> Column:
    """Buckets of the n-grams of a text between two marks."""
    chars = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")

    def grams(c: Column, n: int) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.pmod(F.xxhash64(F.lit(kind), *[F.get(c, i + j) for j in range(n)]), F.lit(buckets)).cast("int"))
        return F.when(F.size(c) >= n, hashed).otherwise(F.expr("cast(array() as array<int>)"))

    def of(c: Column) -> Column:
        return F.concat(*[grams(c, n) for n in sizes])

    # the split is made once: transform over a one-element array binds it
    return F.get(F.transform(F.array(chars), of), 0)


def _features(df: DataFrame, host: str, path: str, sizes: Sequence[int], buckets: int) -> DataFrame:
    return df.withColumn("__grams", F.concat(_grams("h", F.col(host), sizes, buckets), _grams("p", F.col(path), sizes, buckets)))


class UrlModel:
    """weights and intercept over the share that each bucket has of a url's n-grams."""

    def __init__(self, weights: list[float], intercept: float, sizes: Sequence[int]):
        self.weights, self.intercept, self.sizes = weights, intercept, tuple(sizes)

    @classmethod
    def fit(cls, table: DataFrame, url_col: str = "url", label_col: str = "label", sizes: Sequence[int] = SIZES, buckets: int = BUCKETS, reg: float = 1e-5) -> UrlModel:
        """table: a small one; its rows without a url or label don't count."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        host, path = host_and_path(F.col(url_col))
        rows = table.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("label"))
        rows = _features(rows, "host", "path", sizes, buckets)
        n = F.greatest(F.size("__grams"), F.lit(1))
        share = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter("__grams", lambda g: g == b)) / n)
        rows = rows.select("label", array_to_vector(share.cast("array<double>")).alias("features")).orderBy("label").coalesce(1)
        model = LogisticRegression(maxIter=50, regParam=reg, standardization=False).fit(rows)
        return cls([float(x) for x in model.coefficients], float(model.intercept), sizes)

    def score(self, df: DataFrame, host: str, path: str, out: str) -> DataFrame:
        """Adds the probability of `block`."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        df = _features(df, host, path, self.sizes, len(self.weights))
        total = F.aggregate("__grams", F.lit(0.0), lambda s, g: s + F.get(weights, g))
        margin = total / F.greatest(F.size("__grams"), F.lit(1)) + F.lit(self.intercept)
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).drop("__grams")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        on, slash, below = text.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """id_col, url, host, path, rule, verdict and score (the model's probability of `block`) of every row."""
    host, path = host_and_path(F.col("url"))
    df = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("url")).select("__id", "url", host.alias("host"), path.alias("path"))
    df = model.score(df, "host", "path", "score")
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.select(F.col("__id").alias(id_col), "url", "host", "path", rule.alias("rule"), F.coalesce(says, by_model).alias("verdict"), "score")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of pages under the contract's rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, UrlModel.fit(labelled(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
