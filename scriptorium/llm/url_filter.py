"""URL filter: explicit rules first, else logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (``LABELLED`` or the
caller's), by full-batch gradient descent with an L2 penalty, which is deterministic. Features are
the distinct character n-grams of host and path, hashed apart into 2**14 buckets. Only the url column
is read; nothing is shuffled.

Edge cases: null urls and urls without ``://`` have empty host and path, fit no rule and get the
verdict of the model's bias; repeated rows are judged each time; very long urls are read whole; of rules of one
length the first listed wins, and a score that equals the threshold blocks; an empty table gives no rows. Extra columns stay and
change nothing, but for those named host, path, rule, verdict and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
STEPS = 300
RATE = 2.0
PENALTY = 1e-3

#: Rule host, rule path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: The labelled URLs, 1 for those to block.
LABELLED = (
    *((f"https://{h}", 1) for h in (
        "cheap-pills.example.org/buy", "www.cheap-pills.example.net/en/12", "pills-online.example.org/order-now", "casino-win.example.org/en/1", "best-casino.example.net/bonus",
        "m.free-bets.example.org/de/4", "free-bets.example.net/odds", "www.spam-farm.example.org/link", "spam-farm.example.net/en/3", "ads-track.example.org/click?id=4",
        "ads-track.example.net/en/7", "track-ads.example.org/pixel", "win-money-fast.example.net/now", "cheap-watches.example.org/replica", "hot-singles.example.net/chat",
        "adult-video.example.org/xxx", "www.adult-chat.example.net/en/8", "m.adult-pics.example.org/de/27", "poker-slots.example.net/jackpot", "payday-loans.example.org/apply", "free-casino-bonus.example.net/spin", "click-farm.example.org/traffic",
        "viagra-pills.example.net/cheap", "seo-links.example.org/buy-links", "betting-tips.example.net/free", "malware-download.example.org/crack.exe", "keygen-warez.example.net/free",
        "blog.cheap-pills.example.net/de/5/", "blog.casino-win.example.org/fr/88.html", "blog.free-bets.example.org/en/7", "blog.spam-farm.example.net/es/30/", "www.ads-track.example.net/de/61.html",
    )),
    *((f"https://{h}", 0) for h in (
        "www.library.example.org/catalogue/12", "news.example.net/en/2021/story.html", "blog.garden.example.org/roses", "docs.example.net/guide/install", "museum.example.org/de/exhibitions",
        "www.university.example.net/research", "m.weather.example.org/en/today", "recipes.example.net/fr/soup.html", "blog.travel.example.org/en/14/", "history.example.net/articles/97",
        "www.theatre.example.org/en/programme", "physics.example.net/lectures/3", "wiki.example.org/en/mathematics", "blog.then.example.net/en/853", "them.example.org/de/144.html",
        "m.other.example.net/en/25", "www.nation.example.org/en/471", "blog.thesis.example.net/de/9", "station.example.org/en/453", "thing.example.net/de/252.html",
        "www.motion.example.org/en/618", "reading.example.net/en/260", "blog.herald.example.org/es/10", "ration.example.org/fr/414", "anthem.example.net/de/797",
        "m.garden.example.org/en/31", "m.history.example.net/de/57.html", "m.then.example.org/fr/6/", "m.harvest.example.net/es/19", "m.thistle.example.org/en/88", "www.theses.example.net/en/39", "thicket.example.net/en/116",
    )),
)


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of ^host$ and ^path$."""
    found = set()
    for part, text in (("h", host), ("p", path)):
        t = f"^{text}$"
        for n in GRAMS:
            found.update(t[i : i + n] + part for i in range(len(t) - n + 1))
    return np.fromiter({xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in found}, dtype=np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the columns of ``judge`` have them."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def train(labelled: Iterable[tuple[str, int]] = LABELLED) -> np.ndarray:
    """Weights of the buckets, the bias last."""
    x = [features(*split_url(u)) for u, _ in labelled]
    y = np.array([v for _, v in labelled], dtype=np.float64)
    w = np.zeros(BUCKETS + 1)
    for _ in range(STEPS):
        z = np.array([w[f].sum() / np.sqrt(len(f) + 1.0) + w[-1] for f in x])
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = PENALTY * w
        g[-1] = d.sum()
        for f, e in zip(x, d, strict=True):
            g[f] += e / np.sqrt(len(f) + 1.0)
        w -= RATE * g
    return w


def score_udf(weights: np.ndarray):
    """The probability that a (host, path) is to be blocked."""
    w = weights.astype(np.float64)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            z = np.array([w[f].sum() / np.sqrt(len(f) + 1.0) + w[-1] for f in map(features, hosts, paths)], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return F.pandas_udf(score, "double")


def host_column(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules=RULES, labelled: Iterable[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """pages' columns with host, path, rule, verdict, and the model's score."""
    out = pages.withColumn("host", host_column(F.col("url"))).withColumn("path", path_column(F.col("url")))
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
    rule = verdict = None
    for h, p, v in ordered:
        fit = fits(h, p)
        rule = F.when(fit, h + p) if rule is None else rule.when(fit, h + p)
        verdict = F.when(fit, v) if verdict is None else verdict.when(fit, v)
    out = out.withColumn("score", score_udf(train(labelled))("host", "path"))
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumn("rule", rule if ordered else F.lit(None).cast("string")).withColumn("verdict", F.coalesce(verdict, model) if ordered else model)


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
