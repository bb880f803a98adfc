"""URL filters by association rules.

Labelled URLs become sets of tokens; FP-growth mines the token combinations
that go with bad ones. Rules with enough support and confidence, and no shorter
rule that is as sure, are kept. Each is indexed under its rarest token, so a
URL is held only against the rules of its own tokens.
"""

from __future__ import annotations

import itertools

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpointed

#: The least part of the labelled URLs that hold a rule's tokens and are bad.
MIN_SUPPORT = 0.002
#: The least part of the labelled URLs with a rule's tokens that are bad.
MIN_CONFIDENCE = 0.9
#: That part must also be over one half by so many standard errors (Wilson's lower bound), as many combinations are tried.
STANDARD_ERRORS = 2.5
#: Words that public block lists have for hosts: an example of seeds, which nothing uses unless asked to.
SEEDS = ("casino", "bets", "adult", "porn", "pills", "viagra", "spam", "ads", "malware", "phish", "warez")
_BAD = "!bad"


def tokens(url: Column) -> Column:
    """The distinct words of a URL, each with the part that it is from; numbers are one word."""
    low = F.lower(F.trim(url))
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.\-]*:(//)?", "")
    host, tail = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.\-]*):", 1)

    def words(part: Column, tag: str) -> Column:
        named = F.transform(F.split(F.regexp_replace(part, r"\d+", "0"), r"[^\p{L}\p{N}]+"), lambda w: F.when(w != "", F.concat(F.lit(tag), w)))
        return F.filter(named, lambda w: w.isNotNull())

    return F.array_distinct(F.concat(words(scheme, "s:"), words(host, "h:"), words(tail, "p:"), words(query, "q:")))


def labelled(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """(url, bad) of the pages whose document is labelled; the URL's path names the document.

    A page is bad if its document is of low quality or toxic, and if its host
    holds one of the seeds, should any be given. Null URLs and doc_ids and
    labels that say nothing are left out; contradicting labels count as bad;
    repeated pages count as often as they are there. URLs are read whole,
    however long; other columns are ignored, whatever their names.
    """
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    named = F.regexp_extract(path, r"/(\d{1,18})(?:[/.?#]|$)", 1)
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(bad).alias("bad_doc"))
    urls = pages.where("url is not null").select("url", F.when(named != "", named.cast("long")).alias("doc_id"))
    seeded = F.exists(tokens(F.col("url")), lambda t: t.isin([f"h:{w}" for w in seeds])) if seeds else F.lit(False)
    return urls.join(known, "doc_id").select("url", (F.col("bad_doc") | seeded).alias("bad"))


def mined(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of the rules that labelled URLs (url, bad) bear out.

    support is that of tokens and bad together. A rule goes if one with fewer
    of its tokens is at least as confident. Null URLs and labels teach nothing;
    every labelled URL counts, repeated ones as often as they are there.
    """
    items = F.when(F.col("bad"), F.concat(tokens(F.col("url")), F.array(F.lit(_BAD)))).otherwise(tokens(F.col("url")))
    sets = checkpointed(urls.where("url is not null and bad is not null").select(items.alias("items"), "bad"))
    n = sets.count()
    if not n or not sets.where("bad").count():
        return []
    alike, implied = together(sets, min_support * n)
    # only combinations that are frequent with bad can be rules, so those are mined among the bad;
    # how many good URLs hold them is counted after
    first = F.lit([*(x for x, own in alike.items() if x == own[0]), _BAD])
    bad = sets.where("bad").select(F.array_intersect("items", first).alias("items"))
    share = min(1.0, min_support * n / bad.count())
    frequent = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(bad).freqItemsets
    some = frequent.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", _BAD)).alias("rule"), F.col("freq").alias("bad_n"))
    free = F.udf(lambda rule: all(implied.get(x, frozenset()).isdisjoint(rule) for x in rule), "boolean")
    some = checkpointed(some.where(free("rule")))
    rarest = sets.select(F.explode("items").alias("token")).groupBy("token").count()
    posted = some.withColumn("token", F.explode("rule")).join(rarest, "token").groupBy("rule", "bad_n").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    hits = sets.where("not bad").select("items", F.explode("items").alias("token")).join(posted, "token").where(F.size(F.array_except("rule", "items")) == 0)
    good = hits.groupBy("rule").agg(F.count("*").alias("good_n"))
    rules = some.join(good, "rule", "left").select("rule", "bad_n", (F.col("bad_n") / (F.col("bad_n") + F.coalesce("good_n", F.lit(0)))).alias("confidence"))
    z2 = STANDARD_ERRORS**2
    c, m = F.col("confidence"), F.col("bad_n") / F.col("confidence")
    low = (c + z2 / (2 * m) - STANDARD_ERRORS * F.sqrt(c * (1 - c) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    found = rules.where((c >= min_confidence) & (low >= 0.5)).collect()
    kept = pruned([(list(r.rule), r.confidence, r.bad_n / n) for r in found])
    out = [(sorted(t), c, s) for rule, c, s in kept for t in itertools.product(*(alike[x] for x in rule))]
    return sorted(out, key=lambda r: (len(r[0]), r[0]))


def together(sets: DataFrame, least: float) -> tuple[dict[str, list[str]], dict[str, frozenset[str]]]:
    """Of the tokens that at least so many bad sets hold: those that are in the same sets as each, itself among them, and those that are in all of its sets.

    A combination of a token and one that is in all of its sets has the counts
    of the one without the latter, so it never stays a rule. Of tokens that are
    in the same sets, one is mined for all.
    """
    often = sets.where("bad").select(F.explode("items").alias("a")).where(F.col("a") != _BAD).groupBy("a").count().where(F.col("count") > least - 1)
    names = sorted(r.a for r in often.collect())
    held = sets.select(F.array_intersect("items", F.lit(names) if names else F.array().cast("array<string>")).alias("own"))
    pairs = held.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b")).groupBy("a", "b").count()
    total = pairs.where("a = b").select("a", F.col("count").alias("n"))
    always: dict[str, set[str]] = {x: {x} for x in names}
    for r in pairs.join(total, "a").where("count = n").select("a", "b").collect():
        always[r.a].add(r.b)
    alike = {x: sorted(y for y in own if x in always[y]) for x, own in always.items()}
    return alike, {x: frozenset(own - {x}) for x, own in always.items()}


def pruned(rules: list[tuple[list[str], float, float]]) -> list[tuple[list[str], float, float]]:
    """The rules of which no proper part is a rule that is as confident."""
    kept: dict[str, list[tuple[frozenset, float]]] = {}
    out = []
    for t, c, s in sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]))):
        own = frozenset(t)
        # a part that went has a part of its own that stayed and is as confident
        if not any(sure >= c and part < own for x in own for part, sure in kept.get(x, ())):
            kept.setdefault(min(t), []).append((own, c))
            out.append((sorted(t), c, s))
    return out


def matched(pages: DataFrame, rules: list[tuple[list[str], float, float]]) -> DataFrame:
    """(page_id, url, n_rules, confidence, rule) of each page that a rule matches; rule is the most confident, of equals the shortest, then the first.

    Repeated rows are reported once. A null or empty URL matches nothing; URLs
    are read whole. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    urls = pages.where("url is not null").select("page_id", "url", tokens(F.col("url")).alias("items"))
    if not rules:
        return urls.where("false").select("page_id", "url", F.lit(0).cast("long").alias("n_rules"), F.lit(0.0).alias("confidence"), F.col("items").alias("rule"))
    # a rule is posted under the token with which the fewest rules would be read in vain
    uses: dict[str, int] = {}
    for t, _, _ in rules:
        for x in t:
            uses[x] = uses.get(x, 0) + 1
    index = spark.createDataFrame([(min(t, key=lambda x: (x[:2] != "h:", uses[x], x)), t, c) for t, c, _ in rules], "token string, rule array<string>, sure double")
    if sum(sum(map(len, t)) + 64 for t, _, _ in rules) <= BROADCAST_BYTES:
        index = F.broadcast(index)
    hits = urls.withColumn("token", F.explode("items")).join(index, "token").where(F.size(F.array_except("rule", "items")) == 0)
    return hits.groupBy("page_id", "url").agg(
        F.countDistinct("rule").alias("n_rules"), F.max("sure").alias("confidence"), F.min_by("rule", F.struct(-F.col("sure"), F.size("rule"), F.array_join("rule", " "))).alias("rule")
    )


def blocked(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """matched pages under the rules mined from the labels, and from the seeds, should any be given.

    If the labels bear out no rule, no page is blocked.
    """
    return matched(pages, mined(labelled(pages, labels, seeds)))
