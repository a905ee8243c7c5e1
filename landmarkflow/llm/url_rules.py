"""URL filters: listed rules first, association rules over URL tokens for the rest.

FP-growth finds token combinations that go with a label; those with enough support and
confidence, a link to the label that chance does not explain, and no shorter one as good,
become rules. Rules are kept
as an inverted index from token to rule: a rule fires when all its tokens are met.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listed rules: verdict, host, path. A rule covers its host and all subdomains.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"),
          ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCK = "=block"


@dataclass(frozen=True)
class UrlParams:
    """Support is a share of the labelled URLs, ``min_urls`` a least number of them that a
    rule blocks rightly; confidence is the share of a rule's URLs labelled block. ``error`` is
    the chance of any rule at all where labels do not depend on the URL."""

    min_support: float = 0.002
    min_urls: int = 20
    error: float = 0.01
    min_confidence: float = 0.8
    max_tokens: int = 3


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and for URLs without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER),
            F.regexp_extract(url, PARTS, 2))


def listed(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """Longest listed rule that fits, and its verdict; null where none does.

    ``rules`` is a configuration of a few entries and becomes one expression.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, on, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        name = F.when(fits, F.lit(on + under)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` labels of the host with their level, ``p:`` words of the path.

    Runs of digits become ``#``, so numbers do not make tokens of their own.
    """
    host, path = split_url(url)
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.split(F.regexp_replace(path, "[0-9]+", "#"), r"[^\p{L}#]+"),
                        lambda x: F.concat(F.lit("p:"), F.translate(x, UPPER, LOWER)))
    return F.array_distinct(F.filter(F.concat(hosts, words), lambda x: ~x.rlike("^[hp][0-9]*:$")))


def surprise(total: int, blocked: int) -> Column:
    """Least negative log of the chance that as many of a rule's URLs are blocked though
    labels do not depend on them (Chernoff's bound of the tail, right for small counts too);
    0 where a rule blocks no more often than the rest.

    ``support`` and ``confidence`` give the URLs with the rule and those of them to block.
    """
    base = blocked / total
    met = F.round(F.col("support") * total / F.col("confidence"))
    c = F.col("confidence")
    rest = F.when(c < 1.0, (1.0 - c) * F.ln((1.0 - c) / (1.0 - base))).otherwise(0.0)
    return F.when(c > base, met * (c * F.ln(c / base) + rest)).otherwise(0.0)


def mine_rules(labelled: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """(rule_id, items, confidence, support) from rows with ``url`` and ``block`` (boolean).

    Null labels are left out; repeated rows count as often as they are given. A rule has to
    exceed the share of blocked URLs by more than chance allows, at ``error`` divided by the
    number of combinations looked at. It is dropped if a rule on part of its tokens has at least its
    confidence. No labelled row, or none to block, gives none.
    """
    rows = labelled.filter("block is not null").select(
        F.when(F.col("block"), F.array_append(tokens(F.col("url")), F.lit(BLOCK)))
        .otherwise(tokens(F.col("url"))).alias("items")).filter("size(items) > 0")
    total, blocked = rows.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    support = max(params.min_support, params.min_urls / max(total, 1))
    if support > 1.0 or blocked in (0, total):  # nothing can be told apart
        return labelled.sparkSession.createDataFrame(
            [], "rule_id string, items array<string>, confidence double, support double")
    mined = FPGrowth(itemsCol="items", minSupport=support,
                     minConfidence=params.min_confidence).fit(rows)
    tried = mined.freqItemsets.filter(~F.array_contains("items", BLOCK)
                                      & (F.size("items") <= params.max_tokens)).count()
    limit = log(max(tried, 1) / params.error)
    rules = mined.associationRules.filter(
        (F.col("consequent")[0] == BLOCK) & (F.size("antecedent") <= params.max_tokens)
        & (surprise(total, blocked) >= limit)).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support")
    # A shorter rule is met through one of its tokens, so the comparison is an equality join.
    each = rules.select("items", "confidence", F.explode("items").alias("t"))
    short = rules.select(F.col("items").alias("si"), F.col("confidence").alias("sc"),
                         F.col("items")[0].alias("t"))
    worse = (each.join(short, "t").filter(
        (F.size("si") < F.size("items")) & (F.col("sc") >= F.col("confidence"))
        & (F.size(F.array_except("si", "items")) == 0)).select("items").distinct())
    kept = rules.join(worse, "items", "left_anti")
    return kept.select(F.sha2(F.concat_ws("\n", "items"), 256).alias("rule_id"), "items",
                       "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, confidence): the best rule of every distinct URL that meets one."""
    index = rules.select("rule_id", "confidence", F.size("items").alias("size"),
                         F.explode("items").alias("token"))
    met = (urls.select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
           .join(index, "token").groupBy("url", "rule_id")
           .agg(F.count("*").alias("n"), F.first("size").alias("size"),
                F.first("confidence").alias("confidence")).filter("n = size"))
    return met.groupBy("url").agg(F.max(F.struct("confidence", "rule_id")).alias("best")).select(
        "url", F.col("best.rule_id").alias("rule_id"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, params: UrlParams = UrlParams(),
               rules=LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the id of a mined rule that fired, or null).

    A listed rule decides where one fits; else a mined rule blocks and anything
    else is allowed. Null URLs have empty parts and are allowed. Every row of
    ``pages`` gives one row, repeated ones too; its other columns are not read.
    """
    mined = mine_rules(labelled, params)
    host, path = split_url(F.col("url"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    split = (pages.select("page_id", "url").withColumns({"host": host, "path": path})
             .withColumns({"rule": name, "listed": verdict}))
    best = match_rules(split.filter("rule is null and url is not null"), mined)
    return split.join(best, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("rule").isNotNull(), F.col("listed"))
        .when(F.col("rule_id").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
        .alias("verdict"), F.when(F.col("rule").isNull(), F.col("rule_id")).alias("mined"))
