"""URL filtering by association rules; DataFrame expressions and Spark's FP-growth only.

Explicit rules (host suffix and path prefix) decide first, the longest that fits.
Where none fits, token combinations decide that FP-growth has found to go with bad
labels.  Combinations are pruned by support, confidence and by smaller ones that say
the same; a URL finds its candidates through an index on each combination's rarest
token and then has to hold the rest.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

BAD = "label=bad"
A_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for NULL."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), A_Z, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct words of host labels and path; digits in a path count as one kind of token."""
    labels = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"\d+", "9")))
    return F.array_distinct(F.concat(labels, words))


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else NULL.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts
    with the rule's.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(pages: DataFrame, labels: DataFrame, *, min_support: float = 0.0, min_pages: int = 20, min_confidence: float = 0.5) -> DataFrame:
    """Token combinations that go with bad pages: antecedent, confidence, support, rarest.

    ``labels`` has page_id and bad.  Pages without a label are not learned from; with
    several labels, bad wins.  A combination needs ``min_pages`` bad pages that hold it,
    however many pages there are; ``min_support`` is a further floor as a share of the
    labelled pages, unused by default.
    """
    marks = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    baskets = (pages.select(F.col("page_id").cast("long").alias("page_id"), tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("items"))
               .join(marks, "page_id").select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    n = max(baskets.count(), 1)
    least = math.ceil(max(min_support * n, min_pages))
    # FP-growth rounds share * n up again: half a page less cannot round past the wanted number
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where("lift > 1")
             .select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"))
    # a combination goes if part of it is as sure
    smaller = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"), F.col("antecedent")[0].alias("token"))
    implied = (rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(smaller, "token")
               .where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence")))
               .select("antecedent").distinct())
    rules = rules.join(implied, "antecedent", "left_anti")
    one = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    rarest = (rules.select("antecedent", F.explode("antecedent").alias("token")).join(one, "token")
              .groupBy("antecedent").agg(F.min(F.struct("freq", "token")).alias("m")).select("antecedent", F.col("m.token").alias("rarest")))
    return rules.join(rarest, "antecedent")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **limits) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (NULL where none fits), verdict (allow or block).

    NULL urls and urls without ``://`` have an empty host and path, fit no rule and
    hold no tokens: allow.  Repeated rows are judged each.  Columns besides page_id
    and url are not read.
    """
    parts = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("*", fitting(F.col("host"), F.col("path"), rules).alias("fit"))
    mined = mine(pages, labels, **limits)
    open_ = (parts.where("fit IS NULL").select("host", "path").distinct()
             .select("host", "path", tokens_of(F.col("host"), F.col("path")).alias("tokens")))
    hits = (open_.select("host", "path", "tokens", F.explode("tokens").alias("rarest")).join(mined, "rarest")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0).select("host", "path", F.lit("block").alias("mined")).distinct())
    return parts.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("fit").isNull(), F.col("mined")), F.lit("allow")).alias("verdict"))
