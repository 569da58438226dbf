"""URL filtering by association rules.

Given rules (host suffix and path prefix, longest first) decide where they fit. All other urls are
judged by mined rules: FP-growth finds the combinations of url tokens that go with the bad label
among labelled urls; combinations of enough support and confidence, reduced to the minimal ones,
block every url that holds all their tokens. Rules are looked up by their rarest token.

Before the mining, what cannot change its result is taken out, so that urls with a long common slug do not
make a rule of every part of it: tokens of too few bad urls are in no rule, a token that is a rule by itself is
in no other minimal one, and tokens that stand in exactly the same labelled urls are one item, of which a url
needs to hold any.

Only DataFrame operations and Spark's own FP-growth. Distinct token sets are matched, not urls, so a
host with a third of all pages is matched once per combination.

A null url, or one without `://`, has an empty host and path and no tokens: no rule fits, it is
allowed. Repeated rows are judged each. Rows with a null label or url teach nothing; without
labelled rows nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.llm.common import lower_ascii, stored

BAD = "!bad"  # cannot be a token: tokens start with h or p
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct words of the host and of the path, sorted; words of a path that hold a digit are left out."""
    hosts = F.transform(F.split(host, r"[^a-z0-9]+"), lambda w: F.concat(F.lit("h:"), w))
    paths = F.transform(F.split(lower_ascii(path), r"[^a-z0-9]+"), lambda w: F.concat(F.lit("p:"), w))
    return F.array_sort(
        F.array_distinct(
            F.concat(F.filter(hosts, lambda w: F.length(w) > 2), F.filter(paths, lambda w: w.rlike("^p:[a-z]+$")))
        )
    )


def mine_rules(labelled: DataFrame, support: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(tokens, bad, seen): minimal combinations of items of labelled(tokens, bad boolean); and (token, item) where they differ.

    support is the least number of bad urls with the combination, confidence the least bad share.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.filter("tokens is not null and bad is not null and size(tokens) > 0").select("tokens", "bad"))
    spread = rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad").withColumn("token", F.explode("tokens"))
    mark = F.xxhash64("tokens", "bad")
    facts = spread.groupBy("token").agg(
        F.count_if("bad").alias("bad"),
        F.count("*").alias("seen"),
        *(F.sum(m.cast("decimal(20,0)")).alias(name) for name, m in (("m1", mark), ("m2", F.xxhash64(mark, F.lit(1))))),
    )
    facts = stored(facts.filter(F.col("bad") >= support))
    alone = F.col("bad") >= F.lit(confidence) * F.col("seen")
    single = facts.filter(alone).select(F.array("token").alias("tokens"), "bad", "seen")
    same = Window.partitionBy("m1", "m2", "seen", "bad")
    items = stored(facts.filter(~alone).select("token", F.min("token").over(same).alias("item")))
    schema = "tokens array<string>, bad long, seen long"
    baskets = spread.join(items, "token").groupBy("row", "bad").agg(F.collect_set("item").alias("items"))
    rows = stored(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    n = rows.count()
    classes = items.filter("item <> token")
    if not n:
        return single.unionByName(spark.createDataFrame([], schema)), classes
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / n), minConfidence=0.0).fit(rows)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_bad = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("bad")
    )
    seen = sets.filter(~F.array_contains("items", BAD)).select(F.col("items").alias("tokens"), F.col("freq").alias("seen"))
    rules = with_bad.join(seen, "tokens").filter(F.col("bad") >= F.lit(confidence) * F.col("seen"))
    rules = stored(rules.filter(F.col("bad") >= support))
    # A combination is redundant if leaving out some token leaves a rule: look its parts up.
    parts = rules.select("tokens", F.explode("tokens").alias("out")).select(
        F.col("tokens").alias("longer"), F.array_remove("tokens", F.col("out")).alias("tokens")
    )
    lesser = parts.join(rules.select("tokens"), "tokens", "left_semi").select(F.col("longer").alias("tokens")).distinct()
    return rules.join(lesser, "tokens", "left_anti").select("tokens", "bad", "seen").unionByName(single), classes


def match_rules(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(key): keys of token_sets(key, tokens) that hold all items of some rule, by the rule's rarest item."""
    common = rules.select(F.explode("tokens").alias("token")).distinct()
    spread = token_sets.select("key", F.explode("tokens").alias("token")).join(classes, "token", "left")
    whole = spread.groupBy("key").agg(F.collect_set(F.coalesce("item", "token")).alias("tokens"))
    spread = whole.select("key", "tokens", F.explode("tokens").alias("token"))
    frequency = spread.groupBy("token").agg(F.count("*").alias("f")).join(common, "token", "left_semi")
    index = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("token")).join(frequency, "token", "left")
    index = index.groupBy("rule").agg(
        F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.col("token"))).alias("rarest")
    )
    index = index.select("rule", F.col("rarest.token").alias("token"))
    hit = spread.join(index, "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    return hit.select("key").distinct()


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    support: int = 6,
    confidence: float = 0.7,
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined) for every row of pages(page_id, url).

    labelled(url, bad) are the urls to learn from; `mined` tells whether a mined rule matches.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    rows = rows.withColumn("key", F.concat_ws(" ", "tokens"))
    known = labelled.select(url_tokens(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "bad")
    found, classes = mine_rules(known, support, confidence)
    # Written, so that its bytes are known: if they are few the pages of a hot host stay where they are.
    blocked = stored(match_rules(rows.select("key", "tokens").distinct(), found, classes))
    blocked = blocked.select(F.col("key").alias("blocked_key"), F.lit(True).alias("mined"))
    fits = []
    for rule, action in rules:
        host, _, path = rule.partition("/")
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    rows = rows.withColumn("given", best).join(blocked, F.col("key") == F.col("blocked_key"), "left")
    mined = F.coalesce("mined", F.lit(False))
    verdict = F.coalesce(F.col("given.action"), F.when(mined, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(
        "page_id", "url", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), mined.alias("mined")
    )
