"""URL filtering: explicit host and path rules first, then association rules mined by FP-growth.

Mining: each labelled page becomes a set of URL tokens plus, where its label says so, the item `label=bad`. Tokens that stand in exactly the same
pages, as the words of a site's template do, are one item (told by their number of pages and 128 bits of two hashes over them), so their number doesn't
count. Spark's FP-growth finds the frequent sets of four fifths of the pages; a set with the label and the same set without it make the rule `tokens -> label=bad`. A rule stays if it passes the limits of
support, confidence and lift, if its 2 x 2 table against the base rate is beyond chance, and if the pages held out (the last fifth) bear it out. Beyond
chance: chi-square above the quantile of `alpha` divided by the number of rules tried (Bonferroni), as so many rules are tried that some look good by
luck; sets of the same pages are one try. A rule takes one token of each of its items: each such choice is a rule of its own from here on. Borne out: at least one held-out page has its tokens, their share of bad ones is `min_confidence` or more, and chi-square there is above that
of a single test. Last, rules go that a shorter rule of the same or a higher confidence makes needless. All of this is joins and aggregates of
rule rows; only their number comes to the driver.

Matching: an inverted index, a table, holds each rule under the token of it that the fewest of the URLs have, so that a URL meets few rules; a rule fits if
no token of it is missing.

The number of rules doesn't grow with the rows: a URL of t frequent items counts for 2^t sets, and each kept set needs `min_support` of the
rows, so there are at most mean(2^t) / min_support of them. Frequent words that stand together in most pages, but not in the same, still count each.

Null, or a URL without `://`: host and path are empty, no rule fits, and only tokens could block it (there are none). Repeated rows are judged
alike. Empty labels, or none in common with the pages: no rules, every page without an explicit rule is allowed. Other columns aren't read.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, read, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"

#: Fixed values of the op1 query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, each host suffix, path words with digits generalised, query keys."""
    clean = lambda x: F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "#")
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))
    labels = F.split(host(url), "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1))
    scheme = F.array(F.substring_index(F.translate(url, UPPER, LOWER), "://", 1))
    every = F.concat(named("scheme", scheme), named("host", F.filter(suffixes, lambda s: s != "")), named("path", F.split(clean(path(url)), "[/._-]+")), named("key", keys))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


RULE = "items array<string>, confidence double, support double"


def chi_square(n: Column, bad: Column, total: Column, all_bad: Column) -> Column:
    """Of the 2 x 2 table of pages with the tokens (n, of them bad) among all (total, of them all_bad); 0 where a margin is empty."""
    other, good, off = total - n, total - all_bad, total * bad - n * all_bad
    return F.when((n > 0) & (other > 0) & (all_bad > 0) & (good > 0), off * off * total / (n * other * all_bad * good)).otherwise(0.0)


def mine(labelled: DataFrame, stage: Scratch, min_support: float = 0.01, min_confidence: float = 0.6, min_lift: float = 1.5, min_pages: int = 5, alpha: float = 0.01) -> DataFrame:
    """Rules (items, confidence, support) from rows of page_id, tokens and bad. A rule needs `min_pages` pages as well."""
    spark = labelled.sparkSession
    pages = stage(labelled.where(F.size("tokens") > 0).select("page_id", F.monotonically_increasing_id().alias("uid"), "tokens", "bad", (F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(5)) == 0).alias("apart")))
    used = pages.where("not apart")
    sums = pages.agg(*[F.count(F.when(c, 1)).alias(x) for x, c in (("n", ~F.col("apart")), ("bad", ~F.col("apart") & F.col("bad")), ("n_apart", F.col("apart")), ("bad_apart", F.col("apart") & F.col("bad")))]).first()
    if not sums["bad"]:
        return spark.createDataFrame([], RULE)
    n = sums["n"]
    least = min(1.0, max(min_support, min_pages / n))
    each = used.select("uid", "bad", F.explode("tokens").alias("token"))
    classes = stage(_classes(each, least * n))
    items = each.join(classes.select("item", F.explode("members").alias("token")), "token", "left").groupBy("uid", "bad").agg(F.collect_set("item").alias("items"))
    items = items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    sets = stage(FPGrowth(itemsCol="items", minSupport=least).fit(items).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    named = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("bad"))
    tried = stage(named.join(sets.withColumnRenamed("freq", "n"), "items"))
    share = F.col("bad") / F.col("n")
    likely = NormalDist().inv_cdf(1 - alpha / max(1, tried.count()) / 2) ** 2
    beyond = chi_square(F.col("n"), F.col("bad"), F.lit(n), F.lit(sums["bad"])) >= likely
    good = tried.where((share >= min_confidence) & (share * n / sums["bad"] >= min_lift) & beyond).select("items", share.alias("confidence"), (F.col("bad") / n).alias("support"))
    good = stage(_choices(good, classes))
    apart_pages = pages.where("apart").select("uid", "tokens", "bad")
    met = matches(apart_pages, inverted(good, apart_pages), "bad").groupBy("items", "confidence", "support")
    borne = met.agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    single = NormalDist().inv_cdf(1 - alpha / 2) ** 2
    apart = chi_square(F.col("n"), F.col("bad"), F.lit(sums["n_apart"]), F.lit(sums["bad_apart"]))
    borne = stage(borne.where((F.col("bad") >= min_confidence * F.col("n")) & (apart >= single)).select("items", "confidence", "support"))
    return borne.join(_needless(borne), "items", "left_anti")


def _classes(each: DataFrame, least: float) -> DataFrame:
    """item and members: the tokens of `each` (uid, token) in at least `least` pages, those of the same pages together under the first of them."""
    told = [F.bit_xor(F.xxhash64("uid", F.lit(seed))).alias(f"pages{seed}") for seed in (1, 2)]
    tokens = each.groupBy("token").agg(F.count("*").alias("n"), *told).where(F.col("n") >= F.floor(F.lit(least)))
    return tokens.groupBy("n", "pages1", "pages2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")).select("item", "members")


def _choices(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The rules with one token for each of their items, in every way."""
    held = rules.withColumn("item", F.explode("items")).join(classes, "item").groupBy("items", "confidence", "support").agg(F.collect_list("members").alias("members"))
    longer = lambda chosen, members: F.flatten(F.transform(chosen, lambda c: F.transform(members, lambda m: F.concat(c, F.array(m)))))
    ways = F.aggregate("members", F.array(F.array().cast("array<string>")), longer)
    return held.select(F.explode(ways).alias("items"), "confidence", "support").withColumn("items", F.array_sort("items"))


def _needless(rules: DataFrame) -> DataFrame:
    """The items of the rules for which one of fewer of their tokens is as sure. Each rule looks up its own parts."""
    short = rules.where(F.size("items") > 1)
    kept = lambda m: F.filter("items", lambda x, i: F.getbit(m, i) == 1)
    parts = F.transform(F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.size("items")).cast("long") - 2), kept)
    known = rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    return short.select("items", "confidence", F.explode(parts).alias("part")).join(known, "part").where(F.col("sure") >= F.col("confidence")).select("items").distinct()


def inverted(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules under that of their tokens that the fewest of urls (uid, tokens) have: token, items, confidence, support."""
    each = rules.select("items", "confidence", "support", F.explode("items").alias("token"))
    often = urls.select(F.explode("tokens").alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often"))
    rare = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.col("token")))
    return each.join(often, "token", "left").groupBy("items", "confidence", "support").agg(rare["token"].alias("token"))


def matches(urls: DataFrame, index: DataFrame, *more: str) -> DataFrame:
    """uid, items, confidence, support and more columns, for each rule whose tokens a URL (uid, tokens) has."""
    met = urls.select("uid", *more, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("items", "tokens")) == 0).select("uid", "items", "confidence", "support", *more)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict and the best mined rule's confidence (0 without one), for every row of pages.

    labels: doc_id (a page_id), quality, toxic. A page is bad if its quality is 0 or it is toxic; unlabelled pages train nothing.
    """
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))), F.lit(False)).alias("bad"))
    with Scratch(pages.sparkSession) as stage:
        light = stage(pages.select("page_id", "url", F.monotonically_increasing_id().alias("uid")))
        urls = light.select("uid", "page_id", tokens(F.col("url")).alias("tokens"))
        mined = stage(mine(urls.join(bad, "page_id").select("page_id", "tokens", "bad"), stage, **limits))
        index = stage(inverted(mined, urls))
        found = matches(urls, index).groupBy("uid").agg(F.max("confidence").alias("confidence"))
        out = light.join(found, "uid", "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
        out = out.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
        return staged(out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), F.when(F.col("confidence") > 0, "block").otherwise("allow")).alias("verdict"), "confidence"))


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def oracle() -> str:
    """For tables whose labels bear no rule out: what is left to the method is allowed."""
    ordered = sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict, 0.0::DOUBLE AS confidence FROM p"""
