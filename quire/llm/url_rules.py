"""Op 2: URL filter by association rules.

FP-growth mines combinations of URL tokens together with the page's class; rules (tokens -> block or allow) that pass
the confidence and support bounds are matched by an inverted index from each rule's rarest token. Listed host and path
rules come first: the longest that fits decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BROADCAST_RULES = 20_000


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is no ://."""
    part = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? or # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits columns host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, top and second-level domain, every label before it, every path part, extension, every query key, fragment, depth. Null or empty: none."""
    labels = F.split(F.col("host"), r"\.")
    n = F.size(labels)
    parts = F.filter(F.split(F.col("path"), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    number = r"^\d+(\.\w+)?$"
    found = F.array(
        F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))),
        F.concat(F.lit("top="), F.element_at(labels, -1)),
        F.when(n >= 2, F.concat(F.lit("domain="), F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2)))),
        F.concat(F.lit("ext="), F.lower(F.regexp_extract(F.col("path"), r"\.(\w{1,5})$", 1))),
        F.when(url.contains("#"), F.lit("fragment")),
        F.concat(F.lit("depth="), F.least(F.size(parts), F.lit(4)).cast("string")),
    )
    keys = F.transform(keys, lambda k: F.concat(F.lit("query="), F.regexp_extract(k, "^([^=]*)", 1)))
    names = F.transform(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("label="), x))
    folders = F.transform(parts, lambda x: F.concat(F.lit("part="), F.when(x.rlike(number), F.lit("#")).otherwise(x)))
    found = F.array_distinct(F.concat(F.array_compact(found), names, folders, keys))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_sort(found))


def mine(rows: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7) -> DataFrame:
    """Rules (tokens, rule_class, confidence, support, anchor) from rows (tokens, label); label is block or allow.

    Tokens below min_support are dropped first. The number of itemsets does not grow with the input, but doubles with each
    token that many URLs share.
    """
    spark = rows.sparkSession
    baskets = rows.where("label is not null and size(tokens) > 0").select(F.concat("tokens", F.array(F.concat(F.lit("@"), "label"))).alias("items"))
    if baskets.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, rule_class string, confidence double, support long, anchor string")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0, numPartitions=common.shuffle_partitions(spark)).fit(baskets)
    sets = common.written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    plain = sets.where(~F.exists("items", lambda x: x.startswith("@"))).select(F.col("items").alias("tokens"), F.col("freq").alias("seen"))
    classed = sets.where(F.exists("items", lambda x: x.startswith("@")) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~x.startswith("@")).alias("tokens"),
        F.expr("substr(filter(items, x -> startswith(x, '@'))[0], 2)").alias("rule_class"),
        F.col("freq").alias("support"),
    )
    rules = classed.join(plain, "tokens").withColumn("confidence", F.col("support") / F.col("seen")).where(F.col("confidence") >= min_confidence)
    single = plain.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), "seen")
    anchors = rules.select("tokens", F.explode("tokens").alias("token")).distinct().join(single, "token")
    anchors = anchors.groupBy("tokens").agg(F.min(F.struct("seen", "token"))["token"].alias("anchor"))
    return rules.join(anchors, "tokens").select("tokens", "rule_class", "confidence", "support", "anchor")


def judge(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, learned) for every page; labels: (doc_id = page_id, quality, toxic).

    Learned from pages whose label says quality 0 or toxic 1 (block) or else allow; of the learned rules that match, the
    most confident, then best supported, then first by tokens decides, and without any the page is allowed. A listed
    rule goes before. Null or odd urls have empty host and path and no tokens; repeated rows are judged each; other
    columns are ignored; without labels nothing is learned.
    """
    pages = pages.select("page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    pages = pages.withColumn("tokens", url_tokens(F.col("url"))).select("page_id", "host", "path", "tokens")
    bad = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    known = pages.join(bad, pages.page_id == bad.doc_id).select("tokens", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))
    found = common.written(mine(known, min_support, min_confidence), "rules")
    if found.count() <= BROADCAST_RULES:  # otherwise an ordinary shuffled join
        found = F.broadcast(found)
    sets = pages.select(F.col("tokens").alias("set")).distinct()
    hits = sets.select("set", F.explode("set").alias("anchor")).join(found, "anchor").where(F.size(F.array_except("tokens", "set")) == 0)
    best = hits.groupBy("set").agg(F.max(F.struct("confidence", "support", F.transform("tokens", lambda x: x).alias("tokens"), "rule_class"))["rule_class"].alias("learned"))
    rule, verdict = listed(rules)
    out = pages.join(best, pages.tokens == best.set, "left").withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, "learned", F.lit("allow")).alias("verdict"), "learned")
