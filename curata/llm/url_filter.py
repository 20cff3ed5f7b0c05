"""URL filter: host/path rules first, association rules mined from labelled urls for the rest.

The longest fixed rule that fits decides.  For the other urls, FP-growth mines token
combinations of labelled urls together with their class.  A rule "tokens -> class" of either class is kept if it
reaches the support and the confidence, is more confident than its class is frequent (its lift, confidence over the class's share of the labelled
urls, reaches ``min_lift``), and is more confident than every rule on a part of its tokens: so a rule says something, and says it with as few
tokens as it takes.  Tokens that occur in the very same labelled urls (a host and its parents, the parts of one much repeated url) are one item, named by the
first of them, so only closed combinations are mined.

A rule is indexed under its rarest token, so a url meets a rule only
through that token; whether the url has all of the rule's tokens is checked after. The
matching rule with the highest lift (then confidence, support, more tokens, text order)
decides; a url without one is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no fixed
rule and has no tokens but ``url=none``; repeated pages are judged each; a page with several labels counts as
bad if one of them is, a null label as none; without labels, or with labels of one class only, no rule is mined; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import ascii_lower
from curata.session import checkpointed

BAD, GOOD = "class=block", "class=allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, ascii_lower(host)).otherwise(""), F.when(known, path).otherwise("")


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):      # the longest is looked at first
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host and its parents, path segments by place, file ending, query keys and values, fragment."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    places = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), s))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), s))
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key="), F.substring_index(s, "=", 1)))
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    one = lambda name, c: F.when(c != "", F.array(F.concat(F.lit(name), c))).otherwise(F.array().cast("array<string>"))
    found = F.concat(one("scheme=", scheme), parents, places, one("ending=", ending), pairs, keys, one("fragment=", fragment))
    none = F.array(F.lit("url=none"))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.array_distinct(found)), none)


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.7, min_count: int = 20, min_lift: float = 1.1) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, lift, support, key) from rows (tokens, bad).

    A rule must hold for ``min_support`` of the rows and for ``min_count`` rows (few labels
    would otherwise make rules of single urls)."""
    rows = checkpointed(labelled.withColumn("row", F.monotonically_increasing_id()), "urlbaskets")
    n = rows.count()
    if n < min_count:
        rows, n = rows.limit(0), 0
    min_support = min(1.0, max(min_support, min_count / max(n, 1)))
    # tokens of the very same rows (host parents, copies of one url) are one item, or all their combinations would be mined
    items = rows.select("row", "bad", F.explode("tokens").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("where")).where(F.col("n") >= min_support * n)
    often = checkpointed(often.groupBy("n", "where").agg(F.min("item").alias("item")), "urlitems")
    classed = items.join(often.select("item"), "item").groupBy("row", "bad").agg(F.collect_list("item").alias("tokens"))
    classed = (rows.select("row", "bad").join(classed.select("row", "tokens"), "row", "left")
               .select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items")))
    # every rule of a frequent combination, however unsure: the parts of a rule are among them
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(classed)
    rules = (model.associationRules
             .where(F.col("consequent")[0].isin(BAD, GOOD) & ~F.exists("antecedent", lambda t: t.isin(BAD, GOOD)))
             .select(F.sort_array("antecedent").alias("tokens"), F.when(F.col("consequent")[0] == BAD, "block").otherwise("allow").alias("verdict"), "confidence", "lift", "support"))
    rules = checkpointed(rules, "urlrules")
    # the best confidence among all parts of a rule, by size: the parts with one token less, and the best of their parts
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    done = rules.where(F.size("tokens") == 1).withColumn("of_part", F.lit(0.0))
    level = done
    for size in range(2, longest + 1):
        less = level.select(F.col("tokens").alias("part"), "verdict", F.greatest("confidence", "of_part").alias("found"))
        own = rules.where(F.size("tokens") == size)
        parts = own.select("tokens", "verdict", F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))).alias("part"))
        best = parts.join(less, ["part", "verdict"]).groupBy("tokens", "verdict").agg(F.max("found").alias("of_part"))
        level = checkpointed(own.join(best, ["tokens", "verdict"], "left").withColumn("of_part", F.coalesce("of_part", F.lit(0.0))).select(*done.columns), "urllevel")
        done = done.unionByName(level)
    kept = (done.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & (F.col("confidence") > F.col("of_part"))).drop("of_part")
            .withColumn("rule_id", F.concat_ws("\u0001", "tokens", "verdict")))
    rarest = (kept.select("rule_id", F.explode("tokens").alias("item")).join(often, "item")
              .groupBy("rule_id").agg(F.min(F.struct("n", "item"))["item"].alias("key")))
    return checkpointed(kept.join(rarest, "rule_id"), "urlrules")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               min_support: float = 0.005, min_confidence: float = 0.7, min_lift: float = 1.1) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``labels`` has (page_id, bad)."""
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"), url_tokens(F.col("url"), host, path).alias("tokens"))
    base = checkpointed(base, "urls")
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad")).where(F.col("bad").isNotNull())
    mined = mine_rules(base.join(known, "page_id").select("tokens", "bad"), min_support, min_confidence, min_lift=min_lift)
    # pages with the same tokens get the same verdict: each distinct token set is looked up once
    sets = base.select("tokens").distinct()
    index = mined.select(F.col("key").alias("token"), F.col("tokens").alias("need"), F.col("verdict").alias("says"), "lift", "confidence", "support", "rule_id")
    best = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
            .where(F.size(F.array_except("need", "tokens")) == 0)
            .groupBy("tokens").agg(F.max_by("says", F.struct(F.round("lift", 9), F.round("confidence", 9), F.round("support", 9), F.size("need"), "rule_id")).alias("says")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (base.join(best, "tokens", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "says", F.lit("allow")).alias("verdict")))
