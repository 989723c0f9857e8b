"""URL filter: host and path rules, and association rules mined from labelled URLs.

A listed rule (action, host, path) fits its host and all its subdomains where
the URL's path starts with the rule's path; the longest fitting rule decides.
Where none fits, association rules do: Spark's FP-growth mines combinations of
URL tokens (scheme, all host labels, registered domain, all path words without
digits, file type, all query keys; long ones by their hash) together with the
label of the document that the URL names.
Rules that imply a label are pruned by support (a share and a number of URLs),
by confidence and by conviction. Confidence must also hold for the lower end of
its Wilson interval: a rule for another verdict than the default must be more
often right than its verdict's share of all labelled URLs is, so that the
chance finds among thousands of combinations go; one for the default, which
only shields URLs from other rules, must keep to the confidence bound. A rule
goes too if a part of its antecedent implies the verdict with no less
confidence. Those left match through an inverted index: each rule is filed
under the rarest token of its antecedent, a URL meets it by that token, and the
rest of the antecedent is checked then. Tokens that occur in the same labelled
URLs are one item, which any of them stands for: a rule with one of them is as
confident and as frequent as one with more, so verdicts stay and long URLs that
many pages share are mined without all subsets of their tokens. The most
confident matching rule decides (ties: larger support, then the smaller
antecedent); without any the verdict is the default, allow.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and no tokens, so its verdict is allow; repeated rows and null identifiers are
judged row by row; very long URLs are read whole; without labels nothing is
mined; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.shared import saved, table

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def part(url: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, _row, host, path, tokens (distinct)."""
    rows = pages.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.col(url_col).alias("_url"))
    rows = rows.select(id_col, "_row", "_url", F.translate(part("_url", 1), string.ascii_uppercase, string.ascii_lowercase).alias("host"), part("_url", 2).alias("path"), part("_url", 3).alias("_rest"))
    labels, words = F.split("host", r"\."), F.filter(F.split("path", "/"), lambda w: w != "")
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.when(F.length(c) < 64, c).otherwise(F.sha2(c.cast("binary"), 256)))
    one = lambda ok, c: F.when(ok, F.array(c)).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(
        F.array(named("scheme", F.lower(F.substring_index("_url", "://", 1)))),
        F.transform(labels, lambda w: named("host", w)),
        F.array(named("domain", F.substring_index("host", ".", -2))),
        F.transform(F.filter(words, lambda w: ~w.rlike("[0-9]")), lambda w: named("path", w)),
        one(F.col("path").rlike(r"\.[A-Za-z]{1,5}$"), named("type", F.lower(F.regexp_extract("path", r"\.([A-Za-z]{1,5})$", 1)))),
        F.transform(F.regexp_extract_all("_rest", F.lit(r"[?&]([A-Za-z_]++)="), F.lit(1)), lambda w: named("key", w)),
        one(F.contains("_rest", F.lit("#")), F.lit("fragment")),
    )
    empty = F.array().cast("array<string>")
    return rows.select(id_col, "_row", "host", "path", F.coalesce(F.when(F.col("host") != "", F.array_distinct(tokens)), empty).alias("tokens"))


def listed(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null without one."""
    rule = action = F
    for act, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, action = rule.when(fits, F.lit(host + path)), action.when(fits, F.lit(act))
    return rule, action


def same_urls(marked: DataFrame, least: int) -> DataFrame:
    """token, item of the tokens in ``least`` rows or more; tokens of the same rows have the same item.

    ``marked`` has _tx (a stored row number) and tokens. Rows are compared by their count and 128 bits of hashes.
    """
    uses = marked.select("_tx", F.explode("tokens").alias("token")).groupBy("token")
    uses = uses.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("_tx")).alias("x"), F.bit_xor(F.xxhash64("_tx", F.lit("again"))).alias("y")).filter(F.col("n") >= least)
    uses = saved(uses, "token_uses")
    return saved(uses.join(uses.groupBy("n", "x", "y").agg(F.min("token").alias("item")), ["n", "x", "y"]).select("token", "item"), "token_items")


def wilson(share: Column, n: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share seen in ``n`` cases."""
    return (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def mine(
    tokens: DataFrame, labels: DataFrame, support: float = 0.002, least: int = 10, confidence: float = 0.6, conviction: float = 1.5, z: float = 3.29, default_z: float = 1.96, default: str = "allow"
) -> tuple[DataFrame, DataFrame]:
    """antecedent (items), verdict, confidence, support of the rules that imply a label; and token, item.

    ``tokens`` has tokens and the document number, ``labels`` document number and verdict. A rule is kept if
    it holds for ``least`` URLs and the share ``support`` or more, errs at most 1/``conviction`` as often as
    its verdict would without it, and its confidence is ``confidence`` or more and, at ``z`` standard errors
    below, still above its verdict's share (or 0.9); for the default verdict, at ``default_z`` below, still
    ``confidence``.
    """
    marked = saved(tokens.join(labels, "number").select(F.monotonically_increasing_id().alias("_tx"), "tokens", "verdict"), "transactions")
    counts = {x["verdict"]: x["count"] for x in marked.groupBy("verdict").count().collect()}
    total = sum(counts.values())
    if not total:
        none = tokens.sparkSession.createDataFrame
        return none([], "antecedent array<string>, verdict string, confidence double, support double"), none([], "token string, item string")
    support = max(support, least / total)
    items = same_urls(marked, math.ceil(support * total))  # at most the tokens of a URL / support
    each = marked.select("_tx", "verdict", F.explode_outer("tokens").alias("token")).join(F.broadcast(items), "token", "left")
    each = each.groupBy("_tx", "verdict").agg(F.collect_set("item").alias("items"))
    each = saved(each.select(F.concat("items", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items")), "transaction_items")
    if support > 1:
        return tokens.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double"), items
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(each)
    rules = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("verdict=")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 9, 16).alias("verdict"), "confidence", "support")
    seen = F.round(F.col("support") * total / F.col("confidence"))
    passes = F.lit(False)
    for verdict, n in counts.items():
        share = n / total
        sure = wilson(F.col("confidence"), seen, default_z) >= confidence if verdict == default else wilson(F.col("confidence"), seen, z) > min(share, 0.9)
        passes = passes | ((F.col("verdict") == verdict) & ((1 - F.col("confidence")) * conviction <= 1 - share) & sure)
    rules = saved(rules.filter(passes), "rules")
    # without the rules that one of their parts makes needless
    parts = rules.filter("size(antecedent) > 1").select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("left_out"))
    parts = parts.select(F.col("antecedent").alias("whole"), "verdict", F.col("confidence").alias("own"), F.array_remove("antecedent", F.col("left_out")).alias("antecedent"))
    needless = parts.join(rules, ["antecedent", "verdict"]).filter("confidence >= own").select(F.col("whole").alias("antecedent"), "verdict").distinct()
    return saved(rules.join(needless, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support"), "rules"), items


def apply_rules(rows: DataFrame, rules: DataFrame, items: DataFrame, most_broadcast: int = 20_000) -> DataFrame:
    """``_row`` and the verdict of the best rule for each row that one matches; ``items``: token, item."""
    small = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df
    used = saved(items.join(rules.select(F.explode("antecedent").alias("item")).distinct(), "item", "left_semi"), "used_items")
    rows = rows.select("_row", F.explode("tokens").alias("token")).join(small(used), "token").groupBy("_row").agg(F.collect_set("item").alias("items"))
    rows = saved(rows, "row_items")
    numbered = rules.withColumn("_rule", F.xxhash64(F.to_json(F.struct("antecedent", "verdict"))))
    common = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    rarest = numbered.select("_rule", F.explode("antecedent").alias("item")).join(common, "item").groupBy("_rule").agg(F.min(F.struct("n", "item")).alias("r"))
    index = saved(numbered.join(rarest, "_rule").select(F.col("r.item").alias("item"), "antecedent", "verdict", "confidence", "support"), "rule_index")
    met = rows.select("_row", "items", F.explode("items").alias("item")).join(small(index), "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
    return met.groupBy("_row").agg(F.max(F.struct("confidence", "support", (-F.size("antecedent")).alias("short"), "verdict")).alias("m")).select("_row", F.col("m.verdict").alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``; ``labels``: number, verdict."""
    rows = saved(parsed(pages, id_col, url_col), "urls")
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:[/.]|$)", 1)
    found, items = mine(rows.filter("size(tokens) > 0").withColumn("number", F.when(number != "", number).cast("long")).filter("number IS NOT NULL").select("number", "tokens"), labels)
    rule, action = listed(rules)
    out = rows.select(id_col, "_row", "host", "path", rule.alias("rule"), action.alias("_action"))
    if found.limit(1).count():
        out = out.join(apply_rules(rows, found, items), "_row", "left")
    else:
        out = out.withColumn("mined", F.lit(None).cast("string"))
    return out.select(id_col, "host", "path", "rule", F.coalesce("_action", "mined", F.lit("allow")).alias("verdict"))


def op5_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the listed rules and by rules mined from ``labels``.

    The tables have no labels of URLs. A URL of ``pages`` ends in a number, which is taken as that of the document
    it shows, the only link between the tables: bad (block) is what ``labels`` marks as of low quality or toxic.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("number")).agg(F.max(F.when(bad, 1).otherwise(0)).alias("b"))
    return judge(table(spark, sf_dir, "pages"), labels.select("number", F.when(F.col("b") == 1, "block").otherwise("allow").alias("verdict")))
