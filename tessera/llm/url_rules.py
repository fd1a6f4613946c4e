"""URL filtering by fixed rules and, where none fits, by mined association rules.

FP-growth mines token combinations from the pages that a fixed rule labels.  Combinations that imply
a verdict with enough support and confidence, and no less general than needed, become rules; an
inverted index from token to rule finds the rules of every other page.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

#: Items of a row that may meet in one basket, for each group chosen.
_GROUP_ITEMS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict): host and all its subdomains, paths that start as given.
BASE_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, path = rule.split("/", 1)
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def longest_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Columns of the longest fitting rule and of its verdict, null where none fits."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule, verdict = rule.when(_fits(text), F.lit(text)), verdict.when(_fits(text), F.lit(says))
    return rule, verdict


def url_tokens() -> Column:
    """Distinct sorted tokens of ``url``, ``host`` and ``path``: scheme, host labels and their
    parts, path segments by place, with numbers reduced to their first digit, file ending, names of
    query parameters, and whether there is a fragment."""
    labels = F.filter(F.split("host", "[.]"), lambda x: x != "")
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    plain = F.transform(segments, lambda x: F.regexp_replace(F.translate(x, _UPPER, _LOWER), "^([0-9])[0-9]*", "$1#"))
    names = F.expr("split(regexp_extract(coalesce(url, ''), '[?]([^#]*)', 1), '&')")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(F.concat(F.lit("s:"), F.coalesce(F.regexp_extract("url", "^([A-Za-z]*)://", 1), F.lit("")))),
                F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
                F.transform(
                    F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-"))),
                    lambda x: F.concat(F.lit("w:"), x),
                ),
                F.transform(plain, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x)),
                F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1))),
                F.when(F.col("url").contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def _representatives(labelled: DataFrame, least: int) -> DataFrame:
    """``(token, item)``: the tokens of at least ``least`` rows, each with the smallest token that
    occurs in just the same rows, by the number of rows and two sums of the rows' hashes."""
    rows = labelled.select("tokens", F.xxhash64("row").alias("one"), F.hash("row").cast("long").alias("two"))
    seen = rows.select(F.explode("tokens").alias("token"), "one", "two").groupBy("token")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("one").alias("one"), F.sum("two").alias("two")).filter(F.col("n") >= least)
    same = seen.groupBy("n", "one", "two").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return same.select(F.explode("tokens").alias("token"), "item")


def mine_rules(
    labelled: DataFrame, min_support: float = 0.005, min_rows: int = 5, min_confidence: float = 0.8, max_tokens: int = 3
) -> DataFrame:
    """Rules ``(rule_id, tokens, n_tokens, verdict, confidence, support)`` from ``labelled(tokens, verdict)``.

    A rule of at most ``max_tokens`` tokens is kept if it holds for at least ``min_rows`` rows and the
    share ``min_support`` of its verdict's rows, its confidence reaches ``min_confidence``, and no rule
    with fewer of its tokens implies the same verdict at least as surely.  The support is a share
    of the verdict's own rows, so a rare verdict has rules too and the number of rules doesn't grow
    with the corpus.

    FP-growth mines the tokens of each verdict's rows.  Tokens that always occur together count as
    one, and wide rows are cut so that no itemset can grow long: the items are dealt into groups, and
    every row gives one basket for each choice of ``max_tokens`` groups, with the items of these.
    Every combination of that many items lies in one of the baskets, whose number is a polynomial
    in the row's width, and its support there is its support in the rows.
    """
    spark = labelled.sparkSession
    kind = "rule_id long, tokens array<string>, n_tokens int, verdict string, confidence double, support double"
    labelled = materialize(labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("row")), "labelled")
    sizes = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    items = materialize(_representatives(labelled, min_rows).filter("token = item"), "tokens")
    found = None
    for verdict, rows in sorted(sizes.items()):
        least = max(min_rows, math.ceil(min_support * rows))
        if rows < least:
            continue
        own = labelled.filter(F.col("verdict") == verdict)
        kept = own.select("row", F.explode("tokens").alias("token")).join(items, "token").select("row", "item")
        often = kept.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        kept = materialize(kept.join(often.select("item"), "item"), "items")
        width = kept.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if not width:
            continue
        groups = max(max_tokens, -(-width // _GROUP_ITEMS))
        choices = list(itertools.combinations(range(groups), max_tokens))
        place = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
        table = spark.createDataFrame([(k, list(c)) for k, c in enumerate(choices)], "choice int, groups array<int>")
        dealt = kept.withColumn("place", place)
        cut = dealt.join(F.broadcast(table), F.array_contains("groups", F.col("place")))
        cut = cut.groupBy("row", "choice").agg(F.collect_set(F.concat("choice", F.lit("|"), "item")).alias("items"))
        support = (least - 0.5) / max(1, cut.count())
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, support)).fit(cut).freqItemsets
        short = sets.filter(F.size("items") <= max_tokens).select(
            F.array_sort(F.transform("items", lambda x: F.regexp_replace(x, "^[0-9]+[|]", ""))).alias("tokens"), F.col("freq").alias("hits")
        )
        short = short.distinct().select("tokens", "hits", F.lit(verdict).alias("verdict"), F.lit(float(rows)).alias("rows"))
        found = short if found is None else found.unionByName(short)
    if found is None:
        return spark.createDataFrame([], kind)
    found = found.withColumn("rule_id", F.xxhash64("tokens", "verdict")).withColumn("n_tokens", F.size("tokens"))
    found = materialize(found, "itemsets")
    # Confidence: how many rows of any verdict hold the tokens.  The inverted index lists an itemset under
    # its rarest token only; equal rows are counted once.
    kinds = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("rows"))
    often = found.filter("n_tokens = 1").groupBy(F.col("tokens")[0].alias("token")).agg(F.sum("hits").alias("n"))
    rarest = found.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(often, "token")
    index = rarest.groupBy("rule_id").agg(F.first("tokens").alias("wanted"), F.min_by("token", F.struct("n", "token")).alias("token"))
    met = kinds.select("tokens", "rows", F.explode("tokens").alias("token")).join(index, "token")
    met = met.filter(F.forall("wanted", lambda x: F.array_contains("tokens", x)))
    totals = met.groupBy("rule_id").agg(F.sum("rows").alias("all"))
    found = found.join(totals, "rule_id").select(
        "rule_id", "tokens", "n_tokens", "verdict", (F.col("hits") / F.col("all")).alias("confidence"), (F.col("hits") / F.col("rows")).alias("support")
    )
    found = materialize(found.filter(F.col("confidence") >= min_confidence), "rules")
    # A rule is looked up by its own parts, of which it has few.

    def some(mask: int) -> Column:
        taken = F.lit([mask >> k & 1 for k in range(max_tokens)])
        return F.filter("tokens", lambda x, i: F.get(taken, i) == 1)

    parts = [some(mask) for mask in range(1, (1 << max_tokens) - 1)]
    parts = found.select("rule_id", "tokens", "verdict", F.col("confidence").alias("sure"), F.explode(F.array_distinct(F.array(*parts))).alias("part"))
    parts = parts.filter((F.size("part") > 0) & (F.size("part") < F.size("tokens"))).select("rule_id", "verdict", "sure", F.col("part").alias("tokens"))
    wider = parts.join(found.select("tokens", "verdict", "confidence"), ["tokens", "verdict"]).filter("confidence >= sure").select("rule_id").distinct()
    return found.join(wider, "rule_id", "left_anti").select("rule_id", "tokens", "n_tokens", "verdict", "confidence", "support")


def match_rules(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, mined)``: for each token set of ``baskets`` that some rule matches, its verdict.

    The inverted index lists the rules of each token; a rule matches if all its tokens are met.
    The surest rule decides, then the one with the most support, then block before allow.
    """
    index = rules.select(F.explode("tokens").alias("token"), "rule_id", "n_tokens", "verdict", "confidence", "support")
    return (
        baskets.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .groupBy("tokens", "rule_id", "n_tokens", "verdict", "confidence", "support")
        .agg(F.count(F.lit(1)).alias("met"))
        .filter("met = n_tokens")
        .groupBy("tokens")
        .agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
        .select("tokens", F.col("best.verdict").alias("mined"))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]] = BASE_RULES, **mining) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    The longest fitting fixed rule decides; where none fits, the mined rules do, and where none
    of these matches either, the page is allowed.  A null url or one without ``://`` has an empty
    host and path, fits no rule and is judged by its other tokens.  Of equally sure and well supported
    rules block goes before allow.  Null page_ids and repeated rows
    stay as they are; an empty table gives an empty result; other columns are not read.
    """
    rule, verdict = longest_rule(rules)
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"), url_tokens().alias("tokens"))
    rows = materialize(rows, "urls")
    mined = mine_rules(rows.filter("says IS NOT NULL").select("tokens", F.col("says").alias("verdict")), **mining)
    # Pages with the same tokens are judged once, so a hot host is one row here.
    baskets = rows.filter("says IS NULL").groupBy("tokens").agg(F.count(F.lit(1)).alias("pages"))
    matched = match_rules(baskets, mined)
    rest = rows.filter("says IS NULL").join(matched, "tokens", "left")
    return (
        rows.filter("says IS NOT NULL")
        .select("page_id", "host", "path", "rule", F.col("says").alias("verdict"))
        .unionByName(
            rest.select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit("allow")).alias("verdict"))
        )
    )
