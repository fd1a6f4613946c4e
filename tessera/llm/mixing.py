"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of levels (domain, language, source).  At each node it is shared
among the children by weight; a child that has fewer tokens than its share leaves the rest to its
siblings, and only what a whole family can't use goes back to the family's own siblings.  A leaf
spends its budget on whole epochs of its documents and a prefix of one more epoch in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
_SPACES = "\t\n\x0b\x0c\r"
_BINS = 1 << 14

#: Relative weights by path from the root; what is not listed weighs 1.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("web",): 3.0,
    ("books",): 2.0,
    ("code",): 1.0,
    ("web", "en"): 4.0,
    ("web", "de"): 2.0,
    ("books", "en"): 2.0,
}


def domain_of(source: Column) -> Column:
    """Domain of a source name by the number in it: web, books or code in turn; web without one."""
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) AS bigint)")
    return F.when(number % 3 == 1, "books").when(number % 3 == 2, "code").otherwise("web")


def count_tokens(text: Column) -> Column:
    """Words between spaces, tabs and line ends; 0 for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def first_tokens(text: str, taken: str) -> Column:
    """The shortest prefix of ``text`` that holds its first ``taken`` words."""
    pieces = f"split(translate({text}, '\\t\\n\\u000b\\u000c\\r', '     '), ' ')"
    last = f"get(filter(transform(ps, (x, i) -> IF(x = '', -1, i)), i -> i >= 0), int({taken}) - 1)"
    length = f"get(transform(array({pieces}), ps -> length(array_join(slice(ps, 1, {last} + 1), ' '))), 0)"
    return F.expr(f"IF({taken} <= 0, '', substring({text}, 1, {length}))")


def _weight(level: int, weights: dict[tuple[str, ...], float]) -> Column:
    chosen = F.lit(1.0)
    for path, weight in weights.items():
        if len(path) == level + 1:
            same = F.lit(True)
            for name, value in zip(LEVELS, path, strict=False):
                same = same & (F.col(name) == value)
            chosen = F.when(same, F.lit(float(weight))).otherwise(chosen)
    return chosen


def budgets(
    leaves: DataFrame, weights: dict[tuple[str, ...], float], total: int | None, max_epochs: int
) -> DataFrame:
    """``leaves`` with ``budget``, each leaf's whole number of tokens.

    ``leaves`` has the levels and ``tokens``.  A leaf can give ``max_epochs`` times its tokens, a
    node as much as its leaves.  Among siblings with weights w and capacities c and a budget b
    for all, each gets min(c, w * x), where x uses up b; with the siblings in order of c / w, x is
    the largest of (b - sum of c before) / (sum of w from here on).  ``total`` is the root's budget,
    by default all tokens once.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    for depth in range(len(LEVELS), 0, -1):
        family = Window.partitionBy(*LEVELS[:depth])
        nodes = nodes.withColumn(f"cap{depth}", F.sum("capacity").over(family).cast("double"))
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] if total is None else total
    nodes = nodes.withColumn("share", F.lit(float(root)))
    for depth in range(1, len(LEVELS) + 1):
        parent, own = LEVELS[: depth - 1], LEVELS[:depth]
        level = nodes.select(*own, F.col(f"cap{depth}").alias("c"), F.col("share").alias("b")).distinct()
        level = level.withColumn("w", _weight(depth - 1, weights))
        by_need = Window.partitionBy(*parent).orderBy(
            F.when(F.col("w") > 0, F.col("c") / F.col("w")).asc_nulls_last(), own[-1]
        )
        before = by_need.rowsBetween(Window.unboundedPreceding, -1)
        onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        level = (
            level.withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0.0)))
            .withColumn("w_onward", F.sum("w").over(onward))
            .withColumn("x", F.when(F.col("w_onward") > 0, (F.col("b") - F.col("c_before")) / F.col("w_onward")))
            .withColumn("x", F.max("x").over(Window.partitionBy(*parent)))
            .select(*own, F.least("c", F.col("w") * F.coalesce("x", F.lit(0.0))).alias("next"))
        )
        nodes = nodes.join(level, list(own)).withColumn("share", F.col("next")).drop("next")
    return nodes.select(*LEVELS, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    weights: dict[tuple[str, ...], float] | None = None,
    total: int | None = None,
    max_epochs: int = 4,
    seed: int = 1,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, domain, lang, source, epoch, n_tokens, taken_tokens)`` and the columns ``carry``.

    One row for each time a row of ``docs`` is used; ``epoch`` counts from 0.  ``taken_tokens`` is
    ``n_tokens`` but for the document at the end of a leaf's last epoch, which is cut.  Tokens are
    words.  The order of an epoch is that of md5(seed, epoch, doc_id, md5 of the text), so copies
    and partitions don't matter; rows equal in id and text share a place, and what is left there
    is split evenly among them.

    Null languages and sources count as ``(none)``; null and empty texts have no tokens and are
    never used; a leaf without tokens gets no budget.  An empty table gives no rows.  Leaves are
    never gathered in a task: an epoch's prefix is found by bins of the order, then inside one bin.
    """
    weights = WEIGHTS if weights is None else weights
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        count_tokens(F.col("text")).alias("n_tokens"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("print"),
        *(F.col(c).alias(f"carried_{c}") for c in carry),
    ).withColumn("domain", domain_of(F.col("source")))
    # Shares and stops come from a narrow copy; only the last pass reads the carried columns.
    light = materialize(rows.select("doc_id", *LEVELS, "n_tokens", "print"), "tokens")
    rows = rows if carry else light
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    shares = budgets(materialize(leaves, "leaves"), weights, total, max_epochs).filter("budget > 0 AND tokens > 0")
    shares = materialize(
        shares.withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.col("budget") % F.col("tokens")),
        "budgets",
    )

    def placed(frame: DataFrame) -> DataFrame:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "print")
        return frame.withColumn("place", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))

    partial = placed(light.join(shares, list(LEVELS)).filter("n_tokens > 0 AND rest > 0")).withColumn("bin", F.expr(f"place div {(1 << 60) // _BINS}"))
    bins = partial.groupBy(*LEVELS, "rest", "bin").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0)))
    edge = bins.filter("before < rest AND before + t >= rest").select(*LEVELS, "bin", "before")
    inside = partial.select(*LEVELS, "rest", "bin", "place", "n_tokens").join(edge, [*LEVELS, "bin"])
    inside = inside.groupBy(*LEVELS, "rest", "before", "place").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("copies"))
    run = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("t").over(run), F.lit(0)))
    stops = inside.filter("start < rest AND start + t >= rest").select(
        *LEVELS, F.col("place").alias("stop"), F.expr("(rest - start) div copies").alias("last")
    )
    stops = materialize(stops, "stops")

    used = placed(rows.join(shares, list(LEVELS)).filter("n_tokens > 0")).join(stops, list(LEVELS), "left")
    part = F.expr("CASE WHEN rest = 0 THEN 0L WHEN place < stop THEN n_tokens WHEN place = stop THEN least(n_tokens, last) ELSE 0L END")
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).otherwise(F.array().cast("array<long>"))
    times = F.concat(
        F.transform(whole, lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("taken"))),
        F.when(F.col("part") > 0, F.array(F.struct(F.col("epochs").alias("epoch"), F.col("part").alias("taken")))).otherwise(
            F.array().cast("array<struct<epoch:bigint,taken:bigint>>")
        ),
    )
    used = used.withColumn("part", part).withColumn("times", times)
    return used.select("doc_id", *LEVELS, "n_tokens", *(f"carried_{c}" for c in carry), F.explode("times").alias("use")).select(
        "doc_id", *LEVELS, F.col("use.epoch").alias("epoch"), "n_tokens", F.col("use.taken").alias("taken_tokens"),
        *(F.col(f"carried_{c}").alias(c) for c in carry),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: the columns doc_id, text, lang, source and n_chars of ``docs``.

    A document comes once for each epoch that uses it; the one that ends a leaf's budget is cut
    after its last word in budget.  Null languages and sources stay null.
    """
    drawn = mix(
        docs.withColumn("lang_", F.col("lang")).withColumn("source_", F.col("source")),
        carry=("text", "lang_", "source_"),
        **options,
    )
    text = F.when(F.col("taken_tokens") < F.col("n_tokens"), first_tokens("text", "taken_tokens")).otherwise(F.col("text"))
    drawn = drawn.select("doc_id", text.alias("text"), F.col("lang_").alias("lang"), F.col("source_").alias("source"))
    return drawn.withColumn("n_chars", F.char_length("text").cast("long"))
