"""Full-text lookup: nodes scored by how many distinct query terms their text holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import trim

# The words that the standard analyser leaves out.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def standard_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words, each once."""
    runs = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.filter(runs, lambda x: (x != "") & ~x.isin(STOP_WORDS)))


def keyword_terms(text: Column) -> Column:
    """The whole text as its only term, trimmed and in lower case."""
    return F.array_compact(F.array(F.lower(trim(text))))


def query_nodes(nodes: DataFrame, text: str, query: str, analyzer: str = "standard", every: bool = False) -> DataFrame:
    """``(node, score)``: nodes that hold a term of ``query``, or all of them with ``every``.

    The score is the number of distinct query terms met.  Order by score descending, then node, to
    list them.  The query's terms are looked up in each text's own term list, so texts are neither
    exploded nor shuffled.
    """
    terms = standard_terms if analyzer == "standard" else keyword_terms
    wanted = terms(F.lit(query))
    found = nodes.select(F.col("id").alias("node"), F.size(F.array_intersect(terms(F.col(text)), wanted)).cast("long").alias("score"))
    return found.filter((F.col("score") == F.size(wanted)) & (F.col("score") > 0) if every else F.col("score") > 0)
