"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule says whether a text fails it.  A bounded sample tells how long a rule takes and how much
it rejects; the rules then run in the order of rejection per cost, and a text that fails one rule is
not put through the dearer ones behind it.  The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_REPEATS = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the text column ``t``, the word array ``words`` and the base counts."""

    name: str
    fails: str


#: Thresholds of common web-text filters; each looks at the whole text.
RULES = [
    Rule("symbols", "n_symbols > 0.3 * n_words"),
    Rule("short_words", "word_chars < 2.0 * n_words"),
    Rule("long_words", "word_chars > 16.0 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0 AND 10 * n_dup_lines > 3 * size(filter(split(t, '\\n'), x -> rlike(x, '[^ \\\\t-\\\\r]')))"),
    Rule("shouting", "2 * length(regexp_replace(t, '[^\\\\p{Lu}]+', '')) > word_chars"),
    Rule("few_letters", "2 * length(regexp_replace(t, '[^\\\\p{L}]+', '')) < word_chars"),
    Rule("exclamations", "length(t) - length(replace(t, '!', '')) > 0.3 * n_words"),
    Rule("few_distinct_words", "n_words >= 30 AND 10 * size(array_distinct(words)) < n_words"),
    Rule("ellipsis_lines", "instr(t, '...') > 0 AND n_words > 0 AND 3 * size(filter(split(t, '\\n'), x -> rtrim(x) LIKE '%...')) > size(split(t, '\\n'))"),
]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return."""
    plain = F.translate(text, _SPACES, " " * len(_SPACES))
    return F.array_remove(F.split(plain, " "), "")


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once under ``name``, wherever the optimiser moves it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def repeat_words(words: str, width: int = 5) -> str:
    """SQL for the number of words inside ``width``-word windows that occur twice or more.

    Windows are compared by the 64-bit XXH64 of their words' XXH64s.  Texts without a repeated window, found by a hash
    set, stop there; for the rest the windows are sorted by hash, the ones equal to a neighbour
    are put back in text order, and the stretches they cover are added up.
    """
    windows = (
        f"IF(size(w) < {width}, CAST(array() AS array<bigint>), transform(sequence(0, size(w) - {width}),"
        f" i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(width))})))"
    )
    spots = "sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i)))"
    places = (
        "sort_array(transform(filter(spots, (s, k) -> (k > 0 AND get(spots, k - 1).h = s.h)"
        " OR (k + 1 < size(spots) AND get(spots, k + 1).h = s.h)), s -> s.i))"
    )
    covered = (
        f"{width}L + aggregate(sequence(1, size(places) - 1), 0L,"
        f" (a, k) -> a + least({width}, get(places, k) - get(places, k - 1)))"
    )
    return _let(
        "w",
        f"transform({words}, x -> xxhash64(x))",
        _let(
            "hashes",
            windows,
            "CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE "
            + _let("spots", spots, _let("places", places, covered))
            + " END",
        ),
    )


def base_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the text as ``t``, its ``words``, and its base counts.

    Each count is one expression that computes its parts once.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("words", words_of(F.col("t")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    has_word = "filter(split(t, '\\n'), x -> rlike(x, '[^ \\\\t-\\\\r]'))"
    return rows.select(
        *keep,
        "t",
        "words",
        "n_words",
        F.char_length(F.translate("t", " " + _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(f"CAST({_let('ls', has_word, 'size(ls) - size(array_distinct(ls))')} AS BIGINT)").alias("n_dup_lines"),
        F.expr(repeat_words("words")).alias("n_repeat_words"),
    )


def _base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def plan_cascade(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """``rules`` by rejection per second, measured on about ``sample_rows`` texts of ``docs``.

    The sample is a random share of all rows, drawn where they are read, so nothing is gathered.  It
    is written once; each rule is timed over every text ``_REPEATS`` times in one aggregation, the
    fastest of three runs, less the time of a rule that always passes.  A rule that rejects nothing
    comes last, cheapest first.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = base_counts(docs.sample(share, seed=5) if share < 1 else docs, keep=())
    sample = materialize(drawn.filter(~_base_failed()), "rule-sample")
    often = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(_REPEATS))))

    def timed(fails: str) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(3):
            began = time.perf_counter()
            hits = often.agg(F.count_if(F.expr(fails))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    idle, _ = timed("n_words < 0")
    measured = []
    for place, rule in enumerate(rules):
        seconds, hits = timed(rule.fails)
        cost = max(seconds - idle, 1e-3)
        measured.append((-hits / cost, cost, place, rule))
    discard(sample)
    return [m[-1] for m in sorted(measured, key=lambda m: m[:3])]


def cascade(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule)``.

    One row for each row of ``docs``.  ``base_failed`` texts are not kept and pass through no
    rule; for the rest ``failed_rule`` names the first rule of the cascade that rejects the text,
    and ``kept`` tells that there is none.  A null text counts as empty (no words, so it fails).
    Null doc_ids and repeated rows are kept as they are; other columns are not read.  Whole texts
    are counted, of any length; an empty table gives an empty result.
    """
    ordered = plan_cascade(docs, rules, sample_rows)
    first = F.when(_base_failed(), F.lit(None).cast("string"))
    for rule in ordered:
        first = first.when(F.expr(rule.fails), F.lit(rule.name))
    rows = base_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _base_failed().alias("base_failed"),
        first.alias("failed_rule"),
    )
    return rows.withColumn("kept", F.col("failed_rule").isNull() & ~F.col("base_failed"))
