"""Value rules and scalar functions as Column builders, where they differ from Spark's own.

Null is the largest value in an order; NaN equals nothing; integer division truncates and float
division by zero gives an infinity or NaN; string positions count from 0; ``split`` and ``replace``
take their argument literally.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(c: Column) -> Column:
    return c.asc_nulls_last()


def desc(c: Column) -> Column:
    return c.desc_nulls_first()


def _no_nan(*sides: Column) -> Column:
    """False where a side is NaN; Spark holds NaN equal to itself and largest.  Any type may be given."""
    out = F.lit(True)
    for c in sides:
        out = out & ~F.coalesce(c.cast("string") == "NaN", F.lit(False))
    return out


def equal(a: Column, b: Column) -> Column:
    """``=`` on numbers: null if a side is null, false if a side is NaN."""
    return (a == b) & _no_nan(a)


def same(a: Column, b: Column) -> Column:
    """``=`` on strings, booleans, temporal values, lists and points: null if a side is null."""
    return a == b


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def less(a: Column, b: Column) -> Column:
    """``<``: null if a side is null, false if a side is NaN."""
    return (a < b) & _no_nan(a, b)


def less_equal(a: Column, b: Column) -> Column:
    return (a <= b) & _no_nan(a, b)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def greater_equal(a: Column, b: Column) -> Column:
    return less_equal(b, a)


def xor(a: Column, b: Column) -> Column:
    return a != b


def int_divide(a: Column, b: Column) -> Column:
    """Truncating division; division by zero is an error."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def float_divide(a: Column, b: Column) -> Column:
    """Division with infinities and NaN in place of errors."""
    over = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, over).otherwise(a / F.when(b != 0, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def matches(text: Column, pattern: str) -> Column:
    """``=~``: the whole string matches."""
    return text.rlike(f"\\A(?:{pattern})\\z")


def is_in(value: Column, items: Column) -> Column:
    """Membership: null if the answer hangs on a null."""
    found = F.exists(items, lambda x: x == value)
    return F.when(F.size(items) == 0, F.lit(False)).otherwise(found)


def index(items: Column, at: Column | int) -> Column:
    """``items[at]`` with negative positions from the end; null outside or at null."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.get(items, F.when(at >= 0, at).otherwise(F.when(F.size(items) + at >= 0, F.size(items) + at).otherwise(F.size(items))))


def map_index(items: Column, key: Column | str) -> Column:
    """``map[key]``; null for a key that isn't there."""
    return F.try_element_at(items, F.lit(key) if isinstance(key, str) else key)


def slice_(items: Column, start: Column | int | None, stop: Column | int | None) -> Column:
    """``items[start..stop]``: half open, clamped, negative from the end; null if a bound is null."""
    n = F.size(items)

    def clamp(at: Column | int | None, default: Column) -> Column:
        if at is None:
            return default
        at = F.lit(at) if isinstance(at, int) else at
        place = F.when(at >= 0, at).otherwise(n + at)
        return F.when(at.isNotNull(), F.greatest(F.lit(0), F.least(place, n)).cast("int"))

    first, last = clamp(start, F.lit(0)), clamp(stop, n)
    return F.slice(items, first + 1, F.greatest(last - first, F.lit(0)))


def range_(first: Column, last: Column, step: Column | int = 1) -> Column:
    """Inclusive range; a step away from ``last`` gives an empty list, a step of 0 is an error."""
    step = F.lit(step) if isinstance(step, int) else step
    checked = F.when(step != 0, step).otherwise(F.raise_error(F.lit("the step of a range can't be 0")).cast("long"))
    empty = ((step > 0) & (first > last)) | ((step < 0) & (first < last))
    whole = F.sequence(first.cast("long"), F.when(empty, first).otherwise(last).cast("long"), F.when(empty & (step < 0), F.lit(1)).otherwise(checked).cast("long"))
    return F.when(empty, F.array().cast("array<long>")).otherwise(whole)


def tail(items: Column) -> Column:
    """All but the first element; of null the empty list."""
    return F.coalesce(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(0))), F.slice(F.array(), 1, 0))


def head(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def none_of(items: Column, test) -> Column:
    return ~F.exists(items, test)


def single_of(items: Column, test) -> Column:
    """Exactly one element passes: false at two, else null if a test was null."""
    yes = F.size(F.filter(items, test))
    unknown = F.size(F.filter(items, lambda x: test(x).isNull()))
    return F.when(items.isNull(), F.lit(None).cast("boolean")).when(yes > 1, F.lit(False)).when(unknown == 0, yes == 1)


def to_integer(c: Column) -> Column:
    """A string's integer, or its float without fraction; null if it is neither or too large."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def to_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def to_boolean(c: Column) -> Column:
    """'true' and 'false' in any case; null for any other string."""
    text = F.lower(trim(c))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def round_(c: Column, digits: int = 0) -> Column:
    """Half away from zero, as a float; ``digits`` is honoured."""
    return F.round(c.cast("double"), digits)


def sign(c: Column) -> Column:
    return F.signum(c).cast("long")


_SPACE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A{_SPACE}+", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}+\\z", "")


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"\\A{_SPACE}+|{_SPACE}+\\z", "")


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """From position ``start``, counted from 0 and at least 0; to the end without ``length``."""
    start = max(start, 0)
    if length is None:
        return F.substring(c, F.lit(start + 1), F.greatest(F.char_length(c), F.lit(0)))
    return F.substring(c, start + 1, max(length, 0))


def replace(c: Column, search: str, by: str) -> Column:
    """All occurrences; an empty ``search`` matches around every character."""
    if search == "":
        return F.regexp_replace(c, "", re.sub(r"([\\$])", r"\\\1", by))
    return F.replace(c, F.lit(search), F.lit(by))


def split(c: Column, delimiter: str) -> Column:
    """Literal delimiter; an empty one gives the characters."""
    if delimiter == "":
        return F.filter(F.split(c, ""), lambda x: x != "")
    return F.split(c, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", delimiter), -1)


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, max(n, 0))


def right(c: Column, n: int) -> Column:
    return F.when(c.isNotNull(), F.right(c, F.lit(max(n, 0))))


def keys_present(columns: list[str]) -> Column:
    """``keys(n)``: names of the columns that are not null."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns)))


def list_plus(a: Column, b: Column, a_is_list: bool = True, b_is_list: bool = True) -> Column:
    """``+`` with lists: joined, or an element put behind or before; null if a side is null."""
    left = a if a_is_list else F.array(a)
    right = b if b_is_list else F.array(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(left, right))


def text_plus(a: Column, b: Column) -> Column:
    """``+`` with a string: the other side's text is joined to it; null if a side is null."""
    return F.concat(a.cast("string"), b.cast("string"))


def has_labels(labels: Column, *wanted: str) -> Column:
    """``n:A:B`` on a list of labels; null for a null node."""
    out = F.lit(True)
    for w in wanted:
        out = out & F.array_contains(labels, w)
    return F.when(labels.isNotNull(), out)


def properties(columns: list[str]) -> Column:
    """``properties(n)``: the columns that are not null, as a map from name to text."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def keys(items: Column) -> Column:
    """``keys(map)``, sorted."""
    return F.array_sort(F.map_keys(items))


def exists(c: Column) -> Column:
    return c.isNotNull()


def start_node(rel: str) -> Column:
    """Id of the node that the bound relationship ``rel`` starts from, whichever way it was followed."""
    return F.col(f"{rel}__src")


def end_node(rel: str) -> Column:
    return F.col(f"{rel}__dst")
