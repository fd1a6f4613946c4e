"""Dates, times and durations.

Dates are DATE, local date-times TIMESTAMP_NTZ, local times nanoseconds of the day, and durations a
struct of four independent parts, because Spark has no interval of months, days and seconds at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Average seconds of a month of 30.436875 days, by which durations are ordered.
MONTH_SECONDS = 2_629_746
_FIRST_YEAR = {"millennium": 1000, "century": 100, "decade": 10}


def _div(a: Column, b: int) -> Column:
    """Whole division towards zero, exact in 64 bits."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(text: Column, pattern: str, count: int) -> Column:
    """The groups of a text that matches a pattern from end to end, found in one pass; "" for those that are absent."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit("".join(f"${k}\x01" for k in range(1, count + 1))))
    return F.split(marked, "\x01")


def part(c: Column, name: str) -> Column:
    """A component of a date or local date-time."""
    simple = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "week": F.weekofyear,
        "ordinalDay": F.dayofyear, "hour": F.hour, "minute": F.minute,
    }
    if name in simple:
        return simple[name](c)
    if name == "weekYear":
        return F.date_part(F.lit("YEAROFWEEK"), c).cast("int")
    if name in ("weekDay", "dayOfWeek"):
        return F.weekday(c) + 1
    if name == "dayOfQuarter":
        return F.datediff(c, F.trunc(c, "quarter")) + 1
    if name == "second":
        return F.floor(F.date_part(F.lit("SECOND"), c)).cast("int")
    if name in ("millisecond", "microsecond", "nanosecond"):
        micros = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long") % 1_000_000
        return {"millisecond": F.floor(micros / 1000), "microsecond": micros, "nanosecond": micros * 1000}[name].cast("long")
    if name in ("epochSeconds", "epochMillis"):
        micros = F.unix_micros(c.cast("timestamp"))
        return F.floor(micros / (1_000_000 if name == "epochSeconds" else 1000)).cast("long")
    raise ValueError(f"no component {name}")


def truncate(unit: str, c: Column) -> Column:
    """The start of the unit a date-time lies in, as a local date-time."""
    if unit in _FIRST_YEAR:
        size = _FIRST_YEAR[unit]
        first = F.floor(F.year(c) / size) * size
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    if unit == "weekYear":
        fourth = F.make_date(part(c, "weekYear"), F.lit(1), F.lit(4))
        return F.date_trunc("week", fourth).cast("timestamp_ntz")
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def from_epoch_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c)


def from_epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def duration(months: Column | int = 0, days: Column | int = 0, seconds: Column | int = 0, nanos: Column | int = 0) -> Column:
    def whole(x: Column | int) -> Column:
        return (F.lit(x) if isinstance(x, int) else x).cast("long")

    return F.struct(whole(months).alias("months"), whole(days).alias("days"), whole(seconds).alias("seconds"), whole(nanos).alias("nanos"))


def add(c: Column, d: Column) -> Column:
    """``c`` plus a duration: months first (kept inside the month), then days, then the rest."""
    day = F.date_add(F.add_months(c.cast("date"), d["months"].cast("int")), d["days"].cast("int"))
    moment = day.cast("timestamp_ntz") + (c.cast("timestamp_ntz") - c.cast("date").cast("timestamp_ntz"))
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), d["seconds"] + d["nanos"] / 1_000_000_000)


def between(a: Column, b: Column) -> Column:
    """Whole months from ``a`` to ``b``, then whole days, then seconds."""
    months = F.months_between(b, a, False)
    whole = F.when(months >= 0, F.floor(months + 1e-12)).otherwise(F.ceil(months - 1e-12)).cast("int")
    moved = add(a, duration(months=whole))
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(moved.cast("timestamp"))
    rest = micros % 86_400_000_000
    return duration(whole, _div(micros, 86_400_000_000), _div(rest, 1_000_000), (rest % 1_000_000) * 1000)


def in_days(a: Column, b: Column) -> Column:
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return _div(micros, 86_400_000_000)


def in_seconds(a: Column, b: Column) -> Column:
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return _div(micros, 1_000_000)


def in_months(a: Column, b: Column) -> Column:
    return between(a, b)["months"]


def order_key(d: Column) -> Column:
    """What durations are compared by: seconds, with months at their average length."""
    return d["months"] * float(MONTH_SECONDS) + d["days"] * 86_400.0 + d["seconds"] + d["nanos"] / 1e9


def scale(d: Column, by: Column | float) -> Column:
    """``d * by``; what is left of a month or a day goes on as days and seconds of average length."""
    if isinstance(by, int):
        return duration(d["months"] * by, d["days"] * by, d["seconds"] * by, d["nanos"] * by)
    by = F.lit(by) if isinstance(by, float) else by
    return _cascade(d["months"] * by, d["days"] * by, (d["seconds"] + d["nanos"] / 1e9) * by)


def divide(d: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return scale(d, F.lit(1.0) / by)


def _cascade(months: Column, days: Column, seconds: Column) -> Column:
    """A duration from fractional parts: each keeps its whole part and hands the rest down."""

    def split(x: Column) -> Column:
        return _once(_toward_zero(x["m"]), lambda m: _once(x["d"] + (x["m"] - m) * (MONTH_SECONDS / 86_400), lambda d: below(x, m, d)))

    def below(x: Column, m: Column, days: Column) -> Column:
        return _once(_toward_zero(days), lambda d: _once(x["s"] + (days - d) * 86_400, lambda s: whole(m, d, s)))

    def whole(m: Column, d: Column, seconds: Column) -> Column:
        return _once(F.floor(F.round(seconds, 9)), lambda s: duration(m, d, s, F.round((seconds - s) * 1e9)))

    return _once(F.struct(*(c.cast("double").alias(n) for n, c in (("m", months), ("d", days), ("s", seconds)))), split)


def _toward_zero(c: Column) -> Column:
    return _once(F.round(c, 9), lambda r: F.when(r >= 0, F.floor(r)).otherwise(F.ceil(r)).cast("double"))


def plus(a: Column, b: Column) -> Column:
    return duration(*(a[k] + b[k] for k in ("months", "days", "seconds", "nanos")))


def negated(d: Column) -> Column:
    return duration(*(-d[k] for k in ("months", "days", "seconds", "nanos")))


def minus(a: Column, b: Column) -> Column:
    return plus(a, negated(b))


def subtract(c: Column, d: Column) -> Column:
    """A date or local date-time less a duration."""
    return add(c, negated(d))


def duration_of(
    years: Column | float = 0, quarters: Column | float = 0, months: Column | float = 0, weeks: Column | float = 0,
    days: Column | float = 0, hours: Column | float = 0, minutes: Column | float = 0, seconds: Column | float = 0,
    milliseconds: Column | float = 0, microseconds: Column | float = 0, nanoseconds: Column | float = 0,
) -> Column:
    """``duration({...})``: any components, also fractional or negative ones."""

    def c(x: Column | float) -> Column:
        return (F.lit(x) if isinstance(x, (int, float)) else x).cast("double")

    rest = c(milliseconds) / 1e3 + c(microseconds) / 1e6 + c(nanoseconds) / 1e9
    return _cascade(c(years) * 12 + c(quarters) * 3 + c(months), c(weeks) * 7 + c(days), c(hours) * 3600 + c(minutes) * 60 + c(seconds) + rest)


_DURATION = r"^([-+]?)P(?:([-+0-9.]+)Y)?(?:([-+0-9.]+)M)?(?:([-+0-9.]+)W)?(?:([-+0-9.]+)D)?(?:T(?:([-+0-9.]+)H)?(?:([-+0-9.]+)M)?(?:([-+0-9.]+)S)?)?$"


def parse_duration(text: Column) -> Column:
    """``duration('P1Y2M3W4DT5H6M7.5S')``; null for null and for text that is no duration."""

    def read(g: Column) -> Column:
        sign = F.when(g[0] == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
        y, m, w, d, h, mi, se = (F.coalesce(F.when(g[k] != "", g[k]).try_cast("double"), F.lit(0.0)) * sign for k in range(1, 8))
        return duration_of(years=y, months=m, weeks=w, days=d, hours=h, minutes=mi, seconds=se)

    return _once(text, lambda t: F.when(t.rlike(_DURATION) & (F.char_length(t) > 1), _once(_groups(t, _DURATION, 8), read)))


_WHOLE = {"years": ("months", 12), "quarters": ("months", 3), "months": ("months", 1), "weeks": ("days", 7), "days": ("days", 1),
          "hours": ("seconds", 3600), "minutes": ("seconds", 60), "seconds": ("seconds", 1)}
_INSIDE = {"quartersOfYear": ("months", 12, 3), "monthsOfYear": ("months", 12, 1), "monthsOfQuarter": ("months", 3, 1), "daysOfWeek": ("days", 7, 1),
           "minutesOfHour": ("seconds", 3600, 60), "secondsOfMinute": ("seconds", 60, 1)}
_FINE = {"milliseconds": 1000, "microseconds": 1_000_000, "nanoseconds": 1_000_000_000}


def duration_part(d: Column, name: str) -> Column:
    """A component: the whole of its group (``minutes``: of all seconds) or what is left in the next
    larger one (``minutesOfHour``)."""
    if name in _WHOLE:
        group, size = _WHOLE[name]
        return _div(d[group], size)
    if name in _INSIDE:
        group, outer, size = _INSIDE[name]
        return _div(d[group] % outer, size)
    fine = name.removesuffix("OfSecond")
    per = _FINE[fine]
    below = _div(d["nanos"], 1_000_000_000 // per)
    return below if name.endswith("OfSecond") else d["seconds"] * per + below


# Constructors.  A text that has no such form gives null.

_DATE = r"^([0-9]{4})(?:-?(?:W([0-9]{2})(?:-?([1-7]))?|Q([1-4])-?([0-9]{1,2})|([0-9]{3})|([0-9]{2})(?:-?([0-9]{2}))?))?$"
#: Forms of a date that a cast reads.
_PLAIN_DATE = r"^[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?\z"
_TIME = r"^([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)?$"
_ZONE = r"(Z|[-+][0-9]{2}(?::?[0-9]{2})?)?(?:\[([^\]]+)\])?$"


def _number(found: Column) -> Column:
    return F.when(found != "", found).try_cast("int")


def date_of(
    year: Column, month: Column | None = None, day: Column | None = None, week: Column | None = None, day_of_week: Column | None = None,
    quarter: Column | None = None, day_of_quarter: Column | None = None, ordinal_day: Column | None = None,
) -> Column:
    """``date({year, ...})`` by month and day, by week, by quarter, or by day of the year; what is left out is 1."""
    one = F.lit(1)
    year = year.cast("int")
    if week is not None:
        first = F.trunc(F.make_date(year, one, F.lit(4)), "week")
        return F.date_add(first, ((week - 1) * 7 + F.coalesce(day_of_week, one) - 1).cast("int"))
    if quarter is not None:
        return F.date_add(F.make_date(year, (quarter * 3 - 2).cast("int"), one), (F.coalesce(day_of_quarter, one) - 1).cast("int"))
    if ordinal_day is not None:
        return F.date_add(F.make_date(year, one, one), (ordinal_day - 1).cast("int"))
    return F.make_date(year, (one if month is None else F.coalesce(month, one)).cast("int"), (one if day is None else F.coalesce(day, one)).cast("int"))


def parse_date(text: Column) -> Column:
    """``date('...')``: year, year-month, year-month-day, year-Www-d, year-Qq-d and year-ddd, dashes optional."""

    def read(g: Column) -> Column:
        y, w, dw, q, dq, o, m, d = (_number(g[k]) for k in range(8))
        found = F.when(w.isNotNull(), date_of(y, week=w, day_of_week=dw)).when(q.isNotNull(), date_of(y, quarter=q, day_of_quarter=dq))
        found = found.when(o.isNotNull(), date_of(y, ordinal_day=o))
        one = F.lit(1)
        month, day = (F.lpad(F.coalesce(x, one).cast("string"), 2, "0") for x in (m, d))
        return found.otherwise(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), month, day).try_cast("date"))

    forms = lambda t: F.when(t.rlike(_PLAIN_DATE), t.try_cast("date")).when(t.rlike(_DATE), _once(_groups(t, _DATE, 8), read))
    return _once(text, forms)


def time_of(hour: Column, minute: Column | int = 0, second: Column | int = 0, nanosecond: Column | int = 0) -> Column:
    """``localtime({...})`` as nanoseconds of the day."""
    minute, second, nanosecond = (F.lit(x) if isinstance(x, int) else x for x in (minute, second, nanosecond))
    return ((hour.cast("long") * 60 + minute) * 60 + second) * 1_000_000_000 + nanosecond


def parse_time(text: Column) -> Column:
    """``localtime('hh:mm:ss.fff')``, colons optional, as nanoseconds of the day."""

    def read(g: Column) -> Column:
        numbers = F.array(*(F.coalesce(_number(g[k]), F.lit(0)) for k in range(3)))
        fraction = F.rpad(g[3], 9, "0").cast("long")
        return _once(numbers, lambda n: F.when((n[0] < 24) & (n[1] < 60) & (n[2] < 60), time_of(n[0], n[1], n[2], fraction)))

    return _once(text, lambda t: F.when(t.rlike(_TIME), _once(_groups(t, _TIME, 4), read)))


def time_part(nanos: Column, name: str) -> Column:
    size, of = {"hour": (3_600_000_000_000, 24), "minute": (60_000_000_000, 60), "second": (1_000_000_000, 60),
                "millisecond": (1_000_000, 1000), "microsecond": (1000, 1_000_000), "nanosecond": (1, 1_000_000_000)}[name]
    return _div(nanos, size) % of


def date_time(day: Column, nanos: Column) -> Column:
    """A local date-time from a date and a time of day, to the microsecond."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000 + _div(nanos, 1000)).cast("timestamp_ntz")


def parse_local_datetime(text: Column) -> Column:
    """``localdatetime('<date>T<time>')``; a date alone is its midnight.  The session's zone has to be UTC."""

    def read(both: Column) -> Column:
        at = F.when(F.size(both) > 1, parse_time(F.get(both, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        return date_time(parse_date(F.get(both, F.lit(0))), at)

    return _once(F.split(text, "T", 2), read)


def parse_datetime(text: Column, default_zone: str = "UTC") -> Column:
    """``datetime('...')``: struct of the local date-time ``local``, ``offset`` in seconds and ``zone``.

    An offset (``Z``, ``+02``, ``+02:00``) or a region in brackets may follow; a region without an
    offset has that of its rules at that time.
    """

    def offset_of(mark: Column) -> Column:
        digits = F.regexp_replace(mark, "[^0-9]", "")
        size = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
        return F.when(mark == "Z", F.lit(0)).when(mark != "", F.when(mark.startswith("-"), -size).otherwise(size))

    def join(x: Column) -> Column:
        local, zone = x["local"], F.when(x["zone"] != "", x["zone"])
        by_rules = _seconds(local) - _seconds(F.to_utc_timestamp(local.cast("timestamp"), F.coalesce(zone, F.lit(default_zone))))
        offset = F.coalesce(x["given"], by_rules.cast("int"))
        return F.when(local.isNotNull(), F.struct(local.alias("local"), offset.alias("offset"), zone.alias("zone")))

    def read(t: Column) -> Column:
        local = parse_local_datetime(F.regexp_extract(t, r"^([^T\[]*(?:T[^-+Z\[]*)?)", 1))
        given = _once(F.regexp_extract(t, r"T[^-+Z\[]*(Z|[-+][0-9:]+)", 1), offset_of)
        return _once(F.struct(local.alias("local"), F.regexp_extract(t, _ZONE, 2).alias("zone"), given.alias("given")), join)

    return _once(text, read)


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


def zone_part(moment: Column, name: str) -> Column:
    """``offset`` as text, ``offsetSeconds``, ``offsetMinutes``, ``timezone``, ``epochSeconds``, ``epochMillis``."""
    seconds = moment["offset"]
    text = F.format_string("%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"), _div(F.abs(seconds), 3600), _div(F.abs(seconds) % 3600, 60))
    text = F.when(seconds == 0, F.lit("Z")).otherwise(text)
    micros = F.unix_micros(moment["local"].cast("timestamp")) - seconds.cast("long") * 1_000_000
    return {
        "offset": text, "offsetSeconds": seconds, "offsetMinutes": _div(seconds, 60), "timezone": F.coalesce(moment["zone"], text),
        "epochSeconds": F.floor(micros / 1_000_000), "epochMillis": F.floor(micros / 1000),
    }[name]


def now(clock: str = "statement") -> Column:
    """``datetime.statement()`` and ``.transaction()``: the start of the query, one value for all rows, as
    a query is its own transaction here; ``.realtime()`` is the same, as Spark has no clock for each row."""
    if clock not in ("statement", "transaction", "realtime"):
        raise ValueError(f"no clock {clock}")
    return F.current_timestamp()


def truncate_date(unit: str, c: Column, day: Column | int | None = None) -> Column:
    """``date.truncate(unit, c, {day: ...})``: a date; ``day`` replaces the day of the month."""
    first = truncate(unit, c).cast("date")
    return first if day is None else F.make_date(F.year(first), F.month(first), F.lit(day) if isinstance(day, int) else day)
