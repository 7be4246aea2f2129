"""Dates as packs print them: ranges with a precision, and periods, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.once import let

# The forms of dates that packs print. A date means what these say, so they must match those of every
# other reader of the same packs.
SEP = r"[/.\-\s]"
ISO = r"\b(\d{4})-(\d{1,2})\b"
DMY = rf"\b(\d{{1,2}}){SEP}{{1,2}}(\d{{1,2}}){SEP}{{1,2}}(\d{{2,4}})\b"
NAMED = rf"(?i)\b(?:(\d{{1,2}}){SEP}{{0,2}})?([a-z]{{3,9}}){SEP}{{0,2}}(\d{{2,4}})\b"
MY = rf"\b(\d{{1,2}}){SEP}{{1,2}}(\d{{4}})\b"
PERIOD = r"(?i)(\d{1,3})\s*(day|days|week|weeks|month|months|year|years)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where the calendar has none or the year is not in 1900..2200."""
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.between(1900, 2200) & m.between(1, 12) & d.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def _range(first: Column, last: Column, precision: str) -> Column:
    return F.when(first.isNotNull(), F.struct(first.alias("earliest"), last.alias("latest"), F.lit(precision).alias("precision")))


def label_date(c: Column) -> Column:
    """struct(earliest, latest, precision) of the first form that is found, null if it is no date.

    Forms in order: year-month, three numbers (both orders, kept as a range if both are dates),
    named month, month and year. Two-digit years are this century.
    """
    c = F.trim(c)
    name = F.substring(F.lower(F.regexp_extract(c, NAMED, 2)), 1, 3)
    parts = {
        "iso": F.regexp_like(c, F.lit(ISO)), "iy": _part(c, ISO, 1), "im": _part(c, ISO, 2),
        "dmy": F.regexp_like(c, F.lit(DMY)), "a": _part(c, DMY, 1), "b": _part(c, DMY, 2), "y": _part(c, DMY, 3),
        "month": F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name), F.lit(0)).cast("int"),
        "nd": _part(c, NAMED, 1), "ny": _part(c, NAMED, 3),
        "my": F.regexp_like(c, F.lit(MY)), "mm": _part(c, MY, 1), "yy": _part(c, MY, 2),
    }

    def dates(p: Column) -> Column:
        return F.struct(
            _day(p["iy"], p["im"], F.lit(1)).alias("iso"), _day(_year(p["y"]), p["b"], p["a"]).alias("day_first"),
            _day(_year(p["y"]), p["a"], p["b"]).alias("month_first"), _day(_year(p["ny"]), p["month"], F.coalesce(p["nd"], F.lit(1))).alias("named"),
            _day(p["yy"], p["mm"], F.lit(1)).alias("month"), p.alias("p"))

    def chosen(d: Column) -> Column:
        one, two = d["day_first"], d["month_first"]
        three = F.when(one != two, _range(F.least(one, two), F.greatest(one, two), "AMBIGUOUS_ORDER")).otherwise(_range(F.coalesce(one, two), F.coalesce(one, two), "DAY"))
        month = lambda x: _range(x, F.last_day(x), "MONTH")
        named = F.when(d["p"]["nd"].isNull(), month(d["named"])).otherwise(_range(d["named"], d["named"], "DAY"))
        return F.when(d["p"]["iso"], month(d["iso"])).when(d["p"]["dmy"], three).when(d["p"]["month"].isNotNull(), named).when(d["p"]["my"], month(d["month"]))

    return let({"d": let(parts, dates)}, lambda v: chosen(v["d"]))


def label_period(c: Column) -> Column:
    """struct(months, days) of the first number with a unit of time; null without one."""
    n, unit = _part(c, PERIOD, 1), F.rtrim(F.lower(F.regexp_extract(c, PERIOD, 2)), F.lit("s"))
    months = F.when(unit == "month", n).when(unit == "year", n * 12).otherwise(F.lit(0))
    days = F.when(unit == "day", n).when(unit == "week", n * 7).otherwise(F.lit(0))
    return F.when(n.isNotNull(), F.struct(months.alias("months"), days.alias("days")))


def date_shift(date: Column, period: Column) -> Column:
    """The range moved by a period: months first, clamped to the month's end, then days."""
    move = lambda d: F.date_add(F.add_months(d, period["months"]), period["days"])
    return F.when(date.isNotNull() & period.isNotNull(), F.struct(move(date["earliest"]).alias("earliest"), move(date["latest"]).alias("latest"), date["precision"].alias("precision")))


def describe(date: Column) -> Column:
    month, day = "MMM yyyy", "yyyy-MM-dd"
    return (
        F.when(date["precision"] == "MONTH", F.date_format(date["earliest"], month))
        .when(date["precision"] == "AMBIGUOUS_ORDER", F.concat(F.date_format(date["earliest"], day), F.lit(" or "), F.date_format(date["latest"], day)))
        .otherwise(F.date_format(date["earliest"], day))
    )


def resolved(df: DataFrame, text: str, **makes) -> DataFrame:
    """df with, per keyword, make(text) added: each distinct text is read once, however many rows print it.

    makes: name=function of a column, such as d=label_date. Null texts give null.
    """
    texts = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    read = texts.select("__text", *[make(F.col("__text")).alias(name) for name, make in makes.items()])
    return df.join(read, F.col(text) == F.col("__text"), "left").drop("__text")


def certainly_after(a: Column, b: Column) -> Column:
    """Every day that a can mean is behind every day that b can mean."""
    return a["earliest"] > b["latest"]


def possibly_after(a: Column, day: Column) -> Column:
    """Some day that a can mean is behind the day."""
    return a["latest"] > day


def certainly_before(a: Column, day: Column) -> Column:
    return a["latest"] < day


def certain(a: Column) -> Column:
    """The range is one day."""
    return a["earliest"] == a["latest"]
