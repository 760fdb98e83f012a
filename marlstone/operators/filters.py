"""Filters that jobs share: dates, months, texts, missing values, capped lists. All of them reach the scan where they can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(df: DataFrame, date: str, column: str = "date") -> DataFrame:
    """Nothing dated later; to be applied before any window or aggregate."""
    return df.filter(F.col(column) <= F.to_date(F.lit(date)))


def between(df: DataFrame, first: str, last: str, column: str = "date") -> DataFrame:
    return df.filter(F.col(column).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def in_months(df: DataFrame, months: list[str], column: str = "date") -> DataFrame:
    """Rows of some months (yyyy-MM), as date ranges so that files can be skipped by their statistics."""
    wanted = F.lit(False)
    for m in sorted(set(months)):
        first = F.to_date(F.lit(f"{m}-01"))
        wanted = wanted | ((F.col(column) >= first) & (F.col(column) < F.add_months(first, 1)))
    return df.filter(wanted)


def targeted(articles: DataFrame, since: str, prefix: str, pattern: str) -> DataFrame:
    """Articles from a date on, whose headline begins with prefix and that have pattern, in any case, in headline and text."""
    regex = F.lit("(?iu)" + pattern)
    return articles.filter(
        (F.col("date") >= F.to_date(F.lit(since))) & F.startswith("headline", F.lit(prefix)) & F.regexp_like("headline", regex) & F.regexp_like("text", regex))


def named_like(name: Column, stem: str) -> Column:
    """Whether a snake_case name is or begins with the stem, or has it after an underscore."""
    plain = stem.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")
    return name.like(f"{plain}%") | name.like(f"%\\_{plain}%")


def is_missing(text: Column, number: Column, markers: list[str | float]) -> Column:
    """Blank cells, text markers in any case, and numbers equal to a marker."""
    words = [m.strip().lower() for m in markers if isinstance(m, str)]
    values = [float(m) for m in markers if not isinstance(m, str)]
    blank = number.isNull() & (F.btrim(F.coalesce(text, F.lit(""))) == "")
    marked = F.coalesce(F.lower(F.btrim(text)).isin(words), F.lit(False)) if words else F.lit(False)
    return blank | marked | (F.coalesce(number.isin(values), F.lit(False)) if values else F.lit(False))


def actual_only(fmt: Column) -> Column:
    """Whether a number format does not mark a forecast by a quoted f."""
    return ~F.coalesce(F.regexp_like(fmt, F.lit(r'(?i)"\s*f\s*"')), F.lit(False))


def skipped(labels: Column, row: Column, words: list[str], rows: list[int]) -> Column:
    """Whether a row goes: one of its labels holds a word, in any case, or its number is listed."""
    def has(word: str) -> Column:
        return F.exists(labels, lambda x: F.coalesce(F.contains(F.lower(x), F.lit(word.lower())), F.lit(False)))

    out = row.isin(rows) if rows else F.lit(False)
    for w in words:
        out = out | has(w)
    return out


def capped(df: DataFrame, *order: Column | str, rows: int = 50) -> DataFrame:
    """The first rows of an order."""
    return df.orderBy(*order).limit(rows)
