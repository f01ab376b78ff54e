"""Column expressions for cleaning: typed casts, keys, masks, periods, rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fjordbook.schema import AMOUNTS, SPARK_TYPES

UNSPECIFIED_INDUSTRY = "00.000"


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def typed(value: Column, kind: str) -> Column:
    """Cast a text column to ``kind``; empty and unreadable values become null."""
    text = blank_to_null(value)
    if kind == "text":
        return text
    cast = text.try_cast(SPARK_TYPES[kind])
    return F.coalesce(cast, F.lit(False)) if kind == "flag" else cast


def unreadable(value: Column, kind: str) -> Column:
    """True where a non-empty value does not fit its type."""
    if kind == "text":
        return F.lit(False)
    text = blank_to_null(value)
    return text.isNotNull() & text.try_cast(SPARK_TYPES[kind]).isNull()


def real_industry(code: Column, value: Column | None = None) -> Column:
    """The industry code (or a column that describes it), null where the code is a placeholder."""
    return F.when(~code.eqNullSafe(F.lit(UNSPECIFIED_INDUSTRY)), code if value is None else value)


def org_key(value: Column) -> Column:
    """Nine-digit key with leading zeros restored."""
    return F.lpad(F.trim(value), 9, "0")


def clean_text(value: Column) -> Column:
    return blank_to_null(F.trim(value))


def holder_kind(identifier: Column) -> Column:
    """True for a person (a birth year), false for a company (a key), null when neither."""
    return F.when(identifier.rlike(r"^\d{4}$"), True).when(identifier.rlike(r"^\d{9}$"), False)


def post_code(address: Column) -> Column:
    return blank_to_null(F.regexp_extract(address, r"^(\d{4})\s+(.+)$", 1))


def post_place(address: Column) -> Column:
    return blank_to_null(F.regexp_extract(address, r"^(\d{4})\s+(.+)$", 2))


def share_percent(shares: Column, total: Column) -> Column:
    return F.when(total > 0, (F.lit(100) * shares.cast("decimal(20,0)") / total.cast("decimal(20,0)")).cast("decimal(9,6)"))


def period_end(year: Column, month: Column) -> Column:
    """Last day of the fiscal period; an unspecified month (0 or null) is December."""
    return F.last_day(_period_month(year, month))


def period_start(year: Column, month: Column) -> Column:
    return F.add_months(_period_month(year, month), -11)


def _period_month(year: Column, month: Column) -> Column:
    return F.make_date(year, F.coalesce(F.nullif(month, F.lit(0)), F.lit(12)), F.lit(1))


def to_thousand(amount: Column) -> Column:
    """Amount rounded to the nearest thousand, halves away from zero."""
    return (F.round(amount / 1000, 0) * 1000).cast("decimal(20,2)")


def from_thousands(text: Column) -> Column:
    """Text in thousands as an amount; empty and non-numeric values are null."""
    return (F.round(blank_to_null(F.trim(text)).try_cast("decimal(20,4)"), 0) * 1000).cast("decimal(20,2)")


def round_amounts(columns: Iterable[str] = AMOUNTS) -> dict[str, Column]:
    """For ``df.withColumns``: every amount column rounded to the nearest thousand."""
    return {c: to_thousand(F.col(c)) for c in columns}


def person_name(first: Column, middle: Column, last: Column) -> Column:
    return blank_to_null(F.concat_ws(" ", blank_to_null(first), blank_to_null(middle), blank_to_null(last)))


def first_name_key(first_name: Column) -> Column:
    """The key a first name is looked up by: its first word in upper case."""
    return F.upper(F.split_part(first_name, F.lit(" "), F.lit(1)))


def description(activity: str = "aktivitet", purpose: str = "vedtektsfestet_formaal") -> Column:
    """What a company says it does; the stated purpose stands in for a missing activity."""
    return F.coalesce(F.col(activity), F.col(purpose))


def snippet(text: Column, width: int = 160) -> Column:
    return F.left(text, F.lit(width))


def county_of(municipality: Column) -> Column:
    return F.substring(municipality, 1, 2)


