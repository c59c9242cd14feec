"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1048576


def filled(column: Column) -> Column:
    """The column, with empty strings as null."""
    return F.nullif(column, F.lit(""))


def day_key(day: Column, date: Column) -> Column:
    """Partition of a record: its day, else the first ten characters of its date, else ``unknown``."""
    return F.coalesce(filled(day), filled(F.substring(date, 1, 10)), F.lit("unknown"))


def epoch_ms(stamp: Column) -> Column:
    """Milliseconds of an ISO timestamp string; null where it can't be read."""
    return F.floor(F.unix_micros(F.try_to_timestamp(stamp)) / 1000).cast("long")


def one_decimal(value: Column) -> Column:
    """Half-up text with one decimal; exact for sizes, which are whole bytes over a power of two."""
    return F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10)


def size_text(size: Column) -> Column:
    return F.concat(one_decimal(size / F.lit(float(MIB))), F.lit(" MiB"))


def rounded(value: Column) -> Column:
    """Nearest whole number, halves upwards (also below zero)."""
    return F.floor(value + 0.5).cast("long")


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def compact_number(n: Column) -> Column:
    """Three significant digits with k, M or B from a thousand on, without trailing zeros."""
    def scaled(unit: int, suffix: str) -> Column:
        # Rounded half up in whole hundredths, tenths or units, so that no binary fraction decides a tie.
        part = lambda k: F.floor((n * k + unit // 2) / F.lit(unit)).cast("double") / k
        x = n / F.lit(float(unit))
        text = F.when(x < 9.995, F.format_string("%.2f", part(100))).when(x < 99.95, F.format_string("%.1f", part(10))).otherwise(F.format_string("%.0f", part(1)))
        bare = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
        return F.concat(bare, F.lit(suffix))

    return F.when(n < 1000, n.cast("string")).when(n < 999_500, scaled(1000, "k")).when(n < 999_500_000, scaled(10**6, "M")).otherwise(scaled(10**9, "B"))
