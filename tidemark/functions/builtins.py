"""Scalar, string and array builtins of the rule language, and its table aggregates, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def sign(x: Column) -> Column:
    return F.signum(x).cast("bigint")


def round_int(x: Column) -> Column:
    return F.round(x).cast("bigint")


def to_bool(x: Column) -> Column:
    """By the integer part, so 0.5 is false."""
    return x.cast("bigint") != 0


def byte_len(s: Column) -> Column:
    return F.octet_length(s)


def substring(s: Column, start: int, end: int) -> Column:
    """0-based, end excluded, in characters."""
    return F.substring(s, start + 1, max(end - start, 0))


def index_of(s: Column, part: Column) -> Column:
    """0-based byte offset, -1 where absent."""
    at = F.instr(s, part)
    return F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), at - 1))).otherwise(-1)


def split_literal(s: Column, separator: str) -> Column:
    return F.split(s, r"\Q" + separator.replace(r"\E", r"\E\\E\Q") + r"\E")


def parse_int(s: Column) -> Column:
    return F.coalesce(s.try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_float(s: Column) -> Column:
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def char_at(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1)


def array_len(a: Column) -> Column:
    return F.when(a.isNull(), 0).otherwise(F.size(a))


def array_slice(a: Column, start: int, end: int) -> Column:
    """0-based, end excluded, clamped to the array."""
    n = F.size(a)
    lo = F.least(F.lit(max(start, 0)), n)
    return F.slice(a, lo + 1, F.greatest(F.least(F.lit(end), n) - lo, F.lit(0)))


def array_first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def array_last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def array_pop(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def array_remove_at(a: Column, i: int) -> Column:
    return F.filter(a, lambda _, k: k != i)


def number_or_zero(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def sum_field(c: str) -> Column:
    """Missing and non-numeric values count as 0; 0 over no rows."""
    return F.coalesce(F.sum(number_or_zero(c)), F.lit(0.0))


def avg_field(c: str) -> Column:
    """Over all rows, missing ones too; 0 over no rows."""
    return F.coalesce(F.sum(number_or_zero(c)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def min_field(c: str) -> Column:
    return F.coalesce(F.min(F.col(c).try_cast("double")), F.lit(MAX_DOUBLE))


def max_field(c: str) -> Column:
    return F.coalesce(F.max(F.col(c).try_cast("double")), F.lit(-MAX_DOUBLE))


def count_by_field(df: DataFrame, field: str) -> DataFrame:
    """Rows per value in text form, nulls left out."""
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_field_values(df: DataFrame, field: str) -> DataFrame:
    """Values distinct in text form; null is the text `null`."""
    return df.select(F.coalesce(F.col(field).cast("string"), F.lit("null")).alias("value")).distinct()


def find_all(df: DataFrame, field: str, value) -> DataFrame:
    """Rows whose field equals the value; a null value finds null fields."""
    return df.where(F.col(field).eqNullSafe(F.lit(value)))


def find_first(df: DataFrame, field: str, value, key: str) -> DataFrame:
    return find_all(df, field, value).orderBy(key).limit(1)


def top_n(df: DataFrame, field: str, n: int, key: str, descending: bool = True) -> DataFrame:
    """Rows with the field in order; ties by key ascending both ways; rows without the field are left out."""
    first = F.col(field).desc() if descending else F.col(field).asc()
    return df.where(F.col(field).isNotNull()).orderBy(first, key).limit(n)


def bulk_update(df: DataFrame, pred: Column, **sets: Column) -> DataFrame:
    """UPDATE: every assignment sees the old row; unknown predicates leave a row alone."""
    hit = F.coalesce(pred, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in sets.items()})


def bulk_delete(df: DataFrame, pred: Column) -> DataFrame:
    """DELETE: rows with an unknown predicate stay."""
    return df.where(~F.coalesce(pred, F.lit(False)))
