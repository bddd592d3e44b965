"""Column helpers for the semantics that differ from ANSI SQL.

Standard SQL is the default everywhere; these are opt-in. `kv` is the schemaless dialect (null equals null, division is floating), `pg` the
typed one. Both know only true and false: an unknown comparison is false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq_ns(a: Column, b: Column) -> Column:
    """kv equality: null equals null."""
    return a.eqNullSafe(b)


def ne_ns(a: Column, b: Column) -> Column:
    """kv inequality: true where exactly one side is null."""
    return ~a.eqNullSafe(b)


def two_valued(cond: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def not2(cond: Column) -> Column:
    """NOT over two-valued logic: not null is true."""
    return ~two_valued(cond)


def truthy_number(x: Column) -> Column:
    return two_valued(x != 0)


def truthy_text(x: Column) -> Column:
    return two_valued(F.length(x) > 0)


def in2(x: Column, values: list) -> Column:
    """pg IN list: a null never matches."""
    return two_valued(x.isin(*[v for v in values if v is not None]))


def in_kv(x: Column, values: list) -> Column:
    """kv IN list: a null in the list matches a null needle."""
    some = in2(x, values)
    return some | x.isNull() if None in values else some


def between_kv(x: Column, lo: Column, hi: Column) -> Column:
    """kv BETWEEN: null ranks above every value."""
    above = F.when(x.isNull(), True).when(lo.isNull(), False).otherwise(x >= lo)
    below = F.when(hi.isNull(), True).when(x.isNull(), False).otherwise(x <= hi)
    return above & below


def div_kv(a: Column, b: Column) -> Column:
    """Always floating; by zero gives null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mod_kv(a: Column, b: Column) -> Column:
    """On integers (floats are truncated), sign of the dividend; by zero gives null."""
    x, y = a.cast("bigint"), b.cast("bigint")
    return F.when(y != 0, x % F.when(y != 0, y).otherwise(F.lit(1)))


def div_pg(a: Column, b: Column) -> Column:
    """Integer division truncates towards zero and fails on zero."""
    return F.call_function("div", a, b)


def concat_kv(*cols: Column) -> Column:
    """Null is the empty string."""
    return F.concat_ws("", *[c.cast("string") for c in cols])


def text_kv(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def trim_kv(x: Column, side: str = "both") -> Column:
    """Trims all white space, not blanks alone."""
    x = text_kv(x)
    if side in ("both", "left"):
        x = F.regexp_replace(x, r"(?U)^\s+", "")
    if side in ("both", "right"):
        x = F.regexp_replace(x, r"(?U)\s+$", "")
    return x


def substr_kv(x: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start below 1 counts as 1, a negative length as 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    n = F.length(x) if length is None else (length if isinstance(length, Column) else F.lit(length))
    return F.substring(text_kv(x), F.greatest(start, F.lit(1)), F.greatest(n, F.lit(0)))


def round_kv(x: Column, digits: int = 0) -> Column:
    """Half away from zero; negative digits count as 0; null is 0."""
    return F.coalesce(F.round(x.cast("double"), max(0, digits)), F.lit(0.0))


def cast_kv(x: Column, kind: str) -> Column:
    """A failed cast is null; text casts to bool by being non-empty; an unknown type leaves the value as it is."""
    kinds = {"int": "bigint", "bigint": "bigint", "integer": "bigint", "float": "double", "real": "double", "double": "double", "text": "string", "varchar": "string", "string": "string"}
    if kind == "bool":
        return truthy_text(x.cast("string"))
    return x.try_cast(kinds[kind]) if kind in kinds else x


def bool_pg(x: Column) -> Column:
    """Text to bool: t, true, 1, yes and on are true, all else is false."""
    return two_valued(F.lower(x).isin("t", "true", "1", "yes", "on"))


def like_escaped(x: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash is itself."""
    return two_valued(x.like(pattern.replace("\\", "\\\\")))


def order(col: str, descending: bool = False) -> Column:
    """Nulls last both ways."""
    return F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()


def finite(x: Column) -> Column:
    """A value that is not finite is null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
