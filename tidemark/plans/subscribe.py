"""Live subscriptions: a small query text becomes Columns; snapshots, diffs, coalesced ticks and field patches follow from them.

    [SUBSCRIBE] table [WHERE condition {AND|OR condition}] [ORDER BY field [ASC|DESC]] [LIMIT n]

A condition is `field op value` (= == != <> < <= > >=) or `field IN (value, ...)`. AND binds tighter than OR. A value in quotes or any other
bare word is text, true and false are booleans, null is null. ORDER BY and LIMIT shape the snapshot alone, never the diffs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:'((?:[^']|'')*)'|"([^"]*)"|(<=|>=|!=|<>|==|[=<>(),])|([^\s=<>!(),'"]+))""")
_ORDERING = {"<", "<=", ">", ">="}


@dataclass
class Subscription:
    """A parsed query. where is a list (OR) of lists (AND) of (field, op, value)."""

    table: str
    where: list[list[tuple]] = field(default_factory=list)
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip().rstrip(";")
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the subscription at: {text[at:]!r}")
        single, double, op, word = m.groups()
        out.append(("text", single.replace("''", "'")) if single is not None else ("text", double) if double is not None else ("op", op) if op else ("word", word))
        at = m.end()
    return out


def _value(token: tuple[str, str]):
    kind, v = token
    if kind == "text":
        return v
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    if v.lower() == "null":
        return None
    for number in (int, float):
        try:
            return number(v)
        except ValueError:
            pass
    return v


def parse(text: str) -> Subscription:
    """Reads a subscription; anything left over is an error."""
    t = _tokens(text)
    i = 1 if t and t[0][1].upper() == "SUBSCRIBE" else 0
    if i >= len(t) or t[i][0] != "word":
        raise ValueError("a subscription names a table")
    sub, i = Subscription(t[i][1]), i + 1
    word = lambda k: t[k][1].upper() if k < len(t) and t[k][0] == "word" else ""

    def need(k: int, what: str):
        if k >= len(t):
            raise ValueError(f"{what} is missing")
        return t[k]

    if word(i) == "WHERE":
        i, group = i + 1, []
        while True:
            name = need(i, "a field")[1]
            if word(i + 1) == "IN":
                if need(i + 2, "(")[1] != "(":
                    raise ValueError("IN needs a list in parentheses")
                i, values = i + 3, []
                while need(i, ")")[1] != ")":
                    if t[i] != ("op", ","):
                        values.append(_value(t[i]))
                    i += 1
                group.append((name, "IN", values))
                i += 1
            else:
                op = need(i + 1, "an operator")[1]
                if t[i + 1][0] != "op" or op in "(),":
                    raise ValueError(f"{op!r} is no operator")
                group.append((name, {"==": "=", "<>": "!="}.get(op, op), _value(need(i + 2, "a value"))))
                i += 3
            if word(i) == "AND":
                i += 1
            elif word(i) == "OR":
                sub.where.append(group)
                group, i = [], i + 1
            else:
                sub.where.append(group)
                break
    if word(i) == "ORDER":
        if word(i + 1) != "BY":
            raise ValueError("ORDER goes with BY")
        sub.order_by, i = need(i + 2, "a field")[1], i + 3
        if word(i) in ("ASC", "DESC"):
            sub.descending, i = word(i) == "DESC", i + 1
    if word(i) == "LIMIT":
        sub.limit, i = int(need(i + 1, "a number")[1]), i + 2
    if i < len(t):
        raise ValueError(f"unexpected {t[i][1]!r}")
    return sub


def _condition(df: DataFrame, name: str, op: str, value) -> Column:
    """Typed comparison: text compares with text, numbers with numbers, booleans and null only by equality; all else is false."""
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.lit(False)
    c, kind = F.col(name), kinds[name]
    if op == "IN":
        out = F.lit(False)
        for v in value:
            out = out | _condition(df, name, "=", v)
        return out
    number = kind in ("int", "bigint", "smallint", "tinyint", "double", "float") or kind.startswith("decimal")
    if value is None:
        fits = True
    elif isinstance(value, bool):
        fits = kind == "boolean"
    elif isinstance(value, (int, float)):
        fits = number
    else:
        fits = kind == "string"
    if op in _ORDERING and not (fits and number and value is not None):
        return F.lit(False)
    if op == "=":
        return F.lit(False) if not fits else c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False))
    if op == "!=":
        return F.lit(False) if not fits else c.isNotNull() if value is None else F.coalesce(c != F.lit(value), F.lit(False))
    compared = {"<": c < F.lit(value), "<=": c <= F.lit(value), ">": c > F.lit(value), ">=": c >= F.lit(value)}[op]
    return F.coalesce(compared, F.lit(False))


def predicate(sub: Subscription, df: DataFrame) -> Column:
    """The WHERE part over df's columns; true without one."""
    if not sub.where:
        return F.lit(True)
    out = F.lit(False)
    for group in sub.where:
        both = F.lit(True)
        for one in group:
            both = both & _condition(df, *one)
        out = out | both
    return out


def snapshot(sub: Subscription, df: DataFrame) -> DataFrame:
    """The rows that a subscriber gets first, marked initial_snapshot. Rows without the sort field come last both ways."""
    out = df.where(predicate(sub, df))
    if sub.order_by:
        c = F.col(sub.order_by)
        out = out.orderBy(c.desc_nulls_last() if sub.descending else c.asc_nulls_last())
    if sub.limit is not None:
        out = out.limit(sub.limit)
    return out.withColumn("operation", F.lit("initial_snapshot"))


def live(sub: Subscription, deltas: DataFrame, op: str = "op") -> DataFrame:
    """Diffs of a subscription, batch or streaming: matching inserts and updates, and every delete."""
    return deltas.where((F.col(op) == "delete") | predicate(sub, deltas))


def live_with_retractions(sub: Subscription, deltas: DataFrame, key: str, seq: str, op: str = "op") -> DataFrame:
    """Like live, with a `leave` for a row that matched before and no longer does. Batch only."""
    w = Window.partitionBy(key).orderBy(seq)
    d = deltas.withColumn("_now", (F.col(op) != "delete") & predicate(sub, deltas))
    d = d.withColumn("_was", F.coalesce(F.lag("_now").over(w), F.lit(False)))
    leave = (F.col(op) != "delete") & F.col("_was") & ~F.col("_now")
    out = d.where((F.col(op) == "delete") | F.col("_now") | leave)
    return out.withColumn(op, F.when(leave, "leave").otherwise(F.col(op))).drop("_now", "_was")


def coalesced(deltas: DataFrame, tick: Column, keys: list[str], seq: str) -> DataFrame:
    """The last write per key and tick."""
    d = deltas.withColumn("tick", tick)
    rest = [c for c in d.columns if c not in (*keys, "tick")]
    return d.groupBy(*keys, "tick").agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "tick", "_r.*")


def patches(rows: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """(key, seq, patch): a map of the fields whose values changed since the row's last version; a first version has them all."""
    w = Window.partitionBy(key).orderBy(seq)
    first = F.row_number().over(w) == 1
    entries = [F.when(first | ~F.col(f).eqNullSafe(F.lag(f).over(w)), F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value"))) for f in fields]
    full = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return rows.select(key, seq, F.map_from_entries(full).alias("patch"))


def frames(diffs: DataFrame, client: str, tick: str, seq: str, columns: list[str]) -> DataFrame:
    """One batch per client and tick, in order."""
    return diffs.groupBy(client, tick).agg(F.sort_array(F.collect_list(F.struct(seq, *columns))).alias("batch"))


def deliveries(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pub/sub: how many subscriptions each message reaches, an exact name or a glob of patterns(pattern) each.

    Exact names are an equi-join on the channel. Globs, as many as there are, are tested once for each distinct channel: a glob that begins
    with plain text is joined on its first character, the others (which begin with a wildcard) meet all channels.
    """
    from tidemark.sources.tables import glob_regex

    @F.pandas_udf("string")
    def regex(s: pd.Series) -> pd.Series:
        return s.map(glob_regex)

    special = F.col("pattern").rlike(r"[*?\[\\]")
    many = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("k"))
    exact = many.where(~special).select(F.col("pattern").alias("channel"), "k")
    globs = many.where(special).select("k", regex("pattern").alias("regex"), F.when(~F.col("pattern").rlike(r"^[*?\[\\]"), F.substring("pattern", 1, 1)).otherwise("").alias("start"))
    channels = messages.select("channel").distinct()
    starts = channels.withColumn("start", F.explode(F.array(F.lit(""), F.substring("channel", 1, 1))))
    by_glob = starts.join(globs, "start").where(F.rlike("channel", F.col("regex"))).select("channel", "k")
    hits = by_glob.union(exact).groupBy("channel").agg(F.sum("k").cast("int").alias("n"))
    reach = channels.join(hits, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("n"))
    return messages.join(reach, "channel")
