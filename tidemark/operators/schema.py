"""Declared schemas, defaults, row policies and migrations of keyed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"string": "string", "str": "string", "i64": "bigint", "int": "bigint", "i32": "bigint", "f64": "double", "float": "double", "double": "double", "bool": "boolean", "bytes": "binary"}


@dataclass(frozen=True)
class Field:
    """A declared column: its type, whether it must be there, and what stands in for a missing or null value."""

    name: str
    kind: str
    required: bool = False
    default: object = None


def validate(df: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with defaults and types, rejected rows with a reason). Columns that are not declared pass through."""
    out, reason = df, F.lit(None).cast("string")
    for f in reversed(fields):
        kind = KINDS[f.kind.lower()]
        raw = F.col(f.name) if f.name in df.columns else F.lit(None).cast(kind)
        value = raw if dict(df.dtypes).get(f.name) == kind else raw.try_cast(kind)
        bad_type = raw.isNotNull() & value.isNull()
        missing = raw.isNull() & F.lit(f.required and f.default is None)
        reason = F.when(missing, f"{f.name} is required").when(bad_type, f"{f.name} is no {f.kind}").otherwise(reason)
        filled = F.coalesce(value, F.lit(f.default).cast(kind)) if f.default is not None else value
        out = out.withColumn(f"_new_{f.name}", filled)
    out = out.withColumn("_reason", reason)
    plain = [c for c in df.columns if c not in {f.name for f in fields}]
    good = out.where("_reason IS NULL").select(*plain, *(F.col(f"_new_{f.name}").alias(f.name) for f in fields))
    return good, out.where("_reason IS NOT NULL").select(*df.columns, F.col("_reason").alias("reason"))


def row_policy(policy: str, caller: str, role: str, owner: str | None = None, roles: tuple[str, ...] = ()) -> Column:
    """The filter of a row-level policy: public, owner_field, role_gated, owner_field_with_admin. scheduler and system see all."""
    if policy == "public" or role in ("scheduler", "system"):
        return F.lit(True)
    if policy == "role_gated":
        return F.lit(role in roles)
    if policy == "owner_field_with_admin" and role == "admin":
        return F.lit(True)
    return F.coalesce(F.col(owner) == F.lit(caller), F.lit(False))


def add_field(df: DataFrame, name: str, value) -> DataFrame:
    """Idempotent: a row that has the field keeps it."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def remove_field(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_field(df: DataFrame, old: str, new: str) -> DataFrame:
    """Overwrites an existing target; nothing happens without the source."""
    return df.drop(new).withColumnRenamed(old, new) if old in df.columns else df


def insert_rows(df: DataFrame, rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """INSERT: the given columns are cast to the table's types, the others take their default or null."""
    kinds = dict(df.dtypes)
    cols = [(F.col(c) if c in rows.columns else F.lit((defaults or {}).get(c))).cast(kinds[c]).alias(c) for c in df.columns]
    return df.unionByName(rows.select(*cols))
