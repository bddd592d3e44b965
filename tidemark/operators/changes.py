"""Row changes that tell what they changed, keys from a sequence, and tables as a catalog of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import ordered
from tidemark.operators.ordered import nulls_last


def numbered(df: DataFrame, order: list[Column], out: str = "n") -> DataFrame:
    """A gapless number from 1 in the given order, nulls last. Ranges of rows are numbered apart and moved by the rows before them, so that no
    task orders the whole table. The ranges' cuts are literals: a row's range is the same wherever the plan reads it."""
    return ordered.numbered(df, [], nulls_last(order), out)


def with_serial(rows: DataFrame, table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with the next keys of the table's sequence."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))  # one row
    return numbered(rows, order, "_n").crossJoin(F.broadcast(last)).withColumn(key, F.col("_last") + F.col("_n")).drop("_last", "_n")


def not_null(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be inserted, rows refused, with the first column that is null)."""
    first = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    return rows.where(first.isNull()), rows.withColumn("refused", first).where("refused IS NOT NULL")


def update_returning(table: DataFrame, where: Column, returning: list[Column | str], **values: Column) -> DataFrame:
    """The rows that an UPDATE changes, after it; all right sides see the old row."""
    hit = F.coalesce(where, F.lit(False))
    return table.where(hit).select(*(values[c].alias(c) if c in values else F.col(c) for c in table.columns)).select(*returning)


def delete_returning(table: DataFrame, where: Column, returning: list[Column | str]) -> DataFrame:
    """The rows that a DELETE takes, as they were."""
    return table.where(F.coalesce(where, F.lit(False))).select(*returning)


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Inserted rows with row_key: their own `id`, else `row_key`, else one made from the row's values."""
    columns = [c.lower() for c in rows.columns]
    given = [F.col(c).cast("string") for c in ("id", "row_key") if c in columns]
    made = F.concat(F.lit("row_"), F.hex(F.xxhash64(*rows.columns)))
    return rows.withColumn("row_key", F.coalesce(*given, made))


def unnamed(rows: DataFrame) -> DataFrame:
    """Rows inserted without a list of columns: col0, col1 and so on."""
    return rows.toDF(*(f"col{i}" for i in range(len(rows.columns))))


@dataclass(frozen=True)
class Catalog:
    """Tables by name; each statement gives a new catalog."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def create(self, name: str, empty: DataFrame, if_not_exists: bool = False) -> Catalog:
        if name in self.tables:
            if if_not_exists:
                return self
            raise ValueError(f"table {name} exists")
        return Catalog(self.tables | {name: empty.limit(0)})

    def drop(self, name: str, if_exists: bool = False) -> Catalog:
        if name not in self.tables and not if_exists:
            raise ValueError(f"no table {name}")
        return Catalog({k: v for k, v in self.tables.items() if k != name})

    def truncate(self, name: str) -> Catalog:
        spark, schema = self.tables[name].sparkSession, self.tables[name].schema
        return Catalog(self.tables | {name: spark.createDataFrame([], schema)})

    def insert(self, name: str, rows: DataFrame) -> Catalog:
        return Catalog(self.tables | {name: self.tables[name].unionByName(rows, allowMissingColumns=True)})

    def schema(self, name: str) -> StructType:
        return self.tables[name].schema
