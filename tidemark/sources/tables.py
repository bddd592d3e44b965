"""Reading tables, and the scans that are more than `spark.table`: catalog rows, census, key patterns, pages, seeds, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of Parquet files; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def load_or_empty(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table that may not exist yet: reading it then gives no rows of the declared schema, not an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(path.toString())
    return spark.createDataFrame([], schema)


def views(spark: SparkSession, root: str, sql: str) -> None:
    """Registers the tables that a statement names as temporary views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            load(spark, root, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, root: str, sql: str, args: list | dict | None = None) -> DataFrame:
    """A SQL text over the tables of a folder; parameters are bound, never pasted."""
    views(spark, root, sql)
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def catalog_columns(frames: dict[str, DataFrame]) -> DataFrame:
    """information_schema.columns for named frames: table_name, column_name, ordinal_position, data_type, is_nullable."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for t, df in sorted(frames.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def catalog_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """information_schema.tables for named frames."""
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame([(t, "public", "BASE TABLE") for t in sorted(frames)], "table_name string, table_schema string, table_type string")


def census(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one count each (answered from Parquet footers where the source is Parquet)."""
    out = None
    for name, df in sorted(frames.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def total_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables together."""
    return census(frames).agg(F.sum("n_rows").alias("n_rows"))


def tenant_of(name: Column) -> Column:
    """The tenant of a table named `tn:<tenant>:<table>`, else null."""
    found = F.regexp_extract(name, r"^tn:([^:]+):(.+)$", 1)
    return F.nullif(found, F.lit(""))


def lobby_of(name: Column) -> Column:
    """The lobby number of a table named `l<digits>_<table>`, else null."""
    return F.nullif(F.regexp_extract(name, r"^l([0-9]+)_(.+)$", 1), F.lit("")).cast("bigint")


def glob_regex(pattern: str) -> str:
    """A key pattern (* ? [abc] [^a] [a-z] \\x) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            negate, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negate + re.sub(r"([\\\[\]&~^])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(key: Column, pattern: str) -> Column:
    """Whether a key fits a pattern; a pattern that only ends in * is a prefix test, which Parquet can use."""
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return key.startswith(pattern[:-1])
    return key.rlike(glob_regex(pattern))


def scan_page(df: DataFrame, key: str, cursor, count: int) -> DataFrame:
    """The next `count` rows after a cursor key in key order: a filter and a top-n, with no numbering of the whole table."""
    rest = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rest.orderBy(key).limit(count)


def column_scan(df: DataFrame, key: str, field: str) -> DataFrame:
    """Key and one field of all rows, nulls too, in key order; only two columns are read."""
    return df.select(key, field).orderBy(key)


def seed_rows(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits seed rows of JSON text `[table, key, {data}]` into (valid: table_name, row_key, data) and (rejected: row, reason)."""
    table, key, data = (F.get_json_object("row", f"$[{i}]") for i in range(3))
    parsed = rows.select("row", table.alias("table_name"), key.alias("row_key"), data.alias("data"))
    reason = F.when(F.col("table_name").isNull() | (F.col("table_name") == ""), "no table").when(F.col("row_key").isNull() | (F.col("row_key") == ""), "no key").when(~F.coalesce(F.col("data").startswith("{"), F.lit(False)), "data is no object")
    parsed = parsed.withColumn("reason", reason)
    return parsed.where("reason IS NULL").select("table_name", "row_key", "data"), parsed.where("reason IS NOT NULL").select("row", "reason")


def write_snapshot(df: DataFrame, root: str, seq: int) -> str:
    """Writes a snapshot that carries its sequence number in the path."""
    path = f"{root}/seq={seq:020d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_latest_snapshot(spark: SparkSession, root: str, schema: T.StructType) -> tuple[DataFrame, int | None]:
    """The snapshot with the highest sequence number, or no rows and None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(x.getPath().getName()[4:]) for x in fs.listStatus(where) if x.getPath().getName().startswith("seq=")] if fs.exists(where) else []
    if not found:
        return spark.createDataFrame([], schema), None
    return spark.read.schema(schema).parquet(f"{root}/seq={max(found):020d}"), max(found)
