"""What the corpus operators share: reading, words, staging in the shared folder, row ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by the path that Spark's readers take; never opened in any other way."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in the JVM."""
    return F.array_remove(F.split(text, SPACE), "")


def unused(name: str, columns: list[str]) -> str:
    """A column name that none of `columns` has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set on the context. Only with both unset, in one local process, is one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder through the file system that holds it."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; a left-over folder does no harm
        pass


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Results read what is staged, so it goes when the program ends."""
    atexit.register(remove, spark, path)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python in small Arrow batches; a setting other than Spark's default is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of Python values as a local relation (no RDD, no Python worker)."""
    names, kinds = zip(*(x.strip().rsplit(" ", 1) for x in schema.split(",")), strict=True)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True)) + " LIMIT 0")
    body = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} FROM VALUES {body} AS t({', '.join(names)})")


def _literal(v, kind: str) -> str:
    if v is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    if isinstance(v, str):
        return f"CAST(X'{v.encode().hex()}' AS STRING)" if v else "''"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    return str(v)


def ranked(df: DataFrame, parts: list[str], key: Column, order: list[Column], n_rows: int, weight: Column | None = None, per: int = 20_000, out: str = "slot") -> DataFrame:
    """Adds `out`: the exclusive running sum of `weight` (1: a gapless rank from 0) within `parts`.

    No part is ordered in one task: rows are dealt into n_rows / per buckets by a hash of `key`, the buckets' sums are
    added up first, and the rows are then ordered inside (parts, bucket) only. The order is (bucket, order), the same in every run.
    """
    from pyspark.sql import Window

    n = max(1, -(-n_rows // per))
    w = F.lit(1).cast("long") if weight is None else weight
    base = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n))).withColumn("_w", w)
    sums = base.groupBy(*parts, "_b").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*parts, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*parts, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_i", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return base.join(sums, [*parts, "_b"]).withColumn(out, F.col("_i") + F.col("_o")).drop("_b", "_w", "_i", "_o")
