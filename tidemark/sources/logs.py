"""A write-ahead log as text lines with checksums, its reader, and the shared folder that logs, snapshots and streams are kept in."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; a left-over folder does no harm
        pass


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the program ends. Only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def log_lines(entries: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, line): the CRC-32 of a record in hex, a blank, and the record as JSON."""
    record = F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"})
    return entries.select(F.col(seq).alias("seq"), F.concat(F.lpad(F.lower(F.hex(F.crc32(record))), 8, "0"), F.lit(" "), record).alias("line"))


def append_log(lines: DataFrame, path: str) -> None:
    """Adds files of lines to a log; Spark commits them together."""
    lines.select("line").write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str, seq: str = "seq") -> DataFrame:
    """The records of a log up to the first that is torn, altered or missing; numbers rise by one, and repeated records count once.

    The end of the first gapless run is found by an anti-join with the successors, without ordering the log.
    """
    raw = spark.read.text(path)
    record = F.substring("value", 10, 1 << 30)
    sound = F.lower(F.substring("value", 1, 8)) == F.lpad(F.lower(F.hex(F.crc32(record))), 8, "0")
    good = raw.where(sound).select(F.from_json(record, schema).alias("r")).select("r.*").dropDuplicates([seq])
    ends = good.select(F.col(seq).alias("_s")).join(good.select((F.col(seq) - 1).alias("_s")), "_s", "left_anti")
    last = ends.agg(F.min("_s")).first()[0]
    return good.where(F.col(seq) <= last) if last is not None else good
