"""Structured Streaming forms of the stateful operators. Their batch forms are in operators and plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.subscribe import Subscription, live
from tidemark.sources.logs import work_dir


def change_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A change log that grows by files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a folder as a stream, be it one file or a folder of files."""
    path = f"{root}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return reader.parquet(path)


def diffs(sub: Subscription, log: DataFrame) -> DataFrame:
    """A subscription's diffs; stateless."""
    return live(sub, log)


def coalesced(log: DataFrame, time: str, key: str, seq: str, tick: str = "50 milliseconds", late: str = "1 second") -> DataFrame:
    """The last write per key and tick; state goes once the watermark has passed the tick."""
    rest = [c for c in log.columns if c not in (key, time)]
    g = log.withWatermark(time, late).groupBy(F.window(time, tick), key)
    return g.agg(F.max_by(F.struct(*rest), seq).alias("r")).select(F.col("window.start").alias("tick"), key, "r.*")


def counters(log: DataFrame, name: str, amount: str) -> DataFrame:
    """Commutative counters, in update or complete mode; state is one row for each counter."""
    return log.groupBy(name).agg(F.sum(amount).alias("value"))


def board_windows(scores: DataFrame, time: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Best score per player and time window."""
    return scores.withWatermark(time, late).groupBy(F.window(time, length), "player").agg(F.max("score").alias("score")).select(F.col("window.start").alias("window_start"), "player", "score")


def monotonic_gate(entries: DataFrame) -> DataFrame:
    """Stream entries (key, ms, seq, arrival) whose id is above all earlier ids of their stream; state is one id for each stream."""

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = tuple(state.get) if state.exists else (-1, -1)
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        keep = []
        for r in rows.itertuples(index=False):
            keep.append((r.ms, r.seq) > top)
            top = max(top, (r.ms, r.seq))
        state.update((int(top[0]), int(top[1])))
        yield rows[keep][["key", "ms", "seq", "arrival"]]

    return entries.groupBy("key").applyInPandasWithState(gate, "key string, ms long, seq long, arrival long", "ms long, seq long", "append", GroupStateTimeout.NoTimeout)


def presence(beats: DataFrame, user: str = "user_id", time: str = "ts", idle: str = "1 minute", offline: str = "5 minutes", late: str = "10 seconds") -> DataFrame:
    """Online, then Idle and Offline when no heartbeat came for so long: (user, status, at), by event time.

    Gaps between heartbeats count whether or not they come in one batch; after the last one the watermark runs the timers.
    """
    idle_ms, offline_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (idle, offline))

    def lapse(user, last: int, status: str, until: int, out: list) -> str:
        if status == "Online" and last + idle_ms <= until:
            status = "Idle"
            out.append((user, status, last + idle_ms))
        if status == "Idle" and last + offline_ms <= until:
            status = "Offline"
            out.append((user, status, last + offline_ms))
        return status

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status = state.get if state.exists else (None, "Offline")
        out: list[tuple] = []
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            status = lapse(key[0], last, status, now, out)
        else:
            ms = np.unique(np.concatenate([p["ms"].to_numpy() for p in batches]))
            for at in map(int, ms if last is None else ms[ms > last]):
                if last is not None:
                    status = lapse(key[0], last, status, at, out)
                if status != "Online":
                    status = "Online"
                    out.append((key[0], status, at))
                last = at
        if status == "Offline":
            state.remove()
        else:
            state.update((last, status))
            state.setTimeoutTimestamp(max(last + (idle_ms if status == "Online" else offline_ms), now + 1))
        yield pd.DataFrame(out, columns=["user", "status", "at"])

    b = beats.withWatermark(time, late).select(F.col(user).cast("string").alias("user"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), time)
    return b.groupBy("user").applyInPandasWithState(track, "user string, status string, at long", "last long, status string", "append", GroupStateTimeout.EventTimeTimeout)


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, exactly once, into files."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_batches(df: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to apply(batch, id): the scheduled reducer."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for all that there is now. In update mode the last row of each of `keys` counts.

    Each micro-batch overwrites a folder of its own, so that one that is run again after a failure leaves its rows once.
    """
    spark = df.sparkSession
    path = work_dir(spark, "stream")

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={i}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], df.schema)
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    if not keys:
        return rows.select(*df.columns)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
