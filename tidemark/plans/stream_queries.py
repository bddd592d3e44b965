"""Registered queries that run as streams over a table or through a log or snapshot on disk, each with the SQL of its final rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import semantics as S
from tidemark.operators import keyed as K
from tidemark.plans import subscribe as U
from tidemark.plans.keyed_queries import DAY, LOG, STREAM, Query, _replayed, log
from tidemark.sources.logs import append_log, log_lines, read_log, work_dir
from tidemark.sources.tables import load, read_latest_snapshot, write_snapshot
from tidemark.streaming import live as L

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, with their time as a timestamp and in ms."""
    e = L.table_stream(spark, d, "events").withColumn("ms", S.millis(F.col("ts")))
    return e.withColumn("time", F.timestamp_millis("ms"))


@query("stream_diffs", f"WITH {LOG} SELECT seq, key, op FROM log WHERE op = 'delete' OR value >= 60")
def stream_diffs(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    entries = events(spark, d).select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), "value")
    return L.drained(L.diffs(U.parse("log WHERE value >= 60"), entries), "append").select("seq", "key", "op")


@query("stream_counters", "SELECT event_type AS name, sum(round(value * 100)::BIGINT)::BIGINT AS value FROM events GROUP BY event_type")
def stream_counters(spark, d):
    adds = events(spark, d).select(F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("bigint").alias("amount"))
    return L.drained(L.counters(adds, "name", "amount"), "update", ["name"])


@query("stream_coalesced", f"WITH {LOG} SELECT key, (ts // 21600000) * 21600000 AS tick, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM log GROUP BY 1, 2")
def stream_coalesced(spark, d):
    entries = events(spark, d).select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "time", "event_type")
    out = L.drained(L.coalesced(entries, "time", "key", "seq", "6 hours"), "update", ["tick", "key"])
    return out.select("key", F.unix_millis("tick").alias("tick"), "seq", "event_type")


@query("stream_boards", f"WITH {LOG} SELECT key AS player, (ts // {DAY}) * {DAY} AS day, max(value) AS score FROM log GROUP BY 1, 2")
def stream_boards(spark, d):
    scores = events(spark, d).select(F.col("user_id").alias("player"), "time", F.col("value").alias("score"))
    out = L.drained(L.board_windows(scores, "time"), "update", ["window_start", "player"])
    return out.select("player", F.unix_millis("window_start").alias("day"), "score")


@query("stream_gate", f"WITH {STREAM} SELECT key, ms, seq, arrival FROM (SELECT *, max(ms * 100 + seq) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s) WHERE top IS NULL OR ms * 100 + seq > top")
def stream_gate(spark, d):
    e = events(spark, d)
    return L.drained(L.monotonic_gate(e.select(F.col("event_type").alias("key"), F.floor(F.col("ms") / 1000).alias("ms"), (F.col("event_id") % 7).alias("seq"), F.col("event_id").alias("arrival"))), "append")


@query("stream_presence", """WITH b AS (SELECT DISTINCT user_id::VARCHAR AS player, epoch_us(ts) // 1000 AS ms FROM events),
    l AS (SELECT *, lag(ms) OVER w AS prior, lead(ms) OVER w AS later FROM b WINDOW w AS (PARTITION BY player ORDER BY ms)), m AS (SELECT max(ms) - 10000 AS mark FROM b)
    SELECT player, 'Online' AS status, ms FROM l WHERE prior IS NULL OR ms - prior >= 3600000
    UNION ALL SELECT player, 'Idle', ms + 3600000 FROM l, m WHERE CASE WHEN later IS NULL THEN ms + 3600000 < mark ELSE later - ms >= 3600000 END
    UNION ALL SELECT player, 'Offline', ms + 43200000 FROM l, m WHERE CASE WHEN later IS NULL THEN ms + 43200000 <= mark ELSE later - ms >= 43200000 END""")  # fmt: skip
def stream_presence(spark, d):
    beats = events(spark, d).select("user_id", F.col("time").alias("ts"))
    return L.drained(L.presence(beats, idle="1 hour", offline="12 hours"), "append").select(F.col("user").alias("player"), "status", F.col("at").alias("ms"))


@query("log_torn_tail", f"WITH {LOG} SELECT seq, key, event_type FROM log WHERE seq < (SELECT max(seq) - 5 FROM log)")
def log_torn_tail(spark, d):
    """The sixth record from the end is torn, so it and all behind it are no part of the log."""
    entries = log(spark, d).select("seq", "key", "event_type")
    torn = entries.agg(F.max("seq") - 5).first()[0]
    path = work_dir(spark, "log")
    line = F.when(F.col("seq") == torn, F.expr("left(line, length(line) - 4)")).otherwise(F.col("line"))
    append_log(log_lines(entries).withColumn("line", line), path)
    return read_log(spark, path, "seq bigint, key bigint, event_type string")


@query("log_snapshot_restore", _replayed())
def log_snapshot_restore(spark, d):
    """A snapshot on disk, found by its number, and the log behind it."""
    entries, path = log(spark, d), work_dir(spark, "snapshots")
    for seq in (200, 400):
        write_snapshot(K.as_of(entries, seq), path, seq)
    snapshot, seq = read_latest_snapshot(spark, path, K.as_of(entries, 400).schema)
    return K.replay(snapshot, entries, seq).select("key", "seq", "event_type")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
