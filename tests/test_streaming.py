import pytest
from pyspark.sql import functions as F

from tidemark.plans.subscribe import parse
from tidemark.sources import logs as G
from tidemark.streaming import live as L


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def log_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    schema = "seq long, key string, op string, v int, ms long"
    data = [(1, "a", "upsert", 5, 0), (2, "b", "upsert", 50, 10), (3, "a", "upsert", 70, 20), (4, "b", "delete", 0, 70), (5, "z", "upsert", 1, 10_000_000)]
    for i in (data[:3], data[3:]):
        spark.createDataFrame(i, schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame([], schema).schema


def test_diffs_are_stateless_and_complete(spark, log_dir):
    got = drain(spark, L.diffs(parse("log WHERE v >= 50"), L.change_log(spark, *log_dir)), "diffs")
    assert sorted(r.seq for r in got) == [2, 3, 4]


def test_counters(spark, log_dir):
    got = drain(spark, L.counters(L.change_log(spark, *log_dir), "key", "v"), "counters", "complete")
    assert {r.key: r.value for r in got} == {"a": 75, "b": 50, "z": 1}


def test_coalesced_keeps_the_last_write_of_a_tick(spark, log_dir):
    log = L.change_log(spark, *log_dir).withColumn("ts", F.timestamp_millis("ms"))
    got = drain(spark, L.coalesced(log, "ts", "key", "seq"), "ticks")
    assert sorted((r.key, r.seq) for r in got if r.key != "z") == [("a", 3), ("b", 2), ("b", 4)]


def test_gate_refuses_ids_that_do_not_rise(spark, tmp_path):
    schema = "key string, ms long, seq long, arrival long"
    first = [("k", 1, 0, 1), ("k", 1, 0, 2), ("k", 2, 5, 3)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    spark.createDataFrame([("k", 2, 4, 4), ("k", 3, 0, 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    got = drain(spark, L.monotonic_gate(L.change_log(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema, 1)), "gate")
    assert sorted(r.arrival for r in got) == [1, 3, 5]


def test_presence_goes_online(spark, tmp_path):
    spark.createDataFrame([("u1", 1_000_000), ("u2", 1_030_000)], "user_id string, ms long").select("user_id", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "b"))
    beats = L.change_log(spark, str(tmp_path / "b"), spark.read.parquet(str(tmp_path / "b")).schema)
    got = drain(spark, L.presence(beats), "presence")
    assert {r.user for r in got if r.status == "Online"} == {"u1", "u2"}


def test_presence_runs_all_timers_in_one_batch_or_many(spark, tmp_path):
    beats = [("u1", 0), ("u1", 30_000), ("u1", 200_000), ("u2", 40_000), ("u3", 2_000_000), ("u3", 900_000)]
    want = {("u1", "Online", 0), ("u1", "Idle", 90_000), ("u1", "Online", 200_000), ("u1", "Idle", 260_000), ("u1", "Offline", 500_000), ("u2", "Online", 40_000), ("u2", "Idle", 100_000),
            ("u2", "Offline", 340_000), ("u3", "Online", 900_000), ("u3", "Idle", 960_000), ("u3", "Offline", 1_200_000), ("u3", "Online", 2_000_000)}
    base = 1_000_000_000  # away from the epoch, where the first watermark is
    for files in (1, 3):
        path = str(tmp_path / f"b{files}")
        for i in range(files):
            part = [b for b in sorted(beats, key=lambda x: x[1]) if files == 1 or min(b[1] // 300_000, 2) == i]
            spark.createDataFrame(part, "user_id string, ms long").select("user_id", F.timestamp_millis(F.col("ms") + base).alias("ts")).coalesce(1).write.mode("append").parquet(path)
        got = L.drained(L.presence(L.change_log(spark, path, spark.read.parquet(path).schema, 1)), "append").collect()
        assert sorted((r.user, r.status, r.at - base) for r in got) == sorted(want)


def test_log_reader_stops_at_the_first_bad_record(spark, tmp_path):
    entries = spark.createDataFrame([(i, f"k{i % 3}", None if i == 2 else i) for i in range(10)], "seq long, key string, v int")
    lines = G.log_lines(entries)
    schema = "seq bigint, key string, v int"
    G.append_log(lines.where("seq < 6"), str(tmp_path / "whole"))
    G.append_log(lines.where("seq BETWEEN 4 AND 9"), str(tmp_path / "whole"))  # two records delivered twice
    assert sorted(tuple(r) for r in G.read_log(spark, str(tmp_path / "whole"), schema).collect()) == sorted(tuple(r) for r in entries.collect())
    for name, bad in (("torn", F.expr("left(line, length(line) - 3)")), ("altered", F.regexp_replace("line", "k1", "k7")), ("lost", F.lit(""))):
        G.append_log(lines.withColumn("line", F.when(F.col("seq") == 7, bad).otherwise(F.col("line"))), str(tmp_path / name))
        assert sorted(r.seq for r in G.read_log(spark, str(tmp_path / name), schema).collect()) == list(range(7))


def test_batches_are_handed_on(spark, log_dir, tmp_path):
    seen = []
    q = L.upsert_batches(L.change_log(spark, *log_dir, 1), lambda df, i: seen.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sum(seen) == 5
    q = L.to_parquet(L.change_log(spark, *log_dir), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
