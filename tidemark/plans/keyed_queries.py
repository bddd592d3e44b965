"""Registered queries over the operators on keyed state, rankings, collections, places, subscriptions and functions, each with its SQL.

The change log is made from `events`: key user_id, seq event_id, an `error` deletes. Boards take event types, positions take customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import builtins as B
from tidemark.functions import geo as G
from tidemark.functions import hashing as H
from tidemark.functions import semantics as S
from tidemark.operators import collections as C
from tidemark.operators import keyed as K
from tidemark.operators import ranking as R
from tidemark.operators import schema as M
from tidemark.operators import spatial as X
from tidemark.plans import subscribe as U
from tidemark.sources.tables import TABLES, catalog_columns, catalog_tables, census, column_scan, load, matches, lobby_of, scan_page, seed_rows, tenant_of, total_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY = 86_400_000
#: A fixed moment for expiry and presence, in ms: 2024-01-20.
NOW = 1_705_708_800_000
#: SQL of the derived tables.
LOG = "log AS (SELECT event_id AS seq, user_id AS key, (epoch_us(ts) // 1000) AS ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_type, value FROM events)"
BOARD = "board AS (SELECT event_type AS board, user_id AS player, round(value, 3) AS score, (epoch_us(ts) // 1000) AS ts FROM events)"
ENTRIES = BOARD + ", entries AS (SELECT board, player, score, ts FROM (SELECT *, row_number() OVER (PARTITION BY board, player ORDER BY score DESC, ts) AS r FROM board) WHERE r = 1)"
ZSETS = "z AS (SELECT l_returnflag AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY l_returnflag, l_partkey)"
POINTS = "pts AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y FROM customer)"
NEXT = "nxt AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 + c_custkey % 3 AS DOUBLE) AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) AS y FROM customer WHERE c_custkey % 50 <> 0)"
PLACES = "places AS (SELECT c_custkey AS member, CAST((c_custkey * 7) % 360 - 180 AS DOUBLE) + 0.5 AS lon, CAST((c_custkey * 3) % 160 - 80 AS DOUBLE) + 0.25 AS lat FROM customer)"
DIST = "2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians(lat) - radians(37.0)) / 2), 2) + cos(radians(37.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(15.0)) / 2), 2)))"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return load(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), S.millis(F.col("ts")).alias("ts"), op.alias("op"), "event_type", "value")


def board(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("board"), F.col("user_id").alias("player"), F.round("value", 3).alias("score"), S.millis(F.col("ts")).alias("ts"))


def zsets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))


def zset(spark: SparkSession, d: str, key: str) -> DataFrame:
    return zsets(spark, d).where(F.col("key") == key).select("member", "score")


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("x"), (F.col("c_custkey") * 91 % 1000).cast("double").alias("y"))


def next_points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return load(spark, d, "customer").where(c % 50 != 0).select(c.alias("id"), (c * 37 % 1000 + c % 3).cast("double").alias("x"), (c * 91 % 1000).cast("double").alias("y"))


def places(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return load(spark, d, "customer").select(c.alias("member"), ((c * 7 % 360 - 180).cast("double") + 0.5).alias("lon"), ((c * 3 % 160 - 80).cast("double") + 0.25).alias("lat"))


# keyed state


@query("keyed_latest", f"WITH {LOG} SELECT key, seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op <> 'delete'")
def keyed_latest(spark, d):
    return K.current(log(spark, d)).select("key", "seq", "event_type")


@query("keyed_first_write", f"WITH {LOG} SELECT key, seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM log) WHERE r = 1")
def keyed_first_write(spark, d):
    return K.first_per_key(log(spark, d), "key", "seq").select("key", "seq", "event_type")


@query("keyed_as_of", f"WITH {LOG} SELECT key, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS r FROM log WHERE ts <= {NOW}) WHERE r = 1 AND op <> 'delete'")
def keyed_as_of(spark, d):
    return K.latest_per_key(log(spark, d).where(F.col("ts") <= NOW), "key", ["ts", "seq"], keep_deleted=False).select("key", "seq", "ts")


@query("keyed_versions", f"WITH {LOG} SELECT key, count(*) AS version, max(seq) AS head_seq FROM log GROUP BY key")
def keyed_versions(spark, d):
    return K.versions(log(spark, d))


@query("keyed_version_gc", f"WITH {LOG} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key, seq <= 500 ORDER BY seq DESC) AS r FROM log) WHERE seq > 500 OR r = 1")
def keyed_version_gc(spark, d):
    return K.collect_garbage(log(spark, d), 500).select("key", "seq")


@query("keyed_conflicts", f"WITH {LOG}, h AS (SELECT key, max(seq) AS head_seq FROM log GROUP BY key) SELECT key, read_seq, head_seq FROM (SELECT c_custkey AS key, c_custkey * 20 AS read_seq FROM customer) w JOIN h USING (key) WHERE head_seq > read_seq")
def keyed_conflicts(spark, d):
    writes = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 20).alias("read_seq"))
    return K.conflicts(log(spark, d), writes).select("key", "read_seq", "head_seq")


def _replayed(until: str = "") -> str:
    return f"""WITH {LOG}, snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE seq <= 400) WHERE r = 1 AND op <> 'delete'),
        tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log WHERE seq > 400 {until}) WHERE r = 1)
        SELECT key, seq, event_type FROM snap WHERE key NOT IN (SELECT key FROM tail) UNION ALL SELECT key, seq, event_type FROM tail WHERE op <> 'delete'"""


@query("keyed_replay", _replayed())
def keyed_replay(spark, d):
    entries = log(spark, d)
    snapshot = K.as_of(entries, 400)
    twice = entries.unionByName(entries.where("seq % 10 = 0"))  # delivered again
    return K.replay(snapshot, twice, 400).select("key", "seq", "event_type")


@query("keyed_point_in_time", _replayed(f"AND ts <= {NOW}"))
def keyed_point_in_time(spark, d):
    entries = log(spark, d)
    return K.replay(K.as_of(entries, 400), entries, 400, until=NOW).select("key", "seq", "event_type")


@query("keyed_log_gaps", "SELECT after, before FROM (SELECT event_id AS before, lag(event_id) OVER (ORDER BY event_id) AS after FROM events WHERE event_id % 97 NOT IN (3, 4)) WHERE before > after + 1")
def keyed_log_gaps(spark, d):
    return K.gaps(load(spark, d, "events").where("event_id % 97 NOT IN (3, 4)"), "event_id", per=1000)


@query("keyed_replication_serve", f"WITH {LOG} SELECT seq, key, op FROM log WHERE seq > 250 ORDER BY seq LIMIT 100")
def keyed_replication_serve(spark, d):
    return K.serve(log(spark, d), 250, 100).select("seq", "key", "op")


@query("keyed_counters", "SELECT event_type AS name, CAST(sum(user_id % 5) AS BIGINT) AS value, max((epoch_us(ts) // 1000)) AS last_modified FROM events GROUP BY event_type")
def keyed_counters(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 5).alias("amount"), S.millis(F.col("ts")).alias("at"))
    return K.counters(e, "name", "amount", "at")


EXPIRY = f"x AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN NULL ELSE (epoch_us(ts) // 1000) + 5 * {DAY} END AS expires_at FROM events)"


def expiry(spark, d):
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "error", S.millis(F.col("ts")) + 5 * DAY).alias("expires_at"))


@query("keyed_expired", f"WITH {EXPIRY} SELECT key, expires_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM x) WHERE r = 1 AND expires_at <= {NOW + 15 * DAY}")
def keyed_expired(spark, d):
    return K.expired(expiry(spark, d), F.lit(NOW + 15 * DAY)).select("key", "expires_at")


@query("keyed_ttl", f"WITH {EXPIRY} SELECT seq, CASE WHEN expires_at IS NULL THEN -1 WHEN expires_at - {NOW} <= 0 THEN -2 ELSE CAST(ceil((expires_at - {NOW}) / 1000.0) AS BIGINT) END AS ttl FROM x")
def keyed_ttl(spark, d):
    return expiry(spark, d).select("seq", K.ttl_seconds(F.col("expires_at"), F.lit(NOW)).alias("ttl"))


@query("keyed_alive", f"WITH {EXPIRY} SELECT seq, key FROM x WHERE expires_at IS NULL OR expires_at > {NOW}")
def keyed_alive(spark, d):
    return K.alive(expiry(spark, d), F.lit(NOW)).select("seq", "key")


@query("keyed_expire_modes", f"""WITH {EXPIRY} SELECT seq, coalesce(expires_at, {NOW}) AS nx, CASE WHEN expires_at IS NOT NULL THEN {NOW} END AS xx,
    CASE WHEN {NOW} > expires_at THEN {NOW} ELSE expires_at END AS gt, CASE WHEN expires_at IS NULL OR {NOW} < expires_at THEN {NOW} ELSE expires_at END AS lt FROM x""")  # fmt: skip
def keyed_expire_modes(spark, d):
    return expiry(spark, d).select("seq", *(K.expire_if(F.col("expires_at"), F.lit(NOW), m.upper()).alias(m) for m in ("nx", "xx", "gt", "lt")))


@query("keyed_presence", f"""WITH l AS (SELECT user_id, max((epoch_us(ts) // 1000)) AS last_seen FROM events WHERE (epoch_us(ts) // 1000) <= {NOW} GROUP BY user_id)
    SELECT user_id, last_seen, {NOW} - last_seen AS elapsed, CASE WHEN {NOW} - last_seen >= {DAY} THEN 'Idle' ELSE 'Online' END AS status FROM l WHERE {NOW} - last_seen < {3 * DAY}""")  # fmt: skip
def keyed_presence(spark, d):
    beats = load(spark, d, "events").select("user_id", S.millis(F.col("ts")).alias("ts")).where(F.col("ts") <= NOW)
    return K.presence(beats, F.lit(NOW), DAY, 3 * DAY)


@query("keyed_lru_cap", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 25")
def keyed_lru_cap(spark, d):
    return K.row_cap(load(spark, d, "events").select("event_type", "event_id", "ts"), 25, "event_type", "ts", "event_id").select("event_type", "event_id")


@query("keyed_stat_sync", f"WITH {LOG} SELECT region, key, seq, value FROM (SELECT *, key % 4 AS region, row_number() OVER (PARTITION BY key % 4, key ORDER BY seq DESC) AS r FROM log) WHERE r = 1")
def keyed_stat_sync(spark, d):
    return K.stat_sync(log(spark, d).withColumn("region", F.col("key") % 4), "key", "seq", "region").select("region", "key", "seq", "value")


@query("keyed_rate_buckets", "SELECT user_id, (epoch_us(ts) // 1000) // 3600000 AS second, count(*) AS n, greatest(count(*) - 2, 0) AS refused FROM events GROUP BY 1, 2")
def keyed_rate_buckets(spark, d):
    return K.rate_buckets(load(spark, d, "events"), "user_id", F.floor(S.millis(F.col("ts")) / 3_600_000), 2)


@query("keyed_overlay", "SELECT c_custkey AS key, c_acctbal AS bal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 0.5 FROM customer WHERE c_custkey % 14 = 0")
def keyed_overlay(spark, d):
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))
    changes = base.where("key % 7 = 0").select("key", F.lit(0.5).alias("bal"), F.when(F.col("key") % 14 == 0, "upsert").otherwise("delete").alias("op"))
    return K.overlay(base, changes)


# rankings


@query("rank_submit", f"WITH {ENTRIES} SELECT board, player, score, ts FROM entries")
def rank_submit(spark, d):
    return R.best_entries(board(spark, d), ["board"]).select("board", "player", "score", "ts")


@query("rank_top", f"WITH {ENTRIES} SELECT * FROM (SELECT board, player, score, row_number() OVER (PARTITION BY board ORDER BY score DESC, ts, player) AS rank FROM entries) WHERE rank <= 5")
def rank_top(spark, d):
    return R.top(R.best_entries(board(spark, d), ["board"]), 5, ["board"]).select("board", "player", "score", "rank")


WHOLE = "b AS (SELECT player, max(score) AS score FROM board GROUP BY player), e AS (SELECT b.player, b.score, min(ts) AS ts FROM b JOIN board USING (player, score) GROUP BY b.player, b.score), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, ts, player) AS rank, count(*) OVER () AS total FROM e)"


@query("rank_all_percentiles", f"WITH {BOARD}, {WHOLE} SELECT player, score, rank, CASE WHEN total <= 1 THEN 100.0::DOUBLE ELSE round((total - rank) / (total - 1)::DOUBLE * 100.0, 6) END AS percentile FROM k")
def rank_all_percentiles(spark, d):
    r = R.ranks(R.best_entries(board(spark, d)))
    return r.select("player", "score", "rank", F.round(R.percentile(F.col("rank"), F.col("total")), 6).alias("percentile"))


@query("rank_around", f"WITH {BOARD}, {WHOLE} SELECT player, rank FROM k WHERE abs(rank - (SELECT rank FROM k WHERE player = 7)) <= 3")
def rank_around(spark, d):
    return R.around(R.ranks(R.best_entries(board(spark, d))), 7, 3).select("player", "rank")


@query("rank_range", f"WITH {BOARD}, {WHOLE} SELECT player, rank, score FROM k WHERE rank BETWEEN 11 AND 30")
def rank_range(spark, d):
    return R.rank_range(R.ranks(R.best_entries(board(spark, d))), 11, 30).select("player", "rank", "score")


@query("rank_capped", f"WITH {BOARD}, {WHOLE} SELECT player, score FROM k WHERE rank <= 40")
def rank_capped(spark, d):
    return R.capped(R.best_entries(board(spark, d)), 40).select("player", "score")


@query("rank_windows", f"""SELECT ts // {DAY} AS day, (ts + 4 * {DAY}) // (7 * {DAY}) AS week, ts // 2629746000 AS month, ts // 3600000 AS hour, max(value) AS best FROM (SELECT (epoch_us(ts) // 1000) AS ts, value FROM events) GROUP BY ALL""")
def rank_windows(spark, d):
    e = load(spark, d, "events").select(S.millis(F.col("ts")).alias("ms"), "value")
    keys = {"day": "daily", "week": "weekly", "month": "monthly", "hour": 3_600_000}
    return e.groupBy(*(R.bucket(F.col("ms"), w).alias(n) for n, w in keys.items())).agg(F.max("value").alias("best"))


@query("rank_regions", f"WITH {ENTRIES} SELECT board AS region, player, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ts, player) AS rank FROM entries WHERE board IN ('click', 'view', 'purchase')) WHERE rank <= 20")
def rank_regions(spark, d):
    e = R.best_entries(board(spark, d), ["board"])
    return R.merge_regions({b: e.where(F.col("board") == b).drop("board") for b in ("click", "view", "purchase")}, 20).select("region", "player", "score", "rank")


@query("rank_changes", "SELECT event_id, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE event_type IS DISTINCT FROM previous")
def rank_changes(spark, d):
    return R.changes(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("event_id", "previous")


# sets, sorted sets, hashes, lists, bitmaps, streams


def members(spark, d, flag):
    return load(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("member"))


def _set(flag: str) -> str:
    return f"SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_returnflag = '{flag}'"


@query("coll_set_union", f"{_set('A')} UNION {_set('N')}")
def coll_set_union(spark, d):
    return C.union([members(spark, d, "A"), members(spark, d, "N")])


@query("coll_set_inter", f"{_set('A')} INTERSECT {_set('N')} INTERSECT {_set('R')}")
def coll_set_inter(spark, d):
    return C.inter([members(spark, d, x) for x in "ANR"])


@query("coll_set_diff", f"SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def coll_set_diff(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("member"), "o_orderstatus")
    return C.diff([o.where("o_orderstatus = 'F'").select("member"), o.where("o_orderstatus = 'P'").select("member")])


@query("coll_set_inter_card", f"SELECT least(count(*), 50) AS n FROM ({_set('A')} INTERSECT {_set('N')})")
def coll_set_inter_card(spark, d):
    return C.inter_card([members(spark, d, "A"), members(spark, d, "N")], 50)


@query("coll_cardinality", "SELECT l_returnflag AS key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def coll_cardinality(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key")).agg(F.count_distinct("l_partkey").alias("n"))


@query("coll_random_members", "SELECT member FROM (SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_returnflag = 'A') ORDER BY md5('3:' || member), member LIMIT 10")
def coll_random_members(spark, d):
    return C.pick(members(spark, d, "A").distinct(), 10, seed=3)


@query("coll_zset_rank", f"WITH {ZSETS} SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev FROM z")
def coll_zset_rank(spark, d):
    return C.zranks(zsets(spark, d), ["key"]).select("key", "member", "rank", "rev")


@query("coll_zset_range", f"WITH {ZSETS}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, member FROM k WHERE rank BETWEEN n - 12 AND n - 3")
def coll_zset_range(spark, d):
    return C.zrange(zsets(spark, d), -12, -3, ["key"]).select("key", "member")


@query("coll_zset_by_score", f"WITH {ZSETS} SELECT key, member, score FROM z WHERE score > 100 AND score <= 300")
def coll_zset_by_score(spark, d):
    return C.zrange_by_score(zsets(spark, d), "(100", "300").select("key", "member", "score")


@query("coll_zset_by_lex", "SELECT p_name AS member FROM part WHERE p_name >= 'b' AND p_name < 'm'")
def coll_zset_by_lex(spark, d):
    return C.zrange_by_lex(load(spark, d, "part").select(F.col("p_name").alias("member")), "[b", "(m")


@query("coll_zset_count", f"WITH {ZSETS} SELECT count(*) AS n FROM z WHERE key = 'A' AND score >= 150")
def coll_zset_count(spark, d):
    return C.zcount(zset(spark, d, "A"), "150", "+inf")


for _mode, _agg in {"GT": "max(value)", "LT": "min(value)", "NX": "arg_min(value, event_id)", "INCR": "round(sum(value), 4)", "SET": "arg_max(value, event_id)"}.items():

    def _zadd(spark, d, mode=_mode):
        e = load(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
        out = C.zadd(e, mode)
        return out.withColumn("score", F.round("score", 4)) if mode == "INCR" else out

    query(f"coll_zadd_{_mode.lower()}", f"SELECT event_type AS key, user_id AS member, {_agg} AS score FROM events GROUP BY 1, 2")(_zadd)


@query("coll_zset_pop", f"WITH {ZSETS} SELECT member, score FROM z WHERE key = 'R' ORDER BY score DESC, member DESC LIMIT 7")
def coll_zset_pop(spark, d):
    return C.zpop(zset(spark, d, "R"), 7, largest=True)


@query("coll_zset_union", f"WITH {ZSETS} SELECT member, max(score * CASE key WHEN 'A' THEN 2 ELSE 0.5 END) AS score FROM z WHERE key IN ('A', 'N') GROUP BY member")
def coll_zset_union(spark, d):
    return C.zunion([zset(spark, d, "A"), zset(spark, d, "N")], [2.0, 0.5], "max")


@query("coll_zset_inter", f"WITH {ZSETS} SELECT member, sum(score) AS score FROM z WHERE key IN ('A', 'R') GROUP BY member HAVING count(*) = 2")
def coll_zset_inter(spark, d):
    return C.zinter([zset(spark, d, "A"), zset(spark, d, "R")])


@query("coll_zset_diff", f"WITH {ZSETS} SELECT member, score FROM z WHERE key = 'N' AND member NOT IN (SELECT member FROM z WHERE key = 'A' AND score > 250)")
def coll_zset_diff(spark, d):
    return C.zdiff([zset(spark, d, "N"), zset(spark, d, "A").where("score > 250")])


@query("coll_hash_set", "SELECT user_id AS key, event_type AS field, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def coll_hash_set(spark, d):
    return C.hset(load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq")))


@query("coll_hash_incr", "SELECT user_id AS key, event_type AS field, count(*) AS value FROM events GROUP BY 1, 2")
def coll_hash_incr(spark, d):
    return C.hincr(load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.lit(1).alias("amount")))


@query("coll_hash_getall", "SELECT key, string_agg(field || '=' || n, ',' ORDER BY field) AS fields FROM (SELECT user_id AS key, event_type AS field, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY key")
def coll_hash_getall(spark, d):
    maps = C.hash_maps(coll_hash_incr(spark, d))
    return maps.select("key", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


LISTS = "l AS (SELECT conv_id, list(role ORDER BY turn) AS a FROM conversations GROUP BY conv_id)"


def lists(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: x["role"]).alias("a"))


@query("coll_list_reads", f"""WITH {LISTS} SELECT conv_id, len(a)::INT AS n, array_to_string(a[1:2], ',') AS head, array_to_string(a[greatest(len(a) - 1, 1):len(a)], ',') AS tail, a[1] AS first, a[len(a)] AS last,
    CASE WHEN list_position(a, 'assistant') > 0 THEN list_position(a, 'assistant')::INT - 1 END AS at FROM l""")  # fmt: skip
def coll_list_reads(spark, d):
    a = F.col("a")
    return lists(spark, d).select("conv_id", F.size(a).alias("n"), F.array_join(C.lrange(a, 0, 1), ",").alias("head"), F.array_join(C.lrange(a, -2, -1), ",").alias("tail"), C.lindex(a, 0).alias("first"), C.lindex(a, -1).alias("last"), C.lpos(a, F.lit("assistant")).alias("at"))


@query("coll_list_writes", f"""WITH {LISTS} SELECT conv_id, array_to_string(list_filter(a, lambda x: x <> 'user'), ',') AS removed, array_to_string(list_prepend('system', a), ',') AS pushed FROM l""")
def coll_list_writes(spark, d):
    a = F.col("a")
    return lists(spark, d).select("conv_id", F.array_join(C.lrem(a, 0, F.lit("user")), ",").alias("removed"), F.array_join(F.array_prepend(a, F.lit("system")), ",").alias("pushed"))


@query("coll_bit_count", "SELECT p_partkey, bit_count(p_size)::INT AS by_int, bit_count(ascii(p_brand[1]))::INT + bit_count(ascii(p_brand[2]))::INT AS two_bytes, (ascii(p_brand[1]) >> 6)::INT & 1 AS bit1 FROM part")
def coll_bit_count(spark, d):
    brand = F.col("p_brand").cast("binary")
    return load(spark, d, "part").select("p_partkey", F.bit_count("p_size").alias("by_int"), C.bit_count(F.substring(brand, 1, 2)).alias("two_bytes"), C.get_bit(brand, 1).alias("bit1"))


STREAM = "s AS (SELECT event_type AS key, (epoch_us(ts) // 1000) // 1000 AS ms, event_id % 7 AS seq, event_id AS arrival FROM events)"


def stream(spark, d):
    return load(spark, d, "events").select(F.col("event_type").alias("key"), F.floor(S.millis(F.col("ts")) / 1000).alias("ms"), (F.col("event_id") % 7).alias("seq"), F.col("event_id").alias("arrival"))


@query("coll_stream_gate", f"WITH {STREAM} SELECT key, ms, seq, arrival FROM (SELECT *, max(ms * 100 + seq) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s) WHERE top IS NULL OR ms * 100 + seq > top")
def coll_stream_gate(spark, d):
    return C.stream_gate(stream(spark, d), "arrival", "key")


@query("coll_stream_range", f"WITH {STREAM} SELECT key, ms, seq, arrival FROM s WHERE ms * 100 + seq BETWEEN 170500000003 AND 170520000002")
def coll_stream_range(spark, d):
    return C.stream_range(stream(spark, d), (1_705_000_000, 3), (1_705_200_000, 2))


@query("coll_stream_read", f"WITH {STREAM} SELECT ms, seq, arrival FROM (SELECT * FROM s WHERE key = 'click') WHERE ms > 1705000000 ORDER BY ms, seq LIMIT 30")
def coll_stream_read(spark, d):
    return C.stream_read(stream(spark, d).where("key = 'click'"), (1_705_000_000, 6), 30).select("ms", "seq", "arrival")


@query("coll_stream_trim", f"WITH {STREAM} SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM s) WHERE r <= 20")
def coll_stream_trim(spark, d):
    return C.stream_trim(stream(spark, d), "key", 20).select("key", "ms", "seq")


@query("coll_stream_min_id", f"WITH {STREAM} SELECT key, ms, seq, arrival FROM s WHERE ms > 1706000000 OR (ms = 1706000000 AND seq >= 2)")
def coll_stream_min_id(spark, d):
    return C.stream_min_id(stream(spark, d), 1_706_000_000, 2)


@query("coll_string_append", "SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def coll_string_append(spark, d):
    return C.appended(load(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type"), "key", "event_id", "event_type")


@query("coll_string_ranges", "SELECT c_custkey, c_name[10:13] AS mid, c_name[len(c_name) - 2:len(c_name)] AS tail, '' AS none, strlen(c_name)::INT AS n FROM customer")
def coll_string_ranges(spark, d):
    v = F.col("c_name")
    return load(spark, d, "customer").select("c_custkey", C.getrange(v, 9, 12).alias("mid"), C.getrange(v, -3, -1).alias("tail"), C.getrange(v, 5, 2).alias("none"), F.octet_length(v).alias("n"))


@query("coll_string_mget", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (3, 7, 11)")
def coll_string_mget(spark, d):
    return load(spark, d, "customer").where(F.col("c_custkey").isin(3, 7, 11)).select("c_custkey", "c_mktsegment")


@query("coll_set_move", "SELECT DISTINCT CASE WHEN o_custkey = 25 AND o_orderstatus = 'F' THEN 'O' ELSE o_orderstatus END AS key, o_custkey AS member FROM orders")
def coll_set_move(spark, d):
    return C.move(load(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member")), "F", "O", 25)


@query("rank_boards", f"WITH {ENTRIES} SELECT board, count(*) AS players FROM entries WHERE player <> 7 GROUP BY board")
def rank_boards(spark, d):
    e = R.best_entries(board(spark, d), ["board"])
    return e.where("player <> 7").groupBy("board").agg(F.count(F.lit(1)).alias("players"))


@query("keyed_tenant_rows", "SELECT tenant, count(*) AS n FROM (SELECT 'z' || (c_nationkey % 4) AS tenant FROM customer WHERE c_nationkey % 5 <> 0) GROUP BY tenant")
def keyed_tenant_rows(spark, d):
    name = F.when(F.col("c_nationkey") % 5 == 0, F.lit("plain")).otherwise(F.concat(F.lit("tn:z"), F.col("c_nationkey") % 4, F.lit(":items")))
    return load(spark, d, "customer").select(tenant_of(name).alias("tenant")).where("tenant IS NOT NULL").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("keyed_lobby_rows", "SELECT c_nationkey::BIGINT AS lobby, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey")
def keyed_lobby_rows(spark, d):
    name = F.when(F.col("c_nationkey") == 3, F.lit("lx_rows")).otherwise(F.concat(F.lit("l"), F.col("c_nationkey"), F.lit("_rows")))
    return load(spark, d, "customer").select(lobby_of(name).alias("lobby")).where("lobby IS NOT NULL").groupBy("lobby").agg(F.count(F.lit(1)).alias("n"))


# places


@query("geo_distance", f"WITH {PLACES} SELECT member, round({DIST} / 1609.34, 4) AS miles FROM places")
def geo_distance(spark, d):
    return places(spark, d).select("member", G.to_unit(G.haversine(F.lit(15.0), F.lit(37.0), F.col("lon"), F.col("lat")), "mi").alias("miles"))


@query("geo_movement", "SELECT c_custkey AS id, CAST((c_custkey * 37) % 1000 AS DOUBLE) + 0.5 AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) - 2 AS y FROM customer")
def geo_movement(spark, d):
    return X.move(points(spark, d).withColumns({"vx": F.lit(0.5), "vy": F.lit(-2.0)})).select("id", "x", "y")


@query("geo_radius_join", f"WITH {POINTS} SELECT a.id, b.id AS other FROM pts a JOIN pts b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400")
def geo_radius_join(spark, d):
    return X.visible(points(spark, d), 20.0)


@query("geo_grid_radius", f"WITH {POINTS} SELECT id FROM pts WHERE (x - 500) * (x - 500) + (y - 500) * (y - 500) <= 40000")
def geo_grid_radius(spark, d):
    return X.within(points(spark, d), 500.0, 500.0, 200.0).select("id")


_SEE = "SELECT a.id, b.id AS other FROM {0} a JOIN {0} b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225"


@query("geo_enter_exit", f"WITH {POINTS}, {NEXT}, v0 AS ({_SEE.format('pts')}), v1 AS ({_SEE.format('nxt')}) SELECT id, other, 'Enter' AS event FROM (SELECT * FROM v1 EXCEPT SELECT * FROM v0) UNION ALL SELECT id, other, 'Exit' FROM (SELECT * FROM v0 EXCEPT SELECT * FROM v1)")
def geo_enter_exit(spark, d):
    return X.visibility_changes(points(spark, d), next_points(spark, d), 15.0)


DELTAS = f"{POINTS}, {NEXT}, dl AS (SELECT * FROM (SELECT coalesce(b.id, n.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN abs(n.x - b.x) > 0.001 OR abs(n.y - b.y) > 0.001 THEN 'update' END AS op, n.x, n.y FROM pts b FULL JOIN nxt n ON b.id = n.id) WHERE op IS NOT NULL)"


@query("geo_position_deltas", f"WITH {DELTAS} SELECT id, op, x, y FROM dl")
def geo_position_deltas(spark, d):
    return X.position_deltas(points(spark, d), next_points(spark, d))


@query("geo_fan_out", f"WITH {DELTAS}, v AS ({_SEE.format('nxt')}) SELECT v.id AS client, dl.id, dl.op FROM v JOIN dl ON dl.id = v.other UNION ALL SELECT id, id, op FROM dl")
def geo_fan_out(spark, d):
    return X.fan_out(X.position_deltas(points(spark, d), next_points(spark, d)), X.visible(next_points(spark, d), 15.0)).select("client", "id", "op")


@query("geo_search", f"WITH {PLACES} SELECT member, round({DIST} / 1000.0, 4) AS km FROM places WHERE {DIST} <= 2500000")
def geo_search(spark, d):
    return X.geo_radius(places(spark, d), 15.0, 37.0, 2_500_000.0).select("member", G.to_unit(F.col("dist"), "km").alias("km"))


#: Great-circle distance of two points on a sphere, in metres.
APART = "2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians({b}) - radians({y})) / 2), 2) + cos(radians({y})) * cos(radians({b})) * pow(sin((radians({a}) - radians({x})) / 2), 2)))"


@query("geo_box_search", f"WITH {PLACES} SELECT member FROM places WHERE {APART.format(x='lon', y='lat', a='lon', b='37.0')} <= 1000000 AND {APART.format(x='15.0', y='lat', a='lon', b='lat')} <= 1500000")
def geo_box_search(spark, d):
    return X.geo_box(places(spark, d), 15.0, 37.0, 3_000_000.0, 2_000_000.0).select("member")


def _bits(x: str) -> str:
    out = f"CAST(floor({x}) AS BIGINT)"
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = f"(({out} | ({out} << {s})) & {m})" if s == 16 else f"list_transform([{out}], lambda v: (v | (v << {s})) & {m})[1]"
    return out


@query("geo_score", f"WITH {PLACES} SELECT member, {_bits('(lat + 85.05112878) / 170.10225756 * 67108864')} | ({_bits('(lon + 180) / 360 * 67108864')} << 1) AS score FROM places WHERE abs(lat) < 85")
def geo_score(spark, d):
    return places(spark, d).where(F.abs("lat") < 85).select("member", G.score(F.col("lon"), F.col("lat")).alias("score"))


@query("geo_hash_text", f"""WITH {PLACES}, h AS (SELECT member, {_bits('(lat + 90) / 180 * 67108864')} | ({_bits('(lon + 180) / 360 * 67108864')} << 1) AS h FROM places)
    SELECT member, array_to_string(list_transform(range(10), lambda i: substr('{G.BASE32}', CAST(((h >> CAST(47 - 5 * i AS INT)) & 31) + 1 AS INT), 1)), '') || '0' AS geohash FROM h""")  # fmt: skip
def geo_hash_text(spark, d):
    return places(spark, d).select("member", G.geohash(F.col("lon"), F.col("lat")).alias("geohash"))


#: FNV-1a of ASCII text in SQL, and the owners of customers on rings of some members.
FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _owners_sql(name: str, members: str) -> str:
    v = FNV.format("m || '#vnode' || i")
    return f"""r_{name} AS (SELECT {v} AS place, m FROM (SELECT unnest({members}) AS m), (SELECT unnest(range(160)) AS i)),
    o_{name} AS (SELECT c_custkey, coalesce(r.m, (SELECT arg_min(m, place) FROM r_{name})) AS owner FROM c ASOF LEFT JOIN r_{name} r ON c.h <= r.place)"""


HASHED = f"c AS (SELECT c_custkey, {FNV.format('c_name')} AS h FROM customer)"


@query("shard_fnv", f"WITH {HASHED} SELECT c_custkey, (h % 16::UHUGEINT)::INT AS shard FROM c")
def shard_fnv(spark, d):
    return load(spark, d, "customer").select("c_custkey", H.shard_of(F.col("c_name"), 16).alias("shard"))


@query("shard_ring_owner", f"""WITH {HASHED}, {_owners_sql("a", "['east', 'west', 'north']")} SELECT c_custkey, owner FROM o_a""")
def shard_ring_owner(spark, d):
    return H.owners(load(spark, d, "customer").select("c_custkey", "c_name"), "c_name", ["east", "west", "north"]).select("c_custkey", "owner")


@query("shard_ring_moves", f"""WITH {HASHED}, {_owners_sql("a", "['east', 'west', 'north']")}, {_owners_sql("b", "['east', 'west', 'north', 'south']")}
    SELECT c_custkey, o_a.owner AS before, o_b.owner AS owner FROM o_a JOIN o_b USING (c_custkey) WHERE o_a.owner <> o_b.owner""")  # fmt: skip
def shard_ring_moves(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    a = H.owners(c, "c_name", ["east", "west", "north"]).withColumnRenamed("owner", "before")
    return H.owners(a, "c_name", ["east", "west", "north", "south"]).where("before <> owner").select("c_custkey", "before", "owner")


# subscriptions


@query("sub_snapshot", "SELECT c_custkey, c_acctbal, 'initial_snapshot' AS operation FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 100) OR c_nationkey IN (1, 2) ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def sub_snapshot(spark, d):
    sub = U.parse("SUBSCRIBE customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 OR c_nationkey IN (1, 2) ORDER BY c_acctbal DESC LIMIT 25")
    return U.snapshot(sub, load(spark, d, "customer")).select("c_custkey", "c_acctbal", "operation")


@query("sub_live_diff", f"WITH {LOG} SELECT seq, key, op FROM log WHERE op = 'delete' OR value >= 60")
def sub_live_diff(spark, d):
    return U.live(U.parse("log WHERE value >= 60"), log(spark, d)).select("seq", "key", "op")


@query("sub_retractions", f"""WITH {LOG}, m AS (SELECT *, op <> 'delete' AND value >= 60 AS hit, coalesce(lag(op <> 'delete' AND value >= 60) OVER (PARTITION BY key ORDER BY seq), false) AS was FROM log)
    SELECT seq, key, CASE WHEN op <> 'delete' AND was AND NOT hit THEN 'leave' ELSE op END AS op FROM m WHERE op = 'delete' OR hit OR was""")  # fmt: skip
def sub_retractions(spark, d):
    return U.live_with_retractions(U.parse("log WHERE value >= 60"), log(spark, d), "key", "seq").select("seq", "key", "op")


@query("sub_coalesced", f"WITH {LOG} SELECT key, ts // 21600000 AS tick, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key, ts // 21600000")
def sub_coalesced(spark, d):
    return U.coalesced(log(spark, d), F.floor(F.col("ts") / 21_600_000), ["key"], "seq").select("key", "tick", "seq", "value")


@query("sub_patches", f"""WITH {LOG}, p AS (SELECT key, seq, op, event_type, lag(op) OVER w AS o, lag(event_type) OVER w AS t, row_number() OVER w AS r FROM log WINDOW w AS (PARTITION BY key ORDER BY seq))
    SELECT key, seq, CASE WHEN r = 1 OR op <> o THEN op END AS new_op, CASE WHEN r = 1 OR event_type <> t THEN event_type END AS new_type FROM p""")  # fmt: skip
def sub_patches(spark, d):
    p = U.patches(log(spark, d), "key", "seq", ["op", "event_type"])
    return p.select("key", "seq", F.col("patch")["op"].alias("new_op"), F.col("patch")["event_type"].alias("new_type"))


@query("sub_frames", f"WITH {LOG} SELECT key, ts // {DAY} AS tick, count(*)::INT AS n, min(seq) AS first FROM log GROUP BY 1, 2")
def sub_frames(spark, d):
    f = U.frames(log(spark, d).withColumn("tick", F.floor(F.col("ts") / DAY)), "key", "tick", "seq", ["op"])
    return f.select("key", "tick", F.size("batch").alias("n"), F.col("batch")[0]["seq"].alias("first"))


@query("sub_pubsub", "SELECT event_id, (event_type LIKE 'c%')::INT + (event_type LIKE '%e%')::INT AS n FROM events")
def sub_pubsub(spark, d):
    m = load(spark, d, "events").select("event_id", F.col("event_type").alias("channel"))
    return U.deliveries(m, spark.createDataFrame([("c*",), ("*e*",)], "pattern string")).select("event_id", "n")


# data changes, schemas, scans


@query("dml_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def dml_insert(spark, d):
    rows = load(spark, d, "nation").where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return M.insert_rows(load(spark, d, "region"), rows).select("r_regionkey", "r_name")


@query("dml_update", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_acctbal + c_nationkey ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 5 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer")
def dml_update(spark, d):
    c = load(spark, d, "customer")
    return B.bulk_update(c, F.col("c_nationkey") < 5, c_acctbal=F.col("c_acctbal") + F.col("c_nationkey"), c_nationkey=F.lit(0)).select("c_custkey", "c_acctbal", "c_nationkey")


@query("dml_delete", "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def dml_delete(spark, d):
    return B.bulk_delete(load(spark, d, "customer"), F.nullif(F.col("c_nationkey"), F.lit(3)) > 10).select("c_custkey")


@query("dml_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_upsert(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return K.upsert(s, s.where("s_suppkey % 5 = 0").withColumn("s_acctbal", F.lit(1.5)), "s_suppkey")


@query("dml_migrations", "SELECT c_custkey AS id, c_name, 1 AS level FROM customer")
def dml_migrations(spark, d):
    c = M.add_field(M.rename_field(load(spark, d, "customer"), "c_custkey", "id"), "level", 1)
    return M.remove_field(M.remove_field(c, "c_acctbal"), "no_such").select("id", "c_name", "level")


@query("schema_validate", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), 99)::BIGINT AS zone, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
def schema_validate(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("zone"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return M.validate(c, [M.Field("zone", "i64", default=99), M.Field("segment", "string", required=True)])[0].select("c_custkey", "zone", "segment")


@query("schema_rejects", "SELECT c_custkey, 'segment is required' AS reason FROM customer WHERE c_mktsegment = 'BUILDING'")
def schema_rejects(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return M.validate(c, [M.Field("segment", "string", required=True)])[1].select("c_custkey", "reason")


@query("schema_row_policy", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def schema_row_policy(spark, d):
    return load(spark, d, "orders").where(M.row_policy("owner_field", "1-URGENT", "player", "o_orderpriority")).select("o_orderkey")


POLICIES = (("public", "player"), ("owner_field", "player"), ("owner_field", "system"), ("role_gated", "player"), ("role_gated", "judge"), ("owner_field_with_admin", "admin"), ("owner_field_with_admin", "player"))


@query("schema_row_policies", "SELECT p || '/' || r AS seen_by, count(*) AS n FROM orders, (VALUES " + ", ".join(str(x) for x in POLICIES) + """) AS t(p, r)
    WHERE p = 'public' OR r IN ('system', 'admin', 'judge') OR (p <> 'role_gated' AND o_orderpriority = '1-URGENT') GROUP BY p, r""")  # fmt: skip
def schema_row_policies(spark, d):
    seen = [F.when(M.row_policy(p, "1-URGENT", r, "o_orderpriority", ("judge",)), F.lit(f"{p}/{r}")) for p, r in POLICIES]
    return load(spark, d, "orders").select(F.explode(F.array_compact(F.array(*seen))).alias("seen_by")).groupBy("seen_by").agg(F.count(F.lit(1)).alias("n"))


@query("scan_column", "SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer ORDER BY c_custkey")
def scan_column(spark, d):
    return column_scan(load(spark, d, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3))), "c_custkey", "c_nationkey")


@query("scan_key_pattern", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '[a-f].* .*[^e]')")
def scan_key_pattern(spark, d):
    return load(spark, d, "part").where(matches(F.col("p_name"), "[a-f]* *[^e]")).select("p_partkey", "p_name")


@query("scan_prefix", "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def scan_prefix(spark, d):
    return load(spark, d, "customer").where(matches(F.col("c_name"), "Customer#00000001*")).select("c_custkey")


@query("scan_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")
def scan_pages(spark, d):
    return scan_page(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 40)


def _all(spark, d):
    return {t: load(spark, d, t) for t in TABLES}


@query("scan_census", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_census(spark, d):
    return census(_all(spark, d))


@query("scan_total_rows", "SELECT CAST(sum(n) AS BIGINT) AS n_rows FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES) + ")")
def scan_total_rows(spark, d):
    return total_rows(_all(spark, d))


_NAMED = "table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"


@query("scan_catalog_columns", f"""SELECT DISTINCT table_name, column_name, ordinal_position::INT AS ordinal_position, 'YES' AS is_nullable,
    CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'TIMESTAMP' THEN 'timestamp_ntz' WHEN data_type LIKE '%[]' THEN 'array<' || lower(replace(data_type, '[]', '')) || '>' ELSE lower(data_type) END AS data_type
    FROM information_schema.columns WHERE {_NAMED}""")  # fmt: skip
def scan_catalog_columns(spark, d):
    return catalog_columns(_all(spark, d))


@query("scan_catalog_tables", f"SELECT DISTINCT table_name, 'public' AS table_schema, 'BASE TABLE' AS table_type FROM information_schema.tables WHERE {_NAMED}")
def scan_catalog_tables(spark, d):
    return catalog_tables(_all(spark, d))


@query("scan_seed_rows", "SELECT 'event' AS table_name, CAST(event_id AS VARCHAR) AS row_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def scan_seed_rows(spark, d):
    key = F.when(F.col("event_id") % 10 == 0, F.lit('""')).otherwise(F.concat(F.lit('"'), F.col("event_id"), F.lit('"')))
    rows = load(spark, d, "events").select(F.concat(F.lit('["event",'), key, F.lit(","), F.col("props"), F.lit("]")).alias("row"))
    return seed_rows(spark, rows)[0].select("table_name", "row_key", F.get_json_object("data", "$.k").cast("bigint").alias("k"))


# functions


@query("fn_two_valued", """SELECT c_custkey, k IS NOT DISTINCT FROM 3 AS eq, k IS DISTINCT FROM 3 AS ne, NOT coalesce(k > 10, false) AS not_gt, coalesce(k IN (1, 2), false) AS in_pg, coalesce(k IN (1, 2), false) OR k IS NULL AS in_kv,
    CASE WHEN k IS NULL THEN false ELSE k BETWEEN 2 AND 9 END AS between_kv, coalesce(k <> 0, false) AS truthy FROM (SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer)""")  # fmt: skip
def fn_two_valued(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(5)).alias("k"))
    k = F.col("k")
    return c.select("c_custkey", S.eq_ns(k, F.lit(3)).alias("eq"), S.ne_ns(k, F.lit(3)).alias("ne"), S.not2(k > 10).alias("not_gt"), S.in2(k, [1, 2, None]).alias("in_pg"), S.in_kv(k, [1, 2, None]).alias("in_kv"), S.between_kv(k, F.lit(2), F.lit(9)).alias("between_kv"), S.truthy_number(k).alias("truthy"))


@query("fn_kv_arithmetic", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS q, CASE WHEN l_linenumber <> 2 THEN l_orderkey % (l_linenumber - 2) END AS m, l_orderkey // l_linenumber AS div_pg, l_returnflag || '' || coalesce(nullif(l_linestatus, 'F'), '') AS tag FROM lineitem""")
def fn_kv_arithmetic(spark, d):
    line = load(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", S.div_kv(F.col("l_quantity"), F.col("l_discount")).alias("q"), S.mod_kv(F.col("l_orderkey"), F.col("l_linenumber") - 2).alias("m"), S.div_pg(F.col("l_orderkey"), F.col("l_linenumber")).alias("div_pg"), S.concat_kv(F.col("l_returnflag"), F.nullif("l_linestatus", F.lit("F"))).alias("tag"))


@query("fn_kv_strings", """SELECT p_partkey, upper(coalesce(s, '')) AS up, lower(coalesce(s, '')) AS low, length(coalesce(s, ''))::INT AS n, replace(p_name, 'a', '*') AS rep, coalesce(substr(s, 1, 4), '') AS sub, regexp_replace(regexp_replace(chr(9) || p_name || ' ' || chr(10), '^\\s+', ''), '\\s+$', '') AS trimmed,
    coalesce(s LIKE 'b%', false) AS b, coalesce(round(p_retailprice, 1), 0.0) AS r, floor(p_retailprice)::DOUBLE AS f, ceil(p_retailprice)::DOUBLE AS c FROM (SELECT *, nullif(p_name, 'x') AS s FROM part)""")  # fmt: skip
def fn_kv_strings(spark, d):
    p = load(spark, d, "part").withColumn("s", F.nullif("p_name", F.lit("x")))
    s, price = F.col("s"), F.col("p_retailprice")
    return p.select("p_partkey", F.upper(S.text_kv(s)).alias("up"), F.lower(S.text_kv(s)).alias("low"), F.length(S.text_kv(s)).alias("n"), F.replace("p_name", F.lit("a"), F.lit("*")).alias("rep"), S.substr_kv(s, -3, 4).alias("sub"), S.trim_kv(F.concat(F.lit("\t"), F.col("p_name"), F.lit(" \n"))).alias("trimmed"), S.like_escaped(s, "b%").alias("b"), S.round_kv(price, 1).alias("r"), F.floor(price).cast("double").alias("f"), F.ceil(price).cast("double").alias("c"))


@query("fn_pg_scalars", "SELECT c_custkey, greatest(c_nationkey, nullif(c_nationkey % 7, 0), 4) AS g, least(c_nationkey, nullif(c_nationkey % 7, 0)) AS l, coalesce(nullif(c_nationkey, 3), -1) AS c, abs(c_acctbal) AS a, concat('x', nullif(c_mktsegment, 'BUILDING'), 'y') AS t, char_length(c_name)::INT AS n FROM customer")
def fn_pg_scalars(spark, d):
    k = F.col("c_nationkey")
    return load(spark, d, "customer").select("c_custkey", F.greatest(k, F.nullif(k % 7, F.lit(0)), F.lit(4)).alias("g"), F.least(k, F.nullif(k % 7, F.lit(0))).alias("l"), F.coalesce(F.nullif(k, F.lit(3)), F.lit(-1)).alias("c"), F.abs("c_acctbal").alias("a"), S.concat_kv(F.lit("x"), F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("y")).alias("t"), F.char_length("c_name").alias("n"))


@query("fn_rule_math", "SELECT p_partkey, least(greatest(p_size, 10), 30) AS c, sign(p_size - 25)::BIGINT AS s, round(sqrt(p_size), 9) AS q, round(pow(p_size, 2), 3) AS p, round(log2(p_size), 9) AS l2, round(log10(p_size), 9) AS l10, round(p_retailprice)::BIGINT AS r, trunc(p_retailprice / 2000)::BIGINT <> 0 AS b FROM part")
def fn_rule_math(spark, d):
    x, price = F.col("p_size"), F.col("p_retailprice")
    return load(spark, d, "part").select("p_partkey", B.clamp(x, F.lit(10), F.lit(30)).alias("c"), B.sign(x - 25).alias("s"), F.round(F.sqrt(x), 9).alias("q"), F.round(F.pow(x, F.lit(2)), 3).alias("p"), F.round(F.log2(x), 9).alias("l2"), F.round(F.log10(x), 9).alias("l10"), B.round_int(price).alias("r"), B.to_bool(price / 2000).alias("b"))


@query("fn_rule_strings", """SELECT doc_id, strlen(text)::INT AS bytes, contains(text, 'the') AS c, starts_with(text, 'Th') AS sw, ends_with(text, '.') AS ew, substring(text, 3, 5) AS sub, list_count(string_split(text, '. '))::INT AS parts, coalesce(try_cast(source[4:] AS BIGINT), 0) AS i, text[2:2] AS ch, repeat(lang, 2) AS rp FROM documents""")
def fn_rule_strings(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", B.byte_len(t).alias("bytes"), t.contains("the").alias("c"), t.startswith("Th").alias("sw"), t.endswith(".").alias("ew"), B.substring(t, 2, 7).alias("sub"), F.size(B.split_literal(t, ". ")).alias("parts"), B.parse_int(F.substring("source", 4, 10)).alias("i"), B.char_at(t, 1).alias("ch"), F.repeat("lang", F.lit(2)).alias("rp"))


@query("fn_rule_arrays", "SELECT vec_id, len(embedding)::INT AS n, embedding[3]::DOUBLE AS third, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, len(embedding[3:6])::INT AS cut, len(embedding[1:len(embedding) - 1])::INT AS popped FROM embeddings")
def fn_rule_arrays(spark, d):
    a = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", B.array_len(a).alias("n"), F.get(a, F.lit(2)).cast("double").alias("third"), B.array_first(a).cast("double").alias("first"), B.array_last(a).cast("double").alias("last"), F.size(B.array_slice(a, 2, 6)).alias("cut"), F.size(B.array_pop(a)).alias("popped"))


@query("fn_rule_aggregates", "SELECT count(*) AS n, round(sum(coalesce(c_acctbal, 0)), 2) AS s, round(sum(coalesce(c_acctbal, 0)) / count(*), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
def fn_rule_aggregates(spark, d):
    return load(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.round(B.sum_field("c_acctbal"), 2).alias("s"), F.round(B.avg_field("c_acctbal"), 6).alias("a"), B.min_field("c_acctbal").alias("lo"), B.max_field("c_acctbal").alias("hi"))


@query("fn_count_by_field", "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1")
def fn_count_by_field(spark, d):
    return B.count_by_field(load(spark, d, "customer").withColumn("k", F.nullif("c_nationkey", F.lit(3))), "k")


@query("fn_distinct_values", "SELECT DISTINCT coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'null') AS value FROM customer")
def fn_distinct_values(spark, d):
    return B.distinct_field_values(load(spark, d, "customer").withColumn("k", F.nullif("c_nationkey", F.lit(3))), "k")


@query("fn_top_n", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def fn_top_n(spark, d):
    return B.top_n(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 12, "c_custkey")


@query("fn_find_first", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 1")
def fn_find_first(spark, d):
    return B.find_first(load(spark, d, "customer"), "c_mktsegment", "MACHINERY", "c_custkey").select("c_custkey")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
