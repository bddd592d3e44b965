"""Registered queries over row changes, tables, and commands on strings, keys, lists, sets, sorted sets, streams and places, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.functions import semantics as S
from tidemark.operators import changes as D
from tidemark.operators import collections as C
from tidemark.operators import commands as M
from tidemark.operators import ordered as O
from tidemark.plans.keyed_queries import LISTS, LOG, PLACES, STREAM, ZSETS, Query, lists, log, places, stream, zset, zsets
from tidemark.sources.tables import load

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Keys with a text value and an expiry in ms.
KEYS = "k AS (SELECT n_name AS key, n_name AS value, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 1000 END AS expires_at FROM nation)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return load(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_name").alias("value"), F.when(n % 3 == 0, n * 1000).cast("long").alias("expires_at"))


# changes and tables


@query("dml_insert_returning", "SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY c_custkey) AS r_regionkey, c_name AS r_name FROM customer WHERE c_acctbal > 0")
def dml_insert_returning(spark, d):
    rows = load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("r_name"))
    return D.with_serial(rows, load(spark, d, "region"), "r_regionkey", [F.col("c_custkey")]).select("r_regionkey", "r_name")


@query("dml_not_null", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'zone' WHEN c_mktsegment = 'BUILDING' THEN 'segment' END AS refused FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'")
def dml_not_null(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("zone"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return D.not_null(rows, ["zone", "segment"])[1].select("c_custkey", "refused")


@query("dml_update_returning", "SELECT c_custkey, c_acctbal + c_nationkey AS c_acctbal, c_acctbal * 2 AS twice FROM (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 5)".replace("c_acctbal * 2", "(c_acctbal + c_nationkey) * 2"))
def dml_update_returning(spark, d):
    c = load(spark, d, "customer")
    return D.update_returning(c, F.col("c_nationkey") < 5, ["c_custkey", "c_acctbal", (F.col("c_acctbal") * 2).alias("twice")], c_acctbal=F.col("c_acctbal") + F.col("c_nationkey"))


@query("dml_delete_returning", "SELECT c_custkey, c_name FROM customer WHERE nullif(c_nationkey, 3) > 10")
def dml_delete_returning(spark, d):
    return D.delete_returning(load(spark, d, "customer"), F.nullif(F.col("c_nationkey"), F.lit(3)) > 10, ["c_custkey", "c_name"])


@query("dml_insert_keys", "SELECT CASE WHEN c_nationkey <> 3 THEN CAST(c_custkey AS VARCHAR) WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS row_key, count(*) AS n FROM customer WHERE c_nationkey <> 3 OR c_mktsegment <> 'BUILDING' GROUP BY 1")
def dml_insert_keys(spark, d):
    rows = load(spark, d, "customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("row_key"))
    return D.keyed_rows(rows).where("row_key NOT LIKE 'row_%'").groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))


@query("dml_insert_unnamed", "SELECT n_nationkey AS col0, n_name AS col1 FROM nation")
def dml_insert_unnamed(spark, d):
    return D.unnamed(load(spark, d, "nation").select("n_nationkey", "n_name"))


def catalog(spark, d) -> D.Catalog:
    empty = spark.sql("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS STRING) AS name LIMIT 0")
    other = spark.sql("SELECT 1 AS x LIMIT 0")
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return D.Catalog().create("players", empty).create("players", other, if_not_exists=True).insert("players", rows).create("scores", empty)


@query("ddl_create", "SELECT c_custkey AS id, c_name AS name FROM customer")
def ddl_create(spark, d):
    return catalog(spark, d).tables["players"]


@query("ddl_drop", "SELECT 'players' AS name, 2 AS n_columns")
def ddl_drop(spark, d):
    c = catalog(spark, d).drop("scores").drop("scores", if_exists=True)
    return spark.createDataFrame([(k, len(c.schema(k))) for k in sorted(c.tables)], "name string, n_columns int")


@query("ddl_truncate", "SELECT 0 AS n, 1 AS after FROM region LIMIT 1")
def ddl_truncate(spark, d):
    c = catalog(spark, d).truncate("players")
    again = c.insert("players", spark.sql("SELECT CAST(1 AS BIGINT) AS id, 'a' AS name"))
    n = c.tables["players"].agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.crossJoin(again.tables["players"].agg(F.count(F.lit(1)).cast("int").alias("after")))  # one row each


# strings and keys


@query("coll_string_set_range", "SELECT p_partkey, substr(p_brand, 1, 2) || 'XY' || substr(p_brand, 5) AS inside, rpad(p_brand, greatest(len(p_brand), 20)::INT, chr(46))[1:20] || 'Z' AS padded FROM part")
def coll_string_set_range(spark, d):
    v = F.col("p_brand")
    return load(spark, d, "part").select("p_partkey", M.set_range(v, 2, F.lit("XY")).alias("inside"), F.replace(M.set_range(v, 20, F.lit("Z")), F.lit("\0"), F.lit(".")).alias("padded"))


@query("coll_string_set_bit", "SELECT p_partkey, chr((ascii(p_brand[1]) | 32)::INT) || p_brand[2:] AS low FROM part")
def coll_string_set_bit(spark, d):
    return load(spark, d, "part").select("p_partkey", M.set_bit(F.col("p_brand").cast("binary"), 2, True).cast("string").alias("low"))


@query("coll_bit_count_range", """SELECT p_partkey, (bit_count(ascii(p_brand[2])) + bit_count(ascii(p_brand[3])))::INT AS by_byte, (bit_count(ascii(p_brand[1]) & 15) + bit_count(ascii(p_brand[2]) & 240))::INT AS by_bit,
    bit_count(ascii(p_brand[len(p_brand)]))::INT AS last FROM part""")  # fmt: skip
def coll_bit_count_range(spark, d):
    b = F.col("p_brand").cast("binary")
    return load(spark, d, "part").select("p_partkey", M.bit_count_range(b, 1, 2).alias("by_byte"), M.bit_count_range(b, 4, 11, True).alias("by_bit"), M.bit_count_range(b, -1, -1).alias("last"))


@query("coll_string_get_set", f"WITH {KEYS} SELECT key, value AS old, 'new' AS now FROM k WHERE key LIKE '%1%'")
def coll_string_get_set(spark, d):
    k = keys(spark, d).where("key LIKE '%1%'")
    return k.select("key", F.col("value").alias("old"), F.lit("new").alias("now"))


@query("coll_string_get_del", f"WITH {KEYS} SELECT key, value FROM k WHERE key NOT IN ('NATION_1', 'NATION_2')")
def coll_string_get_del(spark, d):
    return M.read_and(keys(spark, d), ["NATION_1", "NATION_2"], delete=True)[1].select("key", "value")


@query("coll_string_get_ex", f"WITH {KEYS} SELECT key, CASE WHEN key IN ('NATION_1', 'NATION_2') THEN 77 ELSE expires_at END AS expires_at FROM k")
def coll_string_get_ex(spark, d):
    return M.read_and(keys(spark, d), ["NATION_1", "NATION_2"], expires_at=77)[1].select("key", "expires_at")


@query("coll_string_mset_nx", f"WITH {KEYS} SELECT key, value FROM k UNION ALL SELECT upper(r_name) || '!', r_name FROM region")
def coll_string_mset_nx(spark, d):
    rows = load(spark, d, "region").select(F.concat(F.upper("r_name"), F.lit("!")).alias("key"), F.col("r_name").alias("value"), F.lit(None).cast("long").alias("expires_at"))
    k = M.set_if_all_new(keys(spark, d), rows)
    clash = rows.withColumn("key", F.when(F.col("value") == F.col("value"), F.lit("NATION_1")))
    return M.set_if_all_new(k, clash).select("key", "value")


@query("keyed_persist", f"WITH {KEYS} SELECT key, coalesce(CASE WHEN key NOT IN ('NATION_1', 'NATION_3') THEN expires_at END, -1) AS expires_at, coalesce(CASE WHEN key NOT IN ('NATION_1', 'NATION_3') THEN expires_at END // 1000, -1) AS seconds FROM k")
def keyed_persist(spark, d):
    k = M.persist(keys(spark, d), ["NATION_1", "NATION_3"])
    e = F.col("expires_at")
    return k.select("key", F.coalesce(e, F.lit(-1)).alias("expires_at"), F.coalesce(F.floor(e / 1000), F.lit(-1)).cast("long").alias("seconds"))


@query("keyed_rename", f"WITH {KEYS} SELECT CASE WHEN key = 'NATION_1' THEN 'NATION_2' ELSE key END AS key, value FROM k WHERE key <> 'NATION_2'")
def keyed_rename(spark, d):
    k = M.rename(keys(spark, d), "NATION_1", "NATION_2")
    k = M.rename(M.rename(k, "NOBODY", "NATION_4"), "NATION_4", "NATION_2", only_new=True)
    return k.select("key", "value")


@query("keyed_copy", f"WITH {KEYS} SELECT key, value FROM k WHERE key <> 'NATION_2' UNION ALL SELECT 'NATION_2', value FROM k WHERE key = 'NATION_1'")
def keyed_copy(spark, d):
    return M.copy(M.copy(keys(spark, d), "NATION_1", "NATION_2", replace=True), "NATION_4", "NATION_2").select("key", "value")


@query("keyed_types", "SELECT 'string' AS kind, count(DISTINCT n_name) AS n FROM nation UNION ALL SELECT 'zset', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'list', count(DISTINCT conv_id) FROM conversations")
def keyed_types(spark, d):
    kinds = [("string", keys(spark, d), "key"), ("zset", zsets(spark, d), "key"), ("list", load(spark, d, "conversations"), "conv_id")]
    out = None
    for kind, df, key in kinds:
        one = df.agg(F.count_distinct(key).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


# hashes: (key, field, value)


HASH = "h AS (SELECT user_id AS key, event_type AS field, count(*) AS value FROM events GROUP BY 1, 2)"


def hashes(spark, d):
    return load(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.count(F.lit(1)).alias("value"))


@query("coll_hash_mget", f"WITH {HASH}, u AS (SELECT DISTINCT key FROM h) SELECT u.key, c.value AS click, n.value AS none FROM u LEFT JOIN h c ON c.key = u.key AND c.field = 'click' LEFT JOIN h n ON n.key = u.key AND n.field = 'none'")
def coll_hash_mget(spark, d):
    return hashes(spark, d).groupBy("key").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("click", "none")))


@query("coll_hash_fields", f"WITH {HASH} SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value::VARCHAR, ',' ORDER BY field) AS vals, max(len(value::VARCHAR))::INT AS longest FROM h GROUP BY key")
def coll_hash_fields(spark, d):
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    g = hashes(spark, d).groupBy("key").agg(pairs.alias("p"), F.max(F.length(F.col("value").cast("string"))).alias("longest"))
    return g.select("key", F.array_join(F.col("p.field"), ",").alias("fields"), F.array_join(F.transform("p.value", lambda v: v.cast("string")), ",").alias("vals"), "longest")


@query("coll_hash_del", f"WITH {HASH} SELECT key, field, value FROM h WHERE field NOT IN ('click', 'error')")
def coll_hash_del(spark, d):
    gone = spark.createDataFrame([("click",), ("error",)], "field string")
    return hashes(spark, d).join(F.broadcast(gone), "field", "left_anti").select("key", "field", "value")


@query("coll_hash_scan", f"WITH {HASH} SELECT key, field, value FROM h WHERE field LIKE '%i%' ORDER BY key, field LIMIT 40")
def coll_hash_scan(spark, d):
    return hashes(spark, d).where(F.col("field").like("%i%")).orderBy("key", "field").limit(40)


# sets


@query("coll_set_is_member", "SELECT p_partkey AS member, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AS found FROM part")
def coll_set_is_member(spark, d):
    have = load(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("member")).distinct().withColumn("_in", F.lit(True))
    return load(spark, d, "part").select(F.col("p_partkey").alias("member")).join(have, "member", "left").select("member", F.coalesce("_in", F.lit(False)).alias("found"))


@query("coll_set_remove", "SELECT DISTINCT l_partkey AS member FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def coll_set_remove(spark, d):
    s = load(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("member"))
    return C.diff([s, load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("member"))])


# lists


@query("coll_list_pop", f"""WITH {LISTS} SELECT conv_id, array_to_string(a[1:2], ',') AS popped, array_to_string(a[3:len(a)], ',') AS rest, a[len(a)] AS last, array_to_string(a[1:len(a) - 1], ',') AS rest_right FROM l""")
def coll_list_pop(spark, d):
    popped, rest = M.lpop(F.col("a"), 2)
    last, right = M.lpop(F.col("a"), 1, right=True)
    return lists(spark, d).select("conv_id", F.array_join(popped, ",").alias("popped"), F.array_join(rest, ",").alias("rest"), F.get(last, F.lit(0)).alias("last"), F.array_join(right, ",").alias("rest_right"))


@query("coll_list_trim", f"WITH {LISTS} SELECT conv_id, array_to_string(a[2:len(a) - 1], ',') AS kept FROM l")
def coll_list_trim(spark, d):
    return lists(spark, d).select("conv_id", F.array_join(M.ltrim(F.col("a"), 1, -2), ",").alias("kept"))


@query("coll_list_move", f"WITH {LISTS} SELECT conv_id, array_to_string(a[1:len(a) - 1], ',') AS src, array_to_string(list_concat(a[len(a):len(a)], ['x', 'y']), ',') AS dst FROM l")
def coll_list_move(spark, d):
    src, dst = M.lmove(F.col("a"), F.array(F.lit("x"), F.lit("y")), True, False)
    return lists(spark, d).select("conv_id", F.array_join(src, ",").alias("src"), F.array_join(dst, ",").alias("dst"))


@query("coll_list_pos_count", f"WITH {LISTS} SELECT conv_id, array_to_string(list_filter(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] = 'user' THEN i END), lambda i: i IS NOT NULL)[1:2], ',') AS first_two FROM l")
def coll_list_pos_count(spark, d):
    return lists(spark, d).select("conv_id", F.array_join(F.transform(M.lpos_all(F.col("a"), F.lit("user"), 2), lambda i: i.cast("string")), ",").alias("first_two"))


@query("coll_list_set_insert", f"""WITH {LISTS} SELECT conv_id, array_to_string(list_concat(['first'], a[2:len(a)]), ',') AS set_first,
    array_to_string(CASE WHEN list_position(a, 'assistant') > 0 THEN list_concat(list_concat(a[1:list_position(a, 'assistant') - 1], ['new']), a[list_position(a, 'assistant'):len(a)]) ELSE a END, ',') AS inserted FROM l""")  # fmt: skip
def coll_list_set_insert(spark, d):
    a = F.col("a")
    return lists(spark, d).select("conv_id", F.array_join(C.lset(a, 0, F.lit("first")), ",").alias("set_first"), F.array_join(C.linsert(a, F.lit("assistant"), F.lit("new")), ",").alias("inserted"))


# sorted sets


@query("coll_zset_rem_rank", f"WITH {ZSETS} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r, count(*) OVER (PARTITION BY key) AS n FROM z) WHERE r - 1 NOT BETWEEN greatest(n - 30, 0) AND n - 11")
def coll_zset_rem_rank(spark, d):
    return M.zrem_by_rank(zsets(spark, d), -30, -11, ["key"])


@query("coll_zset_rem_score", f"WITH {ZSETS} SELECT member, score FROM z WHERE key = 'A' AND NOT (score > 100 AND score <= 200)")
def coll_zset_rem_score(spark, d):
    return M.zrem_by_score(zset(spark, d, "A"), "(100", "200")


@query("coll_zset_rem_lex", "SELECT n_name AS member FROM nation WHERE NOT (n_name >= 'NATION_12' AND n_name < 'NATION_3')")
def coll_zset_rem_lex(spark, d):
    return M.zrem_by_lex(load(spark, d, "nation").select(F.col("n_name").alias("member"), F.lit(0).alias("score")), "[NATION_12", "(NATION_3").select("member")


@query("coll_zset_lex_count", "SELECT count(*) AS n FROM nation WHERE n_name > 'NATION_12' AND n_name <= 'NATION_21'")
def coll_zset_lex_count(spark, d):
    return C.zrange_by_lex(load(spark, d, "nation").select(F.col("n_name").alias("member")), "(NATION_12", "[NATION_21").agg(F.count(F.lit(1)).alias("n"))


@query("coll_zset_mscore", f"WITH {ZSETS} SELECT p_partkey AS member, score FROM part LEFT JOIN (SELECT member, score FROM z WHERE key = 'R') t ON member = p_partkey")
def coll_zset_mscore(spark, d):
    return M.zmscore(zset(spark, d, "R"), load(spark, d, "part").select(F.col("p_partkey").alias("member")))


@query("coll_zset_rev_limit", f"WITH {ZSETS} SELECT member, score FROM z WHERE key = 'N' AND score >= 50 AND score < 400 ORDER BY score DESC, member DESC LIMIT 12 OFFSET 5")
def coll_zset_rev_limit(spark, d):
    return M.zlimit(C.zrange_by_score(zset(spark, d, "N"), "50", "(400"), 5, 12, reverse=True)


@query("coll_zadd_flags", f"""WITH {ZSETS}, a AS (SELECT member, score FROM z WHERE key = 'A'), r AS (SELECT member, score FROM z WHERE key = 'R')
    SELECT member, greatest(a.score, r.score) AS score, a.score IS NULL OR coalesce(r.score > a.score, false) AS changed FROM a FULL JOIN r USING (member)""")  # fmt: skip
def coll_zadd_flags(spark, d):
    return M.zadd_flags(zset(spark, d, "A"), zset(spark, d, "R"), "GT")


@query("coll_zadd_xx", f"WITH {ZSETS} SELECT a.member, coalesce(r.score, a.score) AS score, coalesce(r.score <> a.score, false) AS changed FROM (SELECT * FROM z WHERE key = 'A') a LEFT JOIN (SELECT * FROM z WHERE key = 'R') r USING (member)")
def coll_zadd_xx(spark, d):
    return M.zadd_flags(zset(spark, d, "A"), zset(spark, d, "R"), "XX")


# streams


@query("coll_stream_add", f"WITH {STREAM}, m AS (SELECT key, arrival, max(ms) OVER (PARTITION BY key ORDER BY arrival) AS ms FROM s) SELECT key, arrival, ms, row_number() OVER (PARTITION BY key, ms ORDER BY arrival) - 1 AS seq FROM m")
def coll_stream_add(spark, d):
    return M.stream_ids(stream(spark, d).select("key", "arrival", F.col("ms").alias("clock")), "key", "arrival", "clock").select("key", "arrival", "ms", "seq")


@query("coll_stream_delete", f"WITH {STREAM} SELECT key, ms, seq, arrival FROM s WHERE NOT (arrival % 5 = 0)")
def coll_stream_delete(spark, d):
    s = M.stream_ids(stream(spark, d).select("key", "arrival", F.col("ms").alias("clock")), "key", "arrival", "clock")
    left = M.stream_delete(s, s.where("arrival % 5 = 0").select("key", "ms", "seq"))
    return left.select("key", F.col("clock").alias("ms"), (F.col("arrival") % 7).alias("seq"), "arrival")


@query("coll_stream_length", f"WITH {STREAM} SELECT key, count(*) AS n FROM s GROUP BY key")
def coll_stream_length(spark, d):
    return stream(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("coll_stream_rev_range", f"WITH {STREAM} SELECT ms, seq, arrival FROM s WHERE key = 'click' AND ms * 100 + seq <= 170520000002 ORDER BY ms DESC, seq DESC, arrival DESC LIMIT 15")
def coll_stream_rev_range(spark, d):
    s = stream(spark, d).where("key = 'click'")
    return C.stream_range(s, (0, 0), (1_705_200_000, 2)).orderBy(F.desc("ms"), F.desc("seq"), F.desc("arrival")).limit(15).select("ms", "seq", "arrival")


# places


@query("geo_nearest", f"WITH {PLACES}, x AS (SELECT member, 2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians(lat) - radians(37.0)) / 2), 2) + cos(radians(37.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(15.0)) / 2), 2))) AS m FROM places) SELECT member, round(m, 3) AS m FROM x WHERE m <= 6000000 ORDER BY x.m, member LIMIT 7")
def geo_nearest(spark, d):
    m = G.haversine(F.lit(15.0), F.lit(37.0), F.col("lon"), F.col("lat"))
    return places(spark, d).select("member", m.alias("m")).where("m <= 6000000").orderBy("m", "member").limit(7).select("member", F.round("m", 3).alias("m"))


@query("geo_store_distance", f"WITH {PLACES}, x AS (SELECT member, 2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians(lat) - radians(37.0)) / 2), 2) + cos(radians(37.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(15.0)) / 2), 2))) AS m FROM places) SELECT member, round(m / 1000, 6) AS score FROM x WHERE m <= 3000000")
def geo_store_distance(spark, d):
    m = G.haversine(F.lit(15.0), F.lit(37.0), F.col("lon"), F.col("lat"))
    return places(spark, d).select("member", m.alias("m")).where("m <= 3000000").select("member", F.round(F.col("m") / 1000, 6).alias("score"))


# functions


@query("fn_array_changes", f"""WITH {LISTS} SELECT conv_id, list_contains(a, 'assistant') AS has, array_to_string(list_reverse(a), ',') AS rev, array_to_string(list_append(a, 'end'), ',') AS pushed,
    array_to_string(list_concat(a[1:1], a[3:len(a)]), ',') AS removed FROM l""")  # fmt: skip
def fn_array_changes(spark, d):
    a, join = F.col("a"), lambda c: F.array_join(c, ",")
    removed = F.filter(a, lambda x, i: i != 1)
    return lists(spark, d).select("conv_id", F.array_contains(a, "assistant").alias("has"), join(F.reverse(a)).alias("rev"), join(F.array_append(a, F.lit("end"))).alias("pushed"), join(removed).alias("removed"))


@query("fn_literals", "SELECT n_nationkey, n_nationkey || ',1' AS arr, n_name AS row_name FROM nation")
def fn_literals(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", F.array("n_nationkey", F.lit(1)).alias("a"), F.struct(F.col("n_name").alias("name")).alias("r"))
    return n.select("n_nationkey", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("arr"), F.col("r.name").alias("row_name"))


@query("fn_sort_by", "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer")
def fn_sort_by(spark, d):
    order = [*O.descending(F.col("c_acctbal")), *O.nulls_last([F.col("c_custkey")])]
    return O.numbered(load(spark, d, "customer").select("c_custkey", "c_acctbal"), [], order, "n", ties=True).select("c_custkey", "n")


@query("fn_count_matching", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def fn_count_matching(spark, d):
    return load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").agg(F.count(F.lit(1)).alias("n"))


@query("fn_trims", "SELECT p_partkey, ltrim('  ' || p_name || ' ') AS l, rtrim(' ' || p_name || '  ') AS r, trim(' ' || p_name || ' ') AS b, substring(p_name, 2, 3) AS part FROM part")
def fn_trims(spark, d):
    n = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", F.ltrim(F.concat(F.lit("  "), n, F.lit(" "))).alias("l"), F.rtrim(F.concat(F.lit(" "), n, F.lit("  "))).alias("r"), F.trim(F.concat(F.lit(" "), n, F.lit(" "))).alias("b"), F.expr("substring(p_name FROM 2 FOR 3)").alias("part"))


@query("fn_whole_rounds", """SELECT c_custkey, CAST(coalesce(round(nullif(c_acctbal, 0)), 0) AS BIGINT) AS r, CAST(coalesce(floor(x), 0) AS BIGINT) AS f, CAST(coalesce(ceil(x), 0) AS BIGINT) AS c
    FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS x FROM customer)""")  # fmt: skip
def fn_whole_rounds(spark, d):
    x = F.when(F.col("c_nationkey") != 3, F.col("c_acctbal"))
    whole = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))  # noqa: E731  null counts as 0
    return load(spark, d, "customer").select("c_custkey", whole(F.round("c_acctbal")).alias("r"), whole(F.floor(x)).alias("f"), whole(F.ceil(x)).alias("c"))


@query("fn_parse_numbers", "SELECT p_partkey, coalesce(try_cast(substr(p_brand, 7) AS DOUBLE), 0) AS f, coalesce(try_cast(p_name AS DOUBLE), 0) AS none, CAST(p_size AS DOUBLE) AS to_float, CAST(p_size AS VARCHAR) AS to_str FROM part")
def fn_parse_numbers(spark, d):
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    return load(spark, d, "part").select("p_partkey", number(F.expr("substring(p_brand, 7)")).alias("f"), number(F.col("p_name")).alias("none"), F.col("p_size").cast("double").alias("to_float"), F.col("p_size").cast("string").alias("to_str"))


@query("fn_byte_index", "SELECT p_partkey, CAST(CASE WHEN strpos(p_name, 'e') > 0 THEN strpos(p_name, 'e') + 1 ELSE -1 END AS INT) AS at FROM part")
def fn_byte_index(spark, d):
    from tidemark.functions import builtins as B

    return load(spark, d, "part").select("p_partkey", B.index_of(F.concat(F.lit("é"), F.col("p_name")), F.lit("e")).cast("int").alias("at"))


@query("fn_clock_and_chance", "SELECT true AS later, true AS unit, true AS dice, true AS clock, true AS version FROM region LIMIT 1")
def fn_clock_and_chance(spark, d):
    r, die = F.rand(7), F.floor(F.rand(8) * 6).cast("int") + 1
    shaped = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    e = load(spark, d, "events").select((S.millis(F.col("ts")) < F.unix_millis(F.current_timestamp())).alias("later"), ((r >= 0) & (r < 1)).alias("unit"), die.between(1, 6).alias("dice"), shaped.alias("clock"), (F.length(F.version()) > 0).alias("version"))
    return e.agg(*(F.bool_and(c).alias(c) for c in e.columns))


# budgets and presence


@query("keyed_users_by_status", f"WITH {LOG}, l AS (SELECT key, arg_max(event_type, seq) AS status FROM log GROUP BY key) SELECT status, count(*) AS n, min(key) AS first FROM l GROUP BY status")
def keyed_users_by_status(spark, d):
    last = log(spark, d).groupBy("key").agg(F.max_by("event_type", "seq").alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@query("keyed_byte_cap", """WITH s AS (SELECT c_custkey, len(c_name) + 8 AS bytes, sum(len(c_name) + 8) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS upto, c_nationkey FROM customer)
    SELECT c_custkey FROM s WHERE upto <= 500""")  # fmt: skip
def keyed_byte_cap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = load(spark, d, "customer").withColumn("upto", F.sum(F.length("c_name") + 8).over(w))
    return c.where("upto <= 500").select("c_custkey")


@query("keyed_token_bucket", """WITH RECURSIVE e AS (SELECT event_type AS caller, epoch_us(ts) // 1000 AS ms, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
    b AS (SELECT caller, ms, id, r, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE r = 1
    UNION ALL SELECT caller, ms, id, r, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM
        (SELECT e.*, least(b.tokens + (e.ms - b.ms)::DOUBLE / 1000.0::DOUBLE * 2.0::DOUBLE, 2.0::DOUBLE) AS have FROM b JOIN e ON e.caller = b.caller AND e.r = b.r + 1))
    SELECT caller, ms, id, allowed FROM b""")  # fmt: skip
def keyed_token_bucket(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("caller"), S.millis(F.col("ts")).alias("ms"), F.col("event_id").alias("id"))
    return M.token_bucket(e, "caller", "ms", "id", 2.0)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
