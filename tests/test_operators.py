import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import changes as D
from tidemark.operators import collections as C
from tidemark.operators import commands as Q
from tidemark.operators import keyed as K
from tidemark.operators import ordered as O
from tidemark.operators import ranking as R
from tidemark.operators import schema as M
from tidemark.operators import spatial as X
from tidemark.plans import command_queries, keyed_queries, reducers
from tidemark.sources import tables as T


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    data = [(1, 10, "a", "upsert", 1), (2, 20, "b", "upsert", 2), (3, 30, "a", "upsert", 3), (4, 40, "b", "delete", 0), (5, 50, "c", "upsert", 5)]
    return spark.createDataFrame(data, "seq long, ts long, key string, op string, v int")


def test_state_as_of_and_replay(log):
    assert rows(K.current(log), "key", "v") == [("a", 3), ("c", 5)]
    assert rows(K.as_of(log, 2), "key", "v") == [("a", 1), ("b", 2)]
    twice = log.union(log.where("seq = 3"))
    assert rows(K.replay(K.as_of(log, 2), twice, 2), "key", "v") == [("a", 3), ("c", 5)]
    assert rows(K.replay(K.as_of(log, 2), twice, 2, until=30), "key", "v") == [("a", 3), ("b", 2)]
    assert rows(K.collect_garbage(log, 3), "seq") == [(2,), (3,), (4,), (5,)]
    assert rows(K.gaps(log.where("seq <> 3"), "seq", per=2), "after", "before") == [(2, 4)]


def test_conflicts(spark, log):
    w = spark.createDataFrame([("a", 2), ("c", 5)], "key string, read_seq long")
    assert rows(K.conflicts(log, w), "key", "head_seq") == [("a", 3)]


def test_expiry_and_presence(spark):
    t = spark.createDataFrame([(1, None), (2, 1000), (3, 2500)], "id int, e long")
    assert [r.x for r in t.orderBy("id").select(K.ttl_seconds(F.col("e"), F.lit(1000)).alias("x")).collect()] == [-1, -2, 2]
    gt, lt = (K.expire_if(F.col("e"), F.lit(2000), m) for m in ("GT", "LT"))
    assert [tuple(r) for r in t.orderBy("id").select(gt, lt).collect()] == [(None, 2000), (2000, 1000), (2500, 2000)]
    beats = spark.createDataFrame([(1, 100), (1, 900), (2, 500), (3, 10)], "user_id int, ts long")
    assert rows(K.presence(beats, F.lit(1000), 300, 900), "user_id", "status") == [(1, "Online"), (2, "Idle")]


def test_board(spark):
    b = spark.createDataFrame([(f"p{i}", float(i), i * 1000) for i in range(1, 21)], "player string, score double, ts long")
    r = R.ranks(R.best_entries(b))
    near = R.around(r, "p10", 2)
    assert rows(near, "rank") == [(9,), (10,), (11,), (12,), (13,)]
    assert rows(R.rank_range(r, 1, 2), "player") == [("p19",), ("p20",)]
    p = {x.player: x.p for x in r.select("player", R.percentile(F.col("rank"), F.col("total")).alias("p")).collect()}
    assert p["p20"] == 100.0 and p["p1"] == 0.0
    with pytest.raises(ValueError):
        R.rank_range(r, 0, 2)


def test_board_ties_and_best(spark):
    b = spark.createDataFrame([("late", 100.0, 5000), ("early", 100.0, 1000), ("late", 50.0, 1), ("early", 100.0, 9000)], "player string, score double, ts long")
    e = R.best_entries(b)
    assert rows(e, "player", "score", "ts") == [("early", 100.0, 1000), ("late", 100.0, 5000)]
    assert [r.player for r in R.top(e, 2).orderBy("rank").collect()] == ["early", "late"]


def test_weekly_bucket_turns_on_sunday(spark):
    ms = [3 * 86_400_000 - 1, 3 * 86_400_000]  # Saturday's last, Sunday's first millisecond
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ms], "ms long").select(R.bucket(F.col("ms"), "weekly")).collect()]
    assert got == [0, 1]


def test_zsets(spark):
    z = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "member string, score double")
    y = spark.createDataFrame([("b", 10.0), ("d", 4.0)], "member string, score double")
    assert rows(C.zunion([z, y], [1.0, 0.5]), "member", "score") == [("a", 1.0), ("b", 7.0), ("c", 3.0), ("d", 2.0)]
    assert rows(C.zinter([z, y], how="max"), "member", "score") == [("b", 10.0)]
    assert rows(C.zdiff([z, y]), "member") == [("a",), ("c",)]
    assert rows(C.zrange_by_score(z, "(1", "+inf"), "member") == [("b",), ("c",)]
    k = z.withColumn("key", F.lit("k"))
    assert rows(C.zrange(k, -2, -1, ["key"]), "member") == [("b",), ("c",)]
    assert rows(C.zpop(z, 1, largest=True), "member") == [("c",)]


def test_lists_and_bits(spark):
    a = F.split(F.lit("x,y,x,z,x"), ",")
    got = spark.range(1).select(
        C.lrange(a, -2, 10), C.lindex(a, -1), C.lindex(a, 9), C.lset(a, 1, F.lit("Y")), C.lrem(a, -1, F.lit("x")), C.lrem(a, 2, F.lit("x")), C.linsert(a, F.lit("z"), F.lit("n")),
        C.linsert(a, F.lit("z"), F.lit("n"), before=False), C.lpos(a, F.lit("x"), 2), C.lpos(a, F.lit("x"), -1), C.lpos(a, F.lit("q")), C.lrange(a, 4, 2), C.bit_count(F.lit(b"foobar")), C.get_bit(F.lit(b"\x80"), 0), C.get_bit(F.lit(b"a"), 99),
    ).first()
    assert list(got) == [["z", "x"], "x", None, ["x", "Y", "x", "z", "x"], ["x", "y", "x", "z"], ["y", "z", "x"], ["x", "y", "x", "n", "z", "x"], ["x", "y", "x", "z", "n", "x"], 2, 4, None, [], 26, 1, 0]


@pytest.mark.parametrize("per", [5, 40, 100_000])
def test_positions_by_ranges_are_those_of_one_window(spark, per):
    hot = [("hot", float(i % 3), i // 3 if i % 7 else None, i) for i in range(120)]
    df = spark.createDataFrame([*hot, ("cold", 1.0, 1, 500), (None, None, 2, 501), (None, 2.0, 2, 502)], "part string, score double, member int, id long")
    order = [F.col("score"), F.col("member"), F.col("id")]
    got = O.numbered(df, ["part"], order, "r", "t", per)
    w = Window.partitionBy("part")
    want = df.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("t", F.count(F.lit(1)).over(w))
    assert rows(got, "id", "r", "t") == rows(want, "id", "r", "t")
    entries = df.where("id < 500").select(F.col("id").cast("string").alias("player"), "score", F.lit(5).alias("ts"))
    best = sorted(entries.collect(), key=lambda x: (-x.score, x.player))
    assert [x.player for x in R.ranks(entries, per=per).orderBy("rank").collect()] == [x.player for x in best]
    z = df.where("id < 500").select("part", "score", F.col("id").alias("member"))
    down = sorted(z.collect(), key=lambda x: (-x.score, -x.member))
    assert [x.member for x in C.zrank(z, ["part"], reverse=True, per=per).orderBy("rank").collect()] == [x.member for x in down]


@pytest.mark.parametrize("per", [7, 100_000])
def test_serial_keys_over_many_ranges(spark, monkeypatch, per):
    monkeypatch.setattr(O, "PER_RANGE", per)
    data = [(i * 37 % 101 if i != 50 else None, f"name {i}") for i in range(101)]
    want = sorted((n for _, n in data), key=dict((n, (k is None, k or 0)) for k, n in data).get)
    table = spark.createDataFrame([(4,)], "id long")
    got = D.with_serial(spark.createDataFrame(data, "k long, name string"), table, "id", [F.col("k")])
    assert rows(got, "id", "name") == [(5 + i, n) for i, n in enumerate(want)]
    # no row's range may hang on how a shuffle was cut
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("per", [7, 100_000])
def test_sorted_customers_over_many_ranges(spark, monkeypatch, tmp_path, per):
    """Ties, nulls and NaN as in the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(O, "PER_RANGE", per)
    odd = [(200, None), (None, None), (None, 3.0), (None, 3.0), (201, float("nan")), (202, float("inf")), (203, -0.0), (204, 0.0), (5, 5.0), (5, 5.0)]
    df = spark.createDataFrame([(i, float(i * 37 % 23)) for i in range(100)] + odd, "c_custkey long, c_acctbal double")
    df.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    customer = duckdb.sql(f"FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")  # noqa: F841  read by the SQL
    want = duckdb.sql(command_queries.oracle_sql()["fn_sort_by"]).fetchall()
    got = command_queries.queries()["fn_sort_by"](spark, str(tmp_path)).select("c_custkey", "n").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("per", [4, 100_000])
def test_stream_gate_over_many_ranges(spark, per):
    data = [("hot" if i % 5 else "cold", (i * 37) % 101 + i // 2, i % 3, i) for i in range(90)]
    want, last = [], {}
    for k, ms, seq, at in data:
        if (ms, seq) > last.get(k, (-1, -1)):
            want.append((at,))
            last[k] = (ms, seq)
    s = spark.createDataFrame(data, "key string, ms long, seq long, arrival long")
    assert rows(C.stream_gate(s, "arrival", "key", per), "arrival") == want


@pytest.mark.parametrize("per", [5, 100_000])
def test_token_bucket(spark, per):
    """Bursts, pauses about a second long and times that are null, against plain Python; and a burst of 60 000 requests."""
    gaps = [0, 1, 499, 500, 999, 1000, 1001, 250, 333, 0, 0, 4000, -1]
    data, ms = [], -3000
    for i in range(400):
        ms += max(gaps[i * i % 13], 0)
        data.append(("ab"[i * 7 % 3 // 2], ms, i))
    data += [("a", None, 1000), ("b", None, None), ("a", 5, None)] + [("busy", i // 2, 2000 + i) for i in range(60_000)]
    want, state = [], {}
    for k, t, o in sorted(data, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] is None, r[2] or 0)):
        tokens, before = state.get(k, (2.0, t))
        have = 2.0 if t is None or k not in state else min(tokens + (t - before) / 1000.0 * 2.0, 2.0)
        state[k] = (have - 1 if have >= 1 else have, t)
        want.append((k, t, o, have >= 1))
    s = spark.createDataFrame(data, "k string, t long, o long")
    got = [tuple(r) for r in Q.token_bucket(s, "k", "t", "o", 2.0, per).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stream_gate(spark):
    s = spark.createDataFrame([("k", 1, 0, 1), ("k", 1, 0, 2), ("k", 2, 5, 3), ("k", 2, 4, 4), ("j", 1, 0, 5)], "key string, ms long, seq long, arrival long")
    assert rows(C.stream_gate(s, "arrival", "key"), "arrival") == [(1,), (3,), (5,)]
    assert rows(C.stream_range(s, (1, 0), (2, 4)), "arrival") == [(1,), (2,), (4,), (5,)]


def test_grid(spark):
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, 20.0, 20.0), (3, 500.0, 500.0), (4, -5.0, 10.0)], "id int, x double, y double")
    assert rows(X.within(p, 15.0, 15.0, 20.0), "id") == [(1,), (2,)]
    assert rows(X.visible(p, 15.0), "id", "other") == [(1, 2), (1, 4), (2, 1), (4, 1)]
    moved = spark.createDataFrame([(1, 10.0, 10.0005), (2, 25.0, 20.0), (5, 0.0, 0.0)], "id int, x double, y double")
    assert rows(X.position_deltas(p, moved), "id", "op") == [(2, "update"), (3, "delete"), (4, "delete"), (5, "insert")]


ODD_POINTS = [(i, float(i % 5 * 40), 0.0) for i in range(60)] + [(70, 8.0, 3.0), (70, 8.0, 3.0), (71, -4.0, -0.0), (71, 41.0, 2.0), (None, 0.0, 0.0), (72, None, 0.0), (73, float("nan"), 0.0)]


def seen_by(points, view):
    """(id, other) of plain Python, once for each pair of rows."""
    return sorted((a, b) for a, ax, ay in points for b, bx, by in points if None not in (a, b, ax, bx) and a != b and (ax - bx) ** 2 + (ay - by) ** 2 <= view * view)


@pytest.mark.parametrize("per", [1, 5, 500])
def test_crowds_see_what_their_members_see(spark, per):
    points = lambda data: spark.createDataFrame(data, "id int, x double, y double")
    assert rows(X.visible(points(ODD_POINTS), 9.0, per), "id", "other") == seen_by(ODD_POINTS, 9.0)
    later = [(i, x if x is None or i is None or i % 7 else x + 35.0, y) for i, x, y in ODD_POINTS if i != 10] + [(90, 0.0, 0.0)]
    was, now = set(seen_by(ODD_POINTS, 9.0)), set(seen_by(later, 9.0))
    want = sorted([(*p, "Enter") for p in now - was] + [(*p, "Exit") for p in was - now])
    assert want and rows(X.visibility_changes(points(ODD_POINTS), points(later), 9.0, per), "id", "other", "event") == want


@pytest.mark.parametrize("name", ["geo_radius_join", "geo_enter_exit"])
def test_places_are_joined_and_not_their_crowds(spark, monkeypatch, tmp_path, name):
    """5000 customers stand at ten places far apart: 2.5 million pairs, of which the join may form those of places only."""
    spark.range(0, 500_000, 100).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    joined, join = [], X.radius_join
    monkeypatch.setattr(X, "radius_join", lambda *a: joined.append(join(*a)) or joined[-1])
    keyed_queries.queries()[name](spark, str(tmp_path))
    assert joined and sum(df.count() for df in joined) <= 1000


def test_schema(spark):
    df = spark.createDataFrame([("1", None, "x"), ("two", 5, "y"), (None, 1, "z")], "id string, score int, extra string")
    good, bad = M.validate(df, [M.Field("id", "i64", required=True), M.Field("score", "i64", default=0), M.Field("hp", "f64")])
    assert rows(good, "id", "score", "extra") == [(1, 0, "x")] and good.columns == ["extra", "id", "score", "hp"]
    assert rows(bad, "reason") == [("id is no i64",), ("id is required",)]
    assert M.rename_field(df, "score", "extra").columns == ["id", "extra"]
    assert M.add_field(df, "score", 9).columns == df.columns
    assert rows(df.where(M.row_policy("owner_field", "x", "player", "extra")), "extra") == [("x",)]
    assert df.where(M.row_policy("role_gated", "x", "player", roles=("admin",))).count() == 0


def test_seed_rows(spark):
    df = spark.createDataFrame([('["t","k",{"a":1}]',), ('["t","",{}]',), ('["","k",{}]',), ('["t","k",5]',), ("junk",)], "row string")
    good, bad = T.seed_rows(spark, df)
    assert rows(good, "table_name", "row_key", "data") == [("t", "k", '{"a":1}')]
    assert bad.count() == 4


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([(1,)], "x int")
    assert T.read_latest_snapshot(spark, root, df.schema)[1] is None
    T.write_snapshot(df, root, 5)
    T.write_snapshot(df.union(df), root, 12)
    got, seq = T.read_latest_snapshot(spark, root, df.schema)
    assert seq == 12 and got.count() == 2
    assert T.load_or_empty(spark, str(tmp_path), "none", df.schema).count() == 0


def test_reducers(spark):
    @reducers.reducer("double_it")
    def double(df, by=2):
        return df.withColumn("x", F.col("x") * by)

    assert reducers.call("double_it", spark.createDataFrame([(2,)], "x int"), by=3).first().x == 6
    with pytest.raises(KeyError):
        reducers.call("missing")
    with pytest.raises(ValueError):
        reducers.reducer("double_it")(double)
