import bisect

import pytest
from pyspark.sql import functions as F

from tidemark.functions import builtins as B
from tidemark.functions import geo, hashing
from tidemark.functions import semantics as S
from tidemark.sources.tables import glob_regex


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "foobar", "żółw", "x" * 50])
def test_fnv1a(spark, text):
    assert hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert int(one(spark, hashing.fnv1a_col(F.lit(text)))) == hashing.fnv1a(text.encode())


def test_ring_owner_is_the_first_node_at_or_above(spark):
    members = ["east", "west", "north"]
    ring = hashing.ring(members)
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"))
    got = {r["key"]: r["owner"] for r in hashing.owners(df, "key", members).collect()}
    tree = {r["key"]: r["o"] for r in df.select("key", hashing.owner_col(hashing.fnv1a_col(F.col("key")), members).alias("o")).collect()}
    for key in got:
        i = bisect.bisect_left([h for h, _ in ring], hashing.fnv1a(key.encode()))
        assert got[key] == tree[key] == ring[i % len(ring)][1]
    assert len(got) == 200


def test_geo_known_places(spark):
    palermo, catania = (F.lit(13.361389), F.lit(38.115556)), (F.lit(15.087269), F.lit(37.502669))
    assert one(spark, geo.geohash(*palermo)) == "sqc8b49rny0"
    assert one(spark, geo.geohash(*catania)) == "sqdtr74hyu0"
    assert abs(one(spark, geo.haversine(*palermo, *catania)) - 166274.2578) < 0.001
    assert one(spark, geo.score(*palermo)) == 3479099956230698
    assert one(spark, geo.to_unit(geo.haversine(*geo.cell_centre(*palermo), *geo.cell_centre(*catania)), "km")) == 166.2742


@pytest.mark.parametrize(("pattern", "yes", "no"), [("a*c", "abbc", "abbd"), ("a?c", "abc", "ac"), ("[a-c]x", "bx", "dx"), ("[^a]x", "bx", "ax"), (r"a\*", "a*", "ab"), ("h.llo", "h.llo", "hello"), ("*\n*", "a\nb", "ab")])
def test_glob(pattern, yes, no):
    import re

    assert re.search(glob_regex(pattern), yes) and not re.search(glob_regex(pattern), no)


def test_dialect_helpers(spark):
    null = F.lit(None).cast("int")
    assert one(spark, S.eq_ns(null, null)) is True
    assert one(spark, S.ne_ns(null, F.lit(1))) is True
    assert one(spark, S.not2(null == 1)) is True
    assert one(spark, S.in_kv(null, [1, None])) is True and one(spark, S.in2(null, [1, None])) is False
    assert one(spark, S.between_kv(F.lit(5), F.lit(1), null)) is True and one(spark, S.between_kv(null, F.lit(1), F.lit(9))) is False
    assert one(spark, S.div_kv(F.lit(1), F.lit(0))) is None and one(spark, S.div_kv(F.lit(7), F.lit(2))) == 3.5
    assert one(spark, S.mod_kv(F.lit(-7.9), F.lit(3))) == -1 and one(spark, S.mod_kv(F.lit(1), F.lit(0))) is None
    assert one(spark, S.concat_kv(F.lit("a"), null, F.lit(1))) == "a1"
    assert one(spark, S.trim_kv(F.lit("\t x  \n"))) == "x"
    assert one(spark, S.substr_kv(F.lit("hello"), -2, 3)) == "hel" and one(spark, S.substr_kv(F.lit("hello"), 2, -1)) == ""
    assert one(spark, S.cast_kv(F.lit("x"), "int")) is None and one(spark, S.cast_kv(F.lit("false"), "bool")) is True
    assert one(spark, S.bool_pg(F.lit("ON"))) is True and one(spark, S.bool_pg(F.lit("maybe"))) is False
    assert one(spark, S.like_escaped(F.lit(r"a\b"), r"a\b")) is True
    assert one(spark, S.finite(F.lit(float("inf")))) is None


def test_rule_builtins(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, B.array_slice(a, 1, 9)) == [2, 3] and one(spark, B.array_slice(a, 5, 9)) == []
    assert one(spark, B.array_remove_at(a, 1)) == [1, 3] and one(spark, B.array_pop(a)) == [1, 2]
    assert one(spark, B.index_of(F.lit("żab"), F.lit("b"))) == 3 and one(spark, B.index_of(F.lit("ab"), F.lit("z"))) == -1
    assert one(spark, B.split_literal(F.lit("a.b.c"), ".")) == ["a", "b", "c"]
    assert one(spark, B.to_bool(F.lit(0.5))) is False and one(spark, B.parse_int(F.lit("7x"))) == 0
    empty = spark.range(0).select(F.lit(1.0).alias("v"))
    r = empty.agg(B.sum_field("v").alias("s"), B.avg_field("v").alias("a"), B.min_field("v").alias("lo"), B.max_field("v").alias("hi")).first()
    assert (r.s, r.a, r.lo, r.hi) == (0.0, 0.0, B.MAX_DOUBLE, -B.MAX_DOUBLE)
