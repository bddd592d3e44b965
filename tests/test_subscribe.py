import pytest

from tidemark.plans import subscribe as U


@pytest.mark.parametrize(
    ("text", "where"),
    [
        ("players", []),
        ("SUBSCRIBE players WHERE a = 1", [[("a", "=", 1)]]),
        ("players WHERE a == 'it''s' AND b <> 2.5", [[("a", "=", "it's"), ("b", "!=", 2.5)]]),
        ("players WHERE a > 1 AND b < 2 OR c IN (x, 'y z', 3)", [[("a", ">", 1), ("b", "<", 2)], [("c", "IN", ["x", "y z", 3])]]),
        ("players WHERE on = true OR z = null", [[("on", "=", True)], [("z", "=", None)]]),
    ],
)
def test_parse(text, where):
    assert U.parse(text).where == where


def test_parse_order_and_limit():
    s = U.parse("subscribe t where a=1 order by score desc limit 5")
    assert (s.table, s.order_by, s.descending, s.limit) == ("t", "score", True, 5)


@pytest.mark.parametrize("text", ["", "t WHERE", "t WHERE a", "t WHERE a = ", "t WHERE a IN (1", "t LIMIT", "t ORDER score", "t nonsense", "t WHERE (a = 1)"])
def test_errors(text):
    with pytest.raises(ValueError):
        U.parse(text)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 10, True), ("b", None, False), ("c", 30, None), ("d", 20, True)], "row_key string, score int, alive boolean")


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("t WHERE score > 10", "cd"), ("t WHERE score = '10'", ""), ("t WHERE score != 10", "cd"), ("t WHERE alive = true", "ad"), ("t WHERE alive > 0", ""), ("t WHERE row_key IN (a, b)", "ab"),
        ("t WHERE row_key > a", ""), ("t WHERE none = 1", ""), ("t WHERE score = null", "b"), ("t WHERE score >= 20 AND alive = true OR row_key = b", "bd"),
    ],
)
def test_predicate(rows, text, keys):
    assert sorted(r.row_key for r in U.snapshot(U.parse(text), rows).collect()) == list(keys)


def test_order_puts_missing_last_both_ways(rows):
    assert [r.row_key for r in U.snapshot(U.parse("t ORDER BY score"), rows).collect()] == ["a", "d", "c", "b"]
    assert [r.row_key for r in U.snapshot(U.parse("t ORDER BY score DESC LIMIT 4"), rows).collect()] == ["c", "d", "a", "b"]
