import pytest

from lakeweft.engine import Compat, Engine
from lakeweft.functions.registry import java_pattern
from lakeweft.plans.dialect import DialectError, to_spark, tokens


def one(spark, text, dialect="mysql", **compat):
    return Engine(spark, None, dialect, Compat(**compat)).sql(text).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 'it''s'", "it's"), (r"SELECT 'a\'b'", "a'b"), (r"SELECT 'tab\tx'", "tab\tx"), ('SELECT "double"', "double"), ("SELECT 1 # c\n + 2", 3), ("SELECT /* no */ 4 -- end", 4),
        ("SELECT 'Abc' LIKE 'a%'", True), (r"SELECT 'a\\b' LIKE 'a\\b'", True), ("SELECT 'abc' NOT LIKE '_b_'", False), ("SELECT 5 % 0", None), ("SELECT 5 / 0", None), ("SELECT CAST('12abc' AS UNSIGNED)", None),
        ("SELECT SQRT(-1)", None), ("SELECT ROUND(2.5)", 3), ("SELECT ROUND(-2.5)", -3), ("SELECT IF(NULL, 1, 2)", 2), ("SELECT ISNULL(NULL)", 1), ("SELECT 1 = 1 && 1 = 0 || 2 = 2", True), ("SELECT 1 IN (2, NULL)", None),
        ("SELECT TIMESTAMPDIFF(MONTH, '2024-01-31', '2024-03-01')", 1), ("SELECT DATE_FORMAT('2024-02-03 04:05:06', '%Y|%y|%m|%d|%T|%%|%q')", "2024|24|02|03|04:05:06|%|%q"), ("SELECT CAST(STR_TO_DATE('nope', '%Y-%m-%d') AS CHAR)", None),
        ("SELECT YEARWEEK('2024-05-06')", 202419), ("SELECT SUBSTR('abcdef', 0, 2)", "ab"), ("SELECT GREATEST(1, 3, 2)", 3), ("SELECT TRUNCATE(-3.789, 1)", -3.7), ("SELECT STRCMP('a', 'b')", -1), ("SELECT SOUNDEX('Robert')", "R163"),
    ],
)
def test_mysql_values(spark, text, want):
    got = one(spark, text)
    assert (float(got) == want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(("text", "want"), [("SELECT 'a' || 'b'", "ab"), ("SELECT '7'::int + 1", 8), ("SELECT 'Abc' LIKE 'a%'", False), ("SELECT 'Abc' ILIKE 'a%'", True), ("SELECT 'abc' ~ 'b'", True), (r"SELECT 'a\nb'", r"a\nb"), ("SELECT (1 + 1)::text || 'x'", "2x")])
def test_psql_values(spark, text, want):
    assert one(spark, text, "psql") == want


def test_window_order_switch():
    q = "SELECT SUM(x) OVER (PARTITION BY g ORDER BY y), ROW_NUMBER() OVER (ORDER BY y) FROM t"
    assert to_spark(q, window_order_ignored=True).count("ORDER BY") == 1
    assert to_spark(q).count("ORDER BY") == 2


def test_statements_inside_strings_are_left_alone():
    assert "'LIMIT 1, 2 LIKE ~'" in to_spark("SELECT 'LIMIT 1, 2 LIKE ~' FROM t LIMIT 3, 4")


@pytest.mark.parametrize("bad", ["SELECT (1", "SELECT \x01", "SELECT CAST(1 AS WIDGET)", "SELECT DATE_ADD(x, INTERVAL 1 EON)"])
def test_bad_text(bad):
    with pytest.raises(DialectError):
        to_spark(bad)


def test_tokens_keep_backticks():
    assert [t.kind for t in tokens("`a b`.c")] == ["qid", "op", "name"]


def test_format_letters_are_quoted():
    assert java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


def test_show_describe_explain(spark):
    e = Engine(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in e.sql("SHOW TABLES").collect()} >= {"orders", "nation"}
    assert [r[0] for r in e.sql("DESCRIBE nation").collect()] == ["n_name", "n_nationkey", "n_regionkey"]
    assert "Scan parquet" in e.sql("EXPLAIN SELECT * FROM nation WHERE n_nationkey = 3").first()[0]
    e.sql("SET @a = 4")
    assert e.sql("SELECT @a + 1").first()[0] == 5
    with pytest.raises(ValueError):
        e.sql("CREATE VIEW nation AS SELECT 1")


def test_filters_and_columns_reach_the_scan(spark):
    plan = Engine(spark, "/root/testdata/sf0.001").sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_orderkey = 7 AND o_totalprice > 5").first()[0]
    assert "PushedFilters: [IsNotNull(o_orderkey), IsNotNull(o_totalprice), EqualTo(o_orderkey,7)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
