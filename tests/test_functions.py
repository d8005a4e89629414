"""Scalar functions and conditions, on literal cases."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import conditions as C
from loomgraph.functions import text as T

TEXTS = [
    ("Hello world foo", 3, 0.0), ("{b}Hello{/b} {i}world{/i}", 2, 0.0), ("Hello {w=2.5} world {w=1.0}", 2, 3.5), ("Hello {p=1.0} world", 2, 1.0),
    ("Hello {w} world", 2, 0.0), ("{p}Click to continue", 3, 0.0), ("", 0, 0.0), ("{w=1.0}{b}{/b}", 0, 1.0), ("She said {b}wait{/b}.{w=0.5} Then smiled.", 5, 0.5), (None, 0, 0.0),
]


def test_text_stats(spark):
    df = spark.createDataFrame(TEXTS, "text string, words int, pause double")
    got = df.select("words", "pause", T.word_count(F.col("text")).alias("w"), T.pause_seconds(F.col("text")).alias("p")).collect()
    assert all((r.words, r.pause) == (r.w, r.p) for r in got)


def test_times(spark):
    df = spark.createDataFrame([(0.0, "0s", "< 1m"), (45.0, "45s", "1m"), (90.0, "1m 30s", "2m"), (3661.0, "1h 1m", "1h 2m"), (3600.0, "1h", "1h")], "s double, a string, b string")
    assert all(r.a == r.x and r.b == r.y for r in df.select("a", "b", T.format_seconds(F.col("s")).alias("x"), T.format_minutes(F.col("s")).alias("y")).collect())
    r = spark.range(1).select(T.reading_seconds(F.lit(200), F.lit(5.0)).alias("a"), T.reading_seconds(F.lit(0), F.lit(0.0)).alias("b")).first()
    assert (r.a, r.b) == (65.0, 0.0)


def test_endings_and_cells(spark):
    rows = [("good_ending", "good"), ("bad_end", "bad"), ("true_hero_ending", "true"), ("game_over_scene", "dead_end"), ("normal_ending", "normal")]
    df = spark.createDataFrame(rows, "label string, kind string")
    assert all(r.kind == r.got for r in df.select("kind", T.ending_type(F.col("label"), F.array().cast("array<string>"), F.lit(9)).alias("got")).collect())
    cells = [("=1+1", "\"'=1+1\""), ("-123", "\"'-123\""), ("@SUM(A1:A10)", "\"'@SUM(A1:A10)\""), ('Hello "World"', '"Hello ""World"""'), (None, ""), ("plain", "plain")]
    df = spark.createDataFrame(cells, "v string, cell string")
    assert all(r.cell == r.got for r in df.select("cell", T.csv_cell(F.col("v")).alias("got")).collect())


def test_refs_and_literals(spark):
    df = spark.createDataFrame([("flag_a and flag_b or flag_c", "flag_a,flag_b,flag_c"), ("flag_a is not None", "flag_a"), ("a.b.c > 1", "a,a.b,a.b.c"), ("", ""), (None, "")], "e string, refs string")
    assert all(r.refs == r.got for r in df.select("refs", F.array_join(T.condition_refs(F.col("e")), ",").alias("got")).collect())
    df = spark.createDataFrame([('"a\\"b"', 'a"b'), ("r'x\\n'", "x\\n"), ("'''tri'''", "tri"), ("name", None)], "e string, v string")
    assert all(r.v == r.got for r in df.select("v", T.extract_literal(F.col("e")).alias("got")).collect())


@pytest.mark.parametrize(
    ("expression", "flags", "result"),
    [
        ("flag_a + 1", {"flag_a": "true"}, None), ("flag_a and not flag_b", {"flag_a": "true", "flag_b": "false"}, True), ("flag_a == False", {"flag_a": "false"}, True),
        ("flag_a is None", {"flag_a": "false"}, True), ("flag_a is null", {"flag_a": "false"}, True), ("flag_a is not True", {"flag_a": "false"}, True), ("flag_a is not None", {"flag_a": "true"}, True),
        ("a or b", {"a": "true", "b": "unknown"}, True), ("a and b", {"a": "unknown", "b": "false"}, False), ("a or b", {"a": "unknown"}, None), ("1 < x <= 10", {"x": "10"}, True),
        ("x == 16.0", {"x": "16"}, True), ("", {}, None), ("((", {}, None), ("x in [1]", {"x": "1"}, None), ("not x", {"x": "unknown"}, None),
    ],
)
def test_conditions(expression, flags, result):
    assert C.evaluate(expression, flags) is result


def test_fold():
    assert C.fold("'a' + 'b'", {}) == (True, "ab", ["ab"])
    assert C.fold("x['k'][1]", {"x": {"k": [1, 2]}})[:2] == (True, 2)
    assert C.fold("'a' if y else 'b'", {}) == (False, None, ["a", "b"])
    assert C.always("1 == 1") is True and C.always("False") is False and C.always("x") is None and C.always(" ") is True
