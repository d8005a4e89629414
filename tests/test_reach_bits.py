"""Endings that travel as bits up to where choices are given on."""

import re

from pyspark.sql import functions as F

from loomgraph.operators import analytics
from loomgraph.plans import frontier

EDGES = "project_id string, edge_ord long, id string, source string, target string, kind string, label string, condition_is_statically_false boolean"


def _fan(spark, n):
    """A menu ``top`` of 700 endings, over two menus that have a part of them each, and over one that has all."""
    ways = [("top", "left"), ("top", "right"), ("top", "all"), ("left", "end0")] + [("all", x) for x in ("left", "right")]
    ways += [("left" if i < n // 2 else "right", f"end{i}") for i in range(n)]
    rows = [("p", i, f"e{i}", a, b, "jump", None, False) for i, (a, b) in enumerate(ways)] + [("p", 9000, "e1", "top", "left", "jump", None, False)]
    e = spark.createDataFrame(rows, EDGES)
    names = sorted({x for w in ways for x in w})
    return e, spark.createDataFrame([("p", x, "MENU") for x in names], "project_id string, id string, type string")


def test_choices_get_names_where_they_are_given_on(spark):
    n = 700
    e, nodes = _fan(spark, n)
    ends = spark.createDataFrame([("p", f"end{i}") for i in range(n)], "project_id string, node string")
    points = analytics.points_of_no_return(e, nodes, frontier.reach_bits(e, ends))
    plan = points._jdf.queryExecution().executedPlan().toString()
    # lists of names are in the rows of endings alone when rows are dealt
    assert "Window" not in plan and "MapInArrow" in plan and not re.search(r"array_except|collect_set", plan)
    got = {r.edge_id: r for r in points.collect()}
    old = {r.edge_id: r for r in analytics.points_of_no_return(e, nodes, frontier.reaches(e, ends)).collect()}
    assert got == old and len(got) == 2 + 2 + 1 + n  # all but the way to the menu that has all
    assert got["e0"].source == "top" and got["e0"].eliminated == sorted(f"end{i}" for i in range(n // 2, n)) and not got["e0"].is_lock_in
    assert got["e3"].remaining == ["end0"] and got["e3"].is_lock_in


def test_endings_share_rows_of_several_numbers(spark):
    n = 700
    e, _ = _fan(spark, n)
    ends = spark.createDataFrame([("p", f"end{i}") for i in range(n)], "project_id string, node string")
    found, places = frontier.reach_bits(e, ends)
    assert found.where("node = 'top'").count() == 2 and places.agg(F.countDistinct("block", "word", "bit")).first()[0] == n
    assert sum(len(r.endings) for r in frontier.reach_parts(e, ends).where("node = 'top'").collect()) == n


def test_endings_of_one_block_are_put_in_no_order_and_rows_are_dealt(spark, monkeypatch):
    e, _ = _fan(spark, 200)
    parts = []
    monkeypatch.setattr(frontier, "weak_components", lambda *a: parts.append(a))
    ends = spark.createDataFrame([("p", f"end{i}") for i in range(200)], "project_id string, node string")
    pairs = frontier.reaches(e, ends)
    assert not parts and "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    # top and all have all, left and right a part each (end0 is in left's already), endings have themselves
    assert pairs.count() == pairs.distinct().count() == 2 * 200 + 200 + 200
