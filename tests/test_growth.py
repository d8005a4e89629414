"""What keeps figures from growing faster than the input: plans, written tables, and the same results."""

from pyspark.sql import functions as F

from loomgraph.operators import assets, link, routes, variables
from loomgraph.plans import adapters as ad
from loomgraph.plans import frontier
from tests.test_frontier import EDGES, _ladder, _tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_steps_take_few_tables(spark):
    df = spark.createDataFrame(_ladder(60), EDGES)
    before = _tables(spark)
    got = {r.node for r in frontier.reachable(df, spark.createDataFrame([("p", "a0")], "project_id string, node string")).collect()}
    assert got == {"a0"} | {f"{s}{i}" for i in range(1, 61) for s in "ab"}
    assert len(_tables(spark) - before) < 10


def test_rounds_and_the_last_step_agree(spark, monkeypatch):
    df = spark.createDataFrame(_ladder(30), EDGES)
    ends = spark.createDataFrame([("p", "a30"), ("p", "b12")], "project_id string, node string")
    want = {(f"{s}{i}", e) for i in range(31) for s in "ab" for e, at in (("a30", 30), ("b12", 12)) if i < at or f"{s}{i}" == e}
    monkeypatch.setattr(frontier, "REST", 60)
    got = [(r.node, r.ending) for r in frontier.reaches(df, ends).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_edges_of_some_orders_are_written_once(spark):
    n, e = ad.dag(spark, SF)
    assert "Window" not in _plan(e) and "Join" not in _plan(n)
    every = ad.edges(spark, SF).where((F.substring("target", 2, 20).cast("long") > F.substring("source", 2, 20).cast("long")) & (F.floor(F.col("edge_ord") / 1000) % 20 == 0))
    assert sorted(map(tuple, e.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)


def test_assets_are_not_broadcast(spark):
    index = assets.media_index(ad.media(spark, SF))
    assert "Broadcast" not in _plan(ad.cues(spark, SF)) and "Broadcast" not in _plan(assets.resolve(assets.split_playlists(ad.cues(spark, SF)), index))
    assert index._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1


def test_depth_of_calls_without_lists(spark):
    edges = [("p", "e1", "start", "a", "call"), ("p", "e2", "a", "b", "jump"), ("p", "e3", "b", "c", "call"), ("p", "e4", "c", "d", "call_return"), ("p", "e5", "d", "f", "call"), ("p", "e6", "f", "f", "call")]
    df = spark.createDataFrame(edges, "project_id string, id string, source string, target string, kind string")
    depth, over = link.call_depth(df, spark.createDataFrame([("p", "start")], "project_id string, node string"), 3, chains=False)
    assert {r.node: r.depth for r in depth.collect()} == {"start": 0, "a": 1, "b": 1, "c": 2, "d": 1, "f": 3}
    assert [(r.edge_id, r.frames, r.chain) for r in over.collect()] == [("e6", 4, None)]


def test_targets_of_a_jump_are_not_put_together(spark):
    labels = spark.createDataFrame([("p", x) for x in ("a_1", "a_2")], "project_id string, id string")
    jumps = spark.createDataFrame([("p", "n", 1, "f'a_{x}'"), ("p", "n", 2, "'a_1'")], "project_id string, source string, line_no int, expression string")
    found = link.resolve_dynamic(jumps, labels)
    assert "Window" not in _plan(found)
    assert sorted((r.line_no, r.target, r.how) for r in found.collect()) == [(1, "a_1", "pattern"), (1, "a_2", "pattern"), (2, "a_1", "literal")]


def test_scenarios_and_all_edges_are_one_search(spark, monkeypatch):
    edges = [("p", "a", "b", None), ("p", "b", "c", "disc > 0.05"), ("p", "x", "y", None), ("p", "y", "x", None), ("p", "y", "z", "disc > 0.05")]
    df = spark.createDataFrame(edges, "project_id string, source string, target string, expression string")
    flags = spark.createDataFrame([("low", "disc", "0.01"), ("high", "disc", "0.09")], "scenario_id string, flag string, value string")
    searches, search = [], variables.reachable
    monkeypatch.setattr(variables, "reachable", lambda *a, **b: (searches.append(1), search(*a, **b))[1])
    hidden = lambda df: {(r.scenario_id, r.node) for r in variables.conditional_reachability(df, flags).collect()}
    assert hidden(df.where("source in ('a', 'b')")) == {("low", "c")} and len(searches) == 1
    assert hidden(df) == {("low", "c"), ("low", "z")}


def test_routes_are_not_numbered_in_one_task(spark):
    nodes = spark.createDataFrame([("p", x, "LABEL", 1, 0.0) for x in "abcd"], "project_id string, id string, type string, word_count int, pause_duration double")
    rows = [("p", i, f"e{i}", a, b, "jump", None, False) for i, (a, b) in enumerate(("ab", "ac", "bd", "cd", "ad"))]
    edges = spark.createDataFrame(rows, "project_id string, edge_ord long, id string, source string, target string, kind string, label string, condition_is_statically_false boolean")
    at = lambda x: spark.createDataFrame([("p", x)], "project_id string, node string")
    every = routes.enumerate_routes(nodes, edges, at("a"), at("d"), max_routes=None, max_states=None)
    assert "__part" in _plan(every)
    assert sorted((r.route_ord, r.path, r.truncated) for r in every.collect()) == [(1, ["a", "d"], False), (2, ["a", "b", "d"], False), (3, ["a", "c", "d"], False)]
    two = routes.enumerate_routes(nodes, edges, at("a"), at("d"), max_routes=2)
    assert sorted((r.route_id, r.path, r.truncated) for r in two.collect()) == [("route_1", ["a", "d"], True), ("route_2", ["a", "b", "d"], True)]


def test_counted_nodes_and_edges_leave_the_tables(spark, monkeypatch):
    at = "project_id string, node string"
    edges = [("p", "a", "b"), ("p", "a", "b"), ("p", "b", "c"), ("p", "a", "c"), ("p", "c", "x"), ("p", "x", "y"), ("p", "y", "x"), ("p", "y", "z"), ("p", "u", "v"), ("p", "v", "u"), ("p", "v", "c2"), ("p", "a", "c2"), ("p", "c2", "d"), ("p", "w", "c2")]
    df = spark.createDataFrame([(*e, False) for e in edges], "project_id string, source string, target string, condition_is_statically_false boolean")
    counted, count = [], routes._counted
    monkeypatch.setattr(routes, "_counted", lambda *a: (counted.append(count(*a)), counted[-1])[1])
    got = {r.node: r.routes for r in routes.count_routes(df, spark.createDataFrame([("p", "a")], at)).collect()}
    # u and v are a cycle that no start leads to
    assert got == {"a": 1, "b": 2, "c": 3, "x": None, "y": None, "z": None, "c2": 1, "d": 1}
    assert {(r.source, r.target) for r in counted[0][2].collect()} == {("x", "y"), ("y", "x"), ("y", "z"), ("u", "v"), ("v", "u"), ("v", "c2"), ("c2", "d")}
    assert "Broadcast" not in _plan(counted[0][2])


def test_best_last_steps_carry_no_paths(spark):
    nodes = spark.createDataFrame([("p", x, "LABEL", 1, 0.0) for x in "abcd"], "project_id string, id string, type string, word_count int, pause_duration double")
    rows = [("p", i, f"e{i}", a, b, "jump", label, False) for i, (a, b, label) in enumerate([("a", "d", "x"), ("b", "d", None), ("c", "d", None), ("a", "b", None)])]
    steps = routes._steps(spark.createDataFrame(rows, "project_id string, edge_ord long, id string, source string, target string, kind string, label string, condition_is_statically_false boolean"), nodes, True)
    level = routes._start(nodes, spark.createDataFrame([("p", x) for x in "abc"], "project_id string, node string"))
    met = level.select("project_id", "at", "stack", F.size("choices").alias("choices"))
    best = routes._best_ahead(level, steps, met, "shortest")
    assert not {"path", "choices", "conditions", "taken", "order"} & set(best.columns)
    assert [(r.came["at"], r.to, r.edge_ord) for r in best.collect()] == [("b", "d", 1)]
