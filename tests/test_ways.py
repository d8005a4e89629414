"""Several ways through one graph in one search, over one row an edge."""

import numpy as np

from loomgraph.operators import variables
from loomgraph.plans import frontier


def test_ways_in_one_search_against_loops(spark, monkeypatch):
    monkeypatch.setattr(frontier, "REST", 20)
    rng = np.random.default_rng(5)
    edges = [(f"n{a}", f"n{b}", int(m)) for a, b, m in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(0, 8, 90))] + [(f"n{k}", f"c{k}", 5) for k in range(3)]
    edges += [(f"c{k}", f"c{k + 1}", 7 if k % 9 else 3) for k in range(14)]
    df = spark.createDataFrame([("p", *e) for e in edges], "project_id string, source string, target string, open long")
    seeds = {"n0": 7, "n3": 2, "zz": 4}
    start = spark.createDataFrame([("p", k, v) for k, v in seeds.items()], "project_id string, node string, bits long")
    for shallow in (7, 2):  # with 2, what is left goes on way by way
        monkeypatch.setattr(frontier, "SHALLOW", shallow)
        got = {r.node: r.bits for r in frontier.reachable(df, start, ways=["x", "y", "z"]).collect()}
        for i in range(3):
            met = {k for k, v in seeds.items() if v >> i & 1}
            while more := {b for a, b, m in edges if a in met and m >> i & 1} - met:
                met |= more
            assert {k for k, v in got.items() if v >> i & 1} == met, (shallow, i)


def test_an_edge_is_one_row_for_all_scenarios(spark, monkeypatch):
    edges = [("p", f"a{k}", f"a{k + 1}", "hp > 1" if k == 5 else None) for k in range(10)]
    df = spark.createDataFrame(edges, "project_id string, source string, target string, expression string")
    given, search = [], variables.reachable
    monkeypatch.setattr(variables, "reachable", lambda e, *a, **b: (given.append(e.count()), search(e, *a, **b))[1])
    flags = spark.createDataFrame([(f"s{k}", "hp", str(k % 3)) for k in range(70)], "scenario_id string, flag string, value string")
    got = {(r.scenario_id, r.node) for r in variables.conditional_reachability(df, flags).collect()}
    assert got == {(f"s{k}", f"a{n}") for k in range(70) if k % 3 < 2 for n in range(6, 11)}
    assert given == [10, 10]  # 70 scenarios are two searches
