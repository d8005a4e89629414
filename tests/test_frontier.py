"""Searches over deep chains, cycles and islands, against plain loops; numbering without one task."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import link, variables
from loomgraph.plans.frontier import reachable, reaches, weak_components
from loomgraph.plans.lineage import numbered

EDGES = "project_id string, source string, target string"


def _reach(edges, seeds):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    met, todo = set(seeds), list(seeds)
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in met:
                met.add(b)
                todo.append(b)
    return met


def test_reachable_against_a_loop(spark):
    rng = np.random.default_rng(1)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(300)] + [("a299", "a0"), ("a120", "c0"), ("x", "a200")]
    edges += [(f"c{i}", f"c{(i + 1) % 50}") for i in range(50)] + [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 60, (70, 2))] + [("a7", "a7"), ("c9", "r3")]
    df = spark.createDataFrame([("p", *e) for e in edges], EDGES)
    for seeds in (["a0"], ["a150", "zz"], ["c30"], ["r1", "x"]):
        s = spark.createDataFrame([("p", x) for x in seeds], "project_id string, node string")
        for back in (False, True):
            got = {r.node for r in reachable(df, s, back).collect()}
            assert got == _reach([(b, a) for a, b in edges] if back else edges, seeds)


def test_long_chain(spark):
    import time

    df = spark.range(5000).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    began = time.time()
    assert reachable(df, spark.createDataFrame([("p", "0")], "project_id string, node string")).count() == 5001
    assert time.time() - began < 60


def test_islands_without_a_way_in(spark):
    edges = [("p", f"i{k}", f"j{k}", None) for k in range(20)] + [("p", f"j{k}", f"i{k}", None) for k in range(20)] + [("p", "s", "t", "hp > 1")]
    df = spark.createDataFrame(edges, EDGES + ", expression string")
    parts = {r.node: r.component for r in weak_components(df).collect()}
    assert all(parts[f"j{k}"] == f"i{k}" for k in range(20)) and parts["t"] == "s"
    flags = spark.createDataFrame([("low", "hp", "0"), ("high", "hp", "5")], "scenario_id string, flag string, value string")
    hidden = {(r.scenario_id, r.node) for r in variables.conditional_reachability(df, flags).collect()}
    assert hidden == {("low", "t")}


def test_numbered(spark):
    rows = [("p" if i % 3 else None, i * 7 % 1000) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], [F.desc("v")], "n").collect()
    for key in ("p", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(own) + 1)) and [r.v for r in own] == sorted((r.v for r in own), reverse=True)


def test_call_depth_over_all_edges(spark):
    edges = [("p", "e1", "start", "a", "call"), ("p", "e2", "a", "b", "jump"), ("p", "e3", "b", "c", "call"), ("p", "e4", "c", "d", "call_return"), ("p", "e5", "d", "f", "call"), ("p", "e6", "f", "f", "call")]
    df = spark.createDataFrame(edges, "project_id string, id string, source string, target string, kind string")
    starts = spark.createDataFrame([("p", "start")], "project_id string, node string")
    depth, over = link.call_depth(df, starts, 3)
    assert {r.node: r.depth for r in depth.collect()} == {"start": 0, "a": 1, "b": 1, "c": 2, "d": 1, "f": 3}
    assert [(r.edge_id, r.frames, r.chain) for r in over.collect()] == [("e6", 4, ["a", "f", "f", "f"])]


def test_dynamic_jumps_of_any_length(spark):
    labels = spark.createDataFrame([("p", x) for x in ("a_1", "a_2", "b_end", "scene_x", "s_end")], "project_id string, id string")
    jumps = [("p", "n", 1, "f'a_{x}'"), ("p", "n", 2, "'s' + mood + '_end'"), ("p", "n", 3, "x + '_end'"), ("p", "n", 4, "'scene_x'"), ("p", "n", 5, "'a_1' if y else 'b_end'"), ("p", "n", 6, "f'{x}'")]
    got = {}
    for r in link.resolve_dynamic(spark.createDataFrame(jumps, "project_id string, source string, line_no int, expression string"), labels).collect():
        got.setdefault(r.line_no, set()).add((r.target, r.how))
    assert got == {1: {("a_1", "pattern"), ("a_2", "pattern")}, 2: {("s_end", "pattern")}, 3: {("b_end", "pattern"), ("s_end", "pattern")}, 4: {("scene_x", "literal")}, 5: {("a_1", "literal"), ("b_end", "literal")}}


def _brute_reaches(edges, endings, most=6):
    """Ways backward with a stack of contexts, as the contract words it; ``most`` bounds the stack."""
    found = set()
    for ending in endings:
        met, todo = {(ending, ())}, [(ending, ())]
        while todo:
            node, stack = todo.pop()
            found.add((node, ending))
            for own, source, target, kind, context in edges:
                if target != node:
                    continue
                if kind == "call_return":
                    if len(stack) >= most:
                        continue
                    new = (*stack, context or own)
                elif kind == "call" and stack:
                    if context is not None and context != stack[-1]:
                        continue
                    new = stack[:-1]
                else:
                    new = stack
                if (source, new) not in met:
                    met.add((source, new))
                    todo.append((source, new))
    return found


def test_reaches_against_stacks(spark):
    rng = np.random.default_rng(3)
    for trial in range(3):
        edges = []
        for k in range(6):  # parts that call one another, the last few of them in a cycle
            nodes = [f"f{k}_{i}" for i in range(5)]
            edges += [(f"s{k}_{i}", nodes[i], nodes[i + 1], "sequence", None) for i in range(4)]
            for j in range(2):
                callee = int(rng.integers(0, 6))
                at = int(rng.integers(0, 4))
                context = None if rng.random() < 0.15 else f"c{k}_{j}"
                edges += [(f"call{k}_{j}", nodes[at], f"f{callee}_0", "call", context), (f"ret{k}_{j}", f"f{callee}_4", nodes[at + 1], "call_return", f"c{k}_{j}")]
            edges.append((f"j{k}", nodes[int(rng.integers(0, 5))], f"e{k % 3}", "jump", None))
        endings = ["e0", "e1", "e2", "f2_3"]
        df = spark.createDataFrame([("p", *e) for e in edges], "project_id string, id string, source string, target string, kind string, context string")
        got = [(r.node, r.ending) for r in reaches(df, spark.createDataFrame([("p", e) for e in endings], "project_id string, node string")).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute_reaches(edges, endings), trial


def test_long_chains_in_searches(spark):
    """5,000 labels in a row, with calls: endings and scenarios take the rounds of the contracted graph."""
    import time

    chain = spark.range(5000).select(F.lit("p").alias("project_id"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"), F.lit("sequence").alias("kind"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("expression"))
    more = [("p", "c1", "10", "sub", "call", "x", None), ("p", "c2", "4000", "sub", "call", "y", None), ("p", "r1", "sub_end", "11", "call_return", "x", None), ("p", "r2", "sub_end", "4001", "call_return", "y", None), ("p", "s", "sub", "sub_end", "sequence", None, None), ("p", "z", "20", "other", "jump", None, "hp > 1")]
    df = chain.unionByName(spark.createDataFrame(more, chain.schema))
    began = time.time()
    got = {(r.node, r.ending) for r in reaches(df, spark.createDataFrame([("p", "5000"), ("p", "other")], "project_id string, node string")).collect()}
    assert got == {(str(i), "5000") for i in range(5001)} | {(str(i), "other") for i in range(21)} | {("other", "other"), ("sub", "5000"), ("sub_end", "5000"), ("sub", "other"), ("sub_end", "other")}
    assert time.time() - began < 60
    flags = spark.createDataFrame([("low", "hp", "0"), ("high", "hp", "5")], "scenario_id string, flag string, value string")
    began = time.time()
    assert {(r.scenario_id, r.node) for r in variables.conditional_reachability(df.drop("context"), flags).collect()} == {("low", "other")}
    assert time.time() - began < 60


def _tables(spark):
    from pathlib import Path

    from loomgraph.plans.lineage import shared_dir

    return set(Path(shared_dir(spark)).glob("loomgraph/*"))


def _ladder(n):
    """Two long sides with steps between them: each node has several ways in, and no node of one side stands for another."""
    both = lambda a, b: ("p", a, b, "jump", f"{a}_{b}", None)
    return [both(f"{s}{i}", f"{t}{i + 1}") for i in range(n) for s in "ab" for t in "ab"]


EDGES = "project_id string, source string, target string, kind string, id string, context string"


def test_long_graphs_with_many_ways_in_take_few_rounds(spark):
    from loomgraph.plans.frontier import reachable

    df = spark.createDataFrame(_ladder(60), EDGES)
    before = _tables(spark)
    got = [r.node for r in reachable(df, spark.createDataFrame([("p", "a0")], "project_id string, node string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {"a0"} | {f"{s}{i}" for i in range(1, 61) for s in "ab"}
    assert len(_tables(spark) - before) < 140


def test_many_endings_of_a_long_graph(spark):
    from loomgraph.plans.frontier import reach_sets, reaches

    df = spark.createDataFrame(_ladder(130), EDGES)
    ends = spark.createDataFrame([("p", f"a{i}") for i in range(0, 131, 2)], "project_id string, node string")
    got = [(r.node, r.ending) for r in reaches(df, ends).collect()]
    want = {(f"{s}{i}", f"a{k}") for i in range(131) for s in "ab" for k in range(0, 131, 2) if k > i or (s == "a" and k == i)}
    assert len(got) == len(set(got)) and set(got) == want
    sets = {r.node: r.ends for r in reach_sets(df, ends).collect()}
    assert sets == {n: sorted(e for m, e in want if m == n) for n in {m for m, _ in want}}
