"""Iterative joins over story graphs: closures, and reachability that matches calls with returns.

Each level joins a frontier with the edges and drops what was seen; levels are written as
tables, so that a lost executor repeats one level at most. Loops end on an empty frontier.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut, cut_counted, numbered


#: Levels that a search takes before it contracts the graph.
SHALLOW = 7
#: Tables of about one size that become one table.
MERGE = 4
#: Edges that taking out a node may add beyond those it removes.
FILL = 4
#: A round of taking out nodes that takes out less than this part of them is the last.
WORTH = 0.05
#: Steps that may be left of a graph for each block of endings to be finished in one task.
REST = 4096
#: Endings in a number, and numbers in a row.
BITS = 64
WORDS = [f"bits{i}" for i in range(8)]


class Seen:
    """What a search has met, level by level. Levels of one size become a table of the next size, so that a deep
    search reads few tables and writes each row again a few times only (a logarithm of the levels)."""

    def __init__(self, first: DataFrame) -> None:
        self.tables: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, level: DataFrame) -> None:
        self.tables.append((0, level))
        while len(self.tables) >= MERGE and len({rank for rank, _ in self.tables[-MERGE:]}) == 1:
            rank = self.tables[-1][0] + 1
            merged = cut(reduce(DataFrame.unionAll, [t for _, t in self.tables[-MERGE:]]))
            self.tables[-MERGE:] = [(rank, merged)]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [t for _, t in self.tables])


def weak_components(edges: DataFrame) -> DataFrame:
    """The least node each node is connected with, whatever the direction: project_id, node, component.

    Each round maps every node to the first of itself and its neighbours, in an order that hashes give anew, and contracts the graph along
    that map; so paths whose nodes are named in order shrink like others. Nodes without an edge to another don't appear.
    """
    e = cut(edges.where("source <> target").select("project_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    found = e.select("project_id", F.explode(F.array("a", "b")).alias("node")).distinct().select("project_id", "node", F.col("node").alias("component"))
    found, rounds = cut(found), 0
    while not e.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = e.select("project_id", F.col("a").alias("u"), order("b").alias("v")).unionAll(e.select("project_id", "b", order("a")))
        up = cut(both.groupBy("project_id", "u").agg(F.min("v").alias("v")).select("project_id", "u", F.least(order("u"), "v")["id"].alias("p")))
        found = cut(found.join(up.withColumnRenamed("u", "component"), ["project_id", "component"], "left").select("project_id", "node", F.coalesce("p", "component").alias("component")))
        pa, pb = (up.select("project_id", F.col("u").alias(x), F.col("p").alias(f"p{x}")) for x in ("a", "b"))
        e = cut(e.join(pa, ["project_id", "a"]).join(pb, ["project_id", "b"]).where("pa <> pb").select("project_id", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        rounds += 1
    least = found.groupBy("project_id", "component").agg(F.min("node").alias("least"))
    return found.join(least, ["project_id", "component"]).select("project_id", "node", F.col("least").alias("component"))


def roots_of(up: DataFrame, keys: list[str]) -> DataFrame:
    """``up``: keys, node, up; one row a node. Follows ``up`` to the first node without one: keys, node, root.

    Takes a logarithm of the longest way in rounds of pointer doubling. Nodes that run into a cycle have no root and
    drop out.
    """
    ptr, n = cut_counted(up.select(*keys, "node", F.col("up").alias("root"), F.lit(False).alias("done")))
    reach, open_ = 1, n
    while reach <= 2 * n and open_:
        far = ptr.select(*keys, F.col("node").alias("root"), F.col("root").alias("further"), F.col("done").alias("all_done"))
        ptr, open_ = cut_counted(ptr.join(far, [*keys, "root"], "left").select(*keys, "node", F.coalesce("further", "root").alias("root"), F.coalesce("all_done", F.lit(True)).alias("done")), "not done")
        reach *= 2
    return ptr.where("done").drop("done")


def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False, keys: tuple[str, ...] = ("project_id",), ways: list[str] | None = None) -> DataFrame:
    """The nodes that ``closure`` reaches, without depths: ``keys``, node. ``edges`` and ``seeds`` have all ``keys``.

    A search that isn't over after ``SHALLOW`` levels goes on over the contracted graph: a node with one way in is reached
    if and only if the node before it is, so that all of these stand for the first node before them
    with another number of ways in (found by pointer doubling). Chains and trees take no levels, however deep; other deep graphs are
    contracted further (``_contracted``). ``ways``: see ``_reachable_ways``.
    """
    if ways is not None:
        return _reachable_ways(edges, seeds, ways)
    keys = list(keys)
    a, b = ("target", "source") if backward else ("source", "target")
    step, size = cut_counted(edges.select(*keys, F.col(a).alias("source"), F.col(b).alias("target")).where("source is not null and target is not null").distinct())
    level, n = cut_counted(seeds.select(*keys, "node").where("node is not null").distinct())
    if size <= REST:
        return _finished(step, level, keys)
    seen, depth = Seen(level), 0
    while n and depth < SHALLOW:
        level, n = cut_counted(level.join(step.withColumnRenamed("source", "node"), [*keys, "node"]).select(*keys, F.col("target").alias("node")).distinct().join(seen.all(), [*keys, "node"], "left_anti"))
        seen.add(level)
        depth += 1
    if not n:
        return seen.all()
    met = cut(seen.all())
    single = step.where("source <> target").groupBy(*keys, F.col("target").alias("node")).agg(F.count("*").alias("n")).where("n = 1").join(met, [*keys, "node"], "left_anti")
    up = step.where("source <> target").select(*keys, F.col("target").alias("node"), F.col("source").alias("up"))
    roots = cut(roots_of(single.drop("n").join(up, [*keys, "node"]), keys))
    of = lambda end: roots.select(*keys, F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    # ways into nodes that stand for themselves, from what stands for their source
    into = step.join(of("target"), [*keys, "target"], "left_anti").join(of("source"), [*keys, "source"], "left")
    short = cut(into.select(*keys, F.coalesce("source_root", "source").alias("node"), F.col("target").alias("next")).where("node <> next").distinct())
    core, level, layers = _contracted(short.select(*keys, F.col("node").alias("source"), F.col("next").alias("target")).distinct(), keys, met)
    short = core.select(*keys, F.col("source").alias("node"), F.col("target").alias("next"))
    few = core.limit(REST + 1).count() <= REST
    seen, n = Seen(cut(_finished(core, level, keys)) if few else level), 0 if few else 1
    while n:
        level, n = cut_counted(level.join(short, [*keys, "node"]).select(*keys, F.col("next").alias("node")).distinct().join(seen.all(), [*keys, "node"], "left_anti"))
        seen.add(level)
    for into in reversed(layers):
        level = cut(into.join(seen.all().withColumnRenamed("node", "up"), [*keys, "up"]).select(*keys, "node").distinct().join(seen.all(), [*keys, "node"], "left_anti"))
        seen.add(level)
    found = cut(seen.all())
    behind = roots.join(found.withColumnRenamed("node", "root"), [*keys, "root"], "left_semi").select(*keys, "node")
    return found.unionByName(behind)


def _reachable_ways(edges: DataFrame, seeds: DataFrame, ways: list[str]) -> DataFrame:
    """``reachable`` for several ways (``BITS`` - 1 at most) in one search: project_id, node, bits. ``edges``: source, target and ``open``, a number
    with the bits of the ways that an edge is open in; ``seeds``: node, and ``bits`` of the ways that begin there.

    An edge is one row, however many ways there are. What isn't over after ``SHALLOW`` levels goes on way by way, over the edges into what a way
    hasn't met yet.
    """
    at = ["project_id", "node"]
    once = lambda df: df.groupBy(*at).agg(F.bit_or("bits").alias("bits"))
    step, size = cut_counted(edges.where("source is not null and target is not null").groupBy("project_id", F.col("source").alias("node"), "target").agg(F.bit_or("open").alias("open")).where("open <> 0"))
    level, n = cut_counted(once(seeds.where("node is not null").select(*at, "bits")))
    seen, depth = Seen(level), 0
    while n and depth < SHALLOW and size > REST:
        came = once(level.join(step, at).select("project_id", F.col("target").alias("node"), F.expr("bits & open").alias("bits")).where("bits <> 0"))
        known = once(seen.all()).withColumnRenamed("bits", "had")
        level, n = cut_counted(came.join(known, at, "left").select(*at, F.expr("bits & ~coalesce(had, 0L)").alias("bits")).where("bits <> 0"))
        seen.add(level)
        depth += 1
    met = seen.all()
    if n:
        met = cut(once(met))
        each = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("way")) for i, w in enumerate(ways)]), lambda w: F.getbit("bits", w["i"]) == 1)
        by_way = lambda df, *columns: df.select("project_id", *columns, F.explode(each).alias("w")).select("project_id", *columns, "w.way")
        ahead = step.select("project_id", F.col("node").alias("source"), "target", "open").join(met.select("project_id", F.col("node").alias("target"), F.col("bits").alias("had")), ["project_id", "target"], "left")
        ahead = by_way(ahead.withColumn("bits", F.expr("open & ~coalesce(had, 0L)")).where("bits <> 0"), "source", "target")
        number = F.create_map(*[x for i, w in enumerate(ways) for x in (F.lit(w), F.lit(1 << i).cast("long"))])
        far = reachable(ahead, by_way(level, "node"), keys=("project_id", "way"))
        met = met.unionByName(far.select(*at, number[F.col("way")].alias("bits")))
    return once(met)


def _finished(step: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes that ``own`` (keys, node) leads to over few steps, itself included: keys, node."""
    one = [F.lit(int(w == WORDS[0])).cast("long").alias(w) for w in WORDS]
    none = own.select(*keys, "node", F.lit(0).cast("long").alias("block"), *one)
    return _walked(step, none, keys).select(*keys, "node").unionByName(own).distinct()


def _walked(step: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """What the sources among ``own`` (keys, node, block, ``WORDS``) lead to, over ``REST`` steps at most: a block is walked in one task, which
    gets these steps and a row for each of their sources, however many nodes there were."""
    at = [*keys, "block"]
    begun = own.join(step.select(*keys, F.col("source").alias("node")).distinct(), [*keys, "node"]).select(*at, "node", *WORDS)
    ahead = step.join(begun.select(*at).distinct(), keys).select(*[F.col(k).alias(f"of_{k}") for k in at], "source", "target")

    def walk(key: tuple, begun: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        onward: dict[str, list[str]] = {}
        for a, b in zip(ahead["source"], ahead["target"]):
            onward.setdefault(a, []).append(b)
        got: dict[str, int] = {}
        words = begun[WORDS].to_numpy(dtype="<i8")
        for node, row in zip(begun["node"], words):
            got[node] = got.get(node, 0) | int.from_bytes(row.tobytes(), "little")
        todo = list(got)
        while todo:
            bits, level = got[node := todo.pop()], onward.get(node, ())
            for b in level:
                if bits & ~got.get(b, 0):
                    got[b] = got.get(b, 0) | bits
                    todo.append(b)
        words = np.frombuffer(b"".join(x.to_bytes(8 * len(WORDS), "little") for x in got.values()), dtype="<i8").reshape(-1, len(WORDS))
        return pd.DataFrame({**{k: [v] * len(got) for k, v in zip(at, key)}, "node": list(got), **dict(zip(WORDS, words.T))})

    return begun.groupBy(*at).cogroup(ahead.groupBy(*[f"of_{k}" for k in at])).applyInPandas(walk, begun.schema)


def _contracted(step: DataFrame, keys: list[str], own: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """A smaller graph with the same ways between the nodes that stay: steps, ``own`` and, by round, the ways into the nodes taken out (``keys``, node, up).

    ``step``: keys, source, target, without loops. A round takes out nodes of which no two are neighbours and whose ways in lead on directly to
    their ways out in few more steps; it passes what is their ``own`` (keys, node, and other columns) on to the next nodes. Long graphs of a bounded
    width lose a part of their nodes in each round, so that rounds are a logarithm of their length; dense ones lose none. What has ``REST`` steps or less stays.
    """
    layers: list[DataFrame] = []
    rest = [c for c in own.columns if c not in (*keys, "node")]
    size = step.limit(REST + 1).count()
    while size > REST:
        ends = step.select(*keys, F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(step.select(*keys, "source", F.lit(0), F.lit(1)))
        degrees, n = cut_counted(ends.groupBy(*keys, "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")))
        if not n:
            return step, own, layers
        order = F.struct(F.xxhash64(F.lit(len(layers)), "node"), "node")
        few = degrees.where(F.col("i") * F.col("o") <= F.col("i") + F.col("o") + FILL).select(*keys, "node")
        a, b = (few.select(*keys, F.col("node").alias(c), order.alias(f"{c}_order")) for c in ("source", "target"))
        held = step.join(a, [*keys, "source"]).join(b, [*keys, "target"]).select(*keys, F.when(F.col("source_order") < F.col("target_order"), F.col("target")).otherwise(F.col("source")).alias("node"))
        out, m = cut_counted(few.join(held.distinct(), [*keys, "node"], "left_anti"))
        if m < WORTH * n:
            return step, own, layers
        of = lambda c: out.withColumnRenamed("node", c).withColumn(f"{c}_out", F.lit(True))
        marked = cut(step.join(of("source"), [*keys, "source"], "left").join(of("target"), [*keys, "target"], "left"))
        into = marked.where("target_out").select(*keys, F.col("target").alias("node"), F.col("source").alias("up"))
        onto = marked.where("source_out").select(*keys, F.col("source").alias("node"), F.col("target").alias("next"))
        bridge = into.join(onto, [*keys, "node"]).where("up <> next").select(*keys, F.col("up").alias("source"), F.col("next").alias("target"))
        step, size = cut_counted(marked.where("source_out is null and target_out is null").select(*keys, "source", "target").unionByName(bridge).distinct())
        own = cut(own.unionByName(own.join(onto, [*keys, "node"]).select(*keys, F.col("next").alias("node"), *rest)).distinct())
        layers.append(into)
    return step, own, layers


def _spread(step: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """What each node gets from all that lead to it, itself included: keys, node, block, ``WORDS``; one row a node and block.

    ``step``: keys, source, target. ``own``: keys, node, block, ``WORDS``. Bits of a block travel together. What isn't over after
    ``SHALLOW`` levels goes on over the contracted graph, and then comes to the nodes taken out.
    """
    at = [*keys, "node", "block"]
    once = lambda df: df.groupBy(*at).agg(*[F.bit_or(w).alias(w) for w in WORDS])

    def search(step: DataFrame, seen: DataFrame, level: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, int]:
        ahead, depth, n = step.withColumnRenamed("source", "node"), 0, 1
        met = Seen(seen)
        while n and (most is None or depth < most):
            came = once(level.join(ahead, [*keys, "node"]).select(*keys, F.col("target").alias("node"), "block", *WORDS))
            known = once(met.all()).select(*at, *[F.col(w).alias(f"had_{w}") for w in WORDS])
            fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"had_{w}", F.lit(0)))).alias(w) for w in WORDS]
            level, n = cut_counted(came.join(known, at, "left").select(*at, *fresh).where(" or ".join(f"{w} <> 0" for w in WORDS)))
            met.add(level)
            depth += 1
        return cut(once(met.all())), level, n

    own = cut(once(own))
    if step.limit(REST + 1).count() <= REST:
        return cut(once(own.unionByName(_walked(step, own, keys))))
    seen, level, n = search(step, own, own, SHALLOW)
    if not n:
        return seen
    core, passed, layers = _contracted(step.where("source <> target"), keys, seen)
    few = core.limit(REST + 1).count() <= REST
    if not layers and not few:
        return search(step, seen, level, None)[0]
    passed = cut(once(passed))
    seen = cut(once(passed.unionByName(_walked(core, passed, keys)))) if few else search(core, passed, passed, None)[0]
    for into in reversed(layers):
        got = into.join(seen.withColumnRenamed("node", "up"), [*keys, "up"]).select(*at, *WORDS)
        seen = cut(once(seen.unionByName(got)))
    return seen


def closure(edges: DataFrame, seeds: DataFrame, keys: list[str], backward: bool = False, max_depth: int | None = None) -> DataFrame:
    """All nodes reachable from the seeds: ``keys``, ``node`` and ``depth`` (edges on a shortest way).

    ``seeds``: ``keys`` and ``node``. ``edges``: ``source`` and ``target``, with those of the keys they
    have (say, project_id or scenario_id). Null nodes are dropped.
    """
    shared = [k for k in keys if k in edges.columns]
    a, b = ("target", "source") if backward else ("source", "target")
    step = cut(edges.select(*shared, F.col(a).alias("node"), F.col(b).alias("next")).where("node is not null and next is not null").distinct())
    level, n = cut_counted(seeds.select(*keys, "node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen, depth = Seen(level), 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        reached = level.select(*keys, "node").join(step, [*shared, "node"]).select(*keys, F.col("next").alias("node")).distinct()
        level, n = cut_counted(reached.join(seen.all(), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen.add(level)
    return seen.all()


def reaches(edges: DataFrame, endings: DataFrame) -> DataFrame:
    """The pairs of ``reach_parts``, one by one: project_id, node, ending."""
    return reach_parts(edges, endings).select("project_id", "node", F.explode("endings").alias("ending"))


def reach_sets(edges: DataFrame, endings: DataFrame) -> DataFrame:
    """All endings of each node that has any, in order: project_id, node, ends."""
    return reach_parts(edges, endings).groupBy("project_id", "node").agg(F.array_sort(F.flatten(F.collect_list("endings"))).alias("ends"))


def reach_parts(edges: DataFrame, endings: DataFrame) -> DataFrame:
    """``reach_bits`` with names: project_id, node, endings (lists of up to ``BITS`` for each of ``WORDS``, several a node; no ending is in two)."""
    found, ends = reach_bits(edges, endings)
    names = ends.groupBy("project_id", "block").agg(F.sort_array(F.collect_list(F.struct("word", "bit", "ending"))).alias("names"))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])
    there = F.filter("names", lambda x: F.get(F.array(*WORDS), x["word"]).bitwiseAND(one(x)) != 0)
    # few rows become many, which are dealt before
    found = found.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project_id", "node")
    return found.join(names, ["project_id", "block"]).select("project_id", "node", F.transform(there, lambda x: x["ending"]).alias("endings"))


def reach_bits(edges: DataFrame, endings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which endings each node reaches on ways that match calls with returns: project_id, node, block, ``WORDS``, one row a node and
    block; and the endings' places: project_id, ending, block, word, bit.

    A way may return from a called part only to where that part was called from; it may start inside a called part (and
    return to any of its callers), and may end inside one. A call without a context matches every return. Calls may nest as deep as
    they will. Edges whose condition is statically false don't count. ``edges``: source, target, kind, id, and
    context (may be null); a call_return without a context has its id for one.

    What lies between a call and its return is worked out once for each returning node, as a *summary* step from the call's source
    to the return's target. With these, a search backward from an ending first goes over calls (of parts the way ends in),
    and, once it has gone over a return (into a part the way starts in), over calls no more. A node whose only way
    out is a plain step reaches what the next node reaches, so that such nodes take no levels, however long their chains.
    Endings travel as bits, up to ``BITS`` in each of ``WORDS`` together.
    """
    context = F.col("context") if "context" in edges.columns else F.lit(None).cast("string")
    alive = edges.where(~F.coalesce("condition_is_statically_false", F.lit(False))) if "condition_is_statically_false" in edges.columns else edges
    kind = F.when(F.col("kind").isin("call", "call_return"), F.col("kind")).otherwise("plain")
    named = F.when(kind == "call_return", F.coalesce(context, "id")).when(kind == "call", context)
    step = cut(alive.where("source is not null and target is not null").select("project_id", "source", "target", kind.alias("kind"), named.alias("context")).distinct())
    ends = cut(endings.select("project_id", F.col("node").alias("ending")).where("ending is not null").distinct())
    p = ["project_id"]

    left = step.where("kind <> 'plain' or source <> target").withColumnRenamed("source", "node")
    out, n = cut_counted(left.groupBy(*p, "node").agg(F.count("*").alias("n"), F.max(F.col("kind") != "plain").alias("calls")))
    single = out.where("n = 1 and not calls").select(*p, "node").join(ends.withColumnRenamed("ending", "node"), [*p, "node"], "left_anti")
    single, m = cut_counted(single.join(left.select(*p, "node", F.col("target").alias("up")), [*p, "node"]))
    # where hardly any node has one way out, it isn't worth to put all steps together anew
    roots = cut(roots_of(single, p)) if m >= WORTH * n else None
    if roots is None:
        to = step.withColumn("root", F.col("target"))
    else:
        to = step.join(single.withColumnRenamed("node", "source"), [*p, "source"], "left_anti").join(roots.withColumnRenamed("node", "target"), [*p, "target"], "left")
    # backward: node is where a step leads to (or what stands for it), next where it comes from
    back = to.select(*p, F.coalesce("root", "target").alias("node"), F.col("source").alias("next"), "kind", "context").where("kind <> 'plain' or node <> next")
    back = back if roots is None else cut(back.distinct())
    plain = back.where("kind = 'plain'").select(*p, "node", "next")
    calls, returns = back.where("kind = 'call'"), back.where("kind = 'call_return'")
    if not returns.isEmpty():
        plain = plain.unionByName(_summaries(plain, calls, returns)).distinct()
    else:
        returns = None
    # a node that is left over a return is another one than itself before: 1 is put before its name, else 0
    named = lambda c, was: F.concat(F.lit(was), c) if returns is not None else F.col(c)
    move = lambda df, was, now: df.select(*p, named("node", was).alias("source"), named("next", now).alias("target"))
    moves = move(plain.unionByName(calls.select(*p, "node", "next")), "0", "0")
    if returns is not None:
        moves = moves.unionByName(move(plain, "1", "1")).unionByName(move(returns, "0", "1")).unionByName(move(returns, "1", "1"))
        moves = cut(moves.distinct())
    order = ["ending"]
    if ends.count() > BITS * len(WORDS):
        # endings of one part stand together, so that their bits do; hashes of two ways in and two ways out of each node tell nearly all parts
        h = back.select(*p, F.xxhash64("node").alias("node"), F.xxhash64("next").alias("next"))
        near = [h.groupBy(*p, F.col(a).alias("source")).agg(F.array(F.min(b), F.max(b)).alias("to")) for a, b in (("node", "next"), ("next", "node"))]
        parts = weak_components(near[0].unionByName(near[1]).select(*p, "source", F.explode("to").alias("target")))
        ends, order = ends.withColumn("node", F.xxhash64("ending")).join(parts, [*p, "node"], "left").drop("node"), ["component", "ending"]
    nth = F.col("nth") - 1
    place = [F.floor(nth / (BITS * len(WORDS))).alias("block"), (F.floor(nth / BITS) % len(WORDS)).cast("int").alias("word"), (nth % BITS).cast("int").alias("bit")]
    ends = cut(numbered(ends, p, order, "nth").select(*p, "ending", *place))
    one = [F.when(F.col("word") == i, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0)).cast("long").alias(w) for i, w in enumerate(WORDS)]
    found = _spread(moves, ends.select(*p, named("ending", "0").alias("node"), "block", *one), p)
    if returns is not None:
        found = cut(found.groupBy(*p, F.substring("node", 2, 1 << 30).alias("node"), "block").agg(*[F.bit_or(w).alias(w) for w in WORDS]))
    if roots is not None:
        behind = roots.join(found.withColumnRenamed("node", "root"), [*p, "root"])
        found = found.unionByName(behind.select(*p, "node", "block", *WORDS))
    return found, ends


def _summaries(plain: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """Steps (node, next) from where a return leads back to where its call comes from, if the called part leads from
    the one to the other with all calls in it returned from; all backward, like their parameters."""
    p = ["project_id"]
    level, n = cut_counted(returns.select(*p, F.col("next").alias("exit"), F.col("next").alias("node")).distinct())
    seen, steps, have = Seen(level), plain, None
    # what each returning node is looked for from; one whose parts are all found is followed no further
    back = returns.select(*p, F.col("next").alias("exit"), "context")
    parts = calls.select(*p, "node", "context").where("context is not null").distinct()
    any_ = calls.where("context is null").select(*p, "node").distinct()
    wanted, _ = cut_counted(back.join(parts, [*p, "context"]).select(*p, "exit", "node").unionByName(back.select(*p, "exit").distinct().join(any_, p)).distinct())
    while n:
        # a called part whose entry leads to a returning node: its calls with the contexts of that node's returns
        entered = level.join(calls.select(*p, "node", F.col("next").alias("caller"), F.col("context").alias("of")), [*p, "node"])
        back = returns.select(*p, F.col("next").alias("exit"), F.col("node").alias("target"), "context")
        new = entered.join(back, [*p, "exit"]).where("of is null or of = context").select(*p, F.col("target").alias("node"), F.col("caller").alias("next")).distinct()
        new = cut(new if have is None else new.join(have.all(), [*p, "node", "next"], "left_anti"))
        if have is None:
            have = Seen(new)
        else:
            have.add(new)
        older = seen.all().join(new, [*p, "node"]).select(*p, "exit", F.col("next").alias("node"))
        ahead = level.join(steps.unionByName(have.all()), [*p, "node"]).select(*p, "exit", F.col("next").alias("node"))
        open_ = wanted.join(seen.all(), [*p, "exit", "node"], "left_anti").select(*p, "exit").distinct()
        level, n = cut_counted(older.unionByName(ahead).distinct().join(open_, [*p, "exit"], "left_semi").join(seen.all(), [*p, "exit", "node"], "left_anti"))
        seen.add(level)
    return have.all()


def chain_heads(edges: DataFrame) -> DataFrame:
    """Heads and positions of linear chains by pointer doubling: project_id, node, head, pos.

    ``edges``: project_id, source, target, at most one per source and one per target. A cycle has
    no first node; it is cut before its least id. Takes log2(longest chain) rounds.
    """
    one = edges.select("project_id", "source", "target")
    every = one.select("project_id", F.col("source").alias("node")).unionAll(one.select("project_id", "target")).distinct()
    up = every.join(one.select("project_id", F.col("target").alias("node"), F.col("source").alias("up")), ["project_id", "node"], "left")
    ptr = cut(up.select("project_id", "node", F.coalesce("up", "node").alias("head"), F.col("up").isNotNull().cast("long").alias("pos"), F.col("up").isNull().alias("done"), F.least("node", F.coalesce("up", "node")).alias("least")))
    n, reach = ptr.count(), 1
    while reach <= 2 * n and not ptr.where("not done").isEmpty():
        far = ptr.select("project_id", F.col("node").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        ptr = cut(ptr.join(far, ["project_id", "head"]).select("project_id", "node", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done"), F.least("least", "least2").alias("least")))
        reach *= 2
    first = ptr.where("not done and node = least")
    if first.isEmpty():
        return ptr.select("project_id", "node", "head", "pos")
    return chain_heads(cut(one.join(first.select("project_id", F.col("node").alias("target")), ["project_id", "target"], "left_anti")))


def live(edges: DataFrame) -> DataFrame:
    return edges.where(~F.coalesce(F.col("condition_is_statically_false"), F.lit(False)))


def present(label: Column) -> Column:
    """True for a label that isn't empty."""
    return F.coalesce(F.length(label) > 0, F.lit(False))
