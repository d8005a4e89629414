"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow
routes each pattern's words to the quotas of its sources; reading a pattern again costs more
each time, so that nothing is repeated while something unread would do. Patterns then turn
their flow into whole documents, in an order that only a seed and the document decide.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._util import WORD, cut

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most so often; its n-th reading costs ``REPEAT_COST[n - 1]``.
REPEATS = 3
REPEAT_COST = (0, 1, 3)
SEED = 42
#: Documents of a bucket, about: the last bucket of a pattern is chosen from one by one.
BUCKET = 4096
#: Plans of so many patterns are broadcast.
BROADCAST = 20_000

Source = str | None


def words(text: Column) -> Column:
    """The number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[Source, int], weights: Iterable[float] = WEIGHTS, total: float | None = None) -> dict[Source, float]:
    """Quotas by source: shares by weight (sources by code point, null last), at most
    ``REPEATS`` times a source's size; what is above is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = list(weights)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, quota, open_ = float(sum(sizes.values()) if total is None else total), {}, list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > REPEATS * sizes[s]]
        if not over:
            quota |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            quota[s] = float(REPEATS * sizes[s])
            left -= quota[s]
            open_.remove(s)
    return {s: quota[s] for s in order}


def route(patterns: dict[tuple, int], quotas: dict[Source, float]) -> dict[tuple, float]:
    """Words to take of each pattern: a cheapest flow, by shortest augmenting paths.

    Arcs: start -> pattern once per reading (capacity: the pattern's words), pattern -> its
    sources, source -> end (capacity: its quota).
    """
    start, end = ("start",), ("end",)
    to: list[tuple] = []
    room: list[float] = []
    cost: list[int] = []
    out: dict[tuple, list[int]] = defaultdict(list)

    def arc(a: tuple, b: tuple, capacity: float, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0.0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for p, size in patterns.items():
        for n in range(REPEATS):
            arc(start, ("p", p), float(size), REPEAT_COST[n])
        for s in p:
            arc(("p", p), ("s", s), math.inf, 0)
    for s, q in quotas.items():
        arc(("s", s), end, q, 0)
    least = 1e-6
    while True:
        dist: dict[tuple, int] = {start: 0}
        via: dict[tuple, int] = {}
        queue, queued = deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k in out[a]:
                if room[k] > least and dist[a] + cost[k] < dist.get(to[k], 1 << 60):
                    dist[to[k]], via[to[k]] = dist[a] + cost[k], k
                    if to[k] not in queued:
                        queue.append(to[k])
                        queued.add(to[k])
        if end not in dist:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(room[k] for k in path)
        for k in path:
            room[k] -= amount
            room[k ^ 1] += amount
    flow: dict[tuple, float] = defaultdict(float)
    for p in patterns:
        flow[p] = sum(room[k ^ 1] for k in out[("p", p)] if to[k] != start)
    return flow


def amounts(patterns: dict[tuple, int], quotas: dict[Source, float]) -> dict[tuple, float]:
    """Words to take of each pattern. Sources that no document shares need no flow: all of their words are read up to
    ``REPEATS`` times, as far as the quota goes. The others are routed, each connected part of them by itself."""
    leader = {s: s for p in patterns for s in p}

    def find(s: Source) -> Source:
        while leader[s] != s:
            leader[s] = leader[leader[s]]
            s = leader[s]
        return s

    for p in patterns:
        for s in p[1:]:
            leader[find(s)] = find(p[0])
    parts: dict[Source, dict[tuple, int]] = defaultdict(dict)
    for p, size in patterns.items():
        if p:
            parts[find(p[0])][p] = size
    flow: dict[tuple, float] = {(): 0.0}
    for part in parts.values():
        if len(part) == 1 and len(next(iter(part))) == 1:
            (p, size), = part.items()
            flow[p] = min(quotas[p[0]], float(REPEATS * size))
        else:
            flow |= route(part, {s: quotas[s] for s in {s for p in part for s in p}})
    return flow


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Chooses the units of one bucket that take what is left of a pattern's flow, in seeded
    order, wherever a unit still fits; then one more, if that comes nearer."""
    group = group.sort_values(["h", "doc_id"], kind="stable", na_position="first")
    left, extra = float(group["left"].iloc[0]), []
    for size in group["unit_size"]:
        extra.append(int(0 < size <= left))
        left -= size * extra[-1]
    rest = group["unit_size"].where(pd.Series(extra, index=group.index) == 0)
    rest = rest[rest > 0]
    if len(rest) and rest.min() < 2 * left:
        extra[group.index.get_loc(rest.idxmin())] = 1
    return group.assign(copies=group["copies"] + extra)[["h", "doc_id", "copies"]]


def mix(docs: DataFrame, membership: Column, text: str = "text", doc_id: str = "doc_id", weights: Iterable[float] = WEIGHTS, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Units and quotas. A unit is a distinct (doc_id, membership, text): doc_id, members, h (seeded hash),
    n_rows (repeated rows), size (words of one), copies (how often each row is taken, 0 to 3).
    The quotas have one row per source: source, source_size, target.

    ``membership``: array of the sources of a document; null elements are a source of their
    own. A null or empty text has size 0. Documents without a source are never taken. Rows that repeat are one unit.
    An empty table gives an empty result; other columns are ignored, whatever their names. Reruns agree.
    The driver holds a row for each distinct pattern, and solves a flow for each connected part of the sources that documents share.
    """
    spark = docs.sparkSession
    members = F.array_distinct(F.sort_array(membership, asc=False))
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.to_json(members))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), members.alias("members"), h.alias("h"), words(F.col(text)).alias("size"))
    units = cut(slim.groupBy("doc_id", "members", "h", "size").agg(F.count("*").alias("n_rows")))

    got = units.groupBy("members").agg(F.sum(F.col("size") * F.col("n_rows")).alias("size"), F.count("*").alias("n")).collect()
    patterns = {tuple(r.members or ()): int(r.size) for r in got}
    sizes: dict[Source, int] = defaultdict(int)
    for p, size in patterns.items():
        for s in p:
            sizes[s] += size
    quotas = targets(dict(sizes), weights, sum(patterns.values()) if total is None else total)
    flow = amounts(patterns, quotas)
    rows = []
    for r in got:
        p = tuple(r.members or ())
        full = min(REPEATS, int((flow[p] + 0.5) // patterns[p])) if patterns[p] else 0
        left = max(0.0, flow[p] - full * patterns[p]) if full < REPEATS else 0.0
        rows.append((r.members, max(1, math.ceil(r.n / BUCKET)), full, left))
    plan = spark.createDataFrame(rows, "members array<string>, buckets int, full int, flow_left double")
    if len(rows) <= BROADCAST:
        plan = F.broadcast(plan)

    units = units.join(plan, units["members"].eqNullSafe(plan["members"])).select(units["*"], "buckets", "full", "flow_left")
    units = units.withColumn("bucket", F.expr("pmod(xxhash64(h), buckets)")).withColumn("unit_size", F.col("size") * F.col("n_rows"))
    sums = units.groupBy("members", "bucket").agg(F.sum("unit_size").alias("bucket_size"), F.first("flow_left").alias("flow_left"))
    before = F.sum("bucket_size").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("left", F.col("flow_left") - F.coalesce(before, F.lit(0)))
    state = F.when(F.col("left") >= F.col("bucket_size"), 1).when(F.col("left") <= 0, 0)
    placed = units.drop("flow_left").join(sums.select("members", "bucket", "left", state.alias("whole")).withColumnRenamed("members", "m2").withColumnRenamed("bucket", "b2"), F.col("members").eqNullSafe(F.col("m2")) & (F.col("bucket") == F.col("b2")))
    placed = cut(placed.select("doc_id", "members", "h", "n_rows", "size", "unit_size", "bucket", "left", "whole", F.col("full").alias("copies")))
    sure = placed.where("whole is not null").withColumn("copies", F.when(F.col("size") > 0, F.col("copies") + F.col("whole")).otherwise(F.col("copies")))
    edge = placed.where("whole is null")
    filled = edge.groupBy("members", "bucket").applyInPandas(lambda g: _fill(g), "h long, doc_id long, copies int")
    filled = filled.select(F.col("h").alias("h2"), F.col("doc_id").alias("d2"), F.col("copies").alias("c2"))
    edge = edge.join(filled, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d2"))).withColumn("copies", F.col("c2"))
    keep = ["doc_id", "members", "h", "n_rows", "size", F.col("copies").cast("int").alias("copies")]
    out = sure.select(*keep).unionAll(edge.select(*keep))
    quota_rows = [(s, sizes[s], quotas[s]) for s in quotas]
    return out, spark.createDataFrame(quota_rows, "source string, source_size long, target double")


def by_source(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``, whose one source is a column: doc_id, size, source_size,
    target and taken, the words the mix takes of it with repeats.

    A null source is a source of its own; null and empty texts have size 0 and give nothing; rows that repeat are
    taken alike; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    mixed, quotas = mix(docs, F.array(F.col(source)), **options)
    one = mixed.withColumn("s", F.col("members")[0]).join(quotas, F.col("s").eqNullSafe(F.col("source")), "left")
    return one.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def take(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Rows without a word are never taken; rows that repeat (in doc_id, source and text) are taken alike. A null source is a
    source of its own; null doc_ids and columns of any names pass through; an empty table gives an empty result.
    """
    members = F.array(F.col(source))
    mixed, _ = mix(docs, members, text=text, doc_id=doc_id, seed=seed, **options)
    chosen = mixed.where("copies > 0").select(F.col("h").alias("__mix_h"), F.col("doc_id").alias("__mix_id"), F.col("copies").alias("__mix_copies"))
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.to_json(F.array_distinct(F.sort_array(members, asc=False))))
    both = docs.withColumn("__mix_own", h).join(chosen, (F.col("__mix_own") == F.col("__mix_h")) & F.col(doc_id).eqNullSafe(F.col("__mix_id")))
    return both.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
