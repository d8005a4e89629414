"""Near-duplicate vectors by NN-descent.

A graph of each vector's nearest neighbours starts from blocks of random projections and is
refined by joining, around every vector, its neighbours and those it is a neighbour of. Edges
below the threshold only guide the search. A list that is full of links is saturated: it is
enlarged and joined again. What is saturated even then lies in a dense family, whose links are
counted in blocks, without listing them: its vectors are held against their component and all
others of their label that angles don't rule out. An audit of some vectors against all rows measures the
recall of the lists, vector by vector; while its lower confidence bound is short, twice as many
projections as before and another round follow. If that doesn't suffice, every vector is treated as saturated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._util import components, cut

COSINE = 0.93
#: Neighbours of a list, and of one that was enlarged.
K, WIDE = 8, 32
#: Vectors of one local join or block, about.
CHUNK, BLOCK = 64, 256
TABLES, ROUNDS, MOST_ROUNDS = 3, 3, 7
#: Vectors of the audit at first, and at most where few have links (by their components in all, too);
#: the linked ones it wants; the lower bound of recall below which the search goes on.
AUDIT, MOST_AUDIT, AUDIT_COMPONENTS, LINKED, RECALL = 2048, 32_768, 4_000_000, 256, 0.97
SEED = 42


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_list()).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal keys, across batches."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for x, y in zip(edges, edges[1:]):
            key = tuple(k[x].tolist())
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(b.iloc[x:y])
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


EDGES = "u long, v long, s double"


def _join_run(node: np.ndarray, unit: np.ndarray, bound: np.ndarray) -> pd.DataFrame:
    """Ordered pairs of a run that beat the bound of their first."""
    s = unit @ unit.T
    i, j = np.nonzero((s > bound[:, None]) & (node[:, None] != node[None, :]))
    return pd.DataFrame({"u": node[i], "v": node[j], "s": np.minimum(s[i, j], 1.0)})


def _best_of_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run in _runs(batches, ["grp", "t", "code", "part"]):
        if len(run) > 1:
            unit = _unit(run["vec"])
            s = unit @ unit.T
            np.fill_diagonal(s, -2.0)
            k = min(K, len(run) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            node = run["node"].to_numpy()
            yield pd.DataFrame({"u": np.repeat(node, k), "v": node[best].ravel(), "s": np.minimum(np.take_along_axis(s, best, 1).ravel(), 1.0)})


def _local_joins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[pd.DataFrame] = []
    n = 0
    for run in _runs(batches, ["pivot", "part"]):
        if len(run) > 1:
            out.append(_join_run(run["node"].to_numpy(), _unit(run["vec"]), run["bound"].to_numpy()))
            n += len(out[-1])
        if n > 50_000:
            yield pd.concat(out)
            out, n = [], 0
    if out:
        yield pd.concat(out)


def _top(edges: DataFrame, k: int = K) -> DataFrame:
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return cut(best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))


def _from_projection(classes: DataFrame, most: int, tables: range) -> DataFrame:
    """Nearest neighbours within blocks of vectors on the same side of random planes."""
    bits = max(0, math.ceil(math.log2(max(1, most) / CHUNK)))

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        out, planes = [], {}
        for v in vectors:
            if len(v) not in planes:
                planes[len(v)] = [np.random.default_rng((SEED, t)).standard_normal((len(v), bits)) for t in tables]
            out.append([int((np.asarray(v, dtype=np.float64) @ p > 0) @ (1 << np.arange(bits))) if bits else 0 for p in planes[len(v)]])
        return pd.Series(out, dtype=object)

    dealt = cut(classes.select("node", "grp", F.posexplode(codes("vec")).alias("t", "code")))
    crowd = dealt.groupBy("grp", "t", "code").agg(F.ceil(F.count("*") / (2 * CHUNK)).alias("parts"))
    placed = dealt.join(crowd, ["grp", "t", "code"]).withColumn("part", F.expr("pmod(xxhash64(node, t), parts)"))
    rows = placed.join(classes.select("node", "vec"), "node").select("grp", "t", "code", "part", "node", "vec")
    rows = rows.repartition("grp", "t", "code", "part").sortWithinPartitions("grp", "t", "code", "part")
    return rows.mapInPandas(_best_of_block, EDGES)


def _descend(graph: DataFrame, classes: DataFrame, round_: int) -> DataFrame:
    """One round: neighbours and reverse neighbours of each vector meet around it."""
    bound = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("least")).select(F.col("u").alias("node"), F.when(F.col("n") >= K, F.col("least")).otherwise(-2.0).alias("bound"))
    return _around(graph, classes, bound, -2.0, round_)


def _enlarge(graph: DataFrame, classes: DataFrame, cosine: float, round_: int) -> DataFrame:
    """Links (u, v) only. Lists of K links grow to WIDE: around each of their vectors all links are kept,
    twice, as longer lists bring further vectors together."""
    links = cut(graph.where(F.col("s") >= cosine))
    full = cut(links.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") >= K).select(F.col("u").alias("node"), F.lit(cosine - 1e-12).alias("bound")))
    if full.isEmpty():
        return links
    for r in range(2):
        near = links.join(full.select(F.col("node").alias("u")), "u", "left_semi")
        links = _top(links.unionAll(_around(near, classes, full, 2.0, round_ + r).where(F.col("s") >= cosine)), WIDE)
    return links


def _around(graph: DataFrame, classes: DataFrame, bound: DataFrame, other: float, round_: int) -> DataFrame:
    """Pairs around each vector that beat the bound of their first; ``other``: where it has none."""
    around = graph.select(F.col("u").alias("pivot"), F.col("v").alias("node")).unionAll(graph.select(F.col("v"), F.col("u"))).distinct()
    parts = around.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = around.join(parts, "pivot").withColumn("part", F.expr(f"pmod(xxhash64(node, {round_}), parts)")).drop("parts")
    members = classes.select("node", "vec").join(bound, "node", "left").withColumn("bound", F.coalesce("bound", F.lit(other)))
    rows = dealt.join(members, "node").select("pivot", "part", "node", "bound", "vec")
    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part").mapInPandas(_local_joins, EDGES)


def lower_bound(found: float, n: int, z: float = 1.64) -> float:
    """Wilson's bound: with 95 % confidence the share is no less than this."""
    if not n:
        return 0.0
    p = min(1.0, found / n)
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def saturated(links: DataFrame) -> DataFrame:
    """The vectors whose enlarged lists are full of links."""
    return links.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") >= WIDE).select(F.col("u").alias("node"))


def audit(links: DataFrame, classes: DataFrame, cosine: float, n: int, seed: int) -> tuple[float, int]:
    """Over ``n`` vectors with unsaturated lists, held against all such: the sum of each one's share of its
    links that is found, and how many have links. Links of saturated vectors are counted exactly later on."""
    plain = classes.select("node", "grp", "vec").join(saturated(links), "node", "left_anti")
    some = plain.orderBy(F.xxhash64("node", F.lit(seed))).limit(n).toPandas()
    sets = {g: (x["node"].to_numpy(), _unit(x["vec"])) for g, x in some.groupby("grp")}

    def true_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, x in b.groupby("grp"):
                if g in sets:
                    node, unit = sets[g]
                    i, j = np.nonzero((unit @ _unit(x["vec"]).T >= cosine) & (node[:, None] != x["node"].to_numpy()[None, :]))
                    yield pd.DataFrame({"u": node[i], "v": x["node"].to_numpy()[j]})

    true = plain.mapInPandas(true_links, "u long, v long")
    both = links.select("u", "v", F.lit(1).alias("have")).unionAll(links.select("v", "u", F.lit(1))).distinct()
    shares = true.join(both, ["u", "v"], "left").groupBy("u").agg(F.avg(F.coalesce("have", F.lit(0))).alias("share"))
    r = shares.agg(F.sum("share").alias("found"), F.count("*").alias("n")).first()
    return r.found or 0.0, r.n


def enough(links: DataFrame, classes: DataFrame, cosine: float, round_: int) -> bool:
    """Whether the recall of unsaturated lists is RECALL or more, with confidence. Where few vectors have
    links, more are audited; where even the largest audit meets too few for a bound, it must miss none."""
    total, longest = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    most = max(1, min(MOST_AUDIT, AUDIT_COMPONENTS // max(1, longest or 0)))
    n = min(AUDIT, most)
    while True:
        found, linked = audit(links, classes, cosine, n, SEED + round_)
        if n >= total:
            return found >= RECALL * linked  # no sample: all vectors
        if linked >= LINKED:
            return lower_bound(found, linked) >= RECALL
        if n >= most:
            return found == linked
        n = min(most, 4 * n)


def neighbour_graph(classes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, bool]:
    """The links (u, v, s) of each class (node, grp, vec), up to WIDE; and whether their recall suffices."""
    most = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    graph, tables = _top(_from_projection(classes, most, range(TABLES))), TABLES
    for r in range(MOST_ROUNDS):
        graph = _top(graph.unionAll(_descend(graph, classes, r)))
        if r >= ROUNDS - 1:
            links = _enlarge(graph, classes, cosine, r)
            if enough(links, classes, cosine, r):
                return links, True
            more = TABLES << (r - ROUNDS + 1)
            graph = _top(graph.unionAll(_from_projection(classes, most, range(tables, tables + more))))
            tables += more
    links = _enlarge(graph, classes, cosine, MOST_ROUNDS)
    return links, enough(links, classes, cosine, MOST_ROUNDS)


def _reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The angle of each member to the centre of its component."""
    for b in batches:
        if len(b):
            for _, x in b.groupby(b["vec"].map(len)):
                yield pd.DataFrame({"c": x["c"], "angle": np.arccos(np.clip((_unit(x["vec"]) * _unit(x["centre"])).sum(axis=1), -1.0, 1.0))})


def _near_components(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Pairs of components that may have a link between them, by the triangle inequality of angles."""
    widest = np.arccos(cosine) + 1e-6
    for run in _runs(batches, ["grp", "sb", "mb"]):
        a, b = run[run["side"] == 0], run[run["side"] == 1]
        if len(a) and len(b):
            angle = np.arccos(np.clip(_unit(a["centre"]) @ _unit(b["centre"]).T, -1.0, 1.0))
            i, j = np.nonzero(angle <= a["reach"].to_numpy()[:, None] + b["reach"].to_numpy()[None, :] + widest)
            yield pd.DataFrame({"c": a["c"].to_numpy()[i], "d": b["c"].to_numpy()[j]})


def _blocks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` (side 0) and ``b`` (side 1) of one key, in pairs of blocks; both have columns ``key``, ``h`` and the same others."""
    sizes = a.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("sbs")).join(b.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("mbs")), key)
    a = a.join(sizes, key).withColumn("side", F.lit(0)).withColumn("sb", F.expr("pmod(h, sbs)")).withColumn("mb", F.explode(F.expr("sequence(0L, mbs - 1)")))
    b = b.join(sizes, key).withColumn("side", F.lit(1)).withColumn("mb", F.expr("pmod(h, mbs)")).withColumn("sb", F.explode(F.expr("sequence(0L, sbs - 1)")))
    both = a.unionByName(b).drop("h", "sbs", "mbs")
    return both.repartition(key, "sb", "mb").sortWithinPartitions(key, "sb", "mb")


def _counts(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Links between the saturated vectors and the members of each block pair, summed by vector;
    and, where ``other`` isn't null, the components that they join."""
    for run in _runs(batches, ["c", "sb", "mb"]):
        a, b = run[run["side"] == 0], run[run["side"] == 1]
        if not len(a) or not len(b):
            continue
        hit = (_unit(a["vec"]) @ _unit(b["vec"]).T >= cosine) & (a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :])
        yield pd.DataFrame({"node": a["node"], "n_links": hit @ b["n"].to_numpy(), "other": None})
        plain = ~b["full"].to_numpy(dtype=bool)
        yield pd.DataFrame({"node": b["node"][plain], "n_links": (hit.T @ a["n"].to_numpy())[plain], "other": None})
        c = int(a["c"].iloc[0])
        others = [int(d) for d in b["d"][hit.any(axis=0)].unique() if d != c]
        yield pd.DataFrame({"node": c, "n_links": 0, "other": pd.Series(others, dtype="Int64")})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (rows linked directly), component_id
    (least vec_id reachable, itself included) and kept (vec_id = component_id).

    Vectors link if their labels are equal and not null, their lengths are equal and their
    cosine in double precision is ``cosine`` or more. Rows that are null, empty or zero, that
    hold a null or non-finite component, or that have no vec_id, link with nothing. Equal
    vectors of a label are one class: they link with each other and share their links.
    An empty table gives an empty result; other columns are ignored.
    """
    v = F.col("vec")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = cut(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"), F.col(label).alias("label")).withColumn("node", F.when(sound, F.xxhash64("label", "vec"))))
    grp = F.xxhash64("label", F.size("vec"))
    classes = cut(rows.where("node is not null").groupBy("node", "label", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("grp", grp))
    links, sure = neighbour_graph(classes, cosine)
    links = links.select("u", "v")
    full = saturated(links).withColumn("full", F.lit(True))
    if not sure:
        full = classes.select("node", F.lit(True).alias("full"))
    linked = components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("component", "c")
    known = cut(classes.join(linked, "node", "left").join(full, "node", "left").select("node", "grp", "vec", "n", "least", F.coalesce("c", "node").alias("c"), F.coalesce("full", F.lit(False)).alias("full")))

    # links among unsaturated vectors: the edges of the graph, either way
    plain = known.where("not full").select("node", "n")
    both = links.unionAll(links.select("v", "u")).distinct()
    edges = both.join(plain.select(F.col("node").alias("u")), "u").join(plain.select(F.col("node").alias("v"), "n"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))

    # components of saturated vectors, and those near enough to have a link with them
    centres = known.where("node = c").select("c", "grp", F.col("vec").alias("centre"))
    reach = known.select("c", "vec").join(centres.select("c", "centre"), "c").mapInPandas(_reach, "c long, angle double").groupBy("c").agg(F.max("angle").alias("reach"))
    every = cut(centres.join(reach, "c").withColumn("h", F.xxhash64("c")))
    some = every.join(known.where("full").select("c").distinct(), "c", "left_semi")
    near = cut(_blocks(some, every, "grp").mapInPandas(lambda x: _near_components(x, cosine), "c long, d long"))

    # links of saturated vectors: all of these, in blocks
    dense = known.select("node", "vec", "n", "full", F.col("c").alias("d"), F.xxhash64("node").alias("h"))
    a = dense.where("full").withColumn("c", F.col("d"))
    blocks = _blocks(a, dense.join(near, "d"), "c")
    counted = cut(blocks.mapInPandas(lambda x: _counts(x, cosine), "node long, n_links long, other long"))
    totals = edges.unionByName(counted.where("other is null").select("node", "n_links")).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    joined = components(counted.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("c"), "component")

    whole = known.join(joined, "c", "left").select("node", "n", "least", F.coalesce("component", "c").alias("c"))
    names = whole.groupBy("c").agg(F.min("least").alias("component_id"))
    named = cut(whole.join(names, "c").join(totals, "node", "left").select("node", "component_id", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")))
    out = rows.join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
