"""Folding parts of a graph: chapters to single nodes, menus into their labels, forks and rejoins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.frontier import present
from loomgraph.plans.lineage import cut


def _chapters(nodes: DataFrame, side: str, name: str) -> DataFrame:
    return nodes.select("project_id", F.col("id").alias(side), F.col("chapter").alias(name))


def chapter_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of edges between chapters, and whether they stay inside one."""
    e = edges.join(_chapters(nodes, "source", "source_chapter"), ["project_id", "source"]).join(_chapters(nodes, "target", "target_chapter"), ["project_id", "target"])
    return e.groupBy("project_id", "source_chapter", "target_chapter").agg(F.count("*").alias("n")).withColumn("internal", F.col("source_chapter").eqNullSafe(F.col("target_chapter")))


def redirect_chapters(edges: DataFrame, nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Ends in collapsed chapters (project_id, chapter) become ``chapter:<name>``; what then lies
    inside one drops out, and moved edges stay once by (source, target, kind)."""
    inside = nodes.join(collapsed.select("project_id", "chapter").distinct(), ["project_id", "chapter"], "left_semi")
    e = edges.join(_chapters(inside, "source", "__c1"), ["project_id", "source"], "left").join(_chapters(inside, "target", "__c2"), ["project_id", "target"], "left")
    s = F.when(F.col("__c1").isNull(), F.col("source")).otherwise(F.concat(F.lit("chapter:"), "__c1"))
    t = F.when(F.col("__c2").isNull(), F.col("target")).otherwise(F.concat(F.lit("chapter:"), "__c2"))
    moved = F.col("__c1").isNotNull() | F.col("__c2").isNotNull()
    e = e.withColumn("__s", s).withColumn("__t", t).withColumn("__moved", moved).where("not __moved or __s <> __t")
    key = F.when(F.col("__moved"), F.concat_ws("|", "__s", "__t", "kind")).otherwise(F.col("id"))
    w = Window.partitionBy("project_id", "__moved", key).orderBy("edge_ord")
    e = e.withColumn("__nth", F.row_number().over(w)).where("__nth = 1")
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return e.select(*rest, F.col("__s").alias("source"), F.col("__t").alias("target"))


#: The kind of a composed edge is the strongest of its parts.
STRENGTH = {"call_return": 3, "call": 2, "jump": 1}


def collapse_menus(edges: DataFrame, menus: DataFrame, most_steps: int = 1000) -> DataFrame:
    """Removes menus (project_id, id) and composes the edges through them: last non-empty label,
    strongest kind, conditions and-ed; the same edge once.

    A way never passes a menu twice. ``edges``: id, source, target, kind, label, expression.
    """
    inner = cut(menus.select("project_id", "id").distinct())
    cols = ["project_id", "source", "target", "kind", "label", "expression"]
    e = cut(edges.select(*cols, "edge_ord"))
    seen = F.array("target")
    level = e.join(inner.withColumnRenamed("id", "source"), ["project_id", "source"], "left_anti").select(*cols, "edge_ord", seen.alias("way"))
    done, step = [], 0
    level = cut(level)
    while not level.isEmpty() and step < most_steps:
        step += 1
        done.append(level.join(inner.withColumnRenamed("id", "target"), ["project_id", "target"], "left_anti"))
        stuck = level.join(inner.withColumnRenamed("id", "target"), ["project_id", "target"], "left_semi")
        nxt = e.select("project_id", F.col("source").alias("target"), F.col("target").alias("t2"), F.col("kind").alias("k2"), F.col("label").alias("l2"), F.col("expression").alias("x2"))
        rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in STRENGTH.items()], F.lit(0))
        both = F.concat(F.lit("("), "expression", F.lit(") and ("), "x2", F.lit(")"))
        level = cut(stuck.join(nxt, ["project_id", "target"]).where(~F.array_contains("way", F.col("t2"))).select(
            "project_id", "source", F.col("t2").alias("target"), F.when(rank("k2") > rank("kind"), F.col("k2")).otherwise(F.col("kind")).alias("kind"),
            F.when(present(F.col("l2")), F.col("l2")).otherwise(F.col("label")).alias("label"),
            F.when(F.col("expression").isNotNull() & F.col("x2").isNotNull(), both).otherwise(F.coalesce("expression", "x2")).alias("expression"),
            "edge_ord", F.array_append("way", F.col("t2")).alias("way"),
        ).distinct())
    whole = reduce(DataFrame.unionAll, [x.select(*cols, "edge_ord") for x in done]) if done else e.limit(0)
    return whole.groupBy(*cols).agg(F.min("edge_ord").alias("edge_ord"))


def join_candidates(edges: DataFrame) -> DataFrame:
    """Nodes where all branches of a fork meet again, and into which nothing else leads."""
    pairs = cut(edges.select("project_id", "source", "target").distinct())
    forks = pairs.groupBy("project_id", F.col("source").alias("fork")).agg(F.count("*").alias("branches")).where("branches > 1")
    first = pairs.select("project_id", F.col("source").alias("fork"), F.col("target").alias("mid"))
    second = pairs.select("project_id", F.col("source").alias("mid"), F.col("target").alias("rejoin"))
    met = first.join(second, ["project_id", "mid"]).groupBy("project_id", "fork", "rejoin").agg(F.count("*").alias("n"))
    inflow = pairs.groupBy("project_id", F.col("target").alias("rejoin")).agg(F.count("*").alias("inflow"))
    # every edge into the meeting point comes from a branch: as many as there are branches
    return met.join(forks, ["project_id", "fork"]).join(inflow, ["project_id", "rejoin"]).where("n = branches and inflow = branches").select("project_id", "fork", "rejoin", "branches")
