"""Views of a graph: what is visible under filters, and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE_NODES, LARGE_EDGES = 180, 320


def matches(query: str, in_lines: bool = False) -> Column:
    """Case-insensitive part of the label, the dialogue count itself, or part of a line."""
    q = F.lit(query.strip().lower())
    hit = F.lower(F.coalesce("label", F.lit(""))).contains(q) | (F.col("dialogue_count").cast("string") == q)
    return hit | F.exists("dialogue_lines", lambda x: F.lower(x).contains(q)) if in_lines else hit


def simple_search(nodes: DataFrame, query: str, in_lines: bool = False) -> DataFrame:
    return nodes.where(matches(query, in_lines))


def visible_nodes(nodes: DataFrame, query: str = "", min_dialogue: int = 0, collapsed_chapters: DataFrame | None = None, collapsed_labels: DataFrame | None = None, hidden_ids: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``hidden``: chapter or parent collapsed, hidden by a condition, not matching
    the search, or with too little dialogue."""
    n, hidden = nodes, F.lit(False)
    for frame, keys, own, name in ((collapsed_chapters, ["chapter"], "chapter", "__c"), (collapsed_labels, ["id"], "parent_label_id", "__l"), (hidden_ids, ["id"], "id", "__h")):
        if frame is not None:
            marks = frame.select("project_id", F.col(keys[0]).alias(own)).distinct().withColumn(name, F.lit(True))
            n = n.join(marks, ["project_id", own], "left")
            hidden = hidden | F.coalesce(name, F.lit(False))
    if query.strip():
        hidden = hidden | ~matches(query)
    if min_dialogue > 0:
        hidden = hidden | (F.coalesce("dialogue_count", F.lit(0)) < min_dialogue)
    return n.select(*[nodes[c] if c not in ("project_id", "chapter", "id", "parent_label_id") else F.col(c) for c in nodes.columns], hidden.alias("hidden"))


def chapter_rows(nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Chapters with their visible nodes; hidden if there is none and they aren't collapsed."""
    n = nodes.groupBy("project_id", "chapter").agg(F.count_if(~F.col("hidden")).alias("visible"), F.count("*").alias("nodes"))
    c = n.join(collapsed.select("project_id", "chapter").distinct().withColumn("__c", F.lit(True)), ["project_id", "chapter"], "left")
    return c.select("project_id", "chapter", "visible", "nodes", ((F.col("visible") == 0) & F.col("__c").isNull()).alias("hidden"))


def visible_edges(edges: DataFrame, shown: DataFrame, kinds: tuple[str, ...] | None = None, call_returns: bool = True, viewport: DataFrame | None = None, large: bool = False, hide_unreachable: DataFrame | None = None) -> DataFrame:
    """Edges of the chosen kinds between shown nodes, with an end in the viewport; those of ids in
    ``hide_unreachable`` drop out; sequence edges lose their labels in large graphs."""
    ids = shown.select("project_id", "id").distinct()
    e = edges if kinds is None else edges.where(F.coalesce("kind", F.lit("sequence")).isin(*kinds))
    if not call_returns:
        e = e.where("kind <> 'call_return'")
    if hide_unreachable is not None:
        e = e.join(hide_unreachable.select("project_id", "id").distinct(), ["project_id", "id"], "left_anti")
    for side in ("source", "target"):
        e = e.join(ids.withColumnRenamed("id", side), ["project_id", side], "left_semi")
    if viewport is not None:
        port = viewport.select("project_id", "id").distinct()
        a = e.join(port.select("project_id", F.col("id").alias("source"), F.lit(True).alias("__a")), ["project_id", "source"], "left")
        e = a.join(port.select("project_id", F.col("id").alias("target"), F.lit(True).alias("__b")), ["project_id", "target"], "left").where("__a or __b").drop("__a", "__b")
    if large:
        e = e.withColumn("label", F.when(F.coalesce("kind", F.lit("sequence")) == "sequence", F.lit("")).otherwise(F.col("label")))
    return e


def scope(nodes: DataFrame, chapters: tuple[str, ...] = (), types: tuple[str, ...] = (), min_dialogue: int = 0) -> DataFrame:
    """Nodes within the chosen chapters and types, with enough dialogue."""
    n = nodes.where(F.col("chapter").isin(*chapters)) if chapters else nodes
    n = n.where(F.col("type").isin(*types)) if types else n
    return n.where(F.coalesce("dialogue_count", F.lit(0)) >= min_dialogue)


def collapsed_children(nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Menus whose parent label is collapsed."""
    return nodes.where("type = 'MENU'").join(collapsed.select("project_id", F.col("id").alias("parent_label_id")).distinct(), ["project_id", "parent_label_id"], "left_semi")


def filter_routes(routes: DataFrame, query: str) -> DataFrame:
    """Routes whose id, ending or a choice holds the text."""
    q = F.lit(query.lower())
    return routes.where(F.lower("route_id").contains(q) | F.lower("ending").contains(q) | F.exists("choices", lambda c: F.lower(c).contains(q)))


def solver_candidates(nodes: DataFrame, query: str = "") -> DataFrame:
    """Nodes a route may be asked for: neither shadowed nor broken, with the text in id, label or chapter."""
    q = F.lit(query.lower())
    n = nodes.where("not coalesce(is_shadowed, false) and type <> 'SYNTAX_ERROR'")
    return n.where(F.lower("id").contains(q) | F.lower(F.coalesce("label", F.lit(""))).contains(q) | F.lower(F.coalesce("chapter", F.lit(""))).contains(q))


def default_target(nodes: DataFrame) -> DataFrame:
    """The first terminal node of each project, else its first node."""
    rank = F.struct((~F.coalesce("is_terminal_outcome", F.lit(False))).alias("r"), "node_ord")
    return nodes.groupBy("project_id").agg(F.min_by("id", rank).alias("id"))


def large_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("project_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("project_id").agg(F.count("*").alias("edges"))
    j = n.join(e, "project_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))
    return j.withColumn("large", (F.col("nodes") > LARGE_NODES) | (F.col("edges") > LARGE_EDGES))


def view_metrics(nodes: DataFrame) -> DataFrame:
    """Total and visible nodes, words and pauses of nodes with ``hidden``."""
    seen = ~F.col("hidden")
    return nodes.groupBy("project_id").agg(
        F.count("*").alias("nodes"), F.count_if(seen).alias("visible_nodes"), F.sum("word_count").cast("long").alias("words"), F.sum(F.when(seen, F.col("word_count"))).cast("long").alias("visible_words"),
        F.sum("pause_duration").alias("pause"), F.sum(F.when(seen, F.col("pause_duration"))).alias("visible_pause"),
    )


def chapter_matches(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Number of found nodes by chapter."""
    return nodes.join(found.select("project_id", "id").distinct(), ["project_id", "id"], "left_semi").groupBy("project_id", "chapter").agg(F.count("*").alias("matches"))


def chapter_list(nodes: DataFrame) -> DataFrame:
    return nodes.select("project_id", "chapter").distinct().orderBy("project_id", "chapter")


def label_list(nodes: DataFrame, first: int) -> DataFrame:
    """The first label ids of each project."""
    w = Window.partitionBy("project_id").orderBy("id")
    return nodes.where("type = 'LABEL'").select("project_id", "id").distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= first)
