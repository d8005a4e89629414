"""One table of diagnostics: what the lints of a linked story find, with code, severity, category and place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import condition_refs
from loomgraph.operators import link, variables
from loomgraph.operators.story import Story, initial_names

#: Codes of diagnostics; each other category has the code ``normalization``.
OWN_CODE = ("dynamic_target", "shadowed_label", "unresolved_target", "missing_asset", "unmapped_screen_action")
#: Columns of the table besides ``id``.
PLACE = ("project_id", "code", "severity", "category", "path", "line_no", "source_id", "target_id", "edge_id", "detail")


def of(rows: DataFrame, category: str, severity: str = "warning", **place: Column) -> DataFrame:
    """Rows of one family as diagnostics; places that aren't given are null. ``id`` is the same for the same finding."""
    kinds = {"line_no": "int"}
    values = {"project_id": F.col("project_id"), "code": F.lit(category if category in OWN_CODE else "normalization"), "severity": F.lit(severity), "category": F.lit(category), **place}
    out = rows.select(*[values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in PLACE])
    return out.withColumn("id", F.sha2(F.to_json(F.struct(*PLACE)), 256))


def collect(story: Story) -> DataFrame:
    """All families over a linked story: shadowed labels and jumps or calls of them, unresolved and dynamic targets, calls of what doesn't
    return, options that are never taken, unmapped actions of screens, variables without a use or without a declaration. Each id once.
    """
    nodes, edges = story.nodes, story.edges
    at = lambda df, key: df.join(edges.select("project_id", F.col("id").alias(key), "path", "line_no"), ["project_id", key], "left")
    on_edge = {"path": F.col("path"), "line_no": F.col("line_no"), "source_id": F.col("source"), "target_id": F.col("target"), "edge_id": F.col("edge_id")}
    dead = edges.where("condition_is_statically_false").join(nodes.where("type = 'MENU'").select("project_id", F.col("id").alias("source"), F.lit(True).alias("menu")), ["project_id", "source"], "left")
    dead = dead.where("menu or kind = 'jump'").withColumn("edge_id", F.col("id"))
    declared, used = story.names, edges.where("expression is not null").select("project_id", F.col("id").alias("edge_id"), "source", "target", "path", "line_no", F.explode(condition_refs(F.col("expression"))).alias("name"))
    families = [
        of(nodes.where("is_shadowed"), "shadowed_label", path=F.col("path"), line_no=F.col("line_no"), source_id=F.col("id"), target_id=F.col("shadow_of_id"), detail=F.col("label")),
        of(at(link.unresolved_targets(edges, nodes), "edge_id"), "unresolved_target", **on_edge),
        of(at(link.dangling_calls(edges, story.returning), "edge_id"), "dangling_stack", **on_edge),
        of(at(link.shadowed_targets(edges, nodes.withColumn("id", F.coalesce("shadow_of_id", "id"))), "edge_id"), "shadowed_target_resolution", **on_edge),
        of(dead, "dead_menu_option", detail=F.coalesce("label", "target"), **on_edge),
        of(story.dynamic, "dynamic_target", path=F.col("path"), line_no=F.col("line_no"), source_id=F.col("source"), detail=F.col("expression")),
        *[of(story.actions.where(F.col("category") == c), c, path=F.col("path"), line_no=F.col("line_no"), source_id=F.col("screen"), detail=F.coalesce("name", "action")) for c in ("unmapped_screen_action", "dynamic_target")],
        of(variables.unused_variables(declared, initial_names(story, used)), "unused_variable", detail=F.col("name")),
        of(variables.undeclared_variables(declared, used), "undeclared_variable", detail=F.col("name"), **on_edge),
    ]
    return reduce(DataFrame.unionByName, families).dropDuplicates(["project_id", "id"])


def report(found: DataFrame) -> DataFrame:
    """Counts by code, category and severity, with subtotals by code and in all (null for what is summed up)."""
    return found.rollup("project_id", "code", "category", "severity").agg(F.count("*").alias("n")).where("project_id is not null and (severity is not null or category is null)")
