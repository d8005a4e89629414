"""Linear chains: monologues, and collapsing chains to their heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import reading_seconds
from loomgraph.plans.frontier import chain_heads, live, present
from loomgraph.plans.lineage import cut

LINES, WORDS = 30, 500


def _single(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of their source and the only one into their target."""
    out = edges.groupBy("project_id", "source").count().where("count = 1").drop("count")
    into = edges.groupBy("project_id", "target").count().where("count = 1").drop("count")
    return edges.join(out, ["project_id", "source"], "left_semi").join(into, ["project_id", "target"], "left_semi")


def monologue_sections(nodes: DataFrame, edges: DataFrame, wpm: float = 200.0) -> DataFrame:
    """Chains of story labels over plain live sequence and jump edges, with ``LINES`` lines or
    ``WORDS`` words or more: start, end, nodes, lines, words, reading seconds, chapter of the start."""
    story = nodes.where("type = 'LABEL' and role = 'story'").select("project_id", "id")
    plain = _single(live(edges)).where(F.col("kind").isin("sequence", "jump") & ~present(F.col("label")) & F.col("expression").isNull() & (F.col("source") != F.col("target")))
    ok = plain.join(story.withColumnRenamed("id", "source"), ["project_id", "source"], "left_semi").join(story.withColumnRenamed("id", "target"), ["project_id", "target"], "left_semi")
    heads = chain_heads(cut(ok.select("project_id", "source", "target")))
    placed = nodes.join(story, ["project_id", "id"], "left_semi").join(heads.select("project_id", F.col("node").alias("id"), "head", "pos"), ["project_id", "id"], "left")
    placed = placed.withColumn("head", F.coalesce("head", "id")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    by = placed.groupBy("project_id", "head").agg(F.max_by("id", "pos").alias("end"), F.min_by("chapter", "pos").alias("chapter"), F.count("*").alias("nodes"), F.sum("dialogue_count").cast("long").alias("lines"), F.sum("word_count").cast("long").alias("words"), F.sum("pause_duration").alias("pause"))
    kept = by.where((F.col("lines") >= LINES) | (F.col("words") >= WORDS))
    return kept.select("project_id", F.col("head").alias("start"), "end", "chapter", "nodes", "lines", "words", reading_seconds(F.col("words"), F.col("pause"), wpm).alias("reading_seconds"))


def collapse_chains(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ("start",)) -> tuple[DataFrame, DataFrame]:
    """Merges chains of labels of one chapter into their heads: sums, ids in order; edges are moved
    to the heads as ``<id>__collapsed``, with one ``__collapsed_loop`` edge per head."""
    n = nodes.where("type = 'LABEL'").select("project_id", "id", "chapter")
    e = _single(edges).where(F.col("kind").isin("sequence", "jump", "fallthrough") & ~present(F.col("label")) & F.col("expression").isNull() & (F.col("source") != F.col("target")) & ~F.col("source").isin(*keep) & ~F.col("target").isin(*keep))
    e = e.join(n.select("project_id", F.col("id").alias("source"), F.col("chapter").alias("c1")), ["project_id", "source"]).join(n.select("project_id", F.col("id").alias("target"), F.col("chapter").alias("c2")), ["project_id", "target"]).where(F.col("c1").eqNullSafe(F.col("c2")))
    inner = cut(e.select("project_id", "source", "target"))
    heads = cut(chain_heads(inner))
    placed = nodes.join(heads.select("project_id", F.col("node").alias("id"), "head", "pos"), ["project_id", "id"], "left").withColumn("head", F.coalesce("head", "id")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    merged = placed.groupBy("project_id", F.col("head").alias("id")).agg(
        F.min_by("type", "pos").alias("type"), F.min_by("label", "pos").alias("label"), F.min_by("chapter", "pos").alias("chapter"), F.sum("dialogue_count").cast("long").alias("dialogue_count"),
        F.sum("word_count").cast("long").alias("word_count"), F.sum("pause_duration").alias("pause_duration"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("collapsed_node_ids"),
    )
    head = heads.select("project_id", F.col("node").alias("source"), F.col("head").alias("h1"))
    head2 = heads.select("project_id", F.col("node").alias("target"), F.col("head").alias("h2"))
    outer = edges.join(inner.withColumn("__inner", F.lit(True)), ["project_id", "source", "target"], "left").where("__inner is null").drop("__inner")
    moved = outer.join(head, ["project_id", "source"], "left").join(head2, ["project_id", "target"], "left")
    s, t = F.coalesce("h1", "source"), F.coalesce("h2", "target")
    changed = (s != F.col("source")) | (t != F.col("target"))
    loop = changed & (s == t)
    out = moved.select("project_id", "edge_ord", F.when(loop, F.concat(s, F.lit("__collapsed_loop"))).when(changed, F.concat("id", F.lit("__collapsed"))).otherwise(F.col("id")).alias("id"), s.alias("source"), t.alias("target"), "kind", "label", "expression")
    loops = out.where("id like '%\\\\_\\\\_collapsed\\\\_loop'").groupBy("project_id", "id").agg(*[F.min_by(c, "edge_ord").alias(c) for c in ("source", "target", "kind", "label", "expression")], F.min("edge_ord").alias("edge_ord"))
    rest = out.where("id not like '%\\\\_\\\\_collapsed\\\\_loop'")
    return merged, rest.unionByName(loops)
