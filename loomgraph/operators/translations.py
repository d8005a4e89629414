"""Translations: localized lines and labels, ids of blocks, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import extract_literal


def scan(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strings and dialogue of translation files, given their lines (project_id, path, line_no, text).

    ``translate <lang> strings:`` blocks pair ``old`` and ``new``; other blocks
    (``translate <lang> <id>:``) hold say lines. Comments and other statements are skipped; a
    string must end on its line.
    """
    head = r"^translate\s+(\S+)\s+(\S+?)\s*:"
    w = Window.partitionBy("project_id", "path").orderBy("line_no")
    text = F.trim("text")
    marked = lines.withColumn("t", text).withColumn("lang0", F.when(F.col("t").rlike(head), F.lower(F.regexp_extract("t", head, 1)))).withColumn("block0", F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 2)))
    in_block = marked.withColumn("lang", F.last("lang0", True).over(w)).withColumn("block_id", F.last("block0", True).over(w)).where("lang0 is null and lang is not null and t not like '#%' and t <> ''")
    pair = r"^(old|new)\s+(.*)$"
    s = in_block.where("block_id = 'strings'").where(F.col("t").rlike(pair)).withColumn("side", F.regexp_extract("t", pair, 1)).withColumn("value", extract_literal(F.regexp_extract("t", pair, 2)))
    s = s.withColumn("old", F.when(F.lag("side").over(w) == "old", F.lag("value").over(w))).where("side = 'new' and old is not null").select("project_id", "lang", "old", F.col("value").alias("new"))
    say = r'^(?:[A-Za-z_][\w.]*(?:\s+[\w@-]+)*\s+)?("[^"\\]*+(?:\\.[^"\\]*+)*+"|\x27[^\x27\\]*+(?:\\.[^\x27\\]*+)*+\x27)\s*(?:with\s+\w+|nointeract)?$'
    d = in_block.where("block_id <> 'strings'").where(F.col("t").rlike(say) & ~F.col("t").rlike(r"^(old|new|voice|play|stop|queue|show|scene|hide|with)\s"))
    by = Window.partitionBy("project_id", "lang", "block_id").orderBy("path", "line_no")
    d = d.select("project_id", "lang", "block_id", F.regexp_replace("block_id", "_[0-9a-f]{8}$", "").alias("base_label"), F.row_number().over(by).alias("line_index"), extract_literal(F.regexp_extract("t", say, 1)).alias("text"))
    return s, d


def localized_lines(lines: DataFrame, dialogue: DataFrame, lang: str) -> DataFrame:
    """Lines in a language: by the node's block, else by its label, else as they are."""
    tl = dialogue.where(F.col("lang") == lang)
    by_node = tl.select("project_id", F.col("block_id").alias("node_id"), "line_index", F.col("text").alias("__n"))
    w = Window.partitionBy("project_id", "base_label").orderBy("block_id", "line_index")
    by_label = tl.withColumn("line_index", F.row_number().over(w)).select("project_id", F.col("base_label").alias("label"), "line_index", F.col("text").alias("__l"))
    j = lines.join(by_node, ["project_id", "node_id", "line_index"], "left").join(by_label, ["project_id", "label", "line_index"], "left")
    return j.select(*[F.col(c) for c in lines.columns if c != "text"], F.coalesce("__n", "__l", "text").alias("text"))


def localized_labels(rows: DataFrame, strings: DataFrame, lang: str, column: str = "label") -> DataFrame:
    """``rows`` with a label replaced by its translation, if there is one; the last one counts."""
    s = strings.where(F.col("lang") == lang).groupBy("project_id", F.col("old").alias(column)).agg(F.max("new").alias("__new"))
    return rows.join(s, ["project_id", column], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def canonical_ids(blocks: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """The node of each block id: itself, else without its hash, else by alias, else as it is."""
    ids = nodes.select("project_id", "id").distinct()
    bare = F.regexp_replace("block_id", "_[0-9a-f]{8}$", "")
    j = blocks.withColumn("__bare", bare)
    j = j.join(ids.select("project_id", F.col("id").alias("block_id"), F.lit(True).alias("__a")), ["project_id", "block_id"], "left")
    j = j.join(ids.select("project_id", F.col("id").alias("__bare"), F.lit(True).alias("__b")), ["project_id", "__bare"], "left")
    j = j.join(aliases.select("project_id", F.col("alias").alias("__bare"), F.col("id").alias("__c")), ["project_id", "__bare"], "left")
    node = F.when(F.col("__a"), F.col("block_id")).when(F.col("__b"), F.col("__bare")).otherwise(F.coalesce("__c", "block_id"))
    return j.select(*[F.col(c) for c in blocks.columns], node.alias("node_id"))


def coverage(lines: DataFrame, dialogue: DataFrame, languages: list[str]) -> DataFrame:
    """Lines with and without a translation by language; ``languages`` are few."""
    have = dialogue.select("project_id", F.col("block_id").alias("node_id"), "line_index", "lang").distinct().withColumn("__t", F.lit(1))
    all_ = lines.select("project_id", "node_id", "line_index", F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang"))
    j = all_.join(have, ["project_id", "node_id", "line_index", "lang"], "left")
    return j.groupBy("project_id", "lang").agg(F.count("__t").alias("translated"), F.count_if(F.col("__t").isNull()).alias("missing"))
