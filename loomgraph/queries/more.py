"""Queries of the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import conditions as C
from loomgraph.functions import text as T
from loomgraph.operators import analytics, exports, link, search, view
from loomgraph.plans import adapters as ad
from loomgraph.queries import query
from loomgraph.queries.extra import PATHS, _all_routes, _statements
from loomgraph.queries.graph import REACH, _dag_sql
from loomgraph.sources import extract, scripts

with_ = ad.with_


@query(with_("dialogue", body="SELECT node_id AS id, line_no, text FROM dialogue WHERE node_ord % 4 = 0"))
def j17_node_details(spark, d):
    lines = ad.dialogue(spark, d).withColumnRenamed("node_id", "id")
    chosen = lines.where("node_ord % 4 = 0").select("project_id", "id")
    return link.node_details(lines, chosen).select("id", "line_no", "text")


@query(with_("dialogue", body="SELECT DISTINCT node_id FROM dialogue WHERE node_ord % 7 = 0 OR speaker = 'system'"))
def u4_match_union(spark, d):
    lines = ad.dialogue(spark, d)
    return search.match_union(lines.where("node_ord % 7 = 0"), lines.where("speaker = 'system'")).select("node_id")


@query(_dag_sql("SELECT array_to_string(path, '>') AS path FROM paths p JOIN sinks ON sinks.id = p.at WHERE list_has_any(opts, ['opt3']) OR contains(p.at, 'opt3')", REACH.strip() + ", " + PATHS))
def p6_route_filter(spark, d):
    r = _all_routes(spark, d)[3].withColumn("choices", F.transform("choices", lambda c: F.coalesce(c["text"], F.lit(""))))
    return view.filter_routes(r, "opt3").select(F.array_join("path", ">").alias("path"))


@query(with_("nodes", body="SELECT id FROM nodes WHERE contains(lower(label), 'ring') OR contains(id, 'ring') OR contains(lower(chapter), 'ring')"))
def p7_solver_candidates(spark, d):
    return view.solver_candidates(ad.nodes(spark, d), "Ring").select("id")


@query(with_("nodes", body="SELECT min_by(id, node_ord) AS id FROM nodes WHERE type = 'MENU'"))
def p7_default_target(spark, d):
    n = ad.nodes(spark, d)
    return view.default_target(n.withColumn("is_terminal_outcome", F.col("type") == "MENU")).select("id")


@query("SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS all_true, p_size % 3 <> 0 OR false AS all_known FROM part")
def p9_flag_filter(spark, d):
    a = F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")
    b = F.when(F.col("p_size") % 3 == 0, "unknown").otherwise("true")
    flags = F.create_map(F.lit("fa"), a, F.lit("fb"), b, F.lit("fc"), F.lit("unknown"))
    refs = T.condition_refs(F.lit("fa and fb"))
    kept = C.flags_in(flags, refs)
    return ad.table(spark, d, "part").select("p_partkey", C.all_true(kept, refs).alias("all_true"), C.all_known(kept, refs).alias("all_known"))


@query(_dag_sql("SELECT id AS node_id, CASE WHEN node_ord % 3 = 0 THEN 'true' ELSE 'normal' END AS ending_type FROM sinks", REACH.replace("SELECT id FROM dag_nodes", "SELECT id, node_ord FROM dag_nodes")))
def d2_custom_tags(spark, d):
    n, e = ad.dag(spark, d)
    tags = n.where("node_ord % 3 = 0").select("project_id", "id", F.lit("true").alias("ending_type"))
    return analytics.terminal_endings(n, e, tags).select("node_id", "ending_type")


@query(with_("nodes", body="SELECT id AS node_id, CASE WHEN label LIKE '%bolt' THEN 'metal' WHEN regexp_matches(label, 'red|blue') THEN 'colour' ELSE 'normal' END AS ending_type FROM nodes WHERE role = 'story'"))
def d1_ending_rules(spark, d):
    n, e = ad.nodes(spark, d), ad.edges(spark, d).limit(0)
    rules = [("bolt$", "metal"), ("red|blue", "colour")]
    return analytics.terminal_endings(n, e, rules=rules).select("node_id", "ending_type")


@query("SELECT l_orderkey AS head, min(l_linenumber) AS start_line, max(l_linenumber + l_partkey % 5) AS end_line FROM lineitem GROUP BY l_orderkey")
def a17_combined_locations(spark, d):
    li = ad.table(spark, d, "lineitem").select(F.lit("p").alias("project_id"), F.col("l_orderkey").alias("head"), F.lit("f").alias("file"), F.col("l_linenumber").alias("start_line"), F.lit(0).alias("start_char"), (F.col("l_linenumber") + F.col("l_partkey") % 5).alias("end_line"), F.lit(0).alias("end_char"))
    return analytics.combined_locations(li).select("head", "start.start_line", "end.end_line")


@query("SELECT 'r' || o_orderkey AS section, CAST(1 AS BIGINT) AS ord, '1. **' || o_orderstatus || '**' AS line FROM orders UNION ALL SELECT 'r' || o_orderkey, 2, '2. **' || o_orderpriority || '**' FROM orders")
def k5_walkthrough(spark, d):
    o = ad.table(spark, d, "orders").select(F.lit("p").alias("project_id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("route_id"), F.array("o_orderstatus", "o_orderpriority").alias("steps"))
    return exports.walkthrough(o).select("section", "ord", "line")


@query(with_("edges", "nodes", body="SELECT '| **' || chapter || '**' AS line, CAST(1 AS BIGINT) AS n FROM nodes GROUP BY chapter"))
def k2_markdown(spark, d):
    """Chapters of the report over the whole graph; ``k2_report`` has the whole text."""
    n, e, said = ad.nodes(spark, d), ad.edges(spark, d), ad.dialogue(spark, d)
    ends = analytics.terminal_endings(n, e)
    no_routes = spark.createDataFrame([], "project_id string, ending string, words long, pause double, route_ord long")
    no_points = spark.createDataFrame([], "project_id string, edge_id string, source string, target string, eliminated array<string>, is_lock_in boolean")
    summary = analytics.narrative_summary(n, e, ends, no_routes, no_points)
    lines = exports.analytics_markdown(summary, analytics.ending_matrix(ends, no_routes), no_points, analytics.chapter_pacing(n, e), analytics.character_distribution(said), n, e)
    chapters = lines.where("section = '4 pacing' and line like '| **%'")
    return chapters.select(F.call_function("substring_index", F.col("line"), F.lit(" |"), F.lit(1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(text, chr(10), ' ', 'g') || ' ' AS code FROM (SELECT doc_id, regexp_replace(text, '[\"''#]', '', 'g') AS text FROM documents)")
def x1_strip_comments(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", r"[\"'#]", ""), r"\n", " ")
    return ad.table(spark, d, "documents").select("doc_id", extract.strip_comment(F.concat(t, F.lit(" # \"tail' #"))).alias("code"))


@query(with_("dialogue", body="SELECT node_id AS label_id, count(*) % 2 = 0 AS has_menu FROM dialogue GROUP BY node_id"))
def x17_continuations(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d)).withColumn("content", F.concat("content", F.lit('\n    user "after"\n')))
    s = extract.segments(extract.statements(scripts.file_lines(files)))
    last = s.where("kind = 'say'").groupBy("label_id").agg(F.max_by("segment_id", "line_no").alias("segment_id"))
    return last.select("label_id", F.col("segment_id").contains("__cont_L").alias("has_menu"))


@query(with_("dialogue", body="SELECT node_id AS label_id, 'terminal' AS rule_kind FROM dialogue GROUP BY node_id"))
def x20_custom_statements(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d)).withColumn("content", F.concat("content", F.lit("\n    gameover now\n    unknown thing\n")))
    rules = spark.createDataFrame([("^gameover", "terminal", 1), ("^game", "branch", 2)], "pattern string, rule_kind string, ord int")
    return extract.custom_statements(extract.statements(scripts.file_lines(files)), rules).select("label_id", "rule_kind")


@query(with_("dialogue", body="SELECT node_id AS parent_label_id FROM dialogue GROUP BY node_id, node_ord HAVING node_ord % 2 = 0"))
def x7_pruned_decisions(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d))
    tail = F.when(F.col("file_ord") % 2 == 0, "\n    if ready:\n        jump other\n").otherwise("\n    if ready:\n        $ x = 1\n")
    s = extract.statements(scripts.file_lines(files.withColumn("content", F.concat("content", tail))))
    return extract.prune_dead_ends(extract.decisions(s), s).select("parent_label_id")


@query("SELECT p_size, CAST(CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS VARCHAR) AS always FROM (SELECT DISTINCT p_size FROM part)")
def f11_always(spark, d):
    e = ad.table(spark, d, "part").select("p_size").distinct()
    text = F.concat(F.col("p_size").cast("string"), F.lit(" % 3 == 0 or ("), F.col("p_size").cast("string"), F.lit(" % 3 == 2 and unknown_flag)"))
    return e.select("p_size", C.always_column(text).cast("string").alias("always"))


@query("SELECT source AS project_id, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def r2_running_metrics(spark, d):
    """Running counts of a stream of files, in complete mode until all of it is read."""
    import uuid

    from loomgraph.plans.lineage import shared_dir
    from loomgraph.streaming import ingest

    base = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    files = scripts.from_documents(ad.table(spark, d, "documents")).select("project_id", "path", "content", F.timestamp_seconds(F.lit(1_700_000_000)).alias("arrived"))
    files.write.parquet(f"{base}/in")
    counts = ingest.running_counts(ingest.file_stream(spark, f"{base}/in"))
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    run.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
