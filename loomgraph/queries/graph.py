"""Queries over the story graph of parts and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import analytics, chains, collapse, integrity, link, view
from loomgraph.plans import adapters as ad
from loomgraph.plans.frontier import closure, reach_bits, reaches
from loomgraph.queries import query

with_ = ad.with_
#: DuckDB: (node, ending) pairs of the sparse forward graph.
REACH = """
sinks AS (SELECT id FROM dag_nodes n WHERE type = 'LABEL' AND NOT EXISTS (SELECT 1 FROM dag_edges e WHERE e.source = n.id)),
reach AS (SELECT id AS node, id AS ending FROM sinks UNION SELECT e.source, r.ending FROM reach r JOIN dag_edges e ON e.target = r.node)
"""


def _dag_sql(body: str, more: str = "") -> str:
    return with_("edges", "nodes", "dag_edges", "dag_nodes", body="", recursive=True).rstrip() + (", " + more if more else "") + " " + body


def _ends(spark, d):
    n, e = ad.dag(spark, d)
    ends = analytics.terminal_endings(n, e)
    return n, e, ends


@query(with_("edges", "nodes", body="""
SELECT e.id, e.source, e.target, s.type AS source_type, s.chapter AS source_chapter, t.type AS target_type, t.chapter AS target_chapter
FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id"""))
def j1_attach_endpoints(spark, d):
    return link.attach_endpoints(ad.edges(spark, d), ad.nodes(spark, d)).select("id", "source", "target", "source_type", "source_chapter", "target_type", "target_chapter")


@query(with_("edges", "nodes", body="SELECT id AS edge_id, source, target, 'unresolved_target' AS category FROM edges WHERE kind IN ('jump', 'call') AND target NOT IN (SELECT id FROM nodes WHERE word_count % 10 <> 0)"))
def j2_unresolved_targets(spark, d):
    return link.unresolved_targets(ad.edges(spark, d), ad.nodes(spark, d).where("word_count % 10 <> 0")).drop("project_id")


@query(with_("edges", "nodes", body="""
SELECT DISTINCT id, '(unresolved) ' || id AS label, '__unresolved__' AS chapter FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges)
WHERE id NOT IN (SELECT id FROM nodes WHERE word_count % 7 <> 0)"""))
def j3_placeholders(spark, d):
    return integrity.placeholders(ad.nodes(spark, d).where("word_count % 7 <> 0"), ad.edges(spark, d)).select("id", "label", "chapter")


@query(with_("edges", "nodes", body="""
SELECT edge_ord, id, source, target, kind, label, expression FROM (SELECT *, row_number() OVER (PARTITION BY kind, source, target, coalesce(label, ''), expression ORDER BY edge_ord) AS nth FROM edges) WHERE nth = 1"""))
def u2_graph_integrity(spark, d):
    return integrity.resolve(ad.nodes(spark, d), ad.edges(spark, d))[1].select("edge_ord", "id", "source", "target", "kind", "label", "expression")


@query(with_("edges", body="""
SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY source, target ORDER BY edge_ord) - 1 AS BIGINT) AS parallel_index, count(*) OVER (PARTITION BY source, target) AS parallel_count FROM edges WHERE source <> target) WHERE parallel_count > 1"""))
def w3_parallel_edges(spark, d):
    return integrity.parallel_index(ad.edges(spark, d)).select("id", "parallel_index", "parallel_count")


@query(with_("nodes", body="""
SELECT chapter, count(*) AS node_count, CAST(sum(dialogue_count) AS BIGINT) AS dialogue_count, CAST(sum(word_count) AS BIGINT) AS word_count, sum(pause_duration) AS pause_duration,
  count(*) FILTER (WHERE type = 'LABEL') AS label_count, count(*) FILTER (WHERE type = 'MENU') AS menu_count, count(*) FILTER (WHERE type = 'DECISION') AS decision_count FROM nodes GROUP BY chapter"""))
def a2_chapter_aggregates(spark, d):
    return analytics.chapter_aggregates(ad.nodes(spark, d)).drop("project_id")


@query(with_("edges", "nodes", body="SELECT n.chapter, count(*) AS choice_count FROM edges e JOIN nodes n ON e.source = n.id WHERE n.type = 'MENU' OR e.label <> '' GROUP BY n.chapter"))
def a4_choice_counts(spark, d):
    return analytics.choice_counts(ad.nodes(spark, d), ad.edges(spark, d)).drop("project_id")


PACING = """
SELECT n.chapter, n.lines, n.words, n.menus, coalesce(c.choices, 0) AS choices, CASE WHEN n.menus > 0 THEN round(n.lines / n.menus, 1) ELSE CAST(n.lines AS DOUBLE) END AS lines_per_menu,
  n.words / 200.0 * 60 + n.pause AS reading_seconds,
  CASE WHEN ceil((n.words / 200.0 * 60 + n.pause) / 60) < 60 THEN CAST(ceil((n.words / 200.0 * 60 + n.pause) / 60) AS BIGINT) || 'm'
    WHEN ceil((n.words / 200.0 * 60 + n.pause) / 60) % 60 > 0 THEN CAST(floor(ceil((n.words / 200.0 * 60 + n.pause) / 60) / 60) AS BIGINT) || 'h ' || CAST(ceil((n.words / 200.0 * 60 + n.pause) / 60) % 60 AS BIGINT) || 'm'
    ELSE CAST(floor(ceil((n.words / 200.0 * 60 + n.pause) / 60) / 60) AS BIGINT) || 'h' END AS reading_time
FROM (SELECT chapter, CAST(sum(dialogue_count) AS BIGINT) AS lines, CAST(sum(word_count) AS BIGINT) AS words, sum(pause_duration) AS pause, count(*) FILTER (WHERE type = 'MENU') AS menus FROM nodes GROUP BY chapter) n
LEFT JOIN (SELECT n.chapter, count(*) AS choices FROM edges e JOIN nodes n ON e.source = n.id WHERE n.type = 'MENU' OR e.label <> '' GROUP BY n.chapter) c ON n.chapter = c.chapter"""


@query(with_("edges", "nodes", body=PACING))
def a3_chapter_pacing(spark, d):
    return analytics.chapter_pacing(ad.nodes(spark, d), ad.edges(spark, d)).drop("project_id")


@query(with_("edges", "nodes", body="""
SELECT coalesce(i.id, o.id) AS id, coalesce(array_to_string(i.k, ','), '') AS kinds_in, coalesce(array_to_string(o.k, ','), '') AS kinds_out
FROM (SELECT target AS id, list_sort(list(DISTINCT kind)) AS k FROM edges GROUP BY target) i FULL JOIN (SELECT source AS id, list_sort(list(DISTINCT kind)) AS k FROM edges GROUP BY source) o ON i.id = o.id"""))
def a8_traffic_kinds(spark, d):
    t = link.traffic_kinds(ad.edges(spark, d))
    return t.select("id", F.array_join("kinds_in", ",").alias("kinds_in"), F.array_join("kinds_out", ",").alias("kinds_out"))


@query(with_("edges", "nodes", body="""
SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, i.c IS NULL AS is_root FROM nodes n
LEFT JOIN (SELECT target AS id, count(*) AS c FROM edges GROUP BY target) i ON n.id = i.id LEFT JOIN (SELECT source AS id, count(*) AS c FROM edges GROUP BY source) o ON n.id = o.id"""))
def a11_degree_stats(spark, d):
    return link.degree_stats(ad.nodes(spark, d), ad.edges(spark, d)).drop("project_id")


ROLES = """, ret AS (SELECT id FROM nodes WHERE word_count % 2 = 0), ext AS (SELECT e.*, s.type AS st FROM edges e LEFT JOIN nodes s ON e.source = s.id WHERE e.source <> e.target),
f AS (SELECT n.id, n.id IN (SELECT id FROM ret) AS returns,
  coalesce((SELECT bool_or(kind = 'call') FROM ext WHERE target = n.id), false) AS called, coalesce((SELECT bool_or(kind = 'call' AND st = 'MENU') FROM ext WHERE target = n.id), false) AS menu_called,
  coalesce((SELECT bool_or(kind IN ('sequence', 'jump', 'fallthrough')) FROM ext WHERE target = n.id), false) OR coalesce((SELECT bool_or(kind IN ('sequence', 'jump', 'fallthrough')) FROM ext WHERE source = n.id), false) AS traffic,
  (SELECT count(*) FROM ext WHERE source = n.id) AS n_out FROM nodes n WHERE n.type = 'LABEL'),
r AS (SELECT *, CASE WHEN returns AND NOT traffic AND NOT called THEN 'state_toggle' WHEN menu_called AND returns THEN 'detour' WHEN called AND returns AND NOT traffic THEN 'utility' ELSE 'story' END AS role FROM f)
SELECT id, role, role = 'story' AND NOT called AND (returns OR n_out = 0) AS is_terminal_outcome FROM r"""


@query(with_("edges", "nodes", body=ROLES))
def a9_classify_roles(spark, d):
    n = ad.nodes(spark, d)
    return link.classify_roles(n.withColumn("parent_label_id", F.lit(None).cast("string")), ad.edges(spark, d), n.where("word_count % 2 = 0")).drop("project_id")


@query(with_("edges", "nodes", body="""
SELECT e.id AS edge_id, e.source, e.target, 'dangling_call' AS category FROM edges e WHERE kind = 'call' AND target NOT IN (SELECT id FROM nodes WHERE word_count % 2 = 0)"""))
def j5_dangling_calls(spark, d):
    return link.dangling_calls(ad.edges(spark, d), ad.nodes(spark, d).where("word_count % 2 = 0")).drop("project_id")


CALLS = """, calls AS (SELECT e.*, 'ctx_' || e.id AS context FROM edges e WHERE kind = 'call' AND target IN (SELECT id FROM nodes WHERE word_count % 2 = 0)),
menus AS (SELECT id AS menu, 'p' || (node_ord - 1) AS parent FROM nodes WHERE type = 'MENU')
SELECT 'ret_' || context AS id, target AS source, source AS target FROM calls UNION ALL
SELECT 'ret_' || context || '__' || menu, menu, source FROM calls JOIN menus ON calls.target = menus.parent"""


@query(with_("edges", "nodes", body=CALLS))
def j4_call_returns(spark, d):
    n = ad.nodes(spark, d).withColumn("parent_label_id", F.concat(F.lit("p"), (F.col("node_ord") - 1).cast("string")))
    e = ad.edges(spark, d).withColumn("context", F.concat(F.lit("ctx_"), "id")).withColumn("return_target", F.col("source"))
    return link.call_returns(e, n, n.where("word_count % 2 = 0")).select("id", "source", "target")


@query(with_("edges", "nodes", body="""
SELECT e.id AS edge_id, e.source, e.target, 'shadowed_target' AS category FROM edges e WHERE kind IN ('jump', 'call')
AND target IN (SELECT 'p' || (node_ord % 500) FROM nodes WHERE type = 'LABEL' GROUP BY 1 HAVING count(*) > 1)"""))
def j6_shadowed_targets(spark, d):
    definitions = ad.nodes(spark, d).withColumn("id", F.concat(F.lit("p"), (F.col("node_ord") % 500).cast("string")))
    return link.shadowed_targets(ad.edges(spark, d), definitions).drop("project_id")


@query(with_("nodes", body="""
SELECT 'p' || (node_ord % 500) || CASE WHEN k > 1 AND type = 'LABEL' THEN '__shadow_' || k ELSE '' END AS id, node_ord, k > 1 AND type = 'LABEL' AS is_shadowed
FROM (SELECT *, row_number() OVER (PARTITION BY node_ord % 500 ORDER BY node_ord) AS k FROM nodes)"""))
def w1_shadow_labels(spark, d):
    n = ad.nodes(spark, d).withColumn("id", F.concat(F.lit("p"), (F.col("node_ord") % 500).cast("string"))).withColumn("file_ord", F.col("node_ord")).withColumn("line_no", F.lit(0))
    return integrity.shadow_labels(n).select("id", "node_ord", "is_shadowed")


@query(with_("nodes", body="""
SELECT 'p' || (node_ord % 500) AS id, node_ord, type FROM nodes WHERE type = 'LABEL' UNION ALL
SELECT id, node_ord, type FROM (SELECT 'p' || (node_ord % 500) AS id, node_ord, type, row_number() OVER (PARTITION BY node_ord % 500 ORDER BY node_ord) AS nth FROM nodes WHERE type <> 'LABEL') WHERE nth = 1"""))
def u1_union_fragments(spark, d):
    n = ad.nodes(spark, d).withColumn("id", F.concat(F.lit("p"), (F.col("node_ord") % 500).cast("string")))
    return integrity.union_fragments(n).select("id", "node_ord", "type")


FALL = """, labels AS (SELECT id, node_ord % 100 AS file_ord, node_ord AS line_no, 'c' || (node_ord % 100 // 3) AS chapter FROM nodes WHERE type = 'LABEL'),
files AS (SELECT file_ord, min_by(id, line_no) AS first, max_by(id, line_no) AS last, min(chapter) AS chapter FROM labels GROUP BY file_ord),
pairs AS (SELECT *, lead(first) OVER (ORDER BY file_ord) AS target, lead(chapter) OVER (ORDER BY file_ord) AS nc FROM files)
SELECT 'fall_' || last || '__' || target AS id, last AS source, target FROM pairs WHERE target IS NOT NULL AND chapter <> nc AND last NOT IN (SELECT source FROM edges WHERE edge_ord % 10 = 0)"""


@query(with_("edges", "nodes", body=FALL))
def j9_cross_file_fallthrough(spark, d):
    n = ad.nodes(spark, d).where("type = 'LABEL'").withColumn("file_ord", F.col("node_ord") % 100).withColumn("line_no", F.col("node_ord"))
    n = n.withColumn("chapter", F.concat(F.lit("c"), F.floor(F.col("file_ord") / 3).cast("string")))
    exits = ad.edges(spark, d).where("edge_ord % 10 = 0").select("project_id", "source").distinct().withColumn("file_ord", F.substring("source", 2, 20).cast("long") % 100)
    return link.cross_file_fallthrough(n, exits).select("id", "source", "target")


@query(_dag_sql("""SELECT n.id, m.id IS NULL AS is_orphan FROM dag_nodes n LEFT JOIN (SELECT DISTINCT id FROM met) m ON n.id = m.id""",
    """met AS (SELECT id FROM dag_nodes WHERE id NOT IN (SELECT target FROM dag_edges) UNION SELECT e.target FROM met JOIN dag_edges e ON e.source = met.id)"""))
def g1_orphans(spark, d):
    return link.orphans(*ad.dag(spark, d)).select("id", "is_orphan")


@query(_dag_sql("SELECT node_id, ending_type FROM (SELECT id AS node_id, 'normal' AS ending_type FROM sinks)", REACH))
def g2_terminal_endings(spark, d):
    return _ends(spark, d)[2].select("node_id", "ending_type")


@query(_dag_sql("SELECT node, ending FROM reach", REACH))
def g3_ending_reachability(spark, d):
    _, e, ends = _ends(spark, d)
    return reaches(e, ends.select("project_id", F.col("node_id").alias("node"))).select("node", "ending")


@query(_dag_sql("""
SELECT e.id AS edge_id, array_to_string(s.l, ',') AS prior, coalesce(array_to_string(t.l, ','), '') AS remaining, array_to_string(list_sort(list_filter(s.l, lambda x: NOT list_contains(coalesce(t.l, []), x))), ',') AS eliminated, coalesce(len(t.l), 0) = 1 AS is_lock_in
FROM dag_edges e JOIN dag_nodes n ON e.source = n.id JOIN sets s ON s.node = e.source LEFT JOIN sets t ON t.node = e.target
WHERE (n.type IN ('MENU', 'DECISION') OR e.label <> '' OR e.expression IS NOT NULL) AND len(s.l) > 1 AND len(list_filter(s.l, lambda x: NOT list_contains(coalesce(t.l, []), x))) > 0""",
    REACH + ", sets AS (SELECT node, list_sort(list(DISTINCT ending)) AS l FROM reach GROUP BY node)"))
def g4_points_of_no_return(spark, d):
    n, e, ends = _ends(spark, d)
    p = analytics.points_of_no_return(e, n, reach_bits(e, ends.select("project_id", F.col("node_id").alias("node"))))
    return p.select("edge_id", *[F.array_join(c, ",").alias(c) for c in ("prior", "remaining", "eliminated")], "is_lock_in")


@query(_dag_sql("SELECT s.node, e.ending FROM reach e JOIN (SELECT DISTINCT source, target FROM dag_edges) g ON g.source = e.node JOIN (SELECT id AS node FROM dag_nodes) s ON s.node = g.source WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.node = g.target AND r.ending = e.ending)", REACH))
def u3_eliminated_endings(spark, d):
    _, e, ends = _ends(spark, d)
    r = reaches(e, ends.select("project_id", F.col("node_id").alias("node")))
    steps = e.select("source", "target").distinct()
    before = steps.join(r.select(F.col("node").alias("source"), "ending"), "source")
    return before.join(r.select(F.col("node").alias("target"), "ending"), ["target", "ending"], "left_anti").select(F.col("source").alias("node"), "ending")


@query(_dag_sql("SELECT seed, node, min(depth) AS depth FROM down GROUP BY seed, node", "down AS (SELECT id AS seed, id AS node, 0 AS depth FROM dag_nodes WHERE node_ord % 10 = 0 UNION SELECT down.seed, e.target, down.depth + 1 FROM down JOIN dag_edges e ON e.source = down.node)"))
def g14_downstream(spark, d):
    n, e = ad.dag(spark, d)
    seeds = n.where("node_ord % 10 = 0").select("project_id", F.col("id").alias("seed"), F.col("id").alias("node"))
    return closure(e, seeds, ["project_id", "seed"]).select("seed", "node", "depth")


@query(_dag_sql("SELECT seed, node FROM up", "up AS (SELECT id AS seed, id AS node FROM dag_nodes WHERE node_ord % 10 = 1 UNION SELECT up.seed, e.source FROM up JOIN dag_edges e ON e.target = up.node)"))
def g14_upstream(spark, d):
    n, e = ad.dag(spark, d)
    seeds = n.where("node_ord % 10 = 1").select("project_id", F.col("id").alias("seed"), F.col("id").alias("node"))
    return closure(e, seeds, ["project_id", "seed"], backward=True).select("seed", "node")


@query(with_("edges", "nodes", body="""
SELECT e.id, e.source, e.target FROM edges e WHERE source IN (SELECT id FROM nodes WHERE word_count % 3 = 0) AND target IN (SELECT id FROM nodes WHERE word_count % 3 = 0)"""))
def j18_induced_subgraph(spark, d):
    return link.induced_subgraph(ad.edges(spark, d), ad.nodes(spark, d).where("word_count % 3 = 0")).select("id", "source", "target")


@query(with_("edges", body="SELECT target AS node, source AS caller, id AS context FROM edges WHERE kind = 'call'"))
def j19_call_origins(spark, d):
    return link.call_origins(ad.edges(spark, d)).drop("project_id")


NEST = """, steps AS (SELECT DISTINCT source, target, kind = 'call' AS deeper FROM edges),
nest AS (SELECT id AS node, 0 AS depth FROM nodes WHERE role = 'story' UNION SELECT s.target, nest.depth + CAST(s.deeper AS INT) FROM nest JOIN steps s ON s.source = nest.node WHERE nest.depth + CAST(s.deeper AS INT) <= 10)
"""


@query(with_("edges", "nodes", body="", recursive=True).rstrip() + NEST + "SELECT node, CAST(max(depth) AS INT) AS depth FROM nest GROUP BY node")
def g15_call_depth(spark, d):
    """Over the whole graph with its cycles."""
    return link.call_depth(ad.edges(spark, d), link.call_starts(ad.nodes(spark, d)), chains=False)[0].drop("project_id")


@query(with_("edges", "nodes", body="", recursive=True).rstrip() + NEST + """SELECT min(e.id) AS edge_id, e.source, e.target, 11 AS frames FROM edges e
  JOIN (SELECT node FROM nest GROUP BY node HAVING max(depth) = 10) n ON n.node = e.source WHERE e.kind = 'call' GROUP BY e.source, e.target""")
def g15_excessive_calls(spark, d):
    return link.call_depth(ad.edges(spark, d), link.call_starts(ad.nodes(spark, d)), chains=False)[1].drop("project_id", "chain")


@query(ad.with_("chain_nodes", "chain_edges", recursive=True, body=""", walk AS (SELECT node_ord AS n, node_ord AS head, 0 AS pos FROM chain_nodes WHERE node_ord NOT IN (SELECT t_key FROM chain_edges)
  UNION ALL SELECT e.t_key, w.head, w.pos + 1 FROM walk w JOIN chain_edges e ON e.s_key = w.n)
SELECT 'e' || head AS start, 'e' || max_by(n, pos) AS "end", count(*) AS nodes, CAST(sum(dialogue_count) AS BIGINT) AS lines, CAST(sum(word_count) AS BIGINT) AS words FROM walk JOIN chain_nodes c ON c.node_ord = walk.n
GROUP BY head HAVING sum(dialogue_count) >= 30 OR sum(word_count) >= 500"""))
def g8_monologues(spark, d):
    return chains.monologue_sections(*ad.chains(spark, d)).select("start", "end", "nodes", "lines", "words")


@query(ad.with_("chain_nodes", "chain_edges", recursive=True, body=""", walk AS (SELECT node_ord AS n, node_ord AS head, 0 AS pos FROM chain_nodes WHERE node_ord NOT IN (SELECT t_key FROM chain_edges)
  UNION ALL SELECT e.t_key, w.head, w.pos + 1 FROM walk w JOIN chain_edges e ON e.s_key = w.n)
SELECT 'e' || head AS id, CAST(sum(word_count) AS BIGINT) AS word_count, string_agg('e' || n, ',' ORDER BY pos) AS members FROM walk JOIN chain_nodes c ON c.node_ord = walk.n GROUP BY head"""))
def g9_collapse_chains(spark, d):
    n, _ = chains.collapse_chains(*ad.chains(spark, d))
    return n.select("id", "word_count", F.array_join("collapsed_node_ids", ",").alias("members"))


QUOTIENT = """
SELECT s.chapter AS source_chapter, t.chapter AS target_chapter, count(*) AS n FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id GROUP BY s.chapter, t.chapter"""


@query(with_("edges", "nodes", body=QUOTIENT))
def g12_chapter_graph(spark, d):
    return collapse.chapter_graph(ad.nodes(spark, d), ad.edges(spark, d)).select("source_chapter", "target_chapter", "n")


FOLDED = """, folded AS (SELECT e.*, CASE WHEN s.chapter < 'Brand#2' THEN 'chapter:' || s.chapter ELSE e.source END AS s2, CASE WHEN t.chapter < 'Brand#2' THEN 'chapter:' || t.chapter ELSE e.target END AS t2
  FROM edges e LEFT JOIN nodes s ON e.source = s.id LEFT JOIN nodes t ON e.target = t.id),
marked AS (SELECT *, s2 <> source OR t2 <> target AS moved FROM folded WHERE s2 <> t2 OR (s2 = source AND t2 = target))
SELECT id, s2 AS source, t2 AS target, kind FROM (SELECT *, row_number() OVER (PARTITION BY moved, CASE WHEN moved THEN s2 || '|' || t2 || '|' || kind ELSE id END ORDER BY edge_ord) AS nth FROM marked) WHERE nth = 1"""


@query(with_("edges", "nodes", body=FOLDED))
def g11_redirect_chapters(spark, d):
    n = ad.nodes(spark, d)
    folded = n.where("chapter < 'Brand#2'").select("project_id", "chapter").distinct()
    return collapse.redirect_chapters(ad.edges(spark, d), n, folded).select("id", "source", "target", "kind")


@query(_dag_sql("""SELECT two.fork, two.rejoin, branch.branches FROM two JOIN branch ON two.fork = branch.fork AND two.n = branch.branches
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.target = two.rejoin AND p.source NOT IN (SELECT target FROM pairs q WHERE q.source = two.fork))""",
    """pairs AS (SELECT DISTINCT 'f' || (s_key // 4) AS source, 'f' || (t_key // 4) AS target FROM dag_edges), branch AS (SELECT source AS fork, count(*) AS branches FROM pairs GROUP BY source HAVING count(*) > 1),
two AS (SELECT a.source AS fork, b.target AS rejoin, count(DISTINCT a.target) AS n FROM pairs a JOIN pairs b ON a.target = b.source GROUP BY a.source, b.target)"""))
def u5_join_candidates(spark, d):
    e = ad.dag(spark, d)[1]
    fold = lambda c: F.concat(F.lit("f"), F.floor(F.substring(c, 2, 20).cast("long") / 4).cast("string")).alias(c)
    return collapse.join_candidates(e.select("project_id", fold("source"), fold("target"))).select("fork", "rejoin", "branches")


VISIBLE = """, v AS (SELECT *, chapter >= 'Brand#22' OR NOT (lower(label) LIKE '%red%' OR lower(label) LIKE '%blue%' OR true) OR dialogue_count < 10 AS hidden FROM nodes)
SELECT id, hidden FROM v"""


@query(with_("nodes", body=VISIBLE))
def p1_visible_nodes(spark, d):
    n = ad.nodes(spark, d)
    folded = n.where("chapter >= 'Brand#22'").select("project_id", "chapter").distinct()
    return view.visible_nodes(n, collapsed_chapters=folded, min_dialogue=10).select("id", "hidden")


@query(with_("edges", "nodes", body="""
SELECT e.id FROM edges e WHERE kind IN ('jump', 'sequence') AND source IN (SELECT id FROM nodes WHERE dialogue_count >= 10) AND target IN (SELECT id FROM nodes WHERE dialogue_count >= 10)"""))
def p2_visible_edges(spark, d):
    shown = view.visible_nodes(ad.nodes(spark, d), min_dialogue=10).where("not hidden")
    return view.visible_edges(ad.edges(spark, d), shown, kinds=("jump", "sequence")).select("id")


@query(with_("nodes", body="SELECT id, label FROM nodes WHERE lower(label) LIKE '%bolt%' OR CAST(dialogue_count AS VARCHAR) = 'bolt'"))
def p3_simple_search(spark, d):
    return view.simple_search(ad.nodes(spark, d), "BOLT").select("id", "label")


@query(with_("nodes", body="SELECT id FROM nodes WHERE chapter IN ('Brand#1', 'Brand#2') AND type IN ('LABEL', 'MENU') AND dialogue_count >= 5"))
def p4_search_scope(spark, d):
    return view.scope(ad.nodes(spark, d), chapters=("Brand#1", "Brand#2"), types=("LABEL", "MENU"), min_dialogue=5).select("id")


@query(with_("nodes", body="SELECT m.id FROM nodes m JOIN nodes p ON p.node_ord = m.node_ord - 1 WHERE m.type = 'MENU' AND p.chapter = 'Brand#3'"))
def p5_collapsed_children(spark, d):
    n = ad.nodes(spark, d).withColumn("parent_label_id", F.concat(F.lit("p"), (F.col("node_ord") - 1).cast("string")))
    return view.collapsed_children(n, n.where("chapter = 'Brand#3'")).select("id")


@query(with_("edges", "nodes", body="SELECT count(DISTINCT n.id) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) > 180 OR (SELECT count(*) FROM edges) > 320 AS large FROM nodes n"))
def p8_large_graph(spark, d):
    return view.large_graph(ad.nodes(spark, d), ad.edges(spark, d)).drop("project_id")


@query(with_("nodes", body="""
SELECT count(*) AS nodes, count(*) FILTER (WHERE dialogue_count >= 10) AS visible_nodes, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(word_count) FILTER (WHERE dialogue_count >= 10) AS BIGINT) AS visible_words,
  sum(pause_duration) AS pause, sum(pause_duration) FILTER (WHERE dialogue_count >= 10) AS visible_pause FROM nodes"""))
def a18_view_metrics(spark, d):
    return view.view_metrics(view.visible_nodes(ad.nodes(spark, d), min_dialogue=10)).drop("project_id")


@query(with_("nodes", body="SELECT chapter, count(*) AS matches FROM nodes WHERE lower(label) LIKE '%widget%' GROUP BY chapter"))
def a16_chapter_search_counts(spark, d):
    n = ad.nodes(spark, d)
    return view.chapter_matches(n, view.simple_search(n, "widget")).drop("project_id")


@query(with_("nodes", body="SELECT chapter FROM nodes GROUP BY chapter ORDER BY chapter"))
def t4_chapter_list(spark, d):
    return view.chapter_list(ad.nodes(spark, d)).select("chapter")


@query(with_("edges", "nodes", body="SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) AS warnings, 'dangling_call,shadowed_target' AS codes FROM (SELECT id FROM edges WHERE kind = 'call' AND target NOT IN (SELECT id FROM nodes WHERE word_count % 2 = 0) UNION ALL SELECT e.id FROM edges e WHERE kind IN ('jump', 'call') AND target IN (SELECT 'p' || (node_ord % 500) FROM nodes WHERE type = 'LABEL' GROUP BY 1 HAVING count(*) > 1))"))
def a13_graph_summary(spark, d):
    n, e = ad.nodes(spark, d), ad.edges(spark, d)
    twice = n.withColumn("id", F.concat(F.lit("p"), (F.col("node_ord") % 500).cast("string")))
    found = link.dangling_calls(e, n.where("word_count % 2 = 0")).unionByName(link.shadowed_targets(e, twice))
    s = analytics.graph_summary(n, e, found)
    return s.select("nodes", "edges", "warnings", F.array_join("codes", ",").alias("codes"))


@query(with_("edges", body="SELECT DISTINCT 'disc' AS flag FROM edges WHERE expression IS NOT NULL"))
def a15_discovered_flags(spark, d):
    return analytics.discovered_flags(ad.edges(spark, d)).select("flag")
