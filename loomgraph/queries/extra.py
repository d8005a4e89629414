"""Queries over variables, assets, conditions, routes, files and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import conditions as C
from loomgraph.operators import analytics, assets, exports, integrity, link, routes, variables, view
from loomgraph.plans import adapters as ad
from loomgraph.plans.frontier import reach_bits
from loomgraph.queries import query
from loomgraph.queries.graph import REACH, _dag_sql, _ends
from loomgraph.sources import extract, scripts

with_ = ad.with_


@query(with_("vars", "declared", "referenced", body="SELECT DISTINCT name FROM declared WHERE name NOT IN (SELECT name FROM referenced)"))
def j13_unused_variables(spark, d):
    return variables.unused_variables(*ad.variables(spark, d)).select("name")


@query(with_("vars", "declared", "referenced", body="SELECT name, ord FROM referenced WHERE name NOT IN (SELECT name FROM declared)"))
def j14_undeclared_variables(spark, d):
    return variables.undeclared_variables(*ad.variables(spark, d)).select("name", "ord")


RANKS = "CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 2 ELSE 1 END"


@query(f"SELECT name, ord FROM (SELECT p_brand || p_name AS name, CAST(p_partkey AS BIGINT) AS ord, row_number() OVER (PARTITION BY p_brand || p_name ORDER BY p_size % 3 DESC, {RANKS} DESC, p_partkey DESC) AS nth FROM part) WHERE nth = 1")
def w2_init_variables(spark, d):
    kind = F.when(F.col("p_type") == "SMALL", "default").when(F.col("p_type") == "LARGE", "define").otherwise("python")
    rows = ad.table(spark, d, "part").select(F.lit("p").alias("project_id"), F.concat("p_brand", "p_name").alias("name"), kind.alias("kind"), (F.col("p_size") % 3).alias("priority"), F.col("p_partkey").cast("long").alias("ord"))
    return integrity.last_declarations(rows).select("name", "ord")


@query("SELECT user_id, event_type, round(sum(CASE WHEN event_id % 7 = 3 THEN -value ELSE value END), 4) AS value FROM events GROUP BY user_id, event_type")
def w7_running_values(spark, d):
    ev = ad.table(spark, d, "events")
    m = ev.select(F.lit("p").alias("project_id"), F.col("user_id").alias("node_id"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 == 3, "-=").otherwise("+=").alias("op"), "value")
    return variables.running_values(m).select(F.col("node_id").alias("user_id"), F.col("name").alias("event_type"), F.round("value", 4).alias("value"))


@query(with_("media", body="""SELECT kind, key, max_by(path, ord) AS path FROM (
  SELECT ord, path, unnest(['exact', 'lower', 'file', 'stem', 'relative', 'tag', 'tag', 'tag', 'tag']) AS kind,
    unnest([path, lower(path), lower(path[8:]), lower(path[8:-5]), lower(path[:-5]), lower(path[8:-5]), replace(lower(path[8:-5]), '_', ' '), lower(path[8:-5]), replace(lower(path[8:-5]), '_', ' ')]) AS key FROM media) GROUP BY kind, key"""))
def j12_media_index(spark, d):
    return assets.media_index(ad.media(spark, d)).select("kind", "key", "path")


@query(with_("cues", "media", body="""SELECT type, c.asset AS name, m.path FROM (SELECT DISTINCT type, asset FROM cues) c JOIN media m ON m.path = 'images/' || c.asset || '.png'"""))
def j10_resolve_assets(spark, d):
    names = assets.split_playlists(ad.cues(spark, d))
    return assets.resolve(names, assets.media_index(ad.media(spark, d))).select("type", "name", "path")


@query(with_("cues", "media", body="""SELECT type, name, n FROM (SELECT type, asset AS name, count(*) AS n, row_number() OVER (ORDER BY type, asset) AS nth FROM cues WHERE 'images/' || asset || '.png' NOT IN (SELECT path FROM media) GROUP BY type, asset) WHERE nth <= 1000"""))
def j11_missing_assets(spark, d):
    return assets.missing_assets(ad.cues(spark, d), ad.media(spark, d)).select("type", "name", "n")


@query(with_("cues", body="SELECT CASE WHEN type = 'show' THEN 'image' ELSE 'audio' END AS type, asset AS name, count(DISTINCT node_id) AS nodes FROM cues GROUP BY 1, 2"))
def a10_asset_catalog(spark, d):
    return assets.catalog(ad.cues(spark, d)).select("type", "name", F.size("node_ids").cast("long").alias("nodes"))


def _scenarios(spark, d):
    """Three scenarios over disc: the least and the greatest discount of the table, and unknown."""
    r = ad.table(spark, d, "lineitem").agg(F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))
    return r.select(F.explode(F.array(F.struct(F.lit("low").alias("scenario_id"), F.col("low").cast("string").alias("value")), F.struct(F.lit("high").alias("scenario_id"), F.col("high").cast("string").alias("value")), F.struct(F.lit("none").alias("scenario_id"), F.lit("unknown").alias("value")))).alias("x")).select("x.scenario_id", F.lit("disc").alias("flag"), "x.value")


def _limits(spark, d):
    """An expression for each discount and tax that occurs."""
    li = ad.table(spark, d, "lineitem").select("l_discount", "l_tax", "l_linenumber")
    return li.select("l_discount", "l_tax", F.concat(F.lit("disc >= "), F.col("l_discount").cast("string"), F.lit(" and not (disc > 0.05 or "), F.col("l_tax").cast("string"), F.lit(" > 0.04)")).alias("expression"))


CASES = """WITH s AS (SELECT 'low' AS scenario_id, min(l_discount) AS v FROM lineitem UNION ALL SELECT 'high', max(l_discount) FROM lineitem UNION ALL SELECT 'none', NULL),
e AS (SELECT DISTINCT l_discount, l_tax FROM lineitem), r AS (SELECT scenario_id, l_discount, l_tax, v >= l_discount AND NOT (v > 0.05 OR l_tax > 0.04) AS result FROM s, e)"""


@query(CASES + " SELECT scenario_id, l_discount, l_tax, CAST(result AS VARCHAR) AS result FROM r")
def f7_eval_condition(spark, d):
    e = _limits(spark, d).distinct()
    return C.evaluate_all(e, _scenarios(spark, d)).join(e, "expression").select("scenario_id", "l_discount", "l_tax", F.col("result").cast("string").alias("result"))


@query(CASES + " SELECT scenario_id, count(*) FILTER (WHERE result) AS taken, count(*) FILTER (WHERE NOT result) AS unreachable, count(*) FILTER (WHERE result IS NULL) AS unknown FROM r GROUP BY scenario_id")
def a12_condition_counts(spark, d):
    return C.counts(C.evaluate_all(_limits(spark, d), _scenarios(spark, d)), ["scenario_id"])


@query(CASES + """ SELECT scenario_id, l_discount, CASE WHEN bool_and(coalesce(NOT result, false)) THEN 'unreachable' WHEN bool_or(coalesce(result, false)) THEN 'taken' ELSE 'unknown' END AS state FROM r GROUP BY scenario_id, l_discount""")
def f9_branch_states(spark, d):
    e = _limits(spark, d).distinct()
    r = C.evaluate_all(e, _scenarios(spark, d)).join(e, "expression").withColumn("state", C.branch_state(F.col("result"), F.lit("if")))
    return C.roll_up(r, ["scenario_id", "l_discount"])


@query(CASES + """ SELECT scenario_id, l_tax, CAST(CASE WHEN bool_or(coalesce(result, false)) THEN true WHEN bool_or(result IS NULL) THEN NULL ELSE false END AS VARCHAR) AS result FROM r GROUP BY scenario_id, l_tax""")
def f10_combine_conditions(spark, d):
    e = _limits(spark, d).distinct()
    r = C.evaluate_all(e, _scenarios(spark, d)).join(e, "expression")
    return C.combine(r, ["scenario_id", "l_tax"], "or").withColumn("result", F.col("result").cast("string"))


@query("SELECT p_size, CAST(p_size % 2 = 0 AND p_size > 10 AS VARCHAR) AS value FROM (SELECT DISTINCT p_size FROM part)")
def f8_static_expressions(spark, d):
    e = ad.table(spark, d, "part").select("p_size").distinct()
    text = F.concat(F.lit("{'even': True, 'odd': False}['odd' if "), (F.col("p_size") % 2).cast("string"), F.lit(" == 1 else 'even'] and "), F.col("p_size").cast("string"), F.lit(" > len([1, 2]) * 5"))
    return e.select("p_size", C.fold_column(text, F.create_map().cast("map<string,string>"))["value_json"].alias("value"))


@query(with_("edges", body="SELECT id AS edge_id FROM edges WHERE expression IS NOT NULL"))
def j8_dead_menu_options(spark, d):
    env = spark.createDataFrame([("p", "disc", "0.01")], "project_id string, name string, value_json string")
    return variables.dead_options(ad.edges(spark, d), env).select("edge_id")


@query(_dag_sql("""SELECT s.scenario_id, n.id AS node FROM dag_nodes n, (VALUES ('low'), ('high'), ('none')) s(scenario_id) WHERE n.id NOT IN (SELECT node FROM met WHERE met.scenario_id = s.scenario_id)""",
    """met AS (SELECT s.scenario_id, id AS node FROM dag_nodes, (VALUES ('low'), ('high'), ('none')) s(scenario_id) WHERE id NOT IN (SELECT target FROM dag_edges)
    UNION SELECT met.scenario_id, e.target FROM met JOIN dag_edges e ON e.source = met.node WHERE e.expression IS NULL OR met.scenario_id <> 'low')"""))
def g13_conditional_reachability(spark, d):
    return variables.conditional_reachability(ad.dag(spark, d)[1], _scenarios(spark, d)).select("scenario_id", "node")


PATHS = """paths AS (SELECT id AS at, [id] AS path, CAST(word_count AS BIGINT) AS words, CAST([] AS VARCHAR[]) AS opts FROM dag_nodes WHERE id NOT IN (SELECT target FROM dag_edges)
  UNION ALL SELECT e.target, list_append(p.path, e.target), p.words + n.word_count, CASE WHEN e.label <> '' OR s.type = 'MENU' THEN list_append(p.opts, coalesce(e.label, '')) ELSE p.opts END
  FROM paths p JOIN dag_edges e ON e.source = p.at JOIN dag_nodes n ON n.id = e.target JOIN dag_nodes s ON s.id = e.source)"""


def _all_routes(spark, d):
    n, e, ends = _ends(spark, d)
    return n, e, ends, routes.enumerate_routes(n, e, link.entry_points(n, e), ends.select("project_id", F.col("node_id").alias("node")), max_routes=None, max_states=None)


@query(_dag_sql("SELECT array_to_string(path, '>') AS path, words, len(opts) AS choices FROM paths JOIN sinks ON sinks.id = paths.at", REACH.strip() + ", " + PATHS))
def g5_enumerate_routes(spark, d):
    return _all_routes(spark, d)[3].select(F.array_join("path", ">").alias("path"), "words", F.size("choices").cast("long").alias("choices"))


@query(_dag_sql("SELECT s.id AS node_id, count(p.at) AS routes, 'Reachable' AS status FROM sinks s LEFT JOIN paths p ON p.at = s.id GROUP BY s.id", REACH.strip() + ", " + PATHS))
def a7_ending_matrix(spark, d):
    _, _, ends, r = _all_routes(spark, d)
    return analytics.ending_matrix(ends, r).select("node_id", "routes", "status")


@query(_dag_sql("SELECT p.at AS node_id, CAST(count(*) AS BIGINT) AS routes FROM paths p GROUP BY p.at", PATHS))
def a7_route_counts(spark, d):
    """Ways from the entries to every node, counted without a list of them."""
    n, e = ad.dag(spark, d)
    return routes.count_routes(e, link.entry_points(n, e)).select(F.col("node").alias("node_id"), F.col("routes").cast("long").alias("routes"))


@query(_dag_sql("""SELECT n.id AS target, p.at IS NOT NULL AS is_reachable, coalesce(min(len(p.path)), 0) AS steps FROM dag_nodes n LEFT JOIN paths p ON p.at = n.id WHERE n.node_ord % 3 = 0 GROUP BY n.id, p.at IS NOT NULL""", PATHS))
def g6_solve_routes(spark, d):
    n, e = ad.dag(spark, d)
    s = routes.solve_routes(n, e, link.entry_points(n, e), n.where("node_ord % 3 = 0").select("project_id", F.col("id").alias("node")), max_states=None)
    return s.select("target", "is_reachable", F.size("path").cast("long").alias("steps"))


@query(_dag_sql("SELECT n.id AS target, max(p.words) AS words FROM dag_nodes n JOIN paths p ON p.at = n.id WHERE n.node_ord % 3 = 0 GROUP BY n.id", PATHS))
def t2_best_route(spark, d):
    n, e = ad.dag(spark, d)
    s = routes.solve_routes(n, e, link.entry_points(n, e), n.where("node_ord % 3 = 0").select("project_id", F.col("id").alias("node")), "max_dialogue", max_states=None)
    return s.select("target", "words")


@query()
def g7_flags_needed(spark, d):
    n, e = ad.dag(spark, d)
    s = routes.solve_routes(n, e, link.entry_points(n, e), n.select("project_id", F.col("id").alias("node")), max_states=None)
    return routes.flags_needed(s).drop("project_id")


@query(_dag_sql("SELECT route AS path, node, max(pos) AS step FROM (SELECT array_to_string(path, '>') || len(opts) AS route, unnest(path) AS node, unnest(range(0, len(path))) AS pos FROM (SELECT DISTINCT path, p.at AS tip FROM paths p) q JOIN sinks ON sinks.id = q.tip) GROUP BY route, node".replace(" || len(opts)", ""), REACH.strip() + ", " + PATHS))
def w6_step_order(spark, d):
    r = _all_routes(spark, d)[3]
    steps = variables.step_order(r).join(r.select("route_id", F.array_join("path", ">").alias("path")), "route_id")
    return steps.select("path", "node", F.col("step").cast("long").alias("step")).distinct()


@query(_dag_sql("""SELECT (SELECT count(*) FROM sinks) AS endings, (SELECT count(*) FROM paths p JOIN sinks ON sinks.id = p.at) AS routes, CAST((SELECT sum(word_count) FROM dag_nodes) AS BIGINT) AS unique_words,
  (SELECT round(sum(dialogue_count) / count(*) FILTER (WHERE type = 'MENU'), 1) FROM dag_nodes) AS lines_per_menu""", REACH.strip() + ", " + PATHS))
def a6_narrative_summary(spark, d):
    n, e, ends, r = _all_routes(spark, d)
    p = analytics.points_of_no_return(e, n, reach_bits(e, ends.select("project_id", F.col("node_id").alias("node"))))
    return analytics.narrative_summary(n, e, ends, r, p).select("endings", "routes", "unique_words", "lines_per_menu")


@query(_dag_sql("""SELECT id, CAST(row_number() OVER (ORDER BY coalesce(d, 0), node_ord) AS INT) AS rank FROM dag_nodes LEFT JOIN (SELECT node, min(depth) AS d FROM deep GROUP BY node) ON node = id""",
    "deep AS (SELECT id AS node, 0 AS depth FROM dag_nodes WHERE id NOT IN (SELECT target FROM dag_edges) UNION SELECT e.target, deep.depth + 1 FROM deep JOIN dag_edges e ON e.source = deep.node)"))
def t3_bfs_order(spark, d):
    n, e = ad.dag(spark, d)
    return routes.bfs_first(n, e, n.where("id = ''").select("project_id", F.col("id").alias("node"))).select("id", "rank")


@query("SELECT doc_id, source || '/doc_' || doc_id || '.rpy:' || sha256(text) AS cache_key FROM documents")
def s5_content_hash(spark, d):
    return scripts.content_hash(scripts.from_documents(ad.table(spark, d, "documents"))).select("doc_id", "cache_key")


@query("SELECT doc_id, CAST(len(string_split(replace(text, chr(13), ''), chr(10))) AS BIGINT) AS n_lines FROM documents")
def s6_file_lines(spark, d):
    lines = scripts.file_lines(scripts.from_documents(ad.table(spark, d, "documents")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("""SELECT source AS project_id, CASE WHEN count(*) > 300 THEN 'too_many_files' WHEN sum(octet_length(encode(text))) > 26214400 THEN 'too_large' WHEN max(octet_length(encode(text))) > 30000 THEN 'file_too_large' END AS error FROM documents GROUP BY source""")
def s3_validate_inputs(spark, d):
    return scripts.validate(scripts.from_documents(ad.table(spark, d, "documents")), max_file=30000).select("project_id", "error")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'translation' WHEN doc_id % 4 = 2 THEN 'media' WHEN doc_id % 4 = 3 THEN 'other' ELSE 'script' END AS kind FROM documents""")
def s2_split_inputs(spark, d):
    f = scripts.from_documents(ad.table(spark, d, "documents"))
    path = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("game/tl/es/d"), F.col("doc_id").cast("string"), F.lit(".rpy"))).when(F.col("doc_id") % 4 == 2, F.lit("images/a.PNG")).when(F.col("doc_id") % 4 == 3, F.lit("notes.txt")).otherwise(F.col("path"))
    return f.select("doc_id", scripts.input_kind(path).alias("kind"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY 'doc_' || doc_id || '.rpy') AS INT) AS file_ord FROM documents")
def s1_file_order(spark, d):
    return scripts.file_order(scripts.from_documents(ad.table(spark, d, "documents"))).select("doc_id", "file_ord")


SAID = "SELECT node_ord, node_id, speaker, line_no, regexp_replace(replace(replace(text, chr(10), ' '), '\"', ''), '\\\\', '', 'g') AS text FROM dialogue"


@query(with_("dialogue", body="SELECT node_id AS label_id, count(*) AS n_lines FROM dialogue GROUP BY node_id"))
def x2_extract_labels(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return stmts.where("kind = 'say'").groupBy("label_id").agg(F.count("*").alias("n_lines"))


@query(with_("dialogue", body=f", said AS ({SAID}) SELECT node_id, speaker, text FROM said"))
def x3_extract_say_lines(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.say_lines(stmts).select(F.col("label_id").alias("node_id"), "speaker", "text")


@query(with_("dialogue", body=""", c AS (SELECT DISTINCT node_ord, node_id, CAST(count(*) OVER (PARTITION BY node_id) AS BIGINT) AS n FROM dialogue)
SELECT node_id AS source, 'conv_' || (node_ord + 1) AS target, 'jump' AS kind, CAST(NULL AS VARCHAR) AS label FROM c WHERE n % 2 = 1
UNION ALL SELECT node_id, 'conv_' || (node_ord + k), 'jump', CASE k WHEN 1 THEN 'Next' ELSE 'Skip' END FROM c, (VALUES (1), (2)) v(k) WHERE n % 2 = 0"""))
def x5_extract_transfers(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.transfers(stmts).select("source", "target", "kind", "label")


@query(with_("dialogue", body="SELECT node_id AS parent_label_id, 2 AS items FROM dialogue GROUP BY node_id HAVING count(*) % 2 = 0"))
def x4_extract_menus(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.menus(stmts).select("parent_label_id", F.col("items").cast("int").alias("items"))


@query(with_("dialogue", body="SELECT node_id AS parent_label_id, 'flag_' || (node_ord % 5) AS expression, 'if' AS branch_kind FROM dialogue GROUP BY node_id, node_ord"))
def x6_extract_decisions(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.decisions(stmts).select("parent_label_id", "expression", "branch_kind")


@query(with_("dialogue", body="SELECT node_id, 'score' AS name, '+=' AS op, CAST(count(*) AS VARCHAR) AS value FROM dialogue GROUP BY node_id"))
def x11_extract_mutations(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.mutations(stmts).select(F.col("label_id").alias("node_id"), "name", "op", "value")


@query(with_("dialogue", body="SELECT node_id, 'scene' AS type, 'bg' || (node_ord % 7) AS asset FROM dialogue GROUP BY node_id, node_ord"))
def x13_extract_cues(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.cues(stmts).select(F.col("label_id").alias("node_id"), "type", "asset")


@query(with_("dialogue", body="SELECT 'fl_' || (node_ord % 5) AS name, count(*) AS n FROM (SELECT DISTINCT node_ord FROM dialogue) GROUP BY 1"))
def x12_extract_init_vars(spark, d):
    stmts = extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))
    return extract.init_vars(stmts).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, 'p' || (p_partkey + 1) AS target, 'literal' AS how FROM part WHERE p_partkey % 2 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)
UNION ALL SELECT a.p_partkey, 'p' || b.p_partkey, 'pattern' FROM part a JOIN part b ON a.p_partkey % 2 = 1 AND starts_with('p' || b.p_partkey, 'p' || (a.p_partkey // 10)) AND length('p' || b.p_partkey) >= length('p' || (a.p_partkey // 10))""")
def j7_dynamic_jumps(spark, d):
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    e = F.when(k % 2 == 0, F.concat(F.lit("'p"), s(k + 1), F.lit("'"))).when(k % 4 == 1, F.concat(F.lit('f"p'), s(F.floor(k / 10)), F.lit('{x}"'))).otherwise(F.concat(F.lit("'p"), s(F.floor(k / 10)), F.lit("' + x")))
    p = ad.table(spark, d, "part")
    jumps = p.select(F.lit("p").alias("project_id"), s(k).alias("source"), F.lit(0).alias("line_no"), e.alias("expression"))
    return link.resolve_dynamic(jumps, ad.nodes(spark, d)).select(F.col("source").cast("long").alias("p_partkey"), "target", "how")


def _statements(spark, d):
    return extract.statements(scripts.file_lines(extract.scripts_of(ad.dialogue(spark, d))))


@query("SELECT conv_id, 'conv_' || conv_id AS source, 'tail_' || conv_id AS target FROM conversations GROUP BY conv_id")
def x8_fallthrough(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d))
    open_ = files.withColumn("content", F.concat(F.regexp_replace("content", r"(?m)^    jump .*$|(?ms)^    menu:.*\z", ""), F.lit("\nlabel tail_"), F.col("file_ord").cast("string"), F.lit(":\n    return\n")))
    return extract.fallthrough(extract.statements(scripts.file_lines(open_))).select(F.substring("source", 6, 20).cast("long").alias("conv_id"), "source", "target")


@query("SELECT 'tail_' || conv_id AS id FROM conversations GROUP BY conv_id")
def x16_reliable_returns(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d))
    more = files.withColumn("content", F.concat("content", F.lit("\nlabel tail_"), F.col("file_ord").cast("string"), F.lit(":\n    return\n")))
    return extract.reliable_returns(extract.statements(scripts.file_lines(more))).select("id")


@query("SELECT 'conv_' || conv_id AS source, 'end_' || conv_id AS target, CASE WHEN conv_id % 2 = 0 THEN 'jump' ELSE 'call' END AS kind FROM conversations GROUP BY conv_id")
def x19_python_transfers(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d))
    verb = F.when(F.col("file_ord") % 2 == 0, "jump").otherwise("call")
    more = files.withColumn("content", F.concat("content", F.lit("\n    $ renpy."), verb, F.lit('("end_'), F.col("file_ord").cast("string"), F.lit('")  # renpy.jump("no")\n')))
    return extract.python_transfers(extract.statements(scripts.file_lines(more))).select("source", "target", "kind")


@query("SELECT 'conv_' || conv_id AS source, 'late' AS target, 'Timeout (' || (conv_id % 9 + 1) || 's)' AS label, CAST(conv_id % 9 + 1 AS DOUBLE) AS seconds FROM conversations GROUP BY conv_id")
def x9_timed_choices(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d))
    more = files.withColumn("content", F.concat("content", F.lit("\n    $ timedchoice("), (F.col("file_ord") % 9 + 1).cast("string"), F.lit(', "late")\n')))
    return extract.timed_choices(extract.statements(scripts.file_lines(more))).select("source", "target", "label", F.col("timeout.duration_seconds").alias("seconds"))


@query("SELECT 'conv_' || conv_id AS source, 'shop' AS screen FROM conversations GROUP BY conv_id")
def x18_screen_calls(spark, d):
    files = extract.scripts_of(ad.dialogue(spark, d))
    more = files.withColumn("content", F.concat("content", F.lit("\n    call screen shop\n")))
    return extract.screen_calls(extract.statements(scripts.file_lines(more))).select("source", "screen")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'jump' WHEN 'view' THEN 'set_variable' END AS action_kind, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'dynamic_target' WHEN event_type NOT IN ('click', 'view') THEN 'unmapped_screen_action' END AS category FROM events")
def x10_screen_actions(spark, d):
    defaults = spark.createDataFrame([("v", "CLICK", "jump", 1), ("v", "view", "call", 2)], "variant string, action_name string, action_kind string, ord int")
    custom = spark.createDataFrame([("v", "View", "set_variable", 1), ("v", "error", "nonsense", 2)], defaults.schema)
    actions = ad.table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), F.when(F.col("event_id") % 2 == 1, F.lit("x")).alias("target"))
    return extract.screen_actions(actions, extract.merge_action_rules(defaults, custom)).select("event_id", "action_kind", "category")


@query("""SELECT source AS project_id, CASE WHEN n > 0 THEN 'shout' ELSE 'standard' END AS variant FROM (SELECT source, count(*) FILTER (WHERE regexp_matches(text, '[A-Z]{4,}!!')) AS n FROM documents GROUP BY source)""")
def x14_detect_variant(spark, d):
    rules = spark.createDataFrame([("shout", "[A-Z]{4,}!!", False)], "variant string, pattern string, is_path boolean")
    return extract.detect_variant(scripts.from_documents(ad.table(spark, d, "documents")), rules).select("project_id", "variant")


@query("SELECT 'l' || (event_id % 3) AS lang, 'old' || event_id AS old, 'new' || event_id AS new FROM events")
def q4_scan_translations(spark, d):
    from loomgraph.operators import translations

    ev = ad.table(spark, d, "events")
    k = F.col("event_id").cast("string")
    text = F.concat(F.lit("translate L"), (F.col("event_id") % 3).cast("string"), F.lit(' strings:\n    # note\n    old "old'), k, F.lit('"\n    new "new'), k, F.lit('"\n'))
    files = ev.select(F.lit("p").alias("project_id"), F.concat(F.lit("tl/"), k).alias("path"), text.alias("content"))
    return translations.scan(scripts.file_lines(files))[0].select("lang", "old", "new")


@query("SELECT o_orderkey AS node_id, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 5 GROUP BY o_orderkey")
def w5_interleave_cues(spark, d):
    o = ad.table(spark, d, "orders").select(F.lit("p").alias("project_id"), F.col("o_orderkey").alias("node_id"), F.lit(5).alias("line_num"), F.lit("last").alias("text"))
    li = ad.table(spark, d, "lineitem").select(F.lit("p").alias("project_id"), F.col("l_orderkey").alias("node_id"), F.col("l_linenumber").alias("line_num"), F.col("l_partkey").cast("string").alias("asset"))
    mixed = variables.interleave_cues(o, li)
    return mixed.where("kind = 'cue'").join(o.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS key, max_by(p_name, p_partkey) AS value FROM part GROUP BY p_brand")
def u6_merge_definitions(spark, d):
    p = ad.table(spark, d, "part").select(F.lit("p").alias("project_id"), F.col("p_brand").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("file_ord"))
    return integrity.merge_definitions(p).select("key", "value")


@query("SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n FROM (SELECT DISTINCT event_id, event_type AS category FROM events ORDER BY event_id LIMIT 1000) GROUP BY ROLLUP (category)")
def a14_diagnostics_report(spark, d):
    ev = ad.table(spark, d, "events").select(F.lit("p").alias("project_id"), F.col("event_id").alias("id"), F.col("event_type").alias("category"))
    return analytics.diagnostics_report(ev).where("project_id is not null").select(F.coalesce("category", F.lit("all")).alias("category"), "n")


@query()
def g10_collapse_menus(spark, d):
    from loomgraph.operators import collapse

    n, e = ad.dag(spark, d)
    return collapse.collapse_menus(e, n.where("type = 'MENU'").select("project_id", "id")).select("source", "target", "kind", "label", "expression")


@query(_dag_sql("SELECT 'Reachable' AS status, count(*) AS n FROM sinks", REACH))
def k1_endings_csv(spark, d):
    _, _, ends, r = _all_routes(spark, d)
    lines = exports.endings_csv(analytics.ending_matrix(ends, r)).where("ord > 0")
    return lines.select(F.substring_index("line", ",", -1).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT source AS project_id, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def r1_incremental_ingest(spark, d):
    """Documents as a stream of files; what comes twice with the same content is taken once."""
    from loomgraph.plans.lineage import shared_dir
    from loomgraph.streaming import ingest
    import uuid

    base = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    files = scripts.from_documents(ad.table(spark, d, "documents")).select("project_id", "path", "content", F.timestamp_seconds(F.lit(1_700_000_000)).alias("arrived"))
    files.unionAll(files).write.parquet(f"{base}/in")
    table = ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    return table.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))
