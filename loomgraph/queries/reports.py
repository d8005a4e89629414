"""Queries of whole reports, as text, and of what scripts' names are worth."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import analytics, exports, link, values
from loomgraph.plans import adapters as ad
from loomgraph.plans.frontier import reach_bits
from loomgraph.plans.lineage import cut
from loomgraph.queries import query
from loomgraph.queries.extra import PATHS, _all_routes
from loomgraph.queries.graph import REACH, _dag_sql
from loomgraph.queries.text import WORDS
from loomgraph.sources import extract, scripts

with_ = ad.with_


def _number(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


def _minutes(seconds: str) -> str:
    m = f"CAST(ceil(({seconds}) / 60) AS BIGINT)"
    return f"CASE WHEN {seconds} <= 0 THEN '< 1m' WHEN {m} < 60 THEN {m} || 'm' WHEN {m} % 60 > 0 THEN ({m} // 60) || 'h ' || ({m} % 60) || 'm' ELSE ({m} // 60) || 'h' END"


#: DuckDB: all routes of the sparse forward graph with what a report tells of them.
ROUTES = """rp AS (SELECT id AS at, CAST(word_count AS BIGINT) AS words, pause_duration AS pause, CAST(dialogue_count AS BIGINT) AS said, 1 AS steps, CAST([] AS VARCHAR[]) AS opts, [chapter] AS chs FROM dag_nodes WHERE id NOT IN (SELECT target FROM dag_edges)
  UNION ALL SELECT e.target, p.words + n.word_count, p.pause + n.pause_duration, p.said + n.dialogue_count, p.steps + 1,
    CASE WHEN e.label <> '' OR s.type = 'MENU' THEN list_append(p.opts, s.label || ' -> [' || coalesce(e.label, 'Choice') || ']') ELSE p.opts END, CASE WHEN list_contains(p.chs, n.chapter) THEN p.chs ELSE list_append(p.chs, n.chapter) END
  FROM rp p JOIN dag_edges e ON e.source = p.at JOIN dag_nodes n ON n.id = e.target JOIN dag_nodes s ON s.id = e.source)"""


@query(_dag_sql(f"""SELECT s.label || ',normal,' || r.words || ',' || {_minutes('(r.words / 200.0 * 60 + r.pause)')} || ',' || r.said || ',' || len(r.opts) || ',' || r.steps || ',No,' || array_to_string(r.opts, ' | ') || ','
  || CASE WHEN len(r.chs) > 1 THEN '"' || array_to_string(r.chs, ', ') || '"' ELSE r.chs[1] END AS line FROM rp r JOIN sinks s0 ON s0.id = r.at JOIN dag_nodes s ON s.id = r.at""", REACH.strip() + ", " + ROUTES))
def k1_routes_csv(spark, d):
    """Lines of the routes' file, without the header and the number of each route."""
    n, _, ends, r = _all_routes(spark, d)
    return exports.routes_csv(r, n, ends).where("ord > 0").select(F.regexp_replace("line", r"^route_\d+,", "").alias("line"))


@query(_dag_sql(f"""SELECT CAST(0 AS BIGINT) AS ord, 'Ending Node ID,Ending Label,Chapter,Classification,Reachable Routes Count,Word Count,Pause Duration (s),Dialogue Lines,Status' AS line
UNION ALL SELECT row_number() OVER (ORDER BY n.id), n.id || ',' || n.label || ',' || n.chapter || ',normal,' || (SELECT count(*) FROM paths p WHERE p.at = n.id) || ',' || n.word_count || ',' || {_number('n.pause_duration')} || ',' || n.dialogue_count || ',Reachable'
FROM dag_nodes n JOIN sinks s ON s.id = n.id""", REACH.strip() + ", " + PATHS))
def k1_endings_file(spark, d):
    """The endings' file, line by line."""
    _, _, ends, r = _all_routes(spark, d)
    return exports.endings_csv(analytics.ending_matrix(ends, r)).select("ord", "line")


HEADINGS = " UNION ALL ".join(
    f"SELECT '{section}', CAST({i - len(heading) + 1} AS BIGINT), '{line}'"
    for section, heading in (("2 endings", exports.MATRIX), ("3 no return", exports.LOCKOUTS), ("4 pacing", exports.PACING), ("5 speakers", exports.SPEAKERS))
    for i, line in enumerate(heading)
)
LAST = " UNION ALL ".join(f"SELECT '{section}', CAST({1 << 62} AS BIGINT), ''" for section in ("2 endings", "3 no return", "4 pacing", "5 speakers"))


@query(_dag_sql(f"""
SELECT '1 summary' AS section, CAST(i AS BIGINT) AS ord, line FROM (
  SELECT unnest(range(0, 15)) AS i, unnest(['# Narrative & Ending Analytics Report', '', '## Executive Summary', '',
    '- **Total Story Endings Discovered**: ' || (SELECT count(*) FROM sinks), '- **Reachable Endings**: ' || (SELECT count(*) FROM sinks), '- **Unreachable / Orphan Endings**: 0', '- **Total Distinct Story Routes**: ' || (SELECT count(*) FROM told),
    '- **Total Unique Story Words**: ~' || format('{{:,}}', (SELECT CAST(sum(word_count) AS BIGINT) FROM dag_nodes)) || ' words', '- **Total Unique Reading Time**: ' || (SELECT {_minutes('(sum(word_count) / 200.0 * 60 + sum(pause_duration))')} FROM dag_nodes),
    '- **Average Route Playthrough Duration**: ' || (SELECT {_minutes('(avg(words / 200.0 * 60 + pause))')} FROM told), NULL, NULL,
    '- **Global Dialogue-to-Choice Ratio**: ' || (SELECT {_number("round(sum(dialogue_count) / count(*) FILTER (WHERE type = 'MENU'), 1)")} FROM dag_nodes) || ' lines/choice',
    '- **Global Branching Factor**: ' || (SELECT {_number('round(chosen / menus, 2)')} FROM (SELECT (SELECT count(*) FROM dag_edges e JOIN dag_nodes n ON e.source = n.id WHERE n.type = 'MENU' OR e.label <> '') AS chosen, (SELECT count(*) FROM dag_nodes WHERE type = 'MENU') AS menus)) || ' options/menu']) AS line) WHERE line IS NOT NULL
UNION ALL SELECT '1 summary', 15, ''
UNION ALL {HEADINGS}
UNION ALL {LAST}
UNION ALL SELECT '2 endings', row_number() OVER (ORDER BY n.id), '| **' || n.label || '** | ' || n.chapter || ' | `normal` | ' || (SELECT count(*) FROM told t WHERE t.at = n.id) || ' | ' || format('{{:,}}', n.word_count) || ' | ' || n.dialogue_count || ' |' FROM dag_nodes n JOIN sinks s ON s.id = n.id
UNION ALL SELECT '3 no return', row_number() OVER (ORDER BY e.id), '| `' || n.label || '` | ' || CASE WHEN e.label <> '' THEN '"' || e.label || '"' ELSE 'Branch' END || ' | `' || m.label || '` | `' || array_to_string(list_sort(list_filter(s.l, lambda x: NOT list_contains(coalesce(t.l, []), x))), '`, `')
    || '` | ' || CASE WHEN coalesce(len(t.l), 0) = 1 THEN '**Final Ending Lock-in**' ELSE 'Eliminates branches' END || ' |'
  FROM dag_edges e JOIN dag_nodes n ON e.source = n.id JOIN dag_nodes m ON e.target = m.id JOIN sets s ON s.node = e.source LEFT JOIN sets t ON t.node = e.target
  WHERE (n.type IN ('MENU', 'DECISION') OR e.label <> '' OR e.expression IS NOT NULL) AND len(s.l) > 1 AND len(list_filter(s.l, lambda x: NOT list_contains(coalesce(t.l, []), x))) > 0
UNION ALL SELECT '4 pacing', row_number() OVER (ORDER BY chapter), '| **' || chapter || '** | ' || format('{{:,}}', lines) || ' | ' || format('{{:,}}', words) || ' | ' || menus || ' | ' || choices || ' | ' || {_number('per')} || ' | ' || {_minutes('(words / 200.0 * 60 + pause)')} || ' | None |' FROM (
  SELECT n.*, coalesce(c.choices, 0) AS choices, CASE WHEN n.menus > 0 THEN round(n.lines / n.menus, 1) ELSE CAST(n.lines AS DOUBLE) END AS per
  FROM (SELECT chapter, CAST(sum(dialogue_count) AS BIGINT) AS lines, CAST(sum(word_count) AS BIGINT) AS words, sum(pause_duration) AS pause, count(*) FILTER (WHERE type = 'MENU') AS menus FROM dag_nodes GROUP BY chapter) n
  LEFT JOIN (SELECT n.chapter, count(*) AS choices FROM dag_edges e JOIN dag_nodes n ON e.source = n.id WHERE n.type = 'MENU' OR e.label <> '' GROUP BY n.chapter) c ON n.chapter = c.chapter)
UNION ALL SELECT '5 speakers', row_number() OVER (ORDER BY words DESC, lines DESC, speaker), '| **' || speaker || '** | ' || format('{{:,}}', lines) || ' | ' || format('{{:,}}', words) || ' | ' || {_number('lp')} || '% | ' || {_number('wp')} || '% |' FROM (
  SELECT *, CAST(round(words * 100.0 / sum(words) OVER (), 1) AS DOUBLE) AS wp, CAST(round(lines * 100.0 / sum(lines) OVER (), 1) AS DOUBLE) AS lp FROM (SELECT speaker, count(*) AS lines, CAST(sum({WORDS}) AS BIGINT) AS words FROM dialogue GROUP BY speaker))""",
    f"dialogue AS ({ad.SQL['dialogue']}), " + REACH.strip() + ", sets AS (SELECT node, list_sort(list(DISTINCT ending)) AS l FROM reach GROUP BY node), " + ROUTES + ", told AS (SELECT rp.* FROM rp JOIN sinks ON sinks.id = rp.at)"))
def k2_report(spark, d):
    """The whole report, but for the lines of the shortest and the longest route, which have no order in SQL where they are equally long."""
    n, e, ends, r = (cut(df) for df in _all_routes(spark, d))
    p = cut(analytics.points_of_no_return(e, n, reach_bits(e, ends.select("project_id", F.col("node_id").alias("node")))))
    lines = exports.analytics_markdown(analytics.narrative_summary(n, e, ends, r, p), analytics.ending_matrix(ends, r), p, analytics.chapter_pacing(n, e), analytics.character_distribution(ad.dialogue(spark, d)), n, e)
    return lines.where("not line rlike '^- ..(Shortest|Longest) Route'").select("section", "ord", "line")


@query(with_("nodes", body=""", body AS (SELECT chapter, node_ord, ['### ' || label, '*Type: ' || type || ' | Dialogue Lines: ' || dialogue_count || ' | Words: ' || word_count || '*', '', '> ' || label, '> ' || chapter, '> ', ''] AS lines FROM nodes
UNION ALL SELECT DISTINCT chapter, -1, ['## ' || chapter, ''] FROM nodes)
SELECT '1' AS section, CAST(unnest([0, 1]) AS BIGINT) AS ord, unnest(['# Narrative Storyboard', '']) AS line
UNION ALL SELECT '2 ' || chapter, row_number() OVER (PARTITION BY chapter ORDER BY node_ord, k), line FROM (SELECT chapter, node_ord, unnest(lines) AS line, unnest(range(0, len(lines))) AS k FROM body)"""))
def k4_storyboard_nodes(spark, d):
    n = ad.nodes(spark, d).withColumn("dialogue_lines", F.array(F.concat("label", F.lit("\n"), "chapter"), F.lit("")))
    return exports.storyboard_nodes(n).drop("project_id")


@query("""WITH convs AS (SELECT DISTINCT conv_id AS k FROM conversations)
SELECT 'conv_' || k AS source, 'room_' || (k % 7 + 1) AS target, 'value' AS how FROM convs UNION ALL SELECT 'conv_' || k, 'room_' || (k % 7 + 1 + k % 3 + 1), 'value' FROM convs""")
def j7_jump_values(spark, d):
    """Targets of jumps by what is assigned before them, through names, sums and a branch."""
    k = F.col("conv_id")
    s = lambda x: x.cast("string")
    text = F.concat(F.lit("label conv_"), s(k), F.lit(":\n    $ kind = 'room'\n    $ door = kind + '_'\n    $ n = "), s(k % 7), F.lit("\n    $ n += step\n    if hot:\n        $ n += "), s(k % 3 + 1), F.lit("\n    jump expression door + str(n)\n"))
    files = ad.table(spark, d, "conversations").select("conv_id").distinct().select(F.lit("p").alias("project_id"), F.concat(F.lit("c"), s(k), F.lit(".rpy")).alias("path"), k.cast("int").alias("file_ord"), text.alias("content"))
    stmts = extract.statements(scripts.file_lines(files))
    start = files.select("project_id", F.lit("step").alias("name"), F.lit("1").alias("value_json")).distinct()
    uses = extract.dynamic_targets(stmts).join(stmts.select("project_id", "path", "line_no", "block_path"), ["project_id", "path", "line_no"])
    worth = values.outcomes(uses, values.settled(values.assignments(stmts), start), start)
    return link.resolve_dynamic(uses, extract.labels(stmts), None, worth).select("source", "target", "how")


@query("""WITH convs AS (SELECT DISTINCT conv_id AS k FROM conversations)
SELECT 'a_' || k AS name, CAST(k AS VARCHAR) AS raw_expression, 'python' AS kind, CAST(-(k % 5) AS INT) AS priority FROM convs UNION ALL SELECT 'b_' || k, '[1, ' || k || ']', 'python', CAST(-(k % 5) AS INT) FROM convs
UNION ALL SELECT 'persistent.c_' || k, 'True', 'persistent', -50000 FROM convs UNION ALL SELECT 'd_' || k, '"x = 1"', 'define', 3 FROM convs""")
def x12_init_blocks(spark, d):
    """Declarations in Python blocks that run before the story; assignments in functions, conditions and labels are none."""
    k = F.col("conv_id")
    s = lambda x: x.cast("string")
    text = F.concat(F.lit("init "), s(-(k % 5)), F.lit(" python:\n    a_"), s(k), F.lit(" = "), s(k), F.lit("\n    b_"), s(k), F.lit(" = [1,\n        "), s(k), F.lit("]\n    def f(x=1):\n        y = 2\n        return y\n    if debug:\n        z = 1\npython early:\n    persistent.c_"), s(k), F.lit(" = True\ndefine 3 d_"), s(k), F.lit(' = "x = 1"\nlabel l'), s(k), F.lit(":\n    python:\n        w = 1\n    return\n"))
    files = ad.table(spark, d, "conversations").select("conv_id").distinct().select(F.lit("p").alias("project_id"), F.concat(F.lit("c"), s(k), F.lit(".rpy")).alias("path"), text.alias("content"))
    return extract.init_vars(extract.statements(extract.logical_lines(scripts.file_lines(files)))).select("name", "raw_expression", "kind", "priority")
