"""Queries over dialogue: counts, speakers, search, localization, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import analytics, exports, search, translations
from loomgraph.plans import adapters as ad
from loomgraph.queries import query

with_ = ad.with_
WORDS = r"len(regexp_extract_all(regexp_replace(text, '\{[^}]+\}', '', 'g'), '[^ \t\n\r\f\v]+'))".replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\f", "\f").replace("\\v", "\v")


@query(with_("dialogue", body=f"SELECT node_id, line_no, CAST({WORDS} AS INT) AS words, CAST(line_no AS DOUBLE) AS pause FROM dialogue"))
def f1_text_stats(spark, d):
    t = ad.dialogue(spark, d)
    return t.select("node_id", "line_no", T.word_count(F.col("text")).alias("words"), T.pause_seconds(F.col("text")).alias("pause"))


@query(with_("nodes", body="""SELECT id, CASE WHEN word_count <= 0 AND pause_duration <= 0 THEN 0.0 ELSE word_count / 150.0 * 60 + pause_duration END AS seconds FROM nodes"""))
def f2_reading_seconds(spark, d):
    return ad.nodes(spark, d).select("id", T.reading_seconds(F.col("word_count"), F.col("pause_duration"), 150).alias("seconds"))


MINUTES = "CAST(ceil(s / 60) AS BIGINT)"


@query(f"""SELECT o_orderkey, CASE WHEN s <= 0 THEN '< 1m' WHEN {MINUTES} < 60 THEN {MINUTES} || 'm' WHEN {MINUTES} % 60 > 0 THEN ({MINUTES} // 60) || 'h ' || ({MINUTES} % 60) || 'm' ELSE ({MINUTES} // 60) || 'h' END AS reading_time
FROM (SELECT o_orderkey, o_totalprice / 40 - 100 AS s FROM orders)""")
def f3_format_minutes(spark, d):
    return ad.table(spark, d, "orders").select("o_orderkey", T.format_minutes(F.col("o_totalprice") / 40 - 100).alias("reading_time"))


SECONDS = "CAST(floor(s + 0.5) AS BIGINT)"


@query(f"""SELECT o_orderkey, CASE WHEN t <= 0 THEN '0s' WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN (t // 60) || 'm' || CASE WHEN t % 60 > 0 THEN ' ' || (t % 60) || 's' ELSE '' END
  ELSE (t // 3600) || 'h' || CASE WHEN t // 60 % 60 > 0 THEN ' ' || (t // 60 % 60) || 'm' ELSE '' END END AS duration
FROM (SELECT o_orderkey, {SECONDS} AS t FROM (SELECT o_orderkey, o_totalprice / 40 - 100 AS s FROM orders))""")
def f4_format_seconds(spark, d):
    return ad.table(spark, d, "orders").select("o_orderkey", T.format_seconds(F.col("o_totalprice") / 40 - 100).alias("duration"))


@query(r"""SELECT e.event_id, CASE event_type || '_' || (event_id % 6) WHEN 'x' THEN 'x' ELSE
  CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'good' WHEN 2 THEN 'dead_end' WHEN 3 THEN 'bad' WHEN 4 THEN 'normal' ELSE CASE WHEN event_id % 20 <= 2 THEN 'dead_end' ELSE 'normal' END END END AS ending_type FROM events e""")
def f5_classify_ending(spark, d):
    ev = ad.table(spark, d, "events")
    word = F.element_at(F.array(*[F.lit(x) for x in ("golden", "happy", "killed", "worst", "neutral", "return")]), (F.col("event_id") % 6 + 1).cast("int"))
    label = F.concat(F.col("event_type"), F.lit("_"), word, F.lit("_scene"))
    return ev.select("event_id", T.ending_type(label, F.array().cast("array<string>"), (F.col("event_id") % 20).cast("int")).alias("ending_type"))


@query("""SELECT l_orderkey, count(*) AS n, 'disc,fl.a' || l_orderkey % 7 || '.b' AS refs FROM lineitem GROUP BY l_orderkey""".replace("'disc,fl.a' || l_orderkey % 7 || '.b'", "'disc,fl,fl.a' || (l_orderkey % 7)"))
def f6_condition_refs(spark, d):
    li = ad.table(spark, d, "lineitem")
    e = F.concat(F.lit("disc > 0.05 and not fl.a"), (F.col("l_orderkey") % 7).cast("string"), F.lit(' == "x.y" or True'))
    return li.select("l_orderkey", F.array_join(T.condition_refs(e), ",").alias("refs")).groupBy("l_orderkey", "refs").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name || chr(10) || 'x' AS literal FROM customer""")
def f12_extract_literal(spark, d):
    c = ad.table(spark, d, "customer")
    quoted = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), "c_name", F.lit('\\nx"'))).otherwise(F.concat(F.lit("u'''"), "c_name", F.lit("\\nx'''")))
    return c.select("c_custkey", T.extract_literal(quoted).alias("literal"))


@query(with_("dialogue", body="SELECT 'flag_' || (node_ord % 5) AS name, count(*) AS n FROM dialogue GROUP BY 1"))
def f13_interpolated(spark, d):
    return ad.dialogue(spark, d).select(F.explode(T.interpolated(F.col("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') OR regexp_matches(trim(text), '^[=+\\-@]') THEN '"''' || replace(text, '"', '""') || '"'
  WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' ELSE '' END || text AS text FROM documents)""")
def f14_csv_cell(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), "text")
    return ad.table(spark, d, "documents").select("doc_id", T.csv_cell(t).alias("cell"))


@query("""SELECT doc_id, trim(replace(replace(text, '|', '\\|'), chr(10), ' ')) AS cell FROM documents""")
def f15_markdown_cell(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", T.markdown_cell(F.col("text")).alias("cell"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_type END AS base FROM part")
def f16_base_label(spark, d):
    p = ad.table(spark, d, "part")
    node = F.when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("__cont_L5"))).otherwise(F.concat("p_type", F.lit("__scene_2")))
    return p.select("p_partkey", T.base_label(node, F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))).alias("base"))


@query("SELECT CASE WHEN p_type = 'PROMO' THEN 'jump' ELSE 'sequence' END AS kind, count(*) AS n FROM part GROUP BY 1")
def f17_edge_kind(spark, d):
    k = F.when(F.col("p_type") == "PROMO", "jump").when(F.col("p_type") == "LARGE", F.lit(None)).otherwise(F.lower("p_type"))
    return ad.table(spark, d, "part").select(T.edge_kind(k).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(with_("dialogue", body=f"""SELECT node_id, count(*) AS dialogue_count, CAST(sum({WORDS}) AS BIGINT) AS word_count, CAST(sum(line_no) AS DOUBLE) AS pause_duration, string_agg(text, '|' ORDER BY line_no) AS lines,
  count(DISTINCT speaker) AS speakers FROM dialogue GROUP BY node_id"""))
def a1_node_metrics(spark, d):
    n = analytics.node_metrics(ad.dialogue(spark, d))
    return n.select("node_id", "dialogue_count", "word_count", "pause_duration", F.array_join("dialogue_lines", "|").alias("lines"), F.size("character_dialogue").cast("long").alias("speakers"))


@query(with_("dialogue", body=f"""SELECT speaker, line_count, word_count, round(word_count * 100.0 / sum(word_count) OVER (), 1) AS percent, round(line_count * 100.0 / sum(line_count) OVER (), 1) AS line_percent FROM (SELECT speaker, count(*) AS line_count, CAST(sum({WORDS}) AS BIGINT) AS word_count FROM dialogue GROUP BY speaker)"""))
def a5_character_distribution(spark, d):
    return analytics.character_distribution(ad.dialogue(spark, d)).drop("project_id")


@query(with_("dialogue", body="SELECT node_id || '::' || row_number() OVER (PARTITION BY node_id ORDER BY line_no) AS doc_id, text AS line FROM dialogue"))
def q1_search_docs(spark, d):
    return search.line_docs(ad.dialogue(spark, d)).select("doc_id", "line")


@query(with_("dialogue", body="SELECT node_id || '::' || i AS doc_id, i AS line_index FROM (SELECT node_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY line_no) AS INT) AS i FROM dialogue)"))
def w4_line_index(spark, d):
    return search.line_docs(ad.dialogue(spark, d)).select("doc_id", "line_index")


#: Words of dialogue to look for, by rank of their frequency: taken from the table itself.
def _asked(docs):
    words = docs.select(F.explode(search.terms(F.col("line"))).alias("w")).where("length(w) >= 6").groupBy("w").agg(F.count("*").alias("n"))
    return words.orderBy(F.desc("n"), "w").limit(5).select(F.col("w").alias("query_id"), F.col("w").alias("query"))


TERMS_SQL = "regexp_extract_all(lower(text), '[^ \t\n\r\f\v!-/:-@\\[-`{-~]+')".replace("\\v", "\v").replace("\\f", "\f")


# the oracle's edit distance counts bytes, so that it needs other letters than ASCII as one sign each
@query(with_("dialogue", body=f""", words AS (SELECT node_id || '::' || row_number() OVER (PARTITION BY node_id ORDER BY line_no) AS doc_id, unnest({TERMS_SQL}) AS w, node_id FROM dialogue),
top AS (SELECT w AS q FROM words WHERE length(w) >= 6 GROUP BY w ORDER BY count(*) DESC, w LIMIT 5),
every AS (SELECT doc_id, w FROM words UNION ALL SELECT DISTINCT doc_id, unnest(string_split(node_id, '_')) FROM words),
vocab AS (SELECT DISTINCT w FROM every),
near AS (SELECT q, w FROM vocab, top WHERE starts_with(w, q) OR (abs(length(w) - length(q)) <= round(length(q) * 0.25) AND levenshtein(regexp_replace(w, '[^ -~]', '?', 'g'), q) <= round(length(q) * 0.25)))
SELECT DISTINCT q AS query_id, doc_id FROM every JOIN near USING (w)"""))
def q2_dialogue_search(spark, d):
    docs = search.line_docs(ad.dialogue(spark, d))
    return search.search(docs, _asked(docs), limit=None).select("query_id", "doc_id")


@query(with_("nodes", body="SELECT id AS doc_id FROM nodes WHERE list_contains(string_split(label, ' '), 'widget')"))
def q3_node_search(spark, d):
    docs = ad.nodes(spark, d).select("project_id", F.col("id").alias("doc_id"), "label", F.col("dialogue_count").cast("string").alias("count"))
    asked = spark.createDataFrame([("q", "widget")], "query_id string, query string")
    return search.search(docs, asked, {"label": 2.0, "count": 1.0}, limit=None).select("doc_id")


def _translated(lines):
    """Every second line has a translation to es, every third to fr, by rule."""
    doc = search.line_docs(lines)
    rows = doc.select("project_id", "node_id", "line_index", "line", F.explode(F.array(F.struct(F.lit("es").alias("lang"), F.lit(2).alias("every")), F.struct(F.lit("fr").alias("lang"), F.lit(3).alias("every")))).alias("x"))
    return rows.where("line_index % x.every = 0").select("project_id", "x.lang", F.col("node_id").alias("block_id"), F.col("node_id").alias("base_label"), "line_index", F.concat("x.lang", F.lit(": "), "line").alias("text"))


INDEXED = "docs AS (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY line_no) AS i, text FROM dialogue)"


@query(with_("dialogue", body=f", {INDEXED} SELECT 'es' AS lang, count(*) FILTER (WHERE i % 2 = 0) AS translated, count(*) FILTER (WHERE i % 2 <> 0) AS missing FROM docs UNION ALL SELECT 'fr', count(*) FILTER (WHERE i % 3 = 0), count(*) FILTER (WHERE i % 3 <> 0) FROM docs"))
def q5_translation_coverage(spark, d):
    lines = ad.dialogue(spark, d)
    docs = search.line_docs(lines).select("project_id", "node_id", "line_index")
    return translations.coverage(docs, _translated(lines), ["es", "fr"]).drop("project_id")


@query(with_("dialogue", body=f", {INDEXED} SELECT node_id, CAST(i AS INT) AS line_index, CASE WHEN i % 2 = 0 THEN 'es: ' || text ELSE text END AS text FROM docs"))
def j15_localized_lines(spark, d):
    lines = ad.dialogue(spark, d)
    docs = search.line_docs(lines).select("project_id", "node_id", "label", "line_index", F.col("line").alias("text"))
    tl = _translated(lines).withColumn("base_label", F.lit(None).cast("string"))
    return translations.localized_lines(docs, tl, "es").select("node_id", "line_index", "text")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey ELSE 'b' || p_partkey || '_0123abcd' END AS block_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey WHEN p_partkey % 5 = 0 THEN 'alias' || p_partkey ELSE 'b' || p_partkey || '_0123abcd' END AS node_id FROM part""")
def j16_canonical_ids(spark, d):
    k = F.col("p_partkey")
    s = lambda p, x="": F.concat(F.lit(p), k.cast("string"), F.lit(x))
    p = ad.table(spark, d, "part").select(F.lit("p").alias("project_id"), "p_partkey")
    blocks = p.withColumn("block_id", F.when(k % 2 == 0, s("p")).otherwise(s("b", "_0123abcd")))
    nodes = p.where("p_partkey % 2 = 0").select("project_id", s("p").alias("id")).unionAll(p.where("p_partkey % 3 = 0").select("project_id", s("b")))
    alias = p.where("p_partkey % 5 = 0").select("project_id", s("b").alias("alias"), s("alias").alias("id"))
    return translations.canonical_ids(blocks, nodes, alias).select("p_partkey", "block_id", "node_id")


@query(with_("dialogue", body="""SELECT chapter AS section, row_number() OVER (PARTITION BY chapter ORDER BY node_ord, line_no) AS ord, speaker || ': "' || replace(text, '"', '\\"') || '"' AS line FROM dialogue"""))
def k4_storyboard(spark, d):
    return exports.storyboard(ad.dialogue(spark, d)).drop("project_id")


@query(with_("dialogue", body=f"""SELECT row_number() OVER (ORDER BY word_count DESC, line_count DESC, speaker) AS ord, speaker || ',' || line_count || ',' || word_count || ',' || CASE WHEN lp = floor(lp) THEN CAST(CAST(lp AS BIGINT) AS VARCHAR) ELSE CAST(lp AS VARCHAR) END || ',' || CASE WHEN pc = floor(pc) THEN CAST(CAST(pc AS BIGINT) AS VARCHAR) ELSE CAST(pc AS VARCHAR) END AS line
FROM (SELECT *, CAST(round(word_count * 100.0 / sum(word_count) OVER (), 1) AS DOUBLE) AS pc, CAST(round(line_count * 100.0 / sum(line_count) OVER (), 1) AS DOUBLE) AS lp FROM (SELECT speaker, count(*) AS line_count, CAST(sum({WORDS}) AS BIGINT) AS word_count FROM dialogue GROUP BY speaker))
UNION ALL SELECT 0, 'Character / Speaker,Dialogue Line Count,Word Count,Line Share (%),Word Share (%)'"""))
def k1_characters_csv(spark, d):
    return exports.characters_csv(analytics.character_distribution(ad.dialogue(spark, d))).select("ord", "line")


@query(with_("edges", "nodes", body="""SELECT '1 nodes' AS section, row_number() OVER (ORDER BY node_ord) AS ord, '  ' || id || CASE type WHEN 'MENU' THEN '{{"' || label || '"}}' WHEN 'DECISION' THEN '{"' || label || '"}' ELSE '["' || label || '"]' END AS line FROM nodes
UNION ALL SELECT '1 nodes', 0, 'flowchart TD'
UNION ALL SELECT '2 edges', row_number() OVER (ORDER BY edge_ord), '  ' || source || ' ' || CASE WHEN label <> '' THEN '-->|' || label || '|' ELSE '-->' END || ' ' || target FROM edges"""))
def k3_mermaid(spark, d):
    return exports.mermaid(ad.nodes(spark, d), ad.edges(spark, d)).drop("project_id")


@query(with_("nodes", body="SELECT id, 'n' || row_number() OVER (ORDER BY node_ord) AS alias FROM nodes"))
def w8_alias_ids(spark, d):
    return exports.aliases(ad.nodes(spark, d)).select("id", "alias")


@query(with_("edges", "nodes", body=""", al AS (SELECT id, 'n' || row_number() OVER (ORDER BY node_ord) AS a FROM nodes)
SELECT 'e' || row_number() OVER (ORDER BY edge_ord) AS id, s.a AS source, t.a AS target, kind FROM edges e JOIN al s ON e.source = s.id JOIN al t ON e.target = t.id"""))
def k7_redacted_bundle(spark, d):
    return exports.redacted(ad.nodes(spark, d), ad.edges(spark, d))[1].drop("project_id")


@query(with_("edges", "nodes", body="""SELECT 'nodes' AS section, row_number() OVER (ORDER BY node_ord) AS ord, id, word_count, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target, label FROM nodes
UNION ALL SELECT 'edges', row_number() OVER (ORDER BY edge_ord), id, NULL, source, target, label FROM edges"""))
def k6_graph_json(spark, d):
    j = exports.graph_json(ad.nodes(spark, d), ad.edges(spark, d))
    at = lambda c: F.get_json_object("line", f"$.{c}").alias(c)
    return j.select("section", "ord", at("id"), at("word_count").cast("int").alias("word_count"), at("source"), at("target"), at("label"))
