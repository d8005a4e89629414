"""Story tables derived from the star-schema tables, and the same as DuckDB SQL.

Each adapter has a DataFrame function and a CTE body of the same name in ``SQL``, so that a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: node_id, chapter, speaker, line_no, text (with a pause tag and a reference)."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("{w="), F.col("turn").cast("string"), F.lit("}"), F.col("text"), F.lit(" [flag_"), (F.col("conv_id") % 5).cast("string"), F.lit("]"))
    return c.select(
        F.lit("p").alias("project_id"), F.col("conv_id").alias("node_ord"), _name("conv_", F.col("conv_id")).alias("node_id"),
        _name("ch", F.col("conv_id") % 10).alias("chapter"), F.col("role").alias("speaker"), F.col("turn").alias("line_no"), text.alias("text"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node per part."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "MENU").when(size % 5 == 1, "DECISION").otherwise("LABEL")
    return table(spark, sf_dir, "part").select(
        F.lit("p").alias("project_id"), F.col("p_partkey").cast("long").alias("node_ord"), _name("p", F.col("p_partkey")).alias("id"), kind.alias("type"),
        F.when(kind == "LABEL", "story").when(kind == "MENU", "menu").otherwise("decision").alias("role"),
        F.col("p_name").alias("label"), F.col("p_brand").alias("chapter"), size.cast("int").alias("dialogue_count"),
        F.floor("p_retailprice").cast("int").alias("word_count"), (size % 3).cast("double").alias("pause_duration"),
        F.lit(False).alias("is_shadowed"), F.lit(False).alias("is_terminal_outcome"),
    )


def edges(spark: SparkSession, sf_dir: str, orders: str = "true") -> DataFrame:
    """An edge per neighbouring lines of an order (those of ``orders``): parallel edges, cycles and self loops occur."""
    li = table(spark, sf_dir, "lineitem").where(orders)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    nth = F.row_number().over(w)
    rows = li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_discount",
        nth.alias("nth"), F.lead("l_partkey").over(w).alias("next"),
    ).where("next is not null")
    kind = F.when(F.col("l_returnflag") == "A", "jump").when(F.col("l_returnflag") == "N", "sequence").otherwise("call")
    return rows.select(
        F.lit("p").alias("project_id"), (F.col("l_orderkey") * 1000 + F.col("nth")).cast("long").alias("edge_ord"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("nth").cast("string")).alias("id"),
        _name("p", F.col("l_partkey")).alias("source"), _name("p", F.col("next")).alias("target"), kind.alias("kind"),
        F.when(F.col("l_linestatus") == "O", _name("opt", F.col("l_linenumber"))).alias("label"),
        F.when(F.col("l_discount") > 0.05, F.lit("disc > 0.05")).alias("expression"),
        F.lit(False).alias("condition_is_statically_false"),
    )


def dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sparse forward edges (target key over source key, every twentieth order) and their nodes."""
    return _forward(spark, sf_dir, "l_orderkey % 20 = 0")


def forward(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All forward edges (target key over source key) and their nodes."""
    return _forward(spark, sf_dir, "true")


def _forward(spark: SparkSession, sf_dir: str, orders: str) -> tuple[DataFrame, DataFrame]:
    """Forward edges of some orders and their nodes, written once, as searches read them again and again."""
    e = cut(edges(spark, sf_dir, orders).where(F.substring("target", 2, 20).cast("long") > F.substring("source", 2, 20).cast("long")))
    ends = e.select(F.col("source").alias("id")).unionAll(e.select("target")).distinct()
    return cut(nodes(spark, sf_dir).join(ends, "id", "left_semi")), e


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A node per event; an edge to the user's next event if it is of the same type."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    rows = ev.select("event_id", "user_id", "event_type", "value", F.lead("event_id").over(w).alias("next"), F.lead("event_type").over(w).alias("next_type"))
    n = ev.select(
        F.lit("p").alias("project_id"), F.col("event_id").alias("node_ord"), _name("e", F.col("event_id")).alias("id"), F.lit("LABEL").alias("type"), F.lit("story").alias("role"),
        F.col("event_type").alias("label"), _name("u", F.col("user_id")).alias("chapter"), (F.col("event_id") % 20).cast("int").alias("dialogue_count"),
        F.floor("value").cast("int").alias("word_count"), F.lit(0.0).alias("pause_duration"),
    )
    e = rows.where("next is not null and event_type = next_type").select(
        F.lit("p").alias("project_id"), F.col("event_id").alias("edge_ord"), _name("c", F.col("event_id")).alias("id"),
        _name("e", F.col("event_id")).alias("source"), _name("e", F.col("next")).alias("target"), F.lit("sequence").alias("kind"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("expression"), F.lit(False).alias("condition_is_statically_false"),
    )
    return n, e


def variables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Declared and referenced variable names (project_id, name, ord)."""
    name = F.concat_ws("_", "p_type", F.col("p_size").cast("string"), "p_brand")
    rows = table(spark, sf_dir, "part").select(F.lit("p").alias("project_id"), name.alias("name"), F.col("p_partkey").cast("long").alias("ord"))
    return rows.where("ord % 3 = 1"), rows.where("ord % 3 = 0")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files: an image for two parts in three."""
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(
        F.lit("p").alias("project_id"), F.concat(F.lit("images/"), "p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.col("p_partkey").cast("long").alias("ord"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset cues: a line of an order shows or plays its part."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return li.join(p.hint("merge"), li["l_partkey"] == p["p_partkey"]).select(
        F.lit("p").alias("project_id"), _name("o", F.col("l_orderkey")).alias("node_id"), F.col("l_linenumber").alias("line_num"),
        F.when(F.col("l_returnflag") == "A", "play").otherwise("show").alias("type"),
        F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("asset"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files, one per conversation, of six shapes by its number: a jump; a menu of two jumps; a menu with a
    way on behind it; a decision with a jump, a return and a call; a return; a loop with a call and a decision."""
    k = F.col("conv_id")
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("    "), "role", F.lit(' "turn '), F.col("turn").cast("string"), F.lit('"')).alias("line")))).alias("lines"))
    to = lambda n: F.concat(F.lit("conv_"), (k + n).cast("string"))
    shapes = (
        ("    jump ", to(1)), ('    menu:\n        "Next":\n            jump ', to(1), '\n        "Skip" if score > 3:\n            jump ', to(2)),
        ("    menu m_", k.cast("string"), ':\n        "Stay":\n            user "I stay"\n        "Go":\n            jump ', to(1), '\n    user "After"\n    user "That"\n    jump ', to(2)),
        ("    if flag_", (k % 5).cast("string"), ":\n        jump ", to(1), "\n    elif n > 2:\n        return\n    else:\n        call ", to(2), '\n    user "Then"\n    jump ', to(3)),
        ("    return",), ("    while lives > 0:\n        call ", to(-1), "\n        if lives == 1:\n            jump ", to(1), '\n    $ renpy.jump("', to(2), '")'),
    )
    tails = [F.concat(*[F.lit(x) if isinstance(x, str) else x for x in shape]) for shape in shapes]
    tail = F.element_at(F.array(*tails), (k % 6 + 1).cast("int"))
    content = F.concat(F.lit("label "), to(0), F.lit(":\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"), tail)
    return said.select(F.lit("p").alias("project_id"), F.concat(to(0), F.lit(".rpy")).alias("path"), k.cast("int").alias("file_ord"), content.alias("content"))


#: CTE bodies for DuckDB.
SQL = {
    "dialogue": """SELECT conv_id AS node_ord, 'conv_' || conv_id AS node_id, 'ch' || (conv_id % 10) AS chapter, role AS speaker, turn AS line_no,
      '{w=' || turn || '}' || text || ' [flag_' || (conv_id % 5) || ']' AS text FROM conversations""",
    "nodes": """SELECT CAST(p_partkey AS BIGINT) AS node_ord, 'p' || p_partkey AS id,
      CASE WHEN p_size % 5 = 0 THEN 'MENU' WHEN p_size % 5 = 1 THEN 'DECISION' ELSE 'LABEL' END AS type,
      CASE WHEN p_size % 5 = 0 THEN 'menu' WHEN p_size % 5 = 1 THEN 'decision' ELSE 'story' END AS role,
      p_name AS label, p_brand AS chapter, CAST(p_size AS INT) AS dialogue_count, CAST(floor(p_retailprice) AS INT) AS word_count,
      CAST(p_size % 3 AS DOUBLE) AS pause_duration FROM part""",
    "edges": """SELECT CAST(l_orderkey * 1000 + nth AS BIGINT) AS edge_ord, l_orderkey || '_' || nth AS id, 'p' || l_partkey AS source, 'p' || nxt AS target,
      CASE l_returnflag WHEN 'A' THEN 'jump' WHEN 'N' THEN 'sequence' ELSE 'call' END AS kind,
      CASE WHEN l_linestatus = 'O' THEN 'opt' || l_linenumber END AS label, CASE WHEN l_discount > 0.05 THEN 'disc > 0.05' END AS expression,
      l_orderkey, l_partkey AS s_key, nxt AS t_key
      FROM (SELECT *, row_number() OVER w AS nth, lead(l_partkey) OVER w AS nxt FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) WHERE nxt IS NOT NULL""",
    "dag_edges": "SELECT * FROM edges WHERE t_key > s_key AND l_orderkey % 20 = 0",
    "dag_nodes": "SELECT * FROM nodes WHERE id IN (SELECT source FROM dag_edges UNION SELECT target FROM dag_edges)",
    "forward_edges": "SELECT * FROM edges WHERE t_key > s_key",
    "forward_nodes": "SELECT * FROM nodes WHERE id IN (SELECT source FROM forward_edges UNION SELECT target FROM forward_edges)",
    "chain_nodes": """SELECT event_id AS node_ord, 'e' || event_id AS id, event_type AS label, 'u' || user_id AS chapter, CAST(event_id % 20 AS INT) AS dialogue_count,
      CAST(floor(value) AS INT) AS word_count FROM events""",
    "chain_edges": """SELECT 'c' || event_id AS id, event_id AS s_key, nxt AS t_key, 'e' || event_id AS source, 'e' || nxt AS target
      FROM (SELECT *, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS nxt_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE nxt IS NOT NULL AND event_type = nxt_type""",
    "vars": "SELECT p_type || '_' || p_size || '_' || p_brand AS name, CAST(p_partkey AS BIGINT) AS ord FROM part",
    "declared": "SELECT * FROM vars WHERE ord % 3 = 1",
    "referenced": "SELECT * FROM vars WHERE ord % 3 = 0",
    "media": "SELECT 'images/' || p_name || '_' || p_partkey || '.png' AS path, CAST(p_partkey AS BIGINT) AS ord FROM part WHERE p_partkey % 3 <> 0",
    "cues": """SELECT 'o' || l_orderkey AS node_id, l_linenumber AS line_num, CASE WHEN l_returnflag = 'A' THEN 'play' ELSE 'show' END AS type, p_name || '_' || p_partkey AS asset
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def with_(*names: str, body: str, recursive: bool = False) -> str:
    """A query over adapters: WITH name AS (...), ... body. A body may go on with ``, name AS (...)``."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body.strip()
