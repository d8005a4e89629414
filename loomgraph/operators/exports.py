"""Reports as rows of text: CSV, Markdown, diagrams, storyboards, walkthroughs, JSON, redacted bundles.

Each gives (project_id, section, ord, line), so that a writer can partition by project and sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import csv_cell, format_minutes, markdown_cell, reading_seconds
from loomgraph.plans.lineage import numbered


def _lines(df: DataFrame, section: str, order: list, line: Column) -> DataFrame:
    rows = numbered(df.withColumn("__line", line), ["project_id"], order, "__ord")
    return rows.select("project_id", F.lit(section).alias("section"), F.col("__ord").alias("ord"), F.col("__line").alias("line"))


def _csv(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


#: The first lines of the CSV files.
ENDINGS_HEADER = "Ending Node ID,Ending Label,Chapter,Classification,Reachable Routes Count,Word Count,Pause Duration (s),Dialogue Lines,Status"
CHARACTERS_HEADER = "Character / Speaker,Dialogue Line Count,Word Count,Line Share (%),Word Share (%)"
ROUTES_HEADER = "Route ID,Terminal Ending,Ending Type,Word Count,Estimated Reading Time,Dialogue Lines,Choice Count,Step Count,Has Loop/Cycle,Key Decision Choices,Traversed Chapters"


def _headed(df: DataFrame, section: str, header: str) -> DataFrame:
    top = df.select("project_id").distinct().select("project_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(header).alias("line"))
    return top.unionByName(df)


def number(c: str | Column) -> Column:
    """A number as text, whole ones without a fraction."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def endings_csv(matrix: DataFrame) -> DataFrame:
    """Endings that can be reached first, then the others, each in the order of their ids."""
    reached = F.col("status") == "Reachable"
    status = F.when(reached, "Reachable").otherwise("Unreachable (Dead-end)")
    cells = [F.col("node_id"), F.col("label"), F.coalesce("chapter", F.lit("Uncategorized")), F.col("ending_type"), F.col("routes"), F.col("word_count"), number("pause_duration"), F.col("dialogue_count"), status]
    return _headed(_lines(matrix, "endings", [~reached, "node_id"], _csv(cells)), "endings", ENDINGS_HEADER)


def characters_csv(characters: DataFrame) -> DataFrame:
    line = _csv([F.col("speaker"), F.col("line_count"), F.col("word_count"), number("line_percent"), number("percent")])
    return _headed(_lines(characters, "characters", [F.desc("word_count"), F.desc("line_count"), "speaker"], line), "characters", CHARACTERS_HEADER)


def routes_csv(routes: DataFrame, nodes: DataFrame, endings: DataFrame, wpm: float = 200.0) -> DataFrame:
    """A line per route of ``routes.enumerate_routes``. Labels, lines and chapters of its steps come from ``nodes``, the ending's type from ``endings``;
    chapters stand in the order in which they are first met; a choice is given by the label of what it leaves."""
    key = ["project_id", "route_id"]
    n = nodes.select("project_id", F.col("id").alias("node"), "label", F.coalesce("chapter", F.lit("Uncategorized")).alias("chapter"), "dialogue_count")
    steps = routes.select(*key, F.posexplode("path").alias("pos", "node")).join(n, ["project_id", "node"])
    first = steps.groupBy(*key, "chapter").agg(F.min("pos").alias("pos"), F.sum("dialogue_count").alias("said"))
    walked = first.groupBy(*key).agg(F.sum("said").cast("long").alias("said"), F.array_sort(F.collect_list(F.struct("pos", "chapter"))).alias("met"))
    chosen = routes.select(*key, F.posexplode("choices").alias("pos", "c")).select(*key, "pos", F.col("c.menu").alias("node"), F.coalesce("c.text", F.lit("Choice")).alias("text"))
    menu = F.coalesce("label", "node")
    chosen = chosen.join(n.select("project_id", "node", "label"), ["project_id", "node"], "left").select(*key, "pos", F.concat(menu, F.lit(" -> ["), F.regexp_replace("text", r"[\r\n]+", " "), F.lit("]")).alias("line"))
    chosen = chosen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("chosen"))
    ends = endings.select("project_id", F.col("node_id").alias("ending"), F.col("label").alias("ending_label"), "ending_type")
    r = routes.join(ends, ["project_id", "ending"]).join(walked, key).join(chosen, key, "left")
    line = _csv([
        F.col("route_id"), F.col("ending_label"), F.col("ending_type"), F.col("words"), format_minutes(reading_seconds(F.col("words"), F.col("pause"), wpm)), F.col("said"), F.size("choices"), F.size("path"),
        F.when(F.col("has_cycle"), "Yes").otherwise("No"), F.coalesce(F.array_join(F.transform("chosen", lambda x: x["line"]), " | "), F.lit("")), F.array_join(F.transform("met", lambda x: x["chapter"]), ", "),
    ])
    return _headed(_lines(r, "routes", ["route_ord"], line), "routes", ROUTES_HEADER)


#: Headings of the report's sections, with what stands below each.
TITLE = ("# Narrative & Ending Analytics Report", "", "## Executive Summary", "")
MATRIX = ("## Ending Matrix", "", "| Ending Label | Chapter | Classification | Reachable Routes | Word Count | Dialogue Lines |", "| :--- | :--- | :--- | :---: | :---: | :---: |")
LOCKOUTS = (
    "## Points of No Return (Choice Lockouts)", "", "Key decision branches that permanently eliminate alternative ending outcomes:", "",
    "| Menu / Decision | Choice Branch | Target Label | Eliminated Endings | Lock-in Status |", "| :--- | :--- | :--- | :--- | :--- |",
)
PACING = ("## Chapter Pacing & Dialogue Density", "", "| Chapter | Dialogue Lines | Word Count | Menus | Choices | Dialogue/Choice Ratio | Est. Reading Time | Monologues |", "| :--- | :---: | :---: | :---: | :---: | :---: | :---: | :---: |")
SPEAKERS = ("## Speaking Character Dialogue Breakdown", "", "| Speaker | Line Count | Word Count | Dialogue Share (%) | Word Share (%) |", "| :--- | :---: | :---: | :---: | :---: |")


def _table(projects: DataFrame, rows: DataFrame, section: str, heading: tuple[str, ...], order: list, line: Column, empty: bool) -> DataFrame:
    """A section: its heading, a line per row, a blank line; without rows only if ``empty``."""
    body = _lines(rows, section, order, line)
    there = projects if empty else projects.join(rows.select("project_id").distinct(), "project_id", "left_semi")
    top = there.select("project_id", F.lit(section).alias("section"), F.posexplode(F.array(*[F.lit(h) for h in heading])).alias("k", "line")).select("project_id", "section", (F.col("k") - len(heading) + 1).cast("long").alias("ord"), "line")
    last = there.select("project_id", F.lit(section).alias("section"), F.lit((1 << 62)).cast("long").alias("ord"), F.lit("").alias("line"))
    return top.unionByName(body).unionByName(last)


def analytics_markdown(summary: DataFrame, matrix: DataFrame, no_return: DataFrame, pacing: DataFrame, characters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The report of each project of ``summary`` (``analytics.narrative_summary``): sections in order of ``section``, lines by ``ord``.

    ``matrix``: ``ending_matrix``; ``no_return``: ``points_of_no_return``, whose nodes and choices are named from ``nodes`` and ``edges``; ``pacing``:
    ``chapter_pacing``, whose monologues count where it has them. Chapters stand in alphabetical order. Points of no return and speakers have no section where there are none.
    """
    many = lambda c: F.format_number(F.col(c), 0)
    cell = lambda c: markdown_cell(F.col(c))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    coded = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    projects = summary.select("project_id").distinct()
    reached = F.col("status") == "Reachable"
    counts = matrix.groupBy("project_id").agg(F.count_if(reached).alias("reachable"), F.count_if(~reached).alias("unreachable"))
    point = lambda name, value: F.concat(F.lit(f"- **{name}**: "), value)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    cut_short = F.when(F.col("truncated"), " *(enumeration limit reached)*").otherwise("") if "truncated" in summary.columns else F.lit("")
    facts = [
        point("Total Story Endings Discovered", zero("endings")), point("Reachable Endings", zero("reachable")), point("Unreachable / Orphan Endings", zero("unreachable")), point("Total Distinct Story Routes", F.concat(zero("routes"), cut_short)),
        point("Total Unique Story Words", F.concat(F.lit("~"), many("unique_words"), F.lit(" words"))), point("Total Unique Reading Time", format_minutes(F.col("unique_seconds"))), point("Average Route Playthrough Duration", format_minutes(F.col("average_seconds"))),
    ]
    named = matrix.select("project_id", F.col("node_id").alias("e"), F.col("label").alias("l"))
    s = summary.join(counts, "project_id", "left")
    for which in ("shortest", "longest"):
        s = s.join(named.withColumnsRenamed({"e": which, "l": f"{which}_label"}), ["project_id", which], "left")
        told = F.concat(format_minutes(F.col(f"{which}_seconds")), F.lit(" (~"), many(f"{which}_words"), F.lit(" words, Ending: "), coded(markdown_cell(F.coalesce(f"{which}_label", which))), F.lit(")"))
        facts.append(point(f"{which.title()} Route", told))
    facts += [point("Global Dialogue-to-Choice Ratio", F.concat(number("lines_per_menu"), F.lit(" lines/choice"))), point("Global Branching Factor", F.concat(number("choices_per_menu"), F.lit(" options/menu"))), F.lit("")]
    lines = F.filter(F.array(*[F.lit(t) for t in TITLE], *facts), lambda x: x.isNotNull())
    head = s.select("project_id", F.lit("1 summary").alias("section"), F.posexplode(lines).alias("k", "line")).select("project_id", "section", F.col("k").cast("long").alias("ord"), "line")
    name = F.when(reached, bold(cell("label"))).otherwise(F.concat(F.lit("\u26a0\ufe0f "), bold(cell("label")), F.lit(" *(unreachable)*")))
    ends = _table(projects, matrix, "2 endings", MATRIX, [~reached, "node_id"], row(name, markdown_cell(F.coalesce("chapter", F.lit("Uncategorized"))), coded(F.col("ending_type")), F.when(reached, F.col("routes").cast("string")).otherwise("0"), many("word_count"), F.col("dialogue_count").cast("string")), True)
    called = nodes.select("project_id", F.col("id").alias("i"), F.col("label").alias("l"))
    lost = no_return.join(edges.select("project_id", F.col("id").alias("edge_id"), F.col("label").alias("choice")).dropDuplicates(["project_id", "edge_id"]), ["project_id", "edge_id"], "left")
    for end in ("source", "target"):
        lost = lost.join(called.withColumnsRenamed({"i": end, "l": f"{end}_label"}), ["project_id", end], "left")
    choice = F.when(F.length("choice") > 0, F.concat(F.lit('"'), cell("choice"), F.lit('"'))).otherwise("Branch")
    gone = coded(F.array_join(F.transform("eliminated", markdown_cell), "`, `"))
    points = _table(projects, lost, "3 no return", LOCKOUTS, ["edge_id"], row(coded(markdown_cell(F.coalesce("source_label", "source"))), choice, coded(markdown_cell(F.coalesce("target_label", "target"))), gone, F.when(F.col("is_lock_in"), "**Final Ending Lock-in**").otherwise("Eliminates branches")), False)
    alone = F.col("monologues") if "monologues" in pacing.columns else F.lit(0)
    long_ = F.when(alone > 0, F.concat(F.lit("\u26a0\ufe0f "), alone.cast("string"), F.lit(" section(s)"))).otherwise("None")
    pace = _table(projects, pacing, "4 pacing", PACING, ["chapter"], row(bold(cell("chapter")), many("lines"), many("words"), F.col("menus").cast("string"), F.col("choices").cast("string"), number("lines_per_menu"), F.col("reading_time"), long_), True)
    share = lambda c: F.concat(number(c), F.lit("%"))
    people = _table(projects, characters, "5 speakers", SPEAKERS, [F.desc("word_count"), F.desc("line_count"), "speaker"], row(bold(cell("speaker")), many("line_count"), many("word_count"), share("line_percent"), share("percent")), False)
    return reduce(DataFrame.unionByName, [head, ends, points, pace, people])


#: Words a diagram keeps for itself.
RESERVED = ("end", "subgraph", "flowchart", "graph", "style", "class", "classdef", "click", "call", "interpolate", "linkstyle")
#: How signs with a meaning of their own are written in a diagram, in the order in which they are replaced.
ESCAPES = ((r"\\", "#92;"), ('"', "#quot;"), (r"\|", "#124;"), ("<", "&lt;"), (">", "&gt;"), (r"\r\n|\r|\n", "<br/>"), (r"\[", "#91;"), (r"\]", "#93;"), (r"\{", "#123;"), (r"\}", "#125;"))


def safe_ids(nodes: DataFrame) -> DataFrame:
    """project_id, id, safe: identifiers for diagrams. A name of letters, digits and underlines that is no word of the diagram stays, others become
    ``n_<place>_<name>`` with the place from 0 in the order of nodes; of equal ones the k-th has ``_<k - 1>`` added."""
    placed = numbered(nodes.select("project_id", "id", "node_ord"), ["project_id"], ["node_ord"], "__at")
    plain = F.col("id").rlike(r"^[A-Za-z][A-Za-z0-9_]*$") & ~F.lower("id").isin(*RESERVED)
    made = F.concat(F.lit("n_"), (F.col("__at") - 1).cast("string"), F.lit("_"), F.regexp_replace("id", r"[^A-Za-z0-9_]", "_"))
    w = Window.partitionBy("project_id", "__s").orderBy("__at")
    n = placed.select("project_id", "id", "__at", F.when(plain, F.col("id")).otherwise(made).alias("__s")).withColumn("__k", F.row_number().over(w))
    return n.select("project_id", "id", F.when(F.col("__k") > 1, F.concat("__s", F.lit("_"), (F.col("__k") - 1).cast("string"))).otherwise(F.col("__s")).alias("safe"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A diagram's lines: its kind, the nodes, the edges. Ends of edges that are no node get identifiers behind those of the nodes, by their name; an
    edge back from a call says where to (``return_target``)."""
    there = nodes.select("project_id", "id", F.struct(F.lit(0).alias("x"), F.col("node_ord").alias("o"), F.lit("").alias("n")).alias("node_ord"))
    ends = edges.select("project_id", F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("project_id", "id"), ["project_id", "id"], "left_anti")
    ids = safe_ids(there.unionByName(ends.select("project_id", "id", F.struct(F.lit(1).alias("x"), F.lit(None).cast(nodes.schema["node_ord"].dataType).alias("o"), F.col("id").alias("n")).alias("node_ord"))))
    q = lambda c: F.trim(reduce(lambda s, e: F.regexp_replace(s, *e), ESCAPES, F.coalesce(c, F.lit(""))))
    n = nodes.join(ids, ["project_id", "id"])
    text = q(F.coalesce("label", "id"))
    shape = F.when(F.col("type") == "MENU", F.concat("safe", F.lit('{{"'), text, F.lit('"}}'))).when(F.col("type") == "DECISION", F.concat("safe", F.lit('{"'), text, F.lit('"}'))).otherwise(F.concat("safe", F.lit('["'), text, F.lit('"]')))
    a = _headed(_lines(n, "1 nodes", ["node_ord"], F.concat(F.lit("  "), shape)), "1 nodes", "flowchart TD")
    e = edges.join(ids.select("project_id", F.col("id").alias("source"), F.col("safe").alias("s")), ["project_id", "source"]).join(ids.select("project_id", F.col("id").alias("target"), F.col("safe").alias("t")), ["project_id", "target"])
    said = F.col("label")
    if "return_target" in edges.columns:
        said = F.when((F.col("kind") == "call_return") & (F.length("return_target") > 0), F.concat(F.lit("return to "), "return_target")).otherwise(said)
    arrow = F.when(F.length(said) > 0, F.concat(F.lit("-->|"), q(said), F.lit("|"))).otherwise("-->")
    return a.unionByName(_lines(e, "2 edges", ["edge_ord"], F.concat(F.lit("  "), "s", F.lit(" "), arrow, F.lit(" "), "t")))


def _heading(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"^#+\s*", ""))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("Untitled"))


def storyboard_nodes(nodes: DataFrame) -> DataFrame:
    """A storyboard with headings: chapters in alphabetical order (``section``), their nodes in order, each with its type and counts and its
    lines (``dialogue_lines``) as quotations; a line of several has a mark for each. Null or empty chapters: Uncategorized."""
    chapter = F.when(F.length("chapter") > 0, F.col("chapter")).otherwise("Uncategorized")
    facts = F.concat(F.lit("*Type: "), "type", F.lit(" | Dialogue Lines: "), F.col("dialogue_count").cast("string"), F.lit(" | Words: "), F.coalesce("word_count", F.lit(0)).cast("string"), F.lit("*"))
    spoken = F.flatten(F.transform(F.coalesce("dialogue_lines", F.array().cast("array<string>")), lambda x: F.transform(F.split(x, r"\r?\n"), lambda y: F.concat(F.lit("> "), y))))
    body = F.concat(F.array(F.concat(F.lit("### "), _heading(F.col("label"))), facts), F.when(F.size(spoken) > 0, F.concat(F.array(F.lit("")), spoken)).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    n = nodes.select("project_id", chapter.alias("chapter"), F.struct(F.lit(1).alias("x"), F.col("node_ord").alias("o")).alias("at"), body.alias("body"))
    none = F.lit(None).cast(nodes.schema["node_ord"].dataType)
    tops = n.select("project_id", "chapter").distinct().select("project_id", "chapter", F.struct(F.lit(0).alias("x"), none.alias("o")).alias("at"), F.array(F.concat(F.lit("## "), _heading(F.col("chapter"))), F.lit("")).alias("body"))
    each = n.unionByName(tops).select("project_id", F.concat(F.lit("2 "), "chapter").alias("section"), "at", F.posexplode("body").alias("k", "line"))
    rows = numbered(each, ["project_id", "section"], ["at", "k"], "ord").select("project_id", "section", "ord", "line")
    title = nodes.select("project_id").distinct().select("project_id", F.lit("1").alias("section"), F.posexplode(F.array(F.lit("# Narrative Storyboard"), F.lit(""))).alias("k", "line"))
    return title.select("project_id", "section", F.col("k").cast("long").alias("ord"), "line").unionByName(rows)


def storyboard(lines: DataFrame) -> DataFrame:
    """Chapters in order, their nodes and quoted lines (chapter, node_ord, node_id, line_no, speaker, text)."""
    said = F.concat(F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "))).otherwise(F.lit("")), F.lit('"'), F.replace("text", F.lit('"'), F.lit('\\"')), F.lit('"'))
    w = Window.partitionBy("project_id", "chapter").orderBy("node_ord", "line_no")
    return lines.select("project_id", F.coalesce("chapter", F.lit("Uncategorized")).alias("chapter"), "node_ord", "line_no", "speaker", "text").select("project_id", F.col("chapter").alias("section"), F.row_number().over(w).cast("long").alias("ord"), said.alias("line"))


def walkthrough(routes: DataFrame, form: str = "markdown") -> DataFrame:
    """Numbered steps of each route: markdown, bbcode or text. ``steps``: array of strings."""
    mark = {"markdown": ("", ". **", "**"), "bbcode": ("[*] ", ". [b]", "[/b]"), "text": ("", ". ", "")}[form]
    s = routes.select("project_id", F.col("route_id").alias("section"), F.posexplode("steps").alias("k", "step"))
    return s.select("project_id", "section", (F.col("k") + 1).cast("long").alias("ord"), F.concat(F.lit(mark[0]), (F.col("k") + 1).cast("string"), F.lit(mark[1]), "step", F.lit(mark[2])).alias("line"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON line per node and edge."""
    a = _lines(nodes, "nodes", ["node_ord"], F.to_json(F.struct(*nodes.columns)))
    return a.unionByName(_lines(edges, "edges", ["edge_ord"], F.to_json(F.struct(*edges.columns))))


def aliases(nodes: DataFrame) -> DataFrame:
    """Stable anonymous ids n1, n2, ... in order."""
    rows = numbered(nodes.select("project_id", "id", "node_ord"), ["project_id"], ["node_ord"], "__ord")
    return rows.select("project_id", "id", F.concat(F.lit("n"), F.col("__ord").cast("string")).alias("alias"))


def redacted(nodes: DataFrame, edges: DataFrame, with_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under aliases, without labels, chapters and conditions unless asked for.

    Ends that are no node become ``n_unmapped_<k>``.
    """
    ids = aliases(nodes)
    ends = edges.select("project_id", F.explode(F.array("source", "target")).alias("id")).distinct().join(ids, ["project_id", "id"], "left_anti")
    whole = ids.unionByName(numbered(ends, ["project_id"], ["id"], "__ord").select("project_id", "id", F.concat(F.lit("n_unmapped_"), F.col("__ord").cast("string")).alias("alias")))
    more = ["label", "chapter"] if with_labels else []
    n = nodes.join(ids, ["project_id", "id"]).select("project_id", F.col("alias").alias("id"), "type", "dialogue_count", "word_count", *more)
    e = edges.join(whole.select("project_id", F.col("id").alias("source"), F.col("alias").alias("s")), ["project_id", "source"]).join(whole.select("project_id", F.col("id").alias("target"), F.col("alias").alias("t")), ["project_id", "target"])
    e = numbered(e, ["project_id"], ["edge_ord"], "__ord")
    return n, e.select("project_id", F.concat(F.lit("e"), F.col("__ord").cast("string")).alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), "kind", *(["label", "expression"] if with_labels else []))


def write_text(lines: DataFrame, path: str) -> None:
    """One folder per project, lines in order of section and ord within each file."""
    ordered = lines.repartition("project_id").sortWithinPartitions("project_id", "section", "ord")
    ordered.select("project_id", "line").write.partitionBy("project_id").text(path)
