"""Scripts to tables, line by line: statements, labels, say lines, menus, transfers, decisions.

A line is classified by patterns; blocks come from indentation. All windows run over one file
(project_id, path), so that files share no task. Constructs must stand on one line each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import condition_refs

FILE = ["project_id", "path"]
#: A quoted string; possessive, so that long ones need neither stack nor backtracking.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\x27[^\x27\\]*+(?:\\.[^\x27\\]*+)*+\x27'
#: What a statement of the language starts with, tried in this order.
PATTERNS = (
    ("label", r"^label\s+(\.?[A-Za-z_][\w.]*)\s*(?:\(([^)]*)\))?\s*:"),
    ("menu", r"^menu(?:\s+([A-Za-z_]\w*))?\s*(?:\([^)]*\))?\s*:"),
    ("item", rf"^({STRING})(?:\s*\([^)]*\))?(?:\s+if\s+(.+?))?\s*:$"),
    ("jump_expression", r"^jump\s+expression\s+(.+)$"),
    ("jump", r"^jump\s+(\.?[A-Za-z_][\w.]*)\s*$"),
    ("call_screen", r"^call\s+screen\s+([A-Za-z_]\w*)"),
    ("call_expression", r"^call\s+expression\s+(.+)$"),
    ("call", r"^call\s+(\.?[A-Za-z_][\w.]*)\s*(?:\(([^)]*)\))?(?:\s+from\s+(\w+))?\s*$"),
    ("return", r"^return(?:\s+(.+))?$"),
    ("if", r"^if\s+(.+?)\s*:$"), ("elif", r"^elif\s+(.+?)\s*:$"), ("else", r"^else\s*:()$"),
    ("while", r"^while\s+(.+?)\s*:$"), ("for", r"^for\s+(.+?)\s*:$"), ("match", r"^match\s+(.+?)\s*:$"), ("case", r"^case\s+(.+?)\s*:$"),
    ("init", r"^init(?:\s+(-?\d+))?(?:\s+python)?[^:=]*:$"), ("python", r"^python\b\s*([^:]*):$"),
    ("define", r"^define\s+(?:-?\d+\s+)?([A-Za-z_][\w.]*)\s*=\s*(.+)$"), ("default", r"^default\s+(?:-?\d+\s+)?([A-Za-z_][\w.]*)\s*=\s*(.+)$"),
    ("screen", r"^screen\s+([A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*:"),
    ("timed", r"^(?:\$\s*)?(?:renpy\.)?timedchoice\b\s*\(?(.*?)\)?$"),
    ("mutation", r"^\$\s*([A-Za-z_][\w.]*)\s*(?::\s*\w+\s*)?(=|\+=|-=|\*\*=|\*=|//=|/=|%=)\s*(?!=)(.+)$"),
    ("cue", r"^(scene|show|hide|play|queue|stop|voice)\b\s*(.*)$"),
    ("translate", r"^translate\s+(\S+\s+\S+?)\s*:"),
    ("say", rf"^((?:[A-Za-z_][\w.]*(?:\s+@?-?[\w]+)*|{STRING})?)\s*({STRING})(?:\s+(?:with\s+\w+|nointeract))?$"),
)


def strip_comment(line: Column) -> Column:
    """Cuts from the first ``#`` outside quotes."""
    return F.regexp_replace(line, rf'^((?:[^#"\x27]++|{STRING})*+)#.*$', "$1")


def unquote(text: Column) -> Column:
    body = F.regexp_replace(F.trim(text), r'^["\x27]|["\x27]$', "")
    return F.regexp_replace(body, r"\\(.)", "$1")


def logical_lines(lines: DataFrame) -> DataFrame:
    """Lines with those that go on over open brackets or triple quotes put together: the text of the first, the others behind it with a
    space (in triple quotes with ``\\n``, in one pair of plain quotes), under the first one's number and indent.

    Brackets count outside of quotes and comments. What is open runs sum up over the file, anew at every label, so that a bracket that is
    never closed swallows no more than its label. All columns stay.
    """
    triple = r'"""|\x27\x27\x27'
    d = lines.withColumn("__label", F.sum(F.col("text").rlike(r"^\s*(?:label|screen|init|translate)\b").cast("int")).over(Window.partitionBy(*FILE).orderBy("line_no")))
    d = d.withColumn("__quotes", F.when(F.trim("text").startswith("#"), 0).otherwise(F.regexp_count("text", F.lit(triple))))
    w = Window.partitionBy(*FILE, "__label").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__quotes").over(before), F.lit(0)) % 2 == 1)
    # a line's own code: without quoted parts, comments, and what lies in triple quotes
    last, first = F.regexp_replace("text", rf"^.*(?:{triple})", ""), F.regexp_replace("text", rf"(?:{triple}).*$", "")
    code = F.when(F.col("__in"), F.when(F.col("__quotes") % 2 == 1, last).otherwise("")).otherwise(F.when(F.col("__quotes") > 0, first).otherwise(F.col("text")))
    code = F.regexp_replace(F.regexp_replace(code, STRING, ""), "#.*$", "")
    d = d.withColumn("__open", F.length(F.regexp_replace(code, r"[^(\[{]", "")) - F.length(F.regexp_replace(code, r"[^)\]}]", "")))
    d = d.withColumn("__starts", (F.coalesce(F.sum("__open").over(before), F.lit(0)) <= 0) & ~F.col("__in"))
    d = d.withColumn("__line", F.coalesce(F.last(F.when(F.col("__starts"), F.col("line_no")), True).over(w), F.col("line_no")))
    piece = F.struct("line_no", F.when(F.col("line_no") == F.col("__line"), F.rtrim(F.when(F.col("text").contains("#") & (F.col("__open") > 0), strip_comment(F.col("text"))).otherwise(F.col("text")))).otherwise(F.trim(F.when(F.col("__in"), F.col("text")).otherwise(strip_comment(F.col("text"))))).alias("text"), (F.col("__in")).alias("quoted"))
    rest = [c for c in lines.columns if c not in (*FILE, "line_no", "text")]
    whole = d.groupBy(*FILE, F.col("__line").alias("line_no")).agg(F.sort_array(F.collect_list(piece)).alias("__all"), *[F.min_by(c, "line_no").alias(c) for c in rest])
    joined = F.aggregate("__all", F.lit(""), lambda acc, x: F.when(acc == "", x["text"]).when(x["quoted"], F.concat(acc, F.lit("\\n"), x["text"])).otherwise(F.concat(acc, F.lit(" "), x["text"])))
    plain = F.regexp_replace(joined, rf"(?:{triple})", '"')
    return whole.withColumn("text", F.when(F.size("__all") == 1, F.col("__all")[0]["text"]).otherwise(F.when(F.exists("__all", lambda x: x["quoted"]), plain).otherwise(joined))).select(*lines.columns)


def statements(lines: DataFrame) -> DataFrame:
    """Lines with kind, groups a, b, c, label_id, chapter and the enclosing block.

    ``block_line``, ``block_kind``, ``block_text`` and ``block_condition`` belong to the nearest earlier
    line with a smaller indent that opens a block (ends in a colon); ``block_path`` has the lines of
    all open blocks, outermost first; ``top_kind`` and ``top_text`` belong to the outermost. Local labels (``.x``) carry the last global label.
    """
    rows = _once(lines, "t", F.trim(strip_comment(F.col("text")))).where("t <> ''")
    group = lambda p, n: F.regexp_extract("t", p, n) if n <= re.compile(p).groups else F.lit("")
    tried = [F.when(F.col("t").rlike(p), F.array(F.lit(k), group(p, 1), group(p, 2), group(p, 3))) for k, p in PATTERNS]
    rest = F.when(F.col("t").startswith("$"), "python_line").otherwise("other")
    rows = _once(rows, "__m", F.coalesce(*tried, F.array(rest, F.lit(""), F.lit(""), F.lit(""))))
    part = lambda n: F.nullif(F.col("__m")[n], F.lit(""))
    rows = rows.select(*lines.columns, "t", F.col("__m")[0].alias("kind"), part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    w = Window.partitionBy(*FILE).orderBy("line_no")
    own = F.when(F.col("kind") == "label", F.col("a"))
    last_global = F.last(F.when(~own.startswith("."), own), True).over(w)
    rows = rows.withColumn("__g", last_global)
    full = F.when(own.startswith("."), F.concat(F.coalesce("__g", F.lit("")), own)).otherwise(own)
    rows = rows.withColumn("label_id", F.last(full, True).over(w)).withColumn("chapter", F.regexp_replace("path", r"\.rpy$", "")).drop("__g")
    ddl = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in _BLOCK.items()]])
    found = rows.sortWithinPartitions(*FILE, "line_no").mapInPandas(_blocks, ddl)
    return found.withColumn("block_text", unquote(F.col("block_text")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is worked out once a row, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


_BLOCK = {"block_line": T.IntegerType(), "block_kind": T.StringType(), "block_text": T.StringType(), "block_condition": T.StringType(), "block_path": T.ArrayType(T.IntegerType()), "top_kind": T.StringType(), "top_text": T.StringType()}


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the open blocks of the file at hand; lines come in order, files one after another."""
    at, stack = None, []
    for batch in batches:
        out = []
        for project, path, line, indent, t, kind, a, b in zip(*(batch[c] for c in (*FILE, "line_no", "indent", "t", "kind", "a", "b"))):
            if (project, path) != at:
                at, stack = (project, path), []
            while stack and stack[-1][0] >= indent:
                stack.pop()
            out.append((*(stack[-1][1:] if stack else (None, None, None, None)), [x[1] for x in stack], *(stack[0][2:4] if stack else (None, None))))
            if t.endswith(":"):
                stack.append((indent, line, kind, a, b))
        added = pd.DataFrame(out, columns=list(_BLOCK), index=batch.index).astype({"block_line": "Int32"})
        yield pd.concat([batch, added], axis=1)


def labels(stmts: DataFrame) -> DataFrame:
    """project_id, path, id, line_no, chapter, parameters (name, default_value)."""
    params = F.transform(F.filter(F.split(F.coalesce("b", F.lit("")), r"\s*,\s*"), lambda x: x != ""), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("name"), F.when(F.instr(x, "=") > 0, F.trim(F.regexp_replace(x, r"^[^=]*=", ""))).alias("default_value")))
    return stmts.where("kind = 'label'").select(*FILE, F.col("label_id").alias("id"), "line_no", "chapter", params.alias("parameters"))


def say_lines(stmts: DataFrame) -> DataFrame:
    """project_id, path, label_id, line_no, speaker, text; ``extend`` keeps the speaker, none is the narrator."""
    w = Window.partitionBy(*FILE, "label_id").orderBy("line_no")
    raw = F.regexp_replace(unquote(F.col("a")), r"\s.*$", "")
    said = stmts.where("kind = 'say'").withColumn("__s", F.when(F.col("a").rlike(r'^["\x27]'), unquote(F.col("a"))).otherwise(raw))
    last = F.last(F.when(F.coalesce("__s", F.lit("narrator")) != "extend", F.coalesce("__s", F.lit("narrator"))), True).over(w)
    return said.select(*FILE, "label_id", "chapter", "line_no", F.when(F.col("__s") == "extend", F.coalesce(last, F.lit("narrator"))).otherwise(F.coalesce("__s", F.lit("narrator"))).alias("speaker"), unquote(F.col("b")).alias("text"))


def menus(stmts: DataFrame) -> DataFrame:
    """MENU nodes: id (``menu_<name>``, else ``menu_<path>_<n>``), parent_label_id, line_no, items."""
    w = Window.partitionBy(*FILE).orderBy("line_no")
    m = stmts.where("kind = 'menu'").withColumn("__n", F.row_number().over(w))
    ids = F.when(F.col("a").isNotNull(), F.concat(F.lit("menu_"), "a")).otherwise(F.concat(F.lit("menu_"), "path", F.lit("_"), F.col("__n").cast("string")))
    items = stmts.where("kind = 'item' and block_kind = 'menu'").groupBy(*FILE, F.col("block_line").alias("line_no")).agg(F.count("*").alias("items"))
    return m.select(*FILE, ids.alias("id"), F.col("label_id").alias("parent_label_id"), "chapter", "line_no").join(items, [*FILE, "line_no"], "left").withColumn("items", F.coalesce("items", F.lit(0)))


def transfers(stmts: DataFrame) -> DataFrame:
    """Transfers line by line: source (the label they stand in), target, kind, label (the choice's text), condition, context, line_no.
    The edges of a graph, which leave menus and decisions, come from ``assemble.build``."""
    t = stmts.where("kind in ('jump', 'call')")
    target = F.when(F.col("a").startswith("."), F.concat(F.substring_index("label_id", ".", 1), "a")).otherwise(F.col("a"))
    in_item = F.col("block_kind") == "item"
    ids = F.concat("kind", F.lit("_"), "label_id", F.lit("__"), target, F.lit("_L"), F.col("line_no").cast("string"))
    return t.select(*FILE, ids.alias("id"), F.col("label_id").alias("source"), target.alias("target"), "kind", F.when(in_item, F.col("block_text")).alias("label"), F.when(in_item, F.col("block_condition")).alias("expression"), F.when(F.col("kind") == "call", F.coalesce("c", ids)).alias("context"), "line_no")


def dynamic_targets(stmts: DataFrame) -> DataFrame:
    """Jumps and calls to an expression."""
    return stmts.where("kind in ('jump_expression', 'call_expression')").select(*FILE, F.col("label_id").alias("source"), F.col("a").alias("expression"), "line_no", F.lit("dynamic_target").alias("category"))


def case_expression(pattern: Column, subject: Column) -> Column:
    """The condition of ``case pattern`` under ``match subject``; null where it takes all."""
    guard = F.nullif(F.regexp_extract(pattern, r"\s+if\s+(.+)$", 1), F.lit(""))
    pattern = F.trim(F.regexp_replace(pattern, r"\s+if\s+.+$", ""))
    one = lambda p: F.concat(F.lit("("), subject, F.lit(") == ("), F.trim(p), F.lit(")"))
    parts = F.split(pattern, r"\s*\|\s*")
    several = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), one(p), F.lit(")"))), " or ")
    any_name = pattern.rlike(r"^[A-Za-z_]\w*$") & (guard.isNotNull() | (pattern == "_"))
    match_ = F.when(F.size(parts) > 1, several).when(any_name, F.lit(None)).otherwise(one(pattern))
    return F.when(match_.isNotNull() & guard.isNotNull(), F.concat(F.lit("("), match_, F.lit(") and ("), guard, F.lit(")"))).otherwise(F.coalesce(match_, guard))


def decisions(stmts: DataFrame) -> DataFrame:
    """Branches: decision id (``decision_<label>_L<line>``), branch_kind, expression, references.

    ``elif`` and ``else`` belong to the last ``if`` of their indent; ``case p`` of ``match e`` has
    ``(e) == (p)``, alternatives are or-ed, a guard is and-ed, ``_`` matches all.
    """
    w = Window.partitionBy(*FILE, "indent").orderBy("line_no")
    d = stmts.where("kind in ('if', 'elif', 'else', 'while', 'for', 'case')")
    head = F.last(F.when(F.col("kind").isin("if", "while", "for"), F.col("line_no")), True).over(w)
    case = case_expression(F.col("a"), F.col("block_text"))
    expression = F.when(F.col("kind") == "case", case).otherwise(F.col("a"))
    start = F.when(F.col("kind") == "case", F.col("block_line")).otherwise(head)
    return d.select(*FILE, F.concat(F.lit("decision_"), "label_id", F.lit("_L"), start.cast("string")).alias("id"), F.col("label_id").alias("parent_label_id"), F.col("kind").alias("branch_kind"), expression.alias("expression"), condition_refs(expression).alias("references"), "line_no")


def prune_dead_ends(decisions_: DataFrame, stmts: DataFrame) -> DataFrame:
    """Decisions of which a branch jumps, calls or returns; the others drop out."""
    exits = stmts.where("kind in ('jump', 'call', 'return', 'jump_expression', 'call_expression')").select(*FILE, F.col("block_line").alias("line_no")).distinct().withColumn("__x", F.lit(True))
    alive = decisions_.join(exits, [*FILE, "line_no"], "left").groupBy(*FILE, "id").agg(F.max("__x").alias("__x")).where("__x").drop("__x")
    return decisions_.join(alive, [*FILE, "id"], "left_semi")


def fallthrough(stmts: DataFrame) -> DataFrame:
    """``seq_<a>__<b>`` from a label whose last top-level statement is no exit to the file's next label. A look at lines only: which
    labels all ways leave, ``assemble.build`` knows."""
    w = Window.partitionBy(*FILE).orderBy("line_no")
    ends = stmts.where("label_id is not null").groupBy(*FILE, "label_id").agg(F.min("line_no").alias("line_no"), F.max_by("kind", F.struct("line_no")).alias("last"), F.max_by("block_kind", "line_no").alias("within"))
    nxt = ends.withColumn("target", F.lead("label_id").over(w))
    open_ = ~(F.col("last").isin("jump", "return", "jump_expression") & (F.coalesce("within", F.lit("label")) == "label"))
    return nxt.where(open_ & F.col("target").isNotNull()).select(*FILE, F.concat(F.lit("seq_"), "label_id", F.lit("__"), "target").alias("id"), F.col("label_id").alias("source"), "target", F.lit("sequence").alias("kind"), F.lit("next").alias("label"), F.lit(True).alias("is_fallthrough"))


def reliable_returns(stmts: DataFrame) -> DataFrame:
    """Labels that surely return: a return on their own level, or all branches of an if with else, in any of its blocks
    (``assemble.build`` looks at the label's own statements only)."""
    top = stmts.where("kind = 'return' and coalesce(block_kind, 'label') = 'label'").select("project_id", F.col("label_id").alias("id"))
    d = decisions(stmts).withColumnRenamed("id", "decision").select(*FILE, "decision", "parent_label_id", "branch_kind", "line_no")
    r = stmts.where("kind = 'return'").select(*FILE, F.col("block_line").alias("line_no")).distinct().withColumn("__r", F.lit(1))
    whole = d.join(r, [*FILE, "line_no"], "left").groupBy(*FILE, "decision", "parent_label_id").agg(F.min(F.coalesce("__r", F.lit(0))).alias("all"), F.max((F.col("branch_kind") == "else").cast("int")).alias("has_else")).where("all = 1 and has_else = 1")
    return top.unionByName(whole.select("project_id", F.col("parent_label_id").alias("id"))).distinct()


#: Blocks whose code runs before the story starts, if no label holds them.
BEFORE = ("init", "python")


def _assigned(stmts: DataFrame) -> DataFrame:
    """Statements that assign, with name, operator and value as a, b, c: those after ``$``, lines of Python blocks, and one row for each of several targets."""
    put = lambda rows, values: rows.select(*[values.get(c, F.col(c)).alias(c) for c in stmts.columns])
    one = r"^([A-Za-z_][\w.]*)\s*(?::\s*\w[^=]*?)?\s*(=|\+=|-=|\*\*=|\*=|//=|/=|%=)\s*(?!=)(.+)$"
    inside = stmts.where((F.col("kind") == "other") & F.col("block_kind").isin(*BEFORE) & F.col("t").rlike(one))
    inside = put(inside, {k: F.regexp_extract("t", one, i) for i, k in enumerate("abc", 1)})
    pattern = r"^(?:\$\s*)?([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)+)\s*=\s*(?!=)([^()\[\]{}\x22\x27]+)$"  # several targets, plain values
    targets, values = (F.split(F.regexp_extract("t", pattern, i), r"\s*,\s*") for i in (1, 2))
    several = stmts.where(((F.col("kind") == "python_line") | ((F.col("kind") == "other") & F.col("block_kind").isin(*BEFORE))) & F.col("t").rlike(pattern)).where(F.size(targets) == F.size(values))
    several = put(several.select(*stmts.columns, F.explode(F.arrays_zip(targets.alias("x"), values.alias("y"))).alias("z")), {"a": F.col("z.x"), "b": F.lit("="), "c": F.col("z.y")})
    return stmts.where("kind = 'mutation'").unionByName(inside).unionByName(several)


def mutations(stmts: DataFrame) -> DataFrame:
    """Assignments of the story, also in Python blocks of labels: name, op (``x = not x`` is toggle), value, value_type, is_persistent; one row for
    each of several targets. Those of blocks that run before the story are ``init_vars``."""
    toggle = F.trim("c") == F.concat(F.lit("not "), "a")
    kind = F.when(F.col("c").rlike(r"^(True|False)$"), "bool").when(F.col("c").rlike(r"^-?\d+(\.\d+)?$"), "num").when(F.col("c").rlike(rf"^(?:{STRING})$"), "str").when(F.col("c") == "None", "null").otherwise("expression")
    told = _assigned(stmts).where(~F.coalesce("top_kind", F.lit("")).isin(*BEFORE))
    return told.select(*FILE, "label_id", F.col("a").alias("name"), F.when((F.col("b") == "=") & toggle, "toggle").otherwise(F.col("b")).alias("op"), F.when(kind == "str", unquote(F.col("c"))).otherwise(F.col("c")).alias("value"), kind.alias("value_type"), F.col("a").startswith("persistent.").alias("is_persistent"), "line_no")


def literal_json(value: Column, kind: Column) -> Column:
    """The value of a mutation as JSON; null for an expression."""
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")
    return F.when(kind == "bool", F.lower(value)).when(kind == "num", value).when(kind == "null", "null").when(kind == "str", quoted)


def init_vars(stmts: DataFrame) -> DataFrame:
    """define, default, and what ``init`` and top-level Python blocks assign directly: name, raw_expression, kind, priority, is_persistent.

    A block's priority is that of its ``init``, -50000 for ``python early``, else 0. Assignments inside of functions, loops and conditions aren't declarations.
    """
    persistent = F.col("a").startswith("persistent.")
    columns = lambda kind, raw, priority: [*FILE, F.col("a").alias("name"), raw.alias("raw_expression"), F.when(persistent, "persistent").otherwise(kind).alias("kind"), priority.cast("int").alias("priority"), F.col("line_no").alias("line_index"), persistent.alias("is_persistent")]
    own = F.coalesce(F.nullif(F.regexp_extract("t", r"^(?:define|default)\s+(-?\d+)\s", 1), F.lit("")).cast("int"), F.lit(0))
    block = F.when(F.col("top_text") == "early", -50000).otherwise(F.coalesce(F.col("top_text").try_cast("int"), F.lit(0)))
    said = stmts.where("kind in ('define', 'default')").select(*columns(F.col("kind"), F.col("b"), own))
    first = _assigned(stmts).where(F.col("top_kind").isin(*BEFORE) & F.col("block_kind").isin(*BEFORE) & (F.col("b") == "="))
    return said.unionByName(first.select(*columns(F.lit("python"), F.col("c"), block)))


def cues(stmts: DataFrame) -> DataFrame:
    """scene, show, hide, play, queue, stop, voice: type, channel, asset without modifiers and quotes."""
    audio = F.col("a").isin("play", "queue", "stop")
    rest = F.coalesce("b", F.lit(""))
    channel = F.when(audio, F.nullif(F.regexp_extract(rest, r"^(\w+)", 1), F.lit("")))
    body = F.when(audio, F.regexp_replace(rest, r"^\w+\s*", "")).otherwise(rest)
    cut_ = F.regexp_replace(body, r"\s+(with|at|behind|zorder|as|onlayer|fadein|fadeout|volume|loop|noloop)\b.*$", "")
    asset = F.trim(F.regexp_replace(F.trim(cut_), r'^["\x27]|["\x27]$', ""))
    return stmts.where("kind = 'cue'").select(*FILE, "label_id", F.col("a").alias("type"), channel.alias("channel"), asset.alias("asset"), F.col("t").alias("raw"), F.col("line_no").alias("line_num")).where("asset <> '' or (type = 'stop' and channel is not null)")


def timed_choices(stmts: DataFrame) -> DataFrame:
    """Timed jumps: seconds, target and label of ``timedchoice`` in keyword or positional form."""
    s = F.coalesce(F.nullif(F.regexp_extract("a", r"(?:time|timeout|seconds)\s*=\s*([0-9.]+)", 1), F.lit("")), F.nullif(F.regexp_extract("a", r"^\s*([0-9.]+)", 1), F.lit(""))).cast("double")
    target = F.coalesce(F.nullif(F.regexp_extract("a", r"(?:target|label|jump)\s*=\s*[\"\x27]?(\w+)", 1), F.lit("")), F.nullif(F.regexp_extract("a", r"^\s*[0-9.]+\s*,?\s*(?:jump\s+)?[\"\x27]?(\w+)", 1), F.lit("")))
    label = F.nullif(F.regexp_extract("a", r"(?:text|caption)\s*=\s*[\"\x27]([^\"\x27]*)", 1), F.lit(""))
    default = F.concat(F.lit("Timeout ("), F.regexp_replace(s.cast("string"), r"\.0$", ""), F.lit("s)"))
    return stmts.where("kind = 'timed'").select(*FILE, F.col("label_id").alias("source"), target.alias("target"), F.lit("jump").alias("kind"), F.coalesce(label, default).alias("label"), F.struct(F.lit(True).alias("is_timeout"), s.alias("duration_seconds")).alias("timeout"), "line_no").where("target is not null")


def screen_actions(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Actions of screens under rules (action_name, action_kind; few): kind, or unmapped_screen_action."""
    r = rules.select(F.lower("action_name").alias("__k"), "action_kind")
    j = actions.join(F.broadcast(r), F.lower("action") == F.col("__k"), "left")
    return j.drop("__k").withColumn("category", F.when(F.col("action_kind").isNull(), "unmapped_screen_action").when(F.col("action_kind").isin("jump", "call") & F.col("target").isNull(), "dynamic_target"))


def merge_action_rules(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Rules by variant and lower-cased name; custom ones win, the last counts; unknown kinds drop out."""
    both = defaults.withColumn("__layer", F.lit(0)).unionByName(custom.withColumn("__layer", F.lit(1)))
    ok = both.where(F.col("action_kind").isin("jump", "call", "set_variable", "toggle_variable", "ignored"))
    w = Window.partitionBy("variant", F.lower("action_name")).orderBy(F.desc("__layer"), F.desc("ord"))
    return ok.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").select("variant", F.lower("action_name").alias("action_name"), "action_kind")


def python_transfers(stmts: DataFrame) -> DataFrame:
    """Literal ``renpy.jump("x")`` and ``renpy.call("x")`` in Python lines."""
    code = F.col("t")
    found = F.explode(F.arrays_zip(F.regexp_extract_all(code, F.lit(r"(?<![\w.])renpy\.(jump|call)\(\s*[\"\x27](\w+)[\"\x27]"), F.lit(1)).alias("kind"), F.regexp_extract_all(code, F.lit(r"(?<![\w.])renpy\.(jump|call)\(\s*[\"\x27](\w+)[\"\x27]"), F.lit(2)).alias("target")))
    rows = stmts.where("kind in ('python_line', 'other', 'mutation')").select(*FILE, F.col("label_id").alias("source"), "line_no", found.alias("x"))
    return rows.select(*FILE, F.concat(F.when(F.col("x.kind") == "jump", "pjump_").otherwise("pcall_"), "source", F.lit("__"), "x.target", F.lit("_L"), F.col("line_no").cast("string")).alias("id"), "source", "x.target", "x.kind", "line_no")


def custom_statements(stmts: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines no pattern takes, under custom rules (pattern, rule_kind, ord; few): the first that matches."""
    rest = stmts.where("kind in ('other', 'python_line')").select(*FILE, "label_id", "line_no", "t")
    m = rest.join(F.broadcast(rules.select("pattern", "rule_kind", "ord")), F.expr("t rlike pattern"))
    w = Window.partitionBy(*FILE, "line_no").orderBy("ord")
    return m.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def segments(stmts: DataFrame) -> DataFrame:
    """Statements with the continuation they belong to: after the k-th menu of a label on its own
    level, ``<label>__cont_L<line>`` from the first line behind it."""
    w = Window.partitionBy(*FILE, "label_id").orderBy("line_no")
    inner = F.col("block_kind").isin("menu", "item")
    starts = F.when(~inner & F.lag("block_kind").over(w).isin("menu", "item") & (F.coalesce("block_kind", F.lit("label")) == "label"), F.col("line_no"))
    line = F.last(F.when(~inner, starts), True).over(w)
    return stmts.withColumn("segment_id", F.when(line.isNull(), F.col("label_id")).otherwise(F.concat("label_id", F.lit("__cont_L"), line.cast("string"))))


def screen_calls(stmts: DataFrame) -> DataFrame:
    """``screen_call_<label>_<screen>_L<line>`` nodes."""
    ids = F.concat(F.lit("screen_call_"), "label_id", F.lit("_"), "a", F.lit("_L"), F.col("line_no").cast("string"))
    return stmts.where("kind = 'call_screen'").select(*FILE, ids.alias("id"), F.col("label_id").alias("source"), F.col("a").alias("screen"), "line_no")


def detect_variant(files: DataFrame, rules: DataFrame, fallback: str = "standard") -> DataFrame:
    """The dialect of each project by scored signatures (variant, pattern, is_path; few): 8 for a path,
    else 8 or 3 by the pattern's length, times up to 5 matches a file; with a confidence."""
    m = files.join(F.broadcast(rules), F.when(F.col("is_path"), F.expr("path rlike pattern")).otherwise(F.expr("content rlike pattern")))
    hits = F.when(F.col("is_path"), 1).otherwise(F.least(F.lit(5), F.regexp_count("content", F.col("pattern"))))
    points = F.when(F.col("is_path") | (F.length("pattern") > 25), 8).otherwise(3) * hits
    s = m.groupBy("project_id", "variant").agg(F.sum(points).alias("score"))
    w = Window.partitionBy("project_id").orderBy(F.desc("score"), "variant")
    top = s.withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("nth = 1")
    share = F.floor(60 + 39 * (F.col("score") - F.col("next")) / (F.col("score") + F.col("next") + 2) + 0.5)
    sure = F.when(F.col("next").isNull(), F.when(F.col("score") >= 15, 98).when(F.col("score") >= 6, 92).otherwise(80)).otherwise(F.greatest(F.lit(50), F.least(F.lit(99), share)))
    known = top.select("project_id", "variant", "score", sure.cast("int").alias("confidence"))
    return files.select("project_id").distinct().join(known, "project_id", "left").select("project_id", F.coalesce("variant", F.lit(fallback)).alias("variant"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("confidence", F.lit(0)).alias("confidence"))


def scripts_of(dialogue: DataFrame) -> DataFrame:
    """Scripts written from dialogue lines, one file per node: its label, lines, a flag, a cue, a
    count, a decision, and a jump or (for an even number of lines) a menu of two jumps."""
    k = F.col("node_ord")
    text = F.replace(F.replace(F.regexp_replace("text", r"\n", " "), F.lit('"'), F.lit("")), F.lit("\\"), F.lit(""))
    line = F.concat(F.lit("    "), "speaker", F.lit(' "'), text, F.lit('"'))
    by = dialogue.groupBy("project_id", "node_ord", "node_id").agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"), F.count("*").alias("n"))
    s = lambda x: x.cast("string")
    head = F.concat(F.lit("default fl_"), s(k % 5), F.lit(" = False\nlabel "), "node_id", F.lit(":\n    scene bg"), s(k % 7), F.lit(" with fade\n    $ score += "), s(F.col("n")), F.lit("\n"))
    tail = F.concat(F.lit("\n    if flag_"), s(k % 5), F.lit(":\n        $ renpy.pause(1)\n"))
    jump = F.concat(F.lit("    jump conv_"), s(k + 1))
    menu = F.concat(F.lit('    menu:\n        "Next":\n            jump conv_'), s(k + 1), F.lit('\n        "Skip" if score > 3:\n            jump conv_'), s(k + 2))
    content = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), tail, F.when(F.col("n") % 2 == 0, menu).otherwise(jump))
    return by.select("project_id", F.concat(F.lit("conv_"), s(k), F.lit(".rpy")).alias("path"), F.col("node_ord").alias("file_ord"), content.alias("content"))
