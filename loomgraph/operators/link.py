"""Linking a project's graph: unresolved ends, returns, roles, entries and lints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import base_label
from loomgraph.plans.frontier import live, reachable
from loomgraph.plans.lineage import cut, cut_counted

#: Labels that a story starts from.
ENTRIES = ("start", "splashscreen", "main_menu", "after_load")


def attach_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with type, role, chapter and label of both ends; those without a node drop out."""
    def end(side: str) -> DataFrame:
        return nodes.select("project_id", F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("type", "role", "chapter", "label")])

    return edges.join(end("source"), ["project_id", "source"]).join(end("target"), ["project_id", "target"])


def unresolved_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Jumps and calls whose target is no node."""
    return edges.where("kind in ('jump', 'call')").join(nodes.select("project_id", F.col("id").alias("target")), ["project_id", "target"], "left_anti").select("project_id", F.col("id").alias("edge_id"), "source", "target", F.lit("unresolved_target").alias("category"))


def call_returns(edges: DataFrame, nodes: DataFrame, returning: DataFrame) -> DataFrame:
    """``ret_<context>`` edges from each called label that surely returns to the call's return
    target, and ``ret_<context>__<menu>`` from every menu of that label.

    ``edges``: call edges with context and return_target; ``returning``: project_id, id.
    """
    ids = nodes.select("project_id", "id")
    calls = edges.where("kind = 'call' and context is not null").join(returning.select("project_id", F.col("id").alias("target")), ["project_id", "target"], "left_semi")
    calls = calls.join(ids.withColumnRenamed("id", "return_target"), ["project_id", "return_target"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["project_id", "target"], "left_semi")
    common = ["project_id", F.col("return_target").alias("target"), F.lit("call_return").alias("kind"), F.lit("return").alias("label"), "context"]
    direct = calls.select(F.concat(F.lit("ret_"), "context").alias("id"), F.col("target").alias("source"), *common)
    menus = nodes.where("type = 'MENU'").select("project_id", F.col("parent_label_id").alias("target"), F.col("id").alias("menu"))
    nested = calls.join(menus, ["project_id", "target"]).select(F.concat(F.lit("ret_"), "context", F.lit("__"), "menu").alias("id"), F.col("menu").alias("source"), *common)
    return direct.unionByName(nested)


def dangling_calls(edges: DataFrame, returning: DataFrame) -> DataFrame:
    """Calls of labels that don't surely return."""
    return edges.where("kind = 'call'").join(returning.select("project_id", F.col("id").alias("target")), ["project_id", "target"], "left_anti").select("project_id", F.col("id").alias("edge_id"), "source", "target", F.lit("dangling_call").alias("category"))


def shadowed_targets(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Jumps and calls of a label that is defined more than once."""
    twice = definitions.where("type = 'LABEL'").groupBy("project_id", F.col("id").alias("target")).count().where("count > 1")
    return edges.where("kind in ('jump', 'call')").join(twice, ["project_id", "target"], "left_semi").select("project_id", F.col("id").alias("edge_id"), "source", "target", F.lit("shadowed_target").alias("category"))


def cross_file_fallthrough(labels: DataFrame, exits: DataFrame) -> DataFrame:
    """The last label of a file without an exit there falls through to the first label of the next
    file, if that is another chapter.

    ``labels``: project_id, file_ord, line_no, id, chapter; ``exits``: project_id, file_ord, source.
    """
    files = labels.groupBy("project_id", "file_ord").agg(F.min_by("id", "line_no").alias("first"), F.max_by("id", "line_no").alias("last"), F.first("chapter").alias("chapter"))
    w = Window.partitionBy("project_id").orderBy("file_ord")
    pairs = files.withColumn("target", F.lead("first").over(w)).withColumn("next_chapter", F.lead("chapter").over(w)).where("target is not null and chapter <> next_chapter")
    open_ = pairs.join(exits.select("project_id", "file_ord", F.col("source").alias("last")), ["project_id", "file_ord", "last"], "left_anti")
    return open_.select("project_id", F.concat(F.lit("fall_"), "last", F.lit("__"), "target").alias("id"), F.col("last").alias("source"), "target", F.lit("fallthrough").alias("kind"))


def traffic_kinds(edges: DataFrame) -> DataFrame:
    """Sorted kinds of edges into and out of each node."""
    out = edges.groupBy("project_id", F.col("source").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds_out"))
    into = edges.groupBy("project_id", F.col("target").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds_in"))
    none = F.array().cast("array<string>")
    return into.join(out, ["project_id", "id"], "full").select("project_id", "id", F.coalesce("kinds_in", none).alias("kinds_in"), F.coalesce("kinds_out", none).alias("kinds_out"))


def classify_roles(nodes: DataFrame, edges: DataFrame, returning: DataFrame, utility_pattern: str | None = None) -> DataFrame:
    """Roles of labels by rule: utility by name; state_toggle (returns, no story traffic, not
    called); detour (called from a menu, returns); utility (called, returns, no story traffic);
    else story. A story label is terminal if it isn't called and returns or leads nowhere.

    Story traffic is a sequence, jump or fallthrough edge to or from another label.
    """
    names = nodes.select("project_id", "id", base_label(F.col("id"), F.col("parent_label_id")).alias("base"), F.col("type").alias("t"))
    e = edges.join(names.select("project_id", F.col("id").alias("source"), F.col("base").alias("sb"), F.col("t").alias("st")), ["project_id", "source"], "left")
    e = e.join(names.select("project_id", F.col("id").alias("target"), F.col("base").alias("tb")), ["project_id", "target"], "left").where("sb is null or tb is null or sb <> tb")
    story = F.col("kind").isin("sequence", "jump", "fallthrough")
    flags = lambda key: e.where(f"{key} is not null").groupBy("project_id", F.col(key).alias("base"))
    into = flags("tb").agg(F.max((F.col("kind") == "call").cast("int")).alias("called"), F.max(((F.col("kind") == "call") & (F.col("st") == "MENU")).cast("int")).alias("menu_called"), F.max(story.cast("int")).alias("story_in"))
    out = flags("sb").agg(F.max(story.cast("int")).alias("story_out"), F.count("*").alias("n_out"))
    labels = nodes.where("type = 'LABEL'").withColumn("base", base_label(F.col("id"), F.col("parent_label_id")))
    back = returning.select("project_id", F.col("id").alias("base"), F.lit(1).alias("returns"))
    j = labels.join(into, ["project_id", "base"], "left").join(out, ["project_id", "base"], "left").join(back, ["project_id", "base"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    traffic = yes("story_in") | yes("story_out")
    named = F.col("id").rlike(utility_pattern) if utility_pattern else F.lit(False)
    role = (
        F.when(named, "utility").when(yes("returns") & ~traffic & ~yes("called"), "state_toggle")
        .when(yes("menu_called") & yes("returns"), "detour").when(yes("called") & yes("returns") & ~traffic, "utility").otherwise("story")
    )
    terminal = (role == "story") & ~yes("called") & (yes("returns") | (F.coalesce("n_out", F.lit(0)) == 0))
    return j.select("project_id", "id", role.alias("role"), terminal.alias("is_terminal_outcome"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees over live edges; roots have no edge in."""
    e = live(edges)
    out = e.groupBy("project_id", F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    into = e.groupBy("project_id", F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    j = nodes.select("project_id", "id").join(into, ["project_id", "id"], "left").join(out, ["project_id", "id"], "left")
    return j.select("project_id", "id", F.coalesce("n_in", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("n_out", F.lit(0)).cast("long").alias("out_degree"), F.col("n_in").isNull().alias("is_root"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where a project starts: its entry labels; else labels with such a word as a part of their
    id; else nodes without an edge in (project_id, node)."""
    n = nodes.select("project_id", "id", "type")
    part = F.exists(F.split("id", "_"), lambda x: x.isin("start", "splashscreen")) | F.col("id").rlike("(^|_)(main_menu|after_load)(_|$)")
    rank = F.when(F.col("id").isin(*ENTRIES), 0).when((F.col("type") == "LABEL") & part & ~F.col("id").contains("__cont_"), 1)
    into = edges.select("project_id", F.col("target").alias("id")).distinct().withColumn("__in", F.lit(1))
    ranked = n.join(into, ["project_id", "id"], "left").withColumn("rank", F.coalesce(rank, F.when(F.col("__in").isNull(), 2))).where("rank is not null")
    best = ranked.groupBy("project_id").agg(F.min("rank").alias("best"))
    return ranked.join(best, "project_id").where("rank = best").select("project_id", F.col("id").alias("node"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``is_orphan``: not reached from the entry points over any edge, also those
    whose condition is statically false."""
    met = reachable(edges, entry_points(nodes, edges)).select("project_id", F.col("node").alias("id")).distinct().withColumn("__met", F.lit(True))
    rest = [c for c in nodes.columns if c != "is_orphan"]
    return nodes.join(met, ["project_id", "id"], "left").select(*[nodes[c] if c not in ("project_id", "id") else F.col(c) for c in rest], F.col("__met").isNull().alias("is_orphan"))


def call_starts(nodes: DataFrame) -> DataFrame:
    """Where calls may start from: the node ``start`` and all story nodes (project_id, node)."""
    return nodes.where((F.col("id") == "start") | (F.col("role") == "story")).select("project_id", F.col("id").alias("node"))


def call_depth(edges: DataFrame, starts: DataFrame, most: int = 10, chains: bool = True) -> tuple[DataFrame, DataFrame]:
    """How deep calls nest, over all edges: a call goes one deeper (not beyond ``most``), a
    call_return one back, others keep the depth.

    Returns the greatest depth at each node (project_id, node, depth), and the calls that would
    exceed ``most`` (project_id, edge_id, source, target, frames, chain: the calls that lead there; without ``chains`` null, and no lists are carried along).
    A node is looked at again only where it was reached deeper than before, so at most ``most`` times.
    """
    step = cut(edges.where("source is not null and target is not null").groupBy("project_id", F.col("source").alias("node"), F.col("target").alias("next"), F.when(F.col("kind").isin("call", "call_return"), F.col("kind")).alias("way")).agg(F.min("id").alias("id")))
    none = F.array() if chains else F.lit(None)
    known, n_level = cut_counted(starts.select("project_id", "node").distinct().select("project_id", "node", F.lit(0).alias("depth"), none.cast("array<string>").alias("chain")))
    level = known
    n = F.size("chain")
    chain = F.when(F.col("way") == "call", F.array_append("chain", F.col("next"))).when(F.col("way") == "call_return", F.slice("chain", 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.col("chain"))
    deeper = F.when(F.col("way") == "call", F.col("depth") + 1).when(F.col("way") == "call_return", F.greatest(F.col("depth") - 1, F.lit(0))).otherwise(F.col("depth"))
    while n_level:
        if not chains:
            reached = level.join(step, ["project_id", "node"]).select("project_id", F.col("next").alias("node"), deeper.alias("depth")).where(F.col("depth") <= most)
            best = reached.groupBy("project_id", "node").agg(F.max("depth").alias("depth")).withColumn("chain", F.lit(None).cast("array<string>"))
        else:
            best = _deepest(level, step, chain, most)
        before = known.select("project_id", "node", F.col("depth").alias("was"))
        level, n_level = cut_counted(best.join(before, ["project_id", "node"], "left").where("was is null or depth > was").drop("was"))
        known = cut(known.join(level.select("project_id", "node"), ["project_id", "node"], "left_anti").unionByName(level))
    over = known.where(F.col("depth") == most).join(step.where("way = 'call'"), ["project_id", "node"])
    calls = over.select("project_id", F.col("id").alias("edge_id"), F.col("node").alias("source"), F.col("next").alias("target"), F.lit(most + 1).alias("frames"), F.array_append("chain", F.col("next")).alias("chain"))
    return known.select("project_id", "node", "depth"), calls


def _deepest(level: DataFrame, step: DataFrame, chain: Column, most: int) -> DataFrame:
    """What the steps of a level lead to, with the longest chain of calls, the first of equal ones."""
    reached = level.join(step, ["project_id", "node"]).select("project_id", F.col("next").alias("node"), chain.alias("chain")).where(F.size("chain") <= most)
    return reached.groupBy("project_id", "node").agg(F.min(F.struct((-F.size("chain")).alias("d"), "chain")).alias("b")).select("project_id", "node", F.size("b.chain").alias("depth"), "b.chain")


def call_origins(edges: DataFrame) -> DataFrame:
    """Calls into each node with their context (else the edge's id)."""
    context = F.col("context") if "context" in edges.columns else F.lit(None).cast("string")
    return edges.where("kind = 'call'").select("project_id", F.col("target").alias("node"), F.col("source").alias("caller"), F.coalesce(context, "id").alias("context"))


def induced_subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among ``chosen`` (project_id, id)."""
    pick = chosen.select("project_id", "id").distinct()
    return edges.join(pick.withColumnRenamed("id", "source"), ["project_id", "source"], "left_semi").join(pick.withColumnRenamed("id", "target"), ["project_id", "target"], "left_semi")


def node_details(details: DataFrame, chosen: DataFrame) -> DataFrame:
    """Detail rows (lines, cues) of the chosen ids only."""
    return details.join(chosen.select("project_id", "id").distinct(), ["project_id", "id"], "left_semi")


def resolve_dynamic(jumps: DataFrame, labels: DataFrame, rules: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """Targets of jumps to expressions: project_id, source, line_no, expression, target, how (and path, if the jumps have it).

    First custom rules (pattern, target; few), then, with ``outcomes`` (see ``values.outcomes``), the strings that the expression is worth, whether
    labels or not, if it is known in every case, and those it may be that are labels; then literals and the strings of a ternary that are
    labels, then labels by their fixed beginning and end: of an f-string, or of strings added to
    something. Beginnings are joined by their text, with the labels' beginnings of the same
    lengths (ends likewise, without a beginning), so that no jump meets every label.
    """
    from loomgraph.functions.text import extract_literal

    keys = [c for c in ("project_id", "path", "source", "line_no", "expression") if c in jumps.columns]
    found = []
    if rules is not None:
        found.append(jumps.join(F.broadcast(rules.select("pattern", "target")), F.expr("expression rlike pattern")).select(*keys, "target", F.lit("rule").alias("how")))
    ids = labels.select("project_id", F.col("id").alias("target")).distinct()
    if outcomes is not None:
        string = F.get_json_object(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "$.v")
        worth = outcomes.groupBy(*keys).agg(F.min(F.col("ok") & F.col("value_json").startswith('"')).alias("ok"), F.collect_set(string).alias("worth"), F.array_distinct(F.flatten(F.collect_list("candidates"))).alias("maybe"))
        found.append(worth.where("ok").select(*keys, F.explode("worth").alias("target"), F.lit("value").alias("how")))
        found.append(worth.where("not ok").select(*keys, F.explode("maybe").alias("target")).join(ids, ["project_id", "target"], "left_semi").select(*keys, "target", F.lit("value").alias("how")))
    text = r'"([^"\\]*)"|\x27([^\x27\\]*)\x27'
    e = F.trim(F.regexp_replace("expression", r"^\s*\(\s*|\s*\)\s*$", ""))
    outside = F.regexp_replace("expression", text, "")
    is_f = e.rlike(r"^[fF][\"\x27].*\{.*\}.*[\"\x27]$")
    plain = jumps.where(~e.rlike(r"^[fF][\"\x27]") & ~outside.contains("+"))
    strings = F.array_union(F.array(extract_literal(F.col("expression"))), F.array_union(F.regexp_extract_all("expression", F.lit(text), F.lit(1)), F.regexp_extract_all("expression", F.lit(text), F.lit(2))))
    literal = plain.select(*keys, F.explode(strings).alias("target")).where("target <> ''").distinct().join(ids, ["project_id", "target"], "left_semi")
    found.append(literal.select(*keys, "target", F.lit("literal").alias("how")))

    inner = lambda s: F.regexp_extract(s, r"^[A-Za-z]{0,2}[\"\x27](.*)[\"\x27]$", 1)
    quoted = r'[A-Za-z]{0,2}("[^"\\]*"|\x27[^\x27\\]*\x27)'
    every = F.regexp_extract_all("expression", F.lit(quoted), F.lit(1))
    first, last = inner(F.regexp_extract(e, "^" + quoted, 0)), inner(F.regexp_extract(e, quoted + "$", 0))
    one = F.when(first == "", inner(F.element_at(every, 1))).otherwise(F.lit(""))
    body = inner(e)
    pre = F.when(is_f, F.substring_index(body, "{", 1)).otherwise(first)
    post = F.when(is_f, F.substring_index(body, "}", -1)).when(F.size(every) == 1, one).otherwise(last)
    f = jumps.where(is_f | (outside.contains("+") & (F.size(every) > 0))).select(*keys, pre.alias("pre"), post.alias("post"))
    f = f.select("*", F.when(F.length("pre") > 0, "<").when(F.length("post") > 0, ">").alias("side")).select("*", F.when(F.col("side") == "<", F.col("pre")).otherwise(F.col("post")).alias("block")).where("side is not null")
    lengths = f.select("project_id", "side", F.length("block").alias("n")).distinct()
    part = F.when(F.col("side") == "<", F.expr("left(target, n)")).otherwise(F.expr("right(target, n)"))
    blocks = ids.join(lengths, "project_id").where(F.length("target") >= F.col("n")).select("project_id", "side", "target", part.alias("block"))
    near = f.join(blocks, ["project_id", "side", "block"]).where(F.col("target").startswith(F.col("pre")) & F.col("target").endswith(F.col("post")) & (F.length("target") >= F.length("pre") + F.length("post")))
    found.append(near.select(*keys, "target", F.lit("pattern").alias("how")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    order = F.when(F.col("how") == "rule", 0).when(F.col("how") == "value", 1).when(F.col("how") == "literal", 2).otherwise(3)
    # a jump may have a great part of all labels for targets: the first way is told by an aggregate, and no jump's targets are put together
    found = out.withColumn("__o", order).distinct()
    first = found.groupBy(*keys).agg(F.min("__o").alias("__b")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return found.join(first.hint("merge"), same & (F.col("__o") == F.col("__b"))).select(*out.columns)
