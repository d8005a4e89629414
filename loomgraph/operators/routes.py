"""Routes through a story: all ways from the start to endings, and the best way to a target.

Paths are rows with arrays; each level joins the frontier with the edges. Calls push their
context, returns must match it. Routes are listed; where a cap cuts the list or the search, the rows kept are those of
least path, level by level, and ``truncated`` says so; without a cap the set of routes is complete. The best route to a target needs
no list: of all ways into a node with the same calls open, the best one alone goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import NAME, condition_refs
from loomgraph.plans.frontier import Seen, live, present, reachable
from loomgraph.plans.lineage import cut, cut_counted, numbered

ROUTES, DEPTH, STATES = 500, 200, 50_000
#: Calls that are open at once, at most, on the way to a target.
MOST_CALLS = 30


def _steps(edges: DataFrame, nodes: DataFrame, strict: bool) -> DataFrame:
    """Live edges with the figures of their target and what they do to the call stack."""
    col = lambda c: F.col(c) if c in edges.columns else F.lit(None).cast("string")
    e = live(edges).select(
        "project_id", "edge_ord", F.col("source").alias("at"), F.col("target").alias("to"), F.coalesce("kind", F.lit("sequence")).alias("kind"),
        "label", col("expression").alias("expression"), F.coalesce(col("context"), F.when(F.col("kind") == "call", F.col("id")) if strict else F.lit(None).cast("string")).alias("context"),
        F.coalesce(col("return_target"), F.lit("")).alias("back"),
    )
    chapter = F.col("chapter") if "chapter" in nodes.columns else F.lit(None).cast("string")
    n = nodes.select("project_id", F.col("id").alias("to"), F.coalesce("word_count", F.lit(0)).alias("w"), F.coalesce("pause_duration", F.lit(0.0)).alias("p"), F.col("type").alias("t"), chapter.alias("to_chapter"))
    return cut(e.join(n, ["project_id", "to"]))


def _advance(level: DataFrame, steps: DataFrame, most_visits: int | None, depth: int, strict: bool, chosen: bool = False) -> DataFrame:
    """``chosen``: ``steps`` are those of ``_best_ahead``."""
    top = F.try_element_at("stack", F.size("stack"))
    matched = (F.col("context") == top["context"]) if strict else (F.col("context").isNull() | (F.col("context") == top["context"]) | (F.col("to") == top["back"]))
    ok = F.when(F.col("kind") == "call_return", (F.size("stack") > 0) & F.coalesce(matched, F.lit(False))).otherwise(True)
    visits = F.size(F.filter("path", lambda x: x == F.col("to")))
    if chosen:
        came = steps.withColumns({"at": F.col("came")["at"], "stack": F.col("came")["stack"]}).drop("came")
        moved = level.join(came, ["project_id", "at", "stack"]).withColumn("stack", F.col("new"))
    else:
        moved = level.join(steps, ["project_id", "at"]).where(ok & (F.size("path") < depth))
    if most_visits is not None:
        moved = moved.where(visits < most_visits)
    frame = F.struct(F.col("context").alias("context"), F.col("back").alias("back"))
    stack = F.when(F.col("kind") == "call_return", F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0)))).when(F.col("kind") == "call", F.array_append("stack", frame)).otherwise(F.col("stack"))
    stack = F.col("stack") if chosen else stack
    choice = F.struct(F.col("at").alias("menu"), F.col("label").alias("text"))
    is_choice = (F.col("at_type") == "MENU") | present(F.col("label"))
    step = F.when(is_choice, "choice").when(F.col("expression").isNotNull(), "decision_branch").when(F.col("kind").isin("call", "call_return"), F.col("kind")).otherwise("label")
    taken = F.struct(step.alias("type"), F.col("label").alias("text"), F.when(F.col("at_type") == "MENU", F.col("at")).alias("menu"), F.col("expression").alias("expression"), F.col("to_chapter").alias("chapter"))
    more = [F.array_append("taken", taken).alias("taken")] if strict else []
    return moved.select(
        "project_id", F.col("to").alias("at"), F.col("t").alias("at_type"), F.array_append("path", F.col("to")).alias("path"),
        F.when(is_choice, F.array_append("choices", choice)).otherwise(F.col("choices")).alias("choices"),
        F.when(F.col("expression").isNotNull(), F.array_append("conditions", F.col("expression"))).otherwise(F.col("conditions")).alias("conditions"),
        (F.col("words") + F.col("w")).alias("words"), (F.col("pause") + F.col("p")).alias("pause"), stack.alias("stack"), F.array_append("order", F.col("edge_ord")).alias("order"), *more,
    )


def _best_ahead(level: DataFrame, steps: DataFrame, met: DataFrame, heuristic: str) -> DataFrame:
    """The best way from ``level`` into each node and open calls that ``met`` hasn't (or only by more choices), as its last step alone: project_id, at, stack, came (what it comes from, by node and stack), and the step's columns.

    Ways are compared by figures of the rows they come from, whose lists aren't read. All of a level have the same length.
    """
    p, state = "project_id", ["project_id", "at", "stack"]
    columns = [c for c in steps.columns if c not in (p, "at", "to")]
    near = level.select(*state, "at_type", F.size("choices").alias("n"), F.col("order").alias("was"))
    frame = F.struct(F.col("context").alias("context"), F.col("back").alias("back"))
    last = F.col("kind") == "call_return"
    ahead = near.join(steps, [p, "at"]).where(~last | (F.size("stack") > 0) & F.coalesce(F.col("context") == F.try_element_at("stack", F.size("stack"))["context"], F.lit(False)))
    stack = F.when(last, F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0)))).when(F.col("kind") == "call", F.array_append("stack", frame)).otherwise(F.col("stack"))
    n = F.col("n") + ((F.col("at_type") == "MENU") | present(F.col("label"))).cast("int")
    ahead = ahead.select(p, F.col("to").alias("at"), stack.alias("stack"), F.struct("at", "stack").alias("came"), n.alias("n"), "was", *columns)
    if heuristic == "shortest":
        ahead = ahead.join(met.select(*state), state, "left_anti")
    else:
        ahead = ahead.join(met.groupBy(*state).agg(F.min("choices").alias("least")), state, "left").where("least is null or n < least").drop("least")
    best = ahead.groupBy(*state).agg(F.min_by(F.struct("came", *columns), F.struct("n", "was", "edge_ord")).alias("x"))
    return best.select(p, F.col("at").alias("to"), F.col("stack").alias("new"), "x.*")


def _start(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    s = nodes.join(starts.select("project_id", F.col("node").alias("id")).distinct(), ["project_id", "id"], "left_semi")
    return s.select(
        "project_id", F.col("id").alias("at"), F.col("type").alias("at_type"), F.array("id").alias("path"), F.array().cast("array<struct<menu:string,text:string>>").alias("choices"),
        F.array().cast("array<string>").alias("conditions"), F.coalesce("word_count", F.lit(0)).cast("long").alias("words"), F.coalesce("pause_duration", F.lit(0.0)).alias("pause"),
        F.array().cast("array<struct<context:string,back:string>>").alias("stack"), F.array().cast("array<bigint>").alias("order"),
    )


def _capped(level: DataFrame, most: int | None) -> tuple[DataFrame, int, DataFrame | None]:
    """The level, its rows (``most`` a project), and the projects of which rows were cut."""
    if most is None:
        return *cut_counted(level), None
    w = Window.partitionBy("project_id").orderBy("order")
    one_more, n = cut_counted(level.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= most + 1))
    over = one_more.where(F.col("__nth") > most).select("project_id").distinct()
    return one_more.where(F.col("__nth") <= most).drop("__nth"), n, over


def enumerate_routes(nodes: DataFrame, edges: DataFrame, starts: DataFrame, endings: DataFrame, max_routes: int | None = ROUTES, max_depth: int = DEPTH, max_states: int | None = STATES, max_visits: int = 2) -> DataFrame:
    """All routes from the starts to the endings (project_id, node): route_id, route_ord, ending,
    path, choices, words, pause, has_cycle, truncated. An ending that leads on is passed, too.

    ``truncated`` is true for all routes of a project of which routes, states of a level (``max_states``) or longer paths (``max_depth``) were cut.
    """
    steps = _steps(edges, nodes, False)
    ends = endings.select("project_id", F.col("node").alias("at")).distinct()
    level, n, over = _capped(_start(nodes, starts), max_states)
    found, cuts = [level.limit(0)], [over]
    while n:
        found.append(level.join(ends, ["project_id", "at"], "left_semi"))
        if len(found) > max_depth:  # paths of the greatest length that would go on
            cuts.append(_advance(level, steps, max_visits, max_depth + 1, False).select("project_id").distinct())
        level, n, over = _capped(_advance(level, steps, max_visits, max_depth, False), max_states)
        cuts.append(over)
    rows = reduce(DataFrame.unionAll, found)
    cuts = [c for c in cuts if c is not None]
    short = cut(reduce(DataFrame.unionAll, cuts).distinct().withColumn("__short", F.lit(True))) if cuts else None
    rows = numbered(rows.drop("stack"), ["project_id"], [F.size("path"), "order", "path"], "route_ord").withColumn("route_ord", F.col("route_ord").cast("int"))
    kept = rows
    if max_routes is not None:
        total = rows.groupBy("project_id").agg(F.max("route_ord").alias("__total"))
        kept = rows.where(F.col("route_ord") <= max_routes).join(total, "project_id")
    kept = kept.withColumn("__short", F.lit(False)) if short is None else kept.join(short, "project_id", "left")
    many = F.lit(False) if max_routes is None else F.col("__total") > max_routes
    return kept.select(
        "project_id", F.concat(F.lit("route_"), F.col("route_ord").cast("string")).alias("route_id"), "route_ord", F.col("at").alias("ending"), "path", "choices", "words", "pause", "conditions",
        (F.size(F.array_distinct("path")) < F.size("path")).alias("has_cycle"), (many | F.coalesce("__short", F.lit(False))).alias("truncated"),
    )


def count_routes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """How many ways lead from the starts (project_id, node) to each node they reach: project_id, node, routes (decimal(38,0)), without
    listing them. Parallel edges are ways of their own. ``routes`` is null for nodes on a cycle, or behind one: a way there has no end.

    Edges are taken as they are: calls and returns aren't matched. Each node is counted once all ways into it are, so that an
    edge is looked at once; levels are those of the longest way.
    """
    p = ["project_id"]
    number = lambda c: c.cast("decimal(38,0)").alias("routes")
    e = cut(live(edges).select(*p, "source", "target").where("source is not null and target is not null"))
    row = lambda df, c, one, waits: df.select(*p, F.col(c).alias("node"), F.lit(one).cast("decimal(38,0)").alias("routes"), F.lit(waits).cast("long").alias("waits"))
    every = row(starts.select(*p, "node").where("node is not null").distinct(), "node", 1, 0).unionAll(row(e, "target", 0, 1)).unionAll(row(e, "source", 0, 0))
    done, left, e = _counted(every.groupBy(*p, "node").agg(number(F.sum("routes")), F.sum("waits").alias("waits")), e)
    if left is None:
        return done.where("routes > 0")
    # on cycles or behind them: what no start leads to doesn't count there
    met = cut(reachable(e, left.where("routes > 0").select(*p, "node")))
    e = cut(e.join(met.withColumnRenamed("node", "source"), [*p, "source"], "left_semi"))
    into = e.groupBy(*p, F.col("target").alias("node")).agg(F.count("*").alias("waits"))
    behind, cyclic, _ = _counted(left.drop("waits").join(met, [*p, "node"]).join(into, [*p, "node"], "left").select(*p, "node", "routes", F.coalesce("waits", F.lit(0)).cast("long").alias("waits")), e)
    found = done.where("routes > 0").unionByName(behind)
    return found if cyclic is None else found.unionByName(cyclic.select(*p, "node", number(F.lit(None))))


def _counted(state: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The nodes of ``state`` (project_id, node, routes, waits: edges into it that aren't counted) that come to wait for nothing, those left, if any, and the edges out of these.

    Edges whose source is counted leave the table, and so do counted nodes. Both grow with the input, so they are joined by merging.
    """
    p = ["project_id"]
    state, n = cut_counted(state, "waits = 0")
    done = Seen(state.where("waits = 0").drop("waits"))
    while n:
        level = state.where("waits = 0").select(*p, F.col("node").alias("source"), "routes")
        marked = cut(e.join(level.hint("merge"), [*p, "source"], "left"))
        e = marked.where("routes is null").drop("routes")
        came = marked.where("routes is not null").groupBy(*p, F.col("target").alias("node")).agg(F.sum("routes").cast("decimal(38,0)").alias("more"), F.count("*").alias("k"))
        ahead = state.where("waits > 0").join(came.hint("merge"), [*p, "node"], "left")
        state, n = cut_counted(ahead.select(*p, "node", (F.col("routes") + F.coalesce("more", F.lit(0))).cast("decimal(38,0)").alias("routes"), (F.col("waits") - F.coalesce("k", F.lit(0))).alias("waits")), "waits = 0")
        done.add(state.where("waits = 0").drop("waits"))
    return done.all(), None if state.where("waits > 0").isEmpty() else state.where("waits > 0"), e


def solve_routes(nodes: DataFrame, edges: DataFrame, starts: DataFrame, targets: DataFrame, heuristic: str = "shortest", max_depth: int = 250, max_states: int | None = None) -> DataFrame:
    """The best route to each target (project_id, node): target, is_reachable, path, steps (type, node, chapter, text, menu, expression),
    chapters, n_choices, words, pause, conditions, alternatives, truncated.

    Heuristics: shortest (nodes, then choices), least_choices (choices, then nodes), max_dialogue
    (most words, then nodes); then the order of edges. Returns must match their call. A row goes on only if it is the best for its node and open
    calls: the first that comes (shortest), one with fewer choices than all before (least_choices), or the one of most words among
    those of its length (max_dialogue). For the first two that is the optimum on any graph; for max_dialogue on graphs without cycles, while
    on others no node is passed twice and a longer way that the best one bars may be missed.

    ``alternatives`` counts the other rows that came in at the target. ``truncated``: something was left when the search ended, as paths had
    ``max_depth`` nodes or (if given) a level had more than ``max_states`` rows in the project.
    """
    steps = _steps(edges, nodes, True)
    goals = cut(targets.select("project_id", F.col("node").alias("at")).distinct())
    chapter = F.col("chapter") if "chapter" in nodes.columns else F.lit(None).cast("string")
    first = nodes.select("project_id", F.col("id").alias("at"), F.array(F.struct(F.lit("start").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("menu"), F.lit(None).cast("string").alias("expression"), chapter.alias("chapter"))).alias("taken"))
    level, n, over = _capped(_start(nodes, starts).join(first, ["project_id", "at"]), max_states)
    size, choices, state = F.size("path"), F.size("choices"), ["project_id", "at", "stack"]
    cost = {"shortest": [size, choices], "least_choices": [choices, size], "max_dialogue": [-F.col("words"), size]}[heuristic]
    met = Seen(level.select(*state, choices.alias("choices")))
    found, cuts, depth = [level.join(goals, ["project_id", "at"], "left_semi")], [over], 1
    names = [c for c in level.columns if c not in state]
    while n:
        going = level.where(F.size("stack") <= MOST_CALLS)
        if heuristic == "max_dialogue":
            ahead = _advance(going, steps, 1, max_depth + 1, True)
            ahead = ahead.groupBy(*state).agg(F.min_by(F.struct(*names), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cost)], "order")).alias("x")).select(*state, "x.*")
        else:
            ahead = _advance(going, _best_ahead(going, steps, met.all(), heuristic), None, max_depth + 1, True, True)
        level, n, over = _capped(ahead.select(*level.columns), max_states)
        depth += 1
        if n and depth > max_depth:
            cuts.append(level.select("project_id").distinct())
            break
        cuts.append(over)
        met.add(level.select(*state, choices.alias("choices")))
        found.append(level.join(goals, ["project_id", "at"], "left_semi"))
    rows = reduce(DataFrame.unionAll, found)
    w = Window.partitionBy("project_id", "at")
    best = rows.withColumn("alternatives", F.count("*").over(w) - 1).withColumn("__nth", F.row_number().over(w.orderBy(*cost, "order"))).where("__nth = 1")
    cuts = [c for c in cuts if c is not None]
    short = reduce(DataFrame.unionAll, cuts).distinct() if cuts else goals.select("project_id").limit(0)
    j = goals.join(best, ["project_id", "at"], "left").join(short.withColumn("truncated", F.lit(True)), "project_id", "left")
    none = F.array().cast("array<string>")
    last = F.size("path") - 1
    typed = F.zip_with("taken", "path", lambda t, p: F.struct(t["type"].alias("type"), p.alias("node"), t["chapter"].alias("chapter"), t["text"].alias("text"), t["menu"].alias("menu"), t["expression"].alias("expression")))
    typed = F.transform(typed, lambda t, i: t.withField("type", F.when((i == last) & (t["type"] == "label"), "ending").otherwise(t["type"])))
    kinds = "array<struct<type:string,node:string,chapter:string,text:string,menu:string,expression:string>>"
    return j.select(
        "project_id", F.col("at").alias("target"), F.col("path").isNotNull().alias("is_reachable"), F.coalesce("path", none).alias("path"), F.coalesce(typed.cast(kinds), F.array().cast(kinds)).alias("steps"),
        F.coalesce(F.array_distinct(F.filter(F.transform("taken", lambda t: t["chapter"]), lambda c: c.isNotNull() & (c != ""))), none).alias("chapters"), F.coalesce(choices, F.lit(0)).alias("n_choices"),
        F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("pause", F.lit(0.0)).alias("pause"), F.coalesce("conditions", none).alias("conditions"), F.coalesce("alternatives", F.lit(0)).alias("alternatives"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def flags_needed(solved: DataFrame) -> DataFrame:
    """What a route's conditions ask for: project_id, target, flag, needed. A bare name must be
    true; a name in an expression carries the expression; the first mention counts."""
    each = solved.select("project_id", "target", F.posexplode("conditions").alias("pos", "expression"))
    bare = F.trim("expression").rlike(rf"^{NAME}$")
    refs = each.select("project_id", "target", "pos", F.when(bare, F.lit("true")).otherwise(F.col("expression")).alias("needed"), F.explode(condition_refs(F.col("expression"))).alias("flag"))
    return refs.groupBy("project_id", "target", "flag").agg(F.min_by("needed", "pos").alias("needed"))


def bfs_first(nodes: DataFrame, edges: DataFrame, start: DataFrame, n: int = 220) -> DataFrame:
    """The first ``n`` nodes by breadth from the start, then from roots, then the rest:
    project_id, id, rank, overflow."""
    from loomgraph.plans.frontier import closure

    into = edges.select("project_id", F.col("target").alias("id")).distinct()
    roots = nodes.select("project_id", "id").join(into, ["project_id", "id"], "left_anti").select("project_id", F.col("id").alias("node"))
    depth = lambda seeds, name: closure(edges, seeds, ["project_id"]).groupBy("project_id", F.col("node").alias("id")).agg(F.min("depth").alias(name))
    j = nodes.join(depth(start, "d1"), ["project_id", "id"], "left").join(depth(roots, "d2"), ["project_id", "id"], "left")
    kind = F.when(F.col("d1").isNotNull(), 0).when(F.col("d2").isNotNull(), 1).otherwise(2)
    rows = j.select("project_id", "id", kind.alias("__kind"), F.coalesce("d1", "d2", F.lit(0)).alias("__depth"), "node_ord")
    ranked = numbered(rows, ["project_id"], ["__kind", "__depth", "node_ord"], "rank")
    return ranked.select("project_id", "id", F.col("rank").cast("int").alias("rank"), (F.col("rank") > n).alias("overflow"))
