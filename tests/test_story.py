"""A small story, its endings and routes, call-aware reachability, chains, folding, scripts."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analytics, chains, collapse, integrity, link, routes
from loomgraph.plans.frontier import chain_heads, closure, reaches
from loomgraph.sources import extract, scripts

NODES = "node_ord long, id string, type string, role string, chapter string, dialogue_count int, word_count int, is_terminal_outcome boolean, is_orphan boolean, label string"
EDGES = "edge_ord long, id string, source string, target string, kind string, label string"


@pytest.fixture(scope="module")
def story(spark):
    rows = [
        (0, "start", "LABEL", "story", "prologue", 15, 120, False, False, "start"), (1, "menu_1", "MENU", None, "chapter1", 0, 0, False, False, "Choice: Help or Flee"),
        (2, "help_branch", "LABEL", "story", "chapter1", 40, 600, False, False, "help_branch"), (3, "flee_branch", "LABEL", "story", "chapter1", 5, 50, False, False, "flee_branch"),
        (4, "good_ending", "LABEL", "story", "ending", 20, 250, True, False, "good_ending"), (5, "bad_ending", "LABEL", "story", "ending", 10, 90, True, False, "bad_ending"),
        (6, "orphan_secret_end", "LABEL", "story", "secret", 10, 100, True, True, "true_secret_ending"),
    ]
    edges = [(1, "e1", "start", "menu_1", "sequence", None), (2, "e2", "menu_1", "help_branch", "jump", "Help Eileen"), (3, "e3", "menu_1", "flee_branch", "jump", "Run Away"), (4, "e4", "help_branch", "good_ending", "sequence", None), (5, "e5", "flee_branch", "bad_ending", "sequence", None)]
    n = spark.createDataFrame(rows, NODES).withColumn("project_id", F.lit("p")).withColumn("pause_duration", F.lit(0.0)).withColumn("is_shadowed", F.lit(False))
    e = spark.createDataFrame(edges, EDGES).withColumn("project_id", F.lit("p")).withColumn("expression", F.lit(None).cast("string")).withColumn("condition_is_statically_false", F.lit(False))
    return n, e


def test_endings_and_points(story):
    n, e = story
    ends = analytics.terminal_endings(n, e)
    assert {r.node_id: (r.ending_type, r.is_orphan) for r in ends.collect()} == {"good_ending": ("good", False), "bad_ending": ("bad", False), "orphan_secret_end": ("true", True)}
    reach = reaches(e, ends.select("project_id", F.col("node_id").alias("node")))
    by = {}
    for r in reach.collect():
        by.setdefault(r.node, set()).add(r.ending)
    assert by["start"] == {"good_ending", "bad_ending"} and by["help_branch"] == {"good_ending"}
    points = {r.edge_id: (r.eliminated, r.is_lock_in) for r in analytics.points_of_no_return(e, n, reach).collect()}
    assert points == {"e2": (["bad_ending"], True), "e3": (["good_ending"], True)}
    tagged = analytics.terminal_endings(n, e, n.where("id = 'good_ending'").select("project_id", "id", F.lit("true").alias("ending_type")))
    assert {r.node_id: r.ending_type for r in tagged.collect()}["good_ending"] == "true"


def test_routes_pacing_summary(story):
    n, e = story
    start = n.where("id = 'start'").select("project_id", F.col("id").alias("node"))
    ends = analytics.terminal_endings(n, e)
    r = routes.enumerate_routes(n, e, start, ends.select("project_id", F.col("node_id").alias("node")))
    got = {x.ending: x for x in r.collect()}
    assert got["good_ending"].path == ["start", "menu_1", "help_branch", "good_ending"] and [c.text for c in got["good_ending"].choices] == ["Help Eileen"] and len(got) == 2 and not got["good_ending"].truncated
    mono = chains.monologue_sections(n, e).where("start = 'help_branch'").first()
    assert (mono.lines, mono.words) == (60, 850)
    pacing = {x.chapter: x for x in analytics.chapter_pacing(n, e).collect()}["chapter1"]
    assert (pacing.menus, pacing.choices, pacing.lines_per_menu) == (1, 2, 45.0)
    reach = reaches(e, ends.select("project_id", F.col("node_id").alias("node")))
    s = analytics.narrative_summary(n, e, ends, r, analytics.points_of_no_return(e, n, reach)).first()
    assert (s.endings, s.routes, s.shortest, s.longest, s.points_of_no_return) == (3, 2, "bad_ending", "good_ending", 2)
    empty = n.limit(0)
    assert analytics.narrative_summary(empty, e.limit(0), ends.limit(0), r.limit(0), analytics.points_of_no_return(e, n, reach).limit(0)).count() == 0


def test_cycles(spark, story):
    n, e = story
    loop = e.unionByName(e.where("id = 'e1'").withColumn("id", F.lit("loop")).withColumn("source", F.lit("start")).withColumn("target", F.lit("start")).withColumn("edge_ord", F.lit(9).cast("long")))
    start = n.where("id = 'start'").select("project_id", F.col("id").alias("node"))
    ends = n.where("id = 'good_ending'").select("project_id", F.col("id").alias("node"))
    got = routes.enumerate_routes(n, loop, start, ends).collect()
    assert sorted(x.has_cycle for x in got) == [False, True]
    ring = spark.createDataFrame([("p", "b", "c"), ("p", "c", "a"), ("p", "a", "b"), ("p", "x", "y")], "project_id string, source string, target string")
    assert {r.node: (r.head, r.pos) for r in chain_heads(ring).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", 0), "y": ("x", 1)}


def test_call_contexts(spark):
    rows = [(1, "c1", "entry1", "sub", "call", "ctx1"), (2, "r1", "sub", "ending1", "call_return", "ctx1"), (3, "c2", "entry2", "sub", "call", "ctx2"), (4, "r2", "sub", "ending2", "call_return", "ctx2")]
    e = spark.createDataFrame(rows, "edge_ord long, id string, source string, target string, kind string, context string").withColumn("project_id", F.lit("p"))
    ends = spark.createDataFrame([("p", "ending1"), ("p", "ending2")], "project_id string, node string")
    got = {(r.node, r.ending) for r in reaches(e, ends).collect()}
    assert ("entry1", "ending1") in got and ("entry1", "ending2") not in got and ("entry2", "ending2") in got and ("entry2", "ending1") not in got


def test_solver(spark):
    ids = ["start", "m1", "m2", "end", "p1", "p2", "p3", "p4"]
    n = spark.createDataFrame([(i, x, "MENU" if x[0] == "m" else "LABEL", 10) for i, x in enumerate(ids)], "node_ord long, id string, type string, word_count int").withColumn("project_id", F.lit("p")).withColumn("pause_duration", F.lit(0.0))
    way = [("start", "m1", None), ("m1", "m2", "a"), ("m2", "end", "b"), ("start", "p1", None), ("p1", "p2", None), ("p2", "p3", None), ("p3", "p4", None), ("p4", "end", None)]
    e = spark.createDataFrame([(i, f"e{i}", s, t, "sequence", x, "key and n > 2" if t == "m1" else None) for i, (s, t, x) in enumerate(way)], EDGES + ", expression string").withColumn("project_id", F.lit("p")).withColumn("condition_is_statically_false", F.lit(False))
    node = lambda x: n.where(F.col("id") == x).select("project_id", F.col("id").alias("node"))
    a = routes.solve_routes(n, e, node("start"), node("end")).first()
    b = routes.solve_routes(n, e, node("start"), node("end"), "least_choices").first()
    assert (len(a.path), a.n_choices) == (4, 2) and (len(b.path), b.n_choices) == (6, 0)
    assert {r.flag: r.needed for r in routes.flags_needed(routes.solve_routes(n, e, node("start"), node("end"))).collect()} == {"key": "key and n > 2", "n": "key and n > 2"}
    assert [(x.type, x.node) for x in a.steps] == [("start", "start"), ("decision_branch", "m1"), ("choice", "m2"), ("choice", "end")] and a.steps[2].menu == "m1" and b.steps[-1].type == "ending" and not a.truncated
    none = routes.solve_routes(n, e.where("target <> 'end'"), node("start"), node("end")).first()
    assert not none.is_reachable and none.path == []


def _simple_paths(edges, start, targets):
    """All ways without a node twice, with a stack of calls: target -> (nodes, choices, words) of each."""
    found, todo = {t: [] for t in targets}, [((start,), (), 0)]
    while todo:
        path, stack, choices = todo.pop()
        if path[-1] in found:
            found[path[-1]].append((len(path), choices, len(path) * 10))
        for _, _, s, t, kind, label, context in edges:
            if s != path[-1] or t in path or (kind == "call_return" and (not stack or stack[-1] != context)):
                continue
            todo.append(((*path, t), (*stack, context) if kind == "call" else stack[:-1] if kind == "call_return" else stack, choices + bool(label)))
    return found


def test_best_routes_against_all_paths(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for trial in range(2):
        ids = [f"n{i}" for i in range(14)]
        edges = [(k, f"e{k}", f"n{a}", f"n{b}", "jump", "x" if rng.random() < 0.4 else None, None) for k, (a, b) in enumerate(rng.integers(0, 14, (26, 2))) if a != b]
        edges += [(100, "c1", "n2", "sub", "call", None, "k1"), (101, "c2", "n5", "sub", "call", None, "k2"), (102, "r1", "sub", "n9", "call_return", None, "k1"), (103, "r2", "sub", "n11", "call_return", "y", "k2")]
        n = spark.createDataFrame([(i, x, "LABEL", 10) for i, x in enumerate([*ids, "sub"])], "node_ord long, id string, type string, word_count int").withColumn("project_id", F.lit("p")).withColumn("pause_duration", F.lit(0.0))
        e = spark.createDataFrame(edges, EDGES + ", context string").withColumn("project_id", F.lit("p")).withColumn("condition_is_statically_false", F.lit(False))
        node = lambda xs: n.where(F.col("id").isin(xs)).select("project_id", F.col("id").alias("node"))
        all_ = _simple_paths(edges, "n0", [*ids, "sub"])
        for heuristic, key in (("shortest", lambda x: (x[0], x[1])), ("least_choices", lambda x: (x[1], x[0]))):
            for r in routes.solve_routes(n, e, node(["n0"]), node([*ids, "sub"]), heuristic).collect():
                want = min(all_[r.target], key=key, default=None)
                assert (r.is_reachable, (len(r.path), r.n_choices) if r.is_reachable else None, r.truncated) == (want is not None, want and want[:2], False), (trial, heuristic, r.target)
    cut = routes.solve_routes(n, e, node(["n0"]), node(ids), max_depth=2).collect()
    assert all(r.truncated for r in cut) and max(len(r.path) for r in cut) == 2


def test_counts_of_routes(spark):
    """Ways through 70 forks, more than any list could hold; a cycle and what is behind it have no number."""
    rows = [(f"n{i}", f"n{i + 1}") for i in range(70) for _ in range(2)] + [("n3", "x"), ("x", "n5"), ("n9", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", "behind"), ("lost", "n0")]
    e = spark.createDataFrame([(k, f"e{k}", s, t, "jump", None) for k, (s, t) in enumerate(rows)], EDGES).withColumn("project_id", F.lit("p")).withColumn("condition_is_statically_false", F.lit(False))
    got = {r.node: r.routes for r in routes.count_routes(e, spark.createDataFrame([("p", "n0"), ("p", "n2")], "project_id string, node string")).collect()}
    want = [1]
    for i in range(1, 71):
        want.append(2 * want[-1] + (i == 2) + (want[3] if i == 5 else 0))
    assert {k: int(v) for k, v in got.items() if v is not None} == {f"n{i}": w for i, w in enumerate(want)} | {"x": want[3]}
    assert {k for k, v in got.items() if v is None} == {"c1", "c2", "behind"}


def test_cut_lists_of_routes_say_so(spark):
    n = spark.createDataFrame([(i, f"n{i}", "LABEL", 1) for i in range(6)], "node_ord long, id string, type string, word_count int").withColumn("project_id", F.lit("p")).withColumn("pause_duration", F.lit(0.0))
    e = spark.createDataFrame([(2 * i + k, f"e{i}{k}", f"n{i}", f"n{i + 1}", "jump", None) for i in range(5) for k in range(2)], EDGES).withColumn("project_id", F.lit("p")).withColumn("condition_is_statically_false", F.lit(False))
    node = lambda x: n.where(F.col("id") == x).select("project_id", F.col("id").alias("node"))
    whole = routes.enumerate_routes(n, e, node("n0"), node("n5")).collect()
    assert len(whole) == 32 and not any(r.truncated for r in whole)
    for options in ({"max_states": 8}, {"max_routes": 31}):
        some = routes.enumerate_routes(n, e, node("n0"), node("n5"), **options).collect()
        assert 0 < len(some) < 32 and all(r.truncated for r in some)
    early = routes.enumerate_routes(n, e, node("n0"), node("n2"), max_depth=3).collect()
    assert len(early) == 4 and all(r.truncated for r in early)


def test_integrity_is_stable(story):
    n, e = story
    twice = n.unionByName(n.withColumn("node_ord", F.col("node_ord") + 100).withColumn("label", F.lit("later")))
    nodes, edges = integrity.resolve(twice, e.unionByName(e.withColumn("edge_ord", F.col("edge_ord") + 50)))
    assert nodes.count() == 7 and nodes.where("label = 'later'").count() == 0 and edges.count() == 5
    gone = integrity.placeholders(n.where("id <> 'good_ending'"), e).first()
    assert (gone.id, gone.label, gone.chapter) == ("good_ending", "(unresolved) good_ending", "__unresolved__")
    once = closure(e, n.where("id = 'start'").select("project_id", F.col("id").alias("node")), ["project_id"])
    again = closure(e, once.select("project_id", "node"), ["project_id"])
    assert {r.node for r in once.collect()} == {r.node for r in again.collect()}


def test_folding(spark):
    n = spark.createDataFrame([(0, "ch1_start", "chapter1.rpy"), (1, "ch1_menu", "chapter1.rpy"), (2, "ch2_start", "chapter2.rpy"), (3, "orphan", None)], "node_ord long, id string, chapter string").withColumn("project_id", F.lit("p"))
    e = spark.createDataFrame([(1, "e1", "ch1_start", "ch1_menu", "sequence", None), (2, "e2", "ch1_menu", "ch2_start", "jump", None), (3, "e3", "orphan", "ch1_start", "call", None)], EDGES).withColumn("project_id", F.lit("p"))
    got = {r.id: (r.source, r.target) for r in collapse.redirect_chapters(e, n, n.where("id = 'ch1_start'")).collect()}
    assert got == {"e2": ("chapter:chapter1.rpy", "ch2_start"), "e3": ("orphan", "chapter:chapter1.rpy")}
    m = spark.createDataFrame([(1, "a", "start", "menu_1", "sequence", None, None), (2, "b", "menu_1", "menu_2", "jump", "Go A", None), (3, "c", "menu_1", "target_b", "jump", "Go B", None), (4, "d", "menu_2", "target_a", "jump", "Confirm", "score > 5")], EDGES + ", expression string").withColumn("project_id", F.lit("p"))
    menus = spark.createDataFrame([("p", "menu_1"), ("p", "menu_2")], "project_id string, id string")
    got = {(r.source, r.target): (r.label, r.expression) for r in collapse.collapse_menus(m, menus).collect()}
    assert got == {("start", "target_a"): ("Confirm", "score > 5"), ("start", "target_b"): ("Go B", None)}


SCRIPT = '''label start(a, b=2):
    e happy "Hello # not a comment"  # a comment
    "Just text"
    extend "more"
    $ gold += 5
    $ seen = not seen
    menu choice:
        "Go" if gold > 3:
            jump .inner
        "Stay":
            call sub from back
    return
label .inner:
    scene bg room with fade
    play music "theme.ogg" fadein 1.0
    if gold > 3:
        jump end
    elif seen:
        return
    else:
        jump start
'''


def test_scripts(spark):
    files = spark.createDataFrame([("p", "a.rpy", SCRIPT)], "project_id string, path string, content string")
    s = extract.statements(scripts.file_lines(files)).cache()
    assert [(r.id, [(x.name, x.default_value) for x in r.parameters]) for r in extract.labels(s).orderBy("line_no").collect()] == [("start", [("a", None), ("b", "2")]), ("start.inner", [])]
    assert [(r.speaker, r.text) for r in extract.say_lines(s).orderBy("line_no").collect()] == [("e", "Hello # not a comment"), ("narrator", "Just text"), ("narrator", "more")]
    got = {(r.source, r.target, r.kind, r.label, r.expression) for r in extract.transfers(s).collect()}
    assert ("start", "start.inner", "jump", "Go", "gold > 3") in got and ("start", "sub", "call", "Stay", None) in got and ("start.inner", "end", "jump", None, None) in got
    assert [(r.name, r.op, r.value) for r in extract.mutations(s).orderBy("line_no").collect()] == [("gold", "+=", "5"), ("seen", "toggle", "not seen")]
    assert [(r.type, r.channel, r.asset) for r in extract.cues(s).orderBy("line_num").collect()] == [("scene", None, "bg room"), ("play", "music", "theme.ogg")]
    assert [(r.branch_kind, r.expression) for r in extract.decisions(s).orderBy("line_no").collect()] == [("if", "gold > 3"), ("elif", "seen"), ("else", None)]
    assert extract.menus(s).select("id", "items").first() == ("menu_choice", 2)
    assert {r.id for r in extract.reliable_returns(s).collect()} == {"start"}


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("game/x.rpy", "label x:")
        z.writestr("../evil.rpy", "no")
        z.writestr("notes.txt", "no")
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = scripts.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.path or "", r.error is None) for r in got) == [("", False), ("game/x.rpy", True)]


def test_call_depth_and_roles(story):
    n, e = story
    assert {r.id: r.role for r in link.classify_roles(n.withColumn("parent_label_id", F.lit(None).cast("string")), e, n.limit(0)).collect()}["start"] == "story"
    assert {r.depth for r in link.call_depth(e, link.call_starts(n))[0].collect()} <= {0, 1}
