"""Scripts to graphs: whole sets of edges of small scripts, and the linked graph of two files."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import diagnostics, story
from loomgraph.sources import assemble, extract, scripts

FILES = "project_id string, path string, file_ord int, content string"


def _files(spark, *texts):
    return spark.createDataFrame([("p", f"f{i}.rpy", i, t) for i, t in enumerate(texts)], FILES)


def _build(spark, *texts):
    return assemble.build(extract.statements(scripts.file_lines(_files(spark, *texts))))


def _edges(df):
    return {(r.source, r.target, r.kind, r.label) for r in df.collect()}


@pytest.fixture(scope="module")
def many(spark):
    """Several scripts, a file each: their edges and nodes by file."""
    texts = {
        # what stands behind a menu: a continuation, a lone jump, a lone return, nothing
        "cont": 'label a:\n    "one two"\n    menu:\n        "Stay":\n            "I stay"\n        "Go" if x > 1:\n            jump b\n    "after"\n    "that"\n    jump b\nlabel b:\n    return\n',
        "lone_jump": 'label a:\n    menu:\n        "Stay":\n            pass\n        "Go":\n            call c(1)\n    jump d\nlabel b:\n    return\nlabel c:\n    return\nlabel d:\n    return\n',
        "lone_return": 'label a:\n    menu:\n        "Stay":\n            pass\n        "Go":\n            return\n    scene bg\n    return\nlabel b:\n    "x"\n',
        "next": 'label a:\n    menu:\n        "Stay":\n            pass\n    menu second:\n        "What?"\n        "End":\n            if f:\n                jump b\n            else:\n                jump c\n        "Quit":\n            $ renpy.quit()\n        "On":\n            pass\nlabel b:\n    "x"\nlabel c:\n    return\n',
        "nested": 'label a:\n    menu outer:\n        "Ask":\n            menu inner:\n                "Yes":\n                    jump a\n                "No":\n                    pass\n        "Leave":\n            jump b\nlabel b:\n    return\n',
        # decisions
        "exits": 'label a:\n    if f:\n        jump b\n    else:\n        return\n    "never counted as a way on"\n    jump c\nlabel b:\n    "b"\nlabel c:\n    return\n',
        "no_else": 'label a:\n    if f:\n        $ x = 1\nlabel b:\n    return\n',
        "deep": 'label a:\n    if f:\n        if g == 2:\n            jump b\n        elif h:\n            call c\n    "then"\n    jump b\nlabel b:\n    return\nlabel c:\n    return\n',
        "menu_in_if": 'label a:\n    "say"\n    if f:\n        menu m:\n            "A":\n                jump b\n            "B":\n                pass\n        jump c\n    "behind"\n    return\nlabel b:\n    "b"\nlabel c:\n    return\n',
        "match": 'label a:\n    match mood:\n        case "sad" | "mad":\n            jump b\n        case m if m > 1:\n            "x"\n        case _:\n            return\n    jump c\nlabel b:\n    return\nlabel c:\n    return\n',
        "loops": 'label a:\n    for i in things:\n        call b\n    while n < 3:\n        jump c\nlabel b:\n    return\nlabel c:\n    MainMenu()\n',
        "timed": 'label a:\n    $ timedchoice(5, "b")\n    menu m:\n        "A":\n            jump c\n    $ timedchoice(2.5, "c")\n    return\nlabel b:\n    return\nlabel c:\n    return\n',
        "local": 'label a:\n    jump .x\nlabel .x:\n    return\nlabel .y:\n    call .x\n    return\n',
    }
    g = _build(spark, *texts.values())
    edges, nodes = {n: set() for n in texts}, {n: {} for n in texts}
    names = list(texts)
    for r in g.edges.collect():
        edges[names[int(r.path[1:-4])]].add((r.source, r.target, r.kind, r.label))
    for r in g.nodes.collect():
        nodes[names[int(r.path[1:-4])]][r.id] = r
    details = {(names[int(r.path[1:-4])], r.id): r for r in g.edges.collect()}
    return edges, nodes, details, {r.id for r in g.returning.collect()}


def test_behind_a_menu(many):
    edges, nodes, details, _ = many
    menu = "menu_f0.rpy_1"
    assert edges["cont"] == {("a", menu, "sequence", None), (menu, "a__cont_L7", "sequence", "Stay"), (menu, "b", "jump", "Go"), ("a__cont_L7", "b", "jump", None)}
    n = nodes["cont"]
    assert (n["a"].dialogue_count, n["a"].word_count, n["a__cont_L7"].dialogue_count, n[menu].dialogue_count, n[menu].parent_label_id) == (1, 2, 2, 1, "a")
    assert (details["cont", f"jump_{menu}__b_c1"].expression, details["cont", f"jump_{menu}__b_c1"].decision_node_id) == ("x > 1", menu)
    menu = "menu_f1.rpy_1"
    assert edges["lone_jump"] == {("a", menu, "sequence", None), (menu, "d", "jump", "Stay"), (menu, "c", "call", "call: Go")}
    call = details["lone_jump", f"call_{menu}__c_c1"]
    assert (call.return_target, call.context, call.arguments) == ("d", call.id, "1")
    assert edges["lone_return"] == {("a", "menu_f2.rpy_1", "sequence", None)}


def test_menus_in_a_row_and_nested(many):
    edges, nodes, details, _ = many
    first = "menu_f3.rpy_1"
    assert edges["next"] == {("a", first, "sequence", None), (first, "menu_second", "sequence", "Stay"), ("menu_second", "b", "jump", "End"), ("menu_second", "c", "jump", "End"), ("menu_second", "b", "sequence", "On"), ("b", "c", "sequence", "next")}
    assert (nodes["next"]["menu_second"].label, nodes["next"]["menu_second"].dialogue_count) == ("second", 1)
    assert {details["next", i].branch_kind for i in ("cjump_menu_second__b_c0_L7", "cjump_menu_second__c_c0_L9")} == {"if", "else"}
    assert edges["nested"] == {("a", "menu_outer", "sequence", None), ("menu_outer", "menu_inner", "sequence", "Ask"), ("menu_inner", "a", "jump", "Yes"), ("menu_inner", "b", "sequence", "No"), ("menu_outer", "b", "jump", "Leave")}


def test_decisions(many):
    edges, nodes, details, _ = many
    d = "decision_a_L1"
    assert edges["exits"] == {("a", d, "sequence", None), (d, "b", "jump", "[if f]"), ("b", "c", "sequence", "next")}
    # the way past the decision and the label's own fallthrough lead to the same place
    assert edges["no_else"] == {("a", d, "sequence", None), ("a", "b", "sequence", "next")}
    inner = f"decision_{d}_L2"
    # behind the branches of an inner decision the story goes on behind the outer one; its label itself needs no edge
    assert edges["deep"] == {("a", d, "sequence", None), (d, inner, "sequence", "[if f]"), (inner, "b", "jump", "[if g == 2]"), (inner, "c", "call", "call"), (inner, "a", "sequence", "else"), (d, "a", "sequence", "else"), ("a", "b", "jump", None)}
    assert details["deep", f"call_{inner}__c_L5"].return_target == "a"
    m, cont = "decision_a_L2", "a__cont_L9"
    assert edges["menu_in_if"] == {("a", m, "sequence", None), (m, "menu_m", "sequence", None), ("menu_m", "b", "jump", "A"), ("menu_m", "c", "jump", "B"), (m, cont, "sequence", "else"), ("b", "c", "sequence", "next")}
    assert (nodes["menu_in_if"]["menu_m"].parent_label_id, nodes["menu_in_if"][cont].dialogue_count) == ("a", 1)
    assert edges["match"] == {("a", d, "sequence", None), (d, "b", "jump", 'case "sad" | "mad"'), (d, "c", "sequence", "case m"), ("a", "c", "jump", None)}
    assert details["match", f"cjump_{d}__b_L2"].expression == '((mood) == ("sad")) or ((mood) == ("mad"))'
    assert details["match", f"cseq_{d}__c_L4"].expression == "m > 1"


def test_loops_timed_choices_and_ends(many):
    edges, nodes, details, returning = many
    assert edges["loops"] == {("a", "for_a_L1", "sequence", None), ("for_a_L1", "b", "call", "call"), ("a", "while_a_L3", "sequence", None), ("while_a_L3", "c", "jump", None), ("a", "b", "sequence", "next")}
    assert nodes["loops"]["c"].is_terminal_outcome and nodes["loops"]["for_a_L1"].label == "for i in things"
    assert edges["timed"] == {("a", "menu_m", "sequence", None), ("menu_m", "c", "jump", "A"), ("menu_m", "b", "jump", "Timeout (5s)"), ("a__cont_L5", "c", "jump", None)}
    assert details["timed", "tc_menu_m__b_L1"].timeout.duration_seconds == 5.0
    assert edges["local"] == {("a", "a.x", "jump", None), ("a.y", "a.x", "call", "call")}
    assert {"b", "c", "a.x", "a.y"} <= returning


def test_screens(spark):
    g = _build(spark, 'label a:\n    "x"\n    call screen shop\nlabel b:\n    return\n', 'screen shop():\n    textbutton "x" action Jump("nowhere")\n', 'screen shop():\n    textbutton "Buy" action [SetVariable("gold", 1), Call("b")]\n    textbutton "Back" action Return()\n    timer 4.5 action Jump("b")\n    textbutton "?" action Odd("z")\n    textbutton "!" action Jump(somewhere)\n')
    own = "screen_call_a_shop_L2"
    got = {(r.source, r.target, r.kind, r.label, r.timeout and r.timeout.duration_seconds) for r in g.edges.collect()}
    assert got == {("a", own, "sequence", None, None), (own, "b", "call", "screen: shop", None), (own, "a", "sequence", "return", None), (own, "b", "jump", "screen: shop", 4.5)}
    assert {(r.action, r.category) for r in g.actions.where("category is not null").collect()} == {("Odd", "unmapped_screen_action"), ("Jump", "dynamic_target")}
    rules = spark.createDataFrame([("odd", "jump")], "action_name string, action_kind string")
    g = assemble.build(extract.statements(scripts.file_lines(_files(spark, 'label a:\n    call screen s\nscreen s():\n    textbutton "?" action Odd("z")\n'))), rules)
    assert ("screen_call_a_s_L1", "z", "jump", "screen: s") in _edges(g.edges)


def test_linked_files(spark):
    s = story.linked(_files(spark, 'label start:\n    call sub\n    jump end\nlabel sub:\n    menu m:\n        "Back":\n            pass\n    return\n', 'label end:\n    "The end"\nlabel sub:\n    jump end\nlabel lost:\n    jump end\n'))
    nodes = {r.id: r for r in s.nodes.collect()}
    assert set(nodes) == {"start", "sub", "menu_m", "end", "sub__shadow_2", "lost"}
    assert nodes["sub__shadow_2"].is_shadowed and nodes["sub__shadow_2"].shadow_of_id == "sub"
    edges = {r.id: (r.source, r.target, r.kind) for r in s.edges.collect()}
    assert edges["ret_call_start__sub_L1"] == ("sub", "start", "call_return") and edges["ret_call_start__sub_L1__menu_m"] == ("menu_m", "start", "call_return")
    assert edges["seq_end__sub__shadow_1"] == ("end", "sub__shadow_2", "sequence") and edges["jump_sub__end_L3__shadow_2"] == ("sub__shadow_2", "end", "jump")
    assert {i for i, r in nodes.items() if r.is_orphan} == {"lost"}


def test_files_without_labels(spark):
    g = _build(spark, "", "# nothing\n", "jump a\n    menu:\n        \"x\":\n            jump b\n")
    assert g.edges.count() == 0 and g.nodes.count() == 0
    s = story.linked(_files(spark, "init python:\n    x = 1\n").limit(0))
    assert s.nodes.count() == 0 and s.edges.count() == 0


def test_dead_options_after_assignments(spark):
    text = (
        'default gold = 5\ndefine rich = False\ndefault name = "Al"\nlabel start:\n    $ gold -= 3\n    $ rich = not rich\n    $ luck = roll()\n    menu m:\n'
        '        "A" if gold > 4:\n            jump b\n        "B" if gold == 2 and rich:\n            jump b\n        "C" if luck > 3:\n            jump b\n        "D" if name == "Bo":\n            jump b\n'
        '    "then"\n    $ gold *= 10\n    if gold < 15:\n        jump b\n    jump c\nlabel b:\n    $ gold = 1\n    return\nlabel c:\n    return\n'
    )
    s = story.linked(_files(spark, text))
    dead = {(r.source, r.label) for r in s.edges.where("condition_is_statically_false").collect()}
    # the decision behind the menu is a node of its own, before which nothing is assigned
    assert dead == {("menu_m", "A"), ("menu_m", "D")}


def test_diagnostics_in_one_table(spark):
    one = (
        'default gold = 1\ndefault never = 2\ndefine e = Character("E")\nlabel start:\n    e "You have [gold] coins"\n    call sub\n    call other\n    jump nowhere\n'
        "label chapter_1:\n    jump expression (\"chapter_\" + str(n))\nlabel chapter_2:\n    jump expression what\nlabel sub:\n    return\nlabel other:\n    if ghost > 1:\n        jump start\n    menu:\n"
        '        "A" if gold > 5:\n            jump start\n    call screen s\nscreen s():\n    textbutton "?" action Odd("z")\n'
    )
    s = story.linked(_files(spark, one, "label sub:\n    return\n"))
    edges = {(r.source, r.target) for r in s.edges.where("id like 'djump%'").collect()}
    assert edges == {("chapter_1", "chapter_1"), ("chapter_1", "chapter_2")}
    found = diagnostics.collect(s)
    got = sorted((r.code, r.category, r.severity, r.source_id or r.detail) for r in found.collect())
    assert [x for x in got if x[1] != "unused_variable"] == sorted([
        ("dynamic_target", "dynamic_target", "warning", "chapter_2"), ("normalization", "dangling_stack", "warning", "start"), ("normalization", "dead_menu_option", "warning", "menu_f0.rpy_1"),
        ("normalization", "shadowed_target_resolution", "warning", "start"), ("normalization", "undeclared_variable", "warning", "decision_other_L15"), ("shadowed_label", "shadowed_label", "warning", "sub__shadow_2"),
        ("unmapped_screen_action", "unmapped_screen_action", "warning", "s"), ("unresolved_target", "unresolved_target", "warning", "start"),
    ])
    assert ("normalization", "unused_variable", "warning", "never") in got and ("normalization", "unused_variable", "warning", "gold") not in got
    assert found.where("category = 'dead_menu_option' and path = 'f0.rpy' and line_no = 18").count() == 1
    counts = {(r.code, r.category): r.n for r in diagnostics.report(found).collect()}
    assert counts[None, None] == len(got) and counts["unresolved_target", None] == 1 and counts["normalization", "dangling_stack"] == 1


def test_lines_that_go_on(spark):
    text = (
        'default a = [1,\n    "x (", # not ( this\n    3]\ndefine t = """one\n  two"""\nlabel l:\n    $ x, y = 1, True\n    $ z = f(1,\n        2)\n    e """Many\n    lines."""\n'
        '    "It (is" # so\n    $ broken = (1\n    "lost"\nlabel m:\n    "kept"\n    # """ no\n    jump l\n'
    )
    lines = extract.logical_lines(scripts.file_lines(_files(spark, text)))
    got = {r.line_no: r.text for r in lines.collect()}
    assert got[0] == 'default a = [1, "x (", 3]' and got[3] == 'define t = "one\\ntwo"' and got[7] == "    $ z = f(1, 2)" and got[9] == '    e "Many\\nlines."'
    assert got[11] == '    "It (is" # so' and got[12].endswith('(1 "lost"') and got[15] == '    "kept"' and got[17] == "    jump l"
    stmts = extract.statements(lines)
    assert {(r.name, r.value, r.value_type) for r in extract.mutations(stmts).where("line_no = 6").collect()} == {("x", "1", "num"), ("y", "True", "bool")}
    assert {r.name: r.value_json for r in story.initial_values(stmts, _files(spark, text).select("project_id", "path", "file_ord")).collect()} == {"a": '[1, "x (", 3]', "t": '"one\\ntwo"'}
    assert {(r.label_id, r.line_no) for r in extract.say_lines(stmts).collect()} == {("l", 9), ("l", 11), ("m", 15)}
