"""Dynamic jumps by the values of names, and declarations of Python blocks."""

from loomgraph.operators import diagnostics, story
from loomgraph.sources import extract, scripts

FILES = "project_id string, path string, file_ord int, content string"


def _files(spark, *texts):
    return spark.createDataFrame([("p", f"f{i}.rpy", i, t) for i, t in enumerate(texts)], FILES)


def _stmts(spark, *texts):
    return extract.statements(extract.logical_lines(scripts.file_lines(_files(spark, *texts))))


LABELS = "".join(f"label {n}:\n    return\n" for n in ("room_1", "room_2", "room_3", "hall", "attic", "cellar", "day_2_end", "day_3_end"))

JUMPS = {
    # from a declaration, through several names and an f-string
    "declared": ("    jump expression home\n", {"hall"}),
    "sum": ('    jump expression "room_" + str(first + 1)\n', {"room_2"}),
    "fstring": ('    $ day = first + 1\n    jump expression f"day_{day}_end"\n', {"day_2_end"}),
    # the last assignment on every way counts, those of branches add to it
    "last": ('    $ to = "attic"\n    $ to = "cellar"\n    jump expression to\n', {"cellar"}),
    "branches": ('    $ to = "attic"\n    if hot:\n        $ to = "cellar"\n    jump expression to\n', {"attic", "cellar"}),
    "either": ('    if hot:\n        $ home = "attic"\n    jump expression home\n', {"attic", "hall"}),
    "within": ('    if hot:\n        $ home = "attic"\n        jump expression home\n    return\n', {"attic"}),
    "later": ('    jump expression home\n    $ home = "attic"\n', {"hall"}),
    # values by values
    "product": ('    $ n = 1\n    if hot:\n        $ n += 2\n    jump expression "room_" + str(n)\n', {"room_1", "room_3"}),
    "through": ('    $ a = "room"\n    $ b = a + "_"\n    $ c = b + str(first)\n    jump expression c\n', {"room_1"}),
    "block": ('    python:\n        to = "attic"\n    jump expression to\n', {"attic"}),
    # a target that is no label is one all the same, where it is known
    "nowhere": ('    $ to = "moon"\n    jump expression to\n', {"moon"}),
    # what isn't known in every case is told by fixed parts or not at all
    "unknown": ('    $ n = roll()\n    jump expression "room_" + str(n)\n', {"room_1", "room_2", "room_3"}),
    "partly": ('    $ home = roll()\n    jump expression home\n', set()),
    "ternary": ('    jump expression "attic" if luck else "mars"\n', {"attic"}),
    "ruled": ("    jump expression by_rule(3)\n", {"cellar"}),
}


def test_dynamic_jumps_by_values(spark):
    text = 'default home = "hall"\ninit python:\n    first = 1\n' + "".join(f"label {n}:\n{body}" for n, (body, _) in JUMPS.items()) + LABELS
    rules = spark.createDataFrame([("^by_rule", "cellar")], "pattern string, target string")
    s = story.linked(_files(spark, text, "label other:\n    $ home = \"attic\"\n    return\n"), jump_rules=rules)
    got = {n: set() for n in JUMPS}
    for r in s.edges.where("id like 'djump%'").collect():
        got[r.source].add(r.target)
    assert got == {n: want for n, (_, want) in JUMPS.items()}
    assert {r.source for r in s.dynamic.collect()} == {"partly"}
    found = diagnostics.collect(s)
    assert {(r.category, r.source_id, r.target_id) for r in found.where("category in ('dynamic_target', 'unresolved_target')").collect()} == {("dynamic_target", "partly", None), ("unresolved_target", "nowhere", "moon")}
    declared = {r.name for r in s.names.collect()}
    assert {"home", "first", "to", "n", "a", "b", "c", "day"} <= declared


def test_init_blocks(spark):
    text = (
        "python early:\n    a = 'early'\ninit -2 python:\n    b = [1, 2,\n        3]\n    x, y = 1, 2\n    persistent.seen = True\n    b2 += 1\n    if a == 'z':\n        c = 5\n    def f(k=1):\n        d = 6\n        return d\n"
        "init:\n    $ e = {'k': 'v = 1'}\ninit 5:\n    python:\n        g = \"it's\"\nlabel start:\n    python:\n        h = 7\n        h *= 2\n        i, j = 3, 4\n    $ e = 8\n    for who, n in team:\n        pass\n    return\ninit python:\n    z = 'last'\n"
    )
    stmts = _stmts(spark, text)
    got = {r.name: (r.raw_expression, r.kind, r.priority) for r in extract.init_vars(stmts).collect()}
    assert got == {
        "a": ("'early'", "python", -50000), "b": ("[1, 2, 3]", "python", -2), "x": ("1", "python", -2), "y": ("2", "python", -2), "persistent.seen": ("True", "persistent", -2),
        "e": ("{'k': 'v = 1'}", "python", 0), "g": ('"it\'s"', "python", 5), "z": ("'last'", "python", 0),
    }
    told = sorted((r.name, r.op, r.value) for r in extract.mutations(stmts).collect())
    assert told == [("e", "=", "8"), ("h", "*=", "2"), ("h", "=", "7"), ("i", "=", "3"), ("j", "=", "4")]
    values = {r.name: r.value_json for r in story.initial_values(stmts, _files(spark, text).select("project_id", "path", "file_ord")).collect()}
    assert values["b"] == "[1, 2, 3]" and values["e"] == '{"k": "v = 1"}' and values["persistent.seen"] == "true"
    s = story.linked(_files(spark, text))
    assert {"who", "n"} <= {r.name for r in s.names.collect()} and "a" not in {r.detail for r in diagnostics.collect(s).where("category = 'unused_variable'").collect()}
