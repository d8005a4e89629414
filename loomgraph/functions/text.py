"""Scalar functions over story text: counts, times, literals, names and cells. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"\{[^}]+\}"
PAUSE = r"(?i)\{[wp]=([0-9.]+)\}"
BLANK = r"[^ \t\n\r\f\x0B]+"
NAME = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"

#: Words of the condition language that are no flags.
KEYWORDS = (
    "true", "false", "none", "null", "and", "or", "not", "is", "in", "len", "str", "int",
    "bool", "if", "else", "for", "while", "return", "pass",
)

#: Kinds of edges; any other counts as sequence.
EDGE_KINDS = ("sequence", "jump", "call", "call_return", "fallthrough")

#: Words of a label that name an ending's type, and phrases of its text, in the order they are tried.
ENDING_RULES = (
    ("true", "true|best|perfect|golden", "true ending|true end"),
    ("good", "good|happy|peaceful|victory|win", "good ending|good end|happily ever after"),
    ("dead_end", "gameover|game_over|dead|death|die|killed|failed|failure|trap", "game over|you died|killed"),
    ("bad", "bad|evil|dark|tragedy|tragic|sad|worst|corrupt|doom", "bad ending|bad end"),
    ("normal", "normal|neutral|default|standard", "normal ending|normal end"),
)


def word_count(text: Column) -> Column:
    """Words of a line without its {tags}; null: 0."""
    return F.coalesce(F.regexp_count(F.regexp_replace(text, TAG, ""), F.lit(BLANK)), F.lit(0)).cast("int")


def pause_seconds(text: Column) -> Column:
    """Sum of N over {w=N} and {p=N}; a tag without a number counts 0."""
    found = F.regexp_extract_all(text, F.lit(PAUSE), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0))


def reading_seconds(words: Column, pause: Column, wpm: float | Column = 200.0) -> Column:
    """Reading time at ``wpm`` words a minute plus pauses; 0 if there is neither."""
    speed = F.greatest(F.lit(1.0), wpm if isinstance(wpm, Column) else F.lit(float(wpm)))
    return F.when((words <= 0) & (pause <= 0), 0.0).otherwise(words / speed * 60 + pause)


def _h_m(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60), minutes % 60
    hours = F.concat(h.cast("string"), F.lit("h"))
    return F.when(m > 0, F.concat(hours, F.lit(" "), m.cast("string"), F.lit("m"))).otherwise(hours)


def format_minutes(seconds: Column) -> Column:
    """``< 1m``, or whole minutes rounded up as ``Xm``, ``Xh``, ``Xh Ym``."""
    minutes = F.ceil(seconds / 60).cast("long")
    return F.when(seconds <= 0, "< 1m").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(_h_m(minutes))


def format_seconds(seconds: Column) -> Column:
    """``0s``, ``45s``, ``1m 30s``, ``1h 1m``: rounded half up; hours leave out seconds."""
    total = F.floor(seconds + 0.5).cast("long")
    m, s = F.floor(total / 60), total % 60
    minutes = F.concat(m.cast("string"), F.lit("m"))
    short = F.when(s > 0, F.concat(minutes, F.lit(" "), s.cast("string"), F.lit("s"))).otherwise(minutes)
    return (
        F.when(total <= 0, "0s").when(total < 60, F.concat(total.cast("string"), F.lit("s")))
        .when(total < 3600, short).otherwise(_h_m(m))
    )


def ending_type(label: Column, lines: Column, dialogue_count: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The type of an ending by its label and text; ``rules``: (pattern, type), tried first."""
    label = F.coalesce(label, F.lit(""))
    text = F.lower(F.concat(label, F.lit(" "), F.coalesce(F.array_join(lines, " "), F.lit(""))))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, kind in rules or []:
        chain = chain.when(label.rlike(pattern) | text.rlike(pattern), kind)
    for kind, words, phrases in ENDING_RULES:
        chain = chain.when(label.rlike(rf"(?i)(?:^|_|\b)({words})(?:_|\b|$)") | text.rlike(rf"\b({phrases})\b"), kind)
    short = (dialogue_count <= 2) & label.rlike(r"(?i)(?:^|_|\b)(return|end)(?:_|\b|$)")
    return chain.when(short, "dead_end").otherwise("normal")


def without_strings(expression: Column) -> Column:
    return F.regexp_replace(expression, r'"[^"]*"|\x27[^\x27]*\x27', " ")


def condition_refs(expression: Column) -> Column:
    """Sorted distinct names in a condition; ``a.b.c`` gives a, a.b and a.b.c. Null or blank: none."""
    names = F.regexp_extract_all(without_strings(expression), F.lit(NAME), F.lit(0))
    prefixes = F.transform(names, lambda n: F.transform(F.sequence(F.lit(1), F.size(F.split(n, "\\."))), lambda k: F.call_function("substring_index", n, F.lit("."), k)))
    kept = F.filter(F.flatten(prefixes), lambda n: ~F.lower(n).isin(*KEYWORDS))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def extract_literal(text: Column) -> Column:
    """The string of a quoted literal (', " or triple, prefixes r, u, f), unescaped unless raw; else null."""
    t = F.trim(text)
    shape = r'(?s)^([rRuUfFbB]{0,2})("""(.*)"""|\x27\x27\x27(.*)\x27\x27\x27|"([^"\\]*(?:\\.[^"\\]*)*)"|\x27([^\x27\\]*(?:\\.[^\x27\\]*)*)\x27)$'
    body = F.concat(*[F.regexp_extract(t, shape, i) for i in (3, 4, 5, 6)])
    plain = F.replace(F.replace(F.regexp_replace(body, r"\\([^nt])", "$1"), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    raw = F.lower(F.regexp_extract(t, shape, 1)).contains("r")
    return F.when(t.rlike(shape), F.when(raw, body).otherwise(plain))


def interpolated(text: Column) -> Column:
    """Names in [name.attr] references, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))


def csv_cell(value: Column) -> Column:
    """A cell of a CSV file: quoted where needed, formulas defused by an apostrophe; null: empty."""
    s = value.cast("string")
    formula = s.rlike(r"^[=+\-@\t\r]") | s.rlike(r"^\s+[=+\-@]")
    quoted = F.concat(F.lit('"'), F.when(formula, F.lit("'")).otherwise(F.lit("")), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull(), "").when(formula | s.rlike(r'[,"\n\r]'), quoted).otherwise(s)


def markdown_cell(value: Column) -> Column:
    """A cell of a Markdown table: pipes escaped, line breaks to spaces, trimmed; null: empty."""
    s = F.replace(value.cast("string"), F.lit("|"), F.lit("\\|"))
    return F.coalesce(F.trim(F.regexp_replace(s, r"\r?\n|\r", " ")), F.lit(""))


def base_label(node_id: Column, parent_label_id: Column) -> Column:
    """The label a node belongs to: its parent, else its id before ``__cont_`` or ``__scene_``."""
    cont = F.substring_index(node_id, "__cont_", 1)
    return F.coalesce(parent_label_id, F.when(node_id.contains("__cont_"), cont).otherwise(F.substring_index(node_id, "__scene_", 1)))


def edge_kind(kind: Column) -> Column:
    return F.when(kind.isin(*EDGE_KINDS), kind).otherwise("sequence")
