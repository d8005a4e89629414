"""Three-valued conditions over flags, and constant expressions.

Expressions are read by Python's own ``ast`` and never executed. Spark evaluates each distinct
(expression, scenario) pair once, in a vectorized helper, and joins the answers back.
"""

from __future__ import annotations

import ast
import json
import math
import operator
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unknown(Exception):
    """The value can't be known."""


_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\Z")
#: Words that stand for a value in any spelling.
_WORDS = {"true": True, "false": False, "none": None, "null": None}
_ORDER = {ast.Lt: operator.lt, ast.Gt: operator.gt, ast.LtE: operator.le, ast.GtE: operator.ge}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: math.fmod}
DEEPEST = 200


def _word(text: str):
    t = text.strip().lower()
    return _WORDS[t] if t in _WORDS else float(text) if _NUMBER.match(text) else text


def _number(v) -> float | None:
    """The number a value compares as; None if it has none."""
    if isinstance(v, str):
        v = _word(v)
    return None if isinstance(v, str) else 0.0 if v is None else float(v)


def same(a, b) -> bool:
    """Equality with nothing = false, true = 1, and "16" = 16.0; other strings by their trimmed text."""
    nil = lambda v: v is None or (isinstance(v, str) and _word(v) is None)
    if nil(a) or nil(b):
        other = b if nil(a) else a
        return nil(other) or (_number(other) == 0 if _number(other) is not None else not str(other).strip())
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        # the words true and false in quotes equal no number
        return not any(isinstance(v, str) and not _NUMBER.match(v) for v in (a, b)) and x == y
    return isinstance(a, str) and isinstance(b, str) and x is None and y is None and a.strip() == b.strip()


def _arithmetic(op: type, a, b) -> float:
    if isinstance(a, bool) or isinstance(b, bool) or op not in _ARITHMETIC:
        raise Unknown
    x, y = _number(a), _number(b)
    if x is None or y is None or (op in (ast.Div, ast.Mod) and y == 0):
        raise Unknown
    return _ARITHMETIC[op](x, y)


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    raise Unknown


def _value(node: ast.AST, look: Callable[[str], object], depth: int = 0):
    if depth > DEEPEST:
        raise Unknown
    go = lambda n: _value(n, look, depth + 1)
    match node:
        case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
            return v
        case ast.Name() | ast.Attribute():
            name = _dotted(node)
            return _WORDS[name.lower()] if name.lower() in _WORDS else look(name)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return not go(x)
        case ast.UnaryOp(op=op, operand=x) if isinstance(op, (ast.USub, ast.UAdd)):
            v = go(x)
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise Unknown
            return -v if isinstance(op, ast.USub) else v
        case ast.BoolOp(op=op, values=parts):
            decisive, unknown = isinstance(op, ast.Or), False
            for p in parts:
                try:
                    if bool(go(p)) == decisive:
                        return decisive
                except Unknown:
                    unknown = True
            if unknown:
                raise Unknown
            return not decisive
        case ast.Compare(left=left, ops=ops, comparators=rest):
            a = go(left)
            for op, part in zip(ops, rest):
                b = go(part)
                if isinstance(op, (ast.Eq, ast.Is, ast.NotEq, ast.IsNot)):
                    ok = same(a, b) == isinstance(op, (ast.Eq, ast.Is))
                else:
                    x, y = _number(a), _number(b)
                    if type(op) not in _ORDER or x is None or y is None:
                        raise Unknown
                    ok = _ORDER[type(op)](x, y)
                if not ok:
                    return False
                a = b
            return True
        case ast.BinOp(left=a, op=op, right=b):
            return _arithmetic(type(op), go(a), go(b))
    raise Unknown


def evaluate(expression: str | None, flags: dict[str, str | None]) -> bool | None:
    """True, False, or None for unknown. Flags hold true, false, unknown, none, a number or a text."""

    def look(name: str):
        v = flags.get(name)
        if v is None or v == "unknown":
            raise Unknown
        return _word(v)

    try:
        text = (expression or "").replace("&&", " and ").replace("||", " or ")
        v = _value(ast.parse(text.strip(), mode="eval").body, look)
        return bool(v) and v == v
    except (Unknown, SyntaxError, ValueError, RecursionError, OverflowError, MemoryError):
        return None


def _text(v) -> str:
    """A value as text; whole numbers have no fraction, as arithmetic here is in doubles."""
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


_CALLS: dict[str, Callable] = {"str": _text, "int": lambda v: int(float(v)), "bool": bool, "len": len}


def fold(expression: str | None, env: dict[str, object]) -> tuple[bool, object, list[str]]:
    """Constant folding: whether it worked, the value, and the strings it may be.

    Literals, f-strings, lists, dicts, subscripts, ternaries, ``in``, str/int/bool/len and arithmetic over
    names of ``env``. A ternary whose test is unknown gives both its strings as candidates.
    """

    def strings(v) -> list[str]:
        return [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []

    def go(n: ast.AST, depth: int = 0):
        if depth > DEEPEST:
            raise Unknown
        down = lambda x: go(x, depth + 1)
        match n:
            case ast.List(elts=e) | ast.Tuple(elts=e):
                return [down(x) for x in e]
            case ast.Dict(keys=k, values=v):
                return {down(x): down(y) for x, y in zip(k, v) if x is not None}
            case ast.Subscript(value=v, slice=s):
                return down(v)[down(s)]
            case ast.IfExp(test=t, body=a, orelse=b):
                return down(a) if down(t) else down(b)
            case ast.JoinedStr(values=parts):
                return "".join(_text(down(p)) for p in parts)
            case ast.FormattedValue(value=v, conversion=-1, format_spec=None):
                return down(v)
            case ast.Call(func=ast.Name(id=f), args=[x]) if f in _CALLS:
                return _CALLS[f](down(x))
            case ast.Compare(left=a, ops=[ast.In() | ast.NotIn() as op], comparators=[b]):
                return (down(a) in down(b)) == isinstance(op, ast.In)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                x, y = down(a), down(b)
                if isinstance(x, str) and isinstance(y, str) or isinstance(x, list) and isinstance(y, list):
                    return x + y
                return _arithmetic(ast.Add, x, y)
            case ast.BoolOp(op=op, values=parts):
                return decided(parts, isinstance(op, ast.And), depth)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if isinstance(op, (ast.Eq, ast.NotEq)):
                return same(down(a), down(b)) == isinstance(op, ast.Eq)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _ORDER:
                x, y = _number(down(a)), _number(down(b))
                if x is None or y is None:
                    raise Unknown
                return _ORDER[type(op)](x, y)
            case ast.BinOp(left=a, op=op, right=b):
                return _arithmetic(type(op), down(a), down(b))
        if isinstance(n, (ast.Name, ast.Attribute)) and _dotted(n) in env:
            return env[_dotted(n)]
        return _value(n, _missing, depth)

    def decided(parts: list[ast.AST], both: bool, depth: int):
        """The operand that decides ``and`` or ``or``: a known one settles it whatever the unknown
        others are; without such a one, all must be known and the last is the value."""
        values = []
        for p in parts:
            try:
                v = go(p, depth + 1)
            except (Unknown, TypeError, KeyError, IndexError, ValueError):
                values.append((False, None))
                continue
            if bool(v) != both:
                return v
            values.append((True, v))
        if not all(ok for ok, _ in values):
            raise Unknown
        return values[-1][1]

    def _missing(name: str):
        if name in env:
            return env[name]
        raise Unknown

    try:
        tree = ast.parse((expression or "").strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False, None, []
    try:
        v = go(tree)
        return True, v, strings(v)
    except (Unknown, TypeError, KeyError, IndexError, ValueError, RecursionError, OverflowError):
        maybe: list[str] = []
        if isinstance(tree, ast.IfExp):
            for part in (tree.body, tree.orelse):
                maybe += fold(ast.unparse(part), env)[2]
        return False, None, maybe


def always(expression: str | None) -> bool | None:
    """True or False for an expression that is so with nothing known; None otherwise. A blank one is always true."""
    if not (expression or "").strip():
        return True
    ok, v, _ = fold(expression, {})
    return bool(v) if ok else None


def always_column(expression: Column) -> Column:
    """``always`` of each expression."""

    @F.pandas_udf("boolean")
    def of(expressions: pd.Series) -> pd.Series:
        known = {e: always(e) for e in expressions.dropna().unique()}
        return pd.Series([True if e is None else known[e] for e in expressions], dtype=object)

    return of(expression)



# --- over tables ---------------------------------------------------------------------------


def evaluate_column(expression: Column, flags: Column) -> Column:
    """``flags``: map of names to values. True, false or null."""

    @F.pandas_udf("boolean")
    def of(expressions: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([evaluate(e, dict(m) if m is not None else {}) for e, m in zip(expressions, maps)], dtype="boolean")

    return of(expression, flags)


def evaluate_all(expressions: DataFrame, flags: DataFrame) -> DataFrame:
    """Every distinct expression under every scenario: expression, scenario_id, result.

    ``flags``: scenario_id, flag, value. Scenarios are few and come as one map each.
    """
    maps = flags.groupBy("scenario_id").agg(F.map_from_entries(F.collect_list(F.struct("flag", "value"))).alias("flags"))
    one = expressions.select("expression").where("expression is not null").distinct()
    all_maps = maps.agg(F.collect_list(F.struct("scenario_id", "flags")).alias("all")).withColumn("k", F.lit(1))
    pairs = one.withColumn("k", F.lit(1)).join(F.broadcast(all_maps), "k").select("expression", F.explode("all").alias("s")).select("expression", "s.scenario_id", "s.flags")
    return pairs.select("expression", "scenario_id", evaluate_column(F.col("expression"), F.col("flags")).alias("result"))


def fold_column(expression: Column, env: Column) -> Column:
    """``env``: map of names to JSON values. Struct of ok, value_json and candidates."""

    @F.pandas_udf("struct<ok:boolean,value_json:string,candidates:array<string>>")
    def of(expressions: pd.Series, maps: pd.Series) -> pd.DataFrame:
        rows = []
        for e, m in zip(expressions, maps):
            ok, v, c = fold(e, {k: json.loads(x) for k, x in (dict(m) if m is not None else {}).items() if x is not None})
            rows.append((ok, json.dumps(v) if ok else None, c))
        return pd.DataFrame(rows, columns=["ok", "value_json", "candidates"])

    return of(expression, env)


def branch_state(result: Column, kind: Column) -> Column:
    """normal without a condition; else unreachable, unknown or taken. An else branch carries the
    negation of its expression already."""
    return F.when(kind.isNull(), "normal").when(result.isNull(), "unknown").when(result, "taken").otherwise("unreachable")


def roll_up(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state of many: all unreachable; else any taken; else any unknown; else normal."""
    has = lambda s: F.max((F.col("state") == s).cast("int")) == 1
    return states.groupBy(*keys).agg(
        F.when(F.min((F.col("state") == "unreachable").cast("int")) == 1, "unreachable").when(has("taken"), "taken").when(has("unknown"), "unknown").otherwise("normal").alias("state")
    )


def combine(results: DataFrame, keys: list[str], how: str = "and") -> DataFrame:
    """Kleene AND or OR of ``result`` (null: unknown) by key."""
    decisive = how == "or"
    hit = F.max((F.col("result") == F.lit(decisive)).cast("int")) == 1
    unknown = F.count_if(F.col("result").isNull()) > 0
    return results.groupBy(*keys).agg(F.when(hit, F.lit(decisive)).when(~unknown, F.lit(not decisive)).alias("result"))


def counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Taken, unreachable and unknown conditions."""
    r = F.col("result")
    return results.groupBy(*keys).agg(F.count_if(r).alias("taken"), F.count_if(~r).alias("unreachable"), F.count_if(r.isNull()).alias("unknown"))


def flags_in(flags: Column, refs: Column) -> Column:
    """The part of a flag map that an expression refers to."""
    return F.map_filter(flags, lambda k, _: F.array_contains(refs, k))


def all_known(flags: Column, refs: Column) -> Column:
    return F.forall(refs, lambda r: F.coalesce(F.element_at(flags, r) != "unknown", F.lit(False)))


def all_true(flags: Column, refs: Column) -> Column:
    return F.forall(refs, lambda r: F.coalesce(F.element_at(flags, r) == "true", F.lit(False)))
