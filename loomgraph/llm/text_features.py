"""Hashed features of whole texts, and linear scores over them.

A text's features are the distinct words it has (lower-cased, outer punctuation cut), how
much of it is made of each shape of word (letters, capitals, digits, trailing signs), and
how often words repeat. All are hashed; a model keeps weights for the hashes it has learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remembered words per worker; further ones are worked out each time.
REMEMBERED = 400_000
#: Labelled rows that a model is fitted on at most, those of least hash.
SAMPLE = 10_000
#: A feature is learned if so many rows of the sample have it.
LEAST_ROWS = 4

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")


def _hash(kind: str, value: str) -> int:
    return crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass"))


def shape(token: str) -> str:
    """Runs of small letters, capitals and digits become a, A and 0; other signs stay."""
    if token.isupper() and len(token) > 1:
        token = token.upper()
        s = re.sub(r"[^\W\d_]+", "AA", token)
    else:
        s = _LOWER.sub("a", _UPPER.sub("A", token))
    return _DIGIT.sub("0", s)[:12]


_KNOWN: dict[str, tuple[int, str]] = {}


def _token(token: str) -> tuple[int, str]:
    got = _KNOWN.get(token)
    if got is None:
        got = (_hash("w", _OUTER.sub("", token).lower()), shape(token))
        if len(_KNOWN) < REMEMBERED:
            _KNOWN[token] = got
    return got


def _share(x: float) -> int:
    """Steps of doubling: 0 for none, 8 for all."""
    return 0 if x <= 0 else max(1, 8 + int(np.log2(x)))


def features(text: str | None, words: bool = True, shapes: bool = True) -> list[int]:
    """Distinct feature hashes (unsigned 32 bits). Every word of the text counts."""
    tokens = (text or "").split()
    if not shapes:
        return sorted({_token(t)[0] for t in set(tokens)})
    counts = Counter(tokens)
    found: set[int] = set()
    by_shape: Counter[str] = Counter()
    for t, n in counts.items():
        w, s = _token(t)
        if words:
            found.add(w)
        by_shape[s] += n
    total = max(1, len(tokens))
    for s, n in by_shape.items():
        found.add(_hash("s", f"{s}:{_share(n / total)}"))
    runs = sum(a == b for a, b in zip(tokens, tokens[1:]))
    found.add(_hash("run", str(_share(runs / total))))
    found.add(_hash("kinds", str(_share(len(counts) / total))))
    found.add(_hash("length", str(len(tokens).bit_length())))
    return sorted(found)


class Sparse:
    """A bounded sample in rows of feature positions; products are numpy gathers and sums."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        kinds, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
        ok = seen >= LEAST_ROWS
        self.hashes = kinds[ok]
        new = np.cumsum(ok) - 1
        row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        held = ok[at]
        self.col, self.row = new[at][held], row[held]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=len(self.hashes))


def contrast(x: Sparse, high: np.ndarray) -> np.ndarray:
    """How much likelier each feature is in one class than in the other, as a log ratio. Features
    scaled by it hold down words that merely happen to be in a few texts."""
    y = high.astype(float)
    return np.abs(np.log((x.back(y) + 1) / (y.sum() + 2)) - np.log((x.back(1 - y) + 1) / ((1 - y).sum() + 2)))


def lbfgs(loss, x: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Minimises ``loss(x) -> (value, gradient)`` with limited-memory BFGS and backtracking."""
    value, grad = loss(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list)):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0 if s_list else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12)), -(grad @ q)
        for _ in range(25):
            new = x - step * q
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def bounded_sample(docs: DataFrame, labels: DataFrame, limit: int, words: bool, shapes: bool) -> pd.DataFrame:
    """Features and label of about ``limit`` labelled documents, those of least id hash.

    ``labels``: distinct ``doc_id``, and ``label``. The texts stay in Spark; what is broadcast
    and what comes back is bounded by ``limit`` (a document's features by its distinct words).
    Null texts have the features of empty ones; documents without an id aren't chosen, repeated
    ids all are; other columns are ignored. Rows come in an order that doesn't depend on files.
    """

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t, words, shapes), dtype="<u4").tobytes() for t in texts], dtype=object)

    steps = 1 << 24
    below = int(steps * min(1.0, limit / max(1, labels.count())))
    part = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < below).select(F.col("doc_id").alias("__label_id"), F.col("label").alias("__label"))
    slim = docs.select(F.col("doc_id").alias("__doc_id"), F.col("text").alias("__text"))
    chosen = slim.join(F.broadcast(part), F.col("__doc_id") == F.col("__label_id"))
    got = chosen.select(F.col("__label").alias("label"), F.xxhash64("__doc_id").alias("h"), of("__text").alias("features")).toPandas()
    # in an order of their own, so that sums in floating point don't depend on how rows are dealt
    return got.sort_values(["h", "features", "label"], kind="stable", ignore_index=True)


_TABLES: dict[str, dict[int, float]] = {}


def scores(model: str, hashes: np.ndarray, weights: np.ndarray, texts: Iterable[str | None], words: bool, shapes: bool) -> np.ndarray:
    """Sums of the weights of each text's features; those never learned weigh nothing.

    ``model`` names the weights, whose table a worker keeps from batch to batch.
    """
    if model not in _TABLES:
        _TABLES.clear()
        _TABLES[model] = dict(zip(hashes.tolist(), weights.tolist()))
    get = _TABLES[model].get
    return np.array([sum(get(f, 0.0) for f in features(t, words, shapes)) for t in texts], dtype=float)
