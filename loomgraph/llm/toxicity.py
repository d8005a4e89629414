"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the distinct words of a text. For every labelled text that names a
group, a second text swaps each identity term for another of its kind, and the training loss
penalises the square of the change in score. Mentions of a group then carry no score of
their own, while the words around them still do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text_features as tf
from loomgraph.llm._util import arrow_batches

CUT = 0.7
L2 = 0.2
SWAP = 10.0
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("mexican", "chinese", "american", "indian", "german", "french", "spanish"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)


def swaps() -> dict[int, int]:
    """Word hash of each identity term to that of the next of its kind."""
    h = lambda w: tf._hash("w", w)
    return {h(a): h(b) for kind in IDENTITY for a, b in zip(kind, (*kind[1:], kind[0]))}


@dataclass(frozen=True)
class ToxicModel:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def fit_sample(rows: list[np.ndarray], labels: np.ndarray, l2: float = L2, swap: float = SWAP) -> ToxicModel:
    """Logistic loss + l2 |w|^2 / 2 + swap * sum over counterfactual pairs of (change in score)^2."""
    if not len(labels) or labels.min() == labels.max():
        p = float(labels.mean()) if len(labels) else 0.0
        return ToxicModel(np.zeros(0, dtype=np.int64), np.zeros(0), 4.0 if p == 1 else -4.0)
    x = tf.Sparse(rows)
    place = {h: i for i, h in enumerate(x.hashes.tolist())}
    to, changes = swaps(), []
    for r in rows:
        change: dict[int, float] = {}
        have = set(r.tolist())
        for f in have & to.keys():
            for g, sign in ((f, 1.0), (to[f], -1.0)):
                if g in place:
                    change[place[g]] = change.get(place[g], 0.0) + sign
        if change:
            changes.append(change)
    pair = np.array([i for i, c in enumerate(changes) for _ in c], dtype=np.int64)
    col = np.array([k for c in changes for k in c], dtype=np.int64)
    sign = np.array([v for c in changes for v in c.values()], dtype=float)
    m, y = len(x.hashes), labels.astype(float)
    bias0 = float(np.log(y.mean() / (1 - y.mean())))
    scale = tf.contrast(x, labels > 0)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w = scale * p[:m]
        s = np.clip(x.times(w) + p[m], -40, 40)
        prob = 1 / (1 + np.exp(-s))
        value = float(np.logaddexp(0, s).sum() - (y * s).sum() + 0.5 * l2 * (p[:m] @ p[:m]))
        g = x.back(prob - y)
        if len(pair):
            d = np.bincount(pair, weights=sign * w[col], minlength=len(changes))
            value += swap * float(d @ d)
            g = g + 2 * swap * np.bincount(col, weights=sign * d[pair], minlength=m)
        return value, np.append(scale * g + l2 * p[:m], (prob - y).sum())

    p = tf.lbfgs(loss, np.append(np.zeros(m), bias0))
    return ToxicModel(x.hashes, scale * p[:m], float(p[m]))


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 3 is 1: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = tf.SAMPLE) -> ToxicModel:
    """Fits on at most ``limit`` labelled rows that aren't held out, those of least id hash.

    Repeated labels of a document count as toxic if one is.
    """
    arrow_batches(docs.sparkSession)
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    known = labels.where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    got = tf.bounded_sample(docs, known, limit, True, False)
    return fit_sample([np.frombuffer(b, dtype="<u4").astype(np.int64) for b in got["features"]], got["label"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: ToxicModel, text: str = "text", doc_id: str = "doc_id", cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (0 or 1).

    The score depends on the text alone; null and empty texts get that of a text without
    words. A null doc_id isn't held out. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))  # SAMPLE bounds it
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        hashes, weights, bias = shared.value
        s = tf.scores(name, hashes, weights, texts, True, False) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(s, -40, 40))))

    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), of(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
