"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds turn a text's score
into P(grade > k) = sigmoid(score - threshold_k), so that the expected grade is the sum of
these, and P(grade >= g) selects documents.
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

#: A document stays if P(grade >= LEAST_GRADE) is at least this.
SELECT = 0.5
LEAST_GRADE = 1
L2 = 1.0


@dataclass(frozen=True)
class OrdinalModel:
    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # increasing, one less than there are grades


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_sample(rows: list[np.ndarray], grades: np.ndarray, l2: float = L2) -> OrdinalModel:
    """Maximum likelihood of y in 0..K-1 with P(y > k) = sigmoid(x.w - t_k), t increasing."""
    x, k = tf.Sparse(rows), int(grades.max(initial=0)) + 1
    if k < 2 or not len(grades):
        return OrdinalModel(x.hashes, np.zeros(len(x.hashes)), np.zeros(0))
    m = len(x.hashes)
    shares = np.array([(grades > j).mean() for j in range(k - 1)]).clip(1e-3, 1 - 1e-3)
    t0 = np.log((1 - shares) / shares)
    scale = np.max([tf.contrast(x, grades > j) for j in range(k - 1)], axis=0)
    start = np.concatenate((np.zeros(m), t0[:1], np.log(np.maximum(np.diff(t0), 1e-2))))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((p[m : m + 1], np.exp(p[m + 1 :]))))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = p[:m], thresholds(p)
        edge = np.concatenate(([-40.0], t, [40.0]))
        score = x.times(scale * w)
        low, high = edge[grades], edge[grades + 1]
        a, b = _sigmoid(score - low), _sigmoid(score - high)
        prob = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        ds = -(da - db) / prob
        g_low, g_high = da / prob, -db / prob
        gt = np.array([g_low[grades == j + 1].sum() + g_high[grades == j].sum() for j in range(k - 1)])
        tail = np.cumsum(gt[::-1])[::-1]
        gp = np.concatenate((tail[:1], tail[1:] * np.exp(p[m + 1 :])))
        return float(-np.log(prob).sum() + 0.5 * l2 * (w @ w)), np.concatenate((scale * x.back(ds) + l2 * w, gp))

    p = tf.lbfgs(loss, start)
    return OrdinalModel(x.hashes, scale * p[:m], thresholds(p))


def fit(docs: DataFrame, grades: DataFrame, limit: int = tf.SAMPLE) -> OrdinalModel:
    """Fits on about ``limit`` documents that have a grade (``doc_id``, ``label``), those of least id hash.

    Null texts count as empty ones; rows without an id aren't learned from. Without a graded
    document, or with one grade only, the model gives every text the same score.
    """
    arrow_batches(docs.sparkSession)
    got = tf.bounded_sample(docs, grades, limit, True, True)
    return fit_sample([np.frombuffer(b, dtype="<u4").astype(np.int64) for b in got["features"]], got["label"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", least_grade: int = LEAST_GRADE) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail``, P(grade >= least_grade).

    Null and empty texts get the score of a text without words. A model that saw no two
    grades has tail 1 for every text. All rows stay, repeated ones too, and all columns but
    those of these two names, which are replaced. An empty table gives an empty result.
    """
    return _scored(docs, model, text, least_grade).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("expected_grade", "tail")], "__scored.expected_grade", "__scored.tail")


def _scored(docs: DataFrame, model: OrdinalModel, text: str, least_grade: int) -> DataFrame:
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.thresholds))  # SAMPLE bounds it
    name = uuid.uuid4().hex

    @F.pandas_udf("struct<expected_grade:double,tail:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        hashes, weights, thresholds = shared.value
        s = tf.scores(name, hashes, weights, texts, True, True).reshape(-1, 1)
        above = _sigmoid(s - thresholds) if len(thresholds) else np.ones((len(s), 1))
        tail = above[:, min(least_grade, above.shape[1]) - 1] if least_grade > 0 else np.ones(len(s))
        return pd.DataFrame({"expected_grade": above.sum(axis=1), "tail": tail})

    return docs.withColumn("__scored", of(F.col(text)))


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``label``: 0 for low quality, 1 for good prose that is toxic, 2 for good
    prose. Rows without a doc_id or quality don't count; repeated labels by their least grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("label"))


def select(docs: DataFrame, model: OrdinalModel, text: str = "text", least: float = SELECT, least_grade: int = LEAST_GRADE) -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``least``, with their columns as they are.

    Null and empty texts count as texts without words; repeated rows stay or go together.
    """
    return _scored(docs, model, text, least_grade).where(F.col("__scored.tail") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
