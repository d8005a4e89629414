"""The pipeline: each stage on what its predecessor kept, on real tables and on awkward rows."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import quality, simhash
from loomgraph.llm import text_features as tf
from loomgraph.llm._util import cut

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = cut(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        kept[name] = docs
    low = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0")
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    assert kept["quality"].join(low, "doc_id", "left_semi").count() <= 0.2 * low.count()
    assert kept["quality"].join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()
    assert kept["line_dedup"].count() == kept["quality"].count() and kept["line_dedup"].where("n_chars <> length(text)").count() == 0
    assert kept["simhash"].select("doc_id").distinct().count() == kept["simhash"].count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    whole = pieces.agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("all"), F.count_if(F.col("start") == 0).alias("docs")).first()
    assert whole.n == whole.all and whole.docs == docs.count()


CLASHES = ("label", "tail", "expected_grade", "n_lines", "n_removed", "_nth", "_kept", "_text_hash", "h", "copies", "members", "fp", "component", "size", "bucket", "a.b")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(f"{c}{n}" for c in CLASHES)) for n, (i, t, s) in enumerate(rows)], SCHEMA)


def _prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice([f"w{k}" for k in range(300)], n))


def _rows():
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "one", "b"), (None, _prose(1, 60), "a"), (None, _prose(2, 60), "a"), (4, "one", "a"), (4, "one", "a"), (5, _prose(3, 70), "a"), (5, _prose(4, 70), None)]
    rows += [(10 + k, _prose(5, 80), "a") for k in range(4)] + [(20, "x" * 30_000, "b"), (21, _prose(6, 9_000), "b")]
    return rows + [(30 + k, f"{_prose(7 + k, 12)}\nshared line one\nshared line two\nshared line three\nshared line four\n{_prose(40 + k, 12)}", "c") for k in range(6)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labels that set rows of one shape of words apart, some of them null or repeated."""
    path = tmp_path_factory.mktemp("tables")
    labels = [(i, int(i % 2 == 0), 0) for i in range(1, 40)] + [(5, 1, 1), (None, 1, 0), (6, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def _key(rows):
    return sorted((tuple((x is None, x) for x in r) for r in rows), key=str)


def test_quality_stage_on_awkward_rows(spark, sf_dir):
    """The kept rows are those whose score, worked out row by row, has a tail of one half."""
    docs = _table(spark, _rows())
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    want = []
    for r in docs.collect():
        s = sum(weights.get(f, 0.0) for f in tf.features(r.text))
        if not len(model.thresholds) or 1 / (1 + np.exp(model.thresholds[0] - s)) >= 0.5:
            want.append(tuple(r))
    got = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns and _key(map(tuple, got.collect())) == _key(want)
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), sf_dir).count() == 0


def test_line_dedup_stage_on_awkward_rows(spark, sf_dir):
    docs = _table(spark, _rows())
    got = corpus_pipeline.line_dedup_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns and got.count() == docs.count()
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rest = [f"`{c}`" for c in rest]
    assert _key(map(tuple, got.select(*rest).collect())) == _key(map(tuple, docs.select(*rest).collect()))
    assert got.where("n_chars <> coalesce(length(text), 0)").where("text is not null").count() == 0
    assert sum(r.text.count("shared line two") for r in got.collect() if r.text) < 6
    assert corpus_pipeline.line_dedup_stage(spark, docs.limit(0), sf_dir).count() == 0


def _jaccard(a, b, k=5):
    def sets(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {()}

    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def test_simhash_stage_on_awkward_rows(spark, sf_dir):
    """Against brute force: of each component of similar texts the row of least doc_id stays."""
    docs = _table(spark, _rows())
    rows = docs.collect()
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for x in range(len(rows)):
        for y in range(x):
            if _jaccard(rows[x].text, rows[y].text) >= 0.8:
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x, r in enumerate(rows):
        groups[find(x)].append(r)
    got = corpus_pipeline.simhash_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(groups)
    least = [min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values()]
    assert sorted((k[0] is None, k[0] or 0) for k in kept) == sorted(least)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
    assert corpus_pipeline.simhash_stage(spark, docs.limit(0), sf_dir).count() == 0


def test_mixing_and_packing_stages_on_awkward_rows(spark, sf_dir):
    docs = _table(spark, _rows())
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    rows, taken = {tuple(r) for r in docs.collect()}, defaultdict(int)
    for r in mixed.collect():
        assert tuple(r) in rows
        taken[tuple(r)] += 1
    assert taken and max(taken.values()) <= 3 * max(1, simhash.SHINGLE)
    assert _key(map(tuple, mixed.collect())) == _key(map(tuple, corpus_pipeline.mixing_stage(spark, docs.repartition(3), sf_dir).collect()))
    pieces = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    assert pieces.where("start = 0").count() == docs.count()
    for f in (corpus_pipeline.mixing_stage, corpus_pipeline.packing_stage):
        assert f(spark, docs.limit(0), sf_dir).count() == 0
