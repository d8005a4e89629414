"""Queries against their SQL over the smallest tables, and the registry."""

import math
import os

import duckdb
import pytest

import loomgraph.queries as registry

registry.load()
DATA = os.environ.get("LOOM_DATA", "/root/testdata/sf0.001")
#: A part of the queries keeps the suite short; the rest run in bench and by hand.
SOME = ("a2_chapter_aggregates", "a3_chapter_pacing", "g3_ending_reachability", "u2_graph_integrity", "j11_missing_assets", "f1_text_stats", "f7_eval_condition", "x3_extract_say_lines", "w1_shadow_labels", "j13_unused_variables", "q4_scan_translations", "r1_incremental_ingest")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def _key(rows, columns):
    def cell(v):
        return "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda df: df.astype(object).where(df.notna(), None).to_dict("records")
    assert _key(as_rows(got), columns) == _key(as_rows(want), columns)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(registry.QUERIES) > 100


def test_search_without_limit(spark):
    from loomgraph.operators import search

    docs = spark.range(2100).selectExpr("'p' AS project_id", "concat('n', id) AS doc_id", "'a widget' AS label", "'' AS line")
    asked = spark.createDataFrame([("q", "widget")], "query_id string, query string")
    assert search.search(docs, asked, limit=None).count() == 2100
    assert search.search(docs, asked, limit=7).count() == 7 and search.search(docs, asked).count() == search.DEFAULT


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_terms_of_query_words_against_brute_force(spark):
    import random

    from loomgraph.operators import search

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 13)))
    vocabulary = sorted({word() for _ in range(1500)})
    asked = {f"q{i}": {word() for _ in range(3)} for i in range(12)}
    got = search.expand(spark.createDataFrame([(t,) for t in vocabulary], "term string"), spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in asked.items()], "query_id string, query string")).collect()
    want = {(k, q, t) for k, v in asked.items() for q in v for t in vocabulary if t.startswith(q) or _edits(t, q) <= int(len(q) * search.FUZZY + 0.5)}
    assert len(got) == len(want) and {(r.query_id, r.q, r.term) for r in got} == want
