"""Source divergence audit: how the terms of each source differ from those of its language's other
sources, and which terms it has more of than its language.

Distances between all sources of a language come from Gustavson's row accumulation. The index of a
language is term-major: a term's postings are the sources that hold it. A source's terms are
scattered through it into a dense accumulator with a place for each peer, so that no pair of postings
leaves a task. What neither source or only one of them holds is not in the index: it has the
probability of a count of zero, the *baseline* of its source, and is put right in sums over each
source's sorted values. For sources g and s with baselines b, the distance over V kept terms is

    sum over g's terms of |p_g - b_s|  +  sum over s's terms of |b_g - p_s|
    + sum over common terms of |p_g - p_s| - |p_g - b_s| - |b_g - p_s|
    + (V - g's terms - s's terms + common terms) * |b_g - b_s|

A task holds a tile: the postings of at most 2 * SIDE sources for a share of the terms, some POSTINGS rows or, if that is
more, as many as the tile has pairs. Tiles give one row for each pair of their sources, which are summed; there are no more of these rows than postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._util import arrow_batches, cut
from loomgraph.llm.lexical import pieces, text_bytes

#: Over UTF-8 bytes; those of signs beyond ASCII are all parts of terms.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP = 50
#: Sources of a side of a tile, and postings of a tile at least.
SIDE, POSTINGS = 1024, 50_000
#: Different (lang, source, term) that a task holds before it passes them on.
HELD = 500_000

_POSTING = "lang string, source string, term string, n long, docs long"


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): tasks count what they can hold
    before the rows are shuffled. Nulls are ''."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (of_lang, of_source), (n, n_docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                numbers = [pa.array([c[t] for t in some], pa.int64()) for c in (n, n_docs)]
                names = [pa.array([x] * len(some), pa.string()) for x in (of_lang, of_source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(some, pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "n", "docs"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for of_lang, of_source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                n, n_docs = held.setdefault((of_lang, of_source), (Counter(), Counter()))
                before, own = len(n), set()
                for piece in pieces(text, TERM):
                    n.update(piece)
                    own.update(piece)
                n_docs.update(own)
                size += len(n) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    counted = docs.select(*columns).mapInArrow(of, _POSTING)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kinds: str):
    """p of a count, in 64-bit integers."""
    return F.expr(f"1 + ({SCALE}L * ({n} + {PRIOR})) div ({total} + {PRIOR} * {kinds})")


def _tile(key: tuple, rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """The sums of a tile for every pair of a source of its rows and another one of its columns.

    ``rows``: ``at`` (number of the source in its language), ``base``, and ``term`` and ``p``, which are null
    in the one row by which each source is named. Tiles are ``width`` sources wide and high.
    """
    side, across = key[1], key[2]
    named = rows[rows["term"].isna()].sort_values("at")
    held = rows[rows["term"].notna()]
    at, base = named["at"].to_numpy(), named["base"].to_numpy(np.int64)
    is_row, is_column = at // width == side, at // width == across
    place = {a: i for i, a in enumerate(at.tolist())}
    source = held["at"].map(place).to_numpy(np.int64)
    p = held["p"].to_numpy(np.int64)
    term = pd.factorize(held["term"])[0]
    columns = np.flatnonzero(is_column)
    column_of = np.full(len(at), -1)
    column_of[columns] = np.arange(len(columns))

    # the term-major index: postings of the tile's columns by term
    of_column = np.flatnonzero(column_of[source] >= 0)
    of_column = of_column[np.argsort(term[of_column], kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(term[of_column], minlength=term.max(initial=-1) + 1))])
    peer, peer_p = column_of[source[of_column]], p[of_column]
    by_source = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[by_source], np.arange(len(at) + 1))
    own_of = [by_source[edges[i] : edges[i + 1]] for i in range(len(at))]

    def distances(values: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The sum of |value - point| for each point, by prefix sums over the sorted values."""
        values = np.sort(values)
        sums = np.concatenate([[0], np.cumsum(values)])
        below = np.searchsorted(values, points)
        return points * below - sums[below] + (sums[-1] - sums[below]) - points * (len(values) - below)

    rows_at = np.flatnonzero(is_row)
    peers = {int(c): distances(p[own_of[c]], base[rows_at]) for c in columns}
    value = np.array([peers[int(c)] for c in columns], dtype=np.int64).reshape(len(columns), len(rows_at))
    out = []
    for i, g in enumerate(rows_at):
        own = own_of[g]
        first, last = starts[term[own]], starts[term[own] + 1]
        n = last - first
        # places in the index of all postings of the row's terms
        flat = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else np.zeros(0, dtype=np.int64)
        to, p_g, p_s = peer[flat], np.repeat(p[own], n), peer_p[flat]
        both = np.abs(p_g - p_s) - np.abs(p_g - base[columns][to]) - np.abs(base[g] - p_s)
        accumulator = np.zeros(len(columns), dtype=np.int64)
        np.add.at(accumulator, to, both)
        common = np.bincount(to, minlength=len(columns))
        accumulator += distances(p[own], base[columns]) + value[:, i]
        other = columns != g
        out.append(pd.DataFrame({"lang": key[0], "a": at[g], "b": at[columns][other], "value": accumulator[other], "common": common[other]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "a": [], "b": [], "value": [], "common": []})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", side: int = SIDE, share: int = POSTINGS) -> DataFrame:
    """lang, source, part, item, value, rank: for every group (lang, source) that occurs, its distance from
    each other source of its language (``pair``, greatest first) and the ``top`` terms it has more of than
    the language (``term``).

    Nulls in ``text``, ``lang`` and ``source`` are ''. Every row counts, repeated ones too. A language
    without a term in ``least_docs`` rows has distances of 0 and no terms; one of a single source has no
    pairs. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    counts = cut(postings(docs, text, lang, source))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = cut(of_lang.select("lang", "term", "lang_n"))
    held = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = held.groupBy("lang", "source").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    names = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    groups = names.join(sizes, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0)
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = cut(groups.withColumn("base", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(0)))

    p = held.join(groups.select("lang", "source", "total", "v", "lang_total", "at", "base"), ["lang", "source"])
    p = p.withColumn("p", _share("n", "total", "v")).withColumn("q", _share("lang_n", "lang_total", "v"))
    more = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    far = _pairs(p.select("lang", "at", "base", "term", "p"), groups, side, share).withColumn("rank", F.row_number().over(order))
    return far.unionByName(more)


def _pairs(p: DataFrame, groups: DataFrame, width: int, share: int) -> DataFrame:
    """All ordered pairs of a language's sources: lang, source, part, item, value."""
    # the terms of a tile are dealt out to several groups, so that each has some ``share`` rows, and no fewer than pairs
    plan = groups.groupBy("lang").agg(F.ceil(F.count("*") / width).alias("sides"), F.sum("kinds").alias("size"), F.greatest(F.lit(share), F.pow(F.least(F.count("*"), F.lit(width)), 2)).alias("share"))
    plan = plan.select("lang", "sides", F.greatest(F.lit(1), F.ceil(F.col("size") * F.least(F.lit(2), "sides") / F.col("sides") / F.col("share"))).cast("int").alias("shares"))
    side, others = F.floor(F.col("at") / width).cast("int"), F.sequence(F.lit(0), F.col("sides").cast("int") - 1)
    # a source is in the row of tiles of its side, and in the column
    tiles = F.array_distinct(F.concat(F.transform(others, lambda o: F.struct(side.alias("i"), o.alias("j"))), F.transform(others, lambda o: F.struct(o.alias("i"), side.alias("j")))))
    in_tile = ["lang", "tile.i", "tile.j", "share", "at", "base", "term", "p"]
    postings_ = p.join(plan, "lang").withColumn("share", F.pmod(F.xxhash64("term"), "shares").cast("int")).withColumn("tile", F.explode(tiles)).select(*in_tile)
    named = groups.join(plan, "lang").withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")})
    named = named.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("tile", F.explode(tiles)).select(*in_tile)
    sums = postings_.unionByName(named).groupBy("lang", "i", "j", "share").applyInPandas(lambda key, rows: _tile(key, rows, width), "lang string, a int, b int, value long, common long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("common").alias("common"))
    a = groups.select("lang", F.col("at").alias("a"), "source", F.col("base").alias("base_a"), F.col("kinds").alias("kinds_a"), "v")
    b = groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"), F.col("base").alias("base_b"), F.col("kinds").alias("kinds_b"))
    neither = F.col("v") - F.col("kinds_a") - F.col("kinds_b") + F.col("common")
    value = F.col("value") + neither * F.abs(F.col("base_a") - F.col("base_b"))
    return sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))


#: DuckDB: the sums over all kept terms of each pair, over the table ``documents``.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), words AS (
  SELECT r, lang, source, unnest(words) AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, CAST(count(*) AS BIGINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counted c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), far AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), more AS (
  SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM far
UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM more WHERE rank <= 50
"""
