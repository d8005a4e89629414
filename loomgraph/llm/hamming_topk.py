"""Exact top-k by Hamming distance over binary codes: incremental multi-index hashing.

Codes are split into segments, each an index of its own. If every segment was searched to
radius r, each code within ``segments * (r + 1) - 1`` bits of a query was met, since a code
further off in every segment is further off in all. The radius grows until each query's k-th
verified distance lies within what is covered; a query that is done leaves the search. Codes
beyond a query's k-th distance so far are dropped by the join that meets them.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._util import cut

K = 10
BITS = 64
#: Query ids are divisible by this.
EVERY = 100


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i of the code is set where component i (from 0) is positive; null without components."""
    head = F.slice(vector, 1, bits)
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(vector) > 0, F.aggregate(F.transform(head, bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def segments_for(n: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of each segment; log2(n) bits each at most, so that few keys need probing."""
    m = max(2, min(bits, math.ceil(bits / max(2.0, math.log2(max(2, n))))))
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys(code: Column, segments: list[tuple[int, int]]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("s"), F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("key"))
        for i, (shift, width) in enumerate(segments)
    ])


def _ring(width: int, radius: int) -> Column:
    """All values of ``width`` bits with ``radius`` bits set, as one literal array."""
    flips = (sum(1 << b for b in c) for c in combinations(range(width), radius))
    return F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")


def search(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """The k nearest rows of each query: query_id, id, distance, rank (by distance, then id).

    ``codes`` and ``queries``: ``id`` and ``code`` (long of ``bits`` bits). Rows without an id or
    code are left out; of repeated ids each distinct code counts. A query doesn't find its own
    id. Fewer than k other rows: all of them. Copies of a code are one entry of the index, of
    which the k + 1 least ids are kept, more than any answer needs.
    """
    codes = codes.where("id is not null and code is not null").select("id", "code").distinct()
    by_id = Window.partitionBy("code").orderBy("id")
    owners = cut(codes.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    segments = segments_for(owners.count(), bits)
    index = cut(owners.select("code", F.explode(_keys(F.col("code"), segments)).alias("x")).select("x.s", "x.key", "code"))
    asked = cut(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q"), F.lit(bits).alias("bound")).distinct())
    found = None
    active, radius = asked, 0
    order = Window.partitionBy("query_id", "q").orderBy("distance", "id")
    while not active.isEmpty() and radius <= max(w for _, w in segments):
        probes = _probes(active, segments, radius)
        # what can't be among the k nearest any more is no match of the join; probes are many more
        # than their queries lead the optimizer to expect, so that it mustn't broadcast them
        held = index.select(F.col("s").alias("s2"), F.col("key").alias("key2"), "code")
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        near = (F.col("s") == F.col("s2")) & (F.col("key") == F.col("key2")) & (distance <= F.col("bound"))
        met = probes.hint("merge").join(held, near).select("q", "code", distance.alias("distance")).distinct()
        rows = active.select("query_id", "q").join(met, "q").join(owners, "code").select("query_id", "q", "distance", F.explode("ids").alias("id")).where("id <> query_id")
        if found is not None:
            rows = rows.unionAll(found.join(active, ["query_id", "q"], "left_semi").select("query_id", "q", "distance", "id"))
        best = rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        settled = found.join(active, ["query_id", "q"], "left_anti") if found is not None else None
        best = best.select("query_id", "q", "distance", "id", "rank")
        found = cut(best if settled is None else settled.select("query_id", "q", "distance", "id", "rank").unionAll(best))
        covered = len(segments) * (radius + 1) - 1
        done = found.groupBy("query_id", "q").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where((F.col("n") >= k) & (F.col("kth") <= covered))
        kth = found.where(F.col("rank") == k).select("query_id", "q", F.col("distance").alias("kth"))
        rest = active.join(done, ["query_id", "q"], "left_anti").join(kth, ["query_id", "q"], "left")
        active = cut(rest.select("query_id", "q", F.coalesce("kth", "bound").cast("int").alias("bound")))
        radius += 1
    if found is None:
        return asked.select("query_id", F.col("query_id").alias("id"), F.lit(0).alias("distance"), F.lit(0).alias("rank"))
    return found.select("query_id", "id", F.col("distance").cast("int").alias("distance"), "rank")


def _probes(active: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """The keys at exactly ``radius`` bits from each query's, in every segment so wide."""
    one = active.groupBy("q").agg(F.max("bound").alias("bound"))  # queries may share a code
    own = one.select("q", "bound", F.explode(_keys(F.col("q"), segments)).alias("x")).select("q", "bound", "x.s", F.col("x.key").alias("own"))
    rings = F.lit(None).cast("array<bigint>")
    for width in {w for _, w in segments if w >= radius}:
        wide = F.col("s").isin([i for i, (_, w) in enumerate(segments) if w == width])
        rings = F.when(wide, _ring(width, radius)).otherwise(rings)
    return own.select("q", "bound", "s", F.explode(F.transform(rings, lambda f: f.bitwiseXOR(F.col("own")))).alias("key"))


def of_vectors(vectors: DataFrame, k: int = K, every: int = EVERY, **options) -> DataFrame:
    """Top k of the sign codes of ``embedding``, for every row whose ``vec_id`` divides by ``every``."""
    codes = cut(vectors.select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding")).alias("code")))
    return search(codes, codes.where(F.col("id") % every == 0), k, **options)


#: DuckDB: all rows against the query rows.
ORACLE_SQL = f"""
WITH codes AS (
  SELECT vec_id AS id, list_transform(embedding[1:{BITS}], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE len(embedding) > 0
), pairs AS (
  SELECT q.id AS query_id, c.id, CAST(list_sum(list_transform(range(1, {BITS} + 1), lambda i: CASE WHEN q.bits[i] <> c.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.id <> c.id WHERE q.id % {EVERY} = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, id, distance, rank FROM ranked WHERE rank <= {K}
"""
