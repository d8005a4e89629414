"""Line dedup by content-defined chunks of lines, with DataFrame operations only.

A rolling hash over the hashes of two neighbouring lines is taken at every line; a chunk ends
where it is least among its neighbours. Boundaries so depend on the lines around them alone
(an inserted line moves no boundary further away), and two never touch, so that chunks have
two lines or more. Chunks of several lines that occur again anywhere, byte for byte, stay at
their first place only, by (doc_id, chunk number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._util import cut

LEAST_LINES = 2


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, however often it is used: a generator of
    one row keeps the optimizer from copying the expression into its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``__key`` (identity of a document: its id and text), ``__id``, ``__lines``, ``__hashes`` and
    ``__bounds`` (array of first line, 1-based, and number of lines), beside all columns of ``docs``."""
    d = docs.select("*", F.col(doc_id).cast("long").alias("__id"), F.xxhash64(F.lit(1), doc_id, text).alias("__key"))
    d = _once(d, "__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    d = _once(d, "__hashes", F.transform("__lines", lambda x: F.md5(x)))
    hashes, n = F.col("__hashes"), F.size("__hashes")
    d = _once(d, "__rolling", F.zip_with(F.concat(F.array(F.lit("")), F.slice(hashes, 1, n - 1)), hashes, lambda a, b: F.md5(F.concat(a, b))))
    r = F.col("__rolling")
    before = F.concat(F.array(F.lit("")), F.slice(r, 1, n - 1))
    after = F.concat(F.slice(r, 2, n), F.array(F.lit("")))
    low = F.zip_with(F.zip_with(r, before, lambda a, b: F.when(a < b, a)), after, lambda a, b: a < b)
    ends = F.filter(F.transform(low, lambda x, i: F.when(x, i + 1)), lambda x: x.isNotNull())
    d = _once(d, "__ends", F.concat(ends, F.array(n)))
    ends = F.col("__ends")
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return _once(d, "__bounds", F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("at"), (b - a).alias("n")))).drop("__rolling", "__ends")


def _text(at: Column, n: Column) -> Column:
    return F.array_join(F.slice("__lines", at, n), "\n")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` cut to its kept chunks, and (with ``counts``) ``n_lines`` and ``n_removed``.

    A null text stays null with no lines; an empty one has one empty line. Rows that repeat
    doc_id and text are one document and lose the same chunks; of rows without a doc_id, which
    come first, those that tie keep theirs. A document whose chunks are all copies keeps its
    row with an empty text. Other columns of ``docs`` keep their values, but for columns of the
    counts' names, which the counts replace. An empty table gives an empty result.
    """
    parts = chunks(docs.select(F.col(doc_id), F.col(text)), text, doc_id)
    hash_of = lambda x: F.xxhash64(F.slice("__hashes", x["at"], x["n"]))
    several = F.filter(F.transform("__bounds", lambda x, i: F.struct(i.alias("no"), x["n"].alias("n"), hash_of(x).alias("hash"))), lambda x: x["n"] >= LEAST_LINES)
    slim = cut(parts.select("__key", F.explode(several).alias("x")).select("__key", "x.no", "x.hash"))
    again = slim.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    suspects = slim.join(again, "hash").groupBy("__key").agg(F.collect_set("no").alias("__nos")).withColumnRenamed("__key", "__k")

    # the bytes of suspects only: their documents are read again
    held = parts.join(suspects, F.col("__key") == F.col("__k")).select("__key", "__id", F.explode(F.transform("__nos", lambda i: F.struct(i.alias("no"), _text(F.col("__bounds")[i]["at"], F.col("__bounds")[i]["n"]).alias("bytes")))).alias("x"))
    held = cut(held.select("__key", "__id", "x.no", F.xxhash64("x.bytes").alias("hash"), "x.bytes"))
    firsts = held.groupBy("hash", "bytes").agg(F.min(F.struct("__id", "no")).alias("first")).select(F.col("hash").alias("h2"), F.col("bytes").alias("b2"), "first")
    copies = held.join(firsts, (F.col("hash") == F.col("h2")) & (F.col("bytes") == F.col("b2"))).where(~(F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("no") == F.col("first.no"))))
    drop = copies.groupBy("__key").agg(F.collect_set("no").alias("__drop")).withColumnRenamed("__key", "__k")

    rest = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(1), doc_id, text))
    joined = keyed.join(drop, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
    return _rebuild(joined, rest, text, doc_id, counts)


def _n_lines(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")


def _rebuild(joined: DataFrame, columns: list[str], text: str, doc_id: str, counts: bool) -> DataFrame:
    """Chunks are worked out again for the documents that lose some; others pass as they are."""
    masked = joined.withColumn("__masked", F.when(F.col("__drop").isNotNull(), F.col(text)))
    parts = chunks(masked.withColumnRenamed(text, "__whole").withColumnRenamed("__masked", text), text, doc_id)
    kept = F.filter(F.transform("__bounds", lambda x, i: F.struct(i.alias("no"), x["at"].alias("at"), x["n"].alias("n"))), lambda x: ~F.array_contains(F.col("__drop"), x["no"]))
    parts = _once(parts, "__kept", F.coalesce(kept, F.array().cast("array<struct<no:int,at:int,n:int>>")))
    joined_text = F.array_join(F.flatten(F.transform("__kept", lambda x: F.slice("__lines", x["at"], x["n"]))), "\n")
    new = F.when(F.col("__drop").isNull(), F.col("__whole")).otherwise(joined_text)
    left = F.aggregate("__kept", F.lit(0), lambda a, x: a + x["n"])
    removed = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__lines") - left).cast("long")
    more = [_n_lines(F.col("__whole")).alias("n_lines"), removed.alias("n_removed")] if counts else []
    return parts.select(*[(new if c == text else F.col(f"`{c}`")).alias(c) for c in columns], *more)


#: DuckDB: the same chunks and the same first places, over the table ``documents``.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), rolled AS (
  SELECT doc_id, i, line, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)) AS r FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT doc_id, i, line, r < coalesce(lag(r) OVER w, '') AND r < coalesce(lead(r) OVER w, '') AS low FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, line, coalesce(sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended
), parts AS (
  SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM numbered GROUP BY doc_id, no
), placed AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY bytes, n ORDER BY doc_id, no) > 1 AS copy FROM parts
), kept AS (
  SELECT doc_id, sum(n) AS n_lines, sum(CASE WHEN copy THEN n ELSE 0 END) AS n_removed,
    coalesce(string_agg(bytes, chr(10) ORDER BY no) FILTER (WHERE NOT copy), '') AS text
  FROM placed GROUP BY doc_id
)
SELECT d.doc_id, k.text, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
