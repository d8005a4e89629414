"""Search over dialogue: documents, an index of terms, prefix and fuzzy matching, ranks.

The score is BM25 with field boosts; which documents match follows from prefixes and edit
distance alone. Query words meet the vocabulary by equal beginnings and parts, not word by word, and never
meet documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERM = r"[^ \t\n\r\f\x0B!-/:-@\[-`{-~]+"
FUZZY = 0.25
BOOSTS = {"line": 2.0, "label": 1.0}
DEFAULT, MOST = 500, 2000
K1, B = 1.2, 0.7


def line_docs(lines: DataFrame) -> DataFrame:
    """One document per line: doc_id ``<node>::<i>`` with i from 1 in line order, label and line."""
    w = Window.partitionBy("project_id", "node_id").orderBy("line_no")
    n = F.row_number().over(w)
    return lines.select("project_id", F.concat("node_id", F.lit("::"), n.cast("string")).alias("doc_id"), "node_id", n.alias("line_index"), F.col("node_id").alias("label"), F.col("text").alias("line"))


def translated_docs(translations: DataFrame) -> DataFrame:
    """Documents of translated lines: ``<block>::tl_<lang>::<i>``."""
    key = F.concat("block_id", F.lit("::tl_"), "lang", F.lit("::"), "line_index")
    return translations.select("project_id", key.alias("doc_id"), F.col("block_id").alias("node_id"), F.col("line_index").cast("int").alias("line_index"), F.col("base_label").alias("label"), F.col("text").alias("line"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """project_id, doc_id, field, term, tf, length."""
    parts = [F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields]
    rows = docs.select("project_id", "doc_id", F.explode(F.array(*parts)).alias("x")).select("project_id", "doc_id", "x.field", F.size("x.terms").alias("length"), F.explode("x.terms").alias("term"))
    return rows.groupBy("project_id", "doc_id", "field", "length", "term").agg(F.count("*").alias("tf"))


def _segments(length: str, d: str) -> str:
    """SQL for the ``d`` + 1 even parts of a word of some length: array of (i, from, n), places from 0."""
    base, long_from = f"({length} div ({d} + 1))", f"({d} + 1 - {length} % ({d} + 1))"
    return f"transform(sequence(0, {d}), i -> struct(i as i, cast(i * {base} + greatest(0, i - {long_from}) as int) as from, cast({base} + if(i >= {long_from}, 1, 0) as int) as n))"


def expand(vocabulary: DataFrame, queries: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """Terms that a query word stands for: itself, words it begins, words within its edit distance.

    ``queries``: query_id, query. A weight falls with the distance. Words meet by equal keys only: beginnings of the lengths that the
    query's words have; and, of a term within d edits, one of its d + 1 parts, which must be in the query's word unchanged and
    no more than d places off. Distances are worked out for those that share a part.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("q"))
    words = asked.select("q").distinct().withColumns({"size": F.length("q"), "d": F.round(F.length("q") * fuzzy).cast("int")})
    lengths = words.select("size").distinct()
    begun = vocabulary.withColumn("l", F.length("term")).join(lengths, F.col("l") >= F.col("size")).withColumn("key", F.expr("left(term, size)"))
    begins = begun.join(words.select(F.col("q").alias("key")), "key").select(F.col("key").alias("q"), "term")

    near = words.where("d > 0").withColumn("l", F.explode(F.expr("sequence(greatest(size - d, 1), size + d)")))
    part = near.withColumn("x", F.explode(F.expr(_segments("l", "d")))).select("q", "d", "l", "x.*")
    shifted = part.withColumn("at", F.explode(F.expr("sequence(greatest(from - d, 0), greatest(from - d, 0) + 2 * d)"))).where(F.col("at") + F.col("n") <= F.length("q"))
    probes = shifted.select("q", "d", "l", "i", F.expr("substring(q, at + 1, n)").alias("key")).distinct()
    kinds = near.select("l", "d").distinct()
    index = vocabulary.withColumn("l", F.length("term")).join(kinds, "l").withColumn("x", F.explode(F.expr(_segments("l", "d")))).select("term", "l", "d", "x.i", F.expr("substring(term, x.from + 1, x.n)").alias("key"))
    close = probes.join(index, ["l", "d", "i", "key"]).where(F.levenshtein("term", "q") <= F.col("d")).select("q", "term")
    both = asked.join(begins.unionByName(close).distinct(), "q")
    length = F.length("term")
    weight = F.when(F.col("term") == F.col("q"), 1.0).when(F.col("term").startswith(F.col("q")), 0.375 * length / (length + 0.3 * (length - F.length("q")))).otherwise(0.45 * length / (length + F.levenshtein("term", "q")))
    return both.select("query_id", "q", "term", weight.alias("weight"))


def search(docs: DataFrame, queries: DataFrame, fields: dict[str, float] | None = None, node_ids: DataFrame | None = None, limit: int | None = DEFAULT) -> DataFrame:
    """Ranked hits: query_id, project_id, doc_id, score, rank. ``node_ids`` filter before the limit; without a limit all hits stay."""
    fields = fields or BOOSTS
    p = postings(docs, fields)
    one = expand(p.select("term").distinct(), queries)
    sizes = p.select("project_id", "doc_id", "field", "length").distinct().groupBy("project_id", "field").agg(F.avg("length").alias("mean"), F.count("*").alias("n"))
    df = p.groupBy("project_id", "field", "term").agg(F.count("*").alias("df"))
    m = p.join(one, "term").join(df, ["project_id", "field", "term"]).join(sizes, ["project_id", "field"])
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(b)) for f, b in fields.items()])
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    s = m.groupBy("query_id", "project_id", "doc_id").agg(F.sum(boost * F.col("weight") * idf * tf).alias("score"))
    if node_ids is not None:
        ids = docs.select("project_id", "doc_id", "node_id").join(node_ids.select("project_id", F.col("id").alias("node_id")).distinct(), ["project_id", "node_id"], "left_semi")
        s = s.join(ids.select("project_id", "doc_id"), ["project_id", "doc_id"], "left_semi")
    w = Window.partitionBy("query_id", "project_id").orderBy(F.desc("score"), "doc_id")
    ranked = s.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= min(MOST, max(1, limit)))


def match_union(node_hits: DataFrame, line_hits: DataFrame) -> DataFrame:
    """Nodes found by themselves or by a line of theirs."""
    return node_hits.select("project_id", "node_id").unionAll(line_hits.select("project_id", "node_id")).distinct()
