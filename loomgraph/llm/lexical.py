"""Ranked lexical search: a document FP-tree with depth-first branch and bound.

A document's vector holds the terms that any item asks for, most frequent first, so that vectors
share paths of a trie. Every inner node knows the largest tf of each term and the least m below it;
as a score rises with tf and falls with m, these bound what any document below can reach. Items go
down the trie together, each as long as its own bound comes up to its k-th best score so far.

Each task builds the tries of its own rows (a bounded number of documents each) and gives out
its best rows of each item; a second and a third ranking join the tasks' lists. Items are asked in
blocks of bounded size, each over all documents.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._util import arrow_batches, cut

K = 10
#: Over UTF-8 bytes; those of signs beyond ASCII are all parts of terms.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of item texts in a block, about; what the driver and a task hold of items.
BLOCK = 1_000_000
#: Documents of a trie, and numbers in the maxima of its nodes, at most.
TRIE, MAXIMA = 16_384, 48_000_000
#: A subtree of so many documents is scored one by one.
LEAF = 16
#: Bytes of a text that are searched for terms at once.
PIECE = 1 << 20

_NO_ID = np.iinfo(np.int64).max


def pieces(text: bytes, term: re.Pattern[bytes]) -> Iterator[list[bytes]]:
    """The maximal terms of a text with A-Z made small (and nothing else), in pieces that no term crosses."""
    at, end = 0, len(text)
    while at < end:
        to = min(end, at + PIECE)
        held = term.match(text, to)
        to = held.end() if held else to
        yield term.findall(text[at:to].lower())
        at = to


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text, without decoding them; of nulls none."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def term_counts(text: str | None) -> Counter[str]:
    counts: Counter[bytes] = Counter()
    for piece in pieces((text or "").encode(), TERM):
        counts.update(piece)
    return Counter({t.decode(): n for t, n in counts.items()})


def vectors(docs: DataFrame, vocabulary: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n (terms with repeats), and the positions in ``vocabulary`` of the terms it holds with their tf.

    Rows without a term (null and empty texts too) are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t.encode(): i for i, t in enumerate(vocabulary)}
        for batch in batches:
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                n, own = 0, Counter()
                for piece in pieces(text, TERM):
                    n += len(piece)
                    for token, times in Counter(piece).items():
                        if token in place:
                            own[place[token]] += times
                if n:
                    ids.append(doc)
                    sizes.append(n)
                    terms += own.keys()
                    tfs += own.values()
                    ends.append(len(terms))
            ends32 = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends32, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=schema)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    return slim.mapInArrow(of, "doc_id long, n long, terms array<int>, tfs array<int>")


class Asked:
    """The items of a block: for each item its terms (numbers of a common vocabulary) and how often it has each."""

    def __init__(self, counts: list[Counter[str]], weights: dict[str, int]) -> None:
        #: most frequent term first, which is the least weight
        self.terms = sorted(weights, key=lambda t: (weights[t], t))
        place = {t: i for i, t in enumerate(self.terms)}
        self.weight = np.array([weights[t] for t in self.terms], dtype=np.int64)
        held = [[(place[t], n) for t, n in c.items() if t in place] for c in counts]
        #: items that hold a term of some document; the others have no result
        self.items = np.array([i for i, h in enumerate(held) if h], dtype=np.int64)
        held = [h for h in held if h]
        self.term = np.array([t for h in held for t, _ in h], dtype=np.int64)
        self.times = np.array([n for h in held for _, n in h], dtype=np.int64)
        self.starts = np.cumsum([0, *map(len, held)])[:-1].astype(np.int64)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Each item's sum of its terms' values."""
        return np.add.reduceat(value[self.term] * self.times, self.starts)


class Best:
    """The k best (score, doc_id) of each item so far, and what a further score has to come up to."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.rows = k, [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)

    def offer(self, item: int, score: int, doc: int) -> None:
        rows = self.rows[item]
        insort(rows, (-score, doc))
        if len(rows) > self.k:
            rows.pop()
        if len(rows) == self.k:
            self.least[item] = -rows[-1][0]


def part(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What a term of weight 1 adds; rises with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Trie:
    """Documents in the order of their paths. A node is a run of documents that share a prefix;
    its children split it where the next term differs. ``terms`` of a document rise (rarer and rarer)."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, kinds: int) -> None:
        paths = [terms[a:b].astype(">u4").tobytes() for a, b in zip(ends, ends[1:])]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.ids, self.m, self.kinds = ids[order], m[order], kinds
        self.docs = [(terms[ends[i] : ends[i + 1]], tfs[ends[i] : ends[i + 1]]) for i in order]
        #: how many terms a document shares with the one before it
        self.shared = np.zeros(len(order), dtype=np.int64)
        for i in range(1, len(order)):
            a, b = self.docs[i - 1][0], self.docs[i][0]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.shared[i] = differ.argmax() if differ.any() else n
        #: inner nodes: (from, to, children); a child is another inner node's number or -1 with its run
        self.nodes: list[tuple[int, int, list[tuple[int, int, int]]]] = []
        self._grow()
        self.most = np.zeros((len(self.nodes), kinds), dtype=np.int32)
        self.least_m = np.array([self.m[a:b].min() for a, b, _ in self.nodes], dtype=np.int64)
        for i in range(len(self.nodes) - 1, -1, -1):  # children come after their parents
            most = self.most[i]
            for node, a, b in self.nodes[i][2]:
                if node >= 0:
                    np.maximum(most, self.most[node], out=most)
                else:
                    for t, tf in self.docs[a:b]:
                        most[t] = np.maximum(most[t], tf)

    def _grow(self) -> None:
        todo = [(0, len(self.docs), None)]
        while todo:
            a, b, slot = todo.pop()
            number = -1
            if b - a > LEAF or slot is None:
                number = len(self.nodes)
                children: list[tuple[int, int, int]] = []
                self.nodes.append((a, b, children))
                inner = self.shared[a + 1 : b]
                cuts = a + 1 + np.flatnonzero(inner == inner.min()) if len(inner) else np.zeros(0, dtype=np.int64)
                edges = [a, *cuts.tolist(), b]
                for c, d in zip(edges, edges[1:]):
                    children.append((-1, c, d))
                    todo.append((c, d, (number, len(children) - 1)))
            if slot is not None:
                self.nodes[slot[0]][2][slot[1]] = (number, a, b)

    def search(self, asked: Asked, best: Best) -> None:
        todo = [(0, self._bound(0, asked))]
        while todo:
            at, bound = todo.pop()
            if not (bound >= best.least).any():
                continue
            inner = []
            for node, a, b in self.nodes[at][2]:
                if node >= 0:
                    inner.append((node, self._bound(node, asked)))
                else:
                    for i in range(a, b):
                        self._score(i, asked, best)
            inner.sort(key=lambda x: (x[1] - best.least).max())  # the most promising subtree first
            todo += inner

    def _bound(self, node: int, asked: Asked) -> np.ndarray:
        return asked.sums(asked.weight * part(self.most[node].astype(np.int64), self.least_m[node]))

    def _score(self, i: int, asked: Asked, best: Best) -> None:
        terms, tfs = self.docs[i]
        value = np.zeros(self.kinds, dtype=np.int64)
        value[terms] = asked.weight[terms] * part(tfs.astype(np.int64), self.m[i])
        scores = asked.sums(value)
        for item in np.flatnonzero(scores >= best.least).tolist():
            best.offer(item, int(scores[item]), int(self.ids[i]))


def _best_of_task(batches: Iterator[pa.RecordBatch], asked: Asked, place: np.ndarray, n_docs: int, n_terms: int, k: int) -> Best:
    """Searches a task's vectors, trie by trie. ``place``: from a vector's term to the items' term, or -1."""
    best, kinds = Best(len(asked.items), k), len(asked.terms)
    most = max(64, min(TRIE, MAXIMA // max(1, kinds)))
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> None:
        ids, sizes, lengths, terms, tfs = (np.concatenate(x) for x in zip(*held))
        m = 100 - 75 + (75 * sizes * n_docs) // n_terms
        row = np.repeat(np.arange(len(ids)), lengths)
        terms = place[terms]
        order = np.lexsort((terms, row))
        order = order[terms[order] >= 0]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[order], minlength=len(ids)))])
        Trie(ids, m, ends, terms[order], tfs[order], kinds).search(asked, best)

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            b = batch.slice(at, most)
            ids = b.column(0).fill_null(_NO_ID).to_numpy()
            lengths = np.diff(b.column(2).offsets.to_numpy())
            held.append((ids, b.column(1).to_numpy(), lengths, b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()))
            count += len(ids)
            if count >= most:
                flush()
                held, count = [], 0
    if held:
        flush()
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score.

    Null and empty texts have no terms: such a document is in no result and not counted, such an item
    has no rows. Repeated documents are ranked each on its own; one without a doc_id comes last among
    equal scores and has a null there. Items that repeat item_id and text are one, those that repeat
    item_id alone are ranked each on its own. Other columns are ignored, whatever their names. Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    asked = cut(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text <> ''").distinct())
    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        got = _block(docs, [r.item_id for r in rows], [term_counts(r.text) for r in rows], k, text, doc_id)
        found = got if found is None else found.unionAll(got)
    return found


def _block(docs: DataFrame, names: list[int | None], counts: list[Counter[str]], k: int, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for c in counts for t in c})
    held = cut(vectors(docs, vocabulary, text, doc_id))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = {r.term: r.w for r in df.select("term", weight.alias("w")).collect()}  # a block's terms at most
    asked = Asked(counts, {vocabulary[t]: w for t, w in weights.items()})
    order = {t: i for i, t in enumerate(asked.terms)}
    place = np.array([order.get(t, -1) for t in vocabulary], dtype=np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _best_of_task(batches, asked, place, n_docs, n_terms, k)
        rows = [(int(asked.items[i]), doc, -score) for i, own in enumerate(best.rows) for score, doc in own]
        for at in range(0, len(rows), 10_000):
            item, doc, score = zip(*rows[at : at + 10_000])
            ids = pa.array([None if d == _NO_ID else d for d in doc], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    if not len(asked.items):
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    lists = held.mapInArrow(of, "item int, doc_id long, score long").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(256)))
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "some"], ["item"]):
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, names[i]) for i in asked.items.tolist()], "item int, item_id long")
    return lists.join(named, "item").select("item_id", "rank", "doc_id", "score")


#: DuckDB: every document's score of every item, over ``documents`` and ``benchmark``.
ORACLE_SQL = r"""
WITH small AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), sized AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n, words FROM small WHERE len(words) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sized
), tf AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM sized) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // nt))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
