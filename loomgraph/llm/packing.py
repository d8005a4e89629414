"""Order-preserving packing of tokenised documents into sequences, by dynamic programming.

Documents are taken in order, so every sequence is a window of the token stream. Windows may
be cut at document or sentence boundaries (and, inside sentences of over ``STEP`` tokens, every
``STEP`` tokens). The cuts minimise padding plus penalties for truncation:

    f[j] = min over i, P[j] - P[i] <= size, of f[i] + pad(P[j] - P[i]) + penalty[j]

With pad(n) = size - n this is a sliding minimum of f[i] + P[i], which a monotone queue gives
in constant time; lengths that need no padding (powers of two) are looked up besides.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._util import arrow_batches, cut

SIZE = 2048
END = 1
#: Penalties in tokens of padding: a cut at a document's end, a sentence's end, elsewhere; and
#: what a short sequence without padding costs, so that such are taken only where they pay.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE, SHORT = 0, 8, 48, 16
STEP = 256
#: New tokens after which a task gives out the windows that have become final.
RUN = 1 << 19
#: Characters of a stream, about, and how many streams there are at most (they grow beyond).
STREAM, MOST_STREAMS = 16_000_000, 100_000
#: Words that a Python worker remembers the tokens of.
REMEMBERED = 700_000
#: What special tokens start with.
SPECIAL = "<|"
#: A letter that every normal form keeps, and ASCII punctuation that no contraction or special token has.
LETTER_SIGN = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:;=?@\[-`{}~])"


def _bytes_of(words: pa.StringArray) -> list[bytes]:
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return [b""] * len(words)
    held = data.to_pybytes()
    edges = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return [held[a:b] for a, b in zip(edges, edges[1:])]


class WordTokens:
    """Token ids of whole texts, by remembering the ids of their words.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its
    words in order. Unknown words go to the tokenizer many at a time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        n = max(vocab.values()) + 1
        self.ends_word = np.zeros(n, dtype=bool)
        self.ends_sentence = np.zeros(n, dtype=bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
            core = token.removesuffix("</w>")
            self.ends_sentence[i] = self.ends_word[i] and core[-1:] in (".", "!", "?") and not core[0].isalnum()
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        text = {w: w.decode("utf-8", "surrogatepass") for w in words}
        plain = [w for w in words if text[w].isalpha()]
        got: dict[bytes, bytes] = {}
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = self._encode([" ".join([text[w] for w in part])])[0]
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            if len(ends) == len(part):  # one run of letters is one word to the tokenizer
                data = ids.tobytes()
                got.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))
        rest = [w for w in words if w not in got]
        got.update(zip(rest, (x.tobytes() for x in self._encode([text[w] for w in rest]))))
        if len(self.known) < REMEMBERED:
            self.known.update(got)
        return got

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; null texts have none.

        Words are told apart once a batch; their ids are then gathered for all places at once.
        The tokenizer folds case (but that of its special tokens), and a letter and the
        punctuation after it are never one piece to it, so that words are few.
        """
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LETTER_SIGN, r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        words = _bytes_of(coded.dictionary)
        unknown = [w for w in words if w not in self.known]
        got = self._learn(unknown) if unknown else {}
        ids = [self.known[w] if w in self.known else got[w] for w in words]
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        n = sizes[at] if len(at) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        begin = (np.cumsum(sizes) - sizes)[at] if len(at) else n
        out = flat[np.repeat(begin - (ends - n), n) + np.arange(total)]
        edges = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return out, np.diff(edges)


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, and the penalty of each; the last is len(ids)."""
    cost = np.full(len(ids) + 1, np.inf, dtype=np.float32)
    cost[1:][ends_sentence[ids]] = AT_SENTENCE
    cost[doc_ends] = AT_DOCUMENT
    cost[-1] = 0.0
    where = np.flatnonzero(cost < np.inf)
    gaps = np.diff(where, prepend=0)
    for b, g in zip(where[gaps > STEP].tolist(), gaps[gaps > STEP].tolist()):
        cost[np.arange(b - g + STEP, b, STEP)] = ELSEWHERE
    where = np.flatnonzero(cost < np.inf)
    return where, cost[where].astype(float)


def best_path(where: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> tuple[list[int], list[int]]:
    """Cut points with 0 before them, and for each the cut point before it on the cheapest way
    to it; needs gaps of ``size`` at most."""
    n = len(where)
    pos = [0, *where.tolist()]
    pen = [0.0, *penalty.tolist()]
    at = np.array(pos)
    short: dict[int, list[int]] = {}  # by cut point: those that a window without padding comes from
    for k in range(max(0, size.bit_length() - 4), size.bit_length() - 1):
        want = at - (1 << k)
        i = np.searchsorted(at, want)
        for j in np.flatnonzero((want >= 0) & (at[np.minimum(i, n)] == want)).tolist():
            short.setdefault(j, []).append(int(i[j]))
    f, prev = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (f + P, index, P), increasing
    pop, push = queue.pop, queue.append
    for j in range(1, n + 1):
        p = pos[j]
        while queue[0][2] < p - size:
            queue.popleft()
        least, i, _ = queue[0]
        cost = least + size - p
        if j in short:
            for x in short[j]:
                if f[x] + SHORT < cost:
                    cost, i = f[x] + SHORT, x
        cost += pen[j]
        f[j], prev[j] = cost, i
        g = cost + p
        while queue and queue[-1][0] > g:
            pop()
        push((g, j, p))
    return pos, prev


def path_to(pos: list[int], prev: list[int], j: int) -> list[int]:
    """The ends of the windows on the cheapest way to cut point ``j``."""
    ends = []
    while j:
        ends.append(pos[j])
        j = prev[j]
    return ends[::-1]


def common_path(pos: list[int], prev: list[int], size: int) -> list[int]:
    """The ends of the windows that all cheapest ways share to the cut points a later window may
    start from. What follows can't change them, so cuts don't depend on how texts arrive."""
    open_ = [-j for j in range(len(pos)) if pos[j] > pos[-1] - size]
    heapq.heapify(open_)
    while True:
        j = -heapq.heappop(open_)
        while open_ and -open_[0] == j:
            heapq.heappop(open_)
        if not open_:
            return path_to(pos, prev, j)
        heapq.heappush(open_, -prev[j])


def best_cuts(where: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """The ends of the cheapest windows over [0, where[-1]]; needs gaps of ``size`` at most."""
    pos, prev = best_path(where, penalty, size)
    return path_to(pos, prev, len(pos) - 1)


PIECES_DDL = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def split_tail(length: int) -> list[int]:
    """Lengths for the last window of a stream: powers of two, if these cost less than padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if (len(parts) - 1) * (ELSEWHERE + SHORT) < padding(length) else [length]


class Stream:
    """Documents of a stream, of which those not yet in a final window are held."""

    def __init__(self, ends_sentence: np.ndarray, size: int, first_sequence: int) -> None:
        self.ends_sentence, self.size, self.sequence = ends_sentence, size, first_sequence
        self.ids = np.zeros(0, dtype="<u4")
        self.doc_ids: list[int | None] = []
        self.sizes = np.zeros(0, dtype=np.int64)
        self.first = 0  # tokens of the first document that are in final windows

    def add(self, ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> None:
        self.ids = np.concatenate((self.ids, ids))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.doc_ids += doc_ids

    def windows(self, last: bool) -> pa.RecordBatch:
        """The pieces of those windows that no later document can change; all, if this is the last call."""
        ends = np.cumsum(self.sizes) - self.first
        cuts = np.zeros(0, dtype=np.int64)
        if len(self.ids):
            pos, prev = best_path(*cut_points(self.ids, ends, self.ends_sentence), self.size)
            cuts = np.array(path_to(pos, prev, len(pos) - 1) if last else common_path(pos, prev, self.size), dtype=np.int64)
            if last and self.size & (self.size - 1) == 0:
                begin = cuts[-2] if len(cuts) > 1 else 0
                cuts = np.concatenate((cuts[:-1], begin + np.cumsum(split_tail(int(cuts[-1] - begin)))))
        done = int(cuts[-1]) if len(cuts) else 0
        stops = np.union1d(cuts, ends[ends <= done])
        starts = np.concatenate(([0], stops[:-1])).astype(np.int64) if len(stops) else stops
        doc = np.searchsorted(ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        begins = np.concatenate(([0], cuts[:-1])).astype(np.int64) if len(cuts) else cuts
        data = pa.py_buffer(self.ids[:done].tobytes())
        ids = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, done) * 4).astype(np.int32).tobytes()), data])
        columns = {
            "doc_id": pa.array(self.doc_ids, pa.int64()).take(pa.array(doc)), "start": starts - (ends - self.sizes)[doc] if len(doc) else starts,
            "ids": ids, "doc_tokens": self.sizes[doc] if len(doc) else starts, "sequence_id": self.sequence + window, "offset": starts - begins[window] if len(window) else starts,
        }
        self.sequence += len(cuts)
        gone = int(np.searchsorted(ends, done, side="right")) if done else 0
        self.first = done - int(ends[gone - 1]) if gone else self.first + done
        self.ids, self.doc_ids, self.sizes = self.ids[done:].copy(), self.doc_ids[gone:], self.sizes[gone:]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _packed(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    """Packs a task's rows, which come stream by stream."""
    tokens = word_tokens(path)
    stream, at, fresh = None, None, 0
    for whole in batches:
        numbers = whole.column("stream").to_numpy()
        edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            if int(numbers[x]) != at:
                if stream is not None:
                    yield stream.windows(last=True)
                at, fresh = int(numbers[x]), 0
                stream = Stream(tokens.ends_sentence, size, at << 40)
            b = whole.slice(x, y - x)
            ids, n = tokens.encode_all(b.column("text").cast(pa.string()))
            n_ends = np.cumsum(n)
            stream.add(np.insert(ids, n_ends, end), b.column("doc_id").to_pylist(), n + 1)
            fresh += len(ids) + len(n)
            if fresh >= RUN:
                yield stream.windows(last=False)
                fresh = 0
    if stream is not None:
        yield stream.windows(last=True)


def stream_edges(rows: DataFrame, chars: int) -> list[tuple[bool, int, int]]:
    """The first key (has a doc_id, doc_id, h) of each stream, in order; ``rows``: doc_id, h and size.

    A stream begins where the exact sum of all sizes before passes the next multiple of ``chars``
    (or of a ``MOST_STREAMS``-th of all, if that is more). Sums come from ranges that are summed one by
    one, so edges don't depend on where the ranges happen to lie.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, "doc_id", "h").select("*", F.spark_partition_id().alias("part")))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("own"))
    before = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per range
    total = ranged.agg(F.sum("size")).first()[0] or 0
    chars = max(chars, -(-total // MOST_STREAMS))
    running = F.sum("size").over(Window.partitionBy("part").orderBy("doc_id", "h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # rows of one key are in one stream: the sum includes all of them
    placed = ranged.withColumn("running", running).join(before, F.col("part") == F.col("p"))
    firsts = placed.groupBy(F.expr(f"(before + running - 1) div {chars}L").alias("stream")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("k"))
    return sorted((r.k.has, r.k.id, r.k.h) for r in firsts.collect())


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = END, chars: int = STREAM) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence.

    Documents keep the order of doc_id (then of their text's hash). A stream is the documents of about
    ``chars`` characters in that order, packed by one task; streams, cuts and sequences depend on the
    documents alone, so that reruns agree on any cluster. A null or empty text is the end token alone;
    null doc_ids come first; rows that repeat are documents of their own. An empty table
    gives no piece; other columns are ignored. ``path``: a tokenizer file on every machine.
    """
    spark = docs.sparkSession
    arrow_batches(spark, rows=1500, mb=8)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    edges = stream_edges(rows.select("doc_id", "h", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")), chars)

    @F.pandas_udf("int")
    def of(has: pd.Series, ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(edges, k) - 1 for k in zip(has.tolist(), ids.tolist(), h.tolist())], dtype="int32")

    dealt = rows.withColumn("stream", of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("h")))
    ordered = dealt.repartitionById(max(1, len(edges)), F.col("stream")).sortWithinPartitions("stream", "doc_id", "h")
    return ordered.select("stream", "doc_id", "text").mapInArrow(lambda batches: _packed(batches, path, size, end), PIECES_DDL)


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    """``pieces`` with length and checksum in place of the ids, and the columns named besides."""
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more,
    )


def padding(length: int, size: int = SIZE) -> int:
    """Tokens of padding that a sequence of ``length`` needs."""
    return 0 if length and math.log2(length).is_integer() else size - length


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
