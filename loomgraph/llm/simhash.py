"""Near-duplicates by SimHash, searched with the generalised pigeonhole principle.

Fingerprints are split into groups of correlated bits. Group ``i`` gets a threshold ``t_i``
of its own (-1: the group isn't probed). If the thresholds sum to ``tau - m + 1``, two
fingerprints within ``tau`` bits agree up to ``t_i`` bits in at least one group ``i``, so
that probing each group to its radius finds every link. Dynamic programming picks the
thresholds that cost least, given how many candidates all fingerprints would meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._util import arrow_batches, components, cut

BITS = 64
SHINGLE = 4
TAU = 4
#: What one probe costs, counted in candidate pairs: a probe is shuffled, a pair only compared.
PROBE_COST = 4.0
#: Numbers of groups to choose from. More would be groups of 16 bits or less, whose buckets grow
#: with the square of the corpus from some 10^5 fingerprints on; with two or three (32 or 21 bits)
#: candidates stay few up to 10^7 and more, at 562 or 48 probes a fingerprint.
GROUPS = (2, 3)
#: Longer texts are hashed in pieces of this many bytes.
PIECE = 1 << 20

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces that end at white space, or wherever the next white space is."""
    at = 0
    while len(data) - at > PIECE:
        ends = [p for c in _SPACES if (p := data.find(bytes((c,)), at + PIECE, at + 2 * PIECE)) >= 0]
        if not ends:
            ends = [p for c in _SPACES if (p := data.find(bytes((c,)), at + PIECE)) >= 0] or [len(data)]
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:]


def _counts(hashes: list[int]) -> np.ndarray:
    """How many of ``hashes`` have each bit set, bit 0 first."""
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + np.arange(0, 2048, 256, dtype=np.int64)).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ ((np.arange(256)[:, None] >> np.arange(8)) & 1)).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of ``text``, as a signed integer; 0 if it has no word.

    A-Z are lower-cased, words are divided by ASCII white space, shingles are ``shingle``
    words with single spaces (all words, if there are fewer), repeats count. Bit b is set if
    it is set in the XXH64 (seed 42) of over half the shingles.
    """
    from xxhash import xxh64_intdigest

    total, n, carry = np.zeros(BITS, dtype=np.int64), 0, []
    for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + piece.split()
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        total += _counts(hashes)
        n += len(hashes)
        carry = words[len(words) - shingle + 1 :]
    if not n and carry:
        total, n = _counts([xxh64_intdigest(b" ".join(carry), 42)]), 1
    bits = int(sum(1 << b for b in np.flatnonzero(2 * total > n).tolist()))
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


# --- choosing groups and thresholds -------------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many of them have bits i and j set, over all rows.

    Tasks send 64 x 64 counts each; Spark adds them up.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for b in batches:
            v = b["fp"].to_numpy(dtype=np.int64)
            x = ((v[:, None] >> np.arange(BITS)) & 1).astype(np.float64)
            both += (x.T @ x).astype(np.int64)
            n += len(v)
        yield pd.DataFrame({"k": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})

    got = prints.select("fp").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in got:
        flat[r.k] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each grows by the bit that correlates most with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for i in range(m):
        size = (BITS + i) // m
        group = [left.pop(0)]
        while len(group) < size:
            group.append(left.pop(int(np.argmax(corr[np.ix_(group, left)].sum(axis=0)))))
        groups.append(sorted(group))
    return groups


def expected_pairs(n: int, both: np.ndarray, group: list[int], same: float, most: int) -> list[float]:
    """Expected number of ordered pairs that differ in at most t = 0..most bits of a group.

    The shape comes from the bits' own frequencies, the height from ``same``, the counted
    number of ordered pairs that agree in the whole group.
    """
    p = both.diagonal()[group] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(len(group) + 1)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    below = np.cumsum(dist) * n * n
    return [max(below[t], same) if t else max(same, 1.0) for t in range(most + 1)]


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t_i = u_i - 1 with sum(u_i) = units and least sum of ``costs[i][u_i]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picks) in best.items():
            for u in range(min(units - used, len(row) - 1) + 1):
                new = (cost + row[u], [*picks, u - 1])
                if used + u not in step or new[0] < step[used + u][0]:
                    step[used + u] = new
        best = step
    return best[units]


def _mask(group: list[int]) -> int:
    v = sum(1 << b for b in group)
    return v - (1 << BITS) if v >> (BITS - 1) else v


def plan_groups(prints: DataFrame, tau: int = TAU, ms: tuple[int, ...] = GROUPS) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds for all of ``prints`` (distinct, column ``fp``)."""
    n, both = bit_statistics(prints)
    ms = [m for m in ms if m <= tau + 1] or [1]
    options = {m: group_bits(n, both, m) for m in ms}
    masks = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _masked(g).alias("key")) for m in ms for i, g in enumerate(options[m])]
    same = {
        (r.m, r.i): float(r.pairs)
        for r in prints.select(F.explode(F.array(*masks)).alias("x")).select("x.*").groupBy("m", "i", "key").count()
        .where("count > 1").groupBy("m", "i").agg(F.sum(F.expr("double(count) * (count - 1)")).alias("pairs")).collect()
    }
    found = []
    for m, groups in options.items():
        rows = []
        for i, g in enumerate(groups):
            pairs = expected_pairs(n, both, g, same.get((m, i), 0.0), tau)
            ball = [sum(math.comb(len(g), k) for k in range(t + 1)) for t in range(tau + 1)]
            rows.append([0.0] + [PROBE_COST * n * (ball[t] + 1) + pairs[t] for t in range(tau + 1)])
        found.append((*allocate(rows, tau + 1), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return list(zip(groups, thresholds))


# --- linking ------------------------------------------------------------------------------


def _flips(group: list[int], radius: int) -> list[int]:
    return [_mask(list(c)) for k in range(radius + 1) for c in combinations(group, k)]


def _masked(group: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_mask(group)).cast("long"))


def _probe_keys(i: int, group: list[int], radius: int) -> Column:
    """All (i, key) that agree with column ``fp`` up to ``radius`` bits of the group."""
    flips = F.split(F.lit(",".join(map(str, _flips(group, radius)))), ",").cast("array<bigint>")
    return F.transform(flips, lambda x: F.struct(F.lit(i).alias("i"), _masked(group).bitwiseXOR(x).alias("key")))


def link_fingerprints(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """Components of distinct fingerprints (column ``fp``, long) that link at ``tau`` bits or fewer.

    Returns ``node`` and ``component`` (the least linked fingerprint) for all that have a link.

    First every fingerprint is held against the least one of its bucket, one comparison each.
    That joins dense groups; the full probes then pair only what is near and still apart. Both
    are conditions of the join itself, so that neither a group nor a bucket emits its pairs.
    """
    plan = [(i, g, t) for i, (g, t) in enumerate(plan_groups(prints, tau)) if t >= 0]

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("i"), _masked(g).alias("key")) for i, g, _ in plan]
        return df.select("fp", *more, F.explode(F.array(*keys)).alias("x")).select("x.i", "x.key", "fp", *more)

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau
    buckets = keyed(prints)
    least = buckets.groupBy("i", "key").agg(F.min("fp").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = buckets.join(least, ["i", "key"]).where((F.col("fp") != F.col("other")) & near)
    first = components(stars.select(F.col("fp").alias("a"), F.col("other").alias("b")))
    known = cut(prints.join(first.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("c")))

    index = keyed(known, "c")
    probe_keys = [_probe_keys(i, g, t) for i, g, t in plan]
    probes = known.select("fp", "c", F.explode(F.concat(*probe_keys)).alias("x")).select("x.i", "x.key", F.col("fp").alias("pfp"), F.col("c").alias("pc"))
    pairs = probes.join(
        index.select(F.col("i").alias("i2"), F.col("key").alias("key2"), "fp", "c"),
        (F.col("i") == F.col("i2")) & (F.col("key") == F.col("key2")) & (F.col("c") != F.col("pc"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pfp"))) <= tau),
    )
    second = components(pairs.select(F.col("pc").alias("a"), F.col("c").alias("b")))
    return (
        known.join(second.select(F.col("node").alias("c"), "component"), "c", "left")
        .select(F.col("fp").alias("node"), F.coalesce("component", "c").alias("component"))
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of ``tau`` bits or fewer.
    Null, empty and blank texts have fingerprint zero and link like any other; copies and
    repeated rows share a fingerprint and so a component. A null doc_id keeps its row and
    never names a component (component_id is null if the component has no other).
    An empty table gives an empty result; other columns are ignored.
    """
    prints, classes = _classes(docs, text, doc_id, tau, shingle)
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _text_hash(text: str) -> Column:
    return F.xxhash64(text, F.crc32(F.col(text).cast("binary")))


def _classes(docs: DataFrame, text: str, doc_id: str, tau: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows as doc_id, text_hash, fp; and fp with its least doc_id and its component."""
    arrow_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text_hash(text).alias("text_hash"), fingerprint_column(F.col(text), shingle).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = link_fingerprints(distinct.select("fp"), tau)
    classes = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return prints, cut(classes)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one row with the smallest doc_id.

    A row without doc_id stays if its component has no other. Rows that share their doc_id,
    null or not, are told apart by their text, of which the one of least hash stays. Null and
    empty texts are one component; of rows that repeat one stays. An empty table gives an
    empty result; other columns stay as they are.
    """
    from pyspark.sql import Window

    prints, classes = _classes(docs, text, doc_id, tau, shingle)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    first = prints.join(classes.select("fp", "component"), "fp").groupBy("component").agg(F.min(key).alias("k"))
    return _one_each(docs, first.select("k.doc_id", "k.text_hash"), text, doc_id)


def _one_each(docs: DataFrame, kept: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_hash) of ``kept``, the least by its other columns."""
    from pyspark.sql import Window

    kept = kept.distinct().select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash"))
    stay = docs.withColumn("__own_hash", _text_hash(text)).withColumn("__own_id", F.col(doc_id).cast("long"))
    stay = stay.join(kept, F.col("__own_id").eqNullSafe(F.col("__kept_id")) & (F.col("__own_hash") == F.col("__kept_hash")), "left_semi")
    # what is left to tell apart are rows of one doc_id and one text; Spark limits them before the shuffle
    kinds = dict(docs.dtypes)
    order = Window.partitionBy("__own_id", "__own_hash").orderBy(*[F.col(f"`{c}`") for c in docs.columns if kinds[c] not in ("void", "variant") and "map<" not in kinds[c]])
    return stay.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
