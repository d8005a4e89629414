"""Exact dedup, ranked lexical search and the source audit against brute force, and on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import divergence, exactdedup, lexical

#: Columns of names that the operators use inside.
CLASHES = ("run", "digest", "sha", "row", "best", "n", "of", "terms", "tfs", "item", "some", "rank", "score", "term", "p", "q", "at", "base", "docs", "kinds", "total", "a.b")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def _docs(spark, rows, parts=7):
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).repartition(parts)


AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "  \n ", None, None), (4, "one Two", "en", "b"), (None, "one Two", "en", "b"), (4, "one Two", "en", "b"),
    (5, "x" * 50_000, "en", "c"), (6, "word " * 30_000, "de", "c"), (7, "Größe naïve 日本 É\x0b\x1c end one", "", "a"), (None, None, "", ""), (-3, "one two", "fr", "z"), (9, "İstanbul K one two", "en", "b"),
]


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# --- exact dedup ---


def _brute_dedup(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [(i, keep, len(ids), n == stays, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(map(str, out))


def _many():
    rng = np.random.default_rng(3)
    return [(int(i), f"text {rng.integers(0, 60) if i % 3 else 0}", "en", "a") for i in rng.permutation(400)]


@pytest.mark.parametrize("fan", [2, 16])
def test_exact_dedup_against_brute_force(spark, fan):
    rows = _many()
    got = exactdedup.dedup(_docs(spark, rows, 11), fan=fan)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert _rows(got) == _brute_dedup(rows)


def test_exact_dedup_tells_texts_of_one_digest_apart(spark):
    rows = _many() + AWKWARD
    weak = lambda text: F.substring(F.md5(text), 1, 1)
    assert _rows(exactdedup.dedup(_docs(spark, rows), digest=weak, fan=2)) == _brute_dedup(rows)


def test_exact_dedup_awkward(spark):
    assert _rows(exactdedup.dedup(_docs(spark, AWKWARD))) == _brute_dedup(AWKWARD)
    assert exactdedup.dedup(_docs(spark, [])).count() == 0


def test_exact_dedup_has_no_python(spark):
    plan = exactdedup.dedup(_docs(spark, AWKWARD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- lexical search ---


def _terms(pattern, text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(pattern, text or "")]


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _brute_search(docs, items, k=10):
    held = [(i, Counter(_terms(TERM, t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in _terms(TERM, text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


def _corpus(seed=1, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(120)] + ["Äh", "日本", "K9"]
    weights = 1 / np.arange(1, len(words) + 1)
    say = lambda size: " ".join(rng.choice(words, size, p=weights / weights.sum()))
    docs = [(int(i), say(rng.integers(1, 60)), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 7)}") for i in range(n)]
    docs += [(1000 + i, docs[5][1], "en", "s0") for i in range(60)]  # copies tie
    return docs, [(i, say(12)) for i in range(9)] + [(90, None), (91, ""), (92, "unheard"), (93, "w1 w1 w1 W1!"), (3, "w2"), (3, "w2")]


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = _corpus()
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(_docs(spark, docs), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = _brute_search(docs, items)
    assert _rows(got) == want
    monkeypatch.setattr(lexical, "BLOCK", 100)  # several blocks of items
    assert _rows(lexical.search(_docs(spark, docs), asked)) == want
    assert _rows(lexical.search(_docs(spark, docs), asked, k=2)) == _brute_search(docs, items, 2)


def test_search_awkward(spark):
    items = [(1, "one two"), (None, "größe GRÖSSE end"), (2, "xx"), (3, "日本 É")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert _rows(lexical.search(_docs(spark, AWKWARD), asked)) == _brute_search(AWKWARD, items)
    assert lexical.search(_docs(spark, []), asked).count() == 0
    assert lexical.search(_docs(spark, AWKWARD), asked.limit(0)).count() == 0


@pytest.mark.parametrize(("trie", "leaf"), [(5, 1), (64, 2), (4096, 16)])
def test_tries_of_any_size_and_bounds(monkeypatch, trie, leaf):
    """The search inside a task, with tries and leaves of several sizes; a bound is never below a score."""
    monkeypatch.setattr(lexical, "TRIE", trie)
    monkeypatch.setattr(lexical, "MAXIMA", 1 << 30)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = np.random.default_rng(trie)
    n, kinds = 500, 40
    weights = {f"t{i:02}": int(rng.integers(0, 3000)) for i in range(kinds)}
    asked = lexical.Asked([Counter({f"t{rng.integers(0, kinds):02}": int(rng.integers(1, 3)) for _ in range(6)}) for _ in range(20)], weights)
    held = [Counter(rng.integers(0, kinds, rng.integers(1, 25)).tolist()) for _ in range(n)]
    held[100:160] = [held[3]] * 60
    sizes = [sum(c.values()) + int(rng.integers(0, 9)) for c in held]
    total = sum(sizes)
    ends = np.cumsum([0, *map(len, held)])
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for c in held for x in of(c)], pa.int32())) for of in (dict.keys, dict.values)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
    bounds = []
    bound = lexical.Trie._bound
    monkeypatch.setattr(lexical.Trie, "_bound", lambda self, node, a: (bounds.append((self, node, bound(self, node, a))), bounds[-1][2])[1])
    best = lexical._best_of_task(iter([batch.slice(0, 123), batch.slice(123)]), asked, np.arange(kinds), n, total, 10)
    place = {t: i for i, t in enumerate(asked.terms)}
    value = lambda c, m: {t: weights[f"t{t:02}"] * (10**9 * tf // (1000 * tf + 8 * m)) for t, tf in c.items()}
    # the vectors count terms by their place in the items' common order
    names = {i: int(t[1:]) for t, i in place.items()}
    scores = np.zeros((n, 20), dtype=np.int64)
    for i, c in enumerate(held):
        m = 25 + 75 * sizes[i] * n // total
        v = value({names[t]: tf for t, tf in c.items()}, m)
        for j in range(20):
            a = asked.starts[j]
            b = asked.starts[j + 1] if j < 19 else len(asked.term)
            scores[i, j] = sum(int(k) * v.get(names[int(t)], 0) for t, k in zip(asked.term[a:b], asked.times[a:b]))
    for j in range(20):
        assert best.rows[j] == sorted((-int(s), i) for i, s in enumerate(scores[:, j]) if s > 0)[:10]
    assert bounds
    for tree, node, b in bounds:
        a, z, _ = tree.nodes[node]
        assert (b >= scores[tree.ids[a:z]].max(axis=0)).all()


def test_terms_in_pieces(monkeypatch):
    text = "Ab9 " * 100 + "é" * 50 + "-" + "z" * 33 + "İÉ K"
    monkeypatch.setattr(lexical, "PIECE", 7)
    for term, pattern in ((lexical.TERM, TERM), (divergence.TERM, LETTERS)):
        assert [t.decode() for piece in lexical.pieces(text.encode(), term) for t in piece] == _terms(pattern, text)
    assert lexical.term_counts(text) == Counter(_terms(TERM, text))


# --- source audit ---

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _brute_audit(docs, least, top=50):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = _terms(LETTERS, text)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: count[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in own.items()}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in own:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])
            for name, found in (("pair", far), ("term", more[:top])):
                out += [(lang, s, name, item, -v, n + 1) for n, (v, _, item) in enumerate(found)]
    return sorted(map(str, out))


@pytest.mark.parametrize("options", [{}, {"side": 2, "share": 20}, {"side": 3}])
def test_audit_against_brute_force(spark, options):
    docs, _ = _corpus(4)
    docs += [(1, "...", "en", "no terms"), (2, None, "fr", "alone"), (3, None, "fr", None)]
    got = divergence.audit(_docs(spark, docs), least_docs=12, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert _rows(got) == _brute_audit(docs, 12)


def test_audit_awkward(spark):
    for least in (1, 2, 30):
        assert _rows(divergence.audit(_docs(spark, AWKWARD), least_docs=least)) == _brute_audit(AWKWARD, least)
    assert divergence.audit(_docs(spark, [])).count() == 0


def test_audit_shortens_terms_alone(spark):
    docs, _ = _corpus(5)
    got = divergence.audit(_docs(spark, docs), least_docs=5, top=3)
    assert _rows(got) == _brute_audit(docs, 5, 3)
