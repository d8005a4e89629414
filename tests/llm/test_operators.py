"""The operators of loomgraph.llm against brute force, on small tables and awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _util, hamming_topk, linededup, mixing, nndescent, packing, pii, quality, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, members int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 1) for i, t, s in rows], DOCS)


WORDS = [f"w{i}" for i in range(400)]


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, "one", "a"), (None, "one", "b"), (4, "one", "a"), (5, "x" * 50_000, "b"), (6, _prose(1, 30_000), "b"), (7, "Größe naïve 日本 \x0b\x1c end", "a")]


@pytest.fixture(scope="module")
def awkward(spark):
    return _docs(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- components ---


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in _util.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# --- simhash ---


def _brute_fingerprint(text, k=4):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_in_pieces(monkeypatch):
    text = _prose(3, 2000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 257)
    assert simhash.fingerprint(text) == whole and whole % 2**64 == _brute_fingerprint(text)


def test_simhash_against_brute_force(spark):
    rows = []
    for g in range(40):
        base = _prose(g, 150).split()
        for v in range(1 + g % 5):
            w = list(base)
            for k in range(v):
                w[10 + 30 * k] = "changed"
            rows.append((g * 10 + v, " ".join(w).upper() if v == 2 else " ".join(w), "s"))
    rows += [(900, rows[3][1], "s"), (None, rows[3][1], "s"), (901, "", "s"), (902, None, "s")]
    got = simhash.near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(r[0], r[1]): _brute_fingerprint(r[1]) for r in rows}
    distinct = sorted(set(prints.values()))
    comp = {f: f for f in distinct}
    changed = True
    while changed:
        changed = False
        for a in distinct:
            for b in distinct:
                if (a ^ b).bit_count() <= 4 and comp[a] < comp[b]:
                    comp[b], changed = comp[a], True
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = {(i, f"{f:016x}", least[comp[f]]) for (i, _), f in prints.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


def test_allocate():
    cost, t = simhash.allocate([[0, 5, 9], [0, 1, 100], [0, 2, 3]], 3)
    assert sum(x + 1 for x in t) == 3 and cost == 4 and t == [-1, 0, 1]


def test_keep_one(spark, awkward, empty):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_without_ids(spark):
    rows = [(None, _prose(600 + i, 80), "b") for i in range(6)] + [(None, _prose(600, 80), "b"), (1, _prose(605, 80), "a")]
    rows += [(2, _prose(620 + i, 80), "a") for i in range(3)] + [(2, _prose(620, 80), "a")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(_docs(spark, rows)).collect()]
    want = [(None, _prose(600 + i, 80)) for i in range(5)] + [(1, _prose(605, 80))] + [(2, _prose(620 + i, 80)) for i in range(3)]
    assert sorted(kept, key=str) == sorted(want, key=str)


# --- quality and toxicity ---


def test_ordinal_regression():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        rows.append(np.array([g * 7 + 1, 100 + int(rng.integers(0, 40)), 200 + int(rng.integers(0, 40))]))
        grades.append(g)
    m = quality.fit_sample(rows, np.array(grades))
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    w = dict(zip(m.hashes.tolist(), m.weights.tolist()))
    assert w[1] < w[8] < w[15]
    assert len(quality.fit_sample([], np.array([], dtype=int)).thresholds) == 0
    assert len(quality.fit_sample(rows[:3], np.zeros(3, dtype=int)).thresholds) == 0


def test_quality_stage(spark, awkward, empty):
    good = [(i, _prose(i, 80), "s") for i in range(60)]
    bad = [(i, " ".join(w + "###" for w in _prose(i, 80).split()), "s") for i in range(60, 120)]
    docs = _docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    m = quality.fit(docs, quality.grades(labels))
    kept = {r.doc_id for r in quality.select(docs, m).collect()}
    assert kept == set(range(60))
    assert quality.score(awkward, m).count() == len(AWKWARD) and quality.score(empty, m).count() == 0
    none = quality.fit(docs, quality.grades(labels.limit(0)))
    assert quality.select(docs, none).count() == 120


def test_counterfactual_penalty():
    rng = np.random.default_rng(2)
    word = lambda w: toxicity.tf._hash("w", w)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 2
        f = [word(f"n{rng.integers(0, 50)}") for _ in range(5)]
        if toxic and rng.random() < 0.6:
            f.append(word("idiot"))
        if rng.random() < (0.5 if toxic else 0.05):
            f.append(word("women"))  # groups are named more often in toxic texts
        elif rng.random() < 0.3:
            f.append(word("men"))
        rows.append(np.unique(f))
        labels.append(toxic)
    y = np.array(labels)
    gap = lambda m: abs((w := dict(zip(m.hashes.tolist(), m.weights.tolist())))[word("women")] - w[word("men")])
    assert gap(toxicity.fit_sample(rows, y)) < 0.5 * gap(toxicity.fit_sample(rows, y, swap=0.0))


def test_toxicity(spark, awkward, empty):
    rows = [(i, _prose(i, 60) + (" you idiot" if i % 4 == 0 else ""), "s") for i in range(300)]
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert all(got[i].predicted == int(i % 4 == 0) and 0 <= got[i].score <= 1 for i in range(300) if got[i].held_out)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(awkward, none).count() == len(AWKWARD) and toxicity.score(empty, none).count() == 0


# --- vectors ---


def test_nn_descent_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1):
        for c in range(30):
            base = rng.standard_normal(16)
            for _ in range(1 if c % 3 else 14):
                rows.append((k, (base + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], None), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] * 16, 0), (k + 5, [None] * 16, 0), (k + 6, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    good = [(i, np.array(v, dtype=np.float64), l) for i, v, l in rows if v and i is not None and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    link = (unit @ unit.T >= 0.93) & (np.array([l for *_, l in good])[:, None] == np.array([l for *_, l in good])[None, :])
    comp = np.arange(len(good))
    for _ in range(len(good)):
        new = np.where(link, comp[None, :], len(good)).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    for i, (vec_id, *_) in enumerate(good):
        assert (got[vec_id].n_links, got[vec_id].component_id) == (link[i].sum() - 1, good[comp[i]][0])
        assert got[vec_id].kept == (got[vec_id].component_id == vec_id)
    assert len(got) == len(rows) and all(got[i].n_links == 0 and got[i].kept for i in range(k + 1, k + 7))
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("enough", [True, False])
def test_nn_descent_between_saturated_families(spark, monkeypatch, enough):
    # inner cosine 0.99, cross cosine 0.95: every list is full of its own family
    dim, size, rows = 128, 40, []
    if not enough:
        monkeypatch.setattr(nndescent, "enough", lambda *_: False)
        monkeypatch.setattr(nndescent, "MOST_ROUNDS", 1)
    for family in range(2):
        for k in range(size):
            v = np.zeros(dim)
            v[0], v[1 + family], v[3 + size * family + k] = np.sqrt(0.95), np.sqrt(0.04), np.sqrt(0.01)
            rows.append((family * size + k, v.tolist(), 1))
    rows += [(100 + k, np.eye(dim)[90 + k].tolist(), 1) for k in range(20)]
    got = {r.vec_id: r for r in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (2 * size - 1, 0, i == 0) for i in range(2 * size))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(100, 120))


def test_nn_descent_finds_separate_pairs_beside_a_dense_family(spark):
    """Recall by vector: a dense family, which has nearly all the links, doesn't hide that pairs are lost."""
    rng = np.random.default_rng(11)
    dim, pairs, family, n = 64, 2000, 400, 12_000
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, dim)))
    cosine = rng.uniform(0.935, 0.97, (pairs, 1))
    away = unit(x[pairs : 2 * pairs] - (x[pairs : 2 * pairs] * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x[pairs : 2 * pairs] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * away
    x[-family:] = unit(unit(rng.standard_normal(dim)) + 0.15 * unit(rng.standard_normal((family, dim))))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in nndescent.near_duplicates(rows).collect()}
    true = (x @ x.T >= 0.93).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= true).all() and (true[-family:] > nndescent.WIDE).all()
    assert (found[-family:] == true[-family:]).all()
    assert found[: 2 * pairs].sum() >= 0.97 * true[: 2 * pairs].sum()
    assert (found[true > 0] / true[true > 0]).mean() >= 0.97


def test_recall_bound():
    assert nndescent.lower_bound(256, 256) > 0.98 and nndescent.lower_bound(0, 0) == 0
    assert nndescent.lower_bound(97, 100) < 0.95 < nndescent.lower_bound(9700, 10_000)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(None, rows[1][1]), (2000, None), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in hamming_topk.of_vectors(df, 5).collect())
    codes = {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v in rows if v and i is not None}
    want = []
    for q in codes:
        if q % 100 == 0:
            near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:5]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert hamming_topk.of_vectors(df.limit(0)).count() == 0


# --- substrings and lines ---


def test_compact_windows_cover_every_subsequence():
    edges = np.array([0, 40, 43, 43, 90])
    g = np.random.default_rng(3).integers(0, 50, 90).astype(np.uint64) << np.uint64(50)
    windows = list(zip(*substring.compact_windows(g, edges, 6)))
    for start, end in zip(edges[:-1], edges[1:]):
        for i in range(start, end):
            for j in range(i + 5, end):
                assert sum(l <= i <= c <= j <= r and g[c] == g[i : j + 1].min() for l, c, r in windows) == 1
    assert all(r - l >= 5 and np.searchsorted(edges, l, side="right") == np.searchsorted(edges, r, side="right") for l, _, r in windows)


def test_signatures_are_the_interval_join():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    rows = []
    for f in range(4):
        g = substring._order(h, f)
        rows += [(f, int(g[c]), int(l), int(c), int(r)) for l, c, r in zip(*substring.compact_windows(g, np.array([0, 400]), 46))]
    rows.sort(key=lambda w: w[3])
    i, key, l, c, r = (np.array(x, dtype=np.uint64 if k == 1 else np.int64) for k, x in enumerate(zip(*rows)))
    got = substring.signatures(np.zeros(len(i), dtype=np.int64), i, key, l, c, r, 46)[2]
    want = []
    for u in rows:
        for v in rows:
            if u[0] < v[0]:
                starts = range(max(u[2], v[2]), min(u[3], v[3]) + 1)
                ends = range(max(u[3], v[3]), min(u[4], v[4]) + 1)
                if len(starts) and len(ends) and ends[-1] - starts[0] >= 45:
                    want.append(u[3])
    assert sorted(got.tolist()) == sorted(want)


def test_substring(spark, awkward, empty):
    passage = [f"p{i}" for i in range(60)]
    near = ["x" if i in (20, 45) else w for i, w in enumerate(passage)]
    rows = [(i, " ".join(_prose(i, 120).split() + (passage if i % 2 else near) + _prose(i + 500, 90).split()), "s") for i in range(12)]
    rows += [(20 + i, _prose(900 + i, 300), "s") for i in range(10)] + [(40, _prose(900, 300), "s")]
    got = substring.near_duplicates(_docs(spark, rows)).collect()
    found = {r.doc_id for r in got} | {r.other_id for r in got}
    assert found == {*range(12), 20, 40}
    assert all(r.start <= 121 and r.end >= 179 for r in got if r.doc_id < 12)
    assert all(r.similarity >= 0.8 for r in got)
    whole = [r for r in got if r.doc_id == 40]
    assert [(r.other_id, r.start, r.end) for r in whole] == [(20, 0, 300)]
    assert substring.near_duplicates(awkward).count() == 0 and substring.near_duplicates(empty).count() == 0


def test_shorter_parts_hide_no_passage(spark):
    """A holds 40 words (too few for a similarity of 0.8 over 50) of the passage that B and C share; every order of text hashes occurs."""
    rows = []
    for k in range(60):
        passage = [f"t{k}x{i}" for i in range(60)]
        part = passage[k % 20 : k % 20 + 40]
        rows += [(3 * k + n, " ".join([*_prose(7000 + 3 * k + n, 70).split(), *words, *_prose(8000 + 3 * k + n, 70).split()]), "s") for n, words in enumerate((part, passage, passage))]
    got = {frozenset((r.doc_id, r.other_id)) for r in substring.near_duplicates(_docs(spark, rows)).collect()}
    want = {frozenset((3 * k + 1, 3 * k + 2)) for k in range(60)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_many_shorter_parts_hide_no_passage(spark):
    """Of the 50 words that B and C share, twenty texts each hold the first and the last 44, so that what is around a place they have in common is in one of these, too."""
    rows, want = [], set()
    for k in range(20):
        passage = [f"t{k}x{i}" for i in range(50)]
        held = [passage[:44], passage[6:]] * 20 + [passage, passage]
        for n, words in enumerate(held):
            own = [f"o{k}y{n}z{i}" for i in range(140)]
            rows.append((42 * k + n, " ".join([*own[:70], *words, *own[70:]]), "s"))
        want.add(frozenset((42 * k + 40, 42 * k + 41)))
    got = {frozenset((r.doc_id, r.other_id)) for r in substring.near_duplicates(_docs(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want), len(got)


def test_substring_recall(spark):
    """Pairs of passages of 50 to 120 words with replaced, dropped or added words, similar by 0.8 or more."""
    rng = np.random.default_rng(21)
    rows, want = [], set()
    for k in range(150):
        n = int(rng.integers(50, 121))
        words = [f"q{k}x{i}" for i in range(n)]
        other = list(words)
        for _ in range(int(rng.integers(0, max(1, n // 50) + 1))):
            at = int(rng.integers(0, len(other)))
            other[at : at + 1] = [["y"], [], [other[at], "y"]][int(rng.integers(0, 3))]
        a, b = substring.tokens_of(pa.array([" ".join(words), " ".join(other)]))[0], None
        a, b = a[: n - 4], a[n - 4 :]
        if len(b) >= 46 and substring._similarity(a, b) >= 0.8:
            want.add(frozenset((2 * k, 2 * k + 1)))
        rows += [(2 * k + m, " ".join([*_prose(5000 + 2 * k + m, 60).split(), *w, *_prose(6000 + 2 * k + m, 60).split()]), "s") for m, w in enumerate((words, other))]
    got = {frozenset((r.doc_id, r.other_id)) for r in substring.near_duplicates(_docs(spark, rows)).collect()}
    assert len(want) > 90 and len(got & want) >= 0.95 * len(want), (len(got & want), len(want))
    assert all(max(p) - min(p) == 1 and min(p) % 2 == 0 for p in got)


def _brute_passage(a, b, least=46, similarity=0.8):
    """Whether any two stretches of 50 words or more are similar enough; equal lengths suffice for replaced words."""
    sets = [[{t[k] for k in range(l, l + n)} for n in (least, len(t)) for l in range(len(t) - n + 1)] for t in (a.tolist(), b.tolist())]
    return any(len(p & q) >= similarity * len(p | q) for p in sets[0] for q in sets[1])


def test_passages_against_brute_force():
    for n in (50, 57, 64, 75, 90):
        words = [f"p{i}" for i in range(n)]
        tokens = lambda w: substring.tokens_of(pa.array([" ".join(w)]))[0]
        a = tokens(words)
        for at in range(n):
            for edit in (["x"], [], [words[at], "x"]):
                b = tokens([*words[:at], *edit, *words[at + 1 :]])
                if len(b) < 46:
                    continue
                anchors = [(i, int(np.flatnonzero(b == h)[0])) for i, h in enumerate(a) if h in b]
                for anchor in (anchors[0], anchors[-1]):
                    got = substring.passages(a, b, [anchor], 46, 0.8)
                    assert bool(got) == _brute_passage(a, b), (n, at, edit, anchor)
                    assert all(s >= 0.8 and min(r - l, r2 - l2) >= 45 for l, r, l2, r2, s in got)
    # an edit every 50 words
    words = [f"p{i}" for i in range(450)]
    a, b = tokens(words), tokens(["x" if i % 50 == 22 else w for i, w in enumerate(words)])
    assert substring.passages(a, b, [(100, 100)], 46, 0.8)[0][:4] == (0, 445, 0, 445)


def _brute_lines(rows):
    h = lambda s: hashlib.md5(s.encode()).hexdigest()
    parts = []
    for n, (i, t) in enumerate(rows):
        if t is None:
            continue
        lines = t.split("\n")
        r = [h((h(lines[k - 1]) if k else "") + h(x)) for k, x in enumerate(lines)]
        start, no = 0, 0
        for k in range(len(lines)):
            low = 0 < k < len(lines) - 1 and r[k] < r[k - 1] and r[k] < r[k + 1]
            if low or k == len(lines) - 1:
                parts.append((i, n, no, lines[start : k + 1]))
                start, no = k + 1, no + 1
    seen, out = set(), {n: [] for n, (_, t) in enumerate(rows) if t is not None}
    for _, n, no, lines in sorted(parts, key=lambda p: (p[0], p[2])):
        key = "\n".join(lines)
        if len(lines) < 2 or key not in seen:
            out[n] += [(no, x) for x in lines]
        if len(lines) >= 2:
            seen.add(key)
    return {n: "\n".join(x for _, x in sorted(v, key=lambda p: p[0])) for n, v in out.items()}


def test_lines_against_brute_force(spark, awkward, empty):
    rng = np.random.default_rng(4)
    shared = [f"shared line {i}" for i in range(30)]
    rows = []
    for i in range(25):
        own = [f"own {i} {k}" for k in range(int(rng.integers(1, 12)))]
        rows.append((i, "\n".join(own[:4] + (shared if i % 3 else shared[5:20]) + own[4:])))
    rows += [(30, rows[2][1]), (31, "a\na\na\na"), (32, ""), (33, None), (34, "\n\n")]
    got = {r.doc_id: r.text for r in linededup.dedup(_docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    want = _brute_lines(rows)
    assert got == {i: want.get(n) for n, (i, _) in enumerate(rows)}
    out = linededup.dedup(awkward)
    assert out.count() == len(AWKWARD) and out.columns == [*awkward.columns, "n_lines", "n_removed"] and linededup.dedup(empty).count() == 0


# --- mixing ---


def test_targets_and_routes():
    t = mixing.targets({"a": 100, "b": 10, None: 40})
    assert t["b"] == 30.0 and abs(t["a"] + t["b"] + t[None] - 150) < 1e-9 and t["a"] / t[None] == 5.0
    f = mixing.route({("a",): 50, ("a", "b"): 50, ("b",): 10}, {"a": 60.0, "b": 50.0})
    assert abs(sum(f.values()) - 110) < 1e-3 and all(f[p] <= 3 * s for p, s in {("a",): 50, ("a", "b"): 50, ("b",): 10}.items())


def test_mixing(spark, awkward, empty):
    rng = np.random.default_rng(9)
    rows = [(i, _prose(i, int(rng.integers(5, 60))), ("a", "b", "c", None)[0 if i % 3 else i % 4]) for i in range(600)]
    docs = _docs(spark, rows)
    got = mixing.by_source(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.by_source(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == 600
    source = {i: s for i, _, s in rows}
    for s in ("a", "b", "c", None):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and own[0].source_size == sum(r.size for r in own)
    assert all(r.taken <= 3 * r.size for r in got)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and sum(len(r.text.split()) for r in taken.collect()) == sum(again.values())
    assert mixing.by_source(awkward).count() == len(AWKWARD) and mixing.by_source(empty).count() == 0 and mixing.take(empty).count() == 0


# --- packing ---


def test_best_cuts_against_plain_dynamic_programming():
    rng = np.random.default_rng(11)
    where = np.cumsum(rng.integers(1, 20, 60))
    penalty = rng.choice([0.0, 8.0, 48.0], 60)
    size = 64
    pos = [0, *where.tolist()]
    f = [0.0] + [1e18] * 60
    for j in range(1, 61):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                pad = size - n
                if n in (8, 16, 32):
                    pad = min(pad, packing.SHORT)
                f[j] = min(f[j], f[i] + pad + penalty[j - 1])
    cuts = packing.best_cuts(where, penalty, size)
    cost, a, pen = 0.0, 0, dict(zip(where.tolist(), penalty.tolist()))
    for b in cuts:
        n = b - a
        cost += (min(size - n, packing.SHORT) if n in (8, 16, 32) else size - n) + pen[b]
        a = b
    assert cuts[-1] == where[-1] and abs(cost - f[60]) < 1e-9


def test_packing_round_trip(spark, awkward, empty):
    from tokenizers import Tokenizer

    path = packing.public_vocabulary()
    t = Tokenizer.from_file(path)
    rows = AWKWARD + [(100 + i, f"It's {_prose(i, 40)}. <|endoftext|> don't! Ünï éx 123abc...", "s") for i in range(20)]
    docs = _docs(spark, rows)
    pieces = packing.pack(docs, path, chars=60_000).collect()
    want = sorted(np.append(t.encode(x or "", add_special_tokens=False).ids, 1).astype("<u4").tobytes() for _, x, _ in rows)
    whole, sequences = {}, {}
    for p in pieces:
        n = len(p.ids) // 4
        sequences.setdefault(p.sequence_id, []).append((p.offset, n))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id or 0, p.sequence_id, p.offset)):
        if p.start == 0:
            whole.setdefault("done", []).append(bytearray())
        whole["done"][-1] += p.ids
    assert sorted(bytes(x) for x in whole["done"]) == want
    tokens = sum(len(w) // 4 for w in want)
    assert sum(packing.padding(sum(n for _, n in s)) for s in sequences.values()) < 0.05 * tokens
    d = packing.digest(packing.pack(docs, path, chars=60_000)).collect()
    assert {(p.start, zlib.crc32(p.ids)) for p in pieces} == {(r.start, r.ids_crc32) for r in d}
    assert packing.pack(empty, path).count() == 0


def test_packing_is_the_same_each_time(spark):
    path = packing.public_vocabulary()
    rows = [(i % 250 if i % 7 else None, _prose(i, 30), "s") for i in range(400)] + [(9, "the same row", "s")] * 40
    docs = _docs(spark, rows)
    runs = []
    try:
        for n in ("4", "7", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append(sorted(map(str, packing.digest(packing.pack(docs.repartition(int(n)), path, chars=9_000)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1] == runs[2] and len({r.split("sequence_id=")[1].split(",")[0] for r in runs[0]}) > 5


# --- personal data ---


def _brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_against_plain_patterns():
    rng = np.random.default_rng(13)
    signs = list("aB@@..%x-+ 0123456789()")
    for _ in range(3000):
        text = "".join(rng.choice(signs, int(rng.integers(0, 60))))
        assert [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["kind"] in pii.BASE] == _brute_base(text)


def test_pii(spark, awkward, empty):
    text = "Éa mail a.b@c.example.org, card 4111 1111 1111 1111, host 10.0.0.256 or 10.0.0.25, call +1 (202) 555-0143, IBAN GB82 WEST 1234 5698 7654 32, GB82 WEST 1234 5698 7654 33, ssn 123-45-6789, 123-45-6789"
    docs = _docs(spark, [(1, text, "s")])
    r = pii.digest(pii.find(docs)).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in _brute_base(text))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
    assert r.spans.count("iban") == 1 and "ssn" in r.spans
    assert "[IBAN]" in pii.redact(docs).first().text and "4111" not in pii.redact(docs).first().text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")
    assert pii.spans_of("9" * 200_000 + "." * 3 + "a" * 200_000) == []
    assert pii.find(awkward).count() == len(AWKWARD) and pii.find(empty).count() == 0


def test_word_tokens_equal_the_tokenizer():
    """Every letter beyond ASCII before and inside punctuation, contractions, digits, blanks of any kind."""
    from tokenizers import Tokenizer

    path = packing.public_vocabulary()
    t, own = Tokenizer.from_file(path), packing.WordTokens(path)
    letters = [chr(c) for c in [*range(0x80, 0x3000), *range(0xA640, 0xAC10), *range(0xF900, 0xFFFD), *range(0x1D400, 0x1D500)] if chr(c).isalpha()]
    texts = [f"{c}? {c}!x{c}. a{c}b! {c}{c}, {c}'s" for c in letters]
    rng = np.random.default_rng(3)
    signs = list("ab Z9.,!?'\n\t\x0b\x1c\x85\xa0́İΣς<|>") + ["<|endoftext|>", "'ll", "don't"]
    texts += ["".join(rng.choice(signs, 30)) for _ in range(2000)] + ["", None, "  ", " a", "a "]
    ids, n = own.encode_all(pa.array(texts, pa.string()))
    want = [np.array(e.ids, dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert (ids == np.concatenate(want)).all()


def test_windows_do_not_depend_on_how_texts_arrive():
    rng = np.random.default_rng(5)
    ends_sentence = np.zeros(100, dtype=bool)
    ends_sentence[7] = True
    sizes = rng.integers(1, 400, 300)
    docs = [np.append(rng.choice(100, n - 1, p=[0.05 if k == 7 else 0.95 / 99 for k in range(100)]), 1).astype("<u4") for n in sizes]

    def cuts(step):
        stream, out = packing.Stream(ends_sentence, 256, 0), []
        for k in range(0, len(docs), step):
            part = docs[k : k + step]
            stream.add(np.concatenate(part), list(range(k, k + len(part))), np.array([len(d) for d in part]))
            out += stream.windows(last=False).to_pylist()
        return out + stream.windows(last=True).to_pylist()

    whole = cuts(len(docs))
    assert cuts(1) == cuts(17) == whole
    assert b"".join(p["ids"] for p in whole) == np.concatenate(docs).tobytes()


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200] * 4, 1), (2, [2e200] * 4, 1), (3, [3e-200] * 4, 1), (4, [1e200, -1e200, 1.0, 1.0], 1), (5, [1.0] * 4, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_ordinal_likelihood_gradient():
    """The fit is where the plain likelihood, written out, has no slope."""
    rng = np.random.default_rng(4)
    rows = [np.array([int(g) * 5 + int(rng.integers(0, 3)), 50 + int(rng.integers(0, 6))]) for g in rng.integers(0, 3, 300)]
    grades = np.array([min(2, max(0, int(r[0]) // 5 + int(rng.integers(-1, 2)) * int(rng.random() < 0.3))) for r in rows])
    m = quality.fit_sample(rows, grades)
    place = {h: k for k, h in enumerate(m.hashes.tolist())}
    x = np.zeros((len(rows), len(place)))
    for n, r in enumerate(rows):
        for f in r.tolist():
            if f in place:
                x[n, place[f]] = 1
    scale = np.max([quality.tf.contrast(quality.tf.Sparse(rows), grades > j) for j in range(2)], axis=0)

    def loss(w, t):
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        above = lambda k: 1 / (1 + np.exp(edge[k] - x @ w))
        ok = scale > 1e-9
        return -np.log(above(grades) - above(grades + 1)).sum() + 0.5 * ((w[ok] / scale[ok]) ** 2).sum()

    best = loss(m.weights, m.thresholds)
    for k in range(len(place)):
        for d in (-0.02, 0.02):
            w = m.weights.copy()
            w[k] += d * scale[k]
            assert loss(w, m.thresholds) >= best - 1e-4
    for k in range(2):
        for d in (-0.02, 0.02):
            t = m.thresholds.copy()
            t[k] += d
            assert loss(m.weights, t) >= best - 1e-4


def test_flow_against_brute_force():
    """Cheapest routing of small overlapping patterns, over all amounts in whole steps."""
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(25):
        patterns = {("a",): int(rng.integers(1, 4)), ("a", "b"): int(rng.integers(1, 4)), ("b", "c"): int(rng.integers(1, 3))}
        quotas = {s: float(rng.integers(0, 6)) for s in "abc"}
        flow = mixing.route(patterns, quotas)
        cost = lambda p, n: sum(c * min(max(n - k * patterns[p], 0), patterns[p]) for k, c in enumerate(mixing.REPEAT_COST))
        best = None
        for to in itertools.product(*[range(3 * patterns[p] + 1) for p in patterns for _ in p]):
            amounts, at, into = {}, 0, dict.fromkeys("abc", 0)
            for p in patterns:
                amounts[p] = sum(to[at : at + len(p)])
                for s, n in zip(p, to[at : at + len(p)]):
                    into[s] += n
                at += len(p)
            if all(amounts[p] <= 3 * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in "abc"):
                value = (-sum(amounts.values()), sum(cost(p, n) for p, n in amounts.items()))
                best = value if best is None else min(best, value)
        assert (-sum(flow[p] for p in patterns), sum(cost(p, flow[p]) for p in patterns)) == pytest.approx(best, abs=1e-4)


def test_amounts_by_connected_parts():
    """The flow of all patterns at once, and that of each connected part by itself, take as much of each source and cost the same."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        patterns = {(s,): int(rng.integers(1, 50)) for s in "abcdef"} | {("a", "b"): 20, ("d", "e"): 10}
        quotas = {s: float(rng.integers(0, 200)) for s in "abcdef"}
        whole, parts = mixing.route(patterns, quotas), mixing.amounts(patterns, quotas)
        cost = lambda f: sum(c * min(max(f[p] - k * n, 0), n) for p, n in patterns.items() for k, c in enumerate(mixing.REPEAT_COST))
        assert sum(parts[p] for p in patterns) == pytest.approx(sum(whole[p] for p in patterns)) and cost(parts) == pytest.approx(cost(whole), abs=1e-3)
        assert all(parts[p] == pytest.approx(whole[p], abs=1e-3) for p in (("c",), ("f",)))


def test_mix_of_many_sources(spark):
    """A source for every document, over 20,000 of them: no flow, no error."""
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit("one two three").alias("text"))
    r = mixing.by_source(docs).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.sum("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).first()
    assert r.n == 25_000 and r.target == pytest.approx(75_000) and r.most <= 3 and r.taken > 0


def test_toxic_loss_against_brute_force():
    """Without a penalty the fit is the plain logistic one; with it, swapped mentions score alike."""
    rng = np.random.default_rng(9)
    word = lambda w: toxicity.tf._hash("w", w)
    rows, labels = [], []
    for _ in range(400):
        toxic = int(rng.random() < 0.4)
        f = {word("bad" if toxic and rng.random() < 0.7 else "good"), word(f"n{rng.integers(0, 9)}")}
        if rng.random() < 0.5:
            f.add(word("muslim" if rng.random() < (0.9 if toxic else 0.2) else "christian"))
        rows.append(np.array(sorted(f)))
        labels.append(toxic)
    change = {}
    for swap in (0.0, 50.0):
        m = toxicity.fit_sample(rows, np.array(labels), swap=swap)
        w = dict(zip(m.hashes.tolist(), m.weights.tolist()))
        neutral = m.bias + w[word("good")]
        change[swap] = abs(w[word("muslim")] - w[word("christian")])
        false_positives = 1 / (1 + np.exp(-(neutral + w[word("muslim")])))
        change[swap, "p"] = false_positives
    assert change[50.0] < 0.2 * change[0.0] and change[50.0, "p"] < change[0.0, "p"]


def test_word_hashes_tell_words_not_places():
    words = ["the", "THE", "Eth", "é", "É", "a" * 5000, "b" + "a" * 4999, "aa", "a", "\u00a0"]
    alone = [int(substring.word_hashes(pa.array([w]))[0][0]) for w in words]
    text = "\x0b " + " \t".join(words) + " "
    h, edges = substring.word_hashes(pa.array(["", "other words", text, None, text]))
    assert edges.tolist() == [0, 0, 2, 12, 12, 22]
    assert h[2:12].tolist() == alone == h[12:].tolist()
    assert alone[0] == alone[1] and len(set(alone)) == len(words) - 1
