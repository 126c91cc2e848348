"""Ranked search, exact top-k and whitening against plain Python and numpy, with nulls, ties, repeated and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from notelake.llm import cover_trees, ranked_search, whitening

FIRST = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k):
    """(item, rank, doc_id, score) by scoring every document."""
    found = [(i, Counter(FIRST.findall(lower(t)))) for i, t in docs]
    n = sum(1 for _, c in found if c)
    length = sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 10 + 90 * c.total() * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(FIRST.findall(lower(text))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = ["The", "of", "straße", "Élan", "x1", "東京", "a-b", "naïve"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words[:20]) if r.random() < 0.7 else r.choice(words) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 20, 60]))) for i in range(400)]
    docs += [(1000 + i, "The same words of straße w3 w4") for i in range(300)]  # ties
    docs += [(None, text(10)), (None, None), (7, text(12)), (2000, ""), (2001, " \n?!"), (2002, text(30000)), (-5, text(20))]
    r.shuffle(docs)
    items = [(i, text(12)) for i in range(12)] + [(20, "the OF straße w3"), (21, ""), (22, None), (23, "nowhere met"), (None, "w1 w2"), (24, "of of of w5")]
    return docs, items


@pytest.mark.parametrize(("rows", "head", "passes"), [(4096, 64, 2048), (50, 2, 3)])
def test_ranked_search(spark, corpus, monkeypatch, rows, head, passes):
    for name, value in (("BLOCK_ROWS", rows), ("HEAD", head), ("PASS_ROWS", passes)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")
    got = ranked_search.search(ranked_search.Index(d), q, 10).collect()
    assert Counter(tuple(r) for r in got) == ranked(docs, items, 10)
    assert ranked_search.search(ranked_search.Index(d.limit(0)), q, 10).count() == 0
    assert ranked_search.search(ranked_search.Index(d), q.limit(0), 10).count() == 0


def test_intervals_end_when_all_is_settled():
    """Reading stops before lists end where a few documents are far ahead, and never before ties are settled."""
    r = np.random.default_rng(2)
    for _ in range(200):
        size, many, k = int(r.integers(1, 300)), int(r.integers(1, 8)), int(r.integers(1, 12))
        lists, scores = [], np.zeros(size, dtype=np.int64)
        weights = r.integers(1, 50, many)
        for w in weights:
            docs = r.permutation(size)[: r.integers(1, size + 1)]
            shares = np.sort(r.integers(1, 6 if r.random() < 0.5 else 1000, len(docs)))[::-1]
            lists.append((docs, shares))
            scores[docs] += w * shares
        floor = int(np.sort(scores)[-k]) - 3 if size >= k and r.random() < 0.5 else 0
        docs, found = ranked_search.nra(lists, weights, size, k, floor)
        least = max(np.sort(scores)[-k] if size >= k else 1, 1)
        assert set(np.flatnonzero(scores >= least)) <= set(docs) and (scores[docs] == found).all()


class Deep(np.ndarray):
    """An array that notes how far it was read."""

    deepest = 0

    def __getitem__(self, key):
        if isinstance(key, slice) and key.stop:
            Deep.deepest = max(Deep.deepest, key.stop)
        return np.asarray(super().__getitem__(key)) if isinstance(key, slice) else super().__getitem__(key)


def test_lists_arent_read_to_their_ends():
    n = 40_000
    shares = np.concatenate([np.full(10, 10_000), np.arange(n - 10, 0, -1) % 100]).astype(np.int64)
    shares = np.sort(shares)[::-1].view(Deep)
    docs = np.arange(n)
    Deep.deepest = 0
    found, _ = ranked_search.nra([(docs, shares), (docs, shares)], np.array([3, 5]), n, 10, 0)
    assert sorted(found) == list(range(10)) and Deep.deepest <= 4 * ranked_search.HEAD


# ---------------------------------------------------------------- exact top-k


def nearest(rows, k=10):
    """(query_id, rank, vec_id, score) of all rows with usable vectors, each but itself."""
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, (i, x) in enumerate(good):
        if i is not None and i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0) for p, (j, y) in enumerate(good) if p != q and len(y) == len(x))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return Counter(out)


def vectors(r, n):
    near = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(near)]) for i in range(n)]
    rows += [(5000 + i, [0.5] * 6) for i in range(n // 2)]  # copies
    odd = [(100, None), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (300, [math.nan] * 6), (400, [math.inf] + [0.0] * 5), (None, near[0]), (None, near[1])]
    return rows + odd + [(500, [2.0, -1.0]), (501, [1.0, 1.0]), (9000, []), (9100, []), (0, near[2]), (-200, [-1e-9] * 6), (600, [0.0] * 6)]


@pytest.mark.parametrize(("part", "asked", "leaf"), [(2048, 512, 32), (64, 8, 4)])
def test_dual_trees(spark, monkeypatch, part, asked, leaf):
    monkeypatch.setattr(cover_trees, "PART", part)
    monkeypatch.setattr(cover_trees, "ASKED_PART", asked)
    monkeypatch.setattr(cover_trees.Tree.__init__, "__defaults__", (leaf,))
    rows = vectors(random.Random(9), 900)
    df = spark.createDataFrame([(i, v, 3, "p") for i, v in rows], "vec_id long, embedding array<double>, row int, part string")
    from pyspark.sql import functions as F

    got = cover_trees.top_k(df.repartition(3), F.col("vec_id") % 100 == 0).collect()
    assert Counter(tuple(r) for r in got) == nearest(rows)
    assert cover_trees.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def packed(x, rows, leaf):
    t = cover_trees.Tree(x[rows], leaf)
    own = rows[t.order]
    for i, centre in enumerate(t.point):
        below = x[rows][t.order[t.begin[i] : t.end[i]]]
        assert np.sqrt(((below - x[rows][centre]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9
        if kids := range(t.kids_from[i], t.kids_to[i]):
            assert [t.begin[i], *(t.end[c] for c in kids)] == [*(t.begin[c] for c in kids), t.end[i]]
    return cover_trees.Part(dict(row=own.tolist(), id=own.tolist(), size=x.shape[1], x=x[own].astype("<i8").tobytes(), begin=t.begin, end=t.end, point=np.argsort(t.order)[np.array(t.point)], radii=t.radius, kids_from=t.kids_from, kids_to=t.kids_to), "")


def test_trees_cover_and_prune(monkeypatch):
    r = np.random.default_rng(4)
    looked = []
    monkeypatch.setattr(cover_trees, "products", lambda a, b, real=cover_trees.products: (looked.append(len(a) * len(b)), real(a, b))[1])
    centres = r.normal(size=(40, 8)) * 2000
    x = (centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 8)) * 20).astype(np.int64)
    queries = np.arange(0, 4000, 20)
    asked, held = packed(x, queries, 16), packed(x, np.arange(4000), 32)
    q, p, s = cover_trees.dual(asked, held, 10, {})
    scores = x[asked.row] @ x.T
    scores[np.arange(len(queries)), asked.row] = -(1 << 60)
    for i in range(len(queries)):
        want = np.lexsort((np.arange(4000), -scores[i]))[:10]
        assert held.row[p[q == i]].tolist() == want.tolist() and s[q == i].tolist() == scores[i][want].tolist()
    assert sum(looked) < 0.5 * len(queries) * 4000  # most pairs of leaves are pruned


def test_products_beyond_doubles_are_exact():
    a = np.array([[(1 << 30) + 1, 3]], dtype=np.int64)
    assert cover_trees.products(a, a)[0, 0] == ((1 << 30) + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        cover_trees.products(a << 20, a << 20)


# ---------------------------------------------------------------- whitening


def entries(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(Counter(len(v) for _, v in good).items(), key=lambda x: (x[1], x[0]))[0]
    return [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good if len(v) == size]


@pytest.mark.parametrize("block", [8192, 7])
def test_whitening(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    r = random.Random(6)
    base = [[r.gauss(0, 3) for _ in range(20)] for _ in range(20)]
    rows = [(i, [sum(a * b for a, b in zip(w, c, strict=True)) for c in base]) for i, w in enumerate([[r.gauss(0, 1) for _ in range(20)] for _ in range(150)])]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]
    rows += [(5, None), (6, [math.nan] * 20), (7, [1.0]), (None, rows[4][1]), (8, [None] * 20)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, x int")
    got = whitening.whitened(df.repartition(3)).toPandas()
    kept = entries(rows)
    fit = np.array(sorted({x for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:16], axes[:, ::-1][:, :16]
    assert len(got) == 16 * len(kept) and set(got.n) == {n} and got.identity_error.max() < 1e-8
    assert Counter(zip(got.vec_id.astype(object).where(got.vec_id.notna(), None), got.deviation, strict=True)) == Counter({k: 16 * v for k, v in Counter((i, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept).items()})
    one = {i: np.array(x) - sums / n for i, x in kept if i is not None}
    for i in (0, 3, 1000, 1079, 149):
        mine = got[got.vec_id == i].sort_values("component")
        assert np.allclose(np.abs(mine.whitened), np.abs(one[i] @ axes / np.sqrt(e)), atol=1e-6)
        assert np.allclose(mine.explained, e / np.trace(centred.T @ centred / n), rtol=1e-8)
    for odd in ("vec_id < 0", "vec_id = 5", "vec_id = 0"):  # none, only a null, a single vector
        assert whitening.whitened(df.where(odd)).count() == 0


@pytest.mark.parametrize("kind", ["equal", "rank", "constant", "steep", "few"])
def test_bidiagonalisation_of_odd_spectra(kind):
    r = np.random.default_rng(1)
    x = {
        "equal": np.vstack([np.eye(20), -np.eye(20)]) * 64, "rank": (r.normal(size=(500, 5)) * 8).round() @ r.integers(-2, 3, (5, 20)), "constant": np.ones((5, 4)),
        "steep": r.normal(size=(2000, 30)) * np.logspace(3, 0, 30), "few": r.normal(size=(5, 64)) * 8,
    }[kind]

    class Local(whitening.Rows):
        def __init__(self, x):
            self.x = np.unique(np.floor(x).astype(np.int64), axis=0)
            (self.n, self.d), self.sums = self.x.shape, self.x.sum(0)
            self.mean = self.sums / self.n

        def total(self, of):
            return of(self.x - self.mean)

    rows = Local(x)
    axes, e = whitening.components(rows)
    v = (rows.x - rows.mean).T @ (rows.x - rows.mean) / rows.n
    scale = max(np.abs(v).max(), 1e-9)
    assert np.allclose(v @ axes, axes * e, atol=1e-10 * scale) and np.allclose(axes.T @ axes, np.eye(rows.d), atol=1e-10)
    assert np.allclose(np.sort(np.linalg.eigvalsh(v))[::-1], e, atol=1e-10 * scale)
