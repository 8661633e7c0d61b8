"""Decontamination, whitening and clustering against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import centroids, decontaminate, vectors, whiten

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_scan(docs, items, n):
    grams = {}
    for item, text in items:
        w = WORDS.findall(low(text))
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else ():
            grams.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORDS.findall(low(text)), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                g = tuple(w[i : i + size])
                if g in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[g]
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and then it sleeps for hours"), (2, "One Two three"), (3, ""), (4, None), (5, "été déjà vu"), (6, "..."), (12, "one two THREE"), (None, "nobody owns these words"),
    (7, "a a a a a a a a a a a a"), (2, "one two four"), (8, "x" * 300 + " y"), (9, "single"),
]
DOCS = [
    (1, "He said: The quick brown fox, jumps over THE lazy dog and then it sleeps for hours! Yes."), (2, "one two"), (3, None), (4, ""), (5, "one, two; three one two three"), (6, "été déjà vu encore"), (7, "a " * 25),
    (1, "another text with the same id, one two four"), (1, "another text with the same id, one two four"), (None, "nobody owns these words today"), (None, "clean words here"), (8, "X" * 300 + "  Y"), (9, "K single İ"),
    (10, "the quick brown fox jumps over the lazy dog and"), (11, "one-two_three"), (13, "x1 one\x00two\nthree 2"), (14, "brown fox jumps over the lazy dog and then it sleeps for days"), (15, "  \t\n"),
]


@pytest.mark.parametrize("n, most", [(10, 64 << 20), (3, 64 << 20), (10, 2000)])
def test_decontamination_equals_brute_force(spark, n, most):
    docs = spark.createDataFrame([(*d, "w", 5) for d in DOCS], "doc_id long, text string, w string, at int").repartition(3)
    items = spark.createDataFrame([(*i, "gram") for i in ITEMS], "item_id long, text string, gram string")
    got = decontaminate.scan(docs, items, n, broadcast_bytes=most).collect()
    assert sorted([(r.doc_id, r.n_words, r.hit_words, r["items"]) for r in got], key=str) == brute_scan(DOCS, ITEMS, n)


def test_only_bounded_parts_are_broadcast(spark):
    items = spark.createDataFrame([(i, f"word{i} and some more") for i in range(6)] + [(9, "y" * 5000)], "item_id long, text string")
    windows = decontaminate.test_windows(items)
    sizes, parts = decontaminate.parts_of(windows, 1000)
    assert sizes == [1, 4] and 1 < len(parts) <= 7 and sum(p.count() for p in parts) == 7
    marked = ["broadcast" in p._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in p._jdf.queryExecution().analyzed().toString() for p in parts]
    assert marked.count(False) == 1  # the part with the giant word


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert all(r.hit_words == [] and r["items"] == [] for r in decontaminate.scan(docs, items.limit(0)).collect())
    assert decontaminate.scan(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.scan(docs.limit(0), items).count() == 0


def test_removal(spark):
    rows = [(*d, "kept", 7) for d in DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, hit_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    hits = {(d, t): h for (d, t), (_, _, h, _) in zip(sorted(DOCS, key=str), [x for d in sorted(DOCS, key=str) for x in brute_scan([d], ITEMS, 10)])}
    want = []
    for d, t, *rest in rows:
        if t is not None and hits[(d, t)]:
            pieces = list(re.finditer(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t))
            t = "".join(p.group() for i, p in enumerate(pieces) if i not in hits[(d, t)]) + t[pieces[-1].end() :]
        want.append((d, t, *rest))
    cut = decontaminate.decontaminate(docs, items)
    assert cut.columns == docs.columns
    assert Counter(map(tuple, cut.collect())) == Counter(want)
    kept = decontaminate.decontaminate(docs, items, "documents")
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if not hits[r[:2]])
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, "lines")


def ragged(rng, d, n):
    """Vectors in clusters, with repeated, null, ragged and non-finite ones."""
    rows = [(rng.normal(size=d) * np.linspace(2, 0.2, d) + rng.integers(0, 3)).tolist() for _ in range(n)]
    rows += [rows[0]] * 5 + [rows[1]] * 3 + [None, [], [1.0], [float("nan")] + [0.0] * (d - 1), [float("inf")] * d, [None] + [0.0] * (d - 1), [0.0] * d, [-0.0] * d, [1e-300] * d]
    return [(i % (n - 7) if i % 50 else None, v, 1, "x") for i, v in enumerate(rows)]


def quantised(rows, d):
    good = [(i, v) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    return [i for i, _ in good], np.floor(256 * np.array([v for _, v in good])).astype(np.int64).reshape(-1, d)


def brute_whitening(x, k):
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(0)
    c = f - s / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("d", [2, 5, 16])
def test_whitening_equals_eigenvectors(spark, d):
    rows = ragged(np.random.default_rng(d), d, 120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, q string").repartition(4)
    k = min(4, d)
    got = whiten.whiten(df).collect()
    ids, x = quantised(rows, d)
    n, deviation, want, explained = brute_whitening(x, k)
    assert len(got) == len(x) * k and {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-9
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, deviation.tolist()))
    for j in range(k):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == j + 1)
        for sign in (1, -1):
            theirs = sorted((str(i), int(a), sign * float(b)) for i, a, b in zip(ids, deviation, want[:, j]))
            if np.allclose([m[2] for m in mine], [t[2] for t in theirs], atol=1e-8):
                break
        else:
            pytest.fail(f"component {j + 1}")
        assert abs({r.explained for r in got if r.component == j + 1}.pop() - explained[j]) < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert whiten.whiten(frame([])).count() == 0
    assert whiten.whiten(frame([(1, None), (2, [])])).count() == 0
    assert whiten.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one vector, twice
    line = whiten.whiten(frame([(1, [1.0, 1.0, 0.0]), (2, [2.0, 2.0, 0.0]), (3, [5.0, 5.0, 0.0])])).collect()
    assert {r.component for r in line} == {1} and len(line) == 3
    with pytest.raises(Exception, match="beyond"):
        whiten.whiten(frame([(1, [1e300, 0.0]), (2, [0.0, 0.0])])).count()


def test_bidiagonalisation_finds_equal_singular_values():
    """Repeated singular values, and fewer rows than columns: every direction is found."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 8)))
    p, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    for values in ([5, 5, 5, 3, 3, 1, 0, 0], [2] * 8, [7, 1e-3, 0, 0, 0, 0, 0, 0], [9, 8, 7, 6, 5, 4, 3, 2]):
        x = q * values @ p.T

        def sweep(ys, y, x=x):
            z = x @ y
            return (x @ ys).T @ z, float(z @ z), x.T @ z

        v, b = whiten.bidiagonalise(sweep, 8, 4)
        assert np.abs(v.T @ v - np.eye(8)).max() < 1e-12
        assert np.abs(np.linalg.svd(b)[1] - values).max() < 1e-10
        assert np.abs(np.linalg.svd(x @ v)[1] - values).max() < 1e-10


def test_early_end_beyond_complete_dimensions(monkeypatch):
    monkeypatch.setattr(whiten, "COMPLETE", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 60)) * np.geomspace(100, 0.01, 60)
    swept = []

    def sweep(ys, y):
        z = x @ y
        swept.append(1)
        return (x @ ys).T @ z, float(z @ z), x.T @ z

    v, b = whiten.bidiagonalise(sweep, 60, 4)
    _, s, right = np.linalg.svd(b)
    _, want, axes = np.linalg.svd(x)
    assert len(swept) < 50 and np.abs(s[:4] / want[:4] - 1).max() < 1e-12
    assert np.abs(np.abs(np.sum((v @ right[:4].T) * axes[:4].T, 0)) - 1).max() < 1e-12


def brute_clusters(rows, d, k, rounds):
    ids, x = quantised(rows, d)
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in zip(ids, x) if i is not None)
    c = np.array([v for _, v in named[:k]])
    for r in range(rounds + 1):
        dist = ((x[:, None, :] - c[None]) ** 2).sum(2)
        a = dist.argmin(1)
        if r < rounds:
            for j in set(a.tolist()):
                c[j] = x[a == j].sum(0) // (a == j).sum()
    best = dist.min(1)
    name = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return Counter((i, int(j), int(b), int(best[a == j].sum()), int(best.sum()), name[j]) for i, j, b in zip(ids, a, best))


@pytest.mark.parametrize("d, k", [(16, 12), (16, 200), (4, 6)])
def test_clusters_equal_brute_force(spark, d, k):
    rows = ragged(np.random.default_rng(d + k), d, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, ids string").repartition(4)
    got = centroids.cluster(df, k=k, d=d)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, d, k, 5)


def test_clusters_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0]), (2, None)], schema)).count() == 0
    same = centroids.cluster(spark.createDataFrame([(i, [0.5] * 64) for i in range(60)], schema)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)} and len(same) == 60  # ties go to the first centroid


def test_bounds_filter_and_keep_the_nearest():
    """On clustered data most pairs are never measured, and the nearest centroid is always among those that are."""
    rng = np.random.default_rng(2)
    centres = (rng.normal(size=(40, 6)) @ rng.normal(size=(6, 64)) * 150).astype(np.int64)  # the centres lie in few dimensions, as those of embeddings do
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, size=(3000, 64))).astype(np.int64)
    c = np.unique(x[:40], axis=0)
    mean = x.mean(0)
    lead = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, : centroids.LEADING]
    p, rest = centroids.filters(x, mean, lead)
    cp, crest = centroids.filters(c, mean, lead)
    cluster, dist, measured = centroids.nearest(x, p, rest, c, cp, crest)
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (dist == every.min(1)).all()
    assert measured < 0.25 * every.size


def test_packed_vectors_keep_their_values():
    for limit in (3, 300, 70_000, 1 << 40):
        x = np.array([[limit, -limit], [0, 1]], np.int64)
        assert (vectors.unpack(*vectors.pack(x), 2) == x).all()
