"""Operators on pages and embeddings, components, and the pipeline."""

import random

import numpy as np
import pytest

from quillmark.llm import embed, topk, urls
from quillmark.llm.components import connected_components

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/en/x", "block"), ("example.net", "/en/", "block")]


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_verdicts(spark):
    hosts = ["net", "example.net", "a.example.net", "b.a.Example.NET", "xexample.net", "example.com", "w.example.com", "org", "x.org", "notorg", "", "net.", "..net", "ünet", "\U0010ffff.net"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/de/1?q=/en/", "/fr/#x", "?a=/", "#/"]
    rows = [(i, f"http://{h}{p}", "h", "k") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(1000, None, "h", "k"), (1001, "", "h", "k"), (1002, "net/en/", "h", "k"), (None, "http://net/", "h", "k"), (1003, "a://b://net/", "h", "k"), (0, "http://net", "h", "k"), (1004, "http://net/\nx", "h", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string").repartition(3)
    rules = urls.rules_table(spark, RULES)
    got = sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, slices=5).collect()]))
    assert got == sorted(map(str, [(r[0], *brute_verdict(r[1], RULES)) for r in rows]))
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(8):
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * 0.12).tolist() for _ in range(12)]
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, None, [], [None] + [1.0] * 7, [1.0, 2.0], [1.0, 2.1], [1e300] * 8, [1e-300] * 8]
    return [(i, v, None, "x") for i, v in enumerate(rows)]


def test_embedding_links(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, home string").repartition(3)
    unit = {}
    for i, v, *_ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v) / np.abs(v).max()
            unit[i] = a / np.linalg.norm(a)
    links = {i: {j for j in unit if j != i and i in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i, *_ in rows}
    comp = {i: i for i, *_ in rows}
    for _ in rows:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    for per_cell, block in ((500, 2048), (5, 4)):
        got = embed.near_duplicates(df, rows_per_cell=per_cell, block=block).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (len(links[i]), comp[i], comp[i] == i) for i in comp}
    assert sum(map(len, links.values())) > 100
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_in_few_of_many_dimensions(spark):
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(64, 3)))[0]
    x = rng.normal(size=(1500, 3)) @ basis.T
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.995
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(df, limit=0.995, rows_per_cell=50, block=64).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(linked.sum(1))} and sum(got.values()) > 1000


def test_embedding_pairs_are_not_shuffled(spark):
    """A dense cluster over many cells: what is shuffled grows as the vectors, not as the cells that each of them visits."""
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.226
    x[100:130] = x[100]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    before = shuffled()
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(df, rows_per_cell=150, block=75).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(linked.sum(1))} and sum(got.values()) > 100_000
    assert 0 < shuffled() - before < 8 * x.nbytes


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)] + [(200, None), (201, [float("nan")] * 4), (202, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (203, [1e8] * 4), (250, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    good = {i: np.floor(256 * np.array(v)).astype(object) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ c), i) for i, c in good.items() if i != q and len(c) == len(good[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    from pyspark.sql import functions as F

    for tile, block in ((8192, 1024), (7, 2)):
        got = topk.top_k(df, df.where(F.col("vec_id") % 50 == 0), tile=tile, query_block=block).collect()
        assert sorted(tuple(map(int, r)) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size, kind", [(127.996, "smallint"), (-128.0, "smallint"), (128.0, "int"), (-128.01, "int"), (float(1 << 23), "bigint"), (-float(1 << 23), "int")])
def test_top_k_components_travel_in_the_narrowest_integers_that_hold_them(spark, size, kind):
    """One great component on either side decides for all; the scores are those of plain integers."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows[7] = (7, [size, 0.25, -0.5, 1.0])
    df = spark.createDataFrame([*rows, (90, [])], "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for asked in ([7], [3, 20]):
        found = topk.top_k(df, df.where(df.vec_id.isin(asked)), tile=11)
        want = [(a, k + 1, i, -s) for a in asked for k, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(q[a], v)), i) for i, v in q.items() if i != a)[:5])]
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert f"array<{kind}>" in found._jdf.queryExecution().analyzed().toString()


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (3, None), (7, 9), (9, 7), (7, 9)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    best = {n: n for p in pairs for n in p if None not in p}
    for _ in range(200):
        for a, b in pairs:
            if b is not None:
                best[a] = best[b] = min(best[a], best[b])
    assert got == {n: b for n, b in best.items() if any(n in p and p[0] != p[1] and None not in p for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_a_hub(spark):
    pairs = [(1, i) for i in range(2, 400)] + [(i, 1000 + i) for i in range(2, 400, 3)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.component for r in got} == {1} and len(got) == len({n for p in pairs for n in p})


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
            assert out.count() <= n
            docs, n = out, out.count()
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_whole_pipeline_equals_brute_force(spark):
    """Documents by the scores of the classifier, near copies by the similarity of all pairs, bytes by a plain search, tokens by the library; nothing but the result stays behind."""
    import os
    import re
    from urllib.parse import urlparse

    import public_tokenizers
    from tokenizers import Tokenizer

    from quillmark.llm import common, quality

    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    folder = urlparse(common.shared_dir(spark)).path + "/quillmark"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = sorted(r.doc_id for r in quality.op7_quality(spark, sf).collect() if r.score >= quality.THRESHOLD)
    sets = {}
    for i in good:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i]))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    alike = lambda a, b: 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)
    linked = {i: [j for j in good if i == j or alike(sets[i], sets[j])] for i in good}
    near = {i: i for i in good}
    while True:
        now = {i: min(near[j] for j in linked[i]) for i in good}
        if now == near:
            break
        near = now
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation(), tokenizer.no_padding()
    first, want = {}, {}
    for i in [i for i in good if near[i] == i]:
        t = texts[i].encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                gone[p : p + 50] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="ignore")
        want[i] = len(tokenizer.encode(left, add_special_tokens=False).ids) + 1
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = pipeline.run(spark, sf).collect()
    assert len(set(os.listdir(folder)) - before) == 1
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in {r.doc_id for r in got}} == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.bin_id, r.bin_offset)):  # pieces of a sequence follow each other and fit
        assert r.bin_offset == ends.get(r.bin_id, 0)
        ends[r.bin_id] = r.bin_offset + r.length
        assert ends[r.bin_id] <= r.capacity
