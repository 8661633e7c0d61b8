"""Document operators against plain brute force, on texts with nulls, empties, ties, repeats and odd characters."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quillmark.llm import bpe, packing, quality, sharding, simhash, store, suffix  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, fp string, ids string, b string, n long, shard int"


def odd_rows():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gämma", "d'elta", "eta's", "x1", "—", "日本", "the", "of", "and"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = line(40)
    texts = [None, "", " ", "\n\t ", "one", "two words", "Three short words", "<|endoftext|> a<|endoftext|>b", "a   x　　y\x1cz", " ́x e\u0301", "aaaa" * 300, "ab" * 400, line(3000)]
    texts += [line(30) + " " + shared + " " + line(30) for _ in range(6)] + [shared, shared, line(200)]
    base = line(150)
    texts += [base, base, base + " extra", base.replace("alpha", "omega", 1), "x" + base[1:], base.upper()]
    rows = [(i, t, None, "fp", "ids", "b", -1, 7) for i, t in enumerate(texts)]
    return rows + rows[13:15] + [(None, shared, "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(len(rows))] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def utf8(text):
    return (text or "").encode()


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.digests(docs, path).collect()))) == sorted(map(str, want))
    assert bpe.digests(empty, path).count() == 0


def test_chunks_are_encoded_once_and_joins_repaired(rows):
    work = bpe.ChunkEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    text = utf8(" ".join(r[1] or "" for r in rows)) * 3
    assert b"".join(bpe.text_chunks(text)) == text and len(set(bpe.text_chunks(text))) < len(bpe.text_chunks(text))
    first = work.encode([text])
    known = set(work.store)
    assert work.encode([text]) == first == work.library([text]) and set(work.store) == known and work.whole == 0


@pytest.mark.parametrize("file, whole", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_give_the_ids_of_whole_texts(file, whole):
    rng = random.Random(12)
    words = ["alpha", "Beta", "gämma", "d'elta's", "x1", "—", "日本", "of", "ﬁ", "e\u0301", "\u0301x", "<|endoftext|>", "a\u00a0b", "\u3000", "İ", "ΣΑΣ", "don't", "'s", "12"]
    spaces = [" ", " ", " ", "  ", "\n", "\t ", "\r\n", ""]
    texts = ["".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.choice([1, 5, 300, 2000]))).encode() for _ in range(150)]
    texts += [b" a b ", b"", b" ", b"\n\n", b"x" * 5000, b" " * 5000, b"ab " * 3000, b" ab" * 3000]
    work = bpe.ChunkEncoder(open(public_tokenizers.path(file), encoding="utf-8").read())
    assert work.encode(texts) == work.library(texts)
    assert (work.whole > 0) == whole


def test_windows_widen_until_both_sides_agree(monkeypatch):
    work = bpe.ChunkEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    text = b" ".join(b"word%d alpha%d" % (i % 97, i * i % 1009) for i in range(3000))
    exact, plain, asked = work.library([text]), work.library, []

    def stubborn(texts):
        """Windows of few words come back wrong."""
        asked.append(max([len(t.split()) for t in texts], default=0))
        return [b"\0\0\0\0" + g if 2 < len(t.split()) < 8 and t in windows else g for t, g in zip(texts, plain(texts))]

    windows = set()
    repair = work._repair

    def spied(joins):
        windows.update(a.last_words(n) + m + b.first_words(n) for a, m, b in joins for n in bpe.WIDER[:1])
        return repair(joins)

    monkeypatch.setattr(work, "library", stubborn)
    monkeypatch.setattr(work, "_repair", spied)
    assert work.encode([text]) == exact and work.whole == 0 and max(asked[1:]) >= 8


def test_token_store_round_trip(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encoded = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    store.write_store(docs, str(tmp_path / "s"), path)
    got = store.read_back(spark, str(tmp_path / "s")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start[:-1]]).tolist()
    known = [r.doc_id for r in by_start if r.doc_id is not None]
    assert known == sorted(known)
    whole = store.read_ids(spark, str(tmp_path / "s")).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u2").tolist()) for r in whole) == sorted((str(i), x) for i, x in encoded)
    chunks = spark.read.parquet(str(tmp_path / "s/store"))
    assert chunks.count() == chunks.select("key").distinct().count() == chunks.select("ids").distinct().count() and chunks.where("ids is null").count() == 0
    (root,) = spark.read.parquet(str(tmp_path / "s/manifest")).collect()
    assert (root.documents, root.n_tokens) == (len(rows), sum(len(x) for _, x in encoded))
    store.write_store(empty, str(tmp_path / "e"), path)
    assert store.read_back(spark, str(tmp_path / "e")).count() == 0


def test_id_chunks_have_a_greatest_length():
    rng = np.random.default_rng(3)
    period = np.tile(np.array([5, 9, 11], np.uint16), 10_000)
    for ids in (rng.integers(0, 50_000, 30_000).astype(np.uint16), np.zeros(4096, np.uint16), np.zeros(4097, np.uint16), np.concatenate([rng.integers(0, 50_000, 700).astype(np.uint16), period, rng.integers(0, 50_000, 700).astype(np.uint16)])):
        chunks = store.id_chunks(ids)
        assert np.array_equal(np.concatenate(chunks), ids) and 0 < min(map(len, chunks)) and max(map(len, chunks)) <= 4096
    assert len({c.tobytes() for c in store.id_chunks(np.zeros(1 << 20, np.uint16))}) == 1
    assert store.id_chunks(ids[:0]) == [] and len(store.id_chunks(ids[:8])) == 1


def test_token_store_splits_the_uses_of_a_chunk_that_all_documents_share(spark, tmp_path):
    """The lookup of chunks is cut where one digest has most of the uses; the lookup's thresholds are lowered to this table's size."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = [(i, f"{word()} {word()}.{' the' * 20_000} {word()}") for i in range(400)]
    t = Tokenizer.from_file(path)
    encoded = [(i, t.encode(x, add_special_tokens=False).ids + [0]) for i, x in rows]
    store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "s"), path)
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    before = {k: spark.conf.get(k, None) for k in lowered}
    try:
        for k, v in lowered.items():
            spark.conf.set(k, v)
        read = store.read_back(spark, str(tmp_path / "s"))
        got = read.collect()
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    hot = store._uses(spark.read.schema(store.RECIPES).parquet(str(tmp_path / "s/recipes"))).groupBy("digest").count().agg(F.max("count"), F.sum("count")).first()
    assert hot[0] > hot[1] / 2
    assert "skew=true" in plan


def _copy(spark, source, target, **changed):
    """A copy of a store, with some tables changed; None leaves a table out."""
    for name, table in {"store/kind=0": "chunks", "recipes": "recipes", "manifest": "manifest"}.items():
        df = spark.read.parquet(f"{source}/{name}")
        if (change := changed.get(table, lambda x: x)) is not None:
            change(df).write.parquet(f"{target}/{name}")


def test_token_store_finds_damage_and_loss(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    s = str(tmp_path / "s")
    store.write_store(docs, s, public_tokenizers.path("byte_bpe_50k.json"))
    count = store.read_back(spark, s).count()
    one = spark.read.parquet(f"{s}/store/kind=0").orderBy("key").first()["key"]
    last = count - 1
    damages = {
        "corrupt": {"chunks": lambda df: df.withColumn("ids", F.concat("ids", F.lit(b"\0\0")))},
        "missing": {"chunks": lambda df: df.where(F.col("key") != F.lit(bytes(one)))},
        "differ in": {"recipes": lambda df: df.where("position <> 3")},
        "differ in .": {"recipes": lambda df: df.where(f"position <> {last}")},
        "differ in ..?": {"recipes": lambda df: df.withColumn("crc", F.col("crc") + (F.col("position") == 2).cast("int"))},
        "nodes": {"manifest": lambda df: df.limit(0)},
        "PATH_NOT_FOUND": {"manifest": None},
        "PATH_NOT_FOUND.*": {"recipes": None},
        "PATH_NOT_FOUND.*kind=0": {"chunks": None},
    }
    for i, (message, changed) in enumerate(damages.items()):
        _copy(spark, s, str(tmp_path / f"d{i}"), **changed)
        with pytest.raises(Exception, match=message):
            store.read_back(spark, str(tmp_path / f"d{i}")).collect()
    _copy(spark, s, str(tmp_path / "same"))
    assert store.read_back(spark, str(tmp_path / "same")).count() == count


def test_manifest_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(store, "FAN", 3)
    rows = [(i, i, i, 2 * i, 2, 7, bytes([i]) * 16, bytes([i]) * 16) for i in range(20)]
    t = store.tree(spark.createDataFrame(rows, store.RECIPES)).collect()
    assert sorted((r.level, r.node) for r in t) == [(1, i) for i in range(7)] + [(2, i) for i in range(3)] + [(3, 0)]
    assert [(r.documents, r.n_tokens) for r in t if r.level == 3] == [(20, 40)]
    swapped = [*rows[:4], rows[5][:2] + rows[4][2:], rows[4][:2] + rows[5][2:], *rows[6:]]
    other = {(r.level, r.node): r.hash for r in store.tree(spark.createDataFrame(swapped, store.RECIPES)).collect()}
    assert {k for k, h in other.items() if h != {(r.level, r.node): r.hash for r in t}[k]} == {(1, 1), (2, 0), (3, 0)}


def test_byte_encoder_equals_the_library_on_every_character():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = store.ByteEncoder(open(path, encoding="utf-8").read())
    plain = lambda texts: [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    common_ones = [chr(i) for i in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if not store._OTHER.search(chr(i))]
    assert len(common_ones) > 600 and encoder.fast is not None
    texts = [f"a{c}b{c}{c} {c}1{c}2 {c} {c}{c}\n {c}" for c in common_ones]
    assert encoder.encode([t.encode() for t in texts]) == plain(texts)
    words = [t for t in (encoder.tokenizer.decode([i]) for i in range(encoder.tokenizer.get_vocab_size())) if "\ufffd" not in t]
    joined = [" ".join(words[i : i + 7]) + "".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    assert encoder.encode([t.encode() for t in joined]) == plain(joined)
    rng = random.Random(11)
    odd = common_ones + ["\x1c", "\x1f", "日", "\u3000", "\u0301", "'s", "'ll", " ", "  ", "\n", "ab", "42", "<|endoftext|>"]
    mixed = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert encoder.encode([t.encode() for t in mixed]) == plain(mixed)


def test_other_merges_are_left_to_the_library():
    import json

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert store.merges_are_ranks(spec)
    swapped = json.loads(json.dumps(spec))
    swapped["model"]["merges"][:2] = swapped["model"]["merges"][1::-1]
    assert not store.merges_are_ranks(swapped)
    encoder = store.ByteEncoder(json.dumps(swapped))
    assert encoder.fast is None and encoder.encode([b"some text"]) == encoder.library(["some text"])
    assert not store.merges_are_ranks(json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))


def test_merkle_root():
    a, b, c = (bytes([i]) * 16 for i in range(3))
    assert store.merkle_root([a]) == a
    assert store.merkle_root([a, b, c]) == store.digest(store.digest(a + b) + c)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(nodes, linked):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            low = min(best[b] for b in nodes if b == a or linked(a, b))
            if low < best[a]:
                best[a], changed = low, True
    return best


def test_simhash_links(docs, rows, empty):
    fp = {r[0]: brute_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = components(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(int.from_bytes(r.fp, "big") == fp[r.doc_id] and r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_blocks_find_the_same_links(spark):
    rng = random.Random(3)
    values = sorted({(0xF0F0 << 40 | sum(1 << rng.randrange(40) for _ in range(rng.randrange(4)))) for _ in range(150)})
    nodes = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "id long, fp binary")
    want = components(range(len(values)), lambda a, b: bin(values[a] ^ values[b]).count("1") <= 3)
    for block in (8, 50, 4096):
        pairs = [(r.a, r.b) for r in simhash.links(nodes, 64, 3, block).collect()]
        assert all(bin(values[a] ^ values[b]).count("1") <= 3 for a, b in pairs)
        near = set(pairs) | {(b, a) for a, b in pairs}
        assert components(range(len(values)), lambda a, b: (a, b) in near) == want  # noqa: B023


def test_large_groups_cost_as_their_size(spark):
    members = spark.range(1200).selectExpr("CAST(id % 2 AS LONG) AS key", "id")
    apart, dealt_rows = {7, 200, 201, 999}, []

    def links_of(dealt):
        dealt_rows.append(dealt.count())
        near = dealt.where(~F.col("id").isin(sorted(apart)))
        least = near.groupBy("key", "at").agg(F.min("id").alias("a"))
        own = dealt.where(F.col("id").isin(201, 999)).groupBy("key", "at").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
        return near.join(least, ["key", "at"]).select("a", F.col("id").alias("b")).union(own)

    links = simhash._linked_in_groups(members, 50, links_of)
    pairs = {(r.a, r.b) for r in links.collect()}
    near = pairs | {(b, a) for a, b in pairs}
    want = {i: 201 if i == 999 else i if i in apart else i % 2 for i in range(1200)}
    assert components(range(1200), lambda a, b: (a, b) in near) == want
    assert len(dealt_rows) == 2 and all(n < 3 * 1200 for n in dealt_rows)  # pairs of 12 blocks would deal 14,400 rows


def test_tallies_keep_what_reaches_the_minimum():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, (500, 1), np.int64).view(np.uint64)
    flips = np.array([[np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 7)).astype(np.uint64)) if k % 5 else np.uint64(0)] for k in range(500)], np.uint64)
    b = a ^ flips
    shared = np.array([sum(x == y for x, y in zip(p.tobytes(), q.tobytes())) for p, q in zip(a, b)])
    assert (simhash._tally(a, b) == shared).all()
    differ = np.array([int(f[0]).bit_count() for f in flips])
    assert (simhash._reaching(a, b, 5, 3) == ((shared >= 5) & (differ <= 3))).all() and (simhash._reaching(a, b, 7, None) == (shared >= 7)).all()
    assert not (simhash._reaching(a, b, 5, 3) < (differ <= 3)).any()  # the count filter loses no link


def test_positional_bytes_agree_as_often_as_sets_do():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    for changed in (10, 22, 60):
        copy = list(base)
        for i in range(changed):
            copy[3 + i * 15] = "x" + str(i)
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, copy)]
        j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        x, y = (np.frombuffer(simhash.sketch(" ".join(t).encode())[1], np.uint8) for t in (base, copy))
        assert len(x) == simhash.BYTES and abs((x == y).mean() - j) < 0.15


def test_near_copies_leave_one_document(docs, rows):
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    base = [r[0] for r in rows if r[1] and r[1].startswith(rows[22][1][:80]) and r[0] is not None]
    assert len(kept & set(base)) == 1 and min(base) in kept and None in kept


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**7)}"
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    texts = []
    for size, changed in [(274, k) for k in (5, 6, 7, 8)] * 20 + [(8, 0)] * 10 + [(49, 1)] * 10:
        base = [word() for _ in range(size)]
        copy = list(base)
        for i in range(changed):
            copy[10 + i * 20] = word()
        texts += [base, copy if changed else [*copy, word()]]  # 270 shingles, 6 words changed: 0.8 exactly; 4 of 5 shingles too
    texts += [[*texts[0][:-i], *(word() for _ in range(i))] for i in range(1, 60)]  # a chain-free large group around one text
    sets = [shingles(t) for t in texts]
    want = components(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for block in (8, 512):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs, block=block).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {i for i in want if want[i] == i}


def test_suffix_dedup_equals_brute_force(docs, rows, empty):
    texts = {r[0]: utf8(r[1]) for r in rows if r[0] is not None}
    first, want = {}, {}
    for i in sorted(texts):
        t = texts[i]
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                gone[p : p + 50] = True
        runs = len(re.findall(b"\1+", gone.astype(np.uint8).tobytes()))
        want[i] = (len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone]))
    for edges in (suffix.EDGES, 1):
        got = suffix.deduplicate(docs, edges).collect()
        assert len(got) == len(rows)
        assert all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert {r.n for r in got if r.doc_id is not None} == {-1} and sum(w[1] for w in want.values()) > 0
    assert suffix.deduplicate(empty).count() == 0


def test_suffix_dedup_keeps_columns_of_any_name(spark, docs, rows):
    clashing = docs.select("doc_id", "text", *[docs.n.alias(c) for c in ("kept", "n_bytes", "n_removed", "n_spans", "i", "t", "b", "x0", "a.b")])
    plain = {r.doc_id: r for r in suffix.deduplicate(docs.select("doc_id", "text")).collect()}
    got = suffix.deduplicate(clashing).collect()
    assert all((r.n_removed, r.kept, r.n_spans) == (plain[r.doc_id].n_removed, plain[r.doc_id].kept, plain[r.doc_id].n_spans) for r in got) and got[0]["a.b"] == -1
    back = suffix.without_repeats(clashing)
    assert back.columns == clashing.columns and {(r.doc_id, r.text, r.kept) for r in back.collect()} == {(r.doc_id, plain[r.doc_id].text, r.n) for r in docs.collect()}


def test_suffix_dedup_of_many_edges_around_one_anchor(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    template, texts = word(44), []
    for _ in range(120):  # repeats that end at different places on either side of one passage
        texts.append(word(rng.randrange(60)) + (rng.choice(texts)[20:90] if texts else "") + template[rng.randrange(8) :] + word(rng.randrange(40)))
    first, want = {}, []
    for i, t in enumerate(t.encode() for t in texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                gone[p : p + 50] = True
        want.append((i, bytes(np.frombuffer(t, np.uint8)[~gone])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for edges in (suffix.EDGES, 1):
        assert sorted((r.doc_id, bytes(r.kept)) for r in suffix.deduplicate(df, edges).collect()) == want
    assert sum(len(k) for _, k in want) < sum(map(len, texts))


def cut_by_brute_force(texts):
    """(n_removed, n_spans, kept) of each text, in the order of ids."""
    first, out = {}, []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                gone[p : p + 50] = True
        out.append((int(gone.sum()), len(re.findall(b"\1+", gone.astype(np.uint8).tobytes())), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_suffix_dedup_of_periodic_texts(spark):
    """Texts that repeat themselves: their anchors share their parts, and each piece is sorted once."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for period in (1, 2, 7, 16, 33, 49, 50, 61):
        unit = word(period)
        texts += [unit * (3000 // period), unit * (100 // period + 1), word(30) + unit * (150 // period) + word(40), (unit * (90 // period + 1))[3:], word(60) + (unit * 60)[:45] + word(20)]
    rng.shuffle(texts)
    want = cut_by_brute_force([t.encode() for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for edges in (suffix.EDGES, 1):
        assert [(r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(suffix.deduplicate(df, edges).collect(), key=lambda r: r.doc_id)] == want
    assert sum(w[0] for w in want) > 5000


def test_suffix_dedup_of_megabytes_of_periodic_text(spark):
    """10 MB that repeat one line, and a short text with some of it: a few pieces are sorted, not half a million."""
    import time

    line = "the same line of some words, over and over again, once more.\n"
    rows = [(2, line * (10_000_000 // len(line))), (1, "first " + line * 2), (3, line[5:] + "end")]
    begin = time.monotonic()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(rows[0][1])
    assert got == {1: (6 + 2 * len(line), 0, 0), 2: (n, n, 1), 3: (len(line) - 2, len(line) - 5, 1)}
    rows[0], rows[1] = (0, rows[0][1]), (5, rows[1][1])  # the long text comes first: its anchors are the edges
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 5: (2 * len(line), 1), 3: (len(line) - 5, 1)}
    assert time.monotonic() - begin < 90


def test_postings_of_spans_are_those_of_whole_texts():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[2000:2600] = 97
    ends = np.array([700, 701, 4100, 5000])
    starts = np.concatenate([[0], ends[:-1]])
    rows = lambda span: set(zip(*[c.tolist() for c in suffix._postings(data, starts, ends, span)]))
    whole = rows(1 << 22)
    assert len(whole) > 200 and all(rows(span) == whole for span in (60, 333, 4999))


def test_unequal_contexts_of_one_anchor_never_settle(monkeypatch):
    import pyarrow as pa

    mix = suffix.mix
    monkeypatch.setattr(suffix, "mix", lambda h: mix(h) & ~np.uint64((1 << 48) - 1))  # anchors and 48 bits of contexts collide
    rng = random.Random(2)
    sent = []
    for i in range(2):  # two tasks, whose postings meet in their bucket
        text = "".join(rng.choice("abcdefgh") for _ in range(400)).encode()
        sent += suffix._post(3, 1)(iter([pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text], pa.binary())], ["i", "t"])]))
    doc, place, flag = suffix._answers(suffix._meet(3)(pa.Table.from_batches(sent)), suffix.ANCHORS, "<i8", "<u4", "u1")
    assert not (flag == 0).any()


def test_suffix_sort_and_extensions():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at = np.arange(300)
    size = np.minimum(60, 400 - at)
    s = suffix.Suffixes(data, at, size)
    order = s.sort()
    strings = [bytes(data[a : a + n]) for a, n in zip(at, size)]
    assert [strings[i] for i in order] == sorted(strings)
    n = s.common(order[:-1], order[1:])
    assert all(strings[i][:k] == strings[j][:k] and strings[i][k : k + 1] != strings[j][k : k + 1] or k == min(len(strings[i]), len(strings[j])) for i, j, k in zip(order[:-1], order[1:], n))


def test_quality_learns_and_scores_everything(spark, docs, rows, empty, labels):
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_separates_junk(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(400):
        text = " ".join(word() for _ in range(60))
        rows.append((i, text.upper() + "!!" if i % 3 == 0 else text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id long, quality int")
    held = [r for r in quality.score(docs, labels).collect() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)


def test_quality_on_held_out_documents(spark):
    """Held-out documents are told apart, and batches without rows are scored."""
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, known[r.doc_id], r.predicted) for r in quality.op7_quality(spark, sf).collect() if r.held_out and known.get(r.doc_id) is not None]
    good, bad = ([x for x, y, _ in got if y == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert len(got) > 50 and auc > 0.97 and sum(p == y for _, y, p in got) > 0.95 * len(got)
    score = quality.scorer(quality.Model(0.0))
    assert spark.range(10).repartition(3).where("id > 100").select(score(F.lit("x").cast("binary"))).count() == 0


def test_sharding_law(docs, rows, empty):
    got = sharding.shard(docs, shards=3, slots=64).collect()
    assert len(got) == len(rows)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    size = {r[0]: len(utf8(r[1])) + 1 for r in rows}
    assert all(r["size"] == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in got)
    assert {r.text_crc32 for r in got} == {zlib.crc32(utf8(r[1])) for r in rows}
    loads = [sum(r["size"] for r in got if r.shard == s) for s in range(3)]
    assert max(loads) - min(loads) <= max(size.values()) * 2
    slots = {}
    for r in got:
        slots.setdefault(r.virtual_slot, set()).add(r.shard)
    assert all(len(v) == 1 for v in slots.values())
    assert sharding.shard(empty).count() == 0


def test_sharding_spreads_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else 7, f"text {i}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4).collect()
    loads = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert len(got) == 4000 and max(loads) - min(loads) < 0.02 * sum(loads)


def test_sharding_spreads_equal_rows(spark):
    """A row that stands thousands of times, in several partitions, is dealt like different rows; the others' slots don't depend on the layout."""
    rows = [(1, "same text")] * 4000 + [(None, None)] * 400 + [(i, f"text {i}") for i in range(2, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, other = (sharding.shard(docs.repartition(n), shards=4, slots=512, grow=True).collect() for n in (5, 2))
    loads = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) < 0.02 * sum(loads)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    grown = [sum(r["size"] for r in got if r.next_shard == s) for s in range(5)]
    assert max(grown) - min(grown) < 0.02 * sum(grown) and {r.map_version for r in got} == {1}
    assert sum(r.next_shard != r.shard for r in got) < 0.3 * len(got)
    key = lambda found: sorted((str(r.doc_id), r.virtual_slot, r.shard, r.slot) for r in found)
    assert key(got) == key(other)
    assert len({r.virtual_slot for r in got if r.doc_id == 1}) > 400


def test_sharding_edits_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 5)) for i in range(600)], "doc_id long, text string").repartition(3)
    first, again, more = ({r.doc_id: r for r in sharding.shard(docs, shards=n, slots=64, map_path=path).collect()} for n in (3, 3, 4))
    assert sharding.stored_version(spark, path) == 3 and {r.version for r in sharding.read_map(spark, path, 2).collect()} == {2}
    assert {k: r.virtual_slot for k, r in first.items()} == {k: r.virtual_slot for k, r in more.items()} and {r.shard for r in more.values()} == {0, 1, 2, 3}
    assert sum(first[k].shard != again[k].shard for k in first) < 60  # what is above the fair share of its shard
    assert all(again[k].shard == more[k].shard or more[k].shard == 3 for k in first) or sum(again[k].shard != more[k].shard for k in first) < 250


def test_sharding_rebalance_moves_little(spark):
    totals = spark.createDataFrame([(i, 100 + i % 7, 5) for i in range(200)], "virtual_slot int, bytes long, rows long")
    old = sharding.first_map(totals, 4)
    new = sharding.rebalance(old, totals, 5)
    before, after = ({r.virtual_slot: r.shard for r in m.collect()} for m in (old, new))
    loads = [sum(100 + i % 7 for i, s in after.items() if s == k) for k in range(5)]
    assert max(loads) - min(loads) <= 107 and set(before) == set(after)
    assert all(before[i] == after[i] or after[i] == 4 for i in before) or sum(before[i] != after[i] for i in before) <= 60
    assert {r.version for r in new.collect()} == {2}


def naive_bins(lengths, permitted, opening):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[1] >= n]
        if fits:
            min(fits, key=lambda b: (b[1], b[0]))[1] -= n
        else:
            size = max(opening, min(c for c in permitted if c >= n))
            bins.append([size, size - n])
    return sorted(min(c for c in permitted if c >= s - f) for s, f in bins)


def test_packing_plan_equals_best_fit_decreasing():
    from collections import Counter

    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.choice([1, rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(rng.randint(0, 60))]
        for opening in (16, 32, 64):
            placed, sized = packing.plan(Counter(lengths), (16, 32, 64), opening)
            assert sum(p[2] for p in placed) == len(lengths)
            assert sorted(k for _, c, k in sized for _ in range(c)) == naive_bins(lengths, (16, 32, 64), opening)


def least_cost(lengths, permitted, overhead):
    """Of all ways to deal a few pieces over bins."""
    best = [10**9]

    def deal(rest, bins):
        if not rest:
            best[0] = min(best[0], sum(min(c for c in permitted if c >= b) + overhead for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= max(permitted) and bins[i] not in bins[:i]:
                deal(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
        deal(rest[1:], [*bins, rest[0]])

    deal(sorted(lengths, reverse=True), [])
    return best[0]


def test_joint_sizes_against_single_sizes_and_the_optimum():
    from collections import Counter

    rng, permitted, overhead = random.Random(6), (16, 24, 40, 64), 2
    chosen, single, optimum, mixed = 0, 0, 0, 0
    for _ in range(150):
        lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 24), rng.randint(8, 16)]) for _ in range(rng.randint(1, 8))]
        h = Counter(lengths)
        placed, sized = packing.plan(h, permitted, packing.JointSizes(h, permitted, overhead))
        assert sum(p[2] for p in placed) == len(lengths)
        least = min(packing.cost_of(packing.plan(h, permitted, c)[1], overhead) for c in permitted)
        best = packing.cost_of(packing.best_plan(h, permitted, overhead)[1], overhead)
        optimal = least_cost(lengths, permitted, overhead)
        assert optimal <= best <= least and best <= 1.35 * optimal
        chosen, single, optimum = chosen + best, single + least, optimum + optimal
        mixed += packing.cost_of(sized, overhead) < least
    assert chosen < single and chosen < 1.05 * optimum and mixed >= 5
    h = Counter({400: 90, 1000: 60, 1900: 40, 2500: 30, 600: 20})
    permitted = packing.LENGTHS
    costs = {o: packing.cost_of(packing.plan(h, permitted, packing.JointSizes(h, permitted, 32) if o == "joint" else o)[1], 32) for o in ("joint", *permitted)}
    assert all(costs["joint"] < costs[o] for o in permitted)


def test_packing_places_every_token_once(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([1, 3, 17, 64, 65, rng.randint(1, 300)])) for i in range(500)] + [(7, 17), (7, 17), (None, 5), (900, None), (901, 0)]
    got = packing.pack(spark.createDataFrame(items, "doc_id long, n long"), (16, 32, 64)).collect()
    held = {}
    for r in got:
        if r.length:
            held.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.capacity))
    assert sorted(held) == list(range(len(held)))
    for spans in held.values():
        spans.sort()
        assert all(a[0] + a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= spans[0][2] and len({s[2] for s in spans}) == 1
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    want = {}
    for i, n in items:
        want[i] = want.get(i, 0) + (n or 0)
    assert total == want and [r.bin_id for r in got if r.doc_id in (900, 901)] == [None, None]
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long")).count() == 0


def test_packing_documents(docs, rows, empty):
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {r[0] for r in rows}
    assert packing.pack_documents(empty).count() == 0


def test_pipeline_stages_on_odd_and_on_no_rows(spark, docs, rows, empty, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    ids = {r[0] for r in rows}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        for table in (docs, empty):
            out = stage(spark, table, str(tmp_path))
            got = out.collect()
            assert {r.doc_id for r in got} <= (ids if table is docs else set())
            if k < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns and len(got) <= len(rows)
                assert {r.n for r in got if r.doc_id is not None} <= {-1}
    assert {r.doc_id for r in pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()} == ids
