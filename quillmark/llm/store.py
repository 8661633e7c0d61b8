"""Token-id output as a content-addressed store.

Rolling hashes cut each document's id stream into chunks. The encoding tasks
ship two kinds of rows through one exchange: chunks, named by their digest, of
which one copy each is written to ``store/``; and one recipe for each
document, made from its ids before they are cut: number of ids, checksum, the
digests of its chunks in order, and their Merkle root. ``recipes/`` holds
them in ascending doc_id order with each document's position and start.
``manifest/`` holds a Merkle tree over the documents' roots in that order, up
to a single root that also counts documents and ids.

Reading back trusts no part: chunks must match their digests, recipes the
root of their digests, the checksums of what is stored those of what was
encoded, and all recipes together the manifest. So a changed or lost chunk,
recipe, manifest row or table fails the job. A checksum of a whole document is
combined from its chunks' checksums, so verifying moves digests, not ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import rolling_hash

#: Ids that a task gathers before it ships its chunks.
FLUSH_IDS = 8_000_000
#: Documents or nodes below one node of the manifest.
FAN = 1024
#: What splits text in byte-level BPE (the pre-tokenizer's own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters two libraries' versions of Unicode may class characters differently, so texts with others are encoded whole.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")


class ByteEncoder:
    """Ids of the tokenizers library for a byte-level BPE file.

    Texts of common characters go through the same merges as ranks, three times faster. That is done only if the file's vocabulary
    numbers its merges in their order and its pre-tokenizer and model are the plain ones, so that both ways are the same by
    construction; tests compare them over every such character and every token. All other texts, those that name an added
    token, and all texts of other files go through the tokenizers library itself.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(id_type(spec))
        parsed = json.loads(spec)
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if merges_are_ranks(parsed):
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
            ranks = {bytes(shown[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in added}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned integers of the file's width."""
        decoded = [t.decode("utf-8", "replace") for t in texts]
        whole = [self.fast is None or bool(not t.isascii() and _OTHER.search(t) or self.special and self.special.search(t)) for t in decoded]
        found = iter(self.library([t for t, w in zip(decoded, whole) if w]))
        return [next(found) if w else self.fast.encode_to_numpy(t, disallowed_special=()).astype(self.kind).tobytes() for w, t in zip(whole, decoded)]


def merges_are_ranks(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE whose merges make tokens of rising ids, in the order of the list."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"] and spec["post_processor"] is None
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(p), -1) for p in pairs]
    return bool(plain and not odd and made and min(made) >= 256 and all(a < b for a, b in zip(made, made[1:])) and len(made) == sum(len(t) > 1 for t in model["vocab"]))


def id_type(spec: str) -> str:
    """The width of stored ids: numpy's name of the type."""
    parsed = json.loads(spec)
    most = max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def id_chunks(ids: np.ndarray, bits: int = 9, width: int = 8, most: int = 4096) -> list[np.ndarray]:
    """Content-defined chunks of about 2**bits ids; an empty stream has none.

    Where no hash cuts for ``most`` ids, as in a text that repeats itself, every ``most`` ids from the last cut are a chunk.
    """
    if len(ids) <= width:
        return [ids] if len(ids) else []
    cuts = np.flatnonzero(rolling_hash(ids, width) >> np.uint32(32 - bits) == 0) + width
    cuts = cuts[cuts < len(ids)]
    if len(ids) > most:
        starts, ends = np.append(0, cuts), np.append(cuts, len(ids))
        long = np.flatnonzero(ends - starts > most)
        cuts = np.sort(np.concatenate([cuts, *[np.arange(starts[k] + most, ends[k], most) for k in long]]))
    return np.split(ids, cuts)


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up unchanged, no leaves give zeros."""
    level = digests or [bytes(16)]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


CHUNK, RECIPE = 0, 1
_SHIPPED = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("root", pa.binary()), ("digests", pa.binary())])
_SHIPPED_DDL = "kind int, key binary, ids binary, doc_id long, uid long, n long, crc long, root binary, digests binary"
_STORED = "key binary, ids binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write store, recipes and manifest below ``path``.

    Each document's ids end with ``end_id``, so null and empty texts are one id long. Chunks hold little-endian unsigned integers
    of 16 bits, of 32 for vocabularies beyond 65536. Documents are ordered by doc_id (null first), equal ids by an arbitrary but
    kept order; repeated rows are documents of their own. An empty table gives an empty store with a root of no documents.
    """
    spark = docs.sparkSession
    text = open(tokenizer_path, encoding="utf-8").read()
    spec = spark.sparkContext.broadcast(text)  # a vocabulary file: its size doesn't depend on the data
    kind = np.dtype(id_type(text))
    end = np.array([end_id], kind).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker(ByteEncoder, spec.value)
        chunks: dict[bytes, bytes] = {}
        held = 0
        for b in common.slices(batches, 500):
            recipes = []
            for doc_id, uid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(b.column(2).to_pylist())):
                ids = np.frombuffer(raw + end, kind)
                names = []
                for c in id_chunks(ids):
                    stored = c.tobytes()
                    names.append(digest(stored))
                    chunks[names[-1]] = stored
                held += len(ids)
                recipes.append((doc_id, uid, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), merkle_root(names), b"".join(names)))
            yield _shipped(RECIPE, [u.to_bytes(8, "big", signed=True) for _, u, *_ in recipes], None, recipes)
            if held > FLUSH_IDS:
                yield _shipped(CHUNK, list(chunks), list(chunks.values()), None)
                chunks, held = {}, 0
        yield _shipped(CHUNK, list(chunks), list(chunks.values()), None)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), common.text_bytes().alias("t"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # chunks of one digest are equal: any copy will do
    once = named.mapInArrow(cut, _SHIPPED_DDL).withColumn("__n", first).where("__n = 1").drop("__n")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")
    spark.createDataFrame([], _STORED).write.mode("append").parquet(f"{path}/store/kind={CHUNK}")
    _write_recipes(spark, path)
    common.remove(spark, f"{path}/store/kind={RECIPE}")  # they stand in recipes/ now


def _shipped(kind: int, keys: list[bytes], ids: list[bytes] | None, recipes: list[tuple] | None) -> pa.RecordBatch:
    rest = [pa.nulls(len(keys), t) for t in _SHIPPED.types[3:]] if recipes is None else [pa.array(c, t) for c, t in zip(zip(*recipes), _SHIPPED.types[3:])] or [pa.array([], t) for t in _SHIPPED.types[3:]]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.binary()) if ids is None else pa.array(ids, pa.binary()), *rest], schema=_SHIPPED)


RECIPES = "doc_id long, uid long, position long, start long, n_tokens long, crc long, root binary, digests binary"
MANIFEST = "level int, node long, documents long, n_tokens long, hash string"


def _write_recipes(spark, path: str) -> None:
    raw = spark.read.schema("doc_id long, uid long, n long, crc long, root binary, digests binary, kind int").parquet(f"{path}/store").where(F.col("kind") == RECIPE)
    ranged = common.materialize(raw.drop("kind").repartitionByRange(common.shuffle_width(spark), "doc_id", "uid").withColumn("range", F.spark_partition_id()), "recipe-ranges")
    totals = ranged.groupBy("range").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"))
    earlier = Window.orderBy("range")  # one row for each range
    before = totals.select("range", (F.sum("ids").over(earlier) - F.col("ids")).alias("ids_before"), (F.sum("docs").over(earlier) - F.col("docs")).alias("docs_before"))
    order = Window.partitionBy("range").orderBy("doc_id", "uid")
    placed = ranged.join(F.broadcast(before), "range")
    position, start = F.col("docs_before") + F.row_number().over(order) - 1, F.col("ids_before") + F.sum("n").over(order) - F.col("n")
    placed.select("doc_id", "uid", position.cast("long").alias("position"), start.alias("start"), F.col("n").alias("n_tokens"), "crc", "root", "digests").write.parquet(f"{path}/recipes")
    tree(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def tree(recipes: DataFrame) -> DataFrame:
    """(level, node, documents, n_tokens, hash): a Merkle tree over the recipes in their order, FAN below a node, up to one root at node 0.

    A node's hash covers the roots, positions and lengths below it in order, so a missing, added or moved recipe changes it. No task holds
    more than FAN hashes. The number of levels follows from the number of documents.
    """
    spark = recipes.sparkSession
    count = (recipes.agg(F.max("position")).first()[0] or 0) + 1
    leaf = F.sha2(F.concat_ws(":", F.col("position"), F.col("start"), F.col("n_tokens"), F.col("crc"), F.hex("root"), F.hex("digests"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256)
    below = recipes.select(F.col("position").alias("node"), F.lit(1).cast("long").alias("documents"), "n_tokens", leaf.alias("hash"))
    levels, level = [], 0
    while True:
        level, count = level + 1, -(-count // FAN)
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws("=", x["node"], x["hash"]))
        above = below.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(children, ","), 256).alias("hash"))
        levels.append(above.select(F.lit(level).alias("level"), "node", "documents", "n_tokens", "hash"))
        below = above
        if count == 1:
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    empty = spark.range(1).select(F.lit(1).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("n_tokens"), F.sha2(F.lit(""), 256).alias("hash"))
    return out if not recipes.isEmpty() else empty


def verify_manifest(spark, path: str) -> None:
    """Fail unless the recipes are exactly those of the manifest. Only a count reaches the driver."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    kept = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    mine, theirs = tree(recipes), kept.select("level", "node", *[F.col(c).alias(f"kept_{c}") for c in ("documents", "n_tokens", "hash")])
    same = F.col("documents").eqNullSafe(F.col("kept_documents")) & F.col("n_tokens").eqNullSafe(F.col("kept_n_tokens")) & F.col("hash").eqNullSafe(F.col("kept_hash"))
    wrong = mine.join(theirs, ["level", "node"], "full").where(~same).count()
    if wrong:
        raise ValueError(f"recipes and manifest differ in {wrong} nodes")


def checked_chunks(spark, path: str, width: int) -> DataFrame:
    """(digest, n, crc) of every stored chunk, read from the files; bytes that don't match their digest fail the job."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, raw = (b.column(i).to_pylist() for i in range(2))
            n, crc = [], []
            for d, r in zip(names, raw):
                if digest(r) != d:
                    raise ValueError(f"chunk {d.hex()} is corrupt")
                ids = np.frombuffer(r, f"<u{width}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return _chunks(spark, path).mapInArrow(check, "digest binary, n long, crc long")


def _chunks(spark, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{path}/store/kind={CHUNK}").select(F.col("key").alias("digest"), "ids")


def _uses(recipes: DataFrame) -> DataFrame:
    """(root, seq, digest): the chunks of every different recipe; a root that isn't that of its digests fails the job."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            roots, seqs, out = [], [], []
            for root, joined in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = [joined[i : i + 16] for i in range(0, len(joined), 16)]
                if merkle_root(names) != root:
                    raise ValueError("a recipe doesn't match its root")
                roots += [root] * len(names)
                seqs += range(len(names))
                out += names
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(seqs, pa.int32()), pa.array(out, pa.binary())], ["root", "seq", "digest"])

    return recipes.select("root", "digests").distinct().mapInArrow(split, "root binary, seq int, digest binary")


def read_back(spark, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Fails where any part of the store is missing, changed or added: at once for recipes and manifest, and when the result is
    computed for chunks. A store of no documents gives an empty result.
    """
    verify_manifest(spark, path)
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    parts = _uses(recipes).join(checked_chunks(spark, path, width), "digest", "left")
    whole = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("p"), F.count_if(F.col("n").isNull()).alias("lost"))
    zeros = bytes(1 << 16)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for sizes, crcs, lost in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if lost:
                    raise ValueError(f"{lost} chunks of a document are missing")
                total = 0
                for c, size in zip(crcs, sizes):
                    for at in range(0, 4 * size, len(zeros)):
                        pad = zeros[: min(len(zeros), 4 * size - at)]
                        total = zlib.crc32(pad, total) ^ zlib.crc32(pad)
                    total ^= c
                n.append(sum(sizes))
                crc.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["root", "got_n", "got_crc"])

    got = whole.select("root", "p.n", "p.crc", "lost").mapInArrow(join, "root binary, got_n long, got_crc long")
    same = (F.col("got_crc") == F.col("crc")) & (F.col("got_n") == F.col("n_tokens"))
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("got_crc")).otherwise(F.raise_error(F.lit("a document doesn't match its recipe")).cast("long"))
    return recipes.join(got, "root", "left").select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"))


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, uid, ids binary): every document's whole ids, rebuilt from its chunks; repeated rows stay apart by uid, null ids are kept."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    parts = _uses(recipes).join(_chunks(spark, path), "digest").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("p"))
    whole = parts.select("root", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return recipes.join(whole, "root").select("doc_id", "uid", "ids")


def op2_token_store(spark, sf_dir):
    """Query: every document's place and checksum, read back from the written store."""
    import public_tokenizers

    path = common.scratch_path(spark, "token-store")
    write_store(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, path)
