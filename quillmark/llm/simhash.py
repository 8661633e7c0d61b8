"""SimHash near-duplicate groups through an inverted index on positional fingerprint bytes.

1. Every whole text becomes a fingerprint; equal ones collapse to one node, so
   copies cost nothing after this step.
2. The index posts every fingerprint under (position, byte) in tuples of
   several positions: lists of single bytes would hold one fingerprint in 256
   each, and comparing inside them would grow with the square of the rows.
   For 64 bits and at most 3 differing bits, 5 of the 8 bytes must agree, and
   the eight triples inside the halves {0..3} and {4..7} hit every set of 5
   positions, so every linkable pair shares a posting.
3. Within a posting the shared positional bytes of each pair are tallied. Only
   pairs that reach the guaranteed minimum are verified by their differing
   bits, and only a spanning forest of the verified links leaves the task,
   rooted at small ids so that postings agree on their edges. Postings above
   ``block`` members are cut into blocks. First every block is compared with
   itself and the first one, and components of what was found are labelled;
   only members outside a posting's largest component are then compared with
   all its blocks. A large group of near copies is connected by the first
   round, so its cost grows with its size and not with its square.
4. Components of the links are labelled with distributed star contraction.

``near_duplicates`` votes each fingerprint bit over all shingles. At a Jaccard
similarity of 0.8 such bits differ so often (15 % of them, so only 27 % of
bytes agree) that no tuple of bytes is both selective and sure: three-byte
keys would need 234 postings for a document to find 99 % of the pairs.
``keep_one`` therefore lets one shingle vote each byte, the one that comes
first in the byte's own random order. Two documents agree on such a byte with
the probability of their similarity, so tuples of four bytes, tallies and a
minimum work as above, and the exact similarity of shingle sets verifies.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Fingerprints of ``keep_one``: bytes, positions posted together, bytes that travel for the tally, and how many of those must agree.
BYTES, TUPLE, TALLIED, LEAST = 128, 4, 48, 24
_FLIPS, _FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, (2, BYTES, 1), np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; shorter texts give one shingle, empty ones none."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, len(parts) - words + 1)


def fingerprint(text: bytes, words: int = 3, bits: int = 64) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is set in over half of the shingle hashes; zero for a text without words.

    Each further 64 bits come from a fixed mixing of the shingle's hash.
    """
    return _votes(shingle_hashes(text, words), bits)


def _votes(h: np.ndarray, bits: int) -> bytes:
    out = b""
    for k in range(bits // 64):
        if k:
            h = h * np.uint64(_MIX[1]) + np.uint64(_MIX[0])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[2])
            h = h ^ (h >> np.uint64(32))
        if len(h) < 256:
            votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        else:
            planes = h.view(np.uint8).reshape(-1, 8)
            votes = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
        out += np.packbits(votes * 2 > len(h), bitorder="little").tobytes()[::-1]
    return out


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp binary) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words, bits) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), common.text_bytes().alias("t")).mapInArrow(run, "doc_id long, fp binary")


def posting_tuples(n_bytes: int, max_diff: int) -> tuple[list[tuple[int, ...]], int]:
    """The byte positions that are posted together, and the least number of shared bytes.

    With at most ``max_diff`` differing bits, ``n_bytes - max_diff`` bytes agree; of 8 that must be at least 5, and all triples inside
    each half are posted, which no such pair can avoid.
    """
    if n_bytes == 8 and max_diff <= 3:
        return [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)], 8 - max_diff
    raise ValueError("links are guaranteed for 64 bits and at most 3 differing ones")


def _tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair of rows shares."""
    x = np.ascontiguousarray(a ^ b)
    return (x.view(np.uint8) == 0).sum(-1, dtype=np.int32)


def _reaching(a: np.ndarray, b: np.ndarray, min_shared: int, max_diff: int | None) -> np.ndarray:
    """Which pairs of rows of uint64 words share ``min_shared`` positional bytes and, verified after that, differ in at most ``max_diff`` bits."""
    if not len(a):
        return np.zeros(0, bool)
    a, b = np.broadcast_arrays(a, b)
    out = _tally(a, b) >= min_shared
    if max_diff is not None:
        at = np.flatnonzero(out)
        out[at] = np.bitwise_count(a[at] ^ b[at]).sum(-1, dtype=np.int32) <= max_diff
    return out


def _forest(words: np.ndarray, min_shared: int, max_diff: int | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among rows, by breadth-first search with one vectorised row at a time; first rows are roots."""
    left, edges = np.arange(len(words)), []
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            at = queue.popleft()
            hit = _reaching(words[left], words[at], min_shared, max_diff)
            found = left[hit]
            left = left[~hit]
            edges += [(at, x) for x in found]
            queue += found.tolist()
    return edges


def _links_of_groups(ids: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_shared: int, max_diff: int | None, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of rows (a run is one posting or one pair of blocks)."""
    lengths = np.diff(bounds)
    group = np.repeat(np.arange(len(lengths)), lengths)
    out_a, out_b = [], []
    tiny = np.repeat(lengths <= small, lengths)
    for d in range(1, min(small, int(lengths.max(initial=0)))):
        i = np.flatnonzero((group[:-d] == group[d:]) & tiny[:-d])
        for part in np.array_split(i, len(i) // 1_000_000 + 1):
            hit = part[_reaching(words[part], words[part + d], min_shared, max_diff)]
            out_a.append(ids[hit])
            out_b.append(ids[hit + d])
    for g in np.flatnonzero(lengths > small):
        a, b = bounds[g], bounds[g + 1]
        for x, y in _forest(words[a:b], min_shared, max_diff):
            out_a.append(ids[a + x : a + x + 1])
            out_b.append(ids[a + y : a + y + 1])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _joining(root: dict[int, int], pairs: np.ndarray) -> list[bool]:
    """Which pairs join two sets that were apart so far; ``root`` is a union-find forest, kept from call to call."""

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        out.append(x != y)
        root[max(x, y)] = min(x, y)
    return out


def links(nodes: DataFrame, bits: int, max_diff: int, block: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect every pair within ``max_diff`` bits.

    nodes: (id long, fp binary of bits / 8 bytes), one row per fingerprint.
    """
    n_bytes = bits // 8
    tuples, min_shared = posting_tuples(n_bytes, max_diff)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0), b.column(1)
            raw = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, n_bytes).astype(np.int64)
            for k, places in enumerate(tuples):
                key = np.full(len(raw), k, np.int64)
                for p in places:
                    key = (key << 8) | raw[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key), ids, fps], ["key", "id", "fp"])

    return _linked(nodes.mapInArrow(post, "key long, id long, fp binary"), n_bytes, min_shared, max_diff, block)


def _block(id, blocks, salt: int = 0):
    return F.pmod(F.xxhash64(id, F.lit(salt)), blocks).cast("int")


def _numbers(n):
    return F.sequence(F.lit(0), n - 1)


def _linked_in_groups(members: DataFrame, block: int, links_of) -> DataFrame:
    """Links that connect all that is linked inside the groups of ``members`` (key, id, any others).

    ``links_of`` takes members with the column ``at`` and gives links (a, b) that connect what is linked among the rows of equal
    key and ``at``. Groups of at most ``block`` members are one such run. Larger ones are cut into blocks: the first round joins each
    block with the first one, the second one joins the members that are not in the group's largest component so far with every
    block. Two members that no round brings together are both in that component, so no connection is lost.
    """
    spark = members.sparkSession
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    hot = common.materialize(counts.where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "hot-groups")
    mine = _block(F.col("id"), F.coalesce("blocks", F.lit(1)))
    again = F.when(F.coalesce("blocks", F.lit(1)) == 1, F.array(F.lit(0))).when(mine == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(mine))
    first = links_of(members.join(hot, "key", "left").withColumn("at", F.explode(again)).drop("blocks"))
    if hot.isEmpty():
        return first
    first = common.materialize(first, "first-links")
    parts, path = common.materialize_at(connected_components(first, "a", "b"), "parts")
    large = members.join(hot, "key").join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
    sizes = large.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("size")).where(F.col("size") > F.col("most.n"))
    rest = common.materialize(rest.select("key", F.col("most.part").alias("most"), F.ceil((F.col("size") - F.col("most.n")) / block).cast("int").alias("others")), "split-groups")
    if rest.isEmpty():
        common.remove(spark, path)
        return first
    open_ = large.join(rest, "key").withColumn("at", F.lit(0))
    i, j = _block(F.col("id"), F.col("others"), 1), _block(F.col("id"), F.col("blocks"))
    all_of = F.transform(_numbers(F.col("others")), lambda x: x * F.col("blocks") + j)  # a member in its block, beside each block of others
    outside = F.when(F.col("part") != F.col("most"), F.transform(_numbers(F.col("blocks")), lambda x: i * F.col("blocks") + x)).otherwise(F.array().cast("array<int>"))
    dealt = open_.withColumn("at", F.explode(F.array_union(all_of, outside))).drop("blocks", "part", "most", "others")
    second = common.materialize(links_of(dealt), "second-links")
    common.remove(spark, path)
    return first.unionByName(second)


def _linked(postings: DataFrame, n_bytes: int, min_shared: int, max_diff: int | None, block: int) -> DataFrame:
    """Links (a, b) that connect what shares a posting (key, id, fp) and lies within the limits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}  # of the nodes that this task links; forgetting it only repeats links
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                s = b.slice(at, 20_000)
                ids = s.column(0).flatten().to_numpy(zero_copy_only=False)
                words = np.frombuffer(b"".join(s.column(1).flatten().to_pylist()), np.uint64).reshape(-1, n_bytes // 8)
                off = s.column(0).offsets.to_numpy()
                x, y = _links_of_groups(ids, words, off - off[0], min_shared, max_diff)
                if len(root) > 1_000_000:
                    root.clear()
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                pairs = pairs[np.array(_joining(root, pairs), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def links_of(dealt: DataFrame) -> DataFrame:
        groups = dealt.groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("id", "fp"))).alias("m")).where(F.size("m") > 1)
        return groups.select(F.col("m.id").alias("ids"), F.col("m.fp").alias("fps")).mapInArrow(compare, "a long, b long")

    return _linked_in_groups(postings, block, links_of)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 64, max_diff: int = 3, block: int = 4096) -> DataFrame:
    """(doc_id, fp binary, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts whose fingerprints differ in at most ``max_diff`` bits are linked; component_id is the smallest doc_id reachable. Null
    and wordless texts have fingerprint zero and link like any other. Repeated rows give repeated results; a null doc_id is no
    candidate for component_id. An empty table gives an empty result.
    """
    rows = common.materialize(fingerprints(docs, words, bits), "fingerprints")
    nodes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = connected_components(links(nodes.where("id is not null").select("id", "fp"), bits, max_diff, block), "a", "b")
    classes = nodes.join(found, nodes.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def sketch(text: bytes, words: int = 5) -> tuple[bytes, bytes]:
    """Of the set of word shingles: a 128-bit digest, and a fingerprint of BYTES bytes, each voted by the shingle that is first in its order."""
    h = np.unique(shingle_hashes(text, words))
    low = np.full(BYTES, -1, np.int64).view(np.uint64)
    for at in range(0, len(h), 4096):
        m = (h[at : at + 4096] ^ _FLIPS) * _FACTORS
        m = (m ^ (m >> np.uint64(32))) * np.uint64(_MIX[1])
        low = np.minimum(low, m.min(1))
    voted = low * np.uint64(_MIX[0])
    return xxhash.xxh3_128_digest(h.tobytes()), (voted >> np.uint64(56)).astype(np.uint8).tobytes()


def _similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets with a Jaccard similarity of 0.8 or more, counted exactly."""
    size = np.array([len(s) for s in sets])
    off = np.concatenate([[0], np.cumsum(size)])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    left, edges = np.arange(len(sets)), []
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            at = queue.popleft()
            mine = np.zeros(len(known), bool)
            mine[flat[off[at] : off[at + 1]]] = True
            total = np.concatenate([[0], np.cumsum(mine[flat])])
            hit = 9 * (total[off[left + 1]] - total[off[left]]) >= 4 * (size[left] + size[at])
            found = left[hit]
            left = left[~hit]
            edges += [(at, x) for x in found]
            queue += found.tolist()
    return edges


def similar_documents(docs: DataFrame, words: int = 5, block: int = 512) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text): documents of Jaccard similarity 0.8 or more are linked.

    Equal sets of shingles collapse first. Two sets of similarity 0.8 agree on a byte with probability 0.8, so they share none of
    the 32 tuples of four bytes with probability (1 - 0.8 ** 4) ** 32 < 5e-8, and fewer than 24 of the 48 tallied bytes with
    probability below 2e-6. Unlike sets share a tuple with probability 32 / 2 ** 32. All that is proposed is compared exactly,
    component by component of the candidates, those above ``block`` members in two rounds of blocks like large postings. Null and
    wordless texts have the empty set and are equal. Repeated rows give repeated results; rows with a null doc_id are no
    candidates for component_id; an empty table gives an empty result.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            columns = zip(*[sketch(t, words) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.binary()) for c in columns]], ["doc_id", "digest", "fp"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BYTES)
            tallied = pa.array([r.tobytes() for r in np.ascontiguousarray(raw[:, :TALLIED])], pa.binary())
            keys = np.ascontiguousarray(raw).view(f"<u{TUPLE}").astype(np.int64) | np.arange(BYTES // TUPLE) << 8 * TUPLE
            for k in range(BYTES // TUPLE):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])), b.column(0), tallied], ["key", "id", "fp"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, all_ids, all_sets = b.column(0).offsets.to_numpy(), b.column(0).values, b.column(1).values
            pairs = []
            for x, y in zip(off[:-1], off[1:]):
                ids = all_ids.slice(x, y - x).to_pylist()
                pairs += [(ids[i], ids[j]) for i, j in _similar([np.frombuffer(t, np.uint64) for t in all_sets.slice(x, y - x).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long"), common.text_bytes().alias("t"))
    rows = common.materialize(texts.mapInArrow(sketches, "doc_id long, digest binary, fp binary"), "sketches")
    nodes = common.materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp")), "nodes")
    near = nodes.where("id is not null").select("id", "fp").mapInArrow(post, "key long, id long, fp binary")
    members = connected_components(_linked(near, TALLIED, LEAST, None, 4096), "a", "b")

    def links_of(dealt: DataFrame) -> DataFrame:
        sets = texts.join(dealt.select("id"), F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(shingles, "doc_id long, set binary")
        placed = sets.join(dealt, F.col("doc_id") == F.col("id")).groupBy("key", "at").agg(F.collect_list(F.struct("id", "set")).alias("m")).where(F.size("m") > 1)
        return placed.select(F.col("m.id").alias("ids"), F.col("m.set").alias("sets")).mapInArrow(compare, "a long, b long")

    groups = members.select(F.col("component").alias("key"), F.col("node").alias("id"))
    found = connected_components(_linked_in_groups(groups, block, links_of), "a", "b")
    classes = nodes.join(found, nodes.id == found.node, "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return rows.select("doc_id", "digest").join(classes, "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, any others) whose document has the smallest doc_id of its near-duplicate group.

    Groups connect documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; texts without words are
    equal. Rows with a null doc_id stay; rows that repeat a doc_id stay or go together.
    """
    groups = similar_documents(docs.select("doc_id", "text"), words)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs.doc_id == F.col("__gone"), "left_anti")


def op4_simhash(spark, sf_dir):
    """Query: fingerprints of three-word shingles, linked at three or fewer differing bits."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
