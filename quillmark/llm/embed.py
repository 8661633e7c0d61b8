"""Embedding near-duplicates: spherical k-means cells, blocks of vectors that are read pair by pair, one representative kept.

Vectors travel once, to the block of their cell; equal ones meet there and become
one class. Pairs of blocks are then read from the stored table (a cartesian
product, which shuffles and stores nothing), and a task keeps one count and one
label for each vector that it has seen, so disk grows as the vectors, not as the
pairs.

Blocks of one cell are compared whole. In the cells of two others only guests
are: a vector is a guest in the cells whose bisecting plane (of the cell's
centroid and its home's) is nearer than half of r = sqrt(2 - 2 * limit). No pair
is lost, whatever the data and the centroids are: partners lie at most r apart,
so if their homes are c and d, which lie on either side of the bisecting plane of
c and d, one of them is within r / 2 of it and is a guest in the other's home.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Rows on which centroids are fitted at most, and their bytes; every row is assigned and compared.
FIT_ROWS, FIT_BYTES = 40_000, 64 << 20
#: Cells at most (the centroids are sent to every task: MAX_CELLS * dimension doubles).
MAX_CELLS = 4096
#: Bytes of a block's vectors in doubles, at most; rows of it that are multiplied at a time; pairs of blocks that are handed to Python at a time.
BLOCK_BYTES, TILE, PAIRS = 4 << 20, 1024, 4


def usable(vector) -> F.Column:
    """True for a vector that has a direction: not null or empty, no null or non-finite component, not all zero."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fits, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is taken out first, so that squares stay finite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit points; deterministic start from evenly spaced rows, empty cells keep their centroid."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(points, len(points) // 4096 + 1)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-9
        centroids[good] = sums[good] / norms[good][:, None]
    return np.unique(centroids, axis=0)


def _equal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse) of the distinct rows of a matrix, told by their bytes."""
    _, first, inverse = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, inverse.ravel()


class _Found:
    """Links and components of the vectors that one task has seen."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.ids = self.links = self.parent = np.zeros(0, np.int64)

    def place(self, block: int, ids: np.ndarray) -> int:
        """Where a block's vectors start."""
        if block not in self.at:
            self.at[block] = n = len(self.ids)
            self.ids, self.links = np.concatenate([self.ids, ids]), np.concatenate([self.links, np.zeros(len(ids), np.int64)])
            self.parent = np.concatenate([self.parent, np.arange(n, n + len(ids))])
        return self.at[block]

    def root(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while not np.array_equal(up := self.parent[found], found):
            found = up
        self.parent[nodes] = found
        return found

    def join(self, i: np.ndarray, j: np.ndarray, linked: np.ndarray) -> None:
        """Unite what a matrix of links between nodes i and j connects."""
        a, b = self.root(i), self.root(j)
        if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
            return
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        new = linked[np.ix_(rows, cols)] & (a[rows][:, None] != b[cols][None, :])
        for p, q in _forest(new):  # a spanning forest of the links, not all of them
            p, q = i[rows[p]], j[cols[q]]
            while p != self.parent[p]:
                p = self.parent[p]
            while q != self.parent[q]:
                q = self.parent[q]
            self.parent[max(p, q)] = min(p, q)


def _count(linked: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Links of each row of a matrix to columns that stand for ``n`` vectors each."""
    more = np.flatnonzero(n > 1)
    found = linked.sum(1, dtype=np.int64)
    return found + (linked[:, more].astype(np.float64) @ (n[more] - 1.0)).astype(np.int64) if len(more) else found


def near_duplicates(vectors: DataFrame, limit: float = 0.95, rows_per_cell: int = 8192, block: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Two rows are linked if the cosine of their vectors is at least ``limit`` in double precision. Equal vectors collapse to one
    class first. Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths are never linked. A row with a null vec_id counts as a link of others but is never a component's name.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind, each = ("<f4", "float") if single else ("<f8", "double")
    ids = F.col("vec_id").cast("long").alias("vec_id")
    good = usable(F.col("embedding"))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(ids, F.col("embedding").cast(f"array<{each}>").alias("v"), F.size("embedding").alias("d"))
    total = rows.groupBy("d").agg(F.approx_count_distinct(F.xxhash64("v")).alias("count")).collect()  # one row for each vector length
    centroids, first_block, per_block = {}, {}, {}
    for r in total:
        d = r["d"]
        cells = int(min(MAX_CELLS, max(1, r["count"] // rows_per_cell)))
        fit = min(FIT_ROWS, cells * 40, max(1, FIT_BYTES // (8 * max(1, d))))
        seen, share = rows.where(F.col("d") == d), max(1, r["count"] // (2 * fit))
        some = seen.where(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).groupBy("v").agg(F.count(F.lit(1))).orderBy(F.xxhash64("v"), "v").limit(fit).select("v").collect()
        x = unit(np.array([p["v"] for p in some or seen.limit(1).collect()], np.float64))
        centroids[d] = spherical_kmeans(x, min(cells, len(x)))
        per_block[d] = min(block, max(1, BLOCK_BYTES // (8 * d)))
        held = np.bincount((x @ centroids[d].T).argmax(1), minlength=len(centroids[d])) * r["count"] / len(x)
        first_block[d] = np.concatenate([[0], np.cumsum(np.ceil((held + 1) / per_block[d]).astype(np.int64))])  # an estimate; larger groups give more blocks
    sent = spark.sparkContext.broadcast((centroids, first_block, per_block))
    reach = float(np.sqrt(2 - 2 * limit)) / 2 + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, known = b.column("d").to_numpy(), np.array(b.column("vec_id").is_valid())
            ids = b.column("vec_id").fill_null(0).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                raw = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d) + np.array(0, kind)  # no -0
                first, inverse = _equal(raw)
                raw = raw[first]
                home = np.concatenate([(unit(part.astype(np.float64)) @ sent.value[0][d].T).argmax(1) for part in np.array_split(raw, len(raw) // 2000 + 1)])
                starts = sent.value[1][d]
                to = [int(starts[c]) + zlib.crc32(x.tobytes()) % int(starts[c + 1] - starts[c]) for c, x in zip(home, raw)]
                order = np.argsort(inverse, kind="stable")
                ends = np.cumsum(np.bincount(inverse))
                own = [(at[o], known[at[o]]) for o in np.split(order, ends[:-1])]
                yield pa.RecordBatch.from_pydict(
                    {"d": pa.array(np.full(len(raw), d, np.int32)), "to": pa.array(to, pa.int64()), "cell": pa.array(home.astype(np.int32)), "x": pa.array([x.tobytes() for x in raw], pa.binary()),
                     "ids": pa.array([ids[o[k]].tobytes() for o, k in own], pa.binary()), "nulls": pa.array([int((~k).sum()) for _, k in own], pa.int64())}
                )

    def pack(part: pa.Table) -> pa.Table:
        d, to, cell = (part.column(c)[0].as_py() for c in ("d", "to", "cell"))
        x = np.frombuffer(b"".join(part.column("x").to_pylist()), kind).reshape(-1, d)
        first, inverse = _equal(x)
        members: list = [[] for _ in first]
        for k, own in zip(inverse, part.column("ids").to_pylist()):
            members[k].append(own)
        members = [np.sort(np.frombuffer(b"".join(m), np.int64)) for m in members]
        nulls = np.bincount(inverse, part.column("nulls").to_numpy(), len(first)).astype(np.int64)
        named = np.array([k for k, m in enumerate(members) if len(m)], np.int64)
        lost = int(nulls.sum() - nulls[named].sum())
        c, out = sent.value[0][d], []
        span = reach * np.sqrt(np.maximum(2 - 2 * (c[cell] @ c.T), 1e-18))
        for k, at in enumerate(np.split(named, range(sent.value[2][d], len(named), sent.value[2][d]))):
            visits = np.zeros(len(c), bool)
            for p in np.array_split(at, len(at) // 1000 + 1) if len(at) else []:
                near = unit(x[first[p]].astype(np.float64)) @ c.T
                visits |= (near[:, [cell]] - near <= span).any(0)
            sizes = np.array([len(members[m]) for m in at], np.int64)
            out.append({
                "d": d, "cell": cell, "block": (to << 20) + k, "odd": bool((to + k) % 2), "visits": np.flatnonzero(visits).tolist(), "x": x[first[at]].tobytes(), "ids": np.array([members[m][0] for m in at], np.int64).tobytes(),
                "n": (sizes + nulls[at]).tobytes(), "sizes": sizes.tobytes(), "members": b"".join(members[m].tobytes() for m in at), "lost": 0 if k else lost,
            })
        return pa.Table.from_pylist(out, BLOCKS)

    BLOCKS = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("odd", pa.bool_()), ("visits", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("x", "ids", "n", "sizes", "members")], ("lost", pa.int64())])
    dealt = rows.mapInArrow(assign, "d int, to long, cell int, x binary, ids binary, nulls long").repartition(max(spark.sparkContext.defaultParallelism, common.shuffle_width(spark)), "d", "to")
    stored = dealt.groupBy("d", "to").applyInArrow(pack, "d int, cell int, block long, odd boolean, visits array<int>, x binary, ids binary, n binary, sizes binary, members binary, lost long")
    blocks = common.materialize(stored, "vector-blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        for b in batches:
            for r in b.to_pylist():
                x, y = (unit(np.frombuffer(r[k], kind).reshape(-1, r["d"]).astype(np.float64)) for k in ("x", "x2"))
                ids, ids2, n, n2 = (np.frombuffer(r[k], np.int64) for k in ("ids", "ids2", "n", "n2"))
                i = found.place(r["block"], ids) + np.arange(len(x))
                j = found.place(r["block2"], ids2) + np.arange(len(y))
                every = np.arange(len(y))
                if r["cell"] == r["cell2"]:
                    todo = [(np.arange(len(x)), every)]
                else:  # guests of either side
                    c, c2 = sent.value[0][r["d"]][r["cell"]], sent.value[0][r["d"]][r["cell2"]]
                    span = reach * np.sqrt(max(2 - 2 * float(c @ c2), 1e-18))
                    guest, guest2 = x @ c - x @ c2 <= span, y @ c2 - y @ c <= span
                    todo = [(np.flatnonzero(guest), every), (np.flatnonzero(~guest), np.flatnonzero(guest2))]
                for p, q in todo:
                    right = y if len(q) == len(y) else y[q]
                    for s in range(0, len(p) if len(q) else 0, TILE):
                        t = p[s : s + TILE]
                        linked = x[t] @ right.T >= limit
                        if r["block"] == r["block2"]:
                            linked &= q[None, :] > t[:, None]
                        if linked.any():
                            found.links[i[t]] += _count(linked, n2[q])
                            found.links[j[q]] += _count(linked.T, n[t])
                            found.join(i[t], j[q], linked)
        at = np.flatnonzero(found.links)
        root = found.root(at)
        least = np.full(len(found.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, found.ids[at])
        for s in range(0, len(at), 10_000):
            t = slice(s, s + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(found.ids[at[t]]), pa.array(found.links[at[t]]), pa.array(least[root[t]])], ["id", "links", "other"])

    left = blocks.where(F.length("x") > 0).select("d", "cell", "block", "odd", "visits", "x", "ids", "n")
    right = left.select(*[F.col(c).alias(f"{c}2") for c in left.columns])
    met = (F.col("cell") == F.col("cell2")) | F.array_contains("visits", F.col("cell2")) | F.array_contains("visits2", F.col("cell"))
    once = (F.col("block") == F.col("block2")) | ((F.col("odd") == F.col("odd2")) == (F.col("block") < F.col("block2")))  # either order, in turn
    pairs = left.hint("shuffle_replicate_nl").join(right, (F.col("d") <= F.col("d2")) & (F.col("d") >= F.col("d2")) & once & met).drop("d2", "odd", "odd2", "visits", "visits2")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(PAIRS))  # a pair of blocks is up to two times BLOCK_BYTES
    try:
        found = common.materialize(pairs.mapInArrow(compare, "id long, links long, other long"), "vector-links")
    finally:
        spark.conf.set(batch, before)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, n, sizes, own = (np.frombuffer(r[k], np.int64) for k in ("ids", "n", "sizes", "members"))
                nulls = np.repeat(np.arange(len(ids)), n - sizes)
                at = np.concatenate([np.repeat(np.arange(len(ids)), sizes), nulls])
                names = pa.concat_arrays([pa.array(own), pa.nulls(len(nulls), pa.int64())])
                if len(at):
                    yield pa.RecordBatch.from_arrays([names, pa.array(ids[at]), pa.array(n[at])], ["vec_id", "class", "n"])
                if r["lost"]:
                    yield pa.RecordBatch.from_arrays([pa.nulls(r["lost"], pa.int64()), pa.nulls(r["lost"], pa.int64()), pa.array(np.ones(r["lost"], np.int64))], ["vec_id", "class", "n"])

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("id <> other"), "id", "other")
    of = blocks.select("ids", "n", "sizes", "members", "lost").mapInArrow(members, "vec_id long, class long, n long")
    labelled = of.join(counts, F.col("class") == F.col("id"), "left").join(parts, F.col("class") == F.col("node"), "left")
    placed = labelled.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    alone = vectors.where(~F.coalesce(good, F.lit(False))).select(ids, F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Entries of a boolean matrix that connect the same rows and columns as all its entries do."""
    rows_left, cols_left, edges = linked.any(1), linked.any(0), []
    some = rows_left.copy()
    for start in np.flatnonzero(some):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        queue = [start]
        while queue:
            r = queue.pop()
            cols = np.flatnonzero(linked[r] & cols_left) if cols_left.any() else ()
            cols_left[list(cols)] = False
            edges += [(r, c) for c in cols]
            for c in cols:
                if not rows_left.any():
                    break
                new = np.flatnonzero(linked[:, c] & rows_left)
                rows_left[new] = False
                edges += [(n, c) for n in new]
                queue += new.tolist()
    return edges


def op9_embedding_neardup(spark, sf_dir):
    """Query: links at cosine 0.95 or more among all vectors."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
