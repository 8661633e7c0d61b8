"""Exact top-k search by integer inner product: tiled matrix products, partial selection per tile, tree merging.

Queries and candidates are cut into tiles. The grid of (query block, candidate
tile) cells is dealt over the cluster, each cell is one matrix product whose k
best per query leave the task, and the short lists merge in two levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Largest sum of products that a double holds exactly.
EXACT = float(1 << 53)
#: Types that components travel in, with the greatest that each holds.
WIDTHS = (("smallint", (1 << 15) - 1), ("int", (1 << 31) - 1), ("bigint", (1 << 63) - 1))


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, q array<long>, d): floor(scale * x) of each component, only vectors without null or non-finite components."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fits)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"), F.size("embedding").alias("d"))


def _counted(df: DataFrame) -> tuple[int, int]:
    """(number of rows, greatest component x, or -x - 1 of a negative one) of (q)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("q"), -(F.least(F.array_min("q"), F.lit(0)) + 1))).alias("most")).first()
    return r["n"], r["most"] or 0


def best_of_tile(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best other rows in a tile; ties to the smaller candidate. c_ids ascend."""
    if np.abs(q).max(initial=0) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT:
        scores = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        scores = q.astype(object) @ c.astype(object).T
        scores = np.array(scores, dtype=np.int64)
    low = np.iinfo(np.int64).min
    scores[q_ids[:, None] == c_ids[None, :]] = low
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        i, j = np.nonzero((scores >= edge[:, None]) & (scores > low))
    else:
        i, j = np.nonzero(scores > low)
    s = scores[i, j]
    order = np.lexsort((c_ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.searchsorted(i, i, side="left")
    keep = np.arange(len(i)) - first < k
    return q_ids[i[keep]], c_ids[j[keep]], s[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, tile: int = 8192, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vectors``, itself excluded; ties to the smaller vec_id.

    vectors and queries: (vec_id, embedding), other columns ignored. Null vectors, null ids and vectors holding null or non-finite
    components take no part; vectors of another length than the query's are no candidates. Queries with fewer candidates get
    all of them, and none if there are none. Repeated query ids count once. Scores beyond 64 bits, of components beyond about 2 ** 27, raise
    an error. Components travel in the narrowest integers that hold all of them.
    """
    candidates = common.materialize(quantized(vectors, scale), "candidates")
    asked = common.materialize(quantized(queries, scale).dropDuplicates(["vec_id"]), "queries")
    (n_candidates, most), (n_asked, most_asked) = _counted(candidates), _counted(asked)
    n_tiles, n_blocks = max(1, -(-n_candidates // tile)), max(1, -(-n_asked // query_block))
    narrow = F.col("q").cast(f"array<{next(name for name, holds in WIDTHS if max(most, most_asked) <= holds)}>").alias("q")
    cell = ["d", "i", "j"]
    c = candidates.select("d", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("i"), F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)).cast("int").alias("j"), F.lit(False).alias("asks"), "vec_id", narrow)
    q = asked.select("d", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("j"), F.lit(True).alias("asks"), "vec_id", narrow)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("vec_id")
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        qm, cm = (np.array(p["q"].tolist(), np.int64).reshape(len(p), -1) for p in (a, b))
        found = [best_of_tile(qm[s : s + 256], cm, a["vec_id"].to_numpy()[s : s + 256], b["vec_id"].to_numpy(), k) for s in range(0, len(a), 256)]
        return pd.DataFrame({n: np.concatenate([f[x] for f in found]) for x, n in enumerate(("query_id", "vec_id", "score"))})

    lists = c.unionByName(q).groupBy(*cell).applyInPandas(search, "query_id long, vec_id long, score long")
    branch = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(n_tiles**0.5)))).cast("int")
    level = lists.withColumn("branch", branch).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    top = level.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir):
    """Query: five best rows for every vec_id divisible by 50, against all rows."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = {
    "op10_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
