"""Benchmark decontamination by a broadcast hash set of test n-grams, in DataFrame operations only.

A benchmark item's windows are its runs of n consecutive normalised words; an
item of fewer words is one window. The windows' hashes, their words and their
items are broadcast. Every window of a document is hashed where the document
is read and looked up; a hit counts only if its words are equal too. What a
document sends on is its hits and one row of its own, so texts are never
shuffled by the scan.

What is broadcast has a bound in bytes. A benchmark beyond it is cut into
parts by hash and the documents are scanned once for each; a part that is
beyond the bound by itself (a window of giant words) is joined without a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

N = 10
#: Bytes of test windows (words, items and hashes) that are broadcast at once.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that isn't lower-cased, with the separators before it.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def test_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(h, size, gram, items): each different window once, with the ids of its items as strings; benchmark: (item_id, text)."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.size("w"), F.lit(n)).alias("size"))
    each = w.select("item", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    grams = each.select("item", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("gram"))
    return grams.groupBy("size", "gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64(F.split("gram", " ")).alias("h"), "size", "gram", "items")


def parts_of(windows: DataFrame, most: int) -> tuple[list[int], list[DataFrame]]:
    """(window sizes, parts of the windows): each part within ``most`` bytes is marked for a broadcast."""
    weight = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 64
    seen = windows.agg(F.sort_array(F.collect_set("size")).alias("sizes"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()  # sizes 1 to n
    count = min(-(-seen["bytes"] * 2 // most), seen["n"]) if seen["bytes"] > most else 1
    part = F.pmod(F.xxhash64("gram", F.lit(count)), F.lit(count)).cast("int")
    large = {r["part"] for r in windows.groupBy(part.alias("part")).agg(F.sum(weight).alias("b")).where(F.col("b") > most).collect()}  # of ``count`` rows
    cut = [windows if count == 1 else windows.where(part == p) for p in range(count)]
    return list(seen["sizes"]), [w if p in large else F.broadcast(w) for p, w in enumerate(cut)]


def _hits(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, key, n_words, at, size, items): a row with ``at`` 0 for each document and one for each hit; at is the hit's first word, from 1."""
    w = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), words(F.col("text")).alias("w"))
    every = w.select("doc_id", "key", "w", F.size("w").alias("n_words"), F.posexplode_outer(F.concat(F.array(F.lit("")), "w")).alias("at", "word")).drop("word")
    if len(sizes) == 1:
        sized = every.withColumn("size", F.when(F.col("at") == 0, 0).otherwise(sizes[0]))
    else:
        sized = every.withColumn("size", F.explode_outer(F.when(F.col("at") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, sizes)))))
    inside = (F.col("at") > 0) & (F.col("at") + F.col("size") - 1 <= F.col("n_words"))
    window = F.slice("w", F.greatest("at", F.lit(1)), F.col("size"))
    hashed = sized.where((F.col("at") == 0) | inside).withColumn("hash", F.when(F.col("at") > 0, F.xxhash64(window)))
    found = hashed.join(windows.withColumnRenamed("size", "test_size"), F.col("hash") == F.col("h"), "left")
    # the words are compared after the join, so that they are only put together where the hashes agree
    equal = (F.col("test_size") == F.col("size")) & (F.col("gram") == F.array_join(window, " "))
    return found.where((F.col("at") == 0) | equal).select("doc_id", "key", "n_words", "at", "size", "items")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, key, n_words, hit_words, items) of every row of ``docs`` (doc_id, text); other columns are ignored.

    benchmark: (item_id, text). key is the text's sha256; hit_words are the positions, from 0, of the words inside any occurrence of a test
    window; items the ids of the items with such windows, as strings in their order. Null texts have no words, and items without
    words no windows. Repeated rows come out as often as they stand; a null doc_id is an id like others. An item without an id
    marks words but isn't listed; an id that stands twice is listed once. An empty benchmark hits nothing.
    """
    windows = common.materialize(test_windows(benchmark, n), "test-windows")
    sizes, parts = parts_of(windows, broadcast_bytes)
    rows = reduce(DataFrame.unionByName, [_hits(docs, w, sizes or [n]) for w in parts])
    mine = F.col("at") == 0
    per = rows.groupBy("doc_id", "key").agg(
        F.count_if(mine).alias("rows"), F.max("n_words").alias("n_words"), F.collect_set(F.when(~mine, F.struct("at", "size"))).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    hit = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"] - 1, x["at"] + x["size"] - 2)))))
    once = per.select("doc_id", "key", "n_words", hit.alias("hit_words"), "items", F.explode(F.array_repeat(F.lit(0), (F.col("rows") / len(parts)).cast("int"))).alias("copy"))
    return once.drop("copy")


def without_words(text: Column, hit_words: Column) -> Column:
    """A text without the words at these positions and the separators before each."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), hit_words), lambda i: F.get(pieces, i))
    tail = F.substr(text, F.aggregate(pieces, F.lit(0), lambda a, x: a + F.length(x)) + 1)
    return F.concat(F.array_join(kept, ""), tail)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = N) -> DataFrame:
    """``docs`` with all its columns, of any name, without what stands in the benchmark.

    remove: "spans" takes the hit words out of the texts, "documents" drops every document with a hit. Documents without a hit,
    null texts among them, stay as they are. Rows are matched to their hits by doc_id and the text's sha256.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown removal: {remove}")
    found = scan(docs.select("doc_id", "text"), benchmark, n).where(F.size("hit_words") > 0).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "hit_words").dropDuplicates(["hit_id", "hit_key"])
    whole = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("row_key"))
    j = whole.join(found, F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left")
    if remove == "documents":
        return j.where("hit_key is null").select("row.*")
    cut = F.when(F.col("hit_key").isNull(), F.col("row.text")).otherwise(without_words(F.col("row.text"), F.col("hit_words")))
    return j.select(F.col("row").withField("text", cut).alias("row")).select("row.*")


def op11_decontamination(spark, sf_dir):
    """Query: benchmark windows in every document."""
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op11_decontamination": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (SELECT DISTINCT size FROM g) s ON i + s.size - 1 <= len(w)),
h AS (SELECT doc_id, i, v.size, item_id FROM v JOIN g ON v.gram = g.gram AND v.size = g.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
