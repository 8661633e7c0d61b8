"""Incremental ledger: a stream of records upserted batch by batch into a versioned Parquet table that grows without a limit.

The table is an extendible hash directory. A leaf is a prefix of the bits of
a key's hash; when the bytes below a leaf outgrow a limit, the leaf is split
into longer prefixes, so a leaf's file is always work for one task. Beside
each file stands a Bloom filter of its keys. A batch looks its keys up in the
filters of the leaves that it touches, rewrites only files that may hold one
of them, and puts its other rows into a new file; a leaf of too many files is merged.

A version is one record of a commit log, created only if absent. Two writers
that start from one version both succeed where they touch different leaves; where
they don't, the second one starts again from what the first one left. Beside
each version stands the stream and the batch that made it, so a batch that
runs again changes nothing, and a new stream on an old ledger goes on where the ledger is.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import latest
from ..sources.commits import CommitLog, Snapshot

#: Bytes below a leaf, files below a leaf, versions whose folders are kept for readers that are still on them, and starts of a batch that meets other writers.
LEAF_BYTES, LEAF_FILES, KEEP, STARTS = 256 << 20, 8, 3, 50
#: Bits of a filter for each key, positions of a key, and slots of a directory that are still broadcast.
_BITS, _POSITIONS, _SLOTS = 16, 4, 1 << 16


def current_version(spark: SparkSession, path: str) -> int:
    """The live version; -1 before the first batch."""
    return CommitLog(spark, path).latest()


def _read(spark: SparkSession, path: str, folders: list[str], schema: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in sorted(folders)])


def current(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The table of the last version, or of one of the KEEP before it."""
    return _read(spark, path, list(CommitLog(spark, path).snapshot(version).files), schema)


def _in_leaf(rows: DataFrame, leaves: set[str]) -> DataFrame:
    """Rows with the leaf that their ``__hash`` belongs to."""
    deepest = max(len(x) - 1 for x in leaves)
    if not deepest:
        return rows.withColumn("__leaf", F.lit("r"))
    slots = [(int((x[1:] or "0") + "0" * (deepest - len(x) + 1), 2) + i, x) for x in leaves for i in range(1 << (deepest - len(x) + 1))]
    directory = rows.sparkSession.createDataFrame(slots, "__slot long, __leaf string")
    directory = F.broadcast(directory) if len(slots) <= _SLOTS else directory
    return rows.withColumn("__slot", F.shiftrightunsigned("__hash", 64 - deepest)).join(directory, "__slot").drop("__slot")


def _positions(hash_: Column, words: Column) -> Column:
    """(word, mask) of a key's bits in a filter of so many 64-bit words."""
    bit = lambda i: F.pmod(F.xxhash64(hash_, F.lit(i)), words * 64)
    return F.array(*[F.struct(F.floor(bit(i) / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit(i), F.lit(64)).cast("int")).alias("mask")) for i in range(_POSITIONS)])


def _may_hold(rows: DataFrame, files: list[dict], path: str) -> set[str]:
    """Folders of files that, by their filters, may hold one of the rows (__leaf, __hash)."""
    if not files:
        return set()
    spark = rows.sparkSession
    listed = spark.createDataFrame([(f["leaf"], f["folder"], f["words"]) for f in files], "__leaf string, folder string, words long")
    asked = rows.select("__leaf", "__hash").join(F.broadcast(listed), "__leaf").select("folder", "__hash", F.explode(_positions(F.col("__hash"), F.col("words"))).alias("p")).select("folder", "__hash", "p.*")
    at = spark.createDataFrame([(f["filter"], f["folder"]) for f in files], "filter string, folder string")
    scanned = spark.read.schema("word long, bits long").parquet(*[f"{path}/{f['filter']}" for f in files]).withColumn("filter", F.regexp_extract("_metadata.file_path", r"(filters/[^/]+/__leaf=[^/]+)/", 1))
    filters = scanned.join(F.broadcast(at), "filter").drop("filter")
    hits = asked.join(filters, ["folder", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    found = hits.groupBy("folder", "__hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == _POSITIONS).select("folder").distinct()
    return {r["folder"] for r in found.collect()}  # of the files of the touched leaves


def _bits_for(size: int, limit: int) -> int:
    """How many more bits of hash bring ``size`` to half a limit or less."""
    return max(1, (max(1, -(-2 * size // limit)) - 1).bit_length())


def _store(rows: DataFrame, leaves: set[str], log: CommitLog, path: str, limit: int) -> tuple[list[dict], set[str]]:
    """Write rows (with ``__hash``) leaf by leaf with their filters; (files, leaves). A leaf whose file turns out beyond the limit is split until none is."""
    spark, columns = rows.sparkSession, rows.columns
    name, added, round_ = uuid.uuid4().hex, [], 0
    rows = _in_leaf(rows, leaves)
    while True:
        data, large = f"data/{name}-{round_}", {}
        rows.repartition("__leaf").write.partitionBy("__leaf").parquet(f"{path}/{data}")
        for part in [n for n in log.folder.names(data) if n.startswith("__leaf=")]:
            file = {"folder": f"{data}/{part}", "leaf": part.removeprefix("__leaf="), "bytes": log.folder.bytes(f"{data}/{part}")}
            if file["bytes"] > limit:
                large[file["leaf"]] = file
            else:
                added.append(file)
        if not large:
            break
        written = spark.read.parquet(f"{path}/{data}").where(F.col("__leaf").isin(*large))
        single = {r["__leaf"] for r in written.groupBy("__leaf").agg(F.count_distinct("__hash").alias("n")).where("n = 1").collect()}  # a row that is beyond the limit by itself
        added += [large[x] for x in single]
        split = set(large) - single
        if not split:
            break
        leaves = (leaves - split) | {x + format(i, f"0{k}b") for x in split for k in [_bits_for(large[x]["bytes"], limit)] for i in range(1 << k)}
        rows = _in_leaf(written.where(F.col("__leaf").isin(*split)).select(*columns), leaves)
        round_ += 1
    if not added:
        return [], leaves
    slim = spark.read.schema("__hash long").parquet(*[f"{path}/{f['folder']}" for f in added]).withColumn("__leaf", F.regexp_extract("_metadata.file_path", "__leaf=([^/]+)/", 1))
    counts = {r["__leaf"]: r["n"] for r in slim.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = {leaf: 1 << (max(1, -(-n * _BITS // 64)) - 1).bit_length() for leaf, n in counts.items()}
    sizes = spark.createDataFrame(list(words.items()), "__leaf string, words long")
    bits = slim.join(F.broadcast(sizes), "__leaf").select("__leaf", F.explode(_positions(F.col("__hash"), F.col("words"))).alias("p")).groupBy("__leaf", "p.word").agg(F.bit_or("p.mask").alias("bits"))
    bits.repartition("__leaf").write.partitionBy("__leaf").parquet(f"{path}/filters/{name}")
    return [f | {"rows": counts[f["leaf"]], "words": words[f["leaf"]], "filter": f"filters/{name}/__leaf={f['leaf']}"} for f in added], leaves


def _drop(log: CommitLog, files: list[dict]) -> None:
    """Delete files and their filters, and the folders of a batch that are then empty."""
    paths = [f[k] for f in files for k in ("folder", "filter")]
    for p in paths:
        log.folder.remove(p)
    for above in {p.rsplit("/", 1)[0] for p in paths}:
        if not any(n.startswith("__leaf=") for n in log.folder.names(above)):
            log.folder.remove(above)


def _prepare(state: Snapshot, log: CommitLog, incoming: DataFrame, size: int, path: str, keys: tuple[str, ...], limit: int, most: int) -> dict:
    """The record of a batch on top of a version: what it adds and removes."""
    spark = incoming.sparkSession
    placed = _in_leaf(incoming, state.leaves)
    touched = {r["__leaf"]: r["n"] for r in placed.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # leaves of the directory
    total = sum(touched.values())
    held = {leaf: [f for f in state.files.values() if f["leaf"] == leaf] for leaf in touched}
    hit = _may_hold(placed, [f for files in held.values() for f in files], path)
    schema = ", ".join(f"`{n}` {t}" for n, t in incoming.dtypes)
    whole: set[str] = set()  # leaves that are rewritten as a whole
    while True:
        leaves, rewritten = set(state.leaves), set()
        for leaf, n in touched.items():
            expected = sum(f["bytes"] for f in held[leaf]) + size * n // max(1, total)
            if expected > limit:
                leaves = (leaves - {leaf}) | {leaf + format(i, f"0{k}b") for k in [_bits_for(expected, limit)] for i in range(1 << k)}
            everything = leaf in whole or expected > limit or sum(f["folder"] not in hit for f in held[leaf]) >= most
            rewritten |= {f["folder"] for f in held[leaf] if everything or f["folder"] in hit}
        before = _read(spark, path, list(rewritten), schema).alias("b")
        same = reduce(Column.__and__, [F.col(f"b.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], F.col("b.__hash") == F.col("i.__hash"))
        kept = before.join(incoming.select("__hash", *keys).alias("i"), same, "left_anti")
        added, now = _store(kept.unionByName(incoming), leaves, log, path, limit)
        left = {leaf for leaf in state.leaves - now if any(f["folder"] not in rewritten for f in held[leaf])}
        if not left:
            return {"add": added, "remove": [{"folder": x, "filter": state.files[x]["filter"]} for x in sorted(rewritten)], "closed": sorted(state.leaves - now), "opened": sorted(now - state.leaves), "touched": sorted(touched)}
        _drop(log, added)  # a leaf was split after all while one of its files stayed
        whole |= left


def upsert_batch(batch: DataFrame, batch_id: int, path: str, keys: tuple[str, ...], order: list[Column], source: str = "", limit: int = LEAF_BYTES, most: int = LEAF_FILES) -> dict | None:
    """Apply one micro-batch of a source; the last record of a key wins, and null is a key like others. A batch of that source that is already in changes nothing.

    Returns the record that was committed, or None. Columns that start with two underscores are kept for the table itself.
    """
    spark, log = batch.sparkSession, CommitLog(batch.sparkSession, path)
    if log.snapshot().sources.get(source, -1) >= batch_id:
        return None
    aside = f"incoming/{uuid.uuid4().hex}"
    latest(batch, keys, *order).withColumn("__hash", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])).write.parquet(f"{path}/{aside}")
    incoming = spark.read.schema(", ".join([*[f"`{n}` {t}" for n, t in batch.dtypes], "__hash long"])).parquet(f"{path}/{aside}")
    try:
        for _ in range(STARTS):
            state = log.snapshot()
            if state.sources.get(source, -1) >= batch_id:
                return None
            record = _prepare(state, log, incoming, log.folder.bytes(aside), path, keys, limit, most) | {"source": source, "batch_id": batch_id}
            version = log.commit(record, state.version)
            if version is not None:
                _drop(log, log.forget(version, KEEP))
                return record | {"version": version}
            _drop(log, record["add"])
    finally:
        log.folder.remove(aside)
    raise RuntimeError(f"other writers were first {STARTS} times")


def delete_where(spark: SparkSession, path: str, schema: str, gone: Column) -> dict | None:
    """Delete the rows for which ``gone`` is true, as a purge does; only files that hold such rows are rewritten. Returns the record, or None where there are none."""
    log, hashed = CommitLog(spark, path), f"{schema}, __hash long"
    for _ in range(STARTS):
        state = log.snapshot()
        rows = _read(spark, path, list(state.files), hashed)
        found = rows.where(gone).select(F.regexp_extract("_metadata.file_path", "(data/[^/]+/__leaf=[^/]+)/", 1).alias("folder")).distinct().collect() if state.files else []  # of the directory
        if not found:
            return None
        held = [state.files[r["folder"]] for r in found]
        kept = _read(spark, path, [f["folder"] for f in held], hashed).where(~F.coalesce(gone, F.lit(False)))
        added, now = _store(kept, state.leaves, log, path, max(LEAF_BYTES, *[2 * f["bytes"] for f in held]))
        record = {"add": added, "remove": [{"folder": f["folder"], "filter": f["filter"]} for f in held], "closed": sorted(state.leaves - now), "opened": sorted(now - state.leaves), "touched": sorted({f["leaf"] for f in held}), "source": "", "batch_id": None}
        version = log.commit(record, state.version)
        if version is not None:
            _drop(log, log.forget(version, KEEP))
            return record | {"version": version}
        _drop(log, added)
    raise RuntimeError(f"other writers were first {STARTS} times")


def changes(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], since: int, until: int | None = None) -> DataFrame:
    """(change, before, after) of each key whose row differs between two versions: insert, delete or update, with the rows as structs.

    Only files that were added or removed in between are read. ``since`` may be -1, before the first batch; else it must be one of the last
    KEEP versions, whose files are still there.
    """
    log = CommitLog(spark, path)
    old, new = log.snapshot(since) if since >= 0 else Snapshot(), log.snapshot(until)
    gone, came = (_read(spark, path, [f for f in x.files if f not in y.files], schema) for x, y in ((old, new), (new, old)))
    b, a = (df.select(*[F.col(k).alias(f"__{s}{i}") for i, k in enumerate(keys)], F.struct("*").alias(name)) for df, s, name in ((gone, "b", "before"), (came, "a", "after")))
    same = reduce(Column.__and__, [F.col(f"__b{i}").eqNullSafe(F.col(f"__a{i}")) for i in range(len(keys))])
    j = b.join(a, same, "full_outer")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.to_json("before").eqNullSafe(F.to_json("after")), "update")
    return j.select(kind.alias("change"), "before", "after").where("change is not null")


def start(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], order: list[Column], **trigger) -> StreamingQuery:
    """Run the upserts over a stream; ``trigger`` defaults to everything that is available. The checkpoint names the stream: batch numbers count within it."""

    def sink(batch: DataFrame, i: int) -> None:
        upsert_batch(batch, i, path, keys, order, checkpoint)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def error_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Successes and failures by event-time window and type; events later than ``late`` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type") if events.isStreaming else events.groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed")).select(F.col("window.start").alias("window_start"), "event_type", "n", "failed")
