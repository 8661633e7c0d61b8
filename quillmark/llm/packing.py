"""Best-fit packing into sequences of several permitted lengths.

The packing of a multiset of lengths depends only on how often each length
occurs, and lengths are bounded by the longest permitted sequence, so the
plan is made on the histogram: best fit, longest first, with all pieces of one
length placed at once. Where no open bin has room, the size to open is chosen
for these bins alone: for each permitted size the pieces that are still to
come are tried in it, and the size opens whose filled bin costs least for each
unit that it holds. Pieces that a bin was opened for count as taken when the
next one is opened, so the sizes are optimised jointly. Finally every bin is
downsized to the shortest permitted length that holds its contents, and the
plan is kept unless opening one size throughout is cheaper. Pieces then find
their bins by their rank within their length, which is computed with map-side
counts and a salted window, so that no length, however frequent, lands in one
task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .store import ByteEncoder

#: Permitted sequence lengths, and the cost of a sequence besides its length.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096), 32


class Bins:
    """Groups of equal bins: (free, size) -> runs of consecutive bin numbers, each with its contents so far."""

    def __init__(self) -> None:
        self.open: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (free, first size) -> [first bin, count] runs
        self.order: list[tuple[int, int]] = []

    def put(self, free: int, size: int, first: int, count: int) -> None:
        if (free, size) not in self.open:
            self.open[free, size] = []
            insort(self.order, (free, size))
        self.open[free, size].append((first, count))

    def take(self, need: int) -> tuple[int, int, int, int] | None:
        """A run of bins of the least free room that is enough: (free, size, first bin, count)."""
        at = bisect_left(self.order, (need, 0))
        if at == len(self.order):
            return None
        key = self.order[at]
        run = self.open[key].pop()
        if not self.open[key]:
            del self.open[key], self.order[at]
        return (*key, *run)


class JointSizes:
    """Chooses the size of the next bins to open, by what the pieces that are still to come would fill them with."""

    def __init__(self, histogram: dict[int, int], lengths: tuple[int, ...], overhead: int) -> None:
        self.lengths, self.overhead = sorted(lengths), overhead
        self.left = dict(histogram)  # pieces for which no bin has been opened yet
        self.order = sorted(histogram)

    def _fill(self, size: int, length: int, count: int) -> tuple[int, int, list[tuple[int, int]]]:
        """(what a bin of this size would hold, how many pieces of the length, the shorter pieces), longest first."""
        own = min(count, size // length)
        free, with_it, at = size - own * length, [], bisect_left(self.order, length)
        while free and at:
            at = min(at, bisect_right(self.order, free)) - 1
            if at < 0:
                break
            shorter = self.order[at]
            n = min(self.left[shorter], free // shorter)
            with_it.append((shorter, n))
            free -= n * shorter
        return size - free, own, with_it

    def open(self, length: int, count: int) -> tuple[int, int]:
        """(size, number of bins to open) for ``count`` pieces of a length."""
        best = None
        for size in self.lengths[bisect_left(self.lengths, length) :]:
            held, own, with_it = self._fill(size, length, count)
            closed = self.lengths[bisect_left(self.lengths, held)]
            key = ((closed + self.overhead) / held, -held)
            if best is None or key < best[0]:
                best = key, size, own, with_it
        _, size, own, with_it = best
        bins = max(1, min([count // own, *(self.left[x] // n for x, n in with_it)]))
        for x, n in with_it:
            self.left[x] -= n * bins
            if self.left[x] <= 0:
                del self.left[x], self.order[bisect_left(self.order, x)]
        return size, bins


def plan(histogram: dict[int, int], lengths: tuple[int, ...], opening: int | JointSizes) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing on a histogram of piece lengths; ``opening`` is one size (longer where a piece needs it) or chooses for each run of bins.

    Returns placements (length, first rank, pieces, first bin, bins, offset): pieces of that length with ranks from the first on go
    to the bins in turn, round after round, each round one length further from the offset; and bins (first bin, bins, capacity),
    downsized to their contents.
    """
    bins, placed, n = Bins(), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            got = bins.take(length)
            if got is None:
                if isinstance(opening, JointSizes):
                    size, some = opening.open(length, left)
                else:
                    size = max(opening, min(c for c in lengths if c >= length))
                    some = -(-left // (size // length))
                got = (size, size, n, some)
                n += some
            free, size, first, count = got
            each = free // length  # equal pieces: the fullest bin that still has room is the best fit, so bins fill one by one
            full = min(count, left // each)
            if full:
                placed.append((length, rank, full * each, first, full, size - free))
                bins.put(free - each * length, size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count:
                some = int(left > 0)
                if some:
                    placed.append((length, rank, left, first + full, 1, size - free))
                    bins.put(free - left * length, size, first + full, 1)
                if full + some < count:
                    bins.put(free, size, first + full + some, count - full - some)
                left = 0
    sized = [(first, count, min(c for c in lengths if c >= size - free)) for (free, size), runs in bins.open.items() for first, count in runs if free < size]
    return placed, sized


def cost_of(sized: list[tuple[int, int, int]], overhead: int) -> int:
    return sum(count * (capacity + overhead) for _, count, capacity in sized)


def best_plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list, list]:
    """The joint plan, or that of a single opening size where it costs less; a bin costs its final capacity plus the overhead."""
    openings = [JointSizes(histogram, lengths, overhead), *sorted(lengths, reverse=True)]
    return min((plan(histogram, lengths, o) for o in openings), key=lambda p: cost_of(p[1], overhead))


def pack(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, salts: int = 256) -> DataFrame:
    """Pack items (doc_id, n): one row for each piece of an item.

    Returns (doc_id, piece, start, length, bin_id, bin_offset, capacity): items longer than the longest permitted length are cut
    into pieces of it and a rest; a piece's ``length`` units from ``start`` on stand at ``bin_offset`` of their bin. Empty items get
    one piece of length 0 without a bin (null). Null lengths count as 0, null ids are rows like others, repeated rows are packed as often as they
    occur; equal rows may swap places. An empty table gives an empty result.
    """
    spark = items.sparkSession
    longest = max(lengths)
    n = F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(0)), F.lit(0))
    whole = items.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(longest).cast("long"))
    pieces = whole.select("doc_id", "n", F.posexplode(starts).alias("piece", "start")).withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(longest)).cast("int"))
    pieces = common.materialize(pieces.select("doc_id", "piece", "start", "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt")), "pieces")
    counts = pieces.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in counts.where("length > 0").groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most longest + 1 rows
    placed, sized = best_plan(histogram, tuple(sorted(lengths)), overhead)
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranks = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1
    ranked = pieces.withColumn("r", ranks).join(before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    slim = ranked.select("doc_id", "piece", "start", "length", _places(spark, placed, sized)("length", "rank").alias("at"))
    return slim.select("doc_id", "piece", "start", "length", "at.bin_id", "at.bin_offset", "at.capacity")


def _places(spark, placed: list[tuple], sized: list[tuple]):
    """(bin_id, bin_offset, capacity) of a piece of a length and rank, as an Arrow batch function.

    What it looks up is sent to all tasks: it follows from the histogram, and its size is bounded by the permitted lengths (about a
    hundred runs of bins for each length at most), not by the number of pieces.
    """
    runs = np.array(sorted(placed), np.int64).reshape(-1, 6)
    bins = np.array(sorted(sized), np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs, bins))

    @F.pandas_udf("bin_id long, bin_offset long, capacity int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, runs, bins = sent.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        out = pd.DataFrame({c: pd.array([pd.NA] * len(n), t) for c, t in (("bin_id", "Int64"), ("bin_offset", "Int64"), ("capacity", "Int32"))})
        some = np.flatnonzero(n > 0)
        if len(some):
            own = runs[np.searchsorted(keys, n[some] << 44 | r[some], side="right") - 1]
            turn = r[some] - own[:, 1]
            bin_id = own[:, 3] + turn % own[:, 4]
            out.loc[some, "bin_id"] = bin_id
            out.loc[some, "bin_offset"] = own[:, 5] + turn // own[:, 4] * n[some]
            out.loc[some, "capacity"] = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 2].astype(np.int32)
        return out

    return place


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n): tokens of every document's whole text, with one end token; null texts count as empty."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_worker(ByteEncoder, spec.value)
        for b in common.slices(batches):
            counts = [len(ids) // encoder.kind.itemsize + 1 for ids in encoder.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t")).mapInArrow(run, "doc_id long, n long")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokenizer_path: str | None = None) -> DataFrame:
    """``pack`` for the token counts of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are one token long, the end token; null ids and repeated rows are rows like others; an empty table gives
    an empty result.
    """
    import public_tokenizers

    return pack(token_counts(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")), lengths)


def op5_packing(spark, sf_dir):
    """Query: all documents, by tokens, into sequences of 512 to 4096."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
