"""Suffix-array deduplication: remove every byte covered by a string that already starts in an earlier document.

With ``length`` = 50, a document loses each byte that lies in a 50-byte string
which also starts in a document with a smaller doc_id. The work follows the
repeats, not the text:

1. Anchors. In every 50-byte window the 16-byte string of least hash is an
   anchor; equal windows choose the same anchor at the same place, so any
   repeat is seen from some anchor. About one place in 18 is an anchor. Its
   posting holds hashes of the anchor, of its whole context (everything that
   a window around it can see), and of the right and left parts, all taken
   from prefix polynomial hashes.
2. Postings meet by anchor. Equal contexts settle at once: all but the
   smallest doc_id's are repeats. Anchors whose right or left part recurs in
   an unequal context stand at the edge of a repeat and go on.
3. Edges. A window around an anchor holds the anchor's right or its left part
   whole. Each block of documents ships what the windows around its edge
   anchors can see, to where equal parts meet. There their suffixes are
   sorted, to the right and (reversed) to the left of the anchor, equal ones
   once for all that have them: a merge sort
   whose comparisons find the common extension by binary search on prefix
   hashes, each result verified on the bytes. Adjacent common extensions give
   the classes of equal windows, and all but the smallest doc_id's are repeats.
4. Each block applies the settled spans to its texts.

Postings and answers travel packed, a few per task and bucket; texts are
shuffled once, and their exchange is used by steps 3 and 4. The numbers of
blocks and buckets follow from the bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1  # places of an anchor in a window
RIGHT = WINDOW // 2  # anchors at most this far from the window's start see the right part whole
#: Bytes of text that are gathered and that are hashed at a time, and anchors that a task gathers before it ships them.
BUFFER, SPAN, FLUSH = 1 << 20, 1 << 22, 300_000
#: Edges that are sorted at a time, unless more of them share a part; bytes of text in a block of documents, and of a bucket's share.
EDGES, BLOCK_BYTES, BUCKET_BYTES = 20_000, 32 << 20, 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 28) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)  # a random value for each byte


class Prefixes:
    """Prefix polynomial hashes (modulo 2**64) of a byte buffer."""

    base, base_inverse, value = _BASE, _BASE_INVERSE, _VALUE
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n, kind = len(data) + 1, type(self)
        if len(kind.powers) < n:
            kind.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]))
            kind.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base_inverse)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * kind.powers[: n - 1])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the strings from a up to b."""
        return (self.sums[b] - self.sums[a]) * type(self).inverse[a]


class OtherPrefixes(Prefixes):
    """The same with another base and other values of the bytes."""

    base, base_inverse = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    value = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    powers = inverse = np.ones(1, np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM bytes from each place on."""
    h, m, step = _VALUE[data], _BASE, 1
    while step < GRAM:
        h = h[:-step] * m + h[step:]
        m = np.uint64(int(m) ** 2 % (1 << 64))
        step *= 2
    return mix(h)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on."""
    step, out = 1, v
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, document numbers) of the anchors of the windows inside the documents data[starts:ends] that start from ``first`` up to ``last``."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, np.empty(0, np.uint64), none
    h = gram_hashes(data)
    v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(v, WINDOW)
    inside = np.zeros(len(least) + 1, np.int32)
    big = ends - starts >= LENGTH
    np.add.at(inside, starts[big], 1)
    np.add.at(inside, ends[big] - LENGTH + 1, -1)
    mine = np.cumsum(inside[:-1]) > 0
    mine[:first] = False
    mine[len(mine) if last is None else last :] = False
    places = np.unique((least[mine] & _PLACE).astype(np.int64))
    return places, h[places], np.searchsorted(starts, places, side="right") - 1


def pack(*columns: np.ndarray, rest: bytes = b"") -> bytes:
    """Columns of equal length, and what may follow them, as one compressed blob."""
    return zstandard.compress(len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns) + rest, 1)


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    """The columns of a blob, and as the last one what follows them."""
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n, at))
        at += size
    return [*out, np.frombuffer(raw, np.uint8, -1, at)] if at < len(raw) else out


POSTING = ("<u4", "<u8", "<u4", "<u2", "<u2", "<i8", "<u4")  # anchor, two hashes of the context, right, left, document, place


def _postings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(gram, two independent hashes of the context, right, left, document, place in document) of all anchors; long buffers go in overlapping spans."""
    found = []
    for s in range(0, max(1, len(data)), span):
        a, b = max(0, s - 2 * LENGTH), min(len(data), s + span + 3 * LENGTH)  # no window of the span sees further
        docs = np.arange(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left"))
        found.append((*_posted(data[a:b], np.maximum(starts[docs] - a, 0), np.minimum(ends[docs] - a, b - a), s - a, s - a + span), docs, a))
    return tuple(np.concatenate(c) for c in zip(*[(*hashes, docs[doc], at + a - starts[docs[doc]]) for *hashes, doc, at, docs, a in found]))


def _posted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    at, gram, doc = anchors(data, starts, ends, first, last)
    lo, hi = np.maximum(starts[doc], at - (WINDOW - 1)), np.minimum(ends[doc], at + LENGTH)
    prefixes = Prefixes(data)
    shape = ((at - lo) * 256 + (hi - at)).astype(np.uint64)
    context = mix(prefixes.of(lo, hi) + shape * _BASE)
    other = mix(OtherPrefixes(data).of(lo, hi)) >> np.uint64(32)
    right = mix(prefixes.of(at, np.minimum(ends[doc], at + LENGTH - RIGHT)))
    left = mix(prefixes.of(np.maximum(starts[doc], at - RIGHT - 1), at + GRAM))
    return gram, context, other, right, left, doc, at


def buffers(ids: list[int], blocks: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about BUFFER bytes: (bytes, starts, ends, ids, blocks); texts too short to matter are left out."""
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        group.append(i)
        size += len(t)
        if size >= BUFFER:
            yield _joined(group, ids, blocks, texts)
            group, size = [], 0
    if group:
        yield _joined(group, ids, blocks, texts)


def _joined(group, ids, blocks, texts):
    ends = np.cumsum([len(texts[i]) for i in group])
    starts = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
    return data, starts, ends, np.array([ids[i] for i in group], np.int64), np.array([blocks[i] for i in group], np.int32)


def least_of(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """For each row, the least document among the rows with equal keys."""
    order = np.lexsort((doc, *keys))
    new = np.ones(len(doc), bool)
    if len(doc) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    out = np.empty_like(doc)
    out[order] = doc[order][first]
    return out


def most_of(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    return -least_of(keys, -doc)


def extension(prefixes: Prefixes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the strings at a and b, by binary search on prefix hashes."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = prefixes.of(a, a + mid) == prefixes.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


class Suffixes:
    """Strings in a buffer, sorted by a merge sort that compares through hashes; equal strings stay in their order."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.data, self.at, self.size, self.prefixes = data, at, size, Prefixes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Verified length of the common extension; a hash collision falls back to the bytes."""
        most = np.minimum(self.size[i], self.size[j])
        n = extension(self.prefixes, self.at[i], self.at[j], most)
        wide = int(n.max(initial=0))
        step = np.arange(wide)
        for part in np.array_split(np.arange(len(n)), len(n) // 20_000 + 1):
            x, y = (self.data[np.minimum(self.at[k[part]][:, None] + step, len(self.data) - 1)] for k in (i, j))
            differ = (x != y) & (step < n[part][:, None])
            wrong = differ.any(1)
            if wrong.any():
                n[part[wrong]] = differ[wrong].argmax(1)
        return n

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j (or equals it)."""
        most = np.minimum(self.size[i], self.size[j])
        n = extension(self.prefixes, self.at[i], self.at[j], most)
        ends = n == most
        x = self.data[np.minimum(self.at[i] + n, len(self.data) - 1)]
        y = self.data[np.minimum(self.at[j] + n, len(self.data) - 1)]
        shorter = np.where(or_equal, self.size[i] <= self.size[j], self.size[i] < self.size[j])
        return np.where(ends, shorter, x < y)

    def sort(self) -> np.ndarray:
        """Order of the strings: grouped by their first eight bytes, then merged within each group in runs of doubling width.

        In a merge every string finds its rank in the sister run by binary search.
        """
        step = np.arange(8)
        head = np.where(step < self.size[:, None], self.data[np.minimum(self.at[:, None] + step, len(self.data) - 1)], 0)
        key = np.ascontiguousarray(head, np.uint8).view(">u8").ravel()
        order, n = np.argsort(key, kind="stable"), len(key)
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        firsts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        start, end, width = firsts[group], np.append(firsts[1:], n)[group], 1
        while len(rows := np.flatnonzero(end - start > width)):
            a, z = start[rows], end[rows]
            place = rows - a
            run = place // width
            sister = a + (run ^ 1) * width
            low, high = np.minimum(sister, z), np.minimum(sister + width, z)
            base, first_run = low.copy(), run % 2 == 0
            while len(go := np.flatnonzero(low < high)):
                mid = (low[go] + high[go]) // 2
                x, y = order[mid], order[rows[go]]
                less = self.before(x, y, ~first_run[go])
                low[go] = np.where(less, mid + 1, low[go])
                high[go] = np.where(less, high[go], mid)
            merged = order.copy()
            merged[a + run // 2 * 2 * width + place - run * width + low - base] = order[rows]
            order, width = merged, width * 2
        return order


def window_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Classes of equal windows around anchors: for each distance of the anchor from the window's start, (distance, rows, class)."""
    right = np.minimum(ends[doc], at + LENGTH) - at
    left = at - np.maximum(starts[doc], at - (WINDOW - 1))
    r = Suffixes(data, at, right)
    mirror = Suffixes(data[::-1].copy(), len(data) - at, left)
    sides = []
    for s in (r, mirror):
        order = s.sort()
        shared = s.common(order[:-1], order[1:]) if len(order) > 1 else np.empty(0, np.int64)
        sides.append((order, shared))
    for off in range(WINDOW):
        rows = np.flatnonzero((left >= off) & (right >= LENGTH - off))
        if len(rows):
            ids = []
            for (order, shared), need in zip(sides, (LENGTH - off, off)):
                c = np.empty(len(order), np.int64)
                c[order] = np.concatenate([[0], np.cumsum(shared < need)])
                ids.append(c[rows])
            yield off, rows, ids[0] * (len(at) + 1) + ids[1]


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each document id; ``_block_column`` is the same in Spark."""
    x = ids.astype(np.int64) & np.int64((1 << 63) - 1)
    return (x ^ (x >> 13) ^ (x >> 29)) % blocks


def _block_column(name: str, blocks: int):
    x = F.col(name).bitwiseAND(F.lit((1 << 63) - 1))
    return F.coalesce(x.bitwiseXOR(F.shiftright(x, 13)).bitwiseXOR(F.shiftright(x, 29)) % blocks, F.lit(0)).cast("int")


ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("block", pa.int32()), ("blob", pa.binary())])
ROWS_DDL = "bucket int, kind byte, block int, blob binary"
#: Kinds of packed rows: postings or windows on their way to a bucket; anchors for a block; spans for a block.
SENT, ANCHORS, SPANS = 0, 1, 2


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROWS.types)] if rows else [pa.array([], t) for t in ROWS.types], schema=ROWS)


def _split(key: np.ndarray, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Rows of equal key together, in their order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield [c[part] for c in columns]


def _to_blocks(kind: int, blocks: int, bucket: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    block = block_of(doc, blocks)
    return [(bucket, kind, int(b[0]), pack(d, *rest)) for b, d, *rest in _split(block, block, doc, *columns)]


def _post(blocks: int, buckets: int):
    """Anchors of a task's texts, packed by bucket; repeats among the gathered texts are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> list[pa.RecordBatch]:
            gram, context, other, right, left, doc, place = (np.concatenate(c) for c in zip(*held))
            held.clear()
            old = doc > least_of((context, other, gram), doc)
            rows = _to_blocks(ANCHORS, blocks, 0, doc[old], place[old].astype(np.uint32), np.zeros(int(old.sum()), np.uint8))
            rows = [((int(place.sum()) + b) % buckets, kind, b, blob) for _, kind, b, blob in rows]  # they only pass through their bucket
            new = ~old
            bucket = (gram[new] >> np.uint64(40)) % np.uint64(buckets)
            columns = [gram[new].astype(np.uint32), context[new], other[new].astype(np.uint32), right[new].astype(np.uint16), left[new].astype(np.uint16), doc[new], place[new].astype(np.uint32)]
            for b, *rest in _split(bucket, bucket, *columns):
                rows.append((int(b[0]), SENT, 0, pack(*rest)))
            return _rows(rows).to_batches()

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                ids, texts = s.column(0).to_pylist(), s.column(1).to_pylist()
                known = [i for i, x in enumerate(ids) if x is not None]
                for data, starts, ends, names, _ in buffers([ids[i] for i in known], [0] * len(known), [texts[i] for i in known]):
                    *hashes, doc, place = _postings(data, starts, ends)
                    held.append((*hashes, names[doc], place))
                if sum(len(h[0]) for h in held) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _meet(blocks: int):
    """Settle postings of equal context; pass on those at the edges of repeats."""

    def run(table: pa.Table) -> pa.Table:
        kinds, bucket = table.column("kind").to_numpy(), table.column("bucket")[0].as_py()
        blobs = table.column("blob").to_pylist()
        rows = [(bucket, ANCHORS, b, x) for k, b, x in zip(kinds, table.column("block").to_pylist(), blobs) if k == ANCHORS]
        sent = [unpack(x, *POSTING) for k, x in zip(kinds, blobs) if k == SENT]
        if sent:
            gram, context, other, right, left, doc, place = (np.concatenate(c) for c in zip(*sent))
            old = doc > least_of((context, other, gram), doc)
            flag = np.zeros(len(doc), np.uint8)
            open_ = np.flatnonzero(~old)
            for bit, part in ((1, right), (2, left)):
                keys = (part[open_], gram[open_])
                flag[open_] |= np.where(least_of(keys, doc[open_]) != most_of(keys, doc[open_]), bit, 0).astype(np.uint8)
            tell = old | (flag > 0)
            rows += _to_blocks(ANCHORS, blocks, bucket, doc[tell], place[tell], flag[tell])
        return _rows(rows)

    return run


def _block_texts(docs: pa.Table) -> tuple[list, list[bytes], dict]:
    ids, texts = docs.column("i").to_pylist(), docs.column("t").to_pylist()
    first: dict = {}
    for k, i in enumerate(ids):
        if i is not None:
            first.setdefault(i, k)
    return ids, texts, first


def _answers(table: pa.Table, kind: int, *types: str) -> list[np.ndarray]:
    parts = [unpack(x, *types) for k, x in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k == kind]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, t) for t in types]


EDGE = ("<u8", "<i8", "<u4", "u1", "u1", "u1")  # hash of the shared part, document, place, kind, place of the anchor in the piece, length of the piece
#: The kind of an edge: its right or its left part recurs; and whether the document has the same piece at other places.
RIGHT_PART, LEFT_PART, ALSO = 1, 2, 4
#: For either part: how far a piece goes before and behind the anchor, and where the part stands.
SIDES = ((RIGHT_PART, RIGHT, LENGTH, (0, LENGTH - RIGHT)), (LEFT_PART, WINDOW - 1, LENGTH - RIGHT - 1, (-RIGHT - 1, GRAM)))


def _pieces(text: bytes, places: list[int], flags: list[int]) -> dict[tuple[int, int, bytes], list[int]]:
    """What the windows around the edge anchors of a text can see: (part, place of the anchor in the piece, piece) -> places, one or more."""
    out: dict[tuple[int, int, bytes], list[int]] = {}
    for x, f in zip(places, flags):
        for bit, before, after, part in SIDES:
            if f & bit and x + part[0] >= 0 and x + part[1] <= len(text):
                lo = max(0, x - before)
                out.setdefault((bit, x - lo, text[lo : x + after]), []).append(x)
    return out


def _by_document(doc: np.ndarray, *columns: np.ndarray) -> Iterator[list]:
    """[document, its rows of each column] for each document, as lists."""
    for d, *rest in _split(doc, doc, *columns):
        yield [int(d[0]), *[c.tolist() for c in rest]]


def _edges(blocks: int, buckets: int):
    """The pieces around edge anchors, on their way to where equal right or left parts meet; a document sends each of its pieces once."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        doc, place, flag = _answers(answers, ANCHORS, "<i8", "<u4", "u1")
        on = flag > 0
        if not docs.num_rows or not on.any():
            return _rows([])
        _, texts, first = _block_texts(docs)
        keys, owners, places, kinds, ats, pieces = [], [], [], [], [], []
        for i, x, f in _by_document(doc[on], place[on], flag[on]):
            for (bit, at, piece), where in _pieces(texts[first[i]], x, f).items():
                begin, end = next(part for b, _, _, part in SIDES if b == bit)
                keys.append(xxhash.xxh3_64_intdigest(piece[at + begin : at + end], bit))
                owners.append(i)
                places.append(min(where))
                kinds.append(bit | (ALSO if len(where) > 1 else 0))
                ats.append(at)
                pieces.append(piece)
        key = np.array(keys, np.uint64)
        bucket = key % np.uint64(buckets)
        columns = key, np.array(owners, np.int64), np.array(places, np.uint32), np.array(kinds, np.uint8), np.array(ats, np.uint8), np.array([len(p) for p in pieces], np.uint8)
        order = np.argsort(key, kind="stable")  # alike pieces stand together
        out = []
        for b, rows, *rest in _split(bucket[order], bucket[order], order, *[c[order] for c in columns]):
            out.append((int(b[0]), SENT, 0, pack(*rest, rest=b"".join([pieces[k] for k in rows.tolist()]))))
        return _rows(out)

    return run


def _recurring(pieces: list[bytes], at: np.ndarray, piece: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance of the anchor from the start of a window that a smaller doc_id has too, for each row; (255, 0) without any.

    Rows (piece number, document) share pieces, which are sorted once each. All windows around an anchor overlap, so what goes is one run of bytes.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(size)
    starts = ends - size
    at = starts + at
    h = gram_hashes(data)
    least = (sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), WINDOW) & _PLACE).astype(np.int64)
    owner = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(owner, piece, doc)
    low, high = np.full(len(doc), 255, np.uint8), np.zeros(len(doc), np.uint8)
    for off, rows, same in window_classes(data, starts, ends, np.arange(len(at)), at):
        ours = least[at[rows] - off] == at[rows]  # other windows are seen from another anchor
        rows, same = rows[ours], same[ours]
        smallest = np.full(len(pieces), np.iinfo(np.int64).max)
        smallest[rows] = least_of((same,), owner[rows])
        old = doc > smallest[piece]
        low[old] = np.minimum(low[old], off)
        high[old] = off
    return low, high


def _sort_edges(blocks: int, at_a_time: int):
    """Repeats among the windows around edges whose parts are equal."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [unpack(x, *EDGE) for x in table.column("blob").to_pylist()]
        key, doc, place, kind, at, size = (np.concatenate(c) for c in list(zip(*parts))[:6])
        data = b"".join([p[6].tobytes() for p in parts])
        ends = np.cumsum(size.astype(np.int64))
        order = np.argsort(key, kind="stable")
        firsts = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))
        firsts = np.append(firsts, len(order))
        alone = np.repeat(np.diff(firsts) == 1, np.diff(firsts))
        rows: list[tuple[int, int, int, bytes]] = []
        begin = 0
        for end in firsts[1:].tolist():  # equal parts stay together, however many there are
            if end - begin < at_a_time and end < len(order):
                continue
            part = order[begin:end][~alone[begin:end]]
            begin = end
            if not len(part):
                continue
            number: dict[tuple[int, bytes], int] = {}
            piece = np.array([number.setdefault((a, data[e - n : e]), len(number)) for a, e, n in zip(at[part].tolist(), ends[part].tolist(), size[part].tolist())], np.int64)
            low, high = _recurring([p for _, p in number], np.array([a for a, _ in number], np.int64), piece, doc[part])
            gone = low < 255
            rows += _to_blocks(SPANS, blocks, bucket, doc[part][gone], place[part][gone], kind[part][gone], low[gone], high[gone])
        return _rows(rows)

    return run


def _everywhere(texts: list[bytes], first: dict, anchors_: tuple[np.ndarray, ...], spans: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(document, place, least, greatest distance) of spans at all places of the piece that they stand for."""
    doc, place, kind, low, high = spans
    also = kind & ALSO > 0
    out = [(doc[~also], place[~also].astype(np.int64), low[~also], high[~also])]
    if also.any():
        wanted = np.isin(anchors_[0], doc[also])
        told = {i: list(zip(*rest)) for i, *rest in _by_document(doc[also], place[also], kind[also], low[also], high[also])}
        for i, x, f in _by_document(*[c[wanted] for c in anchors_]):
            same = {(bit, min(p)): p for (bit, _, _), p in _pieces(texts[first[i]], x, f).items()}
            for p, k, a, z in told[i]:
                at = np.array(same[k & ~ALSO, p], np.int64)
                out.append((np.full(len(at), i), at, np.full(len(at), a), np.full(len(at), z)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _cut(extra: list[str]):
    """Texts of a block without what the answers remove."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, first = _block_texts(docs)
        doc, place, flag = _answers(answers, ANCHORS, "<i8", "<u4", "u1")
        settled, on = flag == 0, flag > 0
        other, at, low, high = _everywhere(texts, first, (doc[on], place[on], flag[on]), _answers(answers, SPANS, "<i8", "<u4", "u1", "u1", "u1"))
        d = np.concatenate([doc[settled], other])
        lo = np.concatenate([place[settled].astype(np.int64) - (WINDOW - 1), at - high])
        hi = np.concatenate([place[settled].astype(np.int64) + LENGTH, at - low + LENGTH])
        order = np.argsort(d, kind="stable")
        d, lo, hi = d[order], lo[order], hi[order]
        kept, removed, runs = [], [], []
        for i, t in zip(ids, texts):
            a, b = np.searchsorted(d, [i, i + 1]) if i is not None else (0, 0)
            if a == b:
                kept.append(t)
                removed.append(0)
                runs.append(0)
                continue
            change = np.zeros(len(t) + 1, np.int32)
            np.add.at(change, np.maximum(lo[a:b], 0), 1)
            np.add.at(change, np.minimum(hi[a:b], len(t)), -1)
            gone = np.cumsum(change[:-1]) > 0
            kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        return pa.Table.from_arrays([docs.column("i"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), *[docs.column(c) for c in extra]], ["i", "n", "removed", "runs", "kept", *extra])

    return run


def _cleaned(docs: DataFrame, edges: int) -> tuple[DataFrame, dict[str, str]]:
    """(i, n, removed, runs, kept, one column for each other column of docs), and the names of the others."""
    spark = docs.sparkSession
    width = common.shuffle_width(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(width, size // BLOCK_BYTES) | 1, max(2 * width, size // BUCKET_BYTES)
    others = {c: f"x{k}" for k, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    named = docs.select(F.col("doc_id").cast("long").alias("i"), common.text_bytes().alias("t"), *[F.col(f"`{c}`").alias(x) for c, x in others.items()])
    base = named.withColumn("b", _block_column("i", blocks))
    posted = named.select("i", "t").mapInArrow(_post(blocks, buckets), ROWS_DDL)
    answers = common.materialize(posted.groupBy("bucket").applyInArrow(_meet(blocks), ROWS_DDL), "anchors")
    by_block = base.groupBy("b")
    seen = by_block.cogroup(answers.groupBy("block")).applyInArrow(_edges(blocks, buckets), ROWS_DDL)
    spans = seen.groupBy("bucket").applyInArrow(_sort_edges(blocks, edges), ROWS_DDL)
    types = dict(base.dtypes)
    ddl = ", ".join(["i long, n long, removed long, runs long, kept binary", *[f"{x} {types[x]}" for x in others.values()]])
    return by_block.cogroup(answers.unionByName(spans).groupBy("block")).applyInArrow(_cut(list(others.values())), ddl), others


def deduplicate(docs: DataFrame, edges: int = EDGES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any others) with what is left of its text.

    Returns doc_id, text (valid UTF-8: a character that is cut in part is dropped), kept (binary: the remaining bytes exactly),
    n_bytes, n_removed, n_spans (maximal removed runs) and the other columns, without those of the same names. Matches never
    cross documents; overlapping strings count, and strings are judged on the input. A doc_id names one text: rows that repeat it
    repeat the text, and don't count against each other. Null texts are empty; rows with a null doc_id neither lose bytes nor
    cost others any. An empty table gives an empty result. ``edges`` is how many edges a task sorts at a time. Contexts inside
    a repeat are matched by 96 bits of two independent hashes of the whole context (its bytes would be five times the text), its edges by the bytes.
    """
    cut, others = _cleaned(docs, edges)
    own = {"doc_id": F.col("i"), "text": valid_text("kept"), "kept": F.col("kept"), "n_bytes": F.col("n"), "n_removed": F.col("removed"), "n_spans": F.col("runs")}
    return cut.select(*[c.alias(n) for n, c in own.items()], *[F.col(x).alias(c) for c, x in others.items() if c not in own])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, whatever their names, and what is left of each text as its text."""
    cut, others = _cleaned(docs, EDGES)
    own = {"doc_id": F.col("i").cast(dict(docs.dtypes)["doc_id"]), "text": valid_text("kept")}
    return cut.select(*[(own[c] if c in own else F.col(others[c])).alias(c) for c in docs.columns])


def valid_text(name: str):
    """Bytes as text, without the bytes that are no valid UTF-8."""
    text = F.col(name).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "�", ""))


def op6_suffix_dedup(spark, sf_dir):
    """Query: what is removed from every document, and a digest of what is left."""
    out = deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
