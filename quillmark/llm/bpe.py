"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 32 bytes cuts texts into chunks, so equal passages give
equal chunks wherever they stand. Documents are dealt by their smallest chunk
hash, which brings documents that share text together (of a large group each
reading task sends only a few there and spreads the rest); each task
encodes a chunk once while its bounded store lasts, whichever documents it
occurs in. A chunk is encoded from its first to its last white space (by the
library, or where its words are independent, from a bounded memory of the
library's ids of words, which costs half as much); a cut can fall inside a word, so what lies between two such bodies is a join, and
every join is repaired: it is encoded again in a window with the last words of
the body before it and the first of the body after it. The window must begin
and end with the ids that those words have alone, and the bodies must end and
begin with the same ids; as long as they don't agree, the window takes more
words on either side, to the whole text at last.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of chunks that a task keeps, and words that it remembers for windows.
STORE_BYTES, MEMO_WORDS = 12_000_000, 250_000
#: Of documents of one smallest hash, those that a reading task sends where others of NEAR neighbouring tasks go.
MEET, NEAR = 4, 256
#: Words on either side of a join, window by window.
WIDER = (1, 4, 16)
_SPACE = re.compile(rb"[\t-\r ]")


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash (modulo 2**32) of the ``width`` values from each place on; width is a power of two."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    m, step = np.uint32(0x85EBCA6B), 1
    while step < width:
        h = h[:-step] * m + h[step:] if len(h) > step else h[:0]
        with np.errstate(over="ignore"):
            m = m * m
        step *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(13))


def text_chunks(text: bytes, bits: int = 10, width: int = 32) -> list[bytes]:
    """Content-defined chunks of about 2**bits bytes; each cut falls before a whole UTF-8 character."""
    if len(text) <= width:
        return [text] if text else []
    data = np.frombuffer(text, np.uint8)
    cuts = np.flatnonzero(rolling_hash(data, width) >> np.uint32(32 - bits) == 0) + width
    for _ in range(3):
        inside = cuts < len(data)
        inside[inside] = (data[cuts[inside]] & 0xC0) == 0x80
        cuts = cuts + inside
    ends = np.unique(cuts[cuts < len(data)]).tolist() + [len(text)]
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Chunk:
    """A chunk of text: the bytes before its first white space, from there to its last white space (the body), and after that."""

    __slots__ = ("body", "head", "ids", "tail")

    def __init__(self, text: bytes) -> None:
        first = _SPACE.search(text)
        if first is None:
            self.head, self.body, self.tail = text, b"", b""
        else:
            self.tail = b"" if _SPACE.fullmatch(text[-1:]) else text.rsplit(None, 1)[-1]
            self.head, self.body = text[: first.start()], text[first.start() : len(text) - len(self.tail)]
        self.ids = b""

    def last_words(self, n: int) -> bytes:
        """The last n words of the body with all white space around them; the whole body if it has no more."""
        parts = self.body.rsplit(None, n)
        return self.body[len(parts[0]) :] if len(parts) > n else self.body

    def first_words(self, n: int) -> bytes:
        parts = self.body.split(None, n)
        return self.body[: len(self.body) - len(parts[-1])] if len(parts) > n else self.body


class ChunkEncoder:
    """Encodes documents from chunks, each encoded once while it is in the bounded store."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.name = {i: t.encode() for t, i in names.items()} if self.tokenizer.decoder is None else None
        self.store: dict[bytes, Chunk] = {}
        self.kept = 0
        self.words: dict[bytes, bytes] = {}  # what was used lately, and what was before
        self.older: dict[bytes, bytes] = {}
        one, *words = self.library([b" a1 b's\n\tC\r\n  d ", b"a1", b"b's", b"C", b"d"])
        self.independent = one == b"".join(words)  # white space separates words and leaves no trace
        self.whole = 0  # texts that no window could repair

    def library(self, texts: list[bytes]) -> list[bytes]:
        """Ids as unsigned 32-bit integers (little-endian, as the machines are), straight from the library."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False); without a decoder tokens are joined by spaces."""
        values = np.frombuffer(ids, "<u4").tolist()
        if self.name is not None:
            return b" ".join([self.name[i] for i in values])
        return self.tokenizer.decode(values, skip_special_tokens=False).encode()

    def chunks(self, texts: list[bytes]) -> list[list[Chunk]]:
        """The chunks of each text; those that the store doesn't hold are encoded."""
        cut = [text_chunks(t) for t in texts]
        new = list({c for cs in cut for c in cs if c not in self.store})
        if self.kept > STORE_BYTES:
            again = {c for cs in cut for c in cs} - set(new)
            self.store, self.kept = {c: self.store[c] for c in again}, sum(map(len, again))
        made = [Chunk(c) for c in new]
        for c, chunk, ids in zip(new, made, self.bodies([m.body for m in made])):
            chunk.ids = ids
            self.store[c] = chunk
        self.kept += sum(map(len, new))
        return [[self.store[c] for c in cs] for cs in cut]

    def bodies(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that begin and end at white space."""
        if not self.independent:
            known = dict.fromkeys(texts, b"")
            known.update(zip(known, self.library(list(known))))
            return [known[t] for t in texts]
        split = [t.split() for t in texts]
        words = set().union(*split)
        new = []
        for w in words:
            if w not in self.words:
                known = self.older.get(w)
                if known is None:
                    new.append(w)
                else:
                    self.words[w] = known
        self.words.update(zip(new, self.library(new)))
        out = [b"".join(map(self.words.__getitem__, ws)) for ws in split]
        if len(self.words) > MEMO_WORDS:
            self.words, self.older = {}, self.words
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            out += self._encode(texts[at : at + 256])
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        docs = self.chunks(texts)
        plans: list[list] = []  # ids of bodies, and numbers of joins
        joins: list[tuple[Chunk, bytes, Chunk]] = []
        for chunks in docs:
            plan, before, between = [], _NONE, b""
            for c in chunks:
                between += c.head
                if c.body:
                    plan += [len(joins), c.ids]
                    joins.append((before, between, c))
                    before, between = c, c.tail
            if between or before is not _NONE:
                plan.append(len(joins))
                joins.append((before, between, _NONE))
            plans.append(plan)
        repaired = self._repair(joins)
        out = []
        for text, plan in zip(texts, plans):
            parts = [p if isinstance(p, bytes) else repaired[p] for p in plan]
            if None in parts:
                self.whole += 1
                out += self.library([text])
            else:
                out.append(b"".join(parts))
        return out

    def _repair(self, joins: list[tuple[Chunk, bytes, Chunk]]) -> list[bytes | None]:
        """Ids of what stands between two bodies, from the narrowest window in which both sides agree; None where none does."""
        out: list[bytes | None] = [None] * len(joins)
        open_ = range(len(joins))
        for n in WIDER:
            sides = [(joins[i][0].last_words(n), joins[i][2].first_words(n)) for i in open_]
            alone = list({x for pair in sides for x in pair})
            ids = dict(zip(alone, self.bodies(alone)))
            windows = [a + joins[i][1] + b for i, (a, b) in zip(open_, sides)]
            known: dict[bytes, bytes] = dict.fromkeys(windows, b"")
            known.update(zip(known, self.library(list(known))))
            left = []
            for i, (a, b), w in zip(open_, sides, windows):
                before, _, after = joins[i]
                x, y, g = ids[a], ids[b], known[w]
                if before.ids.endswith(x) and after.ids.startswith(y) and g.startswith(x) and g.endswith(y) and len(x) + len(y) <= len(g):
                    out[i] = g[len(x) : len(g) - len(y)]
                else:
                    left.append(i)
            open_ = left
            if not open_:
                break
        return out


_NONE = Chunk(b"")


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids binary, decoded binary) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ids are little-endian unsigned 32-bit integers without special tokens added; decoded is the UTF-8 text that they decode to.
    Null and empty texts give empty ids and text; repeated rows and null ids are rows like others; an empty table gives an empty
    result. Chunks are of use where the pre-tokenizer breaks at ASCII white space and drops it; where words carry the white space
    before them, windows disagree and the library encodes whole texts.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = common.per_worker(ChunkEncoder, spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                ids = work.encode(s.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(ids, pa.binary()), pa.array(map(work.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return together(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def together(docs: DataFrame) -> DataFrame:
    """(doc_id, t binary) dealt so that documents that share text tend to meet, at most MEET * NEAR of them by their smallest chunk hash."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            keys = []
            for t in b.column(1).to_pylist():
                h = rolling_hash(np.frombuffer(t, np.uint8), 32)
                low = int(h.min()) if len(h) else len(t)
                k = seen[low] = seen.get(low, -1) + 1
                keys.append((low << 31) + (task // NEAR if k < MEET else (1 << 30) + ((task * 1009 + k // MEET) & ((1 << 30) - 1))))
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["doc_id", "t", "route"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("t")).mapInArrow(route, "doc_id long, t binary, route long")
    return dealt.repartition("route").select("doc_id", "t")


def op1_bpe(spark, sf_dir):
    """Query: digests of ids and decoded text of every document."""
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encode_decode`` reduced to (doc_id, n_tokens, ids_sha256, decoded_sha256); the same rows, nulls and repeats included."""
    out = encode_decode(docs, tokenizer_path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
