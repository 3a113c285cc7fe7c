"""Byte-level BPE over a global table of distinct words.

1. Texts are cut into pre-tokens with their positions. A task takes its rows in chunks of about ``chunk_chars``
   characters and sends one row for each chunk and bucket of words: the chunk's distinct words of that bucket and
   their codes; beside them goes one row with the code at every position. A frequent word is sent once a chunk.
2. All rows of a bucket meet in one task, which encodes each distinct word once and answers, row by row, with ids
   in place of words. It holds its bucket's distinct words and one row at a time.
3. The rows of a chunk meet again, ids are put back by position, and each document gets its ids.

Decoding looks every id up in the token-byte table, whose size is fixed by the vocabulary, so it is broadcast.

Chunks are numbered by partition and order, so that a repeated task sends the same rows: give a table that is read
from files, or store it first.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import give_back, small_batches

CHUNK_CHARS = 8 << 20
#: Bytes of encoded words that a task remembers, about, before it starts afresh (it then encodes some words again).
REMEMBERED = 384 << 20
#: What a word takes there beside its own bytes, and each of its ids.
WORD_BYTES, ID_BYTES = 220, 36
DOCS = -1
ROW = "chunk long, bucket int, words binary, places binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pack(values: np.ndarray) -> bytes:
    """Non-negative ints below 2**32 as compressed base-128 digits."""
    v = np.asarray(values, np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 5):
        n += v >= 1 << (7 * k)
    starts = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        m = n > k
        out[starts[m] + k] = ((v[m] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((n[m] > k + 1).astype(np.uint8) << 7)
    return zstandard.ZstdCompressor(level=1).compress(out.tobytes())


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    n, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(n.max(initial=0))):
        m = n > k
        out[m] |= (b[starts[m] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _sections(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _split(data: bytes, n: int) -> list[bytes]:
    ends = 4 * n + np.cumsum(np.frombuffer(data, "<u4", n))
    return [bytes(data[e - s : e]) for e, s in zip(ends.tolist(), np.frombuffer(data, "<u4", n).tolist(), strict=True)]


def _stream(codes: np.ndarray, shared: int) -> bytes:
    """Codes of a chunk's pre-tokens in order. Codes from ``shared`` on stand for words that occur once, numbered
    as they come, so that a mark is enough; a small code is one byte and others spread over four."""
    once = codes >= shared
    large = codes[(codes >= 254) & ~once].astype(np.int64) - 254
    first = np.where(once, 255, np.minimum(codes, 254)).astype(np.uint8)
    planes = [first, *((large >> s & 255).astype(np.uint8) for s in (0, 8, 16, 24))]
    return _sections(*(zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in planes), pack(np.array([shared])))


def _codes(stream: bytes) -> np.ndarray:
    *planes, shared = _split(stream, 6)
    first, *rest = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in planes)
    out = first.astype(np.int32)
    out[first == 254] += sum((x.astype(np.int32) << s for x, s in zip(rest, (0, 8, 16, 24), strict=True)), np.int32(0))
    once = first == 255
    out[once] = unpack(shared)[0] + np.arange(int(once.sum()), dtype=np.int32)
    return out


class Chunk:
    """Pre-tokens of consecutive documents: a code for each, in order, and the words the codes stand for."""

    def __init__(self, pattern: regex.Pattern):
        self.find = pattern.findall
        self.vocabulary: dict[str, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.codes: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.chars = 0

    def add(self, key: int | None, text: str | None) -> None:
        found = self.find(text) if text else []
        self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
        self.keys.append(key)
        self.chars += len(text or "")

    def rows(self, chunk: int, buckets: int) -> pa.RecordBatch:
        counts = np.array([len(c) for c in self.codes])
        keys = np.array([0 if k is None else k for k in self.keys], "<i8").tobytes()
        null = np.array([k is None for k in self.keys], np.uint8).tobytes()
        words = [w.encode() for w in self.vocabulary]
        codes = np.concatenate(self.codes)
        each = np.bincount(codes, minlength=len(words))
        # Frequent words come first, then those that occur once in order of appearance.
        order = np.argsort(-np.where(each > 1, each, 0), kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        out = [(chunk, DOCS, _sections(keys, null, pack(counts)), _stream(place[codes], int((each > 1).sum())))]
        if words:
            bucket = np.array([zlib.crc32(words[i]) % buckets for i in order])
            by_bucket = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(words)], strict=True):
                mine = by_bucket[lo:hi]
                here = [words[i] for i in order[mine]]
                text = zstandard.ZstdCompressor(level=3).compress(b"".join(here))
                out.append((chunk, int(bucket[mine[0]]), _sections(pack(np.array([len(w) for w in here])), text), pack(np.diff(mine, prepend=0))))
        c, b, w, p = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int32()), pa.array(w, pa.binary()), pa.array(p, pa.binary())], ["chunk", "bucket", "words", "places"])


def _put_back(rows: pa.Table) -> pa.Table:
    """A chunk's documents with their ids."""
    by_bucket = sorted(zip(rows["bucket"].to_pylist(), rows["words"].to_pylist(), rows["places"].to_pylist(), strict=True))
    (_, docs, stream), rest = by_bucket[0], by_bucket[1:]
    keys, null, counts = _split(docs, 3)
    counts, codes = unpack(counts), _codes(stream)
    size = int(codes.max(initial=-1)) + 1
    length, ref, flat, base = np.zeros(size, np.int32), np.zeros(size, np.int32), [], 0
    for _, words, places in rest:
        n, ids = map(unpack, _split(words, 2))
        at = np.cumsum(unpack(places))
        length[at], ref[at] = n, base + np.cumsum(n) - n
        flat.append(ids.astype(np.int32))
        base += len(ids)
    lengths, refs = length[codes], ref[codes]
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    if total >= 1 << 31:
        raise ValueError("a chunk has over 2**31 ids")
    where = np.repeat(refs - (ends - lengths).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)
    ids = np.concatenate(flat)[where] if flat else np.zeros(0, np.int32)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    key = pa.array(np.frombuffer(keys, "<i8"), pa.int64(), mask=np.frombuffer(null, np.uint8).astype(bool))
    return pa.Table.from_arrays([key, pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], ["doc_id", "ids"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id`` (the key, a long) and ``ids`` (array of int) for each row of ``docs``.

    Null and empty texts have no ids. Rows are kept one for one, also those with equal or null keys. Special
    tokens have no meaning: their strings are ordinary text. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    buckets = max(1, min(20_000, d.rdd.getNumPartitions()))
    table = d.sparkSession.sparkContext.broadcast(ranks)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        part, made, chunk = TaskContext.get().partitionId(), 0, Chunk(find)
        for batch in batches:
            for at in range(0, len(batch), 500):
                piece = batch.slice(at, 500)
                for k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    chunk.add(k, t)
                    if chunk.chars >= chunk_chars:
                        yield chunk.rows(part << 32 | made, buckets)
                        made, chunk = made + 1, Chunk(find)
        if chunk.keys:
            yield chunk.rows(part << 32 | made, buckets)
        del chunk
        give_back()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        held = 0

        def answer(data: bytes) -> bytes:
            nonlocal held
            lengths, text = _split(data, 2)
            ends = np.cumsum(unpack(lengths)).tolist()
            text = zstandard.ZstdDecompressor().decompress(text)
            found, start = [], 0
            for end in ends:
                w, start = text[start:end], end
                if (x := known.get(w)) is None:
                    if held >= REMEMBERED:
                        known.clear()
                        held = 0
                    x = known[w] = encoding.encode_ordinary(w.decode())
                    held += WORD_BYTES + len(w) + ID_BYTES * len(x)
                found.append(x)
            return _sections(pack(np.array([len(x) for x in found])), pack(np.array([i for x in found for i in x], np.int64)))

        for batch in batches:
            c, b, w, p = batch.columns
            for at in range(len(batch)):
                bucket, data = b[at].as_py(), w[at].as_py()
                answered = pa.array([data if bucket == DOCS else answer(data)], pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(at, 1), b.slice(at, 1), answered, p.slice(at, 1)], ["chunk", "bucket", "words", "places"])
        known.clear()
        give_back()

    sent = d.mapInArrow(words, ROW)
    spread = F.when(F.col("bucket") == DOCS, F.xxhash64("chunk")).otherwise(F.col("bucket").cast("long"))
    answered = sent.repartition(buckets, spread).mapInArrow(ids, ROW)
    return answered.groupBy("chunk").applyInArrow(_put_back, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; null ids give null, an id outside the table fails the job."""
    small_batches(encoded.sparkSession)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    rest = [c for c in encoded.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*rest).schema) + f", `{out}` binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            lists = batch.column(rest.index(ids))
            of = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            joined = tokens.take(lists.flatten())
            at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
            data = joined.buffers()[2] or pa.py_buffer(b"")
            texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at[of].tobytes()), data])
            texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*rest, out])
        give_back()

    return encoded.select(*rest).mapInArrow(join, schema)
