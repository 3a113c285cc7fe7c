"""Training-order materialisation: token-id sequences in one permuted order, as fixed-stride binary shards.

Texts become sequences of ``seq_len`` ids. A first pass counts the sequences of each partition, so that a sequence's
index is exact: its place among its partition's sequences behind those of the partitions before it. A keyed Feistel
network permutes the indices 0 .. n - 1; where it leaves that range, it is applied again until it comes back
(cycle-walking). Its output is the sequence's global slot, and its inverse tells the index at any slot. The texts
are tokenised twice rather than stored in between: that would be one more copy of the corpus. Both times a task
takes its rows in chunks and encodes each distinct word of a chunk once.

A shard holds ``shard_bytes`` of slots in a row, so slot k is record k mod m of shard k // m. A task sorts a range of
slots and writes its shards one after the other, in records of equal stride: readers go through a file in sequence and
resume at any slot. Files carry a name of the attempt that wrote them; the manifest, which Spark commits, says which
of them count. Files that it does not name are left by lost attempts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import give_back, small_batches
from brindle.scratch import qualified

#: Bytes of a record before its ids: key (8), part of the text (4), ids that count (4).
HEAD = 16
NULL_KEY = -(1 << 63)
#: GPT-2's pattern: a space goes to the word behind it, and white space ends one character before a word.
BY_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts whose distinct words are encoded together, about.
CHUNK_BYTES = 16 << 20


class Feistel:
    """A keyed permutation of 0 .. n - 1 over arrays."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        if not 0 < n <= 1 << 62:
            raise ValueError("the range must have 1 to 2**62 places")
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.Generator(np.random.Philox(key)).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = x + key
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._mixed(right, k)
        return (left << np.uint64(self.half)) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ self._mixed(left, k), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = step(np.asarray(x, np.uint64))
            while (away := out >= np.uint64(self.n)).any():
                out[away] = step(out[away])
        return out.astype(np.int64)

    def place(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self._once)

    def index(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self._back)


@dataclass(frozen=True)
class Layout:
    """Records of ``seq_len`` ids of type ``<u2`` or ``<u4``, padded with ``pad``."""

    seq_len: int
    pad: int
    kind: str

    @property
    def stride(self) -> int:
        return HEAD + self.seq_len * int(self.kind[-1])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """For paths with a scheme: one without would be in each machine's own file system."""
    if ":/" not in path:
        raise ValueError("the path needs its scheme")
    return fs.FileSystem.from_uri(path)


def layout(ranks: dict[bytes, int], seq_len: int) -> Layout:
    """Padding is the first id behind the vocabulary."""
    pad = max(ranks.values()) + 1
    return Layout(seq_len, pad, "<u2" if pad < 1 << 16 else "<u4")


def shard_records(form: Layout, shard_bytes: int) -> int:
    return max(1, shard_bytes // form.stride)


def _white_ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which words start and which end with white space; an empty one does both."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    out = []
    for k, at in ((0, offsets[:-1]), (-1, offsets[1:] - 1)):
        white = np.diff(offsets) == 0
        first = np.zeros(len(words), np.uint8)
        first[~white] = data[at[~white]]
        # Printable ASCII is no white space; Python knows the rest.
        for i in np.flatnonzero(~white & ((first <= 32) | (first >= 127))).tolist():
            white[i] = words[i].as_py()[k].isspace()
        out.append(white)
    return out[0], out[1]


class Words:
    """Encodes texts word by word, each distinct word once a call.

    ``BY_WORD`` lets texts be cut before any space that has white space on one side at most: no piece reaches over it.
    Texts with a space between two white-space characters, and all with another pattern, are encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encode = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.by_word = pattern == BY_WORD
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def _ids(self, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word behind a space, in a row, and how many each has. The ``plain`` ones, without white space at
        their ends, are encoded as one text, in which just their first ids start with a space."""
        together = words.filter(pa.array(plain))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together), " ")[0].as_py()
        joined = np.array(self.encode(f" {text}") if len(together) else [], np.int32)
        others = [self.encode(f" {words[k].as_py()}") for k in np.flatnonzero(~plain).tolist()]
        n = np.zeros(len(words), np.int64)
        n[plain] = np.diff(np.flatnonzero(self.spaced[joined]), append=len(joined))
        n[~plain] = [len(x) for x in others]
        ids, of_plain = np.empty(int(n.sum()), np.int32), np.repeat(plain, n)
        ids[of_plain], ids[~of_plain] = joined, [i for x in others for i in x]
        return ids, n

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text (null: none), and all ids in a row."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        if not self.by_word:
            found = [self.encode(x or "") for x in texts.to_pylist()]
            return np.array([len(x) for x in found]), np.fromiter((i for x in found for i in x), np.int32)
        lists = pc.split_pattern(texts.fill_null(""), " ")
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().copy(), coded.dictionary
        left, right = _white_ends(words)
        bad = right[codes[:-1]] & left[codes[1:]]
        bad[first[1:] - 1] = False
        whole = np.unique(np.searchsorted(first, np.flatnonzero(bad), "right") - 1)
        # A text's first word has no space before it, and texts to be encoded whole have one code, at their first word.
        head, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(words)
        codes[first[whole]] = len(words) + len(head) + np.arange(len(whole))
        counts = np.diff(first, append=len(codes))
        if len(whole):
            stays = np.ones(len(texts), bool)
            stays[whole] = False
            stays = np.repeat(stays, counts)
            stays[first] = True
            codes, counts[whole] = codes[stays], 1
        ids, n = self._ids(words, ~(left | right))
        more = [self.encode(x) for x in [words[k].as_py() for k in head.tolist()] + [texts[k].as_py() for k in whole.tolist()]]
        table = np.concatenate([ids, np.fromiter((i for x in more for i in x), np.int32)])
        n = np.concatenate([n, [len(x) for x in more]]).astype(np.int64)
        each, starts = n[codes], np.cumsum(n) - n
        ends = np.cumsum(each)
        at = np.repeat(starts[codes] - (ends - each), each)
        at += np.arange(len(at))
        return np.add.reduceat(each, np.cumsum(counts) - counts), table[at]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order, in tables of about ``CHUNK_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed(heads: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Records (head, then ids without padding) as one binary array; ``ids`` are those of all records in a row."""
    head = HEAD // ids.dtype.itemsize
    ends = np.cumsum(lengths + head)
    at = (ends - lengths - head)[:, None] + np.arange(head)
    out, is_id = np.empty(int(ends[-1]), ids.dtype), np.ones(int(ends[-1]), bool)
    out[at.ravel()] = heads.view(ids.dtype).ravel()
    is_id[at.ravel()] = False
    out[is_id] = ids
    offsets = np.concatenate([[0], ends * ids.dtype.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _padded(records: pa.Array, form: Layout) -> bytes:
    """The records at their full stride."""
    offsets = np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records) + 1]
    size = int(form.kind[-1])
    data = np.frombuffer(records.buffers()[2], form.kind)[offsets[0] // size : offsets[-1] // size]
    lengths = np.diff(offsets) // size
    out = np.full((len(records), form.stride // size), form.pad, form.kind)
    within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(records)), lengths), within] = data
    return out.tobytes()


def materialise(
    docs: DataFrame,
    path: str,
    ranks: dict[bytes, int],
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    seq_len: int = 256,
    shard_bytes: int = 64 << 20,
    most_tasks: int = 16_384,
    seed: int = 42,
) -> DataFrame:
    """Writes the shards and returns their manifest: shard, file, n_records, first_slot.

    Null and empty texts have no sequences, and no sequences give no shards; the last sequence of a text is padded.
    Rows with equal keys are texts of their own; a null key is kept as null. The table must read alike each time (files,
    or stored first): otherwise the counts no longer hold and the job fails. ``path`` may lack its scheme: it is then
    in the default file system. ``most_tasks`` bounds the tasks that write, not what they write.
    """
    small_batches(docs.sparkSession)
    spark, path = docs.sparkSession, qualified(docs.sparkSession, path)
    d = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    form, vocabulary = layout(ranks, seq_len), spark.sparkContext.broadcast(ranks)

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        encoded = Words(vocabulary.value, pattern)
        for rows in _chunks(batches):
            for keys, texts in zip(rows.column(0).chunks, rows.column(1).chunks, strict=True):
                yield keys, *encoded(texts)
        give_back()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int((-(-sizes // seq_len)).sum()) for _, sizes, _ in tokenized(batches))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["p", "n"])

    # Two numbers for each partition that the texts are read in, as the scheduler itself holds of each.
    found = d.mapInArrow(counts, "p int, n long").where("n > 0").collect()
    total = sum(r["n"] for r in found)
    if not total:
        return spark.createDataFrame([], MANIFEST)
    each = np.zeros(max(r["p"] for r in found) + 2, np.int64)
    each[[r["p"] + 1 for r in found]] = [r["n"] for r in found]
    starts = spark.sparkContext.broadcast(np.cumsum(each))
    per_shard = shard_records(form, shard_bytes)
    n_shards = -(-total // per_shard)
    span = -(-n_shards // most_tasks)
    width, n_tasks = span * per_shard, -(-n_shards // span)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, feistel = TaskContext.get().partitionId(), Feistel(total, seed)
        at, end = (int(x) for x in starts.value[p : p + 2]) if p + 1 < len(starts.value) else (0, 0)
        for keys, sizes, ids in tokenized(batches):
            parts = -(-sizes // seq_len)
            n = int(parts.sum())
            if not n:
                continue
            if at + n > end:
                raise RuntimeError("a partition has other rows than when it was counted: store the table first")
            which = np.repeat(np.arange(len(keys)), parts)
            part = np.arange(n) - np.repeat(np.cumsum(parts) - parts, parts)
            heads = np.zeros(n, [("k", "<i8"), ("part", "<i4"), ("n", "<i4")])
            heads["k"] = keys.fill_null(NULL_KEY).to_numpy()[which]
            heads["part"], heads["n"] = part, np.minimum(sizes[which] - part * seq_len, seq_len)
            slot = feistel.place(np.arange(at, at + n))
            at += n
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // width).astype(np.int32)), _packed(heads, heads["n"].astype(np.int64), ids.astype(form.kind))], ["slot", "task", "record"])
        if at != end:
            raise RuntimeError("a partition has other rows than when it was counted: store the table first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _place(path)
        where.create_dir(root, recursive=True)
        first = TaskContext.get().partitionId() * width
        due, out, made = first, None, []
        try:
            for batch in batches:
                slots = batch.column(0).to_numpy()
                if (slots != np.arange(due, due + len(slots))).any():
                    raise RuntimeError("a task has other slots than its own")
                while len(batch):
                    if due % per_shard == 0:
                        if out:
                            out.close()
                        made.append((due // per_shard, f"shard-{due // per_shard:08d}-{uuid.uuid4().hex}.bin", min(per_shard, total - due)))
                        out = where.open_output_stream(f"{root}/{made[-1][1]}")
                    n = min(len(batch), per_shard - due % per_shard)
                    out.write(_padded(batch.column(1).slice(0, n), form))
                    batch, due = batch.slice(n), due + n
            if out:
                out.close()
            if due != min(first + width, total):
                raise RuntimeError("a task lacks slots")
        except BaseException:
            for _, name, _ in made:
                with suppress(OSError):
                    where.delete_file(f"{root}/{name}")
            raise
        rows = [*zip(*made, strict=True)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], ["shard", "file", "n_records"])

    permuted = d.mapInArrow(sequences, "slot long, task int, record binary")
    dealt = permuted.repartitionById(n_tasks, F.col("task")).sortWithinPartitions("slot").select("slot", "record")
    manifest = dealt.mapInArrow(write, "shard long, file string, n_records long").withColumn("first_slot", F.col("shard") * per_shard)
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return read_manifest(spark, path)


MANIFEST = "shard long, file string, n_records long, first_slot long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def read(manifest: DataFrame, path: str, form: Layout, start: int = 0, digest: bool = False) -> DataFrame:
    """Records from slot ``start`` on: slot, shard, doc_id, part, n_tokens, ids (without padding). Files before it are
    not opened; each task goes through its files in sequence. With ``digest``, ``ids_crc32`` stands for ``ids``: the
    CRC-32 of the decimal ids joined by one space, so that checks of whole shards need not move the ids."""
    path = qualified(manifest.sparkSession, path)
    left = manifest.where(F.col("first_slot") + F.col("n_records") > start)
    record = np.dtype([("k", "<i8"), ("part", "<i4"), ("n", "<i4"), ("ids", form.kind, (form.seq_len,))])
    last = "ids_crc32" if digest else "ids"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _place(path)
        texts = pa.array([f" {k}".encode() for k in range(form.pad + 1)], pa.large_binary()) if digest else None

        def digests(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
            joined = texts.take(pa.array(ids))
            at = np.frombuffer(joined.buffers()[1], np.int64)[ends].tolist()
            data = memoryview(joined.buffers()[2])
            return pa.array([zlib.crc32(data[a + 1 : b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())

        for batch in batches:
            for m in batch.to_pylist():
                skip = max(0, start - m["first_slot"])
                with where.open_input_file(f"{root}/{m['file']}") as f:
                    f.seek(skip * form.stride)
                    slot = m["first_slot"] + skip
                    while data := f.read(4096 * form.stride):
                        r = np.frombuffer(data, record)
                        ids = r["ids"][np.arange(form.seq_len) < r["n"][:, None]]
                        ends = np.concatenate([[0], np.cumsum(r["n"])])
                        n = len(r)
                        columns = [np.arange(slot, slot + n), np.full(n, m["shard"]), pa.array(r["k"], mask=r["k"] == NULL_KEY), r["part"], r["n"]]
                        out = digests(ids, ends) if digest else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), out], ["slot", "shard", "doc_id", "part", "n_tokens", last])
                        slot += n
        give_back()

    spread = left.repartition(max(1, left.sparkSession.sparkContext.defaultParallelism * 4), "shard")
    return spread.mapInArrow(records, f"slot long, shard long, doc_id long, part int, n_tokens int, {last} {'long' if digest else 'array<int>'}")
