"""Byte-level BPE, training-order shards and WARC archives."""

import gzip
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.llm import bpe, training_order, warc
from brindle.llm.common import shared_path, stored
from brindle.llm.queries_bpe import digests
from brindle.llm.training_order import BY_WORD, Feistel, Words, layout, materialise, read, read_manifest, shard_records

PATTERN = public_tokenizers.PATTERN
SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", " ", "\n\n  x", "a" * 5000, "don't we'll 's", "  lead  and trail  ", "é中\U0001F600 ñ²½Ⅷ", "<|endoftext|>", "\x00\x1c\x85 ", "word " * 30_000,
    "á‍﻿", "12345678 ٣٤", "\t\t\r\n", "'", "''s",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(13)
    alphabet = "ab é中'sld19²_- \n\t\U0001F600 "
    rows = list(enumerate([*TEXTS, *("".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(400))])) + [(None, "no key"), (3, "same key"), (3, "same key"), (None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "chunk": F.lit(1), "decoded": F.lit(2)}).coalesce(3)


def test_packing():
    rng = np.random.default_rng(14)
    for values in ([], [0], [127, 128, 2**14 - 1, 2**14, 2**21, 2**28, 2**32 - 1], rng.integers(0, 2**32, 5000)):
        assert bpe.unpack(bpe.pack(np.array(values, np.uint64))).tolist() == list(map(int, values))
    codes = np.concatenate([rng.integers(0, 70_000, 3000), [253, 254, 255, 69_999]])
    once = np.arange(70_000, 70_050)
    mixed = np.insert(codes, np.sort(rng.integers(0, 3000, 50)), once)
    assert bpe._codes(bpe._stream(mixed.astype(np.int32), 70_000)).tolist() == mixed.tolist()


@pytest.mark.parametrize("chunk_chars", [1 << 23, 1000, 1])
def test_encoding_equals_the_library(texts, ranks, library, chunk_chars):
    rows, df = texts
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode(df, ranks, PATTERN, chunk_chars=chunk_chars).collect()]
    assert sorted(got, key=repr) == sorted(((k, library.encode_ordinary(t or "")) for k, t in rows), key=repr)


def test_a_task_that_forgets_words_encodes_them_again(texts, ranks, library, monkeypatch):
    rows, df = texts
    monkeypatch.setattr(bpe, "REMEMBERED", 1000)
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode(df, ranks, PATTERN, chunk_chars=5000).collect()]
    assert sorted(got, key=repr) == sorted(((k, library.encode_ordinary(t or "")) for k, t in rows), key=repr)


def test_decoding(texts, ranks, spark):
    rows, df = texts
    back = bpe.decode(bpe.encode(df, ranks, PATTERN).withColumn("decoded", F.lit("old")), ranks).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=repr) == sorted(((k, (t or "").encode()) for k, t in rows), key=repr)
    none = spark.createDataFrame([(1, None), (2, []), (3, [50_255, 0])], "k int, ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.decode(none, ranks).orderBy("k").collect()] == [None, b"", b" gazed!"]


def test_digests_of_the_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    out = entry.queries()["op9_byte_bpe"](spark, SF).collect()
    assert len(out) == len(want)
    for r in out:
        ids = library.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_no_texts(spark, ranks, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert digests(none, ranks).count() == 0
    assert materialise(none, f"file://{tmp_path}/a", ranks, PATTERN).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.n_tokens for r in digests(blank, ranks).collect()] == [0, 0] and materialise(blank, f"file://{tmp_path}/b", ranks, PATTERN).count() == 0


# Training order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 4097])
def test_feistel_permutes(n):
    f = Feistel(n, key=7)
    places = f.place(np.arange(n))
    assert sorted(places) == list(range(n)) and f.index(places).tolist() == list(range(n))
    if n > 100:
        assert (Feistel(n, key=8).place(np.arange(n)) != places).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.15


def brute_slots(n, key):
    """The permutation in plain integers: rounds on two halves of an even number of bits, again while outside."""
    f = Feistel(n, key)
    bits, keys, most = f.half, [int(k) for k in f.keys], (1 << 64) - 1

    def mixed(x, k):
        x = (x + k) & most
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & most
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & most
        return (x ^ x >> 31) & ((1 << bits) - 1)

    def once(x):
        left, right = x >> bits, x & ((1 << bits) - 1)
        for k in keys:
            left, right = right, left ^ mixed(right, k)
        return left << bits | right

    out = []
    for x in range(n):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append(x)
    return out


def brute_order(df, library, seq_len, key=42):
    """Slot to (key, part, ids): sequences numbered in the order the table is read in, then permuted."""
    made = [(r.doc_id, p // seq_len, tuple(ids[p : p + seq_len])) for r in df.select("doc_id", "text").collect() for ids in [library.encode_ordinary(r.text or "")] for p in range(0, len(ids), seq_len)]
    return dict(zip(brute_slots(len(made), key) if made else [], made, strict=True))


@pytest.mark.parametrize("most_tasks", [16_384, 3])
def test_shards_hold_every_sequence_in_its_slot(texts, ranks, library, spark, tmp_path, most_tasks):
    _, df = texts
    path, form = f"file://{tmp_path}/shards", layout(ranks, 16)
    manifest = materialise(df, path, ranks, PATTERN, seq_len=16, shard_bytes=20_000, most_tasks=most_tasks)
    want, m = brute_order(df, library, 16), shard_records(form, 20_000)
    out = read(manifest, path, form).collect()
    assert len(out) == len(want) and {r.slot: (r.doc_id, r.part, tuple(r.ids)) for r in out} == want
    assert all(r.shard == r.slot // m and r.n_tokens == len(r.ids) for r in out) and len({r.shard for r in out}) > 5
    shards = sorted(read_manifest(spark, path).collect())
    assert [r.shard for r in shards] == list(range(-(-len(want) // m))) and {r.n_records for r in shards[:-1]} == {m}
    names = {p.name for p in (tmp_path / "shards").iterdir() if p.suffix == ".bin"}
    assert names == {r.file for r in shards}
    for r in shards:
        assert r.first_slot == r.shard * m and (tmp_path / "shards" / r.file).stat().st_size == r.n_records * form.stride
    later = read(manifest, path, form, start=len(want) - 777).collect()
    assert {r.slot: (r.doc_id, r.part, tuple(r.ids)) for r in later} == {s: x for s, x in want.items() if s >= len(want) - 777}
    raw = (tmp_path / "shards" / shards[1].file).read_bytes()[3 * form.stride : 4 * form.stride]
    k, part, n = struct.unpack("<qii", raw[:16])
    ids = np.frombuffer(raw[16:], form.kind).tolist()
    assert want[m + 3][1:] == (part, tuple(ids[:n])) and (want[m + 3][0] in (k, None)) and set(ids[n:]) <= {form.pad}


def test_slots_lead_back_to_sequences():
    for n in (1, 7, 1000, 4097):
        f = Feistel(n, 42)
        assert f.place(np.arange(n)).tolist() == brute_slots(n, 42) and f.index(np.array(brute_slots(n, 42))).tolist() == list(range(n))


@pytest.mark.parametrize("pattern", [PATTERN, r"[\s\S]{1,5}"])
def test_words_encode_as_the_library(ranks, pattern):
    """White space of all kinds, in every place, beside letters, marks and contractions."""
    library, encoded, rng = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), Words(ranks, pattern), random.Random(21)
    alphabet = [*"    \n\t\r\x0b\x1c\x85\u00a0\u2003\u3000\u180e\u200bab's1.é中\u0301\U0001f600", "ll", "word", "<|endoftext|>"]
    made = [None if rng.random() < 0.05 else "".join(rng.choices(alphabet, k=rng.randrange(20))) for _ in range(10_000)] + TEXTS
    want = [library.encode_ordinary(t or "") for t in made]
    for at, n in ((0, len(made)), (17, 4000), (5, 1), (9, 0)):
        sizes, ids = encoded(pa.array(made).slice(at, n))
        assert sizes.tolist() == [len(x) for x in want[at : at + n]] and ids.tolist() == [i for x in want[at : at + n] for i in x]


def test_a_repeated_word_is_encoded_once(ranks, monkeypatch):
    assert BY_WORD == PATTERN
    seen, plain = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: seen.append(text) or plain(self, text))
    docs = ["the quick brown fox, " * 1000, "the brown fox\nruns"] * 50
    sizes, _ = Words(ranks, PATTERN)(pa.array(docs))
    assert sizes[0] > 5000 and sum(map(len, seen)) < 100


@pytest.mark.parametrize("chunk_bytes", [1, 3000, 1 << 24])
def test_chunks_keep_rows_in_order(monkeypatch, chunk_bytes):
    monkeypatch.setattr(training_order, "CHUNK_BYTES", chunk_bytes)
    batches = pa.table({"k": range(1000), "t": ["x" * 20] * 1000}).to_batches(max_chunksize=40)
    tables = list(training_order._chunks(iter(batches)))
    assert pa.concat_tables(tables)["k"].to_pylist() == list(range(1000)) and len(tables) == {1: 25, 3000: 13, 1 << 24: 1}[chunk_bytes]


def test_path_without_a_scheme_is_in_the_default_file_system(texts, ranks, library, spark, tmp_path):
    _, df = texts
    path, form = str(tmp_path / "bare"), layout(ranks, 64)
    out = read(materialise(df, path, ranks, PATTERN, seq_len=64), path, form).collect()
    assert {r.slot: (r.doc_id, r.part, tuple(r.ids)) for r in out} == brute_order(df, library, 64)
    with pytest.raises(ValueError, match="scheme"):
        training_order._place(path)


def test_a_table_that_reads_otherwise_fails(ranks, spark, tmp_path):
    def grown(batches):
        n = np.random.default_rng().integers(1, 5000)
        for pdf in batches:
            yield pdf.assign(text="word " * int(n))

    changing = spark.range(50).withColumnRenamed("id", "doc_id").mapInPandas(grown, "doc_id long, text string")
    with pytest.raises(Exception, match="other rows"):
        materialise(changing, f"file://{tmp_path}/x", ranks, PATTERN, seq_len=4)
    assert not list((tmp_path / "x").glob("*.bin"))


def test_training_order_query(spark, library):
    sf = "/root/testdata/sf0.001"
    out = entry.queries()["op5_training_order"](spark, sf).collect()
    want = brute_order(spark.read.parquet(f"{sf}/documents.parquet"), library, 256)
    assert len(out) == len(want)
    assert {r.slot: (r.doc_id, r.part, r.n_tokens, r.ids_crc32) for r in out} == {s: (k, p, len(ids), zlib.crc32(" ".join(map(str, ids)).encode())) for s, (k, p, ids) in want.items()}


# WARC


PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/é?q=1", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://c/\r\nX: y", ""), (4, "u", None), (5, "u", "é\r\n\r\nWARC/1.1\r\n"),
    (None, "u", "<p>one</p>"), (None, "u", "only null keys"), (6, "u", "y" * 300_000), (7, "u", "z"), (7, "u", "z"), (8, "u", "same id"), (8, "u", "same id, other"), (-5, "u", "neg"),
]


def brute_pages(rows, least=0):
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "").encode() == data and j is not None), default=None)
        again = top is not None and k != top and len(data) >= least
        out.append((k, len(data), warc.digest(data), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({"sha": F.lit("x"), "payload": F.lit(1), "top": F.lit(2)}).repartition(3)


def test_pages_through_archives(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = entry.queries()["op10_warc"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute_pages(PAGES)


def test_small_payloads_are_all_responses(pages):
    kinds = sorted((r.warc_type, r.payload_bytes) for r in warc.records(pages, least_bytes=8).collect())
    assert kinds == sorted((x[3], x[1]) for x in brute_pages(PAGES, 8))


def test_query_equals_sql(spark, sf_dir, same):
    same(entry.queries()["op10_warc"](spark, sf_dir), entry.oracle_sql()["op10_warc"])


def test_no_pages(spark, pages):
    warc.register(spark)
    path = shared_path(spark, "none")
    warc.write(warc.records(pages.limit(0)), path)
    assert warc.load(spark, path).count() == 0


def test_every_record_has_an_id_of_its_own(spark, pages, tmp_path):
    """Also rows with equal and null keys; each revisit refers to a response with its payload, in the archive."""
    warc.register(spark)
    pages = stored(pages, "pages")
    warc.write(warc.records(pages), str(tmp_path / "bare"), date="2024-05-06T07:08:09Z")
    rows = warc.load(spark, str(tmp_path / "bare")).collect()
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows) == len(PAGES) and {r.warc_date for r in rows} == {"2024-05-06T07:08:09Z"}
    for r in rows:
        assert r.warc_type != "revisit" or (ids[r.refers_to].warc_type, ids[r.refers_to].payload_digest) == ("response", r.payload_digest)
    warc.write(warc.records(pages), str(tmp_path / "now"))
    (date,) = {r.warc_date for r in warc.load(spark, str(tmp_path / "now")).collect()}
    assert date[:4] > "2023"


def test_path_without_a_scheme_is_refused_by_the_source(spark, pages, tmp_path):
    """The source cannot tell which file system is meant; the helpers, which can, add it."""
    warc.register(spark)
    with pytest.raises(Exception, match="scheme"):
        spark.read.format("warc").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="scheme"):
        warc.records(pages).write.format("warc").mode("append").save(str(tmp_path))


def test_filters_are_pushed_and_payloads_skipped(spark, pages, tmp_path, monkeypatch):
    warc.register(spark)
    path = f"file://{tmp_path}/archive"
    warc.records(pages).write.format("warc").mode("append").option("file_bytes", "200").save(path)
    names = [p.name for p in (tmp_path / "archive").iterdir()]
    assert len(names) > 3 and not any(n.startswith(".") for n in names)
    df = lambda: spark.read.format("warc").load(path)
    for test, count in (("warc_type = 'revisit'", 4), ("target_uri LIKE 'http://%' AND warc_type = 'revisit'", 3), ("warc_type IN ('response')", 10), ("refers_to IS NOT NULL", 4)):
        found = df().where(test)
        assert found.count() == count
        assert "Filter" not in found._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    heads = spark.read.format("warc").schema("record_id string, content_length long").load(path)
    assert heads.count() == len(PAGES)
    reader = warc.WarcReader(path, heads.schema, 1 << 20)
    monkeypatch.setattr(warc.WarcReader, "_payload", staticmethod(lambda *a: pytest.fail("a payload was decoded")))
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == len(PAGES)


def test_foreign_archives(spark, tmp_path):
    """Plain files, members without a length, and one member for many records."""
    warc.register(spark)

    def head(kind, n, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\n{extra}Content-Length: {n}\r\n\r\n".encode()

    made = [head("warcinfo", 5) + b"a: b\n" + b"\r\n\r\n", head("resource", 70_000) + b"q" * 70_000 + b"\r\n\r\n", head("resource", 0) + b"\r\n\r\n"]
    (tmp_path / "plain.warc").write_bytes(b"".join(made))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no archive")
    for test, want in (("true", [0, 0, 5, 5, 70_000, 70_000]), ("warc_type = 'resource'", [0, 0, 70_000, 70_000])):
        assert sorted(r.payload_bytes for r in warc.load(spark, str(tmp_path)).where(test).collect()) == want
    ours = warc.member(b"x" * 1000)
    assert gzip.GzipFile(fileobj=io.BytesIO(ours)).read() == b"x" * 1000 and struct.unpack("<I", ours[16:20])[0] == len(ours)


def test_archives_follow_the_format(spark, pages, tmp_path):
    """Each record is head, blank line, block of the stated length, two line ends."""
    warc.records(pages).coalesce(1).write.format("warc").mode("append").save(f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").iterdir()
    data, n = gzip.decompress(file.read_bytes()), 0
    while data:
        top, _, rest = data.partition(b"\r\n\r\n")
        assert top.startswith(b"WARC/1.1\r\n")
        size = int(dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == len(PAGES)
