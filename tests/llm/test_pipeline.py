"""The corpus pipeline, stage by stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from brindle.llm import quality
from brindle.llm.bpe import read_ranks
from brindle.llm.mixing import mix
from brindle.llm.queries_quality import GOOD, quality_model
from brindle.llm.simhash import fingerprint
from brindle.scratch import run_folder
from tests.llm.test_models import brute_fit, brute_score

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """The documents, then each stage's rows, written and read as run() does."""
    out, root = [spark.read.parquet(f"{SF}/documents.parquet")], tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_dedup", "source_mix", "byte_bpe"]
    assert entry.queries()["pipeline"] is pipeline.run and pipeline.ORACLE_SQL is None


def test_columns(results):
    assert all(df.columns == COLUMNS for df in results[:-1])


def test_language_keeps_what_has_one(results):
    before, after = texts(results[0]), texts(results[1])
    assert all(before[k] == t for k, t in after.items())
    assert all(any(c.isalpha() for c in t) for t in after.values()) and len(after) >= 0.98 * len(before)


def test_language_stage_against_brute_force(spark, results, tmp_path):
    """Labelled documents beside ones that are mislabelled, unlabelled, of no language, of an unknown one, or without letters."""
    docs = [tuple(r) for r in results[0].where("doc_id < 400").collect()]
    of = {lang: next(t for _, t, x, _, _ in docs if x == lang and len(t) > 2000) for lang in ("en", "fr")}
    rng = random.Random(8)
    noise = " ".join("".join(rng.choices("qxzjkv", k=7)) for _ in range(80))
    extra = [(of["en"], "fr"), (of["en"], "en"), (of["fr"], None), (of["fr"], "xx"), (noise, None), (noise[::-1], "en"), ("qxzjkv", "en"), (None, "en"), ("", None), ("12 - 34", "de"), (of["en"], None)]
    rows = docs + [(5000 + k, t, lang, "s", 1) for k, (t, lang) in enumerate(extra)] + [(None, of["en"], "en", None, None)] * 2
    df = spark.createDataFrame(rows, results[0].schema)
    lists = brute_fit([Row(text=t, lang=x) for k, t, x, _, _ in rows if k is None or zlib.crc32(str(k).encode()) % 3 != 1])
    known, langs = set().union(*(c for (_, n), c in lists.items() if n == 0)), {x for x, _ in lists}
    want = []
    for r in rows:
        lang, _ = brute_score(lists, r[1])
        words = re.findall(r"[^\W\d_]+", (r[1] or "").lower())
        n, k = len(words), sum(w in known for w in words)
        if lang == "und" or (r[2] in langs and r[2] != lang) or (k + 4.5 + 3 * math.sqrt(k * (n - k) / n + 2.25)) / (n + 9) < pipeline.FAMILIAR:
            continue
        want.append((r[0], r[1], r[2] or lang, *r[3:]))
    got = pipeline.language_id(spark, df, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    stay = {r.doc_id: r.lang for r in got}
    assert 5000 not in stay and stay[5001] == "en" and stay[5002] == "fr" and stay[5010] == "en" and not stay.keys() & {5004, 5007, 5008, 5009}


def test_quality_keeps_good_documents(results, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts(results[1]), texts(results[2])
    kept = {q: np.mean([k in after for k in before if labels.get(k) == q]) for q in (0, 1)}
    assert kept[1] > 0.9 and kept[0] < 0.1


def test_one_of_each_group_stays(results):
    before, after = texts(results[2]), texts(results[3])
    fps = {k: fingerprint(t) for k, t in before.items()}
    near = {k: {j for j in fps if (fps[j] ^ fps[k]).bit_count() <= 3} for k in fps}
    todo, stay = set(fps), set()
    while todo:
        group, fresh = set(), {min(todo)}
        while fresh:
            group |= fresh
            fresh = set().union(*(near[k] for k in fresh)) - group
        stay.add(min(group))
        todo -= group
    assert after.keys() == stay


def test_mix_takes_its_words(results):
    want = {r.doc_id: r.taken for r in mix(results[3]).collect() if r.taken}
    got, before = defaultdict(int), texts(results[3])
    for r in results[4].collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.text == before[r.doc_id] or r.n_chars == len(r.text)
    assert dict(got) == want


def test_ids_of_every_row(results):
    library = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text))) for r in results[4].collect())
    assert Counter((r.doc_id, r.n_tokens) for r in results[5].collect()) == want


ODD = [
    (None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "The of and to " * 30, "en", "s", 420), (2, "The of and to " * 30, "en", "s", 420),
    (3, "x" * 200_000, None, "s", 1), (None, "of the and", "en", "s", 10), (None, "of the and", "en", "s", 10), (4, "of the and", None, None, 10), (5, "12 34", "en", "t", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_odd_rows_by_language(spark, odd):
    """What has a letter stays, with a language."""
    assert rows_of(pipeline.language_id(spark, odd, SF)) == Counter((k, t, lang or "en", s, n) for k, t, lang, s, n in ODD if t and t != "12 34")


def test_each_text_is_scored_once(spark, odd):
    """The filter on the language and the column that takes it do not run the model twice."""
    for stage in (pipeline.language_id, pipeline.quality_classifier):
        plan = stage(spark, odd, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1


def test_odd_rows_by_quality(spark, odd):
    """Rows stay or go with their equals, and those that stay are whole."""
    kept = rows_of(pipeline.quality_classifier(spark, odd, SF))
    assert all(n == Counter(ODD)[r] for r, n in kept.items())
    scores = {r.text: r.s for r in quality.classify(odd, quality_model(spark, odd, SF), score="s").collect()}
    assert kept == Counter(r for r in ODD if scores[r[1]] >= GOOD)


def test_odd_rows_without_copies(spark, odd):
    """One of each group, that with the smallest id; null ids come last."""
    kept = rows_of(pipeline.simhash_dedup(spark, odd, SF))
    assert kept == Counter([ODD[1], ODD[3], ODD[5], ODD[8], ODD[9]])


def test_odd_rows_in_the_mix(spark, odd):
    """Words of rows with any; whole rows first, then a part."""
    out = pipeline.source_mix(spark, odd, SF).collect()
    taken = {}
    for r in mix(odd.where("doc_id = 2 or doc_id > 2 or doc_id is null")).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += len(WORD.findall(r.text))
    assert dict(got) == {k: n for k, n in taken.items() if n} and all(r.text in {x[1] for x in ODD} or r.n_chars == len(r.text) for r in out)


def test_odd_rows_as_ids(spark, odd):
    library = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for k, t, *_ in ODD:
        ids = library.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(pipeline.byte_bpe(spark, odd, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == Counter(want)


def test_empty_tables_pass_every_stage(spark, odd):
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_run(spark, results):
    rows = pipeline.run(spark, SF).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, results[-1].collect()))


def test_run_leaves_its_result_alone(spark):
    root = Path(run_folder(spark).removeprefix("file://"))
    before = {p.name for p in root.iterdir()}
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.split("-")[0] for p in {p.name for p in root.iterdir()} - before] == ["byte_bpe"]
