"""Language identification and the quality classifier: definitions, edge cases and held-out accuracy."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brindle.llm import langid, quality
from brindle.llm.langid import LanguageModel, Scorer, counted, held_out, identify, tokens
from brindle.llm.queries_langid import op6_language_id
from brindle.llm.queries_quality import op1_quality_classifier

SF = "/root/testdata/sf0.01"
EDGES = [None, "", " \n", "12 34 !?", "½ ²", "a", "x" * 100_000, "the " * 20_000, "\U0001F600", "中文 字", "été"]


def brute_fit(docs, docs_per_lang=10**9, words_per_lang=20_000, grams_per_lang=8_000):
    """Each distinct text of a language once; the most frequent words and n-grams of each language (ties: the first)."""
    lists = {}
    for lang in {r.lang for r in docs if r.lang is not None and r.text is not None}:
        words = Counter(w for t in {r.text for r in docs if r.lang == lang and r.text is not None} for w in re.findall(r"[^\W\d_]+", t.lower()))
        by_length = {0: words}
        for n in (1, 2, 3, 4):
            by_length[n] = Counter(f"^{w}$"[i : i + n] for w in words for i in range(len(w) + 3 - n))
        for n, c in by_length.items():
            most = words_per_lang if n == 0 else grams_per_lang
            lists[lang, n] = dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most])
    return lists


def brute_score(lists, text, smooth=0.5):
    """Word by word: log frequencies of known words, else the mean over the longest n-grams that any language knows."""
    langs = sorted({lang for lang, _ in lists})
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not langs or not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    every = {n: set().union(*(lists.get((x, n), {}) for x in langs)) for n in range(5)}
    log = lambda lang, n, g: math.log((lists[lang, n].get(g, 0) + smooth) / (sum(lists[lang, n].values()) + smooth * len(every[n])))
    total = dict.fromkeys(langs, 0.0)
    for w in words:
        n, found = 0, [w] if w in every[0] else []
        for length in (4, 3, 2, 1):
            if not found:
                n, found = length, [g for i in range(len(w) + 3 - length) if (g := f"^{w}$"[i : i + length]) in every[length]]
        for lang in langs:
            total[lang] += sum(log(lang, n, g) for g in found) / max(1, len(found))
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(max(-700, t - total[best])) for t in total.values())


def test_words_come_before_ngrams():
    """A known word scores by its own frequency; an unseen one by the longest n-grams that are known."""
    rows = [("a", 0, "word", 8), ("b", 0, "word", 2), ("a", 0, "other", 2), ("b", 0, "other", 8)]
    rows += [("b", 4, "^wor", 9), ("a", 4, "zzzz", 9), ("b", 2, "^x", 5), ("a", 2, "y$", 5), ("a", 1, "q", 3), ("b", 1, "r", 3)]
    m = LanguageModel.from_counts(rows, smooth=0.5)
    s = Scorer(m)
    assert s.score("word")[0] == "a" and s.score("Other")[0] == "b"
    assert s.score("words")[0] == "b"  # a 4-gram of it is known
    assert s.score("xz")[0] == "b" and s.score("zy")[0] == "a" and s.score("q")[0] == "a" and s.score("r")[0] == "b"
    assert m.grams("words") == (4, [m.at[4]["^wor"]]) and m.grams("jjj") == (0, [])
    a = np.log(8.5 / 11)
    b = np.log(2.5 / 11)
    assert s.score("word")[1] == pytest.approx(1 / (1 + np.exp(b - a)), rel=1e-5)
    assert s.score("word words, word jjj 12")[2:] == (4, 2)


def test_scorer_forgets_without_changing_its_answers(monkeypatch):
    m = LanguageModel.from_counts([("a", 0, "known", 3), ("b", 0, "known", 1), ("a", 1, "x", 4), ("b", 1, "y", 4)])
    monkeypatch.setattr(langid, "REMEMBERED", 3)
    s, texts = Scorer(m), [f"known {'x' * k} {'y' * (k % 3)}z" for k in range(30)]
    assert [s.score(t) for t in texts] == [Scorer(m).score(t) for t in texts]


def test_pieces_cut_no_word(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcé 1.\n", k=3000)) + "x" * 500
    want = Counter(tokens(text))
    for size in (1, 2, 7, 100, 4000):
        monkeypatch.setattr(langid, "PIECE", size)
        assert "".join(langid.pieces(text)) == text and counted(text) == want


def test_many_languages_keep_the_model_small(spark):
    """Lists are cut in proportion, no language is refused, and rows are sparse."""
    docs = spark.range(6000).selectExpr("concat('w', translate(id, '0123456789', 'abcdefghij'), ' common') text", "concat('l', id % 1500) lang")
    m = langid.fit(docs, words_per_lang=100, grams_per_lang=50, most_entries=30_000)
    assert len(m.langs) == 1500 and len(m.gain) <= 30_000 and len(m.ends) <= 30_001
    assert m.gain.nbytes + m.lang.nbytes < 8 * 30_001


def test_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [*docs.collect(), *(Row(doc_id=10_000 + k, text=t, lang=[None, "en", "xx"][k % 3]) for k, t in enumerate([*EDGES, *EDGES, "ünder ßtraße", "zzz qqq"])), Row(doc_id=None, text="the of", lang="en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lists = brute_fit([r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
    want = sorted((str(r.doc_id), *brute_score(lists, r.text)) for r in rows)
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in op6_language_id(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-3, abs=1e-9)


def test_identify_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None), ("", "de")], "text string, lang string")
    m = langid.fit(train)
    assert m.langs == ["de", "en"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(EDGES)] + [(None, "the dog"), (None, "the dog")], "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("zz"), "score": F.lit("old"), "lang_pred": F.lit(3)})
    out = identify(df, m, score="score").collect()
    assert len(out) == len(EDGES) + 2
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0) and r.lang == "zz"
    assert identify(df.limit(0), m).count() == 0
    nothing = langid.fit(train.limit(0))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    """Each of the lowest hashes' texts is learnt from once, whatever the number of copies of it or of others."""
    read = []
    kept = LanguageModel.from_counts.__func__
    monkeypatch.setattr(LanguageModel, "from_counts", classmethod(lambda cls, rows: (read.extend(rows), kept(cls, rows))[1]))
    few = spark.range(4000).selectExpr("concat('few', char(97 + id % 4)) text", "'few' lang")
    hot = spark.range(5000).selectExpr("IF(id < 4000, 'hot', concat('rare', translate(id, '0123456789', 'abcdefghij'))) text", "'hot' lang")
    for k in (1, 3, 50, 700, 5000):
        read.clear()
        docs = few.union(hot)
        assert langid.fit(docs.repartition(7), docs_per_lang=k).langs == ["few", "hot"]
        got = {x: {(g, c) for lang, n, g, c in read if n == 0 and lang == x} for x in ("few", "hot")}
        for x in got:
            rows = docs.where(F.col("lang") == x).select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(k).collect()
            assert got[x] == {(r.text, 1) for r in rows}


def test_fold(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    for r in df.withColumn("h", held_out(F.col("doc_id"), 3, 1)).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_held_out(spark):
    out = op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    mine = [r for r in out if r.held_out]
    assert len(out) == 1000 and len(mine) > 250
    assert np.mean([r.lang == r.lang_pred for r in mine]) >= 0.99


# Quality


def brute_features(text, chunk):
    """Byte by byte and word by word, with plain integers."""
    most = (1 << 64) - 1
    out = [np.zeros(n) for n in (quality.BYTES, quality.PAIRS, quality.WORDS, quality.WORD_PAIRS)]
    if not text:
        return np.zeros(quality.WIDTH)
    b = text.encode()
    low = [min(x, 128) for x in b]
    pieces, at = [], 0
    while at < len(b):
        piece = b[at : at + chunk]
        if at + chunk < len(b) and any(x in b" \t\n\x0b\x0c\r" for x in piece):
            piece = piece[: max(k for k, x in enumerate(piece) if x in b" \t\n\x0b\x0c\r") + 1]
        pieces.append(piece)
        at += len(piece)
    words = [[w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", line) if w] for piece in [b"\0CUT\0".join(pieces)] for line in piece.split(b"\n")]
    words = [[v for w in line for v in w.split(b"\0CUT\0") if v] for line in words]

    def mix(h):
        h = ((h ^ h >> 31) * quality.SPREAD) & most
        return h ^ h >> 29

    hashed = lambda w: mix(sum((x + 1) * pow(quality.FACTOR, k, 1 << 64) for k, x in enumerate(w)) & most)
    lines = [tuple(map(hashed, line)) for line in words if line]
    h = [x for line in lines for x in line]
    for x in low:
        out[0][x] += 1
    for x, y in zip(low, low[1:]):
        out[1][(x * 31 + y * 7 + (x >> 3)) % quality.PAIRS] += 1
    for x in h:
        out[2][x % quality.WORDS] += 1
    for x, y in zip(h, h[1:]):
        out[3][mix((x * quality.FACTOR + y) & most) % quality.WORD_PAIRS] += 1
    windows = list(zip(h, h[1:], h[2:]))
    shares = [1 - len(set(x)) / len(x) if x else 0.0 for x in (windows, lines)]
    rest = [math.log1p(len(h)), math.log1p(len(lines)), len(b) / max(1, len(h)) / 10, len(set(h)) / max(1, len(h))]
    for s in shares:
        rest += [s, *(float(s >= step) for step in quality.STEPS)]
    return np.concatenate([*(np.sqrt(x / max(1, x.sum())) for x in out), rest])


FEATURED = [*(t for t in EDGES if t is None or len(t) < 1000), "\x00\n\n", "a b c a b c a b c\nx\n\n x \nx  \ty\n", "the quick brown fox " * 9 + "\n" + "lazy dog " * 3, "w" * 100 + " " + "é" * 90]


@pytest.mark.parametrize("chunk", [1 << 18, 16, 5])
def test_features_against_brute_force(chunk, monkeypatch):
    """Also where a text, a line or a word lies in several chunks."""
    monkeypatch.setattr(quality, "CHUNK", chunk)
    for t in FEATURED:
        assert np.allclose(quality.features(t), brute_features(t, chunk), atol=1e-6), t


def test_features_of_edges():
    for t in [*EDGES, "\x00\n\n", "a\n" * 1000, "\n" * 300_000]:
        x = quality.features(t)
        assert x.shape == (quality.WIDTH,) and np.isfinite(x).all()


def test_features_of_a_very_long_text_take_little_memory():
    text = "word and other wörds " * 1_500_000
    tracemalloc.start()
    quality.features(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(text)


def written_risk(w, p, u, prior):
    """prior * E_p[loss(z)] and E_u[loss(-z)] - prior * E_p[loss(-z)], row by row."""
    loss = lambda z: math.log1p(math.exp(-z))
    positive = sum(loss(float(x @ w)) for x in p) / len(p)
    negative = sum(loss(-float(x @ w)) for x in u) / len(u) - prior * sum(loss(-float(x @ w)) for x in p) / len(p)
    return prior * positive, negative


def test_gradient_is_that_of_the_risk_as_written():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (7, 4)), rng.normal(0, 1, (9, 4))
    seen = set()
    for prior in (0.2, 0.6, 0.95):
        for scale in (0.1, 1.0, 5.0):
            w = rng.normal(0, scale, 4)
            sign = 1 if written_risk(w, p, u, prior)[1] >= 0 else -1
            seen.add(sign)

            def whole(v, sign=sign, prior=prior):
                positive, negative = written_risk(v, p, u, prior)
                return positive + negative if sign > 0 else -negative

            slope = [(whole(w + e) - whole(w - e)) / 2e-6 for e in 1e-6 * np.eye(4)]
            assert np.allclose(quality.risk_gradient(w, p, u, prior), slope, atol=1e-5)
    assert seen == {1, -1}


def test_prior_as_written():
    """The least ratio of the shares that score at least c, over cuts that leave half of the positives."""
    rng = np.random.default_rng(3)
    sp, su = rng.normal(1, 1, 60), rng.normal(0, 1, 90)
    ratios = []
    for k in range(81):
        c = np.quantile(sp, 0.5 * k / 80)
        ratios.append((sum(x >= c for x in su) / 90) / (sum(x >= c for x in sp) / 60))
    want = min(ratios) - 0.5 * (1 / math.sqrt(90) + 1 / math.sqrt(60))
    assert quality.estimate_prior(sp, su) == pytest.approx(min(0.99, max(0.01, want)))


def test_quality_query_against_brute_force(spark):
    """Every document and trusted label outside the fold, in the order of their hashes; brute features, then the fit."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    good = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1 and not out(r.doc_id)]
    x = {k: brute_features(t, quality.CHUNK).astype(np.float32) for k, t in docs.items()}

    def sample(ids, seed):
        order = spark.createDataFrame([(k,) for k in ids], "k long").select("k", F.xxhash64("k", F.lit(seed)).alias("h")).collect()
        return np.vstack([x[r.k] for r in sorted(order, key=lambda r: (r.h, r.k))])

    m = quality.fit_arrays(sample(good, 1), sample([k for k in docs if not out(k)], 2))
    got = {r.doc_id: r for r in op1_quality_classifier(spark, sf).collect()}
    for k in docs:
        z = float(((x[k] - m.mean) * m.scale) @ m.w + m.bias)
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3) and got[k].held_out == out(k)


def test_repeated_keys_with_other_texts(spark):
    """Distinct texts of a key count once each, which of them is settled by hashes, and null keys are not learned from."""
    rows = [(1, f"text {k % 40}") for k in range(400)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "_id long, _text string")
    ids = docs.select("_id").where("_id IS NOT NULL").distinct()
    one, many = (quality._sampled(docs.repartition(n), ids, 25, 1) for n in (1, 6))
    assert one.shape == (25, quality.WIDTH) and (one == many).all()
    assert quality._sampled(docs, ids, 500, 1).shape[0] == 40


def test_prior_and_risk_on_known_mixtures():
    """Two Gaussian classes: the prior is near the share of positives, and labels are recovered without negatives."""
    rng = np.random.default_rng(11)
    for share in (0.3, 0.6, 0.85):
        good = rng.random(6000) < share
        xu = rng.normal(size=(6000, 12)).astype(np.float32)
        xu[good, :4] += 1.8
        xp = rng.normal(size=(3000, 12)).astype(np.float32)
        xp[:, :4] += 1.8
        m = quality.fit_arrays(xp, xu)
        assert abs(m.prior - share) < 0.08
        assert np.mean((m.score(xu) >= 0.5) == good) > 0.94


def test_too_few_rows_score_a_half(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string").withColumn("quality_score", F.lit("x"))
    m = quality.fit(docs, docs.select("doc_id").limit(0))
    assert [r.quality_score for r in quality.classify(docs, m).collect()] == [0.5] * 3
    assert quality.classify(docs.limit(0), m).count() == 0


def test_trusted_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted(labels).collect()] == [1]


def test_quality_held_out(spark):
    out = op1_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    mine = [r for r in out if r.held_out and r.quality is not None]
    good, bad = ([r.score for r in mine if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.85 and np.mean([s < 0.7 for s in bad]) > 0.85


def test_scores_do_not_depend_on_batches(spark):
    rng = random.Random(12)
    docs = [(k, " ".join(rng.choices(["good", "words", "###", "x"], k=rng.randrange(60)))) for k in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    m = quality.fit(df, df.where("doc_id % 3 = 0").select("doc_id"))
    one = {r.doc_id: r.quality_score for r in quality.classify(df.coalesce(1), m).collect()}
    many = {r.doc_id: r.quality_score for r in quality.classify(df.repartition(9), m).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-6) for k in one)
