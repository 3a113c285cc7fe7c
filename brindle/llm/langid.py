"""Language identification: word-first backoff.

A word the model knows scores by its log frequency in each language. An unseen word falls back to the
character n-grams of its padded form, the longest first; a shorter length is tried only where the model knows
none of the longer. A document's language is that of the highest sum over its words.

The model is fitted on a sample of labelled rows (the ``docs_per_lang`` distinct texts of each language with the lowest
hashes, or all where it has no more, each text once however many copies it has) and keeps ``words_per_lang`` words and
``grams_per_lang`` n-grams of each length, or fewer where there are so many languages that the model would have over
``most_entries`` entries. An entry is a gram in a language whose list it is on; a gram counts as unseen in other
languages. So the model's size is bounded whatever the corpus and the number of languages, and it is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import give_back, small_batches, stored

UNKNOWN = "und"
LENGTHS = (4, 3, 2, 1)
#: Unseen words whose n-grams a Python worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters that end where a run of letters ends."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (run := _LETTERS.match(text, end)):
            end = run.end()
        yield text[at:end]
        at = end


def tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def counted(text: str | None) -> Counter:
    """The text's words and how often each occurs, in order of first appearance."""
    out: Counter = Counter()
    for piece in pieces(text or ""):
        out.update(tokens(piece))
    return out


def _grams(word: str, n: int) -> list[str]:
    p = f"^{word}$"
    return [p[i : i + n] for i in range(len(p) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language as sparse rows.

    ``at`` has for length 0 (words) and for each length of n-grams the row of every known one. Row r's entries are
    ``ends[r] .. ends[r + 1]`` of ``lang`` and ``gain``: the log frequency above that of an unseen one, which is
    ``base`` by length and language.
    """

    langs: list[str]
    at: dict[int, dict[str, int]]
    ends: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @classmethod
    def from_counts(cls, rows: list[tuple[str, int, str, int]], smooth: float = 0.5) -> LanguageModel:
        """``rows``: language, length, gram, count; each (language, length, gram) once."""
        langs = sorted({r[0] for r in rows})
        of = {x: i for i, x in enumerate(langs)}
        at: dict[int, dict[str, int]] = defaultdict(dict)
        rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
        where, total, size = [], np.zeros((LENGTHS[0] + 1, len(langs))), 0
        for lang, n, gram, c in rows:
            if gram not in at[n]:
                at[n][gram] = size
                size += 1
            where.append(size - 1)
            total[n, of[lang]] += c
        total += smooth * np.array([[len(at.get(n, ()))] for n in range(LENGTHS[0] + 1)])
        with np.errstate(divide="ignore"):
            base = np.where(total > 0, np.log(smooth / total), 0.0)
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.array(where, np.int64), minlength=size))]).astype(np.int64)
        gain = np.log1p(np.array([r[3] for r in rows], np.float64) / smooth).astype(np.float32)
        return cls(langs, dict(at), ends, np.array([of[r[0]] for r in rows], np.int32), gain, base)

    def grams(self, word: str) -> tuple[int, list[int]]:
        """The longest length at which n-grams of the word are known, and their rows there; 0 and none otherwise."""
        p = f"^{word}$"
        for n in LENGTHS:
            if n in self.at:
                get = self.at[n].get
                if found := [x for i in range(len(p) - n + 1) if (x := get(p[i : i + n])) is not None]:
                    return n, found
        return 0, []


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[k] .. starts[k] + sizes[k]`` of all k in a row."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values, at least doubled where it lacks it."""
    if size <= len(a):
        return a
    out = np.zeros(max(int(size), 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Scorer(dict):
    """Scores texts. A word's value is its row where the model knows it, and -1 - k for the k-th unseen word met."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.known = model, model.at.get(0, {})
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(self.known)
        self.unseen = 0
        #: Of unseen words: the length of their n-grams, where these end, and their rows in the model.
        self.length, self.ends, self.rows = np.zeros(1024, np.int8), np.zeros(1025, np.int64), np.zeros(8192, np.int32)

    def learn(self, words: list[str]) -> None:
        found = [self.model.grams(w) for w in words]
        start, end = self.unseen, self.unseen + len(words)
        at = self.ends[start]
        sizes = np.array([len(rows) for _, rows in found], np.int64)
        self.length = _grown(self.length, end)
        self.ends = _grown(self.ends, end + 1)
        self.rows = _grown(self.rows, at + sizes.sum())
        self.length[start:end] = [n for n, _ in found]
        self.ends[start + 1 : end + 1] = at + np.cumsum(sizes)
        self.rows[at : at + sizes.sum()] = np.fromiter((r for _, rows in found for r in rows), np.int32, int(sizes.sum()))
        self.update(zip(words, range(-1 - start, -1 - end, -1), strict=True))
        self.unseen = end

    def _sum(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By language: the log frequencies of known words, and the mean ones of unseen words' n-grams."""
        length, rows, ends = self.length, self.rows, self.ends
        m, seen = self.model, ids >= 0
        new, often = -1 - ids[~seen], times[~seen]
        sizes = ends[new + 1] - ends[new]
        row = np.concatenate([ids[seen], rows[_spread(ends[new], sizes)]])
        weight = np.concatenate([times[seen], np.repeat(often / np.maximum(1, sizes), sizes)])
        sizes_ = m.ends[row + 1] - m.ends[row]
        entry = _spread(m.ends[row], sizes_)
        total = np.bincount(m.lang[entry], weights=np.repeat(weight, sizes_) * m.gain[entry], minlength=len(m.langs))
        by_length = np.bincount(length[new], weights=often * (sizes > 0), minlength=len(m.base))
        by_length[0] = times[seen].sum()
        return total + by_length @ m.base

    def score(self, text: str | None) -> tuple[str, float, int, int]:
        """Language and its posterior (``und`` and 0 for null texts and texts without a letter), words, and known words."""
        found = counted(text)
        n = found.total()
        if not self.model.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0, n, 0
        if self.unseen > REMEMBERED:
            self.forget()
        ids = list(map(self.get, found))
        if None in ids:
            self.learn([w for w, i in zip(found, ids, strict=True) if i is None])
            ids = list(map(self.__getitem__, found))
        at, times = np.array(ids, np.int64), np.fromiter(found.values(), np.float64, len(found))
        total = self._sum(at, times)
        best = int(total.argmax())
        score = float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())
        return self.model.langs[best], score, n, int(times[at >= 0].sum())


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words by occurrence and of n-grams by distinct word, summed over a partition."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            for piece in pieces(text):
                seen[lang].update(tokens(piece))
    for lang, counter in seen.items():
        out = {0: counter} | {n: Counter() for n in LENGTHS}
        for w in counter:
            for n in LENGTHS:
                out[n].update(_grams(w, n))
        for n, c in out.items():
            if c:
                yield pd.DataFrame({"lang": lang, "n": n, "gram": list(c), "c": list(c.values())})
    del seen
    give_back()


def _below(d: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with a hash up to their language's ``bound``, where it has one."""
    return d.join(bounds.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"), "left").where("bound IS NULL OR h <= bound").select(*d.columns)


def _lowest(d: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Rows of ``d`` with the ``k`` lowest hashes ``h`` of their language, which has ``sizes`` distinct ones.

    Hashes are even over the longs, so those under a bound that twice ``k`` and a hundred are expected under hold the
    ``k`` lowest; only they are gathered, and only languages of more than ``k``.
    """
    most = F.least(F.lit((2 * k + 100) * 2.0**64) / F.col("n"), F.lit(2.0**64 - 2**12)) - F.lit(2.0**63)
    wide = sizes.where(F.col("n") > k).select("lang", most.cast("long").alias("bound"))
    few = _below(d.join(wide.select(F.col("lang").alias("_lang")), F.col("lang") == F.col("_lang"), "left_semi").select("lang", "h"), wide).distinct()
    lowest = few.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    return _below(d, stored(lowest.select("lang", F.get("hs", F.lit(k - 1)).alias("bound")), "bounds"))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    docs_per_lang: int = 2000,
    words_per_lang: int = 20_000,
    grams_per_lang: int = 8_000,
    most_entries: int = 1_000_000,
) -> LanguageModel:
    """A model of the non-null languages of ``docs``. No labelled rows: a model that answers ``und`` only.

    Where the languages' lists would have more than ``most_entries`` together, each is cut in proportion: from 20
    languages on, that is, with these numbers.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    d = d.withColumn("h", F.xxhash64("text"))
    sizes = stored(d.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n_langs = sizes.count()
    if not n_langs:
        return LanguageModel.from_counts([])
    share = min(1.0, most_entries / (n_langs * (words_per_lang + len(LENGTHS) * grams_per_lang)))
    n_words, n_grams = max(1, int(words_per_lang * share)), max(1, int(grams_per_lang * share))
    sample = _lowest(d, sizes, docs_per_lang).groupBy("lang", "h").agg(F.min("text").alias("text"))
    counts = sample.select("text", "lang").mapInPandas(_count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    top = counts.withColumn("r", rank).where(F.col("r") <= F.when(F.col("n") == 0, n_words).otherwise(n_grams))
    return LanguageModel.from_counts([tuple(r) for r in top.select("lang", "n", "gram", "c").toLocalIterator()])


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "lang_score", words: str | None = None, known: str | None = None
) -> DataFrame:
    """``docs`` with the predicted language and its posterior (0 to 1); columns of these names are replaced.

    ``words`` and ``known`` name further columns: how many words the text has, and how many of them the model knows.
    Null texts and those without a letter are ``und`` with score 0. Repeated rows get equal answers; no rows give none.
    """
    small_batches(docs.sparkSession)
    m = model
    shared = docs.sparkSession.sparkContext.broadcast((m.langs, m.at, m.ends, m.lang, m.gain, m.base))

    @F.pandas_udf("lang string, score double, words long, known long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(LanguageModel(*shared.value))
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["lang", "score", "words", "known"])
        del scorer
        give_back()

    # Said to be nondeterministic, so that a filter on its result does not have Spark run it once more below the filter.
    out = docs.withColumn("_language", predict.asNondeterministic()(F.col(text)))
    names = {"lang": pred, "score": score, "words": words, "known": known}
    return out.withColumns({to: F.col(f"_language.{x}") for x, to in names.items() if to}).drop("_language")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in ``fold``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))
