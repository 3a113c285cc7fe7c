"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; everything else is unlabelled web text. A linear model over byte, word and
word-pair statistics and repetition measures minimises the non-negative unbiased risk

    prior * E_p[loss(z)] + max(0, E_u[loss(-z)] - prior * E_p[loss(-z)])

with the logistic loss, so its sigmoid estimates the chance that a text is good. Rows labelled bad are never
used as negatives. The class prior is estimated from how the two samples spread over the scores of a model
that tells positives from unlabelled: the least ratio of unlabelled to positive mass above a threshold.

Fitting uses bounded samples (``most_positives``, ``most_unlabelled``), scoring every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import give_back, small_batches, stored

#: Sizes of the spreads: bytes (those beyond ASCII together), byte pairs, words and word pairs by hash.
BYTES, PAIRS, WORDS, WORD_PAIRS = 129, 256, 320, 256
SPREADS = BYTES + PAIRS + WORDS + WORD_PAIRS
#: Steps at which the shares of repeated windows and lines become features of their own.
STEPS = np.array([0.05, 0.1, 0.2, 0.35, 0.5, 0.7])
WIDTH = SPREADS + 4 + 2 * (1 + len(STEPS))
#: Bytes that are looked at together; a longer word counts as several.
CHUNK = 1 << 18
#: An odd factor, its inverse modulo 2**64, and one to spread the bits of a hash.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
SPREAD = 0xBF58476D1CE4E5B9


@lru_cache(maxsize=2)
def _powers(factor: int, n: int = CHUNK) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n + 1, factor, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(SPREAD)
    return h ^ (h >> np.uint64(29))


def _chunks(b: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of up to CHUNK bytes; where one holds a space, it ends behind its last."""
    at = 0
    while at < len(b):
        piece = b[at : at + CHUNK]
        if at + CHUNK < len(b) and len(spaces := np.flatnonzero(_space(piece))):
            piece = piece[: spaces[-1] + 1]
        yield piece
        at += len(piece)


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words: where each starts and its hash, the sum of its bytes times powers of FACTOR, mixed."""
    edge = np.diff(np.concatenate([[0], (~_space(b)).view(np.int8), [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(FACTOR)[: len(b)], dtype=np.uint64)])
    return starts, _mix((sums[ends] - sums[starts]) * _powers(INVERSE)[starts])


def _distinct(values: np.ndarray) -> int:
    values.sort()
    return int((values[1:] != values[:-1]).sum()) + 1 if len(values) else 0


def features(text: str | None) -> np.ndarray:
    """Spread of bytes, byte pairs, words and word pairs, lengths, and shares of repeated 3-word windows and lines.

    Words are runs of anything but the six ASCII spaces and lines those that have one. Null and empty texts have a
    vector too (all zero), so they get a score. A text of n words takes about 50 n bytes beside its own.
    """
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    spreads = [np.zeros(n) for n in (BYTES, PAIRS, WORDS, WORD_PAIRS)]
    hashes, lines, line, last, before = [], [], 0, np.zeros(0, np.int32), np.zeros(0, np.uint64)
    for piece in _chunks(b):
        low = np.minimum(piece, 128).astype(np.int32)
        spreads[0] += np.bincount(low, minlength=BYTES)
        low = np.concatenate([last, low])
        spreads[1] += np.bincount((low[:-1] * 31 + low[1:] * 7 + (low[:-1] >> 3)) % PAIRS, minlength=PAIRS)
        starts, h = _word_hashes(piece)
        spreads[2] += np.bincount((h % np.uint64(WORDS)).astype(np.int32), minlength=WORDS)
        both = np.concatenate([before, h])
        spreads[3] += np.bincount((_mix(both[:-1] * np.uint64(FACTOR) + both[1:]) % np.uint64(WORD_PAIRS)).astype(np.int32), minlength=WORD_PAIRS)
        ends = np.flatnonzero(piece == 10)
        hashes.append(h)
        lines.append((np.searchsorted(ends, starts) + line).astype(np.int32))
        line, last, before = line + len(ends), low[-1:], both[-1:]
    at = 0
    for spread in spreads:
        out[at : at + len(spread)] = np.sqrt(spread / max(1, spread.sum()))
        at += len(spread)
    h, line_of = np.concatenate(hashes), np.concatenate(lines)
    n = max(1, len(h))
    windows = h[:-2] * np.uint64(FACTOR) + h[1:-1] * np.uint64(SPREAD) + h[2:]
    first = np.flatnonzero(np.diff(line_of, prepend=-1))
    place = (np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h)))) % CHUNK
    whole = np.add.reduceat(h * _powers(FACTOR)[place], first) if len(first) else h
    n_lines, n_windows = len(first), len(windows)
    shares = 1 - _distinct(windows) / n_windows if n_windows else 0.0, 1 - _distinct(whole) / n_lines if n_lines else 0.0
    rest = [np.log1p(len(h)), np.log1p(n_lines), len(b) / n / 10, _distinct(h) / n]
    for s in shares:
        rest += [s, *(s >= STEPS)]
    out[SPREADS:] = rest
    return out


def matrix(texts: pd.Series) -> np.ndarray:
    return np.vstack([features(t) for t in texts]) if len(texts) else np.zeros((0, WIDTH), np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class QualityModel:
    """``w`` is None where there was nothing to learn from; every score is then 0.5."""

    w: np.ndarray | None
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        return sigmoid(((x - self.mean) * self.scale) @ self.w + self.bias).astype(np.float64)


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; ``gradient`` maps the weights (bias last; in the samples' precision) to their gradient."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w.astype(np.float32))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray, least: float = 0.5) -> float:
    """Least ratio of unlabelled to positive mass above thresholds that keep a share ``least`` of the positives.

    Where only good texts score that high, the ratio is the share of good texts among the unlabelled. The
    scores must come from a model that saw neither sample. Half the sampling error is taken off: a prior
    that is too high lets bad texts pass as good ones.
    """
    cuts = np.quantile(score_p, np.linspace(0, 1 - least, 81))
    p = np.array([(score_p >= c).mean() for c in cuts])
    u = np.array([(score_u >= c).mean() for c in cuts])
    error = 1 / np.sqrt(len(score_u)) + 1 / np.sqrt(len(score_p))
    return float(np.clip((u / p).min() - 0.5 * error, 0.01, 0.99))


def fit_arrays(xp: np.ndarray, xu: np.ndarray, steps: int = 300, decay: float = 0.01, rate: float = 0.05) -> QualityModel:
    """The model of positives ``xp`` and unlabelled ``xu``; 0.5 for everything where there are under 2 of either."""
    if len(xp) < 2 or len(xu) < 2:
        return QualityModel(None, 0.0, np.zeros(WIDTH), np.ones(WIDTH), 0.5)
    mean = xu.mean(axis=0).astype(np.float32)
    scale = (1 / np.maximum(xu.std(axis=0), 0.02)).astype(np.float32)
    p, u = (np.empty((len(x), x.shape[1] + 1), np.float32) for x in (xp, xu))
    for x, z in ((xp, p), (xu, u)):
        np.subtract(x, mean, out=z[:, :-1])
        z[:, :-1] *= scale
        z[:, -1] = 1
    shrink = np.full(p.shape[1], decay, np.float32)
    shrink[-1] = 0

    def apart(half: int) -> float:
        """The prior by a model that tells one half's positives from its unlabelled, on the other half."""
        a, b = p[half::2], u[half::2]

        def gradient(w):
            return (-(1 - sigmoid(a @ w)) @ a / len(a) + sigmoid(b @ w) @ b / len(b)) / 2 + shrink * w

        w = _descend(gradient, p.shape[1], steps // 2, rate).astype(np.float32)
        return estimate_prior(p[1 - half :: 2] @ w, u[1 - half :: 2] @ w)

    prior = (apart(0) + apart(1)) / 2

    w = _descend(lambda w: risk_gradient(w, p, u, prior) + shrink * w, p.shape[1], steps, rate)
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), mean, scale, prior)


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of prior * E_p[loss(z)] + max(0, N), N = E_u[loss(-z)] - prior * E_p[loss(-z)]; where N is negative, of -N: the
    step that undoes what made it so."""
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    good = -prior * (1 - sigmoid(zp)) @ p / len(p)
    bad = sigmoid(zu) @ u / len(u) - prior * sigmoid(zp) @ p / len(p)
    return good + bad if negative >= 0 else -bad


def _sampled(docs: DataFrame, ids: DataFrame, most: int, seed: int) -> np.ndarray:
    """Feature rows of at most ``most`` distinct texts of the documents with these ids (at most so many), by hash.

    Which texts they are is settled by hashes first; features are taken where the texts are, and only they move.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "_hash": pdf["_hash"], "x": [features(t).tobytes() for t in pdf["_text"]]})
        give_back()

    d = docs.withColumn("_hash", F.xxhash64("_text"))
    order = F.xxhash64("_id", F.lit(seed)), F.col("_id"), F.col("_hash")
    mine = d.join(F.broadcast(ids), "_id", "left_semi").select("_id", "_hash").distinct().orderBy(*order).limit(most)
    mine = stored(mine, "sample")
    kind = docs.select("_id").schema[0].dataType.simpleString()
    rows = d.join(F.broadcast(mine), ["_id", "_hash"], "left_semi").select("_id", "_hash", "_text")
    found = rows.mapInPandas(vectors, f"_id {kind}, _hash long, x binary").groupBy("_id", "_hash").agg(F.first("x").alias("x"))
    found = found.select(order[0].alias("o"), "_id", "_hash", "x").collect()
    found.sort(key=lambda r: (r["o"], r["_id"], r["_hash"]))
    out = np.empty((len(found), WIDTH), np.float32)
    for k, r in enumerate(found):
        out[k] = np.frombuffer(r["x"], np.float32)
    return out


def fit(
    docs: DataFrame,
    positives: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    most_positives: int = 5000,
    most_unlabelled: int = 10_000,
) -> QualityModel:
    """A model from ``docs`` (unlabelled) and the keys in ``positives``; both are sampled by a hash of the key.

    A text that stands several times under one key counts once. Null keys are not learned from. With fewer than two
    positives or documents the model scores everything 0.5.
    """

    def chosen(df: DataFrame, most: int, seed: int) -> DataFrame:
        ids = df.select(F.col(key).alias("_id")).where(F.col("_id").isNotNull())
        rank = F.xxhash64("_id", F.lit(seed))
        # About twice as many as are wanted, by their hashes' last bits, so that not all ids are told apart.
        share = (2 * most + 100) / max(1, ids.agg(F.approx_count_distinct("_id")).first()[0])
        few = ids.where(F.pmod(F.xxhash64("_id", F.lit(-seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).distinct()
        return stored(few.orderBy(rank, "_id").limit(most), "chosen")

    small_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    xp = _sampled(d, chosen(positives, most_positives, 1), most_positives, 1)
    xu = _sampled(d, chosen(docs, most_unlabelled, 2), most_unlabelled, 2)
    return fit_arrays(xp, xu)


def trusted(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys all of whose labels are 1."""
    return labels.groupBy(key).agg(F.min(label).alias("_least")).where((F.col("_least") == 1) & F.col(key).isNotNull()).select(key)


def classify(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row; a column of that name is replaced. Null and empty texts are
    scored by the model too, equal texts alike; no rows give no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.bias, model.mean, model.scale, model.prior))

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = QualityModel(*shared.value)
        for texts in batches:
            yield pd.Series(model.score(matrix(texts)))
        give_back()

    return docs.withColumn(score, predict(F.col(text)))
