"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk.

Trusted positives are rows labelled good; everything else it learns from is unlabelled text. With a class
prior p, the risk of a linear score f under the logistic loss l is

    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f)),

and where the bracket falls below zero its gradient is turned round, so that f cannot win by calling every
positive it has seen negative. The prior is estimated from positives and unlabelled rows alone: of a first
classifier of the two, on rows it has not seen, the least ratio of the shares of unlabelled rows and positives
above a threshold (best bin), with a margin for chance.

Inputs of a score are shares over the whole text: of 2- and 3-grams of byte classes (letters by case, digits,
spaces, each punctuation mark), and of words that equal one of the words just before; a short text's shares
are drawn towards zero. Label, language, source
and id are none. Fitting takes a bounded sample, SAMPLE rows of either kind; scoring covers every whole text.

Defined results: a null or empty text has all shares zero and gets the score of the bias; with no positive to
learn from every score is 0.5. Repeated rows give repeated results; several labels of one id count
as positive if all are good; null ids match no label. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.textbytes import runs, spaced, sums

#: Rows of either kind that the model is fitted on, at most.
SAMPLE = 4000

#: Words just before that a word is held against.
LAGS = (1, 2, 3)

#: Grams, and words, added to a text's number of them, so that a few words alone decide little.
FEW_GRAMS, FEW_WORDS = 64, 4

STEPS, RATE, WEIGHT_COST = 600, 0.05, 1e-4

CLASSES = 64


def _classes() -> np.ndarray:
    """Class of each byte: space 0, newline 1, lower 2 (with all beyond ASCII), upper 3, digit 4, then every other sign its own."""
    to = np.zeros(256, np.uint8)
    to[10] = 1
    to[ord("a") : ord("z") + 1] = 2
    to[128:] = 2
    to[ord("A") : ord("Z") + 1] = 3
    to[ord("0") : ord("9") + 1] = 4
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    to[signs] = np.arange(5, 5 + len(signs))
    return to


CLASS = _classes()
PAIRS = CLASSES**2
COLUMNS = CLASSES**2 + CLASSES**3 + len(LAGS)


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 2 and 3: (columns, first, stop); ranges by text."""
    b, first, stop = spaced(CLASS[data].astype(np.int32), bounds, 0, 1)
    two = b[:-1] * CLASSES + b[1:] if len(b) > 1 else b[:0]
    yield two, first - 1, stop
    three = PAIRS + two[:-1] * CLASSES + b[2:] if len(b) > 2 else b[:0]
    yield three, first - 1, np.maximum(stop - 1, first - 1)


def repeats(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of words equal to the word LAGS before, a row for each text."""
    b, first, stop = spaced(data, bounds, 32, 1)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1 if len(b) > 1 else np.zeros(0, np.int64)
    out = np.zeros((len(bounds) - 1, len(LAGS)))
    if not len(begins):
        return out
    place = np.arange(len(b))
    place[begins[0] :] -= np.repeat(begins, np.diff(np.append(begins, len(b))))
    power = np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    mixed = (b.astype(np.uint64) + np.uint64(1)) * (power ^ (power >> np.uint64(29)))
    mixed[space] = 0
    word = np.add.reduceat(mixed, begins)
    of = np.searchsorted(first, begins, "right") - 1
    total = np.bincount(of, minlength=len(bounds) - 1)
    for k, lag in enumerate(LAGS):
        same = (word[lag:] == word[:-lag]) & (of[lag:] == of[:-lag]) if len(word) > lag else np.zeros(0, bool)
        out[:, k] = np.bincount(of[lag:][same], minlength=len(bounds) - 1) / (total + FEW_WORDS)
    return out


@dataclass
class Model:
    #: A weight for each column; the last len(LAGS) are those of the repeats.
    weights: np.ndarray
    bias: float
    prior: float = 0.5

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        f = np.full(len(bounds) - 1, self.bias)
        for column, first, stop in grams(data, bounds):
            f += sums(self.weights[column], first, stop) / (stop - first + FEW_GRAMS)
        f += repeats(data, bounds) @ self.weights[-len(LAGS) :].astype(float)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(x: np.ndarray, positive: np.ndarray, prior: float | None, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk (prior given) or on plain logistic loss of positive against unlabelled (prior None)."""
    w, bias = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    for t in range(1, STEPS + 1):
        bp, bu = rng.choice(p, min(len(p), 512), replace=False), rng.choice(u, min(len(u), 512), replace=False)
        fp, fu = x[bp] @ w + bias, x[bu] @ w + bias
        # d/df of l(f) = log(1 + e^-f) is -sigmoid(-f); of l(-f) it is sigmoid(f).
        if prior is None:
            gp, gu = -_sigmoid(-fp) / len(bp), _sigmoid(fu) / len(bu)
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gp, gu = -prior * _sigmoid(fp) / len(bp), _sigmoid(fu) / len(bu)
            if negative < 0:
                gp, gu = -gp, -gu
            else:
                gp = gp - prior * _sigmoid(-fp) / len(bp)
        g = np.append(gp @ x[bp] + gu @ x[bu] + WEIGHT_COST * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def best_bin_prior(fp: np.ndarray, fu: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of rows the classifier has not seen."""
    grid = np.sort(np.concatenate([fp, fu]))
    sp = 1 - np.searchsorted(np.sort(fp), grid, "left") / len(fp)
    su = 1 - np.searchsorted(np.sort(fu), grid, "left") / len(fu)
    margin = np.sqrt(np.log(4 / delta) / 2) * (len(fp) ** -0.5 + len(fu) ** -0.5)
    some = sp > 0
    best = np.argmin((su[some] + margin) / sp[some])
    return float(np.clip(su[some][best] / sp[some][best], 0.01, 0.99))


def train(rows: list[tuple[bool, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """rows: (is a trusted positive, columns, shares)."""
    weights = np.zeros(COLUMNS, np.float32)
    positive = np.array([r[0] for r in rows], bool)
    if not positive.any() or positive.all():
        return Model(weights, 0.0)
    rng = np.random.default_rng(seed)
    used, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    x = np.zeros((len(rows), len(used)), np.float32)
    x[np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows]), at] = np.concatenate([r[2] for r in rows])
    spread = np.sqrt((x.astype(np.float64) ** 2).mean(axis=0)) + 1e-3  # shares far apart in size become alike
    x /= spread.astype(np.float32)
    seen = rng.random(len(rows)) < 0.6
    if (positive & ~seen).sum() > 20 and (~positive & ~seen).sum() > 20:
        w, b = _descend(x[seen], positive[seen], None, rng)
        f = x[~seen] @ w + b
        prior = best_bin_prior(f[positive[~seen]], f[~positive[~seen]])
    else:
        prior = 0.5
    w, b = _descend(x, positive, prior, rng)
    weights[used] = w / spread
    return Model(weights, float(b), prior)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Positives: usable rows with labels of quality 1 only; unlabelled: rows without a label of use, and any row besides the trusted."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).select(F.col("doc_id").alias("label_id"), "good")
    rows = docs.select("doc_id").where(usable).join(good, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", F.coalesce("good", F.lit(False)).alias("good"))
    counts = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    share = F.when(F.col("good"), min(1.0, sample / counts.get(True, 1))).otherwise(min(1.0, sample / counts.get(False, 1)))
    chosen = rows.where(draw < share * (1 << 30)).distinct().limit(2 * sample + sample // 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, shares = [], []
            for _, _, data, bounds in runs(batch.column(1), 1):
                found = [(np.unique(c[a:z], return_counts=True), z - a + FEW_GRAMS) for c, (a,), (z,) in grams(data, bounds)]
                again = repeats(data, bounds)[0]
                columns.append(np.concatenate([*[c for (c, _), _ in found], np.flatnonzero(again) + COLUMNS - len(LAGS)]).astype(np.int32))
                shares.append(np.concatenate([*[n / total for (_, n), total in found], again[again > 0]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], ["good", "c", "s"])

    texts = docs.where(usable).select(F.col("doc_id").alias("text_id"), F.col("text").cast("binary").alias("text"))
    got = texts.join(chosen, F.col("text_id") == F.col("doc_id")).select("good", "text").mapInArrow(count, "good boolean, c array<int>, s array<double>").toArrow().combine_chunks()
    found = [(good, got["c"][i].values.to_numpy(), got["s"][i].values.to_numpy()) for i, good in enumerate(got["good"].to_pylist())]
    return train(sorted(found, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def score(docs: DataFrame, model: Model) -> Column:
    """Of the text column: 0 to 1, higher where good is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for start, stop, data, bounds in runs(texts):
            out[start:stop] = shared.value.scores(data, bounds)
        return pa.array(out)

    return F.arrow_udf(run, "double")(F.col("text").cast("binary"))
