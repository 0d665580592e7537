"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's subwords are the 2-, 3- and 4-byte pieces of its words, in lower case, with a space at either end of
a word; digits and ASCII punctuation count as space. Each hashes to a row of an embedding table; the mean of
the rows goes through a linear softmax. A temperature, fitted on rows that training leaves out, makes the
score a probability.

Rejection is calibrated on those rows too. A text is rejected if it has no letter, if training has met less
than half the share of its subwords that it has met of all but REJECT of those rows, or if its score is lower
than all but REJECT of theirs and not a tenth of the way from chance to certainty. Texts in two known languages
are not rejected.

Training takes a bounded sample, SAMPLE rows at most, dealt evenly over the languages by a hash of the id, and
gathers hashed counts (BUCKETS numbers a row at most), not texts. Prediction covers every whole text.

Defined results: a text that is null or has no letter is 'und' with score 0 and rejected; a text of letters
that no subword knows gets the softmax of the bias; with nothing to learn from, all is 'und'. Repeated rows
give repeated results; a null id is its own fold (as the text 'null'). Empty tables give no rows. Other
columns are ignored by `predict` and kept by `keep_known`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.textbytes import runs, spaced, sums

#: Rows of the sample that the model is fitted on, at most.
SAMPLE = 3000

#: Rows of the embedding table, and numbers in a row.
BUCKETS, WIDTH = 1 << 17, 16

EPOCHS, RATE = 6, 0.5

#: Share of the calibration rows that stand under the bounds of rejection.
REJECT = 0.001

UNKNOWN = "und"

SIZES = (2, 3, 4)

#: Odd multipliers that spread n-grams of each size over the buckets.
SPREAD = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def _plain() -> np.ndarray:
    to = np.full(256, 32, np.uint8)
    for c in range(ord("a"), ord("z") + 1):
        to[c] = to[c - 32] = c
    to[128:] = np.arange(128, 256)
    return to


PLAIN = _plain()


def subwords(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: (buckets, first, stop), bucket BUCKETS where no subword starts; ranges by text."""
    b, first, stop = spaced(PLAIN[data], bounds, 32, 1)
    wide, space = b.astype(np.uint32), b == 32
    for n in SIZES:
        m = max(0, len(b) - n + 1)
        code = np.zeros(m, np.uint32)
        for k in range(n):
            code |= wide[k : k + m] << np.uint32(8 * k)
        bucket = ((code * np.uint32(SPREAD[n])) >> np.uint32(15)).astype(np.int64)
        broken = space[:m] & space[n - 1 :][:m] if n == 2 else np.zeros(m, bool)
        for k in range(1, n - 1):
            broken = broken | space[k : k + m]
        bucket[broken] = BUCKETS
        yield bucket, first - 1, np.minimum(stop + 2 - n, m).clip(first - 1)


@dataclass
class Model:
    languages: list[str]
    #: Embeddings times the softmax weights: a row of logits for each bucket, zero for none; the last column is 1 if training has met it.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0
    least_met: float = 0.0

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, a row for each text, and the share of its subwords that training has met."""
        total, count = np.zeros((len(bounds) - 1, len(self.languages) + 1)), np.zeros(len(bounds) - 1)
        for bucket, first, stop in subwords(data, bounds):
            total += sums(self.logits[bucket], first, stop)
            count += sums((bucket < BUCKETS).astype(np.float32), first, stop)
        mean = total / np.maximum(count, 1)[:, None]
        return softmax((mean[:, :-1] + self.bias) / self.temperature), mean[:, -1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 8) -> Model | None:
    """rows: (language, buckets, counts) in any order; a fifth is left out of training for the calibration."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(languages)}
    data = [(place[x], b, (c / c.sum()).astype(np.float32)) for x, b, c in rows]
    order = rng.permutation(len(data))
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 50 else (order, order)
    e = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used).tolist():
            y, b, share = data[i]
            rate = RATE * (1 - step / steps) + 1e-3
            step += 1
            h = share @ e[b]
            g = softmax(h @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            bias -= rate * 0.1 * g
            e[b] -= (rate * 20) * share[:, None] * back
    e[BUCKETS] = 0
    met = np.zeros(BUCKETS + 1, np.float32)
    for i in used.tolist():
        met[data[i][1]] = 1
    model = Model(languages, np.column_stack([e @ w, met]).astype(np.float32), bias.astype(np.float64))
    sums_of = np.stack([data[i][2] @ model.logits[data[i][1]] for i in held])
    raw = sums_of[:, :-1] + model.bias
    truth = np.array([data[i][0] for i in held])
    tries = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in tries]
    model.temperature = float(tries[int(np.argmin(loss))])
    chance = 1 / len(languages)
    model.bound = float(min(chance + 0.1 * (1 - chance), np.quantile(softmax(raw / model.temperature).max(axis=1), REJECT)))
    model.least_met = float(np.quantile(sums_of[:, -1], REJECT)) / 2
    return model


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """Of the rows where `usable` holds and lang is known: a bounded sample, the same number for each language."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = sample // len(counts)
    # A draw of less than 1 is chosen; where more are than the sample holds, the lowest draws stay, however files lie.
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    draw = F.lit(2.0)
    for lang, n in counts.items():
        draw = F.when(F.col("lang") == lang, drawn / min(1.0, each / n)).otherwise(draw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, buckets, numbers = batch.column(0), [], []
            for start, stop, data, bounds in runs(batch.column(1), 1):
                all_of = np.concatenate([b[a:z] for b, (a,), (z,) in subwords(data, bounds)])
                b, c = np.unique(all_of[all_of < BUCKETS], return_counts=True)
                buckets.append(b.astype(np.int32))
                numbers.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([langs, pa.array(buckets, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32())), batch.column(2)], ["lang", "b", "c", "draw"])

    met = known.select("lang", F.col("text").cast("binary"), draw.alias("draw")).where("draw < 1").mapInArrow(count, "lang string, b array<int>, c array<int>, draw double")
    rows = met.orderBy("draw", F.xxhash64("lang", "b", "c")).limit(sample).toArrow().combine_chunks()
    found = [(lang, rows["b"][i].values.to_numpy(), rows["c"][i].values.to_numpy()) for i, lang in enumerate(rows["lang"].to_pylist())]
    return train(sorted(found, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


GUESS = "struct<lang_pred:string,score:double,rejected:boolean>"


def guess(docs: DataFrame, model: Model | None) -> Column:
    """lang_pred, score and rejected of the text column, as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        m, n = shared.value, len(texts)
        none = ~letters.to_numpy(zero_copy_only=False).astype(bool) if m else np.ones(n, bool)
        best, score, met = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for start, stop, data, bounds in runs(texts) if m else ():
            p, met[start:stop] = m.scores(data, bounds)
            best[start:stop], score[start:stop] = p.argmax(axis=1), p.max(axis=1)
        names = [*m.languages, UNKNOWN] if m else [UNKNOWN]
        best[none], score[none] = len(names) - 1, 0.0
        rejected = none | (score < m.bound) | (met < m.least_met) if m else none
        return pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(best)), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, GUESS)(F.col("text").cast("binary"), has_letter())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected."""
    return docs.select("doc_id", guess(docs, model).alias("g")).select("doc_id", "g.lang_pred", "g.score", "g.rejected")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not rejected, as they are."""
    return docs.where(~guess(docs, model)["rejected"])
