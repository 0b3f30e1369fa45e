"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (runs of characters other than ASCII ones that are no letter or digit, A-Z
lower-cased) and the distinct first 4 and first 5 bytes of longer words, by their 64-bit hashes, and of each of these
that it occurs more than once. P(grade >= g) is
sigmoid(sum of the weights of the features present - threshold g): the grades share the weights, and the thresholds
ascend. The expected severity is the sum of these over g, so it runs from 0 to the highest grade.

Training takes at most `per_class` toxic and as many clean labelled rows, the first by a hash of their ids (that is
the bound on what is fitted; everything is scored). All features that one class's rows of the sample have much oftener
than the other's (z of 5 or more in either direction, at least 4 times as often and in 4 rows) are kept, however many:
those of clean rows get weights that speak for clean. The labels only say toxic or not; a toxic row's grade is 1, or 2
from 3, or 3 from 6 features that nine in ten of the rows with them are toxic for. So grades above 1 are derived from
the texts, not labelled, and what the model learns of them is how that count is told by weights. The fit is a penalised
maximum-likelihood one by full-batch Adam in numpy on the driver, over 2 * per_class rows at most.

Scoring is one pass over the texts in numpy, without a shuffle.

Nulls and edge cases: labels without an id or a label don't count, and of several labels of one id the largest does, and of several
labelled rows of one id the one with the smallest text;
with no toxic or no clean label the model has no features and finds nothing toxic. A null or empty text is not toxic; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch, keyed_text

PER_CLASS, PREFIXES = 4000, (4, 5)
LEVELS = (3, 6)
LEAST = 2.0  # the first threshold at least, so that a text that nothing speaks for is not toxic (0.12)
_BITS = 20


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, and of the beginnings of longer words; not yet distinct."""
    w = W.words_of(raw, offsets, inside=W.ALNUM, lower=True)
    of, size = w.text_of(), w.end - w.start
    texts, hashes = [of], [w.hash]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        h = np.zeros(len(at), W.U)
        for j in range(n):
            h = h * W.U(257) + w.raw[w.start[at] + j]
        texts.append(of[at])
        hashes.append(W.mixed(h + W.U(n << 56)))
    return np.concatenate(texts), np.concatenate(hashes)


def again(hashes: np.ndarray) -> np.ndarray:
    """The features that say that these occur more than once."""
    return W.mixed(hashes ^ W.U(0xA5A5A5A5A5A5A5A5))


def distinct(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once, and again() of those that occur more than once; in order of texts."""
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.flatnonzero(np.append(True, (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1]))[: len(texts)])
    more = new[np.diff(np.append(new, len(texts))) > 1]
    texts, hashes = np.concatenate([texts[new], texts[more]]), np.concatenate([hashes[new], again(hashes[more])])
    order = np.lexsort((hashes, texts))
    return texts[order], hashes[order]


@dataclass
class ToxicityModel:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def known(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[self.keys & W.U((1 << _BITS) - 1)] = True
        return out

    def present(self, raw: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, index of a key)."""
        texts, hashes = features(raw, offsets)
        mask = W.U((1 << _BITS) - 1)
        at = np.flatnonzero(known[hashes & mask] | known[again(hashes) & mask])
        texts, hashes = distinct(texts[at], hashes[at])
        if not len(self.keys):
            return texts[:0], texts[:0]
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        same = self.keys[i] == hashes
        return texts[same], i[same]

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds[None, :], -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, penalty: float = 2e-5, steps: int = 500, rate: float = 0.05, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, the first at least `least`; (rows, cols) are the features present."""
    w, t = np.zeros(n_features), np.append(1.0 if least is None else max(1.0, least), np.zeros(n_grades - 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    n = max(1, len(grades))
    for step in range(1, steps + 1):
        gaps = np.append(t[:1], np.exp(t[1:]))
        theta = np.cumsum(gaps)
        eta = np.bincount(rows, w[cols], len(grades))
        above = np.concatenate([np.ones((len(grades), 1)), 1 / (1 + np.exp(-(eta[:, None] - theta))), np.zeros((len(grades), 1))], axis=1)
        i = np.arange(len(grades))
        high, low = above[i, grades], above[i, grades + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_eta = -(d_high - d_low) / n
        d_theta = np.bincount(grades, d_high / n, n_grades + 1)[1:n_grades] - np.bincount(grades + 1, d_low / n, n_grades + 1)[1:n_grades]
        g_w = np.bincount(cols, d_eta[rows], n_features) + penalty * w
        tail = np.cumsum(d_theta[::-1])[::-1]
        g_t = tail * np.append(1.0, np.exp(t[1:]))
        for k, (x, g) in enumerate(((w, g_w), (t, g_t))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        if least is not None:
            t[0] = max(t[0], least)
    return w, np.cumsum(np.append(t[:1], np.exp(t[1:])))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    given = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)")
    given = given.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64("__id")
    picked = [given.where(f"toxic = {y}").orderBy(turn, "__id").limit(per_class) for y in (0, 1)]
    sample = keyed_text(docs, id_col, text_col).join(F.broadcast(picked[0].unionByName(picked[1])), "__id")
    scratch = Scratch(docs.sparkSession)
    sample = sample.groupBy("__id").agg(F.min("__text").alias("__text"), F.max("toxic").alias("toxic"))
    sample = scratch.write(sample, "labelled-sample")  # 2 * per_class rows at most, used three times

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                texts, hashes = distinct(*features(*W.texts(W.column(part, "__text"))))
                yield pa.RecordBatch.from_arrays([W.column(part, "toxic").take(pa.array(texts)), pa.array(hashes.view(np.int64))], names=["toxic", "feature"])

    sums = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sums}
    if not n.get(0) or not n.get(1):
        scratch.close()
        return ToxicityModel(np.zeros(0, W.U), np.zeros(0), np.full(len(LEVELS) + 1, 10.0))
    counts = sample.mapInArrow(rows, "toxic int, feature long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 4 or b >= 4")
    pa_, pb = F.col("a") / n[1], F.col("b") / n[0]
    both = (F.col("a") + F.col("b") + 1) / (n[0] + n[1])
    counts = counts.withColumn("z", (pa_ - pb) / F.sqrt(both * (1 / n[1] + 1 / n[0]))).where(((F.col("z") >= 5) & (pa_ >= 4 * pb)) | ((F.col("z") <= -5) & (pb >= 4 * pa_)))
    chosen = sorted(((r.feature, r.a * n[0] >= 9 * r.b * n[1]) for r in counts.collect()), key=lambda x: x[0] % 2**64)
    model = ToxicityModel(np.array([x[0] % 2**64 for x in chosen], W.U), np.zeros(len(chosen)), np.zeros(0))
    known = model.known()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                texts, keys = model.present(*W.texts(W.column(part, "__text")), known)
                lists = W.nested(keys.astype(np.int32), np.bincount(texts, minlength=part.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([W.column(part, "toxic"), lists], names=["toxic", "keys"])

    table = sorted((r["toxic"], sorted(r["keys"])) for r in sample.mapInArrow(present, "toxic int, keys array<int>").collect())
    scratch.close()
    marks = np.array([x[1] for x in chosen], bool)
    grades = np.array([y and 1 + sum(int(marks[k].sum()) >= level for level in LEVELS) for y, k in table], np.int64)
    row = np.repeat(np.arange(len(table)), [len(k) for _, k in table])
    col = np.array([x for _, k in table for x in k], np.int64)
    model.weights, model.thresholds = fit_ordinal(row, col, grades, len(chosen), len(LEVELS) + 2, least=LEAST)
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, severity (expected grade), grade (the highest that is more likely than not reached) and toxic (grade 1
    or more with a probability of threshold or more) of every row."""
    mine, known = keyed_text(docs, id_col, text_col), model.known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                texts, keys = model.present(*W.texts(W.column(part, "__text")), known)
                p = model.at_least(np.bincount(texts, model.weights[keys], part.num_rows) if len(texts) else np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([W.column(part, "__id"), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= threshold)], names=["__id", "severity", "grade", "toxic"])

    out = mine.mapInArrow(run, f"__id {dict(mine.dtypes)['__id']}, severity double, grade int, toxic boolean")
    return out.withColumnRenamed("__id", id_col)


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, that score() doesn't call toxic."""
    known = model.known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                texts, keys = model.present(*W.texts(W.column(part, text_col)), known)
                margins = np.bincount(texts, model.weights[keys], part.num_rows) if len(texts) else np.zeros(part.num_rows)
                yield part.filter(pa.array(model.at_least(margins)[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents by a model fitted to their labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
