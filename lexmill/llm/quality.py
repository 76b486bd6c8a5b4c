"""Quality classification: ordinal regression on graded ratings.

A cumulative-link (proportional-odds) model: P(grade > k) = sigmoid(w . x - threshold_k), with one weight vector shared
by all grades and thresholds kept in order by building each from the one before plus a positive gap. x is hashed text:
the mean over words of one bucket for the word, one for its shape, one for its relation to the word before, and one for
its length; these means make long and short texts comparable.

Cases: null and empty texts have no words and get the score of x = 0; a text is used whole; one grade alone or no rated
row gives expected grade = that grade (or null) and a tail probability of 1 (or null); equal texts score alike; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, tokens

BITS = 16
GROUP_CHARS = 1 << 20
KINDS = 4

#: Class of each byte for a word's shape: letters, digits, bytes of other scripts, sentence marks, other marks.
_CLASS = np.full(256, 4, np.uint64)
_CLASS[np.r_[65:91, 97:123]] = 0
_CLASS[48:58] = 1
_CLASS[128:] = 2
_CLASS[[44, 46, 33, 63, 39, 45]] = 3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each kind by word, words of each text)."""
    w = tokens.words(texts)
    n = len(w.hash)
    if not n:
        return np.zeros((0, KINDS), np.int64), w.count()
    shift = np.uint64(64 - BITS)
    length = w.end - w.start
    k1, k2, k3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
    last = w.buf[w.end - 1]
    before_last = w.buf[np.maximum(w.end - 2, w.start)]
    third = w.buf[np.maximum(w.end - 3, w.start)]
    shape = (_CLASS[w.buf[w.start]] * np.uint64(5) + _CLASS[last]) * np.uint64(25) + _CLASS[before_last] * np.uint64(5) + _CLASS[third]
    prev = np.concatenate([np.zeros(1, np.uint64), w.hash[:-1]])
    prev2 = np.concatenate([np.zeros(2, np.uint64), w.hash[:-2]])[:n]
    relation = (w.hash == prev).astype(np.uint64) * np.uint64(2) + (w.hash == prev2)
    mixed = lambda x, k: tokens.mix(x * k + k) >> shift
    return np.stack([w.hash >> shift, mixed(shape, k1), mixed(relation, k2), mixed(np.minimum(length, 24).astype(np.uint64), k3)], axis=1).astype(np.int64), w.count()


def link(weights: np.ndarray, idx: np.ndarray, count: np.ndarray) -> np.ndarray:
    """w . x by text: the mean over words of their buckets' weights."""
    per = weights[idx].sum(axis=1) if len(idx) else np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(per)])
    at = np.concatenate([[0], np.cumsum(count)])
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(count, 1)


@dataclass
class Ordinal:
    """grades in order; thresholds between them; hashed weights."""

    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) by text and threshold."""
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds[None, :])))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        g = np.array(self.grades, float)
        return g[0] + tails @ np.diff(g)


def fit(rows: list[tuple[float, str]], epochs: int = 12, rate: float = 0.8, seed: int = 5) -> Ordinal:
    """Adagrad on the cumulative-link likelihood of (grade, text) rows; every grade weighs the same in total."""
    grades = sorted({float(g) for g, _ in rows})
    order = {g: k for k, g in enumerate(grades)}
    y = np.array([order[float(g)] for g, _ in rows])
    parts = []
    for a in range(0, len(rows), 500):
        idx, count = features([(t or "").encode("utf-8", "surrogatepass").lower() for _, t in rows[a : a + 500]])
        at = np.concatenate([[0], np.cumsum(count)])
        for k in range(len(count)):
            own, n = np.unique(idx[at[k] : at[k + 1]].ravel(), return_counts=True)
            parts.append((own, n / max(1, count[k])))
    k = len(grades) - 1
    w, theta0, gaps = np.zeros(1 << BITS), np.zeros(1), np.zeros(max(0, k - 1))
    gw, gt, gg = np.full(1 << BITS, 1e-6), np.full(1, 1e-6), np.full(max(0, k - 1), 1e-6)
    share = len(rows) / (len(grades) * np.bincount(y, minlength=len(grades)))
    rng = np.random.default_rng(seed)
    if k:
        for epoch in range(epochs):
            for i in rng.permutation(len(rows)):
                idx, x = parts[i]
                z = w[idx] @ x
                th = np.concatenate([theta0, theta0 + np.cumsum(np.exp(gaps))])
                t = 1 / (1 + np.exp(-(z - th)))
                upper = t[y[i] - 1] if y[i] else 1.0
                lower = t[y[i]] if y[i] < k else 0.0
                p = max(upper - lower, 1e-9)
                du = upper * (1 - upper) if y[i] else 0.0
                dl = lower * (1 - lower) if y[i] < k else 0.0
                dz = -(du - dl) / p * share[y[i]]
                dth = np.zeros(k)
                if y[i]:
                    dth[y[i] - 1] += du / p * share[y[i]]
                if y[i] < k:
                    dth[y[i]] -= dl / p * share[y[i]]
                g = dz * x + 1e-5 * w[idx]
                gw[idx] += g * g
                w[idx] -= rate * g / np.sqrt(gw[idx])
                d0 = dth.sum()
                gt += d0 * d0
                theta0 = theta0 - 0.1 * d0 / np.sqrt(gt)
                if k > 1:
                    d = np.cumsum(dth[::-1])[::-1][1:] * np.exp(gaps)
                    gg += d * d
                    gaps = gaps - 0.1 * d / np.sqrt(gg)
    th = np.concatenate([theta0, theta0 + np.cumsum(np.exp(gaps))])[:k] if k else np.zeros(0)
    return Ordinal(grades, th, w.astype(np.float32))


def grades(labels: DataFrame) -> DataFrame:
    """Ratings in three grades from the labels: 0 for low quality, 1 for a toxic text of good quality, 2 for a clean one. Unrated rows are left out; an id rated more than once has its lowest grade."""
    g = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null").groupBy("doc_id").agg(F.min(g).cast("double").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", per_grade: int = 3000) -> Ordinal:
    """Fits on about per_grade rated rows of each grade, chosen by a hash of the id, and at most sampling.TRAIN_BYTES of texts (documented bounds)."""
    rated = ratings.select(F.col(id_col).alias("_id"), F.col(grade_col).alias("_grade"))
    some = sampling.bounded_per_class(rated, "_grade", "_id", per_grade)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(some), "_id")
    rows = sampling.bounded_texts(rows, "_grade")
    return fit(rows) if rows else Ordinal([], np.zeros(0), np.zeros(1 << BITS, np.float32))


def rate(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", above: int = 0) -> DataFrame:
    """Adds expected_grade and tail_probability = P(grade > grades[above]) to the rows of df, under these names with _ behind where df has them itself; its own columns stay as they are."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    common.small_batches(df.sparkSession)
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<expected_grade:double,tail_probability:double>")
    def scores(text: pa.Array) -> pa.Array:
        m = shipped.value
        out = np.full((len(text), 2), np.nan)
        values = text.to_pylist()
        if m.grades:
            a = 0
            while a < len(values):
                b, size = a, 0
                while b < len(values) and (b == a or size < GROUP_CHARS):
                    size += len(values[b] or "")
                    b += 1
                idx, count = features([(t or "").encode("utf-8", "surrogatepass").lower() for t in values[a:b]])
                tails = m.tails(link(m.weights, idx, count))
                out[a:b, 0] = m.expected(tails)
                out[a:b, 1] = tails[:, above] if tails.shape[1] else 1.0
                a = b
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["expected_grade", "tail_probability"])

    name = common.free_name("_rated", df)
    own = [F.col(f"`{c}`") for c in df.columns]
    added = [F.col(f"{name}.{c}").alias(common.free_name(c, df)) for c in ("expected_grade", "tail_probability")]
    return df.withColumn(name, scores(F.col(f"`{text_col}`").cast("string"))).select(*own, *added)


#: A text whose probability of a grade above the lowest is under this is rejected.
KEEP = 0.5


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from rated rows whose crc32(doc_id as text) mod 5 is not 2, so the others show what it is worth."""
    docs = common.documents(spark, sf_dir)
    held = common.crc_mod("doc_id", 5) == 2
    model = train(docs, grades(common.documents(spark, sf_dir, "labels")).where(~held))
    out = rate(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), F.col("expected_grade").alias("score"), "tail_probability", (F.col("tail_probability") >= KEEP).alias("keep"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts that the classifier rejects go. It learns from the rated rows of the stage's input, with the query's fold left out."""
    model = train(docs, grades(common.documents(spark, sf_dir, "labels")).where(common.crc_mod("doc_id", 5) != 2))
    out = rate(docs, model)
    p = F.col(f"`{out.columns[-1]}`")
    return out.where((p >= KEEP) | p.isNull() | F.isnan(p)).select(*[F.col(f"`{c}`") for c in docs.columns])
