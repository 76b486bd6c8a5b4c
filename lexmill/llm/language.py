"""Language identification by multilingual mixtures.

A character n-gram model of each language gives every word of a text a likelihood in each language. Expectation
maximisation finds the text's language proportions, and the set of languages is the one with the best likelihood less
a penalty for each language. The languages are those found in the training rows.

Cases: null texts and texts without a letter are `und` with score 0 and no languages; a text is used whole; ties go to
the language that sorts first; without training rows every text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling

BITS = 18
GROUP_CHARS = 1 << 20


def _letters() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, which stands on one, else 0; made once in a process."""
    import unicodedata

    kind = {"L": 2, "M": 1}
    return np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.int8, 0x110000)


_LETTER: list[np.ndarray] = []


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words of lower-cased texts, each word closed by 0; where words begin; words of each text. A word is a run of letters and marks with a letter in it."""
    if not _LETTER:
        _LETTER.append(_letters())
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, low), np.int64, len(low)) + 1
    kind = _LETTER[0][code]
    inside = kind > 0
    close = ~inside & np.concatenate([[False], inside[:-1]])
    begin, end = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])), np.flatnonzero(close)
    letters = np.concatenate([[0], np.cumsum(kind == 2)])
    bare = np.flatnonzero(letters[end] == letters[begin])
    for k in bare.tolist():
        inside[begin[k] : end[k]] = False
        close[end[k]] = False
    keep = inside | close
    doc = np.repeat(np.arange(len(texts)), lengths)
    out = np.where(inside, code, 0)[keep]
    ends = np.flatnonzero(out == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    return out, starts, np.bincount(doc[close], minlength=len(texts))


def grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each place's character, of it with one before it, and with two before it; words are apart by a 0."""
    c = code.astype(np.uint64)
    p1 = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    p2 = np.concatenate([[0, 0], c[:-2]]).astype(np.uint64)
    p2 = np.where(p1 == 0, np.uint64(0), p2)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - BITS)
    h1 = c * a + np.uint64(1)
    h2 = (h1 ^ (p1 + np.uint64(0x51)) * b) * a
    h3 = (h2 ^ (p2 + np.uint64(0x77)) * b) * a
    return (h1 * b) >> shift, (h2 * b) >> shift, (h3 * b) >> shift


@dataclass
class Model:
    """langs in order; table[bucket of three characters] has the log likelihood of the last given the two before, by language."""

    langs: list[str]
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray

    def likelihood(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihood of each word (rows) in each language; half of it from trigrams, the rest from shorter grams."""
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32)
        g1, g2, g3 = grams(code)
        per = np.log(np.float32(0.6) * self.three[g3] + np.float32(0.3) * self.two[g2] + np.float32(0.1) * self.one[g1])
        return np.add.reduceat(per, starts, axis=0)


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (lang, text) rows."""
    langs = sorted({r[0] for r in rows})
    n = 1 << BITS
    tables = [np.zeros((n, len(langs)), np.float32) for _ in range(3)]
    for k, lang in enumerate(langs):
        own = [t for x, t in rows if x == lang]
        counts = [np.zeros(n) for _ in range(3)]
        total = 0
        before1, before2 = np.zeros(n), np.zeros(n)
        ctx1: dict[int, int] = {}
        ctx2: dict[int, int] = {}
        for at in range(0, len(own), 500):
            code, _, _ = letter_runs(own[at : at + 500])
            if not len(code):
                continue
            g1, g2, g3 = grams(code)
            # What comes before: the pair's bucket of the place before, and the single one's.
            c1, c2 = np.concatenate([[0], g1[:-1]]).astype(np.int64), np.concatenate([[0], g2[:-1]]).astype(np.int64)
            for c, g in zip(counts, (g1, g2, g3)):
                c += np.bincount(g.astype(np.int64), minlength=n)
            total += len(code)
            before1 += np.bincount(c1, minlength=n)
            before2 += np.bincount(c2, minlength=n)
            ctx1.update(zip(g2.tolist(), c1.tolist()))
            ctx2.update(zip(g3.tolist(), c2.tolist()))
        alpha = 0.5
        tables[0][:, k] = (counts[0] + alpha) / (total + alpha * 256)
        for table, count, before, ctx in ((tables[1], counts[1], before1, ctx1), (tables[2], counts[2], before2, ctx2)):
            g = np.fromiter(ctx.keys(), np.int64, len(ctx))
            b = np.fromiter(ctx.values(), np.int64, len(ctx))
            table[:, k] = 1e-6
            table[g, k] = np.maximum(1e-6, count[g] / (before[b] + 5))
    return Model(langs, *tables)


def mixtures(like: np.ndarray, count: np.ndarray, rounds: int = 12, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, member of the set) by text and language.

    like: log likelihood of each word by language; count: words of each text. Languages are added in the order of
    their proportions, as many as there are, until no text gains; a text keeps the set with the greatest likelihood less a
    penalty of penalty * log(words) + 2 for each language, and the proportions of the set are fitted again.
    """
    texts, langs = len(count), like.shape[1]
    share = np.zeros((texts, langs))
    member = np.zeros((texts, langs), bool)
    some = np.flatnonzero(count)
    if not len(some) or not langs:
        return share, member
    n = count[some]
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    doc = np.repeat(np.arange(len(some)), n)
    top = like.max(axis=1, keepdims=True)
    r = np.exp(like - top).astype(np.float64) + 1e-12

    def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            w = pi[doc] * r
            w /= w.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(w, at, axis=0) / n[:, None]
        return pi, np.add.reduceat(np.log((pi[doc] * r).sum(axis=1)), at)

    pi, _ = em(np.full((len(some), langs), 1 / langs), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, chosen, score = None, None, None
    for k in range(1, langs + 1):
        inside = rank < k
        part = np.where(inside, np.maximum(pi, 1e-9), 0)
        part, ll = em(part / part.sum(axis=1, keepdims=True), 1 if k == 1 else 3)
        now = 2 * ll - k * (penalty * np.log(np.maximum(n, 2)) + 2)
        if best is None:
            best, chosen, score = part, inside, now
            continue
        more = now > score
        if not more.any():
            break
        best = np.where(more[:, None], part, best)
        chosen = np.where(more[:, None], inside, chosen)
        score = np.where(more, now, score)
    share[some], member[some] = best, chosen
    return share, member


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (the predicted language's share), langs array<string> and shares array<double> of the selected set."""
    src = common.ids_and_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(model)  # 3 MB a language

    def run(batches):
        m = shipped.value
        names = np.array([*m.langs, ""], object)
        for batch in batches:
            for group in common.groups(batch, GROUP_CHARS):
                code, starts, count = letter_runs([t for _, t in group])
                share, member = mixtures(m.likelihood(code, starts), count)
                rows = {"_id": [], "lang_pred": [], "score": [], "langs": [], "shares": []}
                for k, (key, _) in enumerate(group):
                    own = sorted(np.flatnonzero(member[k]).tolist(), key=lambda j: (-share[k, j], j))
                    rows["_id"].append(key)
                    rows["lang_pred"].append(names[own[0]] if own else "und")
                    rows["score"].append(min(1.0, float(share[k, own[0]])) if own else 0.0)
                    rows["langs"].append([names[j] for j in own])
                    rows["shares"].append([float(share[k, j]) for j in own])
                yield pa.RecordBatch.from_arrays([pa.array(rows["_id"], batch.schema.field(0).type), pa.array(rows["lang_pred"], pa.string()), pa.array(rows["score"], pa.float64()), pa.array(rows["langs"], pa.list_(pa.string())), pa.array(rows["shares"], pa.list_(pa.float64()))], ["_id", "lang_pred", "score", "langs", "shares"])

    return src.mapInArrow(common.tidy(run), f"_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>").withColumnRenamed("_id", id_col)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500) -> Model:
    """Fits on about per_language texts of each language, chosen by a hash of the id, and at most sampling.TRAIN_BYTES of them (documented bounds)."""
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text is not null and _lang is not null")
    return fit(sampling.bounded_texts(sampling.bounded_per_class(src, "_lang", "_id", per_language), "_lang"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = common.crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("langs").alias("n_langs"), F.concat_ws(",", "langs").alias("langs"))
