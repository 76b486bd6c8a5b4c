"""Toxicity scoring with a bidirectional gated recurrent network and attention pooling, trained in numpy.

Each word enters as the embedding of its hashed form beside the sum of the embeddings of its hashed character grams. A GRU
reads a window of words in each direction, attention pools the states, and a logistic unit gives the window's score.
Windows overlap and cover the whole text; a text's score is that of its highest window. Training knows labels of whole
texts only, so each epoch picks the highest window of each text, and for clean texts another one at random.

Cases: null, empty and blank texts have one window without words, whose score is the network's bias; texts of any
length are scored whole, in groups of bounded size; equal texts score alike; without labelled rows of both kinds all
scores are the share of label 1 (0.5 without rows); an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, tokens

BITS, DIM, HIDDEN, ATT = 14, 8, 8, 8
WINDOW, STRIDE = 32, 24
#: Factor of the sum of a word's gram embeddings.
GRAM_SCALE = 0.5
GROUP_CHARS = 1 << 20
_SHIFT = np.uint64(64 - BITS)
#: Texts with a word or gram at which its embedding learns at half the rate; weight of the labels' share in its beginning.
DOUBT, PRIOR = 8, (0.5, 0.1)


@dataclass
class Text:
    """Inputs of a group of texts: buckets of words and of their character grams."""

    word: np.ndarray
    gram: np.ndarray  # a bucket a gram
    gram_at: np.ndarray  # where each word's grams begin
    first: np.ndarray  # where each text's words begin, and the end


def inputs(texts: list[str]) -> Text:
    """Made a group of texts at a time; buckets are kept as 16-bit numbers."""
    parts, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= GROUP_CHARS:
            parts.append(_inputs(group))
            group, size = [], 0
    if group or not parts:
        parts.append(_inputs(group))
    if len(parts) == 1:
        return parts[0]
    words, grams = np.cumsum([0] + [len(p.word) for p in parts]), np.cumsum([0] + [len(p.gram) for p in parts])
    first = np.concatenate([*(p.first[:-1] + w for p, w in zip(parts, words)), words[-1:]])
    return Text(np.concatenate([p.word for p in parts]), np.concatenate([p.gram for p in parts]), np.concatenate([p.gram_at + g for p, g in zip(parts, grams)]), first)


def _inputs(texts: list[str]) -> Text:
    w = tokens.words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], tokens.IS_BREAK)
    if not len(w.hash):
        return Text(np.zeros(0, np.uint16), np.zeros(0, np.uint16), np.zeros(0, np.int64), w.first)
    # Grams of up to four bytes that end at each byte of a word; at its beginning they are shorter.
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size)])
    age = np.arange(at[-1]) - np.repeat(at[:-1], size)
    pos = np.repeat(w.start, size) + age
    code = w.buf[pos].astype(np.uint64) + np.uint64(1)
    for k in (1, 2, 3):
        code |= np.where(age >= k, w.buf[np.maximum(pos - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(9 * k)
    return Text((w.hash >> _SHIFT).astype(np.uint16), (tokens.mix(code) >> _SHIFT).astype(np.uint16), at[:-1], w.first)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, text) of every window: WINDOW words each, one STRIDE after the other, over whole texts."""
    count = np.diff(first)
    many = np.maximum(1, -(-np.maximum(count - (WINDOW - STRIDE), 1) // STRIDE))
    at = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(count)), many)
    begin = (np.arange(at[-1]) - np.repeat(at[:-1], many)) * STRIDE
    return first[:-1][text] + begin, np.minimum(WINDOW, count[text] - begin), text


class Network:
    """Parameters and the two passes. Both directions run in one matrix: columns 0..H of a state read forward, the others backward."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        r = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "word": r(1 << BITS, DIM, k=0.1), "gram": r(1 << BITS, DIM, k=0.1),
            "wx": r(2 * DIM, 6 * h), "bx": np.zeros(6 * h, np.float32), "uf": r(h, 3 * h), "ub": r(h, 3 * h),
            "wa": r(2 * h, ATT), "va": r(ATT), "wo": r(2 * h), "bo": np.zeros(1, np.float32),
        }

    def embed(self, t: Text) -> np.ndarray:
        g = np.add.reduceat(self.p["gram"][t.gram], t.gram_at, axis=0) * np.float32(GRAM_SCALE) if len(t.word) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][t.word], g], axis=1)

    def recur(self) -> np.ndarray:
        """Both directions' recurrent weights: [2H, 6H] in the order of the gates z, r, n, each forward then backward."""
        h, u = HIDDEN, np.zeros((2 * HIDDEN, 6 * HIDDEN), np.float32)
        for k in range(3):
            u[:h, 2 * k * h : (2 * k + 1) * h] = self.p["uf"][:, k * h : (k + 1) * h]
            u[h:, (2 * k + 1) * h : (2 * k + 2) * h] = self.p["ub"][:, k * h : (k + 1) * h]
        return u

    def forward(self, proj: tuple[np.ndarray, np.ndarray], begin: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; proj: each word's input to the gates. keep: also what the backward pass needs."""
        h, n = HIDDEN, len(begin)
        zero = len(proj[0]) - 1  # the row behind the last word stands for no word
        idx = begin[None, :] + np.arange(WINDOW)[:, None]
        mask = np.arange(WINDOW)[:, None] < size[None, :]
        idx = np.where(mask, idx, zero)
        live = mask.astype(np.float32)
        u = self.recur()
        state = np.zeros((n, 2 * h), np.float32)
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        saved = []
        both = np.zeros((n, 6 * h), np.float32)
        pf, pb = proj
        gate = np.empty((n, 2 * h), np.float32)
        for t in range(WINDOW):
            s = WINDOW - 1 - t
            f, b = pf[idx[t]], pb[idx[s]]
            for k in range(3):
                both[:, 2 * k * h : (2 * k + 1) * h] = f[:, k * h : (k + 1) * h]
                both[:, (2 * k + 1) * h : (2 * k + 2) * h] = b[:, k * h : (k + 1) * h]
            a = state @ u
            zr = np.tanh(0.5 * (both[:, : 4 * h] + a[:, : 4 * h])) * 0.5 + 0.5
            z, r = zr[:, : 2 * h], zr[:, 2 * h :]
            c = np.tanh(both[:, 4 * h :] + r * a[:, 4 * h :])
            gate[:, :h], gate[:, h:] = live[t][:, None], live[s][:, None]
            new = state + gate * (1 - z) * (c - state)
            if keep:
                saved.append((state, z, r, c, a[:, 4 * h :], gate.copy()))
            state = new
            states[t, :, :h], states[s, :, h:] = state[:, :h], state[:, h:]
        hidden = np.tanh(states @ self.p["wa"])
        e = hidden @ self.p["va"] + np.where(mask, 0, -1e9).astype(np.float32)
        e = np.exp(e - e.max(axis=0))
        e *= live
        att = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", att, states)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (idx, mask, u, saved, states, hidden, att, pooled)) if keep else logit

    def gradients(self, t: Text, x: np.ndarray, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss by every parameter; x: the words' embeddings with a zero row behind."""
        h = HIDDEN
        idx, mask, u, saved, states, hidden, att, pooled = kept
        g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["wo"]
        datt = np.einsum("nh,tnh->tn", dpool, states)
        de = att * (datt - (att * datt).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", de, hidden)
        dhid = de[:, :, None] * self.p["va"] * (1 - hidden**2)
        g["wa"] = np.einsum("tnh,tna->ha", states, dhid)
        dstates = att[:, :, None] * dpool[None] + dhid @ self.p["wa"].T
        du = np.zeros_like(u)
        dproj = np.zeros((len(x), 6 * h), np.float32)
        flow = np.zeros_like(saved[0][0])
        for step in range(WINDOW - 1, -1, -1):
            s = WINDOW - 1 - step
            state, z, r, c, an, gate = saved[step]
            flow[:, :h] += dstates[step, :, :h]
            flow[:, h:] += dstates[s, :, h:]
            dc = flow * gate * (1 - z) * (1 - c * c)
            dz = flow * gate * (state - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            din = np.concatenate([dz, dr, dc], axis=1)
            da = np.concatenate([dz, dr, dc * r], axis=1)
            du += state.T @ da
            flow = flow * (1 - gate * (1 - z)) + da @ u.T
            for k in range(3):
                # Each window has words of its own here, so no row but that of no word is written twice.
                dproj[idx[step], 2 * k * h : (2 * k + 1) * h] += din[:, 2 * k * h : (2 * k + 1) * h]
                dproj[idx[s], (2 * k + 1) * h : (2 * k + 2) * h] += din[:, (2 * k + 1) * h : (2 * k + 2) * h]
        dproj = dproj[:-1]
        g["wx"], g["bx"] = x[:-1].T @ dproj, dproj.sum(axis=0)
        for name, off in (("uf", 0), ("ub", 1)):
            g[name] = np.concatenate([du[off * h : (off + 1) * h, (2 * k + off) * h : (2 * k + off + 1) * h] for k in range(3)], axis=1)
        dx = dproj @ self.p["wx"].T
        used = np.flatnonzero(np.abs(dx).sum(axis=1))
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], t.word[used], dx[used, :DIM])
        size = np.diff(np.append(t.gram_at, len(t.gram)))
        share = dx[:, DIM:] * np.float32(GRAM_SCALE)
        g["gram"] = np.zeros_like(self.p["gram"])
        pick = np.repeat(np.isin(np.arange(len(size)), used), size)
        np.add.at(g["gram"], t.gram[pick], np.repeat(share, size, axis=0)[pick])
        return g

    def project(self, t: Text) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(embeddings, inputs to the gates read forward and backward), each with a row of zeros behind for no word."""
        x, h = np.concatenate([self.embed(t), np.zeros((1, 2 * DIM), np.float32)]), HIDDEN
        cols = np.concatenate([np.arange(2 * k * h, (2 * k + 1) * h) for k in range(3)])
        sides = tuple(x @ np.ascontiguousarray(self.p["wx"][:, c]) + self.p["bx"][c] for c in (cols, cols + h))
        for side in sides:
            side[-1] = 0
        return x, sides

    def logits(self, t: Text, a: int, b: int, rows: int = 1024) -> np.ndarray:
        """Of all windows of texts a to b."""
        lo, hi = t.first[a], t.first[b]
        g_lo = t.gram_at[lo] if lo < len(t.gram_at) else len(t.gram)
        g_hi = t.gram_at[hi] if hi < len(t.gram_at) else len(t.gram)
        part = Text(t.word[lo:hi], t.gram[g_lo:g_hi], t.gram_at[lo:hi] - g_lo, t.first[a : b + 1] - lo)
        _, proj = self.project(part)
        begin, size, _ = windows(part.first)
        return np.concatenate([self.forward(proj, begin[k : k + rows], size[k : k + rows]) for k in range(0, len(begin), rows)])

    def score(self, texts: list[str], rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(score of the highest window, number of windows) of each text."""
        t = inputs(texts)
        text = windows(t.first)[2]
        out = self.logits(t, 0, len(texts), rows)
        at = np.searchsorted(text, np.arange(len(texts)))
        return 1 / (1 + np.exp(-np.maximum.reduceat(out, at).astype(np.float64))), np.bincount(text, minlength=len(texts))


@dataclass
class Constant:
    """Stands in for a network where the labels show one class or none."""

    value: float

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(texts), self.value), np.diff(np.searchsorted(windows(inputs(texts).first)[2], np.arange(len(texts) + 1)))


def fit(rows: list[tuple[int, str]], epochs: int = 7, batch: int | None = None, rate: float = 0.01, seed: int = 11) -> Network | Constant:
    """From (label, text) rows, in batches of a sixteenth of the rows, 32 to 128."""
    y = np.array([int(r[0]) for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    batch = batch or min(128, max(32, len(rows) // 16))
    rng = np.random.default_rng(seed)
    net = Network(seed)
    t = inputs([r[1] for r in rows])
    begin, size, text = windows(t.first)
    at = np.concatenate([np.searchsorted(text, np.arange(len(rows))), [len(text)]])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    # What an entry of the embeddings can learn grows with the texts that have it, and it begins where their labels put it.
    trust = {}
    grams_of = np.repeat(np.arange(len(t.word)), np.diff(np.append(t.gram_at, len(t.gram))))
    word_text = np.repeat(np.arange(len(rows)), np.diff(t.first))
    for k, bucket, text_of, side in (("word", t.word, word_text, 0), ("gram", t.gram, word_text[grams_of], DIM)):
        seen = np.unique(text_of.astype(np.int64) << BITS | bucket)
        bad = np.bincount(seen & (1 << BITS) - 1, weights=y[seen >> BITS], minlength=1 << BITS)
        n = np.bincount(seen & (1 << BITS) - 1, minlength=1 << BITS)
        share = y.mean()
        z = (bad - n * share) / np.sqrt(n * share * (1 - share) + DOUBT)
        trust[k] = (n / (n + DOUBT)).astype(np.float32)[:, None]
        net.p[k] *= trust[k]
        net.p[k][:, 0] += (np.clip(z, -8, 8) * PRIOR[side > 0]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        some = at[:-1] + (rng.random(len(rows)) * np.diff(at)).astype(np.int64)
        if epoch:
            all_logits = np.concatenate([net.logits(t, a, min(a + 200, len(rows))) for a in range(0, len(rows), 200)])
            top = np.array([a + int(all_logits[a:b].argmax()) for a, b in zip(at[:-1], at[1:])])
            chosen = np.concatenate([top, some[y == 0]])
        else:
            chosen = np.concatenate([some, at[:-1] + (rng.random(len(rows)) * np.diff(at)).astype(np.int64)])
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), batch):
            c = chosen[a : a + batch]
            # A text of its own for the batch: only the words that its windows read.
            ids = np.concatenate([np.arange(begin[k], begin[k] + size[k]) for k in c]).astype(np.int64)
            g_at, g_end = t.gram_at, np.append(t.gram_at[1:], len(t.gram))
            sizes = (g_end - g_at)[ids] if len(ids) else np.zeros(0, np.int64)
            grams = np.repeat(g_at[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()) if len(ids) else np.zeros(0, np.int64)
            own = Text(t.word[ids], t.gram[grams], np.cumsum(sizes) - sizes, np.zeros(1, np.int64))
            x, proj = net.project(own)
            logit, kept = net.forward(proj, np.cumsum(size[c]) - size[c], size[c], keep=True)
            p = 1 / (1 + np.exp(-logit))
            d = ((p - y[text[c]]) * weight[text[c]] / len(c)).astype(np.float32)
            step += 1
            for k, g in net.gradients(own, x, kept, d).items():
                g = np.clip(g, -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= trust.get(k, 1) * (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1500) -> Network | Constant:
    """Fits on about per_label labelled rows of each label, chosen by a hash of the id, and at most sampling.TRAIN_BYTES of texts (documented bounds)."""
    some = sampling.bounded_per_class(labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")), "_y", "_id", per_label)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(some), "_id")
    return fit(sampling.bounded_texts(rows, "_y"))


def toxicity(df: DataFrame, model: Network | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, n_windows for every row."""
    src = common.ids_and_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(model)  # about a megabyte

    def run(batches):
        net = shipped.value
        for batch in batches:
            for group in common.groups(batch, GROUP_CHARS):
                s, n = net.score([t for _, t in group])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in group], batch.schema.field(0).type), pa.array(s, pa.float64()), pa.array(n.astype(np.int64))], ["_id", "score", "n_windows"])

    return src.mapInArrow(common.tidy(run), f"_id {kind}, score double, n_windows long").withColumnRenamed("_id", id_col)


#: Score from which a text is predicted toxic.
THRESHOLD = 0.7


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = common.documents(spark, sf_dir, "labels")
    model = train(docs, labels.where(common.crc_mod("doc_id", 3) != 1))
    out = toxicity(docs, model)
    return out.select("doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows")
