"""Byte-pair training against merging one pair after another."""

import random
from collections import Counter

import pytest

from lexmill.operators import bpe
from lexmill.plans import QUERIES
from lexmill.plans.text_queries import tokens

SF = "/root/testdata/sf0.001"


def one_by_one(counts, letters, merges, least=2):
    number = {c: i + 1 for i, c in enumerate(letters)}
    text = dict(enumerate(letters, 1))
    words = {w: [number.get(c, 0) for c in bpe.START + w] for w in counts}
    out = []
    while len(out) < merges:
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                if 0 not in p:
                    pairs[p] += counts[w]
        best = min(pairs, key=lambda p: (-pairs[p], max(p), p), default=None)
        if best is None or pairs[best] < least:
            break
        new = len(letters) + len(out) + 1
        text[new] = text[best[0]] + text[best[1]]
        out.append((text[best[0]], text[best[1]], pairs[best]))
        words = {w: bpe.merge_symbols(s, {best: new}) for w, s in words.items()}
    return out, {w: [text.get(x) for x in s] for w, s in words.items()}


def trained(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["lang"]), r["rank"])):
        got.setdefault(r["lang"], []).append((r["left"], r["right"], r["cnt"]))
        assert r["rank"] == len(got[r["lang"]]) and r["piece"] == r["left"] + r["right"]
    return got


def test_query_is_one_by_one_training(spark):
    counts = {}
    for r in tokens(spark, SF).select("lang", "w").collect():
        counts.setdefault(r["lang"], Counter())[r["w"]] += 1
    chars = Counter()
    for c in counts.values():
        for w, n in c.items():
            chars.update({ch: n * k for ch, k in Counter(bpe.START + w).items()})
    kept, got, total = [], 0, sum(chars.values())
    for ch, n in sorted(chars.items(), key=lambda x: (-x[1], x[0])):
        if got >= 0.9995 * total:
            break
        got += n
        kept.append(ch)
    letters = sorted(kept, key=lambda c: c.encode())
    want = {lang: one_by_one(c, letters, 24) for lang, c in counts.items()}
    assert trained(QUERIES["bpe_train"](spark, SF)) == {lang: x[0] for lang, x in want.items()}
    pieces = Counter()
    for lang, (_, cut) in want.items():
        for w, parts in cut.items():
            if None not in parts:
                for p in parts:
                    pieces[lang, p] += counts[lang][w]
    for r in QUERIES["bpe_pieces"](spark, SF).collect():
        assert r["cnt"] >= pieces.get((r["lang"], r["piece"]), 0)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_ties_and_compaction(spark, seed):
    rng = random.Random(seed)
    counts = Counter({"".join(rng.choices("aab", k=rng.randint(1, 9))): rng.randint(1, 3) for _ in range(40)})
    rows = [(None, w, n) for w, n in counts.items()] + [("x", "", 3), ("x", None, 3), ("x", "q", 5)]
    df = spark.createDataFrame(rows, "lang string, w string, cnt long")
    got = trained(bpe.train(df, bpe.BpeSpec(merges=30, coverage=1.0, compact=2, top=4)))
    letters = sorted({bpe.START, "q", *"".join(counts)}, key=lambda c: c.encode())
    want, cut = one_by_one(counts, letters, 30)
    assert got == {None: want, "x": [(bpe.START, "q", 5)]}
    merges = bpe.train(df, bpe.BpeSpec(merges=30, coverage=1.0))
    for r in bpe.encode(df.where("lang is null"), merges).collect():
        assert r["pieces"] == cut[r["w"]]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([], "lang string, w string, cnt long")
    assert bpe.train(df).count() == 0
