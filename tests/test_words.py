"""Word analyses on words worked out by hand, and word cuts against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.morph import english, turkish
from lexmill.operators import wordcut

KNOWN = "theory his tory the expose depart collective global work hope analysis free danger fear bold political politics box read cat dog history beauty solid class piece consensus un happy ness".split()
ENGLISH = {
    "cats": ("cat", "NOUN", "num=PL", ""), "running": ("run", "VERB", "aspect=PROG|tense=PRES", ""), "making": ("make", "VERB", "aspect=PROG|tense=PRES", ""), "added": ("add", "VERB", "tense=PAST", ""),
    "hoping": ("hope", "VERB", "aspect=PROG|tense=PRES", ""), "exposes": ("expose", "VERB", "person=3SG|tense=PRES", ""), "pieces": ("piece", "NOUN", "num=PL", ""), "boxes": ("box", "NOUN", "num=PL", ""),
    "consensus": ("consensus", "NOUN", "", ""), "happier": ("happy", "ADJ", "degree=COMP", ""), "boldest": ("bold", "ADJ", "degree=SUPER", ""), "better": ("good", "ADJ", "degree=COMP", ""),
    "happiness": ("happy", "NOUN", "", "ness→STATE_QUALITY"), "unhappily": ("happy", "ADV", "", "ly→MANNER+un→NEGATION"), "departure": ("depart", "NOUN", "", "ure→RESULT_STATE"),
    "teachers": ("teach", "NOUN", "num=PL", "er→AGENT_NOUN"), "rebuilding": ("build", "VERB", "aspect=PROG|tense=PRES", "re→REPETITION"), "national": ("nation", "ADJ", "", "al→RELATIONAL"),
    "denationalisation": ("nation", "NOUN", "", "ation→ACTION_NOUN+ise→VERBALIZE+al→RELATIONAL+de→REVERSAL"), "globalisation": ("global", "NOUN", "", "ation→ACTION_NOUN+ise→VERBALIZE"),
    "collectivist": ("collective", "NOUN", "", "ist→ADHERENT"), "freedom": ("free", "NOUN", "", "dom→DOMAIN_STATE"), "theory": ("theory", "NOUN", "", ""), "history": ("history", "NOUN", "", ""), "political": ("political", "ADJ", "", ""),
    "non-fiction": ("fiction", "ADJ", "", "non→NEGATION"), "bookshop": ("shop", "NOUN", "", "COMPOUND(book+shop)"), "can": ("can", "AUX", "modal=YES", ""), "3rd": ("3rd", "NUM", "", ""), "xx-yy": ("xx-yy", "UNKNOWN", "", ""),
    "dog's": ("dog", "NOUN", "poss=YES", ""), "readable": ("read", "ADJ", "", "able→CAPABLE_OF"), "beautify": ("beauty", "VERB", "", "ify→VERBALIZE"),
}


def test_english_words(spark):
    words = spark.createDataFrame([(w.title(),) for w in ENGLISH] + [(None,), ("",), ("cats",)], "w string").repartition(3)
    known = spark.createDataFrame([(w,) for w in KNOWN], "w string")
    rows = english.analyze(words, known).collect()
    got = {r["w"]: (r["root"], r["pos"], r["tags"], r["chain"]) for r in rows}
    assert got == ENGLISH and len(rows) == len(ENGLISH)
    assert english.analyze(words.limit(0), known).count() == 0


TURKISH = {
    "kitabını": ("kitap", "case=ACC|poss=3SG"), "kedinin": ("kedi", "case=GEN"), "evin": ("ev", "case=GEN|poss=2SG"), "evinden": ("ev", "case=ABL|poss=2SG"), "evleri": ("ev", "case=ACC|num=PL"),
    "arabasının": ("araba", "case=GEN|poss=3SG"), "evlerden": ("ev", "case=ABL|num=PL"), "evinizde": ("ev", "case=LOC|poss=2PL"),
}


def test_turkish_nouns(spark):
    words = spark.createDataFrame([(w,) for w in [*TURKISH, "kr", "ev", "", None]], "w string")
    got = {r["w"]: (r["root"], r["tags"]) for r in turkish.decompose(words).collect()}
    assert got == TURKISH


def test_every_ending_is_one_that_the_lists_allow():
    ends = turkish.endings()
    assert len(set(ends)) == len(ends) and all(e[0] == e[1] + e[2] + e[3] != "" for e in ends)
    assert not any(e[4] and e[5] == "3PL" and not e[7] for e in ends)


def test_longest_stem(spark):
    words = spark.createDataFrame([("evlerde",), ("kitabı",), ("adını",), ("zzz",), ("ev",)], "w string")
    known = spark.createDataFrame([("ev",), ("evler",), ("kitap",), ("ad",), ("at",)], "w string")
    assert sorted(tuple(r) for r in turkish.longest_stem(words, known).collect()) == [("adını", "ad", "ını"), ("evlerde", "evler", "de"), ("kitabı", "kitap", "ı")]


def brute(s, scores, base, longest, lone=wordcut.LONE):
    best = [(0, [])] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            for score in ([scores[s[b:e]]] if s[b:e] in scores else []) + ([-lone] if e == b + 1 else []):
                x = best[b][0] + score - base
                if best[e] is None or x > best[e][0]:
                    best[e] = x, [*best[b][1], s[b:e]]
    return best[-1][1]


@pytest.mark.parametrize("seed", range(2))
def test_word_cuts(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choices("abé漢", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
    total = sum(counts.values())
    texts = ["".join(rng.choices("abé漢z", k=rng.randint(1, 40))) for _ in range(30)]
    d = wordcut.dictionary(spark.createDataFrame(list(counts.items()), "w string, cnt long"))
    scores = {w: math.floor(1000 * math.log(n)) for w, n in counts.items()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(98, ""), (99, None)], "id long, s string")
    got = {r["id"]: r["pieces"] for r in wordcut.cut(df, d, total, 3).collect()}
    assert got == {i: brute(t, scores, math.floor(1000 * math.log(total)), 3) for i, t in enumerate(texts)}


def test_cut_query_loses_no_character(spark):
    from lexmill.plans import cut_queries

    rows = cut_queries.cuts(spark, "/root/testdata/sf0.001").select("s", F.array_join("pieces", "").alias("j"), F.size("pieces").alias("n")).collect()
    assert rows and all(r["s"] == r["j"] and r["n"] > 0 for r in rows)


def test_word_cuts_over_many_chunks(spark, monkeypatch):
    """Chunks of a few texts, a bitmap that rules nothing out, rows that share an id, and a text that no other chunk's words cut."""
    monkeypatch.setattr(wordcut, "CHUNK_CHARS", 16)
    monkeypatch.setattr(wordcut, "MOST_BITS", 1 << 15)
    rng = random.Random(5)
    counts = {"".join(rng.choices("abé漢", k=rng.randint(1, 6))): rng.randint(1, 50) for _ in range(60)} | {f"x{i}": 1 for i in range(30000)}
    total = sum(counts.values())
    texts = ["".join(rng.choices("abé漢z", k=rng.randint(1, 40))) for _ in range(40)]
    scores = {w: math.floor(1000 * math.log(n)) for w, n in counts.items()}
    d = wordcut.dictionary(spark.createDataFrame(list(counts.items()), "w string, cnt long"))
    rows = wordcut.cut(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, s string"), d, total, 5).collect()
    assert sorted((r["id"], r["pieces"]) for r in rows) == sorted((i // 2, brute(t, scores, math.floor(1000 * math.log(total)), 5)) for i, t in enumerate(texts))


def test_cut_scores_count_each_sentence_once(spark, tmp_path):
    """Rows that share conversation and turn are counted under their own role."""
    rows = [(1, 0, "user", "the cat sat. The dog"), (1, 0, "assistant", "a cat"), (None, 1, "user", "dog")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "the cat sat the dog The dog a cat", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    from lexmill.plans import QUERIES

    got = {r["role"]: (r["sentences"], r["words"]) for r in QUERIES["word_cut_scores"](spark, str(tmp_path)).collect()}
    assert got == {"user": (3, 6), "assistant": (1, 2)}


def test_counts_of_words_are_a_written_table(spark):
    """An analysis reads them at every step; none reads the documents again."""
    from lexmill.plans.english_queries import word_counts

    files = word_counts(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents" in f for f in files)
