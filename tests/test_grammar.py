"""English sentence rules on sentences worked out by hand, and lines over the memo of their words."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexmill.grammar import english
from lexmill.plans import QUERIES, grammar_queries
from lexmill.plans.text_queries import tokens

SF = "/root/testdata/sf0.001"
#: Sentences as word/POS/tags.
SENTENCES = [
    (1, "the/DET/ runs/VERB/ were/AUX/ long/ADJ/"), (2, "he/PRON/ runs/VERB/"), (3, "Running/VERB/ is/AUX/ fun/NOUN/"), (4, "she/PRON/ is/AUX/ running/NOUN/"), (5, "I/PRON/ want/VERB/ to/PREP/ walk/VERB/"),
    (6, "we/PRON/ went/VERB/ to/PART/ the/DET/ shop/NOUN/"), (7, "they/PRON/ know/VERB/ that/DET/ love/VERB/ wins/VERB/"), (8, "that/PRON/ state/NOUN/ grew/VERB/"), (9, "those/DET/ shout/VERB/"), (10, "after/PREP/ he/PRON/ left/VERB/ we/PRON/ ate/VERB/"),
    (11, "before/CONJ/ the/DET/ war/NOUN/"), (12, "my/DET/ love/VERB/tense=PRES ended/VERB/"), (13, "a/DET/ taller/NOUN/ than/CONJ/ me/PRON/"), (14, "more/ADJ/ happy/ADJ/ people/NOUN/ came/VERB/"), (15, "and/CONJ/ she/PRON/ left/VERB/"),
    (16, "the/DET/ of/PREP/ him/PRON/ was/AUX/"), (17, "he/PRON/ ate/VERB/ with/PREP/"), (18, "eating/VERB/aspect=PROG we/PRON/ talk/VERB/"), (19, "walked/VERB/ we/PRON/"), (20, "because/CONJ/ rain/NOUN/ fell/VERB/"), (21, "she/PRON/ left/VERB/ because/CONJ/"),
]

DISAMBIGUATED = [
    (1, "DET NOUN:num=PL AUX ADJ"), (2, "PRON VERB:person=3SG|tense=PRES"), (3, "NOUN AUX NOUN"), (4, "PRON AUX VERB:aspect=PROG|tense=PRES"), (5, "PRON VERB PART:subcat=INF VERB"),
    (6, "PRON VERB PREP DET NOUN"), (7, "PRON VERB CONJ:subcat=COMP NOUN VERB"), (8, "DET NOUN VERB"), (9, "PRON NOUN"), (10, "CONJ:subcat=SUB PRON VERB PRON VERB"),
    (11, "PREP DET NOUN"), (12, "DET NOUN VERB"), (13, "DET ADJ:degree=COMP CONJ PRON"), (14, "ADV:degree=COMP ADJ NOUN VERB"), (15, "CONJ PRON VERB"),
    (16, "DET PREP PRON AUX"), (17, "PRON VERB PREP"), (18, "VERB:aspect=PROG PRON VERB"), (19, "VERB PRON"), (20, "CONJ NOUN VERB"), (21, "PRON VERB CONJ"),
]

VERDICTS = [
    (1, "ok"), (2, "ok"), (3, "ok"), (4, "ok"), (5, "ok"), (6, "ok"), (7, "ok"), (8, "ok"), (9, "no main verb or copula"), (10, "ok"), (11, "no main verb or copula"), (12, "ok"), (13, "no main verb or copula"), (14, "ok"), (15, "coordinator at an edge"),
    (16, "determiner without noun"), (17, "preposition without object"), (18, "aspect without auxiliary"), (19, "subject after verb"), (20, "ok"), (21, "subordinator without clause"),
]


def sentences(spark):
    parts = lambda w: F.struct(F.split(w, "/")[0].alias("surface"), F.split(w, "/")[1].alias("pos"), F.split(w, "/")[2].alias("tags"))
    return spark.createDataFrame(SENTENCES, "id int, s string").select("id", F.transform(F.split("s", " "), parts).alias("tokens"))


def test_disambiguation(spark):
    d = sentences(spark).select("id", english.disambiguate(F.col("tokens")).alias("t")).collect()
    assert sorted((r["id"], " ".join(t["pos"] + (":" + t["tags"] if t["tags"] else "") for t in r["t"])) for r in d) == DISAMBIGUATED


def test_guards(spark):
    d = sentences(spark).select("id", english.content(english.disambiguate(F.col("tokens"))).alias("c"))
    d = d.select("id", F.when(F.spark_partition_id() >= 0, F.col("c")).alias("c")).select("id", english.validate(F.col("c")).alias("verdict"))
    assert sorted(tuple(r) for r in d.collect()) == VERDICTS


def test_lines_over_the_memo(spark):
    lines = spark.createDataFrame([(1, 0, ["Cats", "run", ",", "Cats", "!"]), (1, 1, []), (2, 0, ["nope"])], "doc_id long, sent long, words array<string>")
    memo = spark.createDataFrame([("cats", "NOUN", "num=PL"), ("run", "VERB", None)], "w string, pos string, tags string")
    got = {(r["doc_id"], r["sent"]): [tuple(t) for t in r["tokens"]] for r in grammar_queries.analysed(lines, memo, ["doc_id", "sent"]).collect()}
    cat = ("Cats", "NOUN", "num=PL")
    assert got == {(1, 0): [cat, ("run", "VERB", ""), (",", "PUNCT", ""), cat, ("!", "PUNCT", "")], (2, 0): [("nope", "UNKNOWN", "")]}


def test_queries_keep_every_word(spark):
    tagged = QUERIES["en_disambiguate"](spark, SF).collect()
    words = Counter(r["doc_id"] for r in grammar_queries.sentences(spark, SF).select("doc_id", F.explode("words")).collect())
    got = Counter()
    for r in tagged:
        got[r["doc_id"]] += len(r["tagged"].split(" "))
    assert got == words and len(words) == tokens(spark, SF, "en").select("doc_id").distinct().count()


def test_lines_of_one_key_stay_apart_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(grammar_queries, "CHUNK_WORDS", 2)
    lines = spark.createDataFrame([(1, 0, ["cats", "run"]), (1, 0, ["run", "Cats"]), (1, 0, ["run"])] * 2, "doc_id long, sent long, words array<string>")
    memo = spark.createDataFrame([("cats", "NOUN", "num=PL")], "w string, pos string, tags string")
    got = Counter(tuple((t["surface"], t["pos"]) for t in r["tokens"]) for r in grammar_queries.analysed(lines, memo, ["doc_id", "sent"]).collect())
    run = ("run", "UNKNOWN")
    assert got == {(("cats", "NOUN"), run): 2, (run, ("Cats", "NOUN")): 2, (run,): 2}


def test_rejections_count_every_sentence(spark, tmp_path):
    """Documents that share an id are judged sentence by sentence too."""
    rows = [(1, "The dog was here. She left because.", "en", "web"), (1, "Of him. He runs.", "en", "web"), (2, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["verdict"]: r["n"] for r in QUERIES["en_rejection_rate"](spark, str(tmp_path)).collect()}
    assert sum(got.values()) == 4


def test_a_very_long_sentence():
    """Rules of one sentence take time in proportion to its words: 200,000 are judged at once."""
    word = lambda w: english.Token(w, w, "VERB", "")
    dog = english.Token("the", "the", "DET", "")
    out = english.resolve([dog, word("walk")] * 100_000)
    assert {t.pos for t in out[1::2]} == {"NOUN"} and english.verdict(out) == "no main verb or copula"


def test_many_lines_at_once_are_judged_as_one_by_one():
    rng = random.Random(3)
    surfaces = "the a he she runs running to that this before because and but is has was after more than of in Taller dog eaten walk walking , . nice xx my i ended".split()
    kinds = [(p, t) for p in ("DET", "ADJ", "NOUN", "PRON", "UNKNOWN", "PREP", "VERB", "AUX", "CONJ", "PUNCT", "FOREIGN", "ADV") for t in ("", "aspect=PROG", "aspect=PERF", "subcat=SUB", "poss=YES|num=PL")]
    pool = [english.Token(s, s.lower(), *rng.choice(kinds)) for s in surfaces for _ in range(8)]
    pool += [english.Token(s, s, p, "") for s, p in (("he", "PRON"), ("dog", "NOUN"), ("walk", "VERB"), ("the", "DET"), ("of", "PREP"), ("nice", "ADJ"), ("because", "CONJ"), ("is", "AUX"))] * 40
    codes = [[rng.randrange(len(pool)) for _ in range(rng.randint(0, 9))] for _ in range(40_000)]
    for some in (codes, [[]], [], codes[:1]):
        lines = english.resolve_lines(english.Lines(pool, np.array([k for c in some for k in c], np.int64), np.cumsum([0, *map(len, some)])))
        alone = [english.resolve([pool[k] for k in c]) for c in some]
        assert lines.of([t.label for t in lines.tokens]) == [[t.label for t in x] for x in alone]
        assert english.verdicts(lines) == [english.verdict([t for t in x if t.content]) for x in alone]
    assert len(Counter(english.verdict([t for t in english.resolve([pool[k] for k in c]) if t.content]) for c in codes)) == 9


def test_tokens_share_their_tags_and_know_marks():
    a, b = (english.Token(s, s, "NOUN", "num=PL|case=X") for s in ("cats", "dogs"))
    assert a.kv is b.kv == {"num=PL", "case=X"} and "" in english.Token("x", "x", "NOUN", "").kv
    content = {s: english.Token(s, s, "UNKNOWN", "").content for s in (".", "?!", ";,", "a.", ".a", "", "-", "…")}
    assert content == {s: not re.fullmatch("[.!?;,]+", s) for s in content} and not english.Token("x", "x", "PUNCT", "").content
