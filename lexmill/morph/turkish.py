"""Turkish nouns taken apart as a whole: every way to read an ending as plural, possessive and case, scored at once.

All combinations are generated from the three lists, and those that can never stand are left out, so the index has some
thousand endings whatever the corpus. A word's endings are looked up in it by equality, which gives a few readings a word;
the best score wins, and equal scores are told apart by a key without ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicon import turkish as L

_SOFT, _HARD = "".join(L.HARDENED), "".join(L.HARDENED.values())
GENITIVES, N_GENITIVES = ("ın", "in", "un", "ün"), ("nın", "nin", "nun", "nün")


def vowel(s: str, last: bool) -> str:
    own = [c for c in s if c in L.VOWELS]
    return own[-1 if last else 0] if own else ""


def agree(before: str, after: str) -> bool:
    """Vowel harmony of two vowels, either of which may be none."""
    if not before or not after:
        return True
    return (before in L.BACK) == (after in L.BACK) and (after not in L.HIGH or (before in L.ROUNDED) == (after in L.ROUNDED))


def endings() -> list[tuple]:
    """(full, plural, possessive, case, num, poss, case value, implied, first vowel, wants a vowel before it, base score) of all combinations that some stem can have."""
    out = []
    possessives = [("", "", False), *((k, v, False) for k, v in L.POSSESSIVE.items()), *((k, "3SG", True) for k in L.IMPLIED_3SG)]
    for pl, num in [("", ""), *L.PLURAL.items()]:
        for poss, person, implied in possessives:
            if person == "3PL" and num:
                continue
            for case, value in [("", ""), *L.CASE.items()]:
                full = pl + poss + case
                n_case = case.startswith("n") and case not in N_GENITIVES
                if not full or (implied and not case.startswith("n")) or (n_case and person != "3SG"):
                    continue
                before_y, before_gen = pl or poss, poss or pl
                if case.startswith("y") and before_y and before_y[-1] not in L.VOWELS:
                    continue
                if case in N_GENITIVES and before_gen and before_gen[-1] not in L.VOWELS:
                    continue
                pieces = [p for p in (pl, poss, case) if p]
                if not all(agree(vowel(a, True), vowel(b, False)) for a, b in zip(pieces, pieces[1:])):
                    continue
                needs = poss.startswith("s") or (case.startswith("y") and not before_y) or (case in N_GENITIVES and not before_gen)
                score = 100 * bool(person) + 50 * bool(value) + 30 * bool(num) + len(full) + 60 * (implied and bool(num)) - 50 * (person == "3PL")
                out.append((full, pl, poss, case, num, "3PL" if implied and num else person, value, implied, vowel(full, False), needs, score))
    return out


ENDING = "full string, pl string, ps string, cs string, num string, person string, case string, implied boolean, fv string, needs boolean, base int"
LONGEST = max(len(e[0]) for e in endings())


def decompose(words: DataFrame) -> DataFrame:
    """w, root, tags of each distinct word w that some ending fits; other words have no row. w should be in lower case."""
    spark = words.sparkSession
    index = F.broadcast(spark.createDataFrame(endings(), ENDING))  # generated from fixed lists, so its size is bounded
    cuts = words.select("w", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("w") - 2))).alias("k")).where("length(w) > 2")
    x = cuts.select("w", F.expr("left(w, length(w) - k)").alias("stem"), F.expr("right(w, k)").alias("full"))
    x = x.where(F.col("stem").rlike(f"[{L.VOWELS}]")).withColumns({"lv": F.regexp_extract("stem", f"([{L.VOWELS}])[^{L.VOWELS}]*$", 1), "last": F.right("stem", F.lit(1))})
    x = x.join(index, "full")
    among = lambda cls, c: F.instr(F.lit(cls), F.col(c)) > 0
    open_ = among(L.VOWELS, "last")
    x = x.where((~F.col("needs") | open_) & (among(L.BACK, "lv") == among(L.BACK, "fv")) & (~among(L.HIGH, "fv") | (among(L.ROUNDED, "lv") == among(L.ROUNDED, "fv"))))
    x = x.withColumn("cand", F.concat(F.expr("left(stem, length(stem) - 1)"), F.translate("last", _SOFT, _HARD))).withColumn("hard", F.right("cand", F.lit(1)))
    cs, ps, pl, n = F.col("cs"), F.col("ps"), F.col("pl"), F.length("stem")
    mutated, cand_open = F.col("stem") != F.col("cand"), among(L.VOWELS, "hard")
    owned = (ps != "") & ~F.col("implied")
    bare = (ps == "") & (pl == "")
    lone_gen = cs.isin(*GENITIVES) & (F.col("case") == "GEN") & bare & ~open_ & ~F.col("last").isin("n", "y")
    points = [
        (cs.isin("la", "le") & cand_open, -40),
        (owned & cs.rlike("^[yn]") & mutated, -200),
        (~cand_open & ~mutated, 5),
        (F.col("hard").isin("s", "y", "n") & ~F.col("cand").isin(L.OWN_LAST), -60),
        (F.col("implied") & cs.isin("nı", "ni", "nu", "nü", "na", "ne") & (n >= 4), 50),
        (F.col("implied") & (pl == "") & (n < 4), -60),
        (F.right("cand", F.lit(2)).isin("yl", "nl"), -80),
        (owned & mutated & F.col("last").isin("d", "g"), -80),
        (cs.isin("yla", "yle") & cand_open, 40),
        (lone_gen, 80),
        (ps.isin(*GENITIVES) & (F.col("person") == "2SG") & (cs == "") & (pl == "") & ~open_, -80),
        (cs.isin(*N_GENITIVES) & bare & (n >= 4) & open_ & ~F.col("stem").rlike("s[ıiuü]$"), 120),
    ]
    score = F.col("base")
    for when, value in points:
        score = score + F.when(when, value).otherwise(0)
    person = F.when(lone_gen, "2SG").otherwise(F.col("person"))
    plural = (F.col("num") != "") | (F.col("person") == "3PL")
    pair = lambda k, v: F.when(v != "", F.concat(F.lit(f"{k}="), v))
    tags = lambda case: F.concat_ws("|", pair("case", case), F.when(plural, "num=PL"), pair("poss", F.col("p")))
    x = x.withColumns({"score": score, "p": person})
    x = x.select("w", "cand", tags(F.when(F.col("case") == "", "NOM").otherwise(F.col("case"))).alias("tags"), F.struct("score", F.length("full").alias("n"), tags(F.col("case")).alias("t"), "pl", "ps", "cs").alias("key"))
    return x.groupBy("w").agg(F.max_by(F.struct("cand", "tags"), "key").alias("b")).select("w", F.col("b.cand").alias("root"), "b.tags")


def longest_stem(words: DataFrame, known: DataFrame) -> DataFrame:
    """w, stem, tail: the longest beginning of w that is a known word, as it stands or with its last consonant hardened, and before which only an ending is left. Words without one have no row.

    Each word sends its beginnings to the lexicon, so rows grow with its letters, and the join is on equality.
    """
    spark = words.sparkSession
    tails = F.broadcast(spark.createDataFrame(sorted({(e[0],) for e in endings()}), "tail string"))
    cuts = words.where("length(w) > 2").select("w", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("w") - 2))).alias("k"))
    x = cuts.select("w", F.expr("left(w, length(w) - k)").alias("pre"), F.expr("right(w, k)").alias("tail")).join(tails, "tail", "left_semi")
    hard = F.concat(F.expr("left(pre, length(pre) - 1)"), F.translate(F.right("pre", F.lit(1)), _SOFT, _HARD))
    forms = F.array_distinct(F.array(F.struct(F.lit(1).alias("whole"), F.col("pre").alias("stem")), F.struct(F.when(hard == F.col("pre"), 1).otherwise(0).alias("whole"), hard.alias("stem"))))
    x = x.select("w", "pre", "tail", F.explode(forms).alias("f")).select("w", "pre", "tail", "f.whole", "f.stem")
    x = x.join(known.select(F.col("w").alias("stem")), "stem", "left_semi")
    return x.groupBy("w").agg(F.max_by(F.struct("stem", "tail"), F.struct(F.length("pre"), "whole")).alias("b")).select("w", "b.stem", "b.tail")
