"""Runs, losses and bundles measured on the given tables, for the queries over evaluation results.

A language's two regimes are its words as they are and its words in two pieces (four letters and the rest); a regime's loss is
the entropy of its units, as a unigram model has it. A word's bundle is what its ending says, with its part of speech.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from .derived import words_in, words_in_sql

_WORDS = r"SELECT lang, source, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents WHERE text IS NOT NULL"
_UNITS = f"SELECT lang, source, 'baseline' AS regime, w AS unit FROM ({_WORDS}) UNION ALL SELECT lang, source, 'morph', left(w, 4) FROM ({_WORDS}) UNION ALL SELECT lang, source, 'morph', w[5:] FROM ({_WORDS}) WHERE length(w) > 4"
_ENTROPY = "round(ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n), 5)"
RUNS_SQL = f"(SELECT lang, regime, loss, round(exp(loss), 3) AS ppl, tokens FROM (SELECT lang, regime, {_ENTROPY} AS loss, sum(n)::BIGINT AS tokens FROM (SELECT lang, regime, unit, count(*) AS n FROM ({_UNITS}) GROUP BY ALL) GROUP BY ALL)) AS t(lang, regime, loss, ppl, tokens)"
SEEDS_SQL = f"(SELECT lang || '_' || regime || '_s' || source AS cell, {_ENTROPY.replace(', 5)', ', 9)')} AS bpc FROM (SELECT lang, source, regime, unit, count(*) AS n FROM ({_UNITS}) GROUP BY ALL) GROUP BY lang, regime, source) AS t(cell, bpc)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").where("text is not null").select("lang", "source", F.explode(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0))).alias("w"))
    pieces = F.when(F.length("w") > 4, F.array(F.left("w", F.lit(4)), F.expr("substr(w, 5)"))).otherwise(F.array("w"))
    each = F.explode(F.concat(F.array(F.struct(F.lit("baseline").alias("regime"), F.col("w").alias("unit"))), F.transform(pieces, lambda p: F.struct(F.lit("morph").alias("regime"), p.alias("unit")))))
    return w.select("lang", "source", each.alias("x")).select("lang", "source", "x.*")


def _entropy(digits: int = 5):
    n = F.col("n").cast("double")
    return F.round(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n), digits)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, regime, loss, ppl, tokens."""
    n = _units(spark, sf_dir).groupBy("lang", "regime", "unit").agg(F.count(F.lit(1)).alias("n"))
    x = n.groupBy("lang", "regime").agg(_entropy().alias("loss"), F.sum("n").alias("tokens"))
    return x.select("lang", "regime", "loss", F.round(F.exp("loss"), 3).alias("ppl"), "tokens")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, bpc: a language's regime on one source, as a seed of it."""
    n = _units(spark, sf_dir).groupBy("lang", "source", "regime", "unit").agg(F.count(F.lit(1)).alias("n"))
    x = n.groupBy("lang", "regime", "source").agg(_entropy(9).alias("bpc"))
    return x.select(F.concat_ws("_", "lang", "regime", F.concat(F.lit("s"), "source")).alias("cell"), "bpc")


_TALK = r"SELECT CASE role WHEN 'assistant' THEN 'morph' ELSE 'base' END AS mode, conv_id * 1000 + turn AS text_id, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT role, conv_id, turn, regexp_extract_all(text, '\S+') AS l FROM conversations WHERE text IS NOT NULL)"
LOSSES_SQL = f"(SELECT mode, t.text_id, pos, CASE WHEN regexp_matches(t.w, '[,.]$') THEN 0 ELSE length(t.w) END AS token, CASE WHEN regexp_matches(t.w, '(s|ed|ing|ly)$') THEN 1 ELSE 0 END AS feature, round(ln(m.n::DOUBLE / c.n), 5) AS loss FROM ({_TALK}) t JOIN (SELECT w, count(*) AS n FROM ({_TALK}) GROUP BY w) c ON c.w = t.w, (SELECT count(*) AS n FROM ({_TALK})) m) AS t(mode, text_id, pos, token, feature, loss)"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mode, text_id, pos, token, feature, loss of every word of conversations: its unigram loss; a word at a stop is padding (token 0)."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    t = c.select(F.when(F.col("role") == "assistant", "morph").otherwise("base").alias("mode"), (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.posexplode(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0))).alias("pos", "w"))
    n = t.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    m = F.broadcast(n.agg(F.sum("n").alias("m")))  # one row
    x = t.join(n, "w").join(m)
    return x.select("mode", "text_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("w").rlike("[,.]$"), 0).otherwise(F.length("w")).alias("token"), F.when(F.col("w").rlike("(s|ed|ing|ly)$"), 1).otherwise(0).alias("feature"), F.round(F.log(F.col("m").cast("double") / F.col("n")), 5).alias("loss"))


_POS = "CASE WHEN regexp_matches(w, 'ly$') THEN 'ADV' WHEN regexp_matches(w, '(ing|ed)$') THEN 'VERB' WHEN regexp_matches(w, '(er|est)$') THEN 'ADJ' WHEN length(w) <= 3 THEN 'DET' ELSE 'NOUN' END"
_BUNDLES = f"SELECT w, pos, CASE pos WHEN 'VERB' THEN 'tense' WHEN 'ADJ' THEN 'degree' WHEN 'NOUN' THEN 'num' END AS k1, CASE WHEN pos = 'VERB' THEN CASE WHEN ends_with(w, 'ed') THEN 'PAST' ELSE 'PRES' END WHEN pos = 'ADJ' THEN CASE WHEN ends_with(w, 'est') THEN 'SUPER' ELSE 'COMP' END WHEN pos = 'NOUN' THEN CASE WHEN ends_with(w, 's') THEN 'PL' ELSE 'SG' END END AS v1, CASE WHEN pos = 'VERB' THEN CASE WHEN ends_with(w, 'ed') THEN 'voice' ELSE 'aspect' END WHEN pos = 'ADJ' AND regexp_matches(w, '^[aeiou]') THEN 'poss' WHEN pos = 'NOUN' AND regexp_matches(w, '^[A-Z]') THEN '_position' END AS k2, CASE WHEN pos = 'VERB' THEN CASE WHEN ends_with(w, 'ed') THEN 'PASS' ELSE 'PROG' END WHEN pos = 'ADJ' AND regexp_matches(w, '^[aeiou]') THEN 'YES' WHEN pos = 'NOUN' AND regexp_matches(w, '^[A-Z]') THEN 'opener' END AS v2 FROM (SELECT w, {_POS} AS pos FROM {words_in_sql('latin')})"
#: Tags as a list of k=v in order, the internal ones left out, then as a bundle and as a string.
_LIST = "list_sort(list_filter([k1 || '=' || v1, k2 || '=' || v2], lambda x: x IS NOT NULL AND NOT starts_with(x, '_')))"
BUNDLES_SQL = f"(SELECT w, pos, k1, v1, k2, v2, array_to_string({_LIST}, '|') AS tags, CASE WHEN len({_LIST}) > 0 THEN 'pos=' || pos || '|' || array_to_string({_LIST}, '|') ELSE 'no_features' END AS bundle FROM ({_BUNDLES})) AS t(w, pos, k1, v1, k2, v2, tags, bundle)"


def bundled(words: DataFrame) -> DataFrame:
    """w, pos, k1, v1, k2, v2, tags, bundle of rows of words: two tags at most, by their endings; comparisons alone, so that rows are cheap."""
    w, pos = F.col("w"), F.col("pos")
    ends = lambda *xs: reduce(or_, [w.endswith(x) for x in xs])
    first = F.left("w", F.lit(1))
    kind = F.when(ends("ly"), "ADV").when(ends("ing", "ed"), "VERB").when(ends("er", "est"), "ADJ").when(F.length(w) <= 3, "DET").otherwise("NOUN")
    x = words.select("w", kind.alias("pos"))
    ed, strange, opener = w.endswith("ed"), (pos == "ADJ") & first.isin(*"aeiou"), (pos == "NOUN") & first.between("A", "Z")
    x = x.select(
        "w",
        "pos",
        F.when(pos == "VERB", "tense").when(pos == "ADJ", "degree").when(pos == "NOUN", "num").alias("k1"),
        F.when(pos == "VERB", F.when(ed, "PAST").otherwise("PRES")).when(pos == "ADJ", F.when(w.endswith("est"), "SUPER").otherwise("COMP")).when(pos == "NOUN", F.when(w.endswith("s"), "PL").otherwise("SG")).alias("v1"),
        F.when(pos == "VERB", F.when(ed, "voice").otherwise("aspect")).when(strange, "poss").when(opener, "_position").alias("k2"),
        F.when(pos == "VERB", F.when(ed, "PASS").otherwise("PROG")).when(strange, "YES").when(opener, "opener").alias("v2"),
    )
    own = lambda k, v: F.when(~F.col(k).startswith("_"), F.concat(k, F.lit("="), v))
    x = x.withColumns({"a": own("k1", "v1"), "b": own("k2", "v2")})
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    x = x.withColumn("tags", F.concat_ws("|", F.least("a", "b"), F.when(both, F.greatest("a", "b")))).drop("a", "b")
    return x.withColumn("bundle", F.when(F.col("tags") != "", F.concat(F.lit("pos="), "pos", F.lit("|"), "tags")).otherwise("no_features"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundles of the distinct words of documents."""
    return bundled(words_in(spark, sf_dir, "latin"))
