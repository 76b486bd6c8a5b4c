"""Word cuts of conversations without their spaces, by a dictionary of the words of documents, against the breaks that were there. Without SQL: a recursion over places takes minutes there; tests hold the cuts against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..io import table
from ..operators import stats, wordcut
from .registry import query
from .text_queries import tokens

LONGEST = 24


def cuts(spark, sf_dir):
    """conv_id, turn, role, sent, t, s, pieces: sentences of conversations, t as they were."""
    steps = Steps(spark, "cuts")
    _, counts = steps.write(stats.freq(tokens(spark, sf_dir), "w"))
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    c = table(spark, sf_dir, "conversations").where("text is not null")
    x = c.select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?\\n]+[.!?]*"), F.lit(0))).alias("sent", "t")).withColumn("s", F.regexp_replace("t", "\\s", "")).where("s <> ''")
    return wordcut.cut(x, wordcut.dictionary(counts), total, LONGEST)


@query("word_cut")
def word_cut(spark, sf_dir):
    return cuts(spark, sf_dir).select("conv_id", "turn", "sent", F.array_join("pieces", " ").alias("words"))


@query("word_cut_scores")
def word_cut_scores(spark, sf_dir):
    """Breaks found of those that were there, by role."""
    # A fold, as each end is the one before it and a word's length.
    ends = lambda ws: F.aggregate(ws, F.array().cast("array<int>"), lambda acc, w: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(w))))
    x = cuts(spark, sf_dir).withColumn("ws", F.regexp_extract_all("t", F.lit("\\S+"), F.lit(0)))
    x = x.select("role", ends(F.col("ws")).alias("own"), ends(F.col("pieces")).alias("cut"))
    n = lambda c: F.sum(F.size(c))
    both = F.array_intersect("own", "cut")
    return x.groupBy("role").agg(F.count(F.lit(1)).alias("sentences"), n("own").alias("words"), n("cut").alias("cut"), n(both).alias("shared"), F.round(2 * n(both) / (n("own") + n("cut")), 6).alias("f1"))
