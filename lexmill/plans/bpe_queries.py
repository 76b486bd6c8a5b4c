"""Byte-pair training over the words of documents, and words cut by what was learnt. Without SQL: tests hold the merges against one-by-one training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..operators import bpe, stats, vocab
from ..sources import chunks
from .registry import query
from .text_queries import tokens

#: Merges of a language in the registered queries.
MERGES = 24


def _words(spark, sf_dir):
    return stats.freq(tokens(spark, sf_dir), "lang", "w")


@query("bpe_train")
def bpe_train(spark, sf_dir):
    """The first merges of each language, from all its words."""
    return bpe.train(_words(spark, sf_dir), bpe.BpeSpec(merges=MERGES))


@query("bpe_pieces")
def bpe_pieces(spark, sf_dir):
    """How often each piece occurs when all words are cut by their language's merges."""
    words = _words(spark, sf_dir)
    cut = bpe.encode(words, bpe.train(words, bpe.BpeSpec(merges=MERGES)))
    return cut.select("lang", F.explode("pieces").alias("piece"), "cnt").groupBy("lang", "piece").agg(F.sum("cnt").alias("cnt"))


# Vocabularies over resumable chunks -----------------------------------------

CHUNKS, CAP = 16, 32_000
_TOK = r"tok AS (SELECT doc_id, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS l FROM documents WHERE text IS NOT NULL))"


def _chunks(spark, sf_dir):
    steps = Steps(spark, "chunked-vocab")
    words = tokens(spark, sf_dir).select("doc_id", "pos", "w")
    number = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(CHUNKS))
    chunks.run_chunks(words, number, ["w"], chunks.chunk_vocabulary, steps.root, chunks.Plan("vocabulary", CHUNKS))
    return chunks.read_chunks(spark, steps.root, chunks.chunk_vocabulary(words.withColumn("_chunk", F.lit(0))).schema)


@query("chunk_counts", f"WITH {_TOK} SELECT (doc_id % {CHUNKS})::INTEGER AS chunk, count(*) AS tokens, count(DISTINCT w) AS words FROM tok GROUP BY 1")
def chunk_counts(spark, sf_dir):
    """Tokens and words of each resumable chunk."""
    return _chunks(spark, sf_dir).groupBy(F.col("_chunk").alias("chunk")).agg(F.sum("cnt").alias("tokens"), F.count(F.lit(1)).alias("words"))


@query(
    "chunked_vocab",
    f"WITH {_TOK}, f AS (SELECT w, count(*) AS cnt, min((doc_id, pos)) AS first FROM tok GROUP BY w) SELECT w, 3 + row_number() OVER (ORDER BY cnt DESC, first, w) AS id, cnt AS freq FROM (SELECT * FROM f ORDER BY cnt DESC, first, w LIMIT {CAP - 4}) WHERE w NOT IN ('<pad>', '<unk>', '<s>', '</s>')",
)
def chunked_vocab(spark, sf_dir):
    """The capped vocabulary, merged from those of resumable chunks."""
    return vocab.build_vocab(chunks.merged_vocabulary(_chunks(spark, sf_dir)), first=["first"], cap=CAP).select("w", F.col("id").cast("long").alias("id"), "freq")
