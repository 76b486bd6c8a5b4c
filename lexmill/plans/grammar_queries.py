"""Lines analysed over the memo of their distinct words, then resolved and judged sentence by sentence.

Each distinct word is analysed once. Lines are dealt into chunks of a bounded number of words; the analysis is joined once to
each distinct word of a chunk, and a chunk's lines then meet it in one task, so no line is taken apart in rows and put together
again. Without SQL: rules read the left neighbour as rewritten; tests hold them against sentences worked out by hand and the
lines against their words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..checkpoints import Steps
from ..functions.text import strip_punct
from ..grammar import english
from ..io import table
from ..morph import english as M
from .english_queries import LEXICON, known_words, word_counts
from .registry import query
from .split_queries import english_sentences

#: Words of a chunk of lines, about; a longer line is a chunk with its neighbours.
CHUNK_WORDS = 1 << 18


def sentences(spark, sf_dir) -> DataFrame:
    """doc_id, sent, words of the sentences of English documents."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'")
    x = d.select("doc_id", F.posexplode(english_sentences("text")).alias("sent", "s"))
    return x.select("doc_id", F.col("sent").cast("long").alias("sent"), F.filter(F.split("s", "\\s+"), lambda w: w != "").alias("words"))


def over_memo(lines: DataFrame, memo: DataFrame, key: list[str], kind: StructType, each: Callable[[english.Lines], tuple]) -> DataFrame:
    """key and the columns of kind, which each gives for the lines of a chunk: their words with what the memo (w, pos, tags) says of them, in order; a word that it lacks is UNKNOWN, a mark PUNCT. Lines without words have no row."""
    _, x = Steps(lines.sparkSession, "lines").write(lines.select(*key, "words").where(F.size("words") > 0))
    chunks = 1 + (x.agg(F.sum(F.size("words"))).first()[0] or 0) // CHUNK_WORDS
    x = x.withColumn("_chunk", F.pmod(F.xxhash64(*key, "words"), F.lit(chunks)).cast("int"))
    asked = x.repartition("_chunk").select("_chunk", F.explode("words").alias("surface")).distinct().withColumn("w", F.lower(strip_punct("surface")))
    pos = F.when(F.col("w") == "", "PUNCT").otherwise(F.coalesce("pos", F.lit("UNKNOWN")))
    own = asked.join(memo.select("w", "pos", "tags"), "w", "left").select(F.col("_chunk").alias("_at"), "surface", F.lower("surface").alias("low"), pos.alias("pos"), F.coalesce("tags", F.lit("")).alias("tags"))
    arrow = to_arrow_schema(kind)
    out = StructType([*lines.select(*key).schema.fields, *kind.fields])

    def judged(table: pa.Table, words: pa.Table) -> pa.Table:
        known = {s: english.Token(s, low, p, t) for s, low, p, t in zip(*(words.column(c).to_pylist() for c in ("surface", "low", "pos", "tags")))}
        column = pa.concat_arrays(table.column("words").chunks)
        coded = column.flatten().dictionary_encode()
        starts = np.append(0, np.cumsum(pc.list_value_length(column).to_numpy())).astype(np.int64)
        got = each(english.Lines([known[w] for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64), starts))
        made = [pa.array(column, arrow.field(f.name).type) for f, column in zip(kind.fields, got)]
        return pa.table([*(table.column(k) for k in key), *made], names=[*key, *(f.name for f in kind.fields)])

    return x.groupBy("_chunk").cogroup(own.groupBy("_at")).applyInArrow(judged, out)


def analysed(lines: DataFrame, memo: DataFrame, key: list[str]) -> DataFrame:
    """key, tokens array<struct<surface, pos, tags>> of each line."""
    kind = StructType.fromDDL(f"tokens array<{english.TOKEN}>")
    return over_memo(lines, memo, key, kind, lambda x: (x.of([{"surface": t.surface, "pos": t.pos, "tags": t.tags} for t in x.tokens]),))


def resolved(spark, sf_dir, column: str, each: Callable[[english.Lines], list[str]]) -> DataFrame:
    """doc_id, sent and a column of what each says of sentences after disambiguation."""
    counts = word_counts(spark, sf_dir)
    memo = M.analyze(counts.select("w"), known_words(counts), LEXICON)
    return over_memo(sentences(spark, sf_dir), memo, ["doc_id", "sent"], StructType().add(column, "string"), lambda x: (each(english.resolve_lines(x)),))


@query("en_disambiguate")
def en_disambiguate(spark, sf_dir):
    """Parts of speech and tags of each English sentence, in context."""
    return resolved(spark, sf_dir, "tagged", lambda x: [" ".join(words) for words in x.of([t.label for t in x.tokens])])


@query("en_validate")
def en_validate(spark, sf_dir):
    """The first guard that each English sentence fails, or ok."""
    return resolved(spark, sf_dir, "verdict", english.verdicts)


@query("en_rejection_rate")
def en_rejection_rate(spark, sf_dir):
    return en_validate(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
