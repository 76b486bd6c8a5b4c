"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import common
from lexmill.llm.decontaminate import decontamination_stage
from lexmill.llm.neardup import neardup_stage
from lexmill.llm.pieces import encode_decode, piece_model, tokenizer_path
from lexmill.llm.quality import quality_stage
from lexmill.llm.substrings import substring_stage


#: Words that a worker of the last stage keeps: four stages have filled its executor's heap by then.
STAGE_WORDS = 60_000


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids and digests of the kept texts, which must decode to themselves."""
    x = encode_decode(docs, piece_model(tokenizer_path()), memo_words=STAGE_WORDS)
    return x.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("repeated_passages", substring_stage),
    ("decontamination", decontamination_stage),
    ("pieces", piece_stage),
]

#: The stages' models and hashes have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return docs
