"""Readers of corpora, lexicons, logs and gold files: Spark's own readers with the rules of each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def corpus_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """lang, split, text of files {lang}_{split}.txt: trimmed lines that are not blank."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    d = spark.read.text(path).select(F.regexp_extract(name, "^([a-z]+)_(\\w+)\\.txt$", 1).alias("lang"), F.regexp_extract(name, "^([a-z]+)_(\\w+)\\.txt$", 2).alias("split"), F.trim("value").alias("text")).where("text <> ''")
    return d.limit(limit) if limit else d


def words_of_first_lines(spark: SparkSession, path: str, max_lines: int) -> DataFrame:
    """Words of the first lines; blank lines count towards the number of lines."""
    return spark.read.text(path).limit(max_lines).select(F.explode(F.regexp_extract_all("value", F.lit("\\S+"), F.lit(0))).alias("w"))


def column_of(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of Parquet files; the others are not read."""
    return spark.read.parquet(path).select(column)


def union_of(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON; what cannot be read is null."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema is not None else r).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def run_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Result files of runs with rung, lang and regime from the folder's name; other folders are left out."""
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    p = "^(\\w+?)_([a-z]{2})_(baseline|morph)$"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select("*", run.alias("run_id"))
    return d.where(F.col("run_id").rlike(p)).select("*", *[F.regexp_extract("run_id", p, k + 1).alias(c) for k, c in enumerate(("rung", "run_lang", "regime"))])


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r).csv(path)


def frequency_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, zipf of a TSV; malformed rows are left out."""
    d = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema("word string, zipf double").csv(path)
    return d.where("word is not null and zipf is not null")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """sent, id, form, lemma, upos, feats of CoNLL-U files, one text a file: without the words of multiword ranges and empty nodes."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n\\s*\n")).alias("sent", "block"))
    line = raw.select("file", "sent", F.posexplode(F.split("block", "\n")).alias("line", "text")).where(~F.col("text").startswith("#") & (F.trim("text") != ""))
    c = line.select("file", "sent", F.split("text", "\t").alias("c"))
    r = c.select("file", "sent", *[F.get("c", F.lit(k)).alias(n) for k, n in ((0, "id"), (1, "form"), (2, "lemma"), (3, "upos"), (5, "feats"))])
    spans = r.where(F.col("id").rlike("^\\d+-\\d+$")).select("file", "sent", F.explode(F.sequence(F.split("id", "-")[0].cast("int"), F.split("id", "-")[1].cast("int")).cast("array<string>")).alias("id"))
    return r.where(F.col("id").rlike("^\\d+$")).join(spans, ["file", "sent", "id"], "left_anti").withColumn("id", F.col("id").cast("int"))


def unihan_radicals(spark: SparkSession, path: str) -> DataFrame:
    """char, radical from Unihan's kRSUnicode lines."""
    d = spark.read.option("sep", "\t").schema("code string, field string, value string").csv(path).where("field = 'kRSUnicode'")
    code = F.conv(F.substring("code", 3, 8), 16, 10).cast("int")
    utf = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")
    return d.select(utf.alias("char"), F.regexp_extract("value", "^(\\d+)", 1).cast("int").alias("radical"))


def tex_keys(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (cite, ref, label), key of LaTeX files."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = [d.select("file", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(rf"\\{k}[a-z]*\{{([^}}]*)\}}"), F.lit(1))).alias("keys")) for k in ("cite", "ref", "label")]
    return union_of(parts).select("file", "kind", F.explode(F.split("keys", "\\s*,\\s*")).alias("key"))
