"""Words and texts of the given tables in other scripts, for rules of languages that the tables lack.

Letters are replaced one by one, so whatever stands in the tables runs through the rules, and their work grows with it. The
letters for accents bring in what the rules look for: vowel marks, final forms, carriers of hamza, dotless vowels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table

_FROM = "abcdefghijklmnopqrstuvwxyzéèêçàùüöäßñóíá"
#: By script, what stands for each letter above; none is left out, so lengths stay.
LETTERS = {
    "he": "אבקדהפגחיזקלמנופקרשתוושצהזָךםןףץיםןתסעט־",
    "ar": "ابكدِفجحيزقلمنُبقرستوفوصيزةََأإؤئّٰعغآىه",
    "tr": "abcdefghijklmnopçrstuvşxyzğşıçığüöışçİıâ",
    "zh": "我把猫的了书过着一只看们马你在第几人是他不学文习有子两三吃读说家里大小上下好河林",
}
assert all(len(x) == len(_FROM) for x in LETTERS.values())
_UPPER = {"tr": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPÇRSTUVŞXYZ")}


def in_script(c: str | Column, script: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    if script == "latin":
        return c
    if script in _UPPER:
        return F.translate(F.translate(c, *_UPPER[script]), _FROM, LETTERS[script])
    return F.translate(F.lower(c), _FROM, LETTERS[script])


def in_script_sql(c: str, script: str) -> str:
    if script == "latin":
        return c
    if script in _UPPER:
        a, b = _UPPER[script]
        return f"translate(translate({c}, '{a}', '{b}'), '{_FROM}', '{LETTERS[script]}')"
    return f"translate(lower({c}), '{_FROM}', '{LETTERS[script]}')"


_WORD = "[A-Za-zéèêçàùüöäßñóíá]+"


def word_rows(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    """w: the words of documents, each as often as it stands there, in another script."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("w"))
    return words.select(in_script("w", script).alias("w"))


def words_in(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    """w: the distinct words of documents, in another script."""
    return word_rows(spark, sf_dir, script).distinct()


def words_in_sql(script: str) -> str:
    return f"(SELECT DISTINCT {in_script_sql('w', script)} AS w FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM documents)) AS t(w)"


def texts_in(spark: SparkSession, sf_dir: str, script: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """id, t: the texts of a table, in another script."""
    return table(spark, sf_dir, name).where("text is not null").select(F.col(key).alias("id"), in_script("text", script).alias("t"))


def texts_in_sql(script: str, name: str = "documents", key: str = "doc_id") -> str:
    return f"(SELECT {key} AS id, {in_script_sql('text', script)} AS t FROM {name} WHERE text IS NOT NULL) AS t(id, t)"


def letters_in(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    """sent, pos, w: the letters of each benchmark item one after another, in another script."""
    t = texts_in(spark, sf_dir, script, "benchmark", "item_id")
    return t.select(F.col("id").alias("sent"), F.posexplode(F.regexp_extract_all("t", F.lit("\\S"), F.lit(0))).alias("pos", "w")).withColumn("pos", F.col("pos").cast("long"))


def letters_in_sql(script: str) -> str:
    return f"(SELECT id AS sent, unnest(range(0, len(l))) AS pos, unnest(l) AS w FROM (SELECT id, regexp_extract_all(t, '\\S') AS l FROM {texts_in_sql(script, 'benchmark', 'item_id')})) AS t(sent, pos, w)"
