"""The shallow segmenter: root and suffix tag by the first listed affix that leaves enough, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edge_stripped
from ..lexicon.affixes import AR_PREFIXES, AR_SUFFIXES, EN_SUFFIXES, TR_SUFFIXES


def _first_suffix(w: Column, suffixes: list[str], least: int) -> Column:
    """The first listed suffix that leaves `least` characters, or null."""
    out = None
    for s in dict.fromkeys(suffixes):
        fits = w.endswith(s) & (F.length(w) >= len(s) + least)
        out = F.when(fits, s) if out is None else out.when(fits, s)
    return out


def _without(w: Column, suffix: Column) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - F.length(suffix))


def segment(word: str | Column, lang: str = "en") -> Column:
    """struct<root, tag> of a word in en, tr or ar; other languages keep the word as ROOT. A word of edge marks only has tag O."""
    w = edge_stripped(word)
    if lang in ("en", "tr"):
        s = _first_suffix(w, EN_SUFFIXES if lang == "en" else TR_SUFFIXES, 2)
        root, tag = F.coalesce(_without(w, s), w), F.coalesce(F.concat(F.lit("SUF_"), s), F.lit("ROOT"))
    elif lang == "ar":
        p = None
        for x in AR_PREFIXES:
            fits = w.startswith(x) & (F.length(w) >= len(x) + 2)
            p = F.when(fits, x) if p is None else p.when(fits, x)
        stem = F.coalesce(F.substr(w, F.length(p) + 1), w)
        s = _first_suffix(stem, AR_SUFFIXES, 1)
        root = F.coalesce(_without(stem, s), stem)
        tag = F.coalesce(F.concat_ws("_", F.concat(F.lit("PRE_"), p), F.concat(F.lit("SUF_"), s)), F.lit(""))
        tag = F.when(tag == "", "ROOT").otherwise(tag)
    else:
        root, tag = w, F.lit("ROOT")
    return F.struct(root.alias("root"), F.when(w == "", "O").otherwise(tag).alias("tag"))


def with_segments(df: DataFrame, word: str) -> DataFrame:
    """df with root and tag of an English word column, one step a projection, so the suffix is looked for once a row."""
    x = df.withColumn("_w", edge_stripped(word))
    x = x.withColumn("_s", _first_suffix(F.col("_w"), EN_SUFFIXES, 2))
    tag = F.when(F.col("_w") == "", "O").otherwise(F.coalesce(F.concat(F.lit("SUF_"), F.col("_s")), F.lit("ROOT")))
    return x.select(*df.columns, F.coalesce(_without(F.col("_w"), F.col("_s")), F.col("_w")).alias("root"), tag.alias("tag"))


def segment_sql(w: str, suffixes: list[str] = EN_SUFFIXES) -> str:
    """A DuckDB expression for the chosen suffix of w, generated from the same list."""
    cases = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 2} THEN '{s}'" for s in dict.fromkeys(suffixes))
    return f"CASE {cases} END"
