"""The whole record of a Hebrew word: part of speech, root, skeleton, clitics, tags with the verb pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import hebrew
from .derived import words_in, words_in_sql
from .eval_queries import HE_PRE_SQL, HE_STEM_SQL, HE_VERBAL_SQL, he_pos, he_proclitics
from .morph_queries import HE_BARE_SQL, HE_BINYAN_SQL, HE_ENDLESS_SQL, HE_VERB_SQL, he_binyan_expr, he_root_expr, he_verb_expr
from .registry import query

#: Whether a noun's front shows a verb pattern, behind a first lamed.
SIGNATURE = "^(הת|מת|הו|מו|השת|הצט|הזד|הסת)|^[המנ]..+"
_PRONOUN_TAGS = {w: "|".join(f"{k}={v}" for k, v in sorted(tags.items())) for w, tags in hebrew.PRONOUNS.items()}


def _pronoun(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in _PRONOUN_TAGS.items() for x in kv)), c)


def _tags(**parts: Column) -> Column:
    """k=v joined by |, keys in order, empty and null values left out."""
    return F.concat_ws("|", *(F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in sorted(parts.items())))


def record(words: DataFrame) -> DataFrame:
    """w, pos, root, template, clitics, tags of the words w. Words without a Hebrew letter are numbers, marks or X; words of closed classes keep their form."""
    naked = F.regexp_replace(T.strip_niqqud("w"), "[׳״]", "")
    x = words.select("w", naked.alias("n"))
    stem, pre = he_proclitics(F.col("n"))
    x = x.select("w", "n", stem.alias("s"), pre.alias("pre")).withColumn("pos", he_pos(F.col("n"), F.col("s")))
    heb = F.col("n").rlike("[א-ת]")
    whole = heb & F.col("n").isin([w for ws in (hebrew.PRONOUNS, *hebrew.CLASSES.values()) for w in ws])
    x = x.withColumns({"heb": heb, "whole": whole})
    x = x.withColumn("inner", ~F.col("whole") & F.col("heb") & F.col("s").isin(list(hebrew.PRONOUNS)))
    x = x.withColumn("open", F.col("heb") & ~F.col("whole") & ~F.col("inner")).withColumn("verb", F.col("open") & (F.col("pos") == "VERB"))
    bare = F.when((F.length("s") > 3) & F.col("s").startswith("ל"), F.expr("substr(s, 2)")).otherwise(F.col("s"))
    x = x.withColumn("binyan", F.when(F.col("open") & (F.col("verb") | bare.rlike(SIGNATURE)), he_binyan_expr(F.col("s"))).otherwise(""))
    x = x.withColumn("t", F.split(he_verb_expr(F.col("s")), ":"))
    s = F.col("s")
    lamed = F.when(F.col("verb") & s.startswith("ל") & (F.length(s) > 3), F.expr("substr(s, 2)")).otherwise(s)
    root = he_root_expr(lamed, F.col("binyan"))
    x = x.withColumn("root", F.when(F.col("open"), root).when(F.col("inner"), s).otherwise(F.col("n")))
    num = F.when(s.endswith("יים"), "DU").when(s.endswith("ים") | s.endswith("ות"), "PL").otherwise("SG")
    gender = F.when(s.endswith("יים"), "").when(s.endswith("ים"), "M").when(s.endswith("ה") | s.endswith("ת"), "F").otherwise("M")
    t = F.col("t")
    verb_tags = _tags(tense=F.when(t[0] != "INF", t[0]).otherwise(""), verbform=F.when(t[0] == "INF", "INF").otherwise(""), person=t[1], num=t[2], gender=t[3], binyan=F.col("binyan"))
    noun_tags = _tags(num=num, gender=gender, binyan=F.col("binyan"))
    masked = F.array_join(F.transform(F.split("s", ""), lambda c: F.when((c != "") & (F.instr(T.normalize_finals(F.col("root")), T.normalize_finals(c)) > 0), "_").otherwise(c)), "")
    return x.select(
        "w", "pos", "root",
        F.when(F.col("open"), masked).when(F.col("whole") | F.col("inner"), "CLOSED_CLASS").when(F.col("pos") == "NUM", "NUM").otherwise("").alias("template"),
        F.when(F.col("open") | F.col("inner"), F.col("pre")).otherwise("").alias("clitics"),
        F.when(F.col("verb"), verb_tags).when(F.col("open"), noun_tags).otherwise(F.coalesce(_pronoun(F.when(F.col("whole"), F.col("n")).when(F.col("inner"), s)), F.lit(""))).alias("tags"),
    )


_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_CLOSED = f"WHEN n IN ({_LIST(hebrew.PRONOUNS)}) THEN 'PRON' " + " ".join(f"WHEN n IN ({_LIST(ws)}) THEN '{k}'" for k, ws in hebrew.CLASSES.items())
_WHOLE = f"n IN ({_LIST([w for ws in (hebrew.PRONOUNS, *hebrew.CLASSES.values()) for w in ws])})"
_PRON_SQL = lambda c: f"coalesce(CASE {c} " + " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in _PRONOUN_TAGS.items()) + " END, '')"
_TAG = lambda k, v: f"CASE WHEN {v} <> '' THEN '{k}=' || {v} END"
_NIQQUD = "[\\x{0591}-\\x{05BD}\\x{05BF}\\x{05C1}\\x{05C2}\\x{05C4}\\x{05C5}\\x{05C7}\\x{05BE}׳״]"
HE_SQL = f"""
WITH n0 AS (SELECT w, regexp_replace(w, '{_NIQQUD}', '', 'g') AS n FROM {words_in_sql('he')}),
n1 AS (SELECT w, n, {HE_PRE_SQL.replace('length(w)', 'length(n)').replace('w[', 'n[').replace('ELSE w', 'ELSE n')} AS a FROM n0),
n2 AS (SELECT w, n, a, {HE_STEM_SQL} AS s, regexp_matches(n, '[א-ת]') AS heb FROM n1),
n3 AS (SELECT *, CASE WHEN NOT heb THEN CASE WHEN regexp_matches(n, '[0-9]') THEN 'NUM' WHEN regexp_matches(n, '^[^\\p{{L}}\\p{{N}}]+$') THEN 'PUNCT' ELSE 'X' END {_CLOSED} WHEN s IN ({_LIST(hebrew.PRONOUNS)}) THEN 'PRON' WHEN {HE_VERBAL_SQL} THEN 'VERB' ELSE 'NOUN' END AS pos,
  heb AND {_WHOLE} AS whole, heb AND NOT {_WHOLE} AND s IN ({_LIST(hebrew.PRONOUNS)}) AS inside, concat_ws('+', CASE WHEN a <> n THEN 'W' END, CASE WHEN length(a) > 2 AND a[1:2] = 'כש' THEN 'KESHE' WHEN length(a) > 3 AND a[1] = 'ש' THEN 'SHE' END) AS pre FROM n2),
n4 AS (SELECT *, heb AND NOT whole AND NOT inside AS op, CASE WHEN length(s) > 3 AND s[1] = 'ל' THEN s[2:] ELSE s END AS bare FROM n3),
n5 AS (SELECT *, CASE WHEN op AND (pos = 'VERB' OR regexp_matches(bare, '{SIGNATURE}')) THEN {HE_BINYAN_SQL.replace('s[', 'bare[').replace('length(s)', 'length(bare)').replace('instr(s', 'instr(bare')} ELSE '' END AS binyan, {HE_VERB_SQL.replace('length(w)', 'length(s)').replace('w[', 's[').replace('ends_with(w', 'ends_with(s')} AS vt,
  CASE WHEN pos = 'VERB' AND op AND s[1] = 'ל' AND length(s) > 3 THEN s[2:] ELSE s END AS lam FROM n4),
n6 AS (SELECT *, {HE_ENDLESS_SQL} AS e FROM (SELECT *, {HE_BARE_SQL.replace('(w,', '(lam,').replace('ELSE w', 'ELSE lam')} AS b FROM n5)),
n7 AS (SELECT *, CASE WHEN op THEN CASE WHEN length(regexp_replace(e, '[אהוי]', '', 'g')) >= 2 THEN regexp_replace(e, '[אהוי]', '', 'g') ELSE e END WHEN inside THEN s ELSE n END AS root, string_split(vt, ':') AS t FROM n6)
SELECT w, pos, root,
  CASE WHEN op THEN coalesce(list_aggregate(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: CASE WHEN instr(translate(root, 'ךםןףץ', 'כמנפצ'), translate(c, 'ךםןףץ', 'כמנפצ')) > 0 THEN '_' ELSE c END), 'string_agg', ''), '') WHEN whole OR inside THEN 'CLOSED_CLASS' WHEN pos = 'NUM' THEN 'NUM' ELSE '' END AS template,
  CASE WHEN op OR inside THEN pre ELSE '' END AS clitics,
  CASE WHEN op AND pos = 'VERB' THEN concat_ws('|', {_TAG('binyan', 'binyan')}, {_TAG('gender', 't[4]')}, {_TAG('num', 't[3]')}, {_TAG('person', 't[2]')}, CASE WHEN t[1] <> 'INF' THEN 'tense=' || t[1] END, CASE WHEN t[1] = 'INF' THEN 'verbform=INF' END)
    WHEN op THEN concat_ws('|', {_TAG('binyan', 'binyan')}, CASE WHEN s LIKE '%יים' THEN NULL WHEN s LIKE '%ים' THEN 'gender=M' WHEN s LIKE '%ה' OR s LIKE '%ת' THEN 'gender=F' ELSE 'gender=M' END, CASE WHEN s LIKE '%יים' THEN 'num=DU' WHEN s LIKE '%ים' OR s LIKE '%ות' THEN 'num=PL' ELSE 'num=SG' END)
    WHEN whole THEN {_PRON_SQL('n')} WHEN inside THEN {_PRON_SQL('s')} ELSE '' END AS tags
FROM n7"""


@query("he_analyze", HE_SQL)
def he_analyze(spark, sf_dir):
    """The record of every word of documents in Hebrew letters."""
    return record(words_in(spark, sf_dir, "he"))
