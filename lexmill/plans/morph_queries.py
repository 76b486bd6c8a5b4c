"""Hebrew, Mandarin, Turkish and Arabic rules as column expressions, on words of documents in these scripts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .derived import letters_in, letters_in_sql, words_in, words_in_sql
from .registry import query

def he_binyan_expr(stem: Column) -> Column:
    """The verb pattern from an unpointed surface: the most distinctive prefixes first, PAAL by default. PUAL and the second NIFAL form stand behind wider rules that always take their words first."""
    s = F.when((F.length(stem) > 3) & stem.startswith("ל"), F.substr(stem, F.lit(2))).otherwise(stem)
    n = F.length(s)
    pre = lambda *ps: s.rlike("^(" + "|".join(ps) + ")")
    return (
        F.when(pre("הת", "מת", "השת", "הצט", "הזד", "הסת") | (pre("נת") & (n >= 4)), "HITPAEL")
        .when(pre("הו", "מו"), "HUFAL")
        .when(s.rlike("^ה.*י") | s.rlike("^מ..*י"), "HIFIL")
        .when(s.rlike("^נ[^אהוי]") & (n >= 3), "NIFAL")
        .when(pre("הי") & (n >= 4), "NIFAL")
        .when(pre("מו") & (n >= 3), "PUAL")
        .when(pre("מ"), "PIEL")
        .otherwise("PAAL")
    )


_HE = "CASE WHEN length(w) > 3 AND w[1] = 'ל' THEN w[2:] ELSE w END"


@query(
    "he_binyan",
    f"SELECT w, CASE WHEN s[1:2] IN ('הת', 'מת') OR s[1:3] IN ('השת', 'הצט', 'הזד', 'הסת') OR (s[1:2] = 'נת' AND length(s) >= 4) THEN 'HITPAEL' WHEN s[1:2] IN ('הו', 'מו') THEN 'HUFAL' WHEN (s[1] = 'ה' AND instr(s[2:], 'י') > 0) OR (s[1] = 'מ' AND instr(s[3:], 'י') > 0) THEN 'HIFIL' "
    f"WHEN length(s) >= 3 AND s[1] = 'נ' AND s[2] NOT IN ('א', 'ה', 'ו', 'י') THEN 'NIFAL' WHEN s[1] = 'מ' THEN 'PIEL' ELSE 'PAAL' END AS binyan FROM (SELECT w, {_HE} AS s FROM {words_in_sql('he')})",
)
def he_binyan(spark, sf_dir):
    return words_in(spark, sf_dir, "he").select("w", he_binyan_expr(F.col("w")).alias("binyan"))


@query("he_nominal", f"SELECT w, CASE WHEN w LIKE '%יים' THEN 'DU' WHEN w LIKE '%ים' OR w LIKE '%ות' THEN 'PL' ELSE 'SG' END AS num, CASE WHEN w LIKE '%יים' THEN NULL WHEN w LIKE '%ים' THEN 'M' WHEN w LIKE '%ה' OR w LIKE '%ת' THEN 'F' ELSE 'M' END AS gender FROM {words_in_sql('he')}")
def he_nominal(spark, sf_dir):
    w = F.col("w")
    num = F.when(w.endswith("יים"), "DU").when(w.endswith("ים") | w.endswith("ות"), "PL").otherwise("SG")
    return words_in(spark, sf_dir, "he").select("w", num.alias("num"), F.when(w.endswith("יים"), None).when(w.endswith("ים"), "M").when(w.endswith("ה") | w.endswith("ת"), "F").otherwise("M").alias("gender"))


# Endings of the past with person, number and gender, in order.
HE_PAST = [("תי", "1", "SG", ""), ("נו", "1", "PL", ""), ("תם", "2", "PL", "M"), ("תן", "2", "PL", "F"), ("ת", "2", "SG", ""), ("ו", "3", "PL", ""), ("ה", "3", "SG", "F")]
# Prefixes of the future with person and number.
HE_FUTURE = [("א", "1", "SG"), ("נ", "1", "PL"), ("ת", "2", ""), ("י", "3", "")]


def he_verb_expr(w: Column) -> Column:
    """tense:person:number:gender of an unpointed verb: infinitive, future by its prefix, past by its ending."""
    n = F.length(w)
    out = F.when(w.startswith("ל") & (n >= 3), "INF:::")
    for p, person, num in HE_FUTURE:
        future = F.when(w.endswith("ו"), f"FUT:{person}:PL:").when(w.endswith("נה"), f"FUT:{person}:PL:F").otherwise(f"FUT:{person}:{num}:")
        out = out.when(w.startswith(p) & (n >= 4), future)
    for e, person, num, gender in HE_PAST:
        out = out.when(w.endswith(e) & (n >= len(e) + 2), f"PAST:{person}:{num}:{gender}")
    return out.otherwise("PAST:3:SG:M")


_HE_FUT_SQL = " ".join(f"WHEN w[1] = '{p}' AND length(w) >= 4 THEN CASE WHEN ends_with(w, 'ו') THEN 'FUT:{person}:PL:' WHEN ends_with(w, 'נה') THEN 'FUT:{person}:PL:F' ELSE 'FUT:{person}:{num}:' END" for p, person, num in HE_FUTURE)
_HE_PAST_SQL = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) >= {len(e) + 2} THEN 'PAST:{person}:{num}:{gender}'" for e, person, num, gender in HE_PAST)


HE_VERB_SQL = f"CASE WHEN w[1] = 'ל' AND length(w) >= 3 THEN 'INF:::' {_HE_FUT_SQL} {_HE_PAST_SQL} ELSE 'PAST:3:SG:M' END"


@query("he_verb", f"SELECT w, {HE_VERB_SQL} AS tags FROM {words_in_sql('he')}")
def he_verb(spark, sf_dir):
    return words_in(spark, sf_dir, "he").select("w", he_verb_expr(F.col("w")).alias("tags"))


# Endings taken off before the root's letters are read, in order.
HE_ENDINGS = ["יים", "ות", "ים", "תי", "נו", "תם", "תן", "ית", "ה", "ת", "ו", "י", "ם", "ן"]


def he_root_expr(stem: Column, binyan: Column) -> Column:
    """The root's letters: the pattern's prefix, one ending and the vowel letters go, if enough is left."""
    s = F.when(binyan == "HITPAEL", F.regexp_replace(stem, "^(הת|מת|השת|הצט|הזד|הסת)", "")).when(binyan.isin("HIFIL", "HUFAL"), F.regexp_replace(stem, "^[המ]", "")).when(binyan == "NIFAL", F.regexp_replace(stem, "^נ", "")).when(binyan.isin("PUAL", "PIEL"), F.regexp_replace(stem, "^מ", "")).otherwise(stem)
    s = F.regexp_replace(s, "^(..+?)(" + "|".join(HE_ENDINGS) + ")$", "$1")
    core = F.regexp_replace(s, "[אהוי]", "")
    return F.when(F.length(core) >= 2, core).otherwise(s)


HE_BINYAN_SQL = "CASE WHEN s[1:2] IN ('הת', 'מת') OR s[1:3] IN ('השת', 'הצט', 'הזד', 'הסת') OR (s[1:2] = 'נת' AND length(s) >= 4) THEN 'HITPAEL' WHEN s[1:2] IN ('הו', 'מו') THEN 'HUFAL' WHEN (s[1] = 'ה' AND instr(s[2:], 'י') > 0) OR (s[1] = 'מ' AND instr(s[3:], 'י') > 0) THEN 'HIFIL' WHEN length(s) >= 3 AND s[1] = 'נ' AND s[2] NOT IN ('א', 'ה', 'ו', 'י') THEN 'NIFAL' WHEN s[1] = 'מ' THEN 'PIEL' ELSE 'PAAL' END"
_HE_BINYAN = f"(SELECT w, {HE_BINYAN_SQL} AS binyan FROM (SELECT w, {_HE} AS s FROM {words_in_sql('he')}))"
HE_BARE_SQL = "CASE binyan WHEN 'HITPAEL' THEN regexp_replace(w, '^(הת|מת|השת|הצט|הזד|הסת)', '') WHEN 'HIFIL' THEN regexp_replace(w, '^[המ]', '') WHEN 'HUFAL' THEN regexp_replace(w, '^[המ]', '') WHEN 'NIFAL' THEN regexp_replace(w, '^נ', '') WHEN 'PIEL' THEN regexp_replace(w, '^מ', '') ELSE w END"
HE_ENDLESS_SQL = "CASE " + " ".join(f"WHEN ends_with(b, '{e}') AND length(b) >= {len(e) + 2} THEN left(b, length(b) - {len(e)})" for e in sorted(HE_ENDINGS, key=len, reverse=True)) + " ELSE b END"


@query("he_root", f"SELECT w, binyan, CASE WHEN length(regexp_replace(e, '[אהוי]', '', 'g')) >= 2 THEN regexp_replace(e, '[אהוי]', '', 'g') ELSE e END AS root FROM (SELECT w, binyan, {HE_ENDLESS_SQL} AS e FROM (SELECT w, binyan, {HE_BARE_SQL} AS b FROM {_HE_BINYAN}))")
def he_root(spark, sf_dir):
    return words_in(spark, sf_dir, "he").select("w", he_binyan_expr(F.col("w")).alias("binyan")).select("w", "binyan", he_root_expr(F.col("w"), F.col("binyan")).alias("root"))


#: Words of up to three letters for the Mandarin rules: the letters of the items in threes, twos and ones.
_ZH_WORDS = f"(SELECT sent, pos // 3 AS pos, string_agg(w, '' ORDER BY pos)[:1 + pos // 3 % 3] AS w FROM {letters_in_sql('zh')} GROUP BY sent, pos // 3)"


def zh_words(spark, sf_dir):
    g = letters_in(spark, sf_dir, "zh").groupBy("sent", F.expr("pos div 3").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), "").alias("t"))
    return g.select("sent", F.col("k").alias("pos"), F.substr("t", F.lit(1), (1 + F.col("k") % 3).cast("int")).alias("w"))


@query("zh_inflection", f"SELECT sent, pos, w, CASE WHEN length(w) >= 2 AND w LIKE '%们' THEN 'num=PL' WHEN length(w) >= 2 AND w LIKE '%了' THEN 'aspect=PERF' WHEN length(w) >= 2 AND w LIKE '%着' THEN 'aspect=DUR' WHEN length(w) >= 2 AND w LIKE '%过' THEN 'aspect=EXP' WHEN length(w) >= 2 AND w LIKE '第%' THEN 'role=ORDINAL' WHEN length(w) = 2 AND w[1] = w[2] THEN 'redup' ELSE '' END AS tag FROM {_ZH_WORDS}")
def zh_inflection(spark, sf_dir):
    w, long = F.col("w"), F.length("w") >= 2
    tag = F.when(long & w.endswith("们"), "num=PL").when(long & w.endswith("了"), "aspect=PERF").when(long & w.endswith("着"), "aspect=DUR").when(long & w.endswith("过"), "aspect=EXP").when(long & w.startswith("第"), "role=ORDINAL").when((F.length(w) == 2) & (F.left(w, F.lit(1)) == F.right(w, F.lit(1))), "redup").otherwise("")
    return zh_words(spark, sf_dir).select("sent", "pos", "w", tag.alias("tag"))


@query(
    "zh_disambiguate",
    "SELECT sent, pos, w, CASE WHEN w = '只' THEN CASE WHEN prev IN ('一', '两', '三', '几') THEN 'CLF' ELSE 'ADV' END WHEN w = '把' THEN CASE WHEN prev IN ('一', '两', '三', '几') THEN 'CLF' ELSE 'ADP' END WHEN w = '在' THEN CASE WHEN next IN ('学习', '吃', '看', '读') THEN 'ADV' ELSE 'ADP' END ELSE 'X' END AS reading "
    f"FROM (SELECT *, lag(w) OVER (PARTITION BY sent ORDER BY pos) AS prev, lead(w) OVER (PARTITION BY sent ORDER BY pos) AS next FROM {letters_in_sql('zh')})",
)
def zh_disambiguate(spark, sf_dir):
    """Readings by the neighbours' surfaces, which no rule rewrites, so a window is as good as a fold."""
    o = Window.partitionBy("sent").orderBy("pos")
    r = letters_in(spark, sf_dir, "zh").withColumn("prev", F.lag("w").over(o)).withColumn("next", F.lead("w").over(o))
    counted = F.coalesce(F.col("prev").isin("一", "两", "三", "几"), F.lit(False))
    act = F.coalesce(F.col("next").isin("学习", "吃", "看", "读"), F.lit(False))
    x = F.when(F.col("w") == "只", F.when(counted, "CLF").otherwise("ADV")).when(F.col("w") == "把", F.when(counted, "CLF").otherwise("ADP")).when(F.col("w") == "在", F.when(act, "ADV").otherwise("ADP")).otherwise("X")
    return r.select("sent", "pos", "w", x.alias("reading"))


#: A word's last three letters stand for a suffix.
_HARMONY = f"(SELECT left(w, length(w) - 3) AS stem, right(w, 3) AS suffix FROM {words_in_sql('tr')} WHERE length(w) > 4)"
#: Vowel classes of Turkish.
BACK, ROUNDED, HIGH, VOWELS = "aıou", "oöuü", "ıiuü", "aıoueiöü"
@query(
    "vowel_harmony",
    f"SELECT stem, suffix, CASE WHEN lv = '' OR sv = '' THEN true WHEN (instr('{BACK}', lv) > 0) <> (instr('{BACK}', sv) > 0) THEN false WHEN instr('{HIGH}', sv) > 0 AND (instr('{ROUNDED}', lv) > 0) <> (instr('{ROUNDED}', sv) > 0) THEN false ELSE true END AS ok "
    f"FROM (SELECT stem, suffix, regexp_extract(stem, '([{VOWELS}])[^{VOWELS}]*$', 1) AS lv, regexp_extract(suffix, '^[^{VOWELS}]*([{VOWELS}])', 1) AS sv FROM {_HARMONY})",
)
def vowel_harmony(spark, sf_dir):
    lv, sv = F.regexp_extract("stem", f"([{VOWELS}])[^{VOWELS}]*$", 1), F.regexp_extract("suffix", f"^[^{VOWELS}]*([{VOWELS}])", 1)
    r = words_in(spark, sf_dir, "tr").where("length(w) > 4").selectExpr("left(w, length(w) - 3) AS stem", "right(w, 3) AS suffix").select("stem", "suffix", lv.alias("lv"), sv.alias("sv"))
    among = lambda cls, c: F.instr(F.lit(cls), F.col(c)) > 0
    ok = F.when((F.col("lv") == "") | (F.col("sv") == ""), True).when(among(BACK, "lv") != among(BACK, "sv"), False).when(among(HIGH, "sv") & (among(ROUNDED, "lv") != among(ROUNDED, "sv")), False).otherwise(True)
    return r.select("stem", "suffix", ok.alias("ok"))


@query("consonant_unmutation", f"SELECT w, w AS candidate FROM {words_in_sql('tr')} UNION ALL SELECT w, substr(w, 1, length(w) - 1) || translate(right(w, 1), 'bcdğg', 'pçtkk') FROM {words_in_sql('tr')} WHERE right(w, 1) IN ('b', 'c', 'd', 'ğ', 'g')")
def consonant_unmutation(spark, sf_dir):
    w = F.col("w")
    hard = F.concat(F.substr(w, F.lit(1), F.length(w) - 1), F.translate(F.right(w, F.lit(1)), "bcdğg", "pçtkk"))
    return words_in(spark, sf_dir, "tr").select("w", F.explode(F.when(w.rlike("[bcdğg]$"), F.array(w, hard)).otherwise(F.array(w))).alias("candidate"))


#: Arabic consonants, for the vowels that follow the first two.
AR_CONSONANTS = "ءأإآؤئابتثجحخدذرزسشصضطظعغفقكلمنهوي"
@query("ar_passive", f"SELECT w, regexp_matches(w, '^[^{AR_CONSONANTS}]*[{AR_CONSONANTS}]\\x{{064F}}[^{AR_CONSONANTS}]*[{AR_CONSONANTS}]\\x{{0650}}') AS passive FROM {words_in_sql('ar')}")
def ar_passive(spark, sf_dir):
    """Damma on the first and kasra on the second consonant."""
    p = f"^[^{AR_CONSONANTS}]*[{AR_CONSONANTS}]\\x{{064F}}[^{AR_CONSONANTS}]*[{AR_CONSONANTS}]\\x{{0650}}"
    return words_in(spark, sf_dir, "ar").select("w", F.col("w").rlike(p).alias("passive"))


@query("ar_agreement", f"SELECT w, CASE WHEN w LIKE '%ات' THEN 'F PL' WHEN w LIKE '%ة' THEN 'F SG' ELSE 'M SG' END AS agreement FROM {words_in_sql('ar')}")
def ar_agreement(spark, sf_dir):
    w = F.col("w")
    return words_in(spark, sf_dir, "ar").select("w", F.when(w.endswith("ات"), "F PL").when(w.endswith("ة"), "F SG").otherwise("M SG").alias("agreement"))


#: Skeletons are words of two or three letters; the set of roots is made of those with three.
@query(
    "weak_root_candidates",
    f"WITH s AS (SELECT w FROM {words_in_sql('ar')} WHERE length(w) IN (2, 3)), r AS (SELECT w AS root FROM {words_in_sql('ar')} WHERE length(w) = 3), c AS (SELECT w, 0 AS p, w AS cand FROM s WHERE length(w) = 3 UNION ALL SELECT w, 1, w || right(w, 1) FROM s WHERE length(w) = 2 UNION ALL SELECT w, 2, 'و' || w FROM s WHERE length(w) = 2 UNION ALL SELECT w, 3, w[1] || 'و' || w[2] FROM s WHERE length(w) = 2 UNION ALL SELECT w, 4, w[1] || 'ي' || w[2] FROM s WHERE length(w) = 2) "
    "SELECT w, arg_min(cand, p) AS root FROM c WHERE cand IN (SELECT root FROM r) GROUP BY w",
)
def weak_root_candidates(spark, sf_dir):
    """Candidates in order, kept if the injected set of roots has them; the first one wins."""
    w = F.col("w")
    first, last = F.left(w, F.lit(1)), F.right(w, F.lit(1))
    cands = F.when(F.length(w) == 3, F.array(F.struct(F.lit(0).alias("p"), w.alias("cand")))).otherwise(F.array(*[F.struct(F.lit(p).alias("p"), c.alias("cand")) for p, c in ((1, F.concat(w, last)), (2, F.concat(F.lit("و"), w)), (3, F.concat(first, F.lit("و"), last)), (4, F.concat(first, F.lit("ي"), last)))]))
    words = words_in(spark, sf_dir, "ar")
    c = words.where("length(w) in (2, 3)").select("w", F.explode(cands).alias("c")).select("w", "c.p", "c.cand")
    known = c.join(words.where("length(w) = 3").select(F.col("w").alias("root")), F.col("cand") == F.col("root"), "left_semi")
    return known.groupBy("w").agg(F.min_by("cand", "p").alias("root"))
