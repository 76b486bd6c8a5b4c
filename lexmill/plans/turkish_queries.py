"""Turkish noun analysis over the words of documents in Turkish letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..lexicon import turkish as L
from ..morph import turkish as M
from .derived import in_script, in_script_sql
from .registry import query

#: Occurrences from which a word is known.
LEAST = 5
_LETTERS = "[A-Za-zéèêçàùüöäßñóíá]+"
_COUNTS = f"tc AS (SELECT lower(translate({in_script_sql('w', 'tr')}, 'İI', 'iı')) AS w, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{_LETTERS}')) AS w FROM documents) GROUP BY 1)"


def turkish_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_LETTERS), F.lit(0))).alias("w"))
    return words.groupBy(T.tr_lower(in_script("w", "tr")).alias("w")).agg(F.count(F.lit(1)).alias("cnt"))


_rows = lambda d: ", ".join(f"('{k}', '{v}', false)" for k, v in d.items())
_HARDENED = "left(stem, length(stem) - 1) || translate(right(stem, 1), 'bcdğg', 'pçtkk')"
_V = f"[{L.VOWELS}]"


def _harmony(before: str, after: str) -> str:
    lv, sv = f"regexp_extract({before}, '({_V})[^{L.VOWELS}]*$', 1)", f"regexp_extract({after}, '({_V})', 1)"
    return f"({after} = '' OR ((instr('{L.BACK}', {lv}) > 0) = (instr('{L.BACK}', {sv}) > 0) AND (instr('{L.HIGH}', {sv}) = 0 OR (instr('{L.ROUNDED}', {lv}) > 0) = (instr('{L.ROUNDED}', {sv}) > 0))))"


_OPEN = lambda c: f"regexp_matches({c}, '{_V}$')"
_GEN, _NGEN = "('ın', 'in', 'un', 'ün')", "('nın', 'nin', 'nun', 'nün')"
_LONE = f"(cs IN {_GEN} AND ps = '' AND pl = '' AND NOT {_OPEN('stem')} AND right(stem, 1) NOT IN ('n', 'y'))"
TR_SQL = f"""WITH {_COUNTS},
e AS (SELECT pl, ps, cs, num, person, cv, implied, pl || ps || cs AS f
  FROM (VALUES ('', ''), ('lar', 'PL'), ('ler', 'PL')) a(pl, num), (VALUES ('', '', false), {_rows(L.POSSESSIVE)}, {", ".join(f"('{k}', '3SG', true)" for k in L.IMPLIED_3SG)}) b(ps, person, implied), (VALUES ('', '', false), {_rows(L.CASE)}) c(cs, cv, unused)
  WHERE pl || ps || cs <> '' AND NOT (person = '3PL' AND num = 'PL') AND NOT (implied AND left(cs, 1) <> 'n')),
k AS (SELECT w, left(w, length(w) - n) AS stem, right(w, n) AS f FROM (SELECT w, unnest(range(1, least(20, length(w) - 1))) AS n FROM tc WHERE length(w) > 2)),
j AS (SELECT w, stem, e.*, {_HARDENED} AS cand FROM k JOIN e USING (f) WHERE regexp_matches(stem, '{_V}') AND length(stem) >= 2 AND {_harmony('stem', 'pl')} AND {_harmony('stem || pl', 'ps')} AND {_harmony('stem || pl || ps', 'cs')}
  AND NOT (left(ps, 1) = 's' AND NOT {_OPEN('stem')}) AND NOT (left(cs, 1) = 'y' AND NOT CASE WHEN pl <> '' THEN {_OPEN('pl')} WHEN ps <> '' THEN {_OPEN('ps')} ELSE {_OPEN('stem')} END)
  AND NOT (left(cs, 1) = 'n' AND cs NOT IN {_NGEN} AND person <> '3SG') AND NOT (cs IN {_NGEN} AND NOT CASE WHEN ps <> '' THEN {_OPEN('ps')} WHEN pl <> '' THEN {_OPEN('pl')} ELSE {_OPEN('stem')} END)),
s AS (SELECT w, cand, pl, ps, cs, length(f) AS n, cv, CASE WHEN {_LONE} THEN '2SG' WHEN implied AND num = 'PL' THEN '3PL' ELSE person END AS p, num = 'PL' OR person = '3PL' AS plural,
    (person <> '')::INT * 100 + (cv <> '')::INT * 50 + (num <> '')::INT * 30 + length(f) + (implied AND num <> '')::INT * 60 - (person = '3PL')::INT * 50 - (cs IN ('la', 'le') AND {_OPEN('cand')})::INT * 40
    - (ps <> '' AND NOT implied AND left(cs, 1) IN ('y', 'n') AND stem <> cand)::INT * 200 + (NOT {_OPEN('cand')} AND stem = cand)::INT * 5 - (right(cand, 1) IN ('s', 'y', 'n') AND cand NOT IN ({", ".join(f"'{x}'" for x in L.OWN_LAST)}))::INT * 60
    + (implied AND cs IN ('nı', 'ni', 'nu', 'nü', 'na', 'ne') AND length(stem) >= 4)::INT * 50 - (implied AND pl = '' AND length(stem) < 4)::INT * 60 - (right(cand, 2) IN ('yl', 'nl'))::INT * 80 - (ps <> '' AND NOT implied AND stem <> cand AND right(stem, 1) IN ('d', 'g'))::INT * 80
    + (cs IN ('yla', 'yle') AND {_OPEN('cand')})::INT * 40 + {_LONE}::INT * 80 - (ps IN {_GEN} AND person = '2SG' AND cs = '' AND pl = '' AND NOT {_OPEN('stem')})::INT * 80
    + (cs IN {_NGEN} AND ps = '' AND pl = '' AND length(stem) >= 4 AND {_OPEN('stem')} AND NOT regexp_matches(stem, 's[ıiuü]$'))::INT * 120 AS score FROM j),
t AS (SELECT *, concat_ws('|', CASE WHEN cv <> '' THEN 'case=' || cv END, CASE WHEN plural THEN 'num=PL' END, CASE WHEN p <> '' THEN 'poss=' || p END) AS key, concat_ws('|', 'case=' || CASE WHEN cv <> '' THEN cv ELSE 'NOM' END, CASE WHEN plural THEN 'num=PL' END, CASE WHEN p <> '' THEN 'poss=' || p END) AS tags FROM s)
SELECT w, cand AS root, tags FROM t QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, n DESC, key DESC, pl DESC, ps DESC, cs DESC) = 1"""


@query("tr_nominal", TR_SQL)
def tr_nominal(spark, sf_dir):
    """Stem and tags of every word by the best reading of its ending."""
    return M.decompose(turkish_counts(spark, sf_dir).select("w"))


_TAILS = ", ".join(f"('{t}')" for t in sorted({e[0] for e in M.endings()}))


@query(
    "tr_longest_stem",
    f"WITH {_COUNTS}, known AS (SELECT w FROM tc WHERE cnt >= {LEAST}), tails AS (SELECT * FROM (VALUES {_TAILS}) t(tail)), k AS (SELECT w, left(w, n) AS stem, w[n + 1:] AS tail FROM (SELECT w, unnest(range(2, length(w))) AS n FROM tc WHERE length(w) > 2)), "
    f"f AS (SELECT w, length(stem) AS n, 1 AS whole, stem AS s, tail FROM k UNION ALL SELECT w, length(stem), 0, {_HARDENED}, tail FROM k WHERE {_HARDENED} <> stem) SELECT f.w, s AS stem, tail FROM f JOIN tails USING (tail) JOIN known ON known.w = s QUALIFY row_number() OVER (PARTITION BY f.w ORDER BY n DESC, whole DESC) = 1",
)
def tr_longest_stem(spark, sf_dir):
    """The longest known stem of every word, with its ending."""
    counts = turkish_counts(spark, sf_dir)
    return M.longest_stem(counts.select("w"), counts.where(F.col("cnt") >= LEAST).select("w"))
