"""The English word analysis over the words of documents. The lexicon of real words is made of the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..functions.text import strip_punct
from ..lexicon import english_words as E
from ..morph import english as M
from .registry import query
from .text_queries import tok_sql, tokens

#: Occurrences from which a word of letters is a real word.
LEAST = 3
LEXICON = M.Lexicon(irregular={"went": ("go", "VERB", "tense=PAST"), "children": ("child", "NOUN", "num=PL"), "thought": ("think", "VERB", "tense=PAST"), "seen": ("see", "VERB", "aspect=PERF")})


def word_counts(spark, sf_dir) -> DataFrame:
    """w, cnt of English words in lower case without marks at their edges: a written table, as an analysis reads it at every step. Words are counted as they stand first, and each distinct one is stripped once."""
    raw = tokens(spark, sf_dir, "en").groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))
    counts = raw.select(F.lower(strip_punct("w")).alias("w"), "cnt").where("w <> ''").groupBy("w").agg(F.sum("cnt").alias("cnt"))
    return Steps(spark, "words").write(counts)[1]


def known_words(counts: DataFrame, least: int = LEAST) -> DataFrame:
    return counts.where((F.col("cnt") >= least) & F.col("w").rlike("^\\p{L}+$")).select("w")


# The same rules in SQL ------------------------------------------------------

_RULES = M.Rules(LEXICON)
_in = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
_pairs = lambda d: "(VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in (k, *(v if isinstance(v, tuple) else (v,)))) + ")" for k, v in d.items()) + ")"
_VERBISH = _in([*E.VERBS, *_RULES.forms])
_ADJ, _NOUN, _VERB = _in(E.ADJECTIVES), _in(E.NOUNS), _in(E.VERBS)
_FORM_VERBS = {k: v[0] for k, v in _RULES.forms.items() if v[1] == "VERB"}
_gloss = lambda c, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
_prefix = lambda c: f"CASE WHEN {c} IN {_in(E.NO_PREFIX)} THEN NULL " + " ".join(f"WHEN starts_with({c}, '{p}') AND length({c}) >= {len(p) + 3} THEN '{p}'" for p in M.PREFIXES) + " END"
_base_pos = lambda c: f"CASE WHEN {c} IN {_VERB} THEN 'VERB' WHEN {c} IN {_ADJ} THEN 'ADJ' WHEN {c} IN {_NOUN} THEN 'NOUN' ELSE coalesce({_gloss(c, {k: v[1] for k, v in _RULES.forms.items()})}, 'UNKNOWN') END"
_without = lambda c, n: f"left({c}, greatest(length({c}) - {n}, 0))"
_SUFS = "(VALUES " + ", ".join(f"('{s}', {i}, {2 if s in ('able', 'ible') else 3}, '{E.SUFFIX_GLOSS.get(s, 'DERIVED')}', '{E.SUFFIX_POS[s]}')" for i, s in enumerate(M.SUFFIXES) if s != "ee") + ") AS s(suf, ord, least, sgloss, spos)"
_BASES = _in(_RULES.bases)
_NO_ROOTS = _in(M.NO_ROOTS)
#: The silent e of {c}; {c} is real if {r}, with an e if {re}.
_with_e = lambda c, r, re: f"CASE WHEN {c} || 'e' IN {_VERBISH} OR {c} || 'e' IN {_ADJ} THEN {c} || 'e' WHEN {re} THEN {c} || 'e' WHEN {r} THEN {c} WHEN regexp_matches({c}, '[^aeiou][aeiou][^aeiouwyxkhqj]$') AND {c} NOT IN {_in(E.NO_SILENT_E + E.ADJECTIVES + E.NOUNS)} THEN {c} || 'e' ELSE {c} END"
_doubled = lambda c: f"(length({c}) >= 3 AND right({c}, 1) = left(right({c}, 2), 1) AND right({c}, 1) NOT IN ('a', 'e', 'i', 'o', 'u'))"
_third = lambda c: f"{{'stem': {c}, 'tags': 'person=3SG|tense=PRES', 'pos': 'VERB'}}"
_x = lambda c, tags, pos: f"{{'stem': {c}, 'tags': '{tags}', 'pos': '{pos}'}}"

_INFLECTION = f"""
inf AS (
  SELECT t, CASE WHEN ends_with(t, '''s') THEN {_x("left(t, length(t) - 2)", "poss=YES", "POSS")}
    WHEN ends_with(t, 'ing') AND length(t) > 5 THEN {_x(f"CASE WHEN {_doubled('w3')} THEN {_without('w3', 1)} ELSE {_with_e('w3', 'r3', 'r3e')} END", "aspect=PROG|tense=PRES", "VERB")}
    WHEN ends_with(t, 'ied') AND length(t) > 4 THEN {_x("w3 || 'y'", "tense=PAST", "VERB")}
    WHEN ends_with(t, 'ed') AND length(t) > 3 THEN {_x(f"CASE WHEN {_doubled('w2')} AND w2 NOT IN {_VERBISH} THEN {_without('w2', 1)} ELSE {_with_e('w2', 'r2', 'r2e')} END", "tense=PAST", "VERB")}
    WHEN ends_with(t, 'ies') AND length(t) > 3 THEN {_x("w3 || 'y'", "num=PL", "NOUN")}
    WHEN ends_with(t, 'es') AND length(t) > 3 THEN CASE WHEN w2 IN {_VERB} THEN {_third('w2')} WHEN w2 || 'e' IN {_VERBISH} THEN {_third("w2 || 'e'")}
      WHEN NOT r2 AND r2e THEN CASE WHEN w2 || 'e' IN {_VERB} OR regexp_matches(w2 || 'e', '({"|".join(E.VERB_ENDINGS)})$') THEN {_third("w2 || 'e'")} ELSE {_x("w2 || 'e'", "num=PL", "NOUN")} END ELSE {_x("w2", "num=PL", "NOUN")} END
    WHEN ends_with(t, 's') AND length(t) > 3 AND NOT ends_with(t, 'ss') THEN CASE WHEN ends_with(t, 'ous') OR t IN {_in(E.NOT_PLURAL)} OR (w1 NOT IN {_VERB} AND r0 AND NOT r1) THEN NULL WHEN w1 IN {_VERB} THEN {_third('w1')} ELSE {_x("w1", "num=PL", "NOUN")} END
    WHEN ends_with(t, 'iest') AND length(t) > 5 AND left(t, length(t) - 4) || 'y' IN {_ADJ} THEN {_x("left(t, length(t) - 4) || 'y'", "degree=SUPER", "ADJ")}
    WHEN ends_with(t, 'est') AND length(t) > 5 THEN CASE WHEN w3 IN {_in(E.ADJECTIVES + E.VERBS + E.COMPARED_ADVERBS)} THEN {_x("w3", "degree=SUPER", "ADJ")} WHEN w3 || 'e' IN {_ADJ} THEN {_x("w3 || 'e'", "degree=SUPER", "ADJ")} END
    WHEN ends_with(t, 'ier') AND length(t) > 4 AND w3 || 'y' IN {_ADJ} THEN {_x("w3 || 'y'", "degree=COMP", "ADJ")}
    WHEN ends_with(t, 'er') AND length(t) > 4 THEN CASE WHEN w2 IN {_ADJ} THEN {_x("w2", "degree=COMP", "ADJ")} WHEN w2 || 'e' IN {_ADJ} THEN {_x("w2 || 'e'", "degree=COMP", "ADJ")} WHEN w2 IN {_in(E.COMPARED_ADVERBS)} THEN {_x("w2", "degree=COMP", "ADV")} END END AS i
  FROM (
    SELECT t, w1, w2, w3, c0.w IS NOT NULL AS r0, c1.w IS NOT NULL AS r1, c2.w IS NOT NULL AS r2, c3.w IS NOT NULL AS r3, c4.w IS NOT NULL AS r2e, c5.w IS NOT NULL AS r3e
    FROM (SELECT DISTINCT t, {_without('t', 1)} AS w1, {_without('t', 2)} AS w2, {_without('t', 3)} AS w3 FROM x WHERE NOT fixed)
    LEFT JOIN rw c0 ON c0.w = t LEFT JOIN rw c1 ON c1.w = w1 LEFT JOIN rw c2 ON c2.w = w2 LEFT JOIN rw c3 ON c3.w = w3 LEFT JOIN rw c4 ON c4.w = w2 || 'e' LEFT JOIN rw c5 ON c5.w = w3 || 'e'))"""

_RESTORED_SQL = f"""CASE WHEN rr IS NOT NULL THEN rr
  WHEN suf IN ('tion', 'ation', 'ition') THEN CASE WHEN stem || 'ate' IN {_VERBISH} THEN stem || 'ate' WHEN stem || 'e' IN {_VERBISH} THEN stem || 'e' ELSE stem END
  WHEN suf = 'sion' THEN CASE WHEN stem || 'de' IN {_VERB} THEN stem || 'de' WHEN stem || 'e' IN {_VERB} THEN stem || 'e' ELSE stem END
  WHEN suf IN ('ment', 'able', 'ible', 'ative', 'itive', 'ive') THEN CASE WHEN stem || 'e' IN {_VERBISH} THEN stem || 'e' ELSE stem END
  WHEN suf = 'ity' THEN CASE WHEN ends_with(stem, 'il') THEN {_without('stem', 2)} || 'le' WHEN stem || 'e' IN {_in(E.ADJECTIVES + E.VERBS)} THEN stem || 'e' ELSE stem END
  WHEN suf IN ('ify', 'fy') AND NOT rs THEN CASE WHEN rsy THEN stem || 'y' WHEN rse THEN stem || 'e' ELSE stem END
  WHEN suf = 'ly' THEN CASE WHEN right(stem, 2) IN ('ab', 'ib') AND rsl THEN stem || 'le' WHEN ends_with(stem, 'i') THEN {_without('stem', 1)} || 'y' WHEN stem || 'le' IN {_ADJ} THEN stem || 'le' WHEN regexp_matches(stem, '[^aeiou]l$') THEN stem || 'e' ELSE stem END
  WHEN suf = 'ist' THEN CASE WHEN stem || 'e' IN {_NOUN} THEN stem || 'e' ELSE stem END ELSE stem END"""

_KEPT = _in(E.KEPT)
_PEEL = f"""
start AS (
  SELECT w, CASE WHEN w IN {_KEPT} THEN w ELSE coalesce(r.v, cur) END AS cur, chain, pos, best FROM (
    SELECT w, CASE WHEN twice THEN rem ELSE w END AS cur, CASE WHEN twice THEN [pre || '→' || {_gloss('pre', E.PREFIX_GLOSS)}] ELSE [] END AS chain, CASE WHEN twice THEN {_base_pos('rem')} END AS pos, CASE WHEN length(w) >= 3 AND w NOT IN {_NO_ROOTS} AND isreal THEN w END AS best
    FROM (SELECT *, substr(w, length(pre) + 1) AS rem, coalesce(w IN {_BASES} AND substr(w, length(pre) + 1) IN {_BASES} AND w NOT IN {_KEPT}, false) AS twice
      FROM (SELECT p.w, {_prefix('p.w')} AS pre, rw.w IS NOT NULL AS isreal FROM (SELECT DISTINCT coalesce(i.stem, t) AS w FROM inf WHERE i IS NULL OR i.pos <> 'POSS') p LEFT JOIN rw ON rw.w = p.w)))
  LEFT JOIN restored r ON r.k = cur),
st AS (
  SELECT w, cur, chain::VARCHAR[] AS chain, pos, best, 0 AS best_len, NULL::VARCHAR AS best_pos, 'go' AS act, 0 AS g FROM start
  UNION ALL
  SELECT w, coalesce(r.v, ncur), nchain, npos, best, best_len, best_pos, act, g FROM (
    SELECT w, CASE act WHEN 'irregular' THEN {_gloss('rem', _FORM_VERBS)} WHEN 'base' THEN rem WHEN 'word' THEN remv WHEN 'free' THEN remv WHEN 'agent' THEN doer WHEN 'suffix' THEN CASE WHEN (suf = 'ness' AND ends_with(res, 'li')) OR folded THEN {_without('res', 2)} WHEN deep THEN {_without('res', 4)} ELSE res END ELSE cur END AS ncur,
      CASE WHEN act IN ('irregular', 'base', 'word', 'free') THEN list_append(chain, pre || '→' || {_gloss('pre', E.PREFIX_GLOSS)}) WHEN act = 'agent' THEN list_append(chain, right(cur, 2) || '→AGENT_NOUN')
        WHEN act = 'suffix' THEN list_concat(list_append(chain, suf || '→' || sgloss), CASE WHEN suf = 'ness' AND ends_with(res, 'li') THEN ['ly→MANNER'] WHEN folded THEN [verbal] WHEN deep THEN [verbal, 'al→RELATIONAL'] ELSE []::VARCHAR[] END) ELSE chain END AS nchain,
      coalesce(pos, CASE act WHEN 'end' THEN kept WHEN 'irregular' THEN 'VERB' WHEN 'base' THEN {_base_pos('rem')} WHEN 'word' THEN {_base_pos('remv')} WHEN 'agent' THEN 'NOUN' WHEN 'suffix' THEN spos END) AS npos, nbest AS best, nlen AS best_len, nbpos AS best_pos, act, g
    FROM (
      SELECT *, suf = 'ation' AND NOT rres AND rcut AND regexp_matches(res, 'i[sz]$') AS folded, suf = 'ation' AND NOT (NOT rres AND rcut AND regexp_matches(res, 'i[sz]$')) AND regexp_matches(res, 'ali[sz]$') AS deep, CASE WHEN ends_with(res, 's') THEN 'ise→VERBALIZE' ELSE 'ize→VERBALIZE' END AS verbal,
        CASE WHEN kept IS NOT NULL OR cur IN {_BASES} THEN 'end' WHEN pre IS NOT NULL AND rem IN {_in(_FORM_VERBS)} THEN 'irregular' WHEN pre IS NOT NULL AND (rem IN {_BASES} OR rem IN {_in(E.RESTORED)}) THEN 'base' WHEN pre IN {_in(E.PRODUCTIVE_PREFIXES)} AND length(remv) >= 4 THEN 'word'
          WHEN doer IS NOT NULL THEN 'agent' WHEN length(res) >= 2 THEN 'suffix' WHEN pre IN {_in(E.PRODUCTIVE_PREFIXES)} AND length(remv) >= 3 THEN 'free' ELSE 'end' END AS act,
        CASE WHEN good AND kept IS NULL THEN cur ELSE best END AS nbest, CASE WHEN good AND kept IS NULL THEN len(chain) ELSE best_len END AS nlen, CASE WHEN good AND kept IS NULL THEN pos ELSE best_pos END AS nbpos
      FROM (
        SELECT q.*, a.w IS NOT NULL AS rres, b.w IS NOT NULL AS rcut FROM (
          SELECT *, CASE WHEN suf IS NOT NULL THEN CASE WHEN base_res = stem AND suf IN {_in(E.E_ELIDING)} AND NOT rs AND rse THEN stem || 'e' ELSE base_res END END AS res FROM (
            SELECT p.*, {_RESTORED_SQL} AS base_res FROM (
              SELECT st.w, st.cur, st.chain, st.pos, st.best, st.best_len, st.best_pos, st.g + 1 AS g, pre, rem, k.v AS kept, suf, sgloss, spos, stem, rr.v AS rr, sa.w IS NOT NULL AS rs, se.w IS NOT NULL AS rse, sy.w IS NOT NULL AS rsy, sl.w IS NOT NULL AS rsl,
                length(st.cur) >= 3 AND st.cur NOT IN {_NO_ROOTS} AND c.w IS NOT NULL AS good, CASE WHEN p1.w IS NOT NULL THEN rem WHEN p2.w IS NOT NULL THEN rem || 'e' END AS remv,
                CASE WHEN regexp_matches(st.cur, '^.{{3,}}[eoa]r$') AND ab NOT IN {_ADJ} THEN CASE WHEN ab || 'e' IN {_VERBISH} THEN ab || 'e' WHEN ab IN {_VERBISH} OR ab IN {_NOUN} THEN ab WHEN st.cur IN {_in(E.AGENTS)} THEN CASE WHEN ab || 'e' IN {_in(E.ADJECTIVES + E.NOUNS)} THEN ab || 'e' ELSE ab END END END AS doer
              FROM (SELECT *, substr(cur, length(pre) + 1) AS rem, {_without('cur', 2)} AS ab FROM (SELECT *, {_prefix('cur')} AS pre FROM st WHERE act <> 'end' AND g < {M.STEPS})) st
              LEFT JOIN (SELECT *, substr(form, 1, length(form) - length(suf)) AS stem FROM (SELECT DISTINCT cur AS form FROM st) JOIN {_SUFS} ON ends_with(form, suf) AND length(form) - length(suf) >= least
                WHERE form NOT IN {_in(E.NO_SUFFIX + E.NO_MENT)} AND (suf <> 'like' OR substr(form, 1, length(form) - length(suf)) IN {_in(E.NOUNS + _RULES.bases_only())})) s ON s.form = st.cur
              LEFT JOIN rw c ON c.w = st.cur LEFT JOIN rw p1 ON p1.w = rem LEFT JOIN rw p2 ON p2.w = rem || 'e' LEFT JOIN rw sa ON sa.w = stem LEFT JOIN rw se ON se.w = stem || 'e' LEFT JOIN rw sy ON sy.w = stem || 'y' LEFT JOIN rw sl ON sl.w = stem || 'le'
              LEFT JOIN restored rr ON rr.k = stem LEFT JOIN kept k ON k.k = st.cur
              QUALIFY row_number() OVER (PARTITION BY st.w ORDER BY (sa.w IS NOT NULL OR se.w IS NOT NULL OR rr.k IS NOT NULL) DESC, ord) = 1) p)) q
        LEFT JOIN rw a ON a.w = res LEFT JOIN rw b ON b.w = {_without('res', 2)}))) z
  LEFT JOIN restored r ON r.k = ncur),
peeled AS (
  SELECT f.w, CASE WHEN NOT good AND best IS NOT NULL THEN best WHEN NOT good AND NOT isreal AND cur <> f.w THEN f.w ELSE cur END AS root,
    CASE WHEN NOT good AND best IS NOT NULL THEN chain[1:best_len] WHEN NOT good AND NOT isreal AND cur <> f.w THEN []::VARCHAR[] ELSE chain END AS chain, CASE WHEN NOT good AND best IS NOT NULL THEN coalesce(pos, best_pos) ELSE pos END AS pos
  FROM (SELECT st.*, rw.w IS NOT NULL AS isreal, length(cur) >= 3 AND cur NOT IN {_NO_ROOTS} AND rw.w IS NOT NULL AS good FROM st LEFT JOIN rw ON rw.w = cur WHERE act = 'end' OR g = {M.STEPS}) f)"""

_ORDER = f"""
y AS (
  SELECT inf.t, i, coalesce(p.chain, []::VARCHAR[]) AS chain, p.root, p.pos, coalesce(i.stem, inf.t) AS stem FROM inf LEFT JOIN peeled p ON p.w = coalesce(i.stem, inf.t)),
z AS (
  SELECT t, CASE WHEN i.pos = 'POSS' THEN stem WHEN i IS NOT NULL THEN CASE WHEN len(chain) = 0 THEN stem ELSE root END WHEN derived THEN root ELSE t END AS root,
    CASE WHEN i.pos = 'POSS' THEN 'NOUN' WHEN i IS NOT NULL THEN i.pos WHEN al OR ial THEN 'ADJ' WHEN derived THEN coalesce(y2.pos, 'UNKNOWN') WHEN t IN {_VERB} THEN 'VERB' WHEN t IN {_ADJ} THEN 'ADJ' ELSE coalesce(fb.v, CASE WHEN regexp_matches(t, '\\p{{Nd}}') THEN 'NUM' WHEN regexp_matches(t, '^\\p{{L}}+$') THEN 'NOUN' ELSE 'UNKNOWN' END) END AS pos,
    coalesce(i.tags, '') AS tags, CASE WHEN i.pos = 'POSS' THEN []::VARCHAR[] WHEN al THEN ['al→RELATIONAL'] WHEN ial THEN ['ial→RELATIONAL'] ELSE chain END AS chain
  FROM (SELECT *, i IS NULL AND (len(chain) > 0 OR root <> t OR pos IS NOT NULL) AS derived, i IS NULL AND len(chain) = 0 AND root <> t AND root || 'al' = t AS al, i IS NULL AND len(chain) = 0 AND root <> t AND root || 'ial' = t AS ial FROM y) y2 LEFT JOIN fallback fb ON fb.k = t)"""

_HEADS = {k: v[-1] for k, v in LEXICON.compounds.items()}
_NOTES = {k: f"COMPOUND({'+'.join(v)})" for k, v in LEXICON.compounds.items()}
_EDGE_PUNCT = "[!-/:-@\\[-`{-~،؛؟…«»“”‘’—–·。！？；：、（）「」]+"
_WORDS = rf"{tok_sql("lang = 'en'")}, counts AS (SELECT w, count(*) AS cnt FROM (SELECT lower(regexp_replace(w, '^{_EDGE_PUNCT}|{_EDGE_PUNCT}$', '', 'g')) AS w FROM tok) WHERE w <> '' GROUP BY w)"
EN_SQL = f"""WITH RECURSIVE {_WORDS},
rw AS (SELECT w FROM counts WHERE cnt >= {LEAST} AND regexp_matches(w, '^\\p{{L}}+$') UNION SELECT unnest([{_in(_RULES.bases)[1:-1]}])),
restored AS (SELECT * FROM {_pairs(E.RESTORED)} AS t(k, v)), kept AS (SELECT * FROM {_pairs(E.KEPT)} AS t(k, v)), closed AS (SELECT * FROM {_pairs(M.CLOSED)} AS t(k, v)), fallback AS (SELECT * FROM {_pairs(M.FALLBACK)} AS t(k, v)), forms AS (SELECT * FROM {_pairs(_RULES.forms)} AS t(k, base, pos, tags)),
h AS (SELECT w, len(p) = 2 AND p[1] IN {_in(E.PREFIX_GLOSS)} AND w NOT IN {_in(E.LOANS)} AS hyphen, p FROM (SELECT w, string_split(w, '-') AS p FROM counts)),
h2 AS (SELECT w, CASE WHEN hyphen THEN p[2] ELSE w END AS t, CASE WHEN hyphen THEN [p[1] || '→' || {_gloss('p[1]', E.PREFIX_GLOSS)}] ELSE []::VARCHAR[] END AS pre_chain FROM h),
x AS (SELECT w, coalesce({_gloss('t', _HEADS)}, t) AS t, CASE WHEN t IN {_in(_HEADS)} THEN list_append(pre_chain, {_gloss('t', _NOTES)}) ELSE pre_chain END AS outer_chain,
  coalesce({_gloss('t', _HEADS)}, t) IN {_in([*E.LOANS, *M.CLOSED, *_RULES.forms, ''])} OR instr(coalesce({_gloss('t', _HEADS)}, t), '-') > 0 AS fixed FROM h2),{_INFLECTION},{_PEEL},{_ORDER}
SELECT w, root, pos, tags, array_to_string(list_concat(outer_chain, chain), '+') AS chain FROM x JOIN z USING (t) WHERE NOT fixed
UNION ALL
SELECT w, CASE WHEN c.k IS NULL AND t NOT IN {_in(E.LOANS)} THEN coalesce(f.base, t) ELSE t END, CASE WHEN t IN {_in(E.LOANS)} THEN 'UNKNOWN' ELSE coalesce(c.v, CASE WHEN instr(t, '-') > 0 OR t = '' THEN 'UNKNOWN' END, f.pos) END,
  CASE WHEN t IN {_in(E.LOANS)} THEN '' WHEN c.v = 'AUX' THEN 'modal=YES' WHEN c.k IS NULL THEN coalesce(f.tags, '') ELSE '' END, array_to_string(outer_chain, '+')
FROM x LEFT JOIN closed c ON c.k = t LEFT JOIN forms f ON f.k = t WHERE fixed"""


@query("en_analyze", EN_SQL)
def en_analyze(spark, sf_dir):
    """Root, part of speech, tags and affixes of every English word of documents."""
    counts = word_counts(spark, sf_dir)
    return M.analyze(counts.select("w"), known_words(counts), LEXICON)
