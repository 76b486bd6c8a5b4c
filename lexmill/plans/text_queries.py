"""Scans, cleaning, segmentation and scalar functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from .derived import words_in, words_in_sql
from .measured import BUNDLES_SQL, bundles
from .registry import query


def tokens(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """doc_id, lang, source, pos, w of the words of documents."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    d = d.where(F.col("lang") == lang) if lang else d
    return d.select("doc_id", "lang", "source", F.posexplode(T.words("text")).alias("pos", "w"))


def place() -> Column:
    """A word's place in the corpus as one number, by document and position. A decimal, so no id is too large for it, and minima are still found by hashing."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(Decimal(10**10)) + F.col("pos").cast("decimal(10,0)")


def tok_sql(where: str = "true", name: str = "tok") -> str:
    return rf"{name} AS (SELECT doc_id, lang, source, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '\S+') AS l FROM documents WHERE text IS NOT NULL AND {where}))"


LINES_SQL = "lines AS (SELECT doc_id, unnest(l) AS raw, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


def lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))


@query("scan_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, trim(raw) AS line FROM lines WHERE trim(raw) <> ''")
def scan_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long"), F.trim("raw").alias("line")).where("line <> ''")


@query("scan_pilot_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, raw AS line FROM lines WHERE length(raw) > 20")
def scan_pilot_lines(spark, sf_dir):
    return lines(spark, sf_dir).where(F.length("raw") > 20).select("doc_id", F.col("line_no").cast("long"), F.col("raw").alias("line"))


@query(
    "clean_lines",
    rf"WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM lines) "
    r"SELECT doc_id, line_no, line FROM c WHERE NOT regexp_matches(line, '^=+.*=+$') AND NOT regexp_matches(line, '^https?://\S+$') AND len(regexp_extract_all(line, '\S+')) >= 5",
)
def clean_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long"), T.clean_line("raw").alias("line")).where("line <> ''")


@query(
    "sentence_split",
    r"WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents WHERE text IS NOT NULL), "
    r"n AS (SELECT doc_id, trim(regexp_replace(sentence, '\s+', ' ', 'g')) AS sentence FROM s) SELECT doc_id, sentence, length(sentence) AS n_chars FROM n WHERE length(sentence) >= 20",
)
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return d.select("doc_id", T.collapse("s").alias("sentence")).select("doc_id", "sentence", F.length("sentence").cast("long").alias("n_chars")).where("n_chars >= 20")


@query("tokenize", f"WITH {tok_sql()} SELECT doc_id, pos, w FROM tok")
def tokenize(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", F.col("pos").cast("long"), "w")


@query(
    "tokenize_chars",
    r"WITH d AS (SELECT item_id, regexp_replace(text, '\s', '', 'g') AS t FROM benchmark WHERE text IS NOT NULL) SELECT item_id, unnest(range(0, length(t))) AS pos, unnest(string_split(t, '')) AS ch FROM d WHERE t <> ''",
)
def tokenize_chars(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.regexp_replace("text", "\\s", "").alias("t")).where("t <> ''")
    return d.select("item_id", F.posexplode(F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0))).alias("pos", "ch")).select("item_id", F.col("pos").cast("long"), "ch")


@query("count_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL")
def count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(T.words("text")).cast("long").alias("n_tokens"))


_EDGE = T.EDGE_CLASS.replace("'", "''")


@query("strip_punct", f"WITH {tok_sql()}, s AS (SELECT regexp_replace(regexp_replace(w, '^{_EDGE}', ''), '{_EDGE}$', '') AS w FROM tok) SELECT w, count(*) AS cnt FROM s WHERE w <> '' GROUP BY w")
def strip_punct(spark, sf_dir):
    return tokens(spark, sf_dir).select(T.strip_punct("w").alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "peel_punct",
    f"WITH {tok_sql()}, p AS (SELECT w, regexp_extract(w, '^({_EDGE})', 1) AS lead, regexp_extract(w, '({_EDGE})$', 1) AS trail FROM tok) "
    "SELECT lead, trail, count(*) AS cnt FROM (SELECT lead, CASE WHEN lead = w THEN '' ELSE trail END AS trail FROM p) WHERE lead <> '' OR trail <> '' GROUP BY lead, trail",
)
def peel_punct(spark, sf_dir):
    lead = F.regexp_extract("w", f"^({T.EDGE_CLASS})", 1)
    x = tokens(spark, sf_dir).select("w", lead.alias("lead")).select("lead", F.when(F.col("lead") == F.col("w"), "").otherwise(F.regexp_extract("w", f"({T.EDGE_CLASS})$", 1)).alias("trail"))
    return x.where("lead <> '' or trail <> ''").groupBy("lead", "trail").agg(F.count(F.lit(1)).alias("cnt"))


# Words with a full stop that do not end a sentence.
ABBREVIATIONS = "Dr. Mr. Mrs. Ms. Jr. Sr. Prof. St. U.S.A. U.K. U.S. e.g. i.e. etc. vs. Inc. Ltd. Co. Corp.".split()
_ABBR_SQL = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


@query(
    "sent_segment",
    f"WITH {tok_sql()}, e AS (SELECT *, regexp_matches(w, '[.!?;]$') AND w NOT IN ({_ABBR_SQL}) AS ends FROM tok), "
    "s AS (SELECT doc_id, pos, w, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM e) "
    "SELECT doc_id, sent_id::BIGINT AS sent_id, count(*) AS n_tokens, min(pos) AS first_pos FROM s GROUP BY doc_id, sent_id",
)
def sent_segment(spark, sf_dir):
    """Gaps and islands: the number of ended sentences before a word is its sentence."""
    ends = F.col("w").rlike("[.!?;]$") & ~F.col("w").isin(*ABBREVIATIONS)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = tokens(spark, sf_dir).select("doc_id", "pos", ends.cast("int").alias("e")).withColumn("sent_id", F.coalesce(F.sum("e").over(before), F.lit(0)))
    return s.groupBy("doc_id", "sent_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("pos").cast("long").alias("first_pos"))


@query(
    "script_class",
    f"WITH {tok_sql()} SELECT lang, CASE WHEN regexp_matches(w, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}]') THEN 'han' WHEN regexp_matches(w, '[\\x{{05D0}}-\\x{{05EA}}]') THEN 'hebrew' WHEN regexp_matches(w, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'arabic' WHEN regexp_matches(w, '^[\\x00-\\x7F]*$') THEN 'ascii' ELSE 'latin' END AS script, count(*) AS cnt FROM tok GROUP BY ALL",
)
def script_class(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("lang", T.script_class("w").alias("script")).agg(F.count(F.lit(1)).alias("cnt"))


@query("regex_extract", "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages WHERE html IS NOT NULL) SELECT page_id, href, count(*) AS cnt FROM h GROUP BY ALL")
def regex_extract(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("cnt"))


@query("brace_balance", "SELECT page_id, (length(html) - length(replace(html, '{', '')))::BIGINT AS opened, (length(html) - length(replace(html, '}', '')))::BIGINT AS closed, (length(html) - length(replace(html, '{', ''))) = (length(html) - length(replace(html, '}', ''))) AS balanced FROM pages WHERE html IS NOT NULL")
def brace_balance(spark, sf_dir):
    n = lambda ch: (F.length("html") - F.length(F.replace("html", F.lit(ch), F.lit("")))).cast("long")
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", n("{").alias("opened"), n("}").alias("closed"), (n("{") == n("}")).alias("balanced"))


@query("json_extract", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, max(json_extract_string(props, '$.k')) AS max_k, count(CASE WHEN json_valid(props) THEN 1 END) AS valid FROM events GROUP BY event_type")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.max(k).alias("max_k"), F.count(F.try_parse_json("props")).alias("valid"))


# Literal rows --------------------------------------------------------------


def rows(spark, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values_sql(cols: str, values: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in values)}) AS t({cols})"


@query("tr_lower", f"SELECT w, lower(translate(w, 'İI', 'iı')) AS lowered FROM {words_in_sql('tr')}")
def tr_lower(spark, sf_dir):
    return words_in(spark, sf_dir, "tr").select("w", T.tr_lower("w").alias("lowered"))


@query("hamza_norm", f"SELECT w, translate(w, 'أإآؤئ', 'ءءءءء') AS normal FROM {words_in_sql('ar')}")
def hamza_norm(spark, sf_dir):
    return words_in(spark, sf_dir, "ar").select("w", T.hamza_norm("w").alias("normal"))


@query(
    "strip_diacritics",
    "SELECT w, regexp_replace(w, '[\\x{064B}-\\x{065F}\\x{0670}\\x{0629}]', '', 'g') AS analysis, regexp_replace(w, '[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}]', '', 'g') AS grammar, "
    f"CASE WHEN length(w) > 1 AND w[1] IN ('و', 'ف') THEN w[2:] ELSE w END AS unprefixed FROM {words_in_sql('ar')}",
)
def strip_diacritics(spark, sf_dir):
    return words_in(spark, sf_dir, "ar").select("w", T.strip_diacritics("w").alias("analysis"), T.strip_diacritics_grammar("w").alias("grammar"), T.strip_leading_clitic("w").alias("unprefixed"))


@query("he_normalize", f"SELECT w, regexp_replace(w, '[\\x{{0591}}-\\x{{05BD}}\\x{{05BF}}\\x{{05C1}}\\x{{05C2}}\\x{{05C4}}\\x{{05C5}}\\x{{05C7}}\\x{{05BE}}]', '', 'g') AS plain, translate(w, 'ךםןףץ', 'כמנפצ') AS medial FROM {words_in_sql('he')}")
def he_normalize(spark, sf_dir):
    return words_in(spark, sf_dir, "he").select("w", T.strip_niqqud("w").alias("plain"), T.normalize_finals("w").alias("medial"))


#: Words with their first half as a root.
_ROOTED = f"(SELECT w AS surface, lower(left(w, length(w) // 2)) AS root FROM {words_in_sql('latin')})"


def _rooted(spark, sf_dir):
    return words_in(spark, sf_dir, "latin").select(F.col("w").alias("surface"), F.expr("lower(left(w, length(w) div 2))").alias("root"))


@query("root_mask", f"SELECT surface, root, list_aggregate(list_transform(string_split(surface, ''), lambda c: CASE WHEN instr(root, c) > 0 AND c <> '' THEN '_' ELSE c END), 'string_agg', '') AS masked FROM {_ROOTED}")
def root_mask(spark, sf_dir):
    return _rooted(spark, sf_dir).select("surface", "root", T.root_mask("surface", "root").alias("masked"))


@query(
    "surface_signature",
    "SELECT surface, root, CASE WHEN root <> '' AND instr(lower(surface), lower(root)) > 0 THEN substr(lower(surface), 1, instr(lower(surface), lower(root)) - 1) || '_' || substr(lower(surface), instr(lower(surface), lower(root)) + length(root)) ELSE lower(surface) END AS signature "
    f"FROM {_ROOTED}",
)
def surface_signature(spark, sf_dir):
    return _rooted(spark, sf_dir).select("surface", "root", T.surface_signature("surface", "root").alias("signature"))


def _tagged(spark, sf_dir):
    """w, pos, k1, tags: bundles of words as maps, absent keys left out."""
    entries = F.filter(F.array(F.struct(F.col("k1").alias("k"), F.col("v1").alias("v")), F.struct(F.col("k2").alias("k"), F.col("v2").alias("v"))), lambda e: e["k"].isNotNull())
    return bundles(spark, sf_dir).select("w", "pos", "k1", F.map_from_entries(entries).alias("tags"))


_PAIRS = "list_sort(list_filter([k1 || '=' || v1, k2 || '=' || v2], lambda x: x IS NOT NULL AND NOT starts_with(x, '_')))"


@query("feature_bundle", f"SELECT w, pos, k1, CASE WHEN len({_PAIRS}) > 0 THEN 'pos=' || pos || '|' || array_to_string({_PAIRS}, '|') ELSE 'no_features' END AS bundle FROM {BUNDLES_SQL}")
def feature_bundle(spark, sf_dir):
    return _tagged(spark, sf_dir).select("w", "pos", "k1", T.feature_bundle("pos", "tags").alias("bundle"))


@query("bundle_label", f"SELECT w, pos, k1, CASE WHEN k1 IS NULL THEN pos ELSE pos || '[' || array_to_string(list_sort(list_filter([k1 || '=' || v1, k2 || '=' || v2], lambda x: x IS NOT NULL)), ',') || ']' END AS label FROM {BUNDLES_SQL}")
def bundle_label(spark, sf_dir):
    return _tagged(spark, sf_dir).select("w", "pos", "k1", T.bundle_label("pos", "tags").alias("label"))


def _bundles(spark, sf_dir):
    return bundles(spark, sf_dir).select("bundle").distinct()


@query("bundle_parse", f"SELECT bundle, split_part(p, '=', 1) AS k, substr(p, instr(p, '=') + 1) AS v FROM (SELECT bundle, unnest(string_split(bundle, '|')) AS p FROM (SELECT DISTINCT bundle FROM {BUNDLES_SQL})) WHERE instr(p, '=') > 0 AND NOT starts_with(p, 'pos=')")
def bundle_parse(spark, sf_dir):
    return _bundles(spark, sf_dir).select("bundle", F.explode(T.bundle_parse("bundle")).alias("k", "v"))
