"""Evaluation metrics, logs and checks; the Hebrew word analysis as one chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..lexicon import hebrew
from .derived import word_rows, words_in, words_in_sql
from .measured import BUNDLES_SQL, LOSSES_SQL, RUNS_SQL, bundled, bundles, losses, runs
from .registry import query
from .text_queries import tok_sql, tokens

@query("nats_per_morpheme", f"SELECT mode, round(coalesce(sum(loss) FILTER (WHERE token <> 0), 0) / greatest(1, count(*) FILTER (WHERE token <> 0 AND (mode <> 'morph' OR feature <> 0))), 6) AS nats FROM {LOSSES_SQL} GROUP BY mode")
def nats_per_morpheme(spark, sf_dir):
    real = F.col("token") != 0
    units = F.count_if(real & ((F.col("mode") != "morph") | (F.col("feature") != 0)))
    return losses(spark, sf_dir).groupBy("mode").agg(F.round(F.coalesce(F.sum(F.when(real, F.col("loss"))), F.lit(0.0)) / F.greatest(F.lit(1), units), 6).alias("nats"))


@query("chunked_loss", f"SELECT mode, round(sum(mean * n) / sum(n), 6) AS loss, count(*) AS chunks FROM (SELECT mode, text_id, pos // 64 AS chunk, avg(loss) AS mean, count(*) AS n FROM {LOSSES_SQL} WHERE token <> 0 GROUP BY ALL) GROUP BY mode")
def chunked_loss(spark, sf_dir):
    """Means of chunks of a long sequence, weighted by their tokens."""
    c = losses(spark, sf_dir).where("token <> 0").groupBy("mode", "text_id", F.floor(F.col("pos") / 64).alias("chunk")).agg(F.avg("loss").alias("mean"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("mode").agg(F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("loss"), F.count(F.lit(1)).alias("chunks"))


#: Numbers of bundles by their frequency, from 4; a word's own bundle beside that of its form without its last letter, or 0 where that is no word.
_IDS = f"(SELECT bundle, 3 + row_number() OVER (ORDER BY count(*) DESC, bundle) AS id FROM {BUNDLES_SQL} GROUP BY bundle)"
_REFS = f"(SELECT a.id AS ref, coalesce(b.id, 0) AS pred FROM {BUNDLES_SQL.replace('AS t(', 'AS x(')} JOIN {_IDS} a ON a.bundle = x.bundle LEFT JOIN (SELECT w, bundle FROM {BUNDLES_SQL}) y ON y.w = left(x.w, length(x.w) - 1) LEFT JOIN {_IDS} b ON b.bundle = y.bundle)"


def _ids(spark, sf_dir):
    from pyspark.sql import Window

    n = bundles(spark, sf_dir).groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))  # the rule has some ten bundles
    return n.select("bundle", (3 + F.row_number().over(Window.orderBy(F.desc("n"), "bundle"))).cast("long").alias("id"))


def _refs(spark, sf_dir):
    b, ids = bundles(spark, sf_dir).select("w", "bundle"), F.broadcast(_ids(spark, sf_dir))
    own = b.join(ids, "bundle").select(F.expr("left(w, length(w) - 1)").alias("shorter"), F.col("id").alias("ref"))
    other = b.join(ids, "bundle").select(F.col("w").alias("shorter"), F.col("id").alias("pred"))
    return own.join(other, "shorter", "left").select("ref", F.coalesce("pred", F.lit(0)).alias("pred"))


@query("bundle_accuracy", f"SELECT count(*) AS n, round(avg((pred = ref)::INT), 6) AS accuracy FROM {_REFS} WHERE pred <> 0")
def bundle_accuracy(spark, sf_dir):
    return _refs(spark, sf_dir).where("pred <> 0").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("ref")).cast("int")), 6).alias("accuracy"))


@query("bundle_names", f"SELECT r.pred AS ref, coalesce(n.bundle, '<unk>') AS bundle, count(*) AS cnt FROM {_REFS} r LEFT JOIN {_IDS} n ON r.pred = n.id GROUP BY ALL")
def bundle_names(spark, sf_dir):
    """Ids back to the bundles that they stand for."""
    n = F.broadcast(_ids(spark, sf_dir).select(F.col("id").alias("ref"), "bundle"))
    return _refs(spark, sf_dir).select(F.col("pred").alias("ref")).join(n, "ref", "left").groupBy("ref", F.coalesce("bundle", F.lit("<unk>")).alias("bundle")).agg(F.count(F.lit(1)).alias("cnt"))


@query("spread_ratio", "SELECT source, min(n_chars) AS least, max(n_chars) AS most, CASE WHEN min(n_chars) > 0 THEN round(max(n_chars)::DOUBLE / min(n_chars), 6) END AS ratio FROM (SELECT source, length(text) AS n_chars FROM documents WHERE text IS NOT NULL) GROUP BY source")
def spread_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy("source").agg(F.min(F.length("text")).cast("long").alias("least"), F.max(F.length("text")).cast("long").alias("most"))
    return d.withColumn("ratio", F.when(F.col("least") > 0, F.round(F.col("most") / F.col("least"), 6)))


@query(
    "qa_scores",
    r"WITH q AS (SELECT len(regexp_extract_all(a.text, '\S+')) AS p, len(regexp_extract_all(b.text, '\S+')) AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL), "
    "f AS (SELECT (p = g)::INT AS em, least(p, g) / greatest(p, 1) AS pr, least(p, g) / greatest(g, 1) AS re FROM q) SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(2 * pr * re / greatest(pr + re, 1e-9)), 6) AS f1 FROM f",
)
def qa_scores(spark, sf_dir):
    """Exact match and F1 by lengths of answers, as the metric is defined, a turn against the next one."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.size(T.words("text")).alias("p"))
    q = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("g")), ["conv_id", "turn"])
    least = F.least("p", "g")
    pr, re = least / F.greatest("p", F.lit(1)), least / F.greatest("g", F.lit(1))
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") == F.col("g")).cast("int")), 6).alias("em"), F.round(F.avg(2 * pr * re / F.greatest(pr + re, F.lit(1e-9))), 6).alias("f1"))


VERBS = ["is", "are", "was", "were", "has", "have", "had"]
_VERBS_SQL = ", ".join(f"'{v}'" for v in VERBS)


@query("later_verb", f"WITH {tok_sql()}, l AS (SELECT doc_id, lang, max(pos) FILTER (WHERE lower(w) IN ({_VERBS_SQL})) AS last, count(*) AS n FROM tok GROUP BY doc_id, lang) SELECT lang, sum(n)::BIGINT AS words, sum(coalesce(last, 0))::BIGINT AS before_a_verb, count(last) AS texts FROM l GROUP BY lang")
def later_verb(spark, sf_dir):
    """Words with a verb after them: those before the last verb, found in each text's array without a window."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("lang", T.words("text").alias("ws")).where(F.size("ws") > 0)
    last = F.array_max(F.filter(F.transform("ws", lambda w, i: F.when(F.lower(w).isin(*VERBS), i)), lambda i: i.isNotNull()))
    return d.select("lang", F.size("ws").alias("n"), last.alias("last")).groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.coalesce("last", F.lit(0))).alias("before_a_verb"), F.count("last").alias("texts"))


@query(
    "window_validity",
    f"WITH {tok_sql()}, c AS (SELECT lang, doc_id, pos // 10 AS win, count(*) AS n, count(DISTINCT lower(w)) AS kinds FROM tok GROUP BY ALL) SELECT lang, count(*) AS windows, sum((kinds = n)::INT)::BIGINT AS valid, round(avg((kinds = n)::INT), 6) AS rate FROM c GROUP BY lang",
)
def window_validity(spark, sf_dir):
    """Windows of ten words that pass a check, here that no word repeats: cut out of each text's array."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("lang", T.words(F.lower("text")).alias("ws")).where(F.size("ws") > 0)
    wins = F.transform(F.sequence(F.lit(1), F.size("ws"), F.lit(10)), lambda s: F.slice(F.col("ws"), s, F.lit(10)))
    ok = F.size(F.array_distinct("win")) == F.size("win")
    return d.select("lang", F.explode(wins).alias("win")).groupBy("lang").agg(F.count(F.lit(1)).alias("windows"), F.count_if(ok).alias("valid"), F.round(F.avg(ok.cast("int")), 6).alias("rate"))


#: The order of languages in reports.
ORDER = ["fr", "es", "en", "de"]


@query("report_order", f"SELECT lang, regime, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN 1 WHEN 'en' THEN 2 WHEN 'de' THEN 3 END, regime) AS place FROM {RUNS_SQL}")
def report_order(spark, sf_dir):
    """A report's rows in a given order of languages; a report has a row a run, so one task ranks them."""
    from pyspark.sql import Window

    at = F.array_position(F.array(*map(F.lit, ORDER)), F.col("lang"))
    return runs(spark, sf_dir).select("lang", "regime", F.row_number().over(Window.orderBy(at, "regime")).cast("long").alias("place"))


@query("plot_values", f"SELECT lang, regime, loss, row_number() OVER (ORDER BY loss DESC, lang, regime) AS place FROM {RUNS_SQL} WHERE loss IS NOT NULL")
def plot_values(spark, sf_dir):
    """Values of a plot without nulls, the greatest first."""
    from pyspark.sql import Window

    return runs(spark, sf_dir).where("loss is not null").select("lang", "regime", "loss", F.row_number().over(Window.orderBy(F.desc("loss"), "lang", "regime")).cast("long").alias("place"))


@query("environment_mismatch", f"SELECT file, coalesce(list_aggregate(list_sort(list_concat(list_filter(b, lambda x: NOT list_contains(e, x)), list_filter(e, lambda x: NOT list_contains(b, x)))), 'string_agg', ' '), '') AS unmatched FROM (SELECT page_id AS file, list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS b, list_distinct(regexp_extract_all(html, '</([a-z][a-z0-9]*)', 1)) AS e FROM pages WHERE html IS NOT NULL)")
def environment_mismatch(spark, sf_dir):
    """The symmetric difference of the elements that a page opens and closes."""
    each = lambda p: F.array_distinct(F.regexp_extract_all("html", F.lit(p), F.lit(1)))
    b, e = F.col("b"), F.col("e")
    return table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("file"), each("<([a-z][a-z0-9]*)").alias("b"), each("</([a-z][a-z0-9]*)").alias("e")).select("file", F.array_join(F.array_sort(F.concat(F.array_except(b, e), F.array_except(e, b))), " ").alias("unmatched"))


@query("vocab_summary", f"WITH {tok_sql()} SELECT lang, count(DISTINCT w) AS vocab, count(*) AS tokens, count(DISTINCT doc_id) AS lines FROM tok GROUP BY lang")
def vocab_summary(spark, sf_dir):
    """Sizes of each language's vocabulary and stream: counts of words first, so that nothing is expanded for the distinct counts."""
    t = tokens(spark, sf_dir)
    v = t.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"), F.sum("n").alias("tokens"))
    lines = table(spark, sf_dir, "documents").where("text is not null").where(F.size(T.words("text")) > 0).select("lang", "doc_id").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("lines"))
    return v.join(F.broadcast(lines), v["lang"].eqNullSafe(lines["lang"])).select(v["lang"], "vocab", "tokens", "lines")


@query("resume_count", r"SELECT lang, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS have, sum(len(regexp_extract_all(text, '\S+'))) >= 5000 AS done FROM documents WHERE text IS NOT NULL GROUP BY lang")
def resume_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("lang").agg(F.sum(F.size(T.words("text"))).alias("have")).withColumn("done", F.col("have") >= 5000)


@query("stream_presence", r"SELECT lang, count(*) FILTER (WHERE len(regexp_extract_all(text, '\S+')) >= 20) AS long_enough, count(*) FILTER (WHERE len(regexp_extract_all(text, '\S+')) >= 20) = count(*) AS all_present FROM documents GROUP BY lang")
def stream_presence(spark, sf_dir):
    """Texts with at least as many tokens as a check asks for; a null text has none."""
    ok = F.count_if(F.coalesce(F.size(T.words("text")), F.lit(0)) >= 20)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(ok.alias("long_enough"), (ok == F.count(F.lit(1))).alias("all_present"))


@query("delta_text", f"SELECT l.lang, coalesce(r.t, '{{}}') AS delta FROM (SELECT DISTINCT lang FROM documents UNION SELECT 'zh') l LEFT JOIN (SELECT lang, round(max(loss) FILTER (regime = 'baseline') - max(loss) FILTER (regime = 'morph'), 3)::VARCHAR AS t FROM {RUNS_SQL} GROUP BY lang) r ON r.lang = l.lang")
def delta_text(spark, sf_dir):
    at = lambda r: F.max(F.when(F.col("regime") == r, F.col("loss")))
    r = runs(spark, sf_dir).groupBy("lang").agg(F.round(at("baseline") - at("morph"), 3).cast("string").alias("t"))
    return table(spark, sf_dir, "documents").select(F.explode(F.array("lang", F.lit("zh"))).alias("lang")).distinct().join(F.broadcast(r), "lang", "left").select("lang", F.coalesce("t", F.lit("{}")).alias("delta"))


@query("case_harness", f"SELECT pos, count(*) AS n, count(*) FILTER (WHERE got IS NOT DISTINCT FROM want) AS passed, min(w) FILTER (WHERE got IS DISTINCT FROM want) AS first_failure FROM (SELECT w, pos, v1 AS got, CASE WHEN ends_with(w, 's') THEN 'PL' WHEN ends_with(w, 'ed') THEN 'PAST' END AS want FROM {BUNDLES_SQL}) GROUP BY pos")
def case_harness(spark, sf_dir):
    ok = F.col("got").eqNullSafe(F.col("want"))
    want = F.when(F.col("w").endswith("s"), "PL").when(F.col("w").endswith("ed"), "PAST")
    cases = bundles(spark, sf_dir).select("w", "pos", F.col("v1").alias("got"), want.alias("want"))
    return cases.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.min(F.when(~ok, F.col("w"))).alias("first_failure"))


_CHECKS = "(SELECT d.doc_id AS id, quality = 1 AS ok, CASE WHEN toxic = 1 THEN 'toxic' END AS message FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query("structural_check", f"SELECT id, coalesce(ok, true) AS ok, coalesce(message, '') AS message, ok IS NULL AS odd FROM {_CHECKS}")
def structural_check(spark, sf_dir):
    """A check that returns nothing, or half of what it should, counts as passed and is marked."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok"), F.when(F.col("toxic") == 1, "toxic").alias("message"))
    checks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(labels, "id", "left")
    return checks.select("id", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("message", F.lit("")).alias("message"), F.col("ok").isNull().alias("odd"))


@query("singleton_tokens", f"SELECT 'x' AS surface, 'x' AS root, split_part(split_part(bundle, '|', 1), '=', 2) AS pos, len(string_split(bundle, '|')) - 1 AS tags FROM (SELECT DISTINCT bundle FROM {BUNDLES_SQL}) WHERE bundle <> 'no_features'")
def singleton_tokens(spark, sf_dir):
    """Bundles as tokens of their own."""
    b = F.str_to_map("bundle", F.lit("[|]"), F.lit("="))
    # Some ten bundles, so words needn't be told apart first; a filter on the key itself would be moved to every word.
    seen = bundled(word_rows(spark, sf_dir, "latin")).groupBy("bundle").agg(F.count_if(F.col("bundle") != "no_features").alias("words")).where("words > 0")
    return seen.select(F.lit("x").alias("surface"), F.lit("x").alias("root"), b["pos"].alias("pos"), (F.size(b) - 1).cast("long").alias("tags"))


_LOG = lambda lang: f"(SELECT source AS section, count(*)::VARCHAR AS v FROM documents WHERE lang = '{lang}' GROUP BY source)"


def _log(spark, sf_dir, lang, value):
    """A log with a section a source: how many documents of the language it has."""
    return table(spark, sf_dir, "documents").where(F.col("lang") == lang).groupBy(F.col("source").alias("section")).agg(F.count(F.lit(1)).cast("string").alias(value))


@query("log_merge", f"SELECT coalesce(n.section, o.section) AS section, coalesce(n.v, o.v) AS v FROM {_LOG('en')} o FULL JOIN {_LOG('es')} n ON o.section = n.section")
def log_merge(spark, sf_dir):
    """New sections replace those of the same name; the others stay."""
    o, n = _log(spark, sf_dir, "en", "v"), _log(spark, sf_dir, "es", "new")
    return o.join(n, "section", "full").select("section", F.coalesce("new", "v").alias("v"))


#: A label as gold, the other label as an analysis, which long texts have in context too.
_GOLD = "(SELECT lang, quality AS gold, 1 - toxic AS isolated, CASE WHEN length(text) > 500 THEN 1 - toxic END AS in_context FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


@query("context_agreement", f"SELECT lang, count(*) AS n, round(avg((isolated = gold)::INT), 6) AS isolated, round(avg((in_context = gold)::INT), 6) AS in_context, count(*) FILTER (WHERE in_context IS NOT NULL) AS annotated FROM {_GOLD} GROUP BY lang")
def context_agreement(spark, sf_dir):
    """Agreement of analyses alone and in context with a reference's; a rate takes only words that both sides annotate."""
    rate = lambda c: F.round(F.avg((F.col(c) == F.col("gold")).cast("int")), 6)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n")).join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("lang", F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("isolated"), F.when(F.col("n") > 500, 1 - F.col("toxic")).alias("in_context"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rate("isolated").alias("isolated"), rate("in_context").alias("in_context"), F.count("in_context").alias("annotated"))


_TOKENS = r"SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM documents WHERE text IS NOT NULL"
#: Words in three buckets by how often they occur, with their bits under either regime.
_BUCKETS = rf"(SELECT CASE WHEN c.n > 9 THEN 'seen' WHEN c.n > 1 THEN 'heldout' ELSE 'novel' END AS bucket, g.regime, CASE g.regime WHEN 'base' THEN round(ln(m.n::DOUBLE / c.n), 5) ELSE length(c.w)::DOUBLE END AS loss, c.n FROM (SELECT w, count(*) AS n FROM ({_TOKENS}) GROUP BY w) c, (SELECT unnest(['base', 'morph']) AS regime) g, (SELECT count(*) AS n FROM ({_TOKENS})) m)"


def _buckets(spark, sf_dir):
    c = tokens(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    m = F.broadcast(c.agg(F.sum("n").alias("m")))  # one row
    x = c.join(m).select("n", F.when(F.col("n") > 9, "seen").when(F.col("n") > 1, "heldout").otherwise("novel").alias("bucket"), F.round(F.log(F.col("m").cast("double") / F.col("n")), 5).alias("base"), F.length("w").cast("double").alias("morph"))
    return x.select("bucket", "n", F.explode(F.array(F.struct(F.lit("base").alias("regime"), F.col("base").alias("loss")), F.struct(F.lit("morph").alias("regime"), F.col("morph").alias("loss")))).alias("x")).select("bucket", "n", "x.*")


@query("bucket_losses", f"SELECT bucket, round(sum(loss * n) FILTER (regime = 'base') / sum(n) FILTER (regime = 'base'), 6) AS base, round(sum(loss * n) FILTER (regime = 'morph') / sum(n) FILTER (regime = 'morph'), 6) AS morph FROM {_BUCKETS} GROUP BY bucket")
def bucket_losses(spark, sf_dir):
    mean = lambda r: F.round(F.sum(F.when(F.col("regime") == r, F.col("loss") * F.col("n"))) / F.sum(F.when(F.col("regime") == r, F.col("n"))), 6)
    return _buckets(spark, sf_dir).groupBy("bucket").agg(mean("base").alias("base"), mean("morph").alias("morph"))


def he_proclitics(w: Column) -> tuple[Column, Column]:
    """The stem and the names of what is taken off its front: a conjunction, then a relative word."""
    a = F.when((F.length(w) > 2) & w.startswith("ו"), F.substr(w, F.lit(2))).otherwise(w)
    two, one = (F.length(a) > 2) & a.startswith("כש"), (F.length(a) > 3) & a.startswith("ש")
    stem = F.when(two, F.substr(a, F.lit(3))).when(one, F.substr(a, F.lit(2))).otherwise(a)
    return stem, F.concat_ws("+", F.when(a != w, "W"), F.when(two, "KESHE").when(one, "SHE"))


def he_verbal(s: Column) -> Column:
    """Whether a stem shows a sign of a verb; plurals of nouns take some signs back."""
    n, plural = F.length(s), s.rlike("(ות|יים)$")
    sure = s.rlike("^(הת|מת|השת|הצט|הזד|הסת)") | (s.rlike("^(הו|מו)") & (n >= 4)) | ((n >= 4) & s.rlike("^ה.*י|^מ..*י")) | s.rlike("^.{2,}(תי|נו|תם|תן)$")
    open_sign = s.rlike("^נ[^אהוי]") | ((n >= 4) & s.rlike("^[למ]")) | ((n >= 4) & s.rlike("[^אהוי]{2}ו$|^[יתנא].*ו$"))
    return (n >= 3) & (sure | (~plural & open_sign))


_HE_STEM = "CASE WHEN length(a) > 2 AND a[1:2] = 'כש' THEN a[3:] WHEN length(a) > 3 AND a[1] = 'ש' THEN a[2:] ELSE a END"
_HE_PRE = "CASE WHEN length(w) > 2 AND w[1] = 'ו' THEN w[2:] ELSE w END"
_HE_STEMS = f"(SELECT w, a, {_HE_STEM} AS s FROM (SELECT w, {_HE_PRE} AS a FROM {words_in_sql('he')}))"
HE_STEM_SQL, HE_PRE_SQL = _HE_STEM, _HE_PRE
HE_VERBAL_SQL = (
    "length(s) >= 3 AND (s[1:2] IN ('הת', 'מת') OR s[1:3] IN ('השת', 'הצט', 'הזד', 'הסת') OR (s[1:2] IN ('הו', 'מו') AND length(s) >= 4) OR (length(s) >= 4 AND ((s[1] = 'ה' AND instr(s[2:], 'י') > 0) OR (s[1] = 'מ' AND instr(s[3:], 'י') > 0))) "
    "OR (length(s) >= 4 AND (ends_with(s, 'תי') OR ends_with(s, 'נו') OR ends_with(s, 'תם') OR ends_with(s, 'תן'))) OR (NOT (ends_with(s, 'ות') OR ends_with(s, 'יים')) AND ((s[1] = 'נ' AND s[2] NOT IN ('א', 'ה', 'ו', 'י')) OR (length(s) >= 4 AND s[1] IN ('ל', 'מ')) "
    "OR (length(s) >= 4 AND ends_with(s, 'ו') AND (s[1] IN ('י', 'ת', 'נ', 'א') OR NOT regexp_matches(s[-3:-2], '[אהוי]'))))))"
)


@query("he_proclitics", f"SELECT w, s AS stem, concat_ws('+', CASE WHEN a <> w THEN 'W' END, CASE WHEN length(a) > 2 AND a[1:2] = 'כש' THEN 'KESHE' WHEN length(a) > 3 AND a[1] = 'ש' THEN 'SHE' END) AS pre FROM {_HE_STEMS}")
def he_proclitics_query(spark, sf_dir):
    stem, pre = he_proclitics(F.col("w"))
    return words_in(spark, sf_dir, "he").select("w", stem.alias("stem"), pre.alias("pre"))


def he_pos(naked: Column, stem: Column) -> Column:
    """The part of speech of a word without points: numbers and marks, whole words of the closed classes, then the stem's own signs. Both should be columns, not expressions: they are read many times."""
    out = F.when(naked.rlike("[א-ת]"), None).when(naked.rlike("[0-9]"), "NUM").when(naked.rlike("^[^\\p{L}\\p{N}]+$"), "PUNCT").otherwise("X")
    closed = F.when(naked.isin(*hebrew.PRONOUNS), "PRON")
    for name, words in hebrew.CLASSES.items():
        closed = closed.when(naked.isin(*words), name)
    return F.coalesce(out, closed.when(stem.isin(*hebrew.PRONOUNS), "PRON").when(he_verbal(stem), "VERB").otherwise("NOUN"))
