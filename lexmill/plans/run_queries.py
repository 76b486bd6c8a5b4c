"""Run logs, scores and training-curve statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import table
from ..operators import stats
from .derived import words_in, words_in_sql
from .measured import RUNS_SQL, SEEDS_SQL, runs, seeds
from .registry import query

_RUNS = RUNS_SQL


def _pair(spark, sf_dir):
    """One row a language with both regimes' values: one aggregation instead of a self-join."""
    at = lambda c, r: F.max(F.when(F.col("regime") == r, F.col(c)))
    return runs(spark, sf_dir).groupBy("lang").agg(at("loss", "baseline").alias("base_loss"), at("loss", "morph").alias("morph_loss"), at("ppl", "baseline").alias("base_ppl"), at("ppl", "morph").alias("morph_ppl"))


_PAIR = f"(SELECT lang, max(loss) FILTER (regime = 'baseline') AS base_loss, max(loss) FILTER (regime = 'morph') AS morph_loss, max(ppl) FILTER (regime = 'baseline') AS base_ppl, max(ppl) FILTER (regime = 'morph') AS morph_ppl FROM {_RUNS} GROUP BY lang)"


@query("regime_pair", f"SELECT lang, base_loss, morph_loss, base_loss IS NOT NULL AS has_baseline, morph_loss IS NOT NULL AS has_morph FROM {_PAIR}")
def regime_pair(spark, sf_dir):
    return _pair(spark, sf_dir).select("lang", "base_loss", "morph_loss", F.col("base_loss").isNotNull().alias("has_baseline"), F.col("morph_loss").isNotNull().alias("has_morph"))


@query("rebate", f"SELECT lang, round(base_loss - morph_loss, 6) AS delta_loss, round(100 * (morph_ppl - base_ppl) / base_ppl, 6) AS delta_ppl_pct FROM {_PAIR} WHERE base_loss IS NOT NULL AND morph_loss IS NOT NULL")
def rebate(spark, sf_dir):
    return _pair(spark, sf_dir).where("base_loss is not null and morph_loss is not null").select("lang", F.round(F.col("base_loss") - F.col("morph_loss"), 6).alias("delta_loss"), F.round(100 * (F.col("morph_ppl") - F.col("base_ppl")) / F.col("base_ppl"), 6).alias("delta_ppl_pct"))


@query("ppl_ratio", f"SELECT lang, round(morph_ppl / base_ppl, 6) AS ratio, CASE WHEN morph_ppl < base_ppl THEN 'better' WHEN morph_ppl > base_ppl THEN 'worse' ELSE 'same' END AS direction FROM {_PAIR} WHERE morph_ppl IS NOT NULL")
def ppl_ratio(spark, sf_dir):
    d = F.when(F.col("morph_ppl") < F.col("base_ppl"), "better").when(F.col("morph_ppl") > F.col("base_ppl"), "worse").otherwise("same")
    return _pair(spark, sf_dir).where("morph_ppl is not null").select("lang", F.round(F.col("morph_ppl") / F.col("base_ppl"), 6).alias("ratio"), d.alias("direction"))


#: A language's share of its words' entropy that the second pieces add.
_HL = f"(SELECT lang, round((max(loss) FILTER (regime = 'baseline') - max(loss) FILTER (regime = 'morph')) / ln(2), 6) AS rho_h FROM {_RUNS} GROUP BY lang)"


@query("summary_table", f"SELECT l.lang, g.regime, r.loss, h.rho_h FROM (SELECT DISTINCT lang FROM {_RUNS}) l CROSS JOIN (SELECT unnest(['baseline', 'morph']) AS regime) g LEFT JOIN (SELECT * FROM {_RUNS}) r ON r.lang = l.lang AND r.regime = g.regime LEFT JOIN {_HL} h ON h.lang = l.lang")
def summary_table(spark, sf_dir):
    """Languages by regimes, made by exploding the fixed list of regimes, with what is known of each."""
    h = _pair(spark, sf_dir).select("lang", F.round((F.col("base_loss") - F.col("morph_loss")) / F.log(F.lit(2.0)), 6).alias("rho_h"))
    grid = runs(spark, sf_dir).select("lang").distinct().select("lang", F.explode(F.array(F.lit("baseline"), F.lit("morph"))).alias("regime"))
    return grid.join(runs(spark, sf_dir).select("lang", "regime", "loss"), ["lang", "regime"], "left").join(h, "lang", "left").select("lang", "regime", "loss", "rho_h")


@query("run_grid", "SELECT source || '_' || lang || '_' || regime AS run_id, source AS rung, lang, regime FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents), (SELECT unnest(['baseline', 'morph']) AS regime)")
def run_grid(spark, sf_dir):
    """Every source by every language by both regimes: the result is the grid, so its sides are exploded from arrays of distinct values."""
    d = table(spark, sf_dir, "documents").agg(F.collect_set("source").alias("sources"), F.collect_set("lang").alias("langs"))
    g = d.select(F.explode("sources").alias("rung"), "langs").select("rung", F.explode("langs").alias("lang")).select("rung", "lang", F.explode(F.array(F.lit("baseline"), F.lit("morph"))).alias("regime"))
    return g.select(F.concat_ws("_", "rung", "lang", "regime").alias("run_id"), "rung", "lang", "regime")


#: Ids of runs, one a document; a third of them are no runs.
_IDS = "(SELECT CASE doc_id % 3 WHEN 0 THEN replace(source, 'src', 'r') || '_' || lang || '_morph' WHEN 1 THEN replace(source, 'src', 'r') || '_' || lang || '_baseline' ELSE source || '_notes' END AS run_id FROM documents) AS t(run_id)"


@query("run_id_parse", f"SELECT run_id, regexp_extract(run_id, '^(r\\d+)_([a-z]{{2}})_(baseline|morph)$', 1) AS rung, regexp_extract(run_id, '^(r\\d+)_([a-z]{{2}})_(baseline|morph)$', 2) AS lang FROM {_IDS} WHERE regexp_matches(run_id, '^(r\\d+)_([a-z]{{2}})_(baseline|morph)$')")
def run_id_parse(spark, sf_dir):
    p = "^(r\\d+)_([a-z]{2})_(baseline|morph)$"
    ids = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace("source", F.lit("src"), F.lit("r")), F.lit("_"), "lang", F.lit("_morph"))).when(F.col("doc_id") % 3 == 1, F.concat(F.replace("source", F.lit("src"), F.lit("r")), F.lit("_"), "lang", F.lit("_baseline"))).otherwise(F.concat("source", F.lit("_notes")))
    return table(spark, sf_dir, "documents").select(ids.alias("run_id")).where(F.col("run_id").rlike(p)).select("run_id", F.regexp_extract("run_id", p, 1).alias("rung"), F.regexp_extract("run_id", p, 2).alias("lang"))


@query("seed_stats", f"SELECT cell, count(*) AS n, round(avg(bpc), 6) AS mean_bpc, round(stddev_pop(bpc), 6) AS sd_bpc, round(max(bpc) / min(bpc), 6) AS spread FROM (SELECT regexp_replace(cell, '_s[^_]*$', '') AS cell, bpc FROM {SEEDS_SQL}) GROUP BY cell")
def seed_stats(spark, sf_dir):
    r = seeds(spark, sf_dir).select(F.regexp_replace("cell", "_s[^_]*$", "").alias("cell"), "bpc")
    return r.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bpc"), 6).alias("mean_bpc"), F.round(F.stddev_pop("bpc"), 6).alias("sd_bpc"), F.round(F.max("bpc") / F.min("bpc"), 6).alias("spread"))


@query("results_rollup", f"SELECT lang, count(*) AS n, round(sum(loss * tokens) / sum(tokens), 6) AS weighted_loss, round(exp(least(sum(loss * tokens) / sum(tokens), 20)), 4) AS ppl, round(sum(loss * tokens) / sum(tokens) / ln(2) * 1.3, 6) AS bpc FROM {_RUNS} GROUP BY lang")
def results_rollup(spark, sf_dir):
    w = F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")
    return runs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(w, 6).alias("weighted_loss"), F.round(F.exp(F.least(w, F.lit(20.0))), 4).alias("ppl"), F.round(w / F.log(F.lit(2.0)) * 1.3, 6).alias("bpc"))


@query("weighted_loss", "SELECT event_type, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS loss, round(exp(least(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 20)), 2) AS ppl FROM events WHERE value IS NOT NULL GROUP BY event_type")
def weighted_loss(spark, sf_dir):
    n = F.col("user_id") % 7 + 1
    w = F.sum(F.col("value") * n) / F.sum(n)
    return table(spark, sf_dir, "events").where("value is not null").groupBy("event_type").agg(F.round(w, 6).alias("loss"), F.round(F.exp(F.least(w, F.lit(20.0))), 2).alias("ppl"))


@query("bpc", r"SELECT lang, round(2.5 / ln(2) * sum(len(regexp_extract_all(text, '\S+'))) / sum(length(text)), 6) AS bpc FROM documents WHERE text IS NOT NULL GROUP BY lang")
def bpc(spark, sf_dir):
    from ..functions import text as T

    f = F.sum(F.size(T.words("text"))) / F.sum(F.length("text"))
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("lang").agg(F.round(F.lit(2.5) / F.log(F.lit(2.0)) * f, 6).alias("bpc"))


@query("ols_origin", "SELECT event_type, count(*) AS n, round(sum(x * value) / sum(x * x), 6) AS slope, round(sqrt(greatest(0, (sum(value * value) - 2 * (sum(x * value) / sum(x * x)) * sum(x * value) + (sum(x * value) / sum(x * x)) ** 2 * sum(x * x)) / count(*))), 4) AS rmse FROM (SELECT event_type, value, (user_id % 50)::DOUBLE AS x FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def ols_origin(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value", (F.col("user_id") % 50).cast("double").alias("x"))
    return stats.ols_origin(e, "x", "value", ("event_type",)).select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("rmse", 4).alias("rmse"))


@query("macro_f1", "WITH c AS (SELECT toxic AS p, 1 - quality AS t FROM labels), s AS (SELECT count(*) AS n, avg((p = t)::INT) AS acc, sum((p = 0 AND t = 0)::INT) AS a0, sum((p = 0 AND t <> 0)::INT) AS f0, sum((p <> 0 AND t = 0)::INT) AS m0, sum((p = 1 AND t = 1)::INT) AS a1, sum((p = 1 AND t <> 1)::INT) AS f1, sum((p <> 1 AND t = 1)::INT) AS m1 FROM c), r AS (SELECT *, a0 / (a0 + f0 + 1e-9) AS p0, a0 / (a0 + m0 + 1e-9) AS r0, a1 / (a1 + f1 + 1e-9) AS p1, a1 / (a1 + m1 + 1e-9) AS r1 FROM s) SELECT n, round(acc, 6) AS accuracy, round((2 * p0 * r0 / (p0 + r0 + 1e-9) + 2 * p1 * r1 / (p1 + r1 + 1e-9)) / 2, 6) AS macro_f1 FROM r")
def macro_f1(spark, sf_dir):
    c = table(spark, sf_dir, "labels").select(F.col("toxic").alias("p"), (1 - F.col("quality")).alias("t"))
    return stats.macro_f1(c, "p", "t").select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("gini", "WITH r AS (SELECT o_orderpriority AS g, o_totalprice::DOUBLE AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT g, max(n) AS n, round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 6) AS gini FROM r GROUP BY g")
def gini(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").cast("double").alias("v"))
    return stats.gini(o, "v", ("g",)).select("g", "n", F.round("gini", 6).alias("gini"))


_GOLD = f"(SELECT w AS word, regexp_replace(w, '(s|ed|ing)$', '') AS gold, CASE WHEN length(w) <= 3 THEN 'function' WHEN regexp_matches(w, '[^A-Za-z]') THEN 'foreign' WHEN ends_with(w, 's') THEN 'corrected' ELSE 'agree' END AS source, regexp_replace(w, '(s|ing)$', '') AS answer FROM {words_in_sql('latin')}) AS t(word, gold, source, answer)"


def _gold(spark, sf_dir):
    """word, gold, source, answer: a rule with three endings judges one with two."""
    w = F.col("w")
    source = F.when(F.length(w) <= 3, "function").when(w.rlike("[^A-Za-z]"), "foreign").when(w.endswith("s"), "corrected").otherwise("agree")
    return words_in(spark, sf_dir, "latin").select(w.alias("word"), F.regexp_replace(w, "(s|ed|ing)$", "").alias("gold"), source.alias("source"), F.regexp_replace(w, "(s|ing)$", "").alias("answer"))


@query("gold_scorecard", f"SELECT count(*) AS n, count(*) FILTER (source IN ('agree', 'corrected')) AS scored, count(*) FILTER (source IN ('agree', 'corrected') AND gold = answer) AS right_answers, count(*) FILTER (source NOT IN ('agree', 'corrected')) AS excluded, round(count(*) FILTER (source IN ('agree', 'corrected') AND gold = answer) / count(*) FILTER (source IN ('agree', 'corrected')), 6) AS rate FROM {_GOLD}")
def gold_scorecard(spark, sf_dir):
    scored = F.col("source").isin("agree", "corrected")
    hit = F.count_if(scored & (F.col("gold") == F.col("answer")))
    return _gold(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(scored).alias("scored"), hit.alias("right_answers"), F.count_if(~scored).alias("excluded"), F.round(F.coalesce(F.try_divide(hit, F.count_if(scored)), F.lit(0.0)), 6).alias("rate"))


#: Words beside themselves without their last letter, and infinitives beside their stems.
_MATCHES = f"(SELECT a, b FROM (SELECT w AS a, left(w, length(w) - 1) AS b FROM {words_in_sql('tr')} UNION ALL SELECT w || 'mek', w FROM {words_in_sql('tr')})) AS t(a, b)"


@query("lemma_match", f"SELECT a, b, a = b OR a || 'e' = b OR a = b || 'e' AS en_ok, regexp_replace(CASE WHEN length(a) > 4 AND (a LIKE '%mak' OR a LIKE '%mek') THEN left(a, length(a) - 3) ELSE a END, '$', '') = b AS tr_ok FROM {_MATCHES}")
def lemma_match(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    stem = F.when((F.length(a) > 4) & a.rlike("m[ae]k$"), F.substr(a, F.lit(1), F.length(a) - 3)).otherwise(a)
    words = words_in(spark, sf_dir, "tr")
    pairs = words.selectExpr("w AS a", "left(w, length(w) - 1) AS b").unionByName(words.selectExpr("w || 'mek' AS a", "w AS b"))
    return pairs.select("a", "b", ((a == b) | (F.concat(a, F.lit("e")) == b) | (a == F.concat(b, F.lit("e")))).alias("en_ok"), (stem == b).alias("tr_ok"))


_E = "(SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL AND user_id % 10 = 0)"


@query("ema", f"WITH RECURSIVE e AS {_E}, r AS (SELECT user_id, k, value AS ema FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, 0.9 * r.ema + 0.1 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, max(k) AS steps, round(arg_max(ema, k), 6) AS ema FROM r GROUP BY user_id".replace(" AND user_id % 10 = 0", ""))
def ema(spark, sf_dir):
    """A recursion over the ordered values of one user."""
    e = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    fold = F.aggregate("v", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["value"]).otherwise(0.9 * acc + 0.1 * x["value"]))
    return e.select("user_id", F.size("v").cast("long").alias("steps"), F.round(fold, 6).alias("ema"))


@query("lr_schedule", "SELECT step, round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * (step - 100) / 900.0)) END, 9) AS lr FROM (SELECT DISTINCT event_id % 1000 AS step FROM events)")
def lr_schedule(spark, sf_dir):
    s = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("step")).distinct()
    return s.select("step", F.round(F.when(F.col("step") < 100, 0.001 * (F.col("step") + 1) / 100).otherwise(0.0001 + 0.5 * 0.0009 * (1 + F.cos(F.pi() * (F.col("step") - 100) / 900.0))), 9).alias("lr"))


@query("stale_runs", "SELECT event_type, count(*) AS n, sum(((epoch(n.now) - epoch(ts)) / 60 > 1440)::INT)::BIGINT AS stale FROM events, (SELECT max(ts) AS now FROM events) n GROUP BY event_type")
def stale_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "ts")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6
    return e.join(now).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((age > 1440).cast("int")).alias("stale"))


@query("last_record", "SELECT user_id, arg_max(event_id, ts * 1) AS last_event FROM (SELECT user_id, event_id, epoch_us(ts) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY user_id")
def last_record(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("dangling_refs", "SELECT count(*) AS n, count(DISTINCT l.doc_id) AS docs FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def dangling_refs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").join(d, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("pad_truncate", "SELECT doc_id, array_to_string((ids || [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ' ') AS ids FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents WHERE text IS NOT NULL)")
def pad_truncate(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(F.concat(ids, F.array_repeat(F.lit(0), 8)), 1, 8).cast("array<string>"), " ").alias("ids"))


@query("nearest_crossing", "SELECT t AS target, arg_min(n, (abs(y - t), n)) AS nearest FROM (SELECT o_orderkey AS n, o_totalprice::DOUBLE AS y FROM orders), (SELECT unnest([50000.0::DOUBLE, 150000.0::DOUBLE]) AS t) GROUP BY t")
def nearest_crossing(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_totalprice").cast("double").alias("y"), F.explode(F.array(F.lit(50000.0), F.lit(150000.0))).alias("target"))
    return x.groupBy("target").agg(F.min_by("n", F.struct(F.abs(F.col("y") - F.col("target")), "n")).alias("nearest"))


@query("mean_pooling", "WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) SELECT label, i, round(avg(v::DOUBLE), 4) AS mean FROM e GROUP BY label, i")
def mean_pooling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("mean"))


