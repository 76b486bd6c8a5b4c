"""Stream projections, closed vocabularies, run states, costs and further splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..lexicon import english_words as E
from ..operators.vocab import ranks
from .derived import texts_in, texts_in_sql, words_in, words_in_sql
from .registry import query
from .set_queries import _bucket_sql, md5_bucket
from .stat_queries import SEG_SQL, segmented
from .text_queries import rows, tok_sql, tokens, values_sql


@query("stream_projection", f"WITH {SEG_SQL} SELECT coalesce(nullif(root, ''), surface) || '+' || CASE WHEN tag LIKE 'SUF%' THEN 'pos=X|suf=' || substr(tag, 5) ELSE 'no_features' END AS composite, count(*) AS cnt FROM seg GROUP BY 1")
def stream_projection(spark, sf_dir):
    """root + bundle of each word; a missing root is the surface."""
    tags = F.when(F.col("tag").startswith("SUF"), F.create_map(F.lit("suf"), F.substr("tag", F.lit(5)))).otherwise(F.create_map().cast("map<string,string>"))
    c = F.concat(F.coalesce(F.nullif(F.col("root"), F.lit("")), F.col("surface")), F.lit("+"), T.feature_bundle(F.lit("X"), tags))
    return segmented(spark, sf_dir).groupBy(c.alias("composite")).agg(F.count(F.lit(1)).alias("cnt"))


#: Roots are the first three letters of words in Arabic letters, in the order in which a lexicon, the documents by id, has them.
_PLACES = rf"(SELECT (id, i) AS place, left(w, 3) AS root FROM (SELECT id, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM (SELECT id, regexp_extract_all(t, '\S+') AS l FROM {texts_in_sql('ar', 'benchmark', 'item_id')})))"


@query("closed_vocab", f"SELECT root, 3 + row_number() OVER (ORDER BY min(place)) AS id FROM {_PLACES} GROUP BY root")
def closed_vocab(spark, sf_dir):
    t = texts_in(spark, sf_dir, "ar", "benchmark", "item_id").select("id", F.posexplode(F.regexp_extract_all("t", F.lit("\\S+"), F.lit(0))).alias("i", "w"))
    f = t.select(F.struct("id", "i").alias("place"), F.left("w", F.lit(3)).alias("root")).groupBy("root").agg(F.min("place").alias("first"))
    return f.select("root", (3 + F.row_number().over(Window.orderBy("first"))).cast("long").alias("id"))


_STATES = "(SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 100 AS age, o_orderpriority LIKE '1%' AS retry FROM orders)"


@query("run_state", f"SELECT run, CASE WHEN status = 'completed' THEN 'skip_completed' WHEN status = 'failed' AND NOT retry THEN 'skip_failed' WHEN status = 'running' AND age <= 60 THEN 'skip_running_fresh' ELSE 'run' END AS outcome FROM {_STATES}")
def run_state(spark, sf_dir):
    s = F.col("status")
    o = F.when(s == "completed", "skip_completed").when((s == "failed") & ~F.col("retry"), "skip_failed").when((s == "running") & (F.col("age") <= 60), "skip_running_fresh").otherwise("run")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), status.alias("status"), (F.col("o_orderkey") % 100).alias("age"), F.col("o_orderpriority").startswith("1").alias("retry"))
    return jobs.select("run", o.alias("outcome"))


PRICES = [("F", 1.5, 0.4), ("O", 4.0, 0.1)]
_JOBS = "(SELECT o_orderstatus AS instance, count(*) AS m FROM orders GROUP BY o_orderstatus)"


@query("cost_estimate", f"SELECT j.instance, p.price IS NOT NULL AS known, round(m * h, 2) AS hours, round(m * h * price * 0.8, 2) AS low, round(m * h * price * 1.5, 2) AS high FROM {_JOBS} j LEFT JOIN {values_sql('instance, price, h', PRICES).replace('AS t(', 'AS p(')} ON j.instance = p.instance")
def cost_estimate(spark, sf_dir):
    j = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("instance")).agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(rows(spark, "instance string, price double, h double", PRICES)), "instance", "left")
    hours = F.col("m") * F.col("h")
    return j.select("instance", F.col("price").isNotNull().alias("known"), F.round(hours, 2).alias("hours"), F.round(hours * F.col("price") * 0.8, 2).alias("low"), F.round(hours * F.col("price") * 1.5, 2).alias("high"))


_STREAMS = f"(WITH {tok_sql()} SELECT lang AS stream, count(DISTINCT w) AS vocab, 64 * length(lang) AS dim FROM tok GROUP BY lang)"


@query("parameter_breakdown", f"SELECT stream, vocab * dim AS embedding, (vocab * width)::BIGINT AS head FROM {_STREAMS} s, (SELECT sum(dim) AS width FROM {_STREAMS}) d")
def parameter_breakdown(spark, sf_dir):
    s = tokens(spark, sf_dir).select("lang", "w").distinct().groupBy(F.col("lang").alias("stream")).agg(F.count(F.lit(1)).alias("vocab")).withColumn("dim", (64 * F.length("stream")).cast("long"))
    width = F.broadcast(s.agg(F.sum("dim").alias("width")))
    return s.join(width).select("stream", (F.col("vocab") * F.col("dim")).alias("embedding"), (F.col("vocab") * F.col("width")).cast("long").alias("head"))


@query(
    "shuffled_control",
    r"WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS l FROM documents WHERE text IS NOT NULL AND lang = 'en'), s AS (SELECT doc_id, list_sort(list_transform(range(0, len(l)), lambda i: {'h': md5('3' || i::VARCHAR), 'i': i, 'w': l[i + 1]})) AS x FROM d) "
    "SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(list_transform(x, lambda e: e.w)) AS w FROM s",
)
def shuffled_control(spark, sf_dir):
    """Each document's words dealt anew over its places by a seeded hash: one array a document, no shuffle."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'")
    dealt = F.array_sort(F.transform(T.words("text"), lambda w, i: F.struct(F.md5(F.concat(F.lit("3"), i.cast("string"))).alias("h"), i.alias("i"), w.alias("w"))))
    return d.select("doc_id", F.posexplode(F.transform(dealt, lambda x: x["w"])).alias("pos", "w")).select("doc_id", F.col("pos").cast("long"), "w")


@query("head_tail_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM labels) SELECT CASE WHEN rn <= floor(0.8 * n) THEN 'head' ELSE 'tail' END AS part, count(*) AS n, min(doc_id) AS first_doc FROM r GROUP BY 1")
def head_tail_split(spark, sf_dir):
    """Ids in order, ranked within buckets of 4,096 ids, so no task gets all or most of them."""
    ids = table(spark, sf_dir, "labels").select("doc_id")
    r = ranks(ids, F.floor(F.col("doc_id") / 4096), ["doc_id"]).join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n"))))
    part = F.when(F.col("_rank") <= F.floor(0.8 * F.col("_n")), "head").otherwise("tail")
    return r.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("split_cap", f"WITH s AS (SELECT doc_id, CASE WHEN {_bucket_sql('doc_id::VARCHAR', 10)} = 0 THEN 2 WHEN {_bucket_sql('doc_id::VARCHAR', 10)} = 1 THEN 1 ELSE 0 END AS split FROM documents) SELECT doc_id, split FROM s ORDER BY split, doc_id LIMIT 170")
def split_cap(spark, sf_dir):
    """A cap over train, then val, then test."""
    b = md5_bucket(F.col("doc_id").cast("string"), 10)
    s = table(spark, sf_dir, "documents").select("doc_id", F.when(b == 0, 2).when(b == 1, 1).otherwise(0).alias("split"))
    return s.orderBy("split", "doc_id").limit(170)


@query("random_windows", f"WITH {tok_sql("lang = 'en'")}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), o AS (SELECT doc_id, {_bucket_sql("'9' || doc_id::VARCHAR", 1000003)} % greatest(1, n - 32) AS start FROM n) SELECT o.doc_id, o.start, count(*) AS size, min(w) AS least FROM o JOIN tok ON tok.doc_id = o.doc_id AND pos >= start AND pos < start + 32 GROUP BY 1, 2")
def random_windows(spark, sf_dir):
    """One window of each document at a seeded offset, cut out of its array of words."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'").select("doc_id", T.words("text").alias("ws")).where(F.size("ws") > 0)
    start = md5_bucket(F.concat(F.lit("9"), F.col("doc_id").cast("string")), 1000003) % F.greatest(F.lit(1), F.size("ws") - 32)
    x = d.select("doc_id", start.alias("start"), "ws").select("doc_id", "start", F.slice("ws", F.col("start").cast("int") + 1, 32).alias("win"))
    return x.select("doc_id", "start", F.size("win").cast("long").alias("size"), F.array_min("win").alias("least"))


@query("question_context", "SELECT a.conv_id, a.turn, left(a.text || ' [SEP] ' || b.text, 80) AS joined FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def question_context(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).where("text is not null and answer is not null").select("conv_id", "turn", F.left(F.concat_ws(" [SEP] ", "text", "answer"), F.lit(80)).alias("joined"))


@query("zh_split", f"SELECT id, len(list_filter(string_split(regexp_replace(t, '([。！？；….!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS n FROM {texts_in_sql('zh')}")
def zh_split(spark, sf_dir):
    parts = F.filter(F.split("t", "(?<=[。！？；….!?;])"), lambda x: x != "")
    return texts_in(spark, sf_dir, "zh").select("id", F.size(parts).cast("long").alias("n"))


_AGENT = f"(SELECT w, left(w, length(w) - 2) AS base FROM {words_in_sql('latin')} WHERE length(w) > 2) AS t(w, base)"
_KINDS = "(VALUES " + ", ".join([*(f"('{w}', 'ADJ')" for w in E.ADJECTIVES), *(f"('{w}', 'VERB')" for w in E.VERBS if w not in E.ADJECTIVES)]) + ") AS k(base, kind)"


@query("en_agent", f"SELECT t.w, t.base, CASE WHEN kind = 'ADJ' THEN 'COMP' WHEN kind = 'VERB' AND regexp_matches(t.w, '(er|or|ar)$') THEN 'AGENT' ELSE 'WHOLE' END AS reading FROM {_AGENT} LEFT JOIN {_KINDS} ON k.base = t.base")
def en_agent(spark, sf_dir):
    """A comparative wins if the base is an adjective; an agent needs a known verb. The lists are injected."""
    known = F.broadcast(spark.createDataFrame([*((w, "ADJ") for w in E.ADJECTIVES), *((w, "VERB") for w in E.VERBS if w not in E.ADJECTIVES)], "base string, kind string"))
    r = F.when(F.col("kind") == "ADJ", "COMP").when((F.col("kind") == "VERB") & F.col("w").rlike("(er|or|ar)$"), "AGENT").otherwise("WHOLE")
    words = words_in(spark, sf_dir, "latin").where("length(w) > 2").selectExpr("w", "left(w, length(w) - 2) AS base")
    return words.join(known, "base", "left").select("w", "base", r.alias("reading"))


@query("ready_splits", "SELECT lang, count(*) AS n, count(*) >= 100 AS ready FROM documents GROUP BY lang")
def ready_splits(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("ready", F.col("n") >= 100)


@query("bundle_profile", f"WITH {SEG_SQL} SELECT round(avg((tag LIKE 'SUF%')::INT), 6) AS avg_tags, round(count(DISTINCT root) / count(DISTINCT surface), 6) AS vocab_compression, count(DISTINCT tag) AS bundles FROM seg")
def bundle_profile(spark, sf_dir):
    return segmented(spark, sf_dir).agg(F.round(F.avg(F.col("tag").startswith("SUF").cast("int")), 6).alias("avg_tags"), F.round(F.count_distinct("root") / F.count_distinct("surface"), 6).alias("vocab_compression"), F.count_distinct("tag").alias("bundles"))
