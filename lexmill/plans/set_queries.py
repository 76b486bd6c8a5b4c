"""Joins, sets, splits, samples and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..lexicon.slots import EN_ALLOWED, SLOTS
from ..operators.vocab import ranks
from .derived import words_in, words_in_sql
from .measured import BUNDLES_SQL, bundles
from .registry import query
from .text_queries import place, rows, tok_sql, tokens, values_sql


def md5_bucket(c, n: int):
    """A bucket of [0, n) from a hash of the key: the same in every engine, where a random draw is not."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(n))


def _bucket_sql(c: str, n: int) -> str:
    return f"(('0x' || substr(md5({c}), 1, 8))::BIGINT % {n})"


@query("topk_tokens", f"WITH {tok_sql()} SELECT w, count(*) AS cnt FROM tok GROUP BY w ORDER BY cnt DESC, min((doc_id, pos)), w LIMIT 25")
def topk_tokens(spark, sf_dir):
    f = tokens(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("cnt"), F.min(place()).alias("first"))
    return f.orderBy(F.desc("cnt"), "first", "w").limit(25).select("w", "cnt")


@query("topk_per_group", f"WITH {tok_sql()}, f AS (SELECT lang, w, count(*) AS cnt FROM tok GROUP BY lang, w) SELECT lang, w, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, w) AS rank FROM f QUALIFY rank <= 10")
def topk_per_group(spark, sf_dir):
    """The rank's limit works in each task before the shuffle."""
    f = tokens(spark, sf_dir).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("cnt"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "w")).cast("long")).where("rank <= 10")


@query(
    "examples_topk",
    f"WITH {tok_sql()}, k AS (SELECT lang, length(w) AS len, w, min((doc_id, pos)) AS first FROM tok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, len ORDER BY first, w) AS rn FROM k) "
    "SELECT lang, len, string_agg(w, ' ' ORDER BY first, w) AS examples FROM r WHERE rn <= 3 GROUP BY lang, len",
)
def examples_topk(spark, sf_dir):
    k = tokens(spark, sf_dir).groupBy("lang", F.length("w").cast("long").alias("len"), "w").agg(F.min(place()).alias("first"))
    r = k.withColumn("rn", F.row_number().over(Window.partitionBy("lang", "len").orderBy("first", "w"))).where("rn <= 3")
    return r.groupBy("lang", "len").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "w"))), lambda x: x["w"]), " ").alias("examples"))


@query("balanced_cap", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), a AS (SELECT *, rn <= 8 AS in_cap FROM r) SELECT doc_id, source FROM (SELECT * FROM a ORDER BY in_cap DESC, doc_id LIMIT 180)")
def balanced_cap(spark, sf_dir):
    """Up to a cap from each source, then more in order of id up to the target.

    The cap's rank is limited in the tasks before the shuffle; what fills up comes from a limit over the rest.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    capped = d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 8").drop("rn")
    rest = d.join(capped.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(180)
    both = capped.withColumn("place", F.lit(0)).unionByName(rest.withColumn("place", F.lit(1)))
    return both.orderBy("place", "doc_id").limit(180).select("doc_id", "source")


@query("hash_split", f"SELECT split, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN {_bucket_sql("doc_id::VARCHAR", 100)} < 10 THEN 'test' WHEN {_bucket_sql("doc_id::VARCHAR", 100)} < 20 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY split")
def hash_split(spark, sf_dir):
    b = md5_bucket(F.col("doc_id").cast("string"), 100)
    s = F.when(b < 10, "test").when(b < 20, "val").otherwise("train")
    return table(spark, sf_dir, "documents").groupBy(s.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("shuffle_split", "WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('17' || item_id::VARCHAR), item_id) AS rn, count(*) OVER () AS n FROM benchmark) SELECT item_id, CASE WHEN rn <= floor(0.7 * n) THEN 'train' WHEN rn <= floor(0.85 * n) THEN 'val' ELSE 'test' END AS split FROM r")
def shuffle_split(spark, sf_dir):
    """A seeded order, then contiguous parts: ids are ranked within 65,536 buckets of their hash."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.concat(F.lit("17"), F.col("item_id").cast("string"))).alias("h"))
    r = ranks(b, F.left("h", F.lit(4)), ["h", "item_id"]).withColumnRenamed("_rank", "rn").join(F.broadcast(b.agg(F.count(F.lit(1)).alias("n"))))
    return r.select("item_id", F.when(F.col("rn") <= F.floor(0.7 * F.col("n")), "train").when(F.col("rn") <= F.floor(0.85 * F.col("n")), "val").otherwise("test").alias("split"))


@query("sample_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('5' || doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 5")
def sample_per_group(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("5"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("rn")).where("rn <= 5").drop("rn")


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_exact(spark, sf_dir):
    """Grouped by a 128-bit digest and the length, so texts are not shuffled."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))
    return d.groupBy("text_md5", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("n")


@query("union_sources", "SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY kind")
def union_sources(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), "text") for t in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_BENCH_TOK = r"bt AS (SELECT item_id, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS l FROM benchmark))"


def bench_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.posexplode(T.words("text")).alias("pos", "w"))


@query("except_sets", f"WITH {tok_sql()}, {_BENCH_TOK} SELECT 'benchmark only' AS side, count(*) AS n FROM (SELECT DISTINCT w FROM bt EXCEPT SELECT DISTINCT w FROM tok) UNION ALL SELECT 'documents only', count(*) FROM (SELECT DISTINCT w FROM tok EXCEPT SELECT DISTINCT w FROM bt)")
def except_sets(spark, sf_dir):
    a, b = bench_tokens(spark, sf_dir).select("w").distinct(), tokens(spark, sf_dir).select("w").distinct()
    n = lambda x, y, s: x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return n(a, b, "benchmark only").union(n(b, a, "documents only"))


@query("intersect_sets", f"WITH {tok_sql()}, {_BENCH_TOK} SELECT DISTINCT w FROM bt INTERSECT SELECT DISTINCT w FROM tok")
def intersect_sets(spark, sf_dir):
    return bench_tokens(spark, sf_dir).select("w").intersect(tokens(spark, sf_dir).select("w"))


@query("known_word_semi", f"WITH {tok_sql()}, {_BENCH_TOK} SELECT doc_id, count(*) AS known FROM tok WHERE w IN (SELECT w FROM bt) GROUP BY doc_id")
def known_word_semi(spark, sf_dir):
    return tokens(spark, sf_dir).join(bench_tokens(spark, sf_dir).select("w").distinct(), "w", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("known"))


@query("oov_anti", f"WITH {tok_sql()}, {_BENCH_TOK} SELECT item_id, pos, w FROM bt WHERE w NOT IN (SELECT w FROM tok WHERE lang = 'en')")
def oov_anti(spark, sf_dir):
    return bench_tokens(spark, sf_dir).join(tokens(spark, sf_dir, "en").select("w").distinct(), "w", "left_anti").select("item_id", F.col("pos").cast("long"), "w")


@query(
    "compositional_buckets",
    f"WITH {tok_sql()}, {_BENCH_TOK}, tr AS (SELECT DISTINCT left(w, 3) AS a, right(w, 2) AS b FROM tok WHERE length(w) >= 5), te AS (SELECT left(w, 3) AS a, right(w, 2) AS b FROM bt WHERE length(w) >= 5), "
    "x AS (SELECT te.*, EXISTS (SELECT 1 FROM tr WHERE tr.a = te.a AND tr.b = te.b) AS pair, te.a IN (SELECT a FROM tr) AS has_a, te.b IN (SELECT b FROM tr) AS has_b FROM te) SELECT CASE WHEN pair THEN 'seen' WHEN has_a AND has_b THEN 'heldout' ELSE 'novel' END AS bucket, count(*) AS n FROM x GROUP BY 1",
)
def compositional_buckets(spark, sf_dir):
    """Pairs of a root-like and a template-like part: seen together, seen apart, or new."""
    parts = lambda d: d.where(F.length("w") >= 5).select(F.left("w", F.lit(3)).alias("a"), F.right("w", F.lit(2)).alias("b"))
    tr, te = parts(tokens(spark, sf_dir)).distinct(), parts(bench_tokens(spark, sf_dir))
    x = te.join(tr.withColumn("pair", F.lit(True)), ["a", "b"], "left").join(tr.select("a").distinct().withColumn("has_a", F.lit(True)), "a", "left").join(tr.select("b").distinct().withColumn("has_b", F.lit(True)), "b", "left")
    return x.groupBy(F.when(F.col("pair"), "seen").when(F.col("has_a") & F.col("has_b"), "heldout").otherwise("novel").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_CONV = r"ct AS (SELECT conv_id, turn, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS l FROM conversations))"


@query(
    "occurrence_join",
    f"WITH {_CONV}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY pos) AS k FROM ct) SELECT a.conv_id, a.turn, count(*) AS n, count(b.pos) AS matched FROM k a LEFT JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w AND a.k = b.k GROUP BY 1, 2",
)
def occurrence_join(spark, sf_dir):
    """The k-th occurrence of a word in a turn meets the k-th in the next turn."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(T.words("text")).alias("pos", "w"))
    k = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "turn", "w").orderBy("pos")))
    nxt = k.select("conv_id", (F.col("turn") - 1).alias("turn"), "w", "k", F.col("pos").alias("other"))
    return k.join(nxt, ["conv_id", "turn", "w", "k"], "left").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count("other").alias("matched"))


# Bundle spaces -------------------------------------------------------------

_SLOT_ROWS = [(lang, pos, slot, v) for lang, ps in SLOTS.items() for pos, slots in ps.items() for slot, vs in (slots or {"": []}).items() for v in [None, *vs]]


def bundle_space(spark) -> DataFrame:
    """lang, pos, tags map: every combination of slot values of a part of speech, absent ones left out. A fixed space of some 31,000 rows."""
    out = None
    for lang, ps in SLOTS.items():
        for pos, slots in ps.items():
            d = spark.range(1).select(F.lit(lang).alias("lang"), F.lit(pos).alias("pos"), F.array().cast("array<struct<k:string,v:string>>").alias("e"))
            for slot, vs in slots.items():
                choice = F.explode(F.array(F.lit(None).cast("string"), *[F.lit(v) for v in vs]))
                d = d.select("lang", "pos", "e", choice.alias("v")).select("lang", "pos", F.when(F.col("v").isNull(), F.col("e")).otherwise(F.concat("e", F.array(F.struct(F.lit(slot).alias("k"), F.col("v").alias("v"))))).alias("e"))
            out = d if out is None else out.union(d)
    return out.select("lang", "pos", F.map_from_entries("e").alias("tags"))


def validate_expr():
    """Whether a bundle is allowed, by language."""
    t, keys = F.col("tags"), F.map_keys("tags")
    within = lambda names: F.size(F.array_except(keys, F.array(*[F.lit(x) for x in names]))) == 0
    v = lambda k: F.coalesce(F.try_element_at(t, F.lit(k)), F.lit(""))
    has = lambda *ks: F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ks]))
    en = F.lit(True)
    for pos, names in EN_ALLOWED.items():
        en = en & ((F.col("pos") != pos) | within(names))
    en = en & ~((F.col("pos") == "VERB") & (v("aspect") == "PERF") & ~v("tense").isin("PAST", "PRES", "")) & ~((F.col("pos") == "VERB") & (v("voice") == "PASS") & ~v("aspect").isin("PERF", "SIMPLE", ""))
    verb = has("tense") & has("person") & ~((v("tense") == "IMP") & ((v("person") != "2") | (v("voice") != "ACT"))) & ~((v("mood") == "JUS") & (v("tense") != "PRES")) & ~has("case", "def")
    exempt = v("role").isin("MASDAR", "VERBAL_NOUN", "PLURAL", "PROPER") | (v("diptote") == "YES")
    nom = ~has("tense", "person", "mood") & (exempt | has("num", "gender"))
    ar = F.when(F.col("pos") == "VERB", verb).when(F.col("pos") == "NOM", nom).when(F.col("pos") == "ADJ", ~has("tense", "person", "mood")).otherwise(True)
    tr = ~((F.col("pos") == "VERB") & (((v("mood") == "IMP") & ~v("person").isin("2", "")) | ((v("voice") == "CAUS") & (v("voice_base") == "PASS"))))
    from ..lexicon.slots import ZH_ALLOWED

    zh = F.lit(True)
    for pos, names in ZH_ALLOWED.items():
        zh = zh & ((F.col("pos") != pos) | within(names))
    zh = zh & v("aspect").isin("", "PERF", "DUR", "EXP", "PROG") & v("negation").isin("", "BU", "MEI", "BIE")
    return F.when(F.col("lang") == "en", en).when(F.col("lang") == "ar", ar).when(F.col("lang") == "tr", tr).otherwise(zh)


#: Sizes of the spaces and of their valid parts, worked out by hand from the tables of slots and rules.
_SIZES = [("zh", 547, 547), ("en", 95, 89), ("tr", 4382, 4382), ("ar", 26256, 9579)]


@query("slot_space", f"WITH s AS (SELECT lang, pos, slot, count(*) AS k FROM {values_sql('lang, pos, slot, v', _SLOT_ROWS)} GROUP BY ALL), p AS (SELECT lang, pos, round(exp(sum(ln(k))))::BIGINT AS possible FROM s GROUP BY lang, pos), o AS (SELECT pos, count(*) AS words FROM {BUNDLES_SQL} GROUP BY pos) SELECT lang, p.pos, possible, coalesce(words, 0) AS words FROM p LEFT JOIN o ON p.pos = o.pos AND lang = 'en'")
def slot_space(spark, sf_dir):
    """Possible bundles of each part of speech, and the words that fill the English ones."""
    space = bundle_space(spark).groupBy("lang", "pos").agg(F.count(F.lit(1)).alias("possible"))
    words = bundles(spark, sf_dir).groupBy("pos").agg(F.count(F.lit(1)).alias("words")).withColumn("lang", F.lit("en"))
    return space.join(words, ["lang", "pos"], "left").select("lang", "pos", "possible", F.coalesce("words", F.lit(0)).alias("words"))


_OBSERVED = f"(SELECT lang, count(DISTINCT bundle) AS observed FROM (SELECT 'en' AS lang, bundle FROM {BUNDLES_SQL}) GROUP BY lang)"


@query("bundle_space", f"SELECT s.lang, possible, valid, coalesce(observed, 0) AS observed FROM (SELECT * FROM {values_sql('lang, possible, valid', _SIZES)}) s LEFT JOIN {_OBSERVED} o ON o.lang = s.lang")
def bundle_space_sizes(spark, sf_dir):
    """Possible, valid and observed bundles."""
    space = bundle_space(spark).groupBy("lang").agg(F.count(F.lit(1)).alias("possible"), F.sum(validate_expr().cast("long")).alias("valid"))
    seen = bundles(spark, sf_dir).select("bundle").distinct().agg(F.count(F.lit(1)).alias("observed")).withColumn("lang", F.lit("en"))
    return space.join(seen, "lang", "left").select("lang", "possible", "valid", F.coalesce("observed", F.lit(0)).alias("observed"))


#: Bundles of words under the English rules: adjectives have no possessive, and a passive needs an aspect that allows it or none.
_JUDGED = f"(SELECT w, pos, CASE WHEN pos = 'ADJ' AND k2 = 'poss' THEN 'tag not allowed' WHEN pos = 'VERB' AND v2 = 'PASS' AND k1 = 'aspect' THEN 'voice against aspect' WHEN pos = 'ADV' AND k1 IS NOT NULL THEN 'tag not allowed' END AS reason FROM {BUNDLES_SQL})"


def _judge(b: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, pos, ok, reason of rows of bundles, internal tags left out."""
    b = b.select(*keep, "pos", F.str_to_map("tags", F.lit("[|]"), F.lit("=")).alias("tags"))
    b = b.select(*keep, "pos", F.map_filter("tags", lambda k, v: k != "").alias("tags"), F.lit("en").alias("lang"))
    extra = None
    for p, names in EN_ALLOWED.items():
        some = (F.col("pos") == p) & (F.size(F.array_except(F.map_keys("tags"), F.array(*[F.lit(x) for x in names]))) > 0)
        extra = some if extra is None else extra | some
    return b.select(*keep, "pos", validate_expr().alias("ok"), F.when(~validate_expr(), F.when(extra, "tag not allowed").otherwise("voice against aspect")).alias("reason"))


def judged(spark, sf_dir) -> DataFrame:
    """w, pos, ok, reason of the words' bundles."""
    return _judge(bundles(spark, sf_dir), "w")


@query("validate_bundle", f"SELECT w, reason IS NULL AS ok FROM {_JUDGED}")
def validate_bundle(spark, sf_dir):
    return judged(spark, sf_dir).select("w", "ok")


@query("classify_rejection", f"SELECT pos, reason, count(*) AS cnt FROM {_JUDGED} WHERE reason IS NOT NULL GROUP BY pos, reason")
def classify_rejection(spark, sf_dir):
    """Rejected words by the first rule that they fail."""
    # Words are counted by bundle and the few bundles judged; a filter on ok or reason would be moved to every word, so it is on the count.
    n = _judge(bundles(spark, sf_dir).groupBy("pos", "tags").agg(F.count(F.lit(1)).alias("n")), "n")
    return n.groupBy("pos", "reason").agg(F.sum(F.when(~F.col("ok"), F.col("n"))).alias("cnt")).where("cnt > 0")


@query("rejection_histogram", f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS cnt FROM {_JUDGED} GROUP BY 1")
def rejection_histogram(spark, sf_dir):
    return judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("cnt"))


@query("rejection_rate", f"SELECT pos, round(avg((reason IS NOT NULL)::INT), 6) AS rate FROM {_JUDGED} GROUP BY pos")
def rejection_rate(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("pos").agg(F.round(F.avg((~F.col("ok")).cast("int")), 6).alias("rate"))


_ALLOWED_SQL = "CASE pos " + " ".join(f"WHEN '{p}' THEN [{', '.join(repr(x) for x in names)}]" for p, names in EN_ALLOWED.items()) + " ELSE [] END"


@query("tag_filter", f"SELECT w, pos, array_to_string(list_sort(list_filter([k1 || '=' || v1, k2 || '=' || v2], lambda x: list_contains({_ALLOWED_SQL}, split_part(x, '=', 1)))), '|') AS kept FROM {BUNDLES_SQL} WHERE k1 IS NOT NULL AND k2 IS NOT NULL")
def tag_filter(spark, sf_dir):
    r = bundles(spark, sf_dir).where("k1 is not null and k2 is not null")
    allowed = None
    for p, names in EN_ALLOWED.items():
        a = F.array(*[F.lit(x) for x in names])
        allowed = F.when(F.col("pos") == p, a) if allowed is None else allowed.when(F.col("pos") == p, a)
    allowed = allowed.otherwise(F.array().cast("array<string>"))
    kept = F.map_filter(F.create_map("k1", "v1", "k2", "v2"), lambda k, v: F.array_contains(allowed, k))
    return r.select("w", "pos", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("kept"))


# Coarse classes of tags.
COARSE = [
    ("NOUN", "NOMINAL"),
    ("PROPN", "NOMINAL"),
    ("NOM", "NOMINAL"),
    ("NOUN_PROP", "NOMINAL"),
    ("NOUN_NUM", "NUM"),
    ("ADJ", "ADJ"),
    ("ADJ_COMP", "ADJ"),
    ("VERB", "VERB"),
    ("VERB_PSEUDO", "VERB"),
    ("AUX", "VERB"),
    ("ADV", "ADV"),
    ("ADP", "ADP"),
    ("PREP", "ADP"),
    ("PART", "PART"),
    ("PRON", "PRON"),
    ("DET", "DET"),
    ("NUM", "NUM"),
    ("CONJ", "CONJ"),
    ("CCONJ", "CONJ"),
    ("SCONJ", "CONJ"),
    ("CONJ_SUB", "CONJ"),
    ("PUNCT", "PUNCT"),
    ("CLF", "PART"),
]


@query("coarse_pos", f"SELECT w, coalesce(c, 'OTHER') AS coarse FROM {BUNDLES_SQL} LEFT JOIN (SELECT * FROM {values_sql('p, c', COARSE)}) ON pos = p")
def coarse_pos(spark, sf_dir):
    return bundles(spark, sf_dir).select("w", "pos").join(F.broadcast(rows(spark, "p string, c string", COARSE)), F.col("pos") == F.col("p"), "left").select("w", F.coalesce("c", F.lit("OTHER")).alias("coarse"))


@query("any_match", "SELECT doc_id, list_contains(string_split(lower(text), ' '), 'the') AS has_the, len(list_distinct(string_split(lower(text), ' ')))::BIGINT AS distinct_words FROM documents WHERE text IS NOT NULL")
def any_match(spark, sf_dir):
    w = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_contains(w, "the").alias("has_the"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


AFFIX = [("ler", "PL", 3), ("lar", "PL", 3), ("leri", "PL+POSS", 4), ("den", "ABL", 3), ("in", "GEN", 2), ("i", "ACC", 1)]
@query("argmax_decomp", f"SELECT w, suffix, tag FROM (SELECT w, suffix, tag, row_number() OVER (PARTITION BY w ORDER BY score DESC, suffix) AS rn FROM {words_in_sql('tr')} JOIN (SELECT * FROM {values_sql('suffix, tag, score', AFFIX)}) ON ends_with(w, suffix) AND length(w) - length(suffix) >= 2) WHERE rn = 1")
def argmax_decomp(spark, sf_dir):
    """A word against a small affix table by its ending; the best score wins, by one aggregation."""
    a = F.broadcast(rows(spark, "suffix string, tag string, score int", AFFIX))
    x = words_in(spark, sf_dir, "tr").join(a, F.expr("endswith(w, suffix) and length(w) - length(suffix) >= 2"))
    return x.groupBy("w").agg(F.min_by(F.struct("suffix", "tag"), F.struct(-F.col("score"), "suffix")).alias("b")).select("w", "b.suffix", "b.tag")
