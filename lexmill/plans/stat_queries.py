"""Segmentation, counts, entropies, vocabularies and encodings over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..functions import text as T
from ..io import table
from ..lexicon.affixes import EDGE
from ..morph import shallow
from ..operators import stats, vocab
from .registry import query
from .text_queries import place, tok_sql, tokens

_EDGE_SQL = EDGE.replace("'", "''")
_W = f"trim(lower(w), '{_EDGE_SQL}')"
_SUF = shallow.segment_sql("w")
#: Segmented English words.
SEG_SQL = (
    f"{tok_sql("lang = 'en'")}, lw AS (SELECT doc_id, pos, w AS surface, {_W} AS w FROM tok), sx AS (SELECT *, {_SUF} AS suf FROM lw), "
    "seg AS (SELECT doc_id, pos, surface, CASE WHEN suf IS NULL THEN w ELSE substr(w, 1, length(w) - length(suf)) END AS root, CASE WHEN w = '' THEN 'O' WHEN suf IS NULL THEN 'ROOT' ELSE 'SUF_' || suf END AS tag FROM sx)"
)


def segmented(spark, sf_dir) -> DataFrame:
    """doc_id, pos, surface, root, tag of English words where they stand, for streams that keep places; without a shuffle."""
    return shallow.with_segments(tokens(spark, sf_dir, "en").select("doc_id", "pos", F.col("w").alias("surface")), "surface")


def segmented_words(spark, sf_dir) -> DataFrame:
    """surface, cnt, root, tag: words are counted first, and each distinct one is segmented once."""
    n = stats.freq(tokens(spark, sf_dir, "en").select(F.col("w").alias("surface")), "surface")
    return shallow.with_segments(n, "surface")


def summed(counts: DataFrame, *cols: str) -> DataFrame:
    """Counts by fewer columns."""
    return counts.groupBy(*cols).agg(F.sum("cnt").alias("cnt"))


@query("shallow_segment", f"WITH {SEG_SQL} SELECT root, tag, count(*) AS cnt FROM seg GROUP BY root, tag")
def shallow_segment(spark, sf_dir):
    return summed(segmented_words(spark, sf_dir), "root", "tag")


@query("token_freq", f"WITH {tok_sql()} SELECT lang, w, count(*) AS cnt FROM tok GROUP BY lang, w")
def token_freq(spark, sf_dir):
    return stats.freq(tokens(spark, sf_dir), "lang", "w")


_H = "SELECT sum(cnt)::BIGINT AS n, count(*) AS distinct_values, log2(sum(cnt)::DOUBLE) - sum(cnt * log2(cnt::DOUBLE)) / sum(cnt) AS h"


@query("bundle_entropy", f"WITH {SEG_SQL}, c AS (SELECT tag, count(*) AS cnt FROM seg GROUP BY tag) SELECT n, distinct_values, round(h, 6) AS h FROM ({_H} FROM c)")
def bundle_entropy(spark, sf_dir):
    return stats.entropy(summed(segmented_words(spark, sf_dir), "tag")).select("n", "distinct_values", F.round("h", 6).alias("h"))


_HC = (
    "SELECT sum(nc)::BIGINT AS n, sum(nc * log2(nc::DOUBLE) - s) / sum(nc) AS h_cond FROM (SELECT cond, sum(cnt) AS nc, sum(cnt * log2(cnt::DOUBLE)) AS s FROM j GROUP BY cond)"
)


@query("conditional_entropy", f"WITH {SEG_SQL}, j AS (SELECT root AS cond, tag, count(*) AS cnt FROM seg GROUP BY ALL) SELECT n, round(h_cond, 6) AS h_cond FROM ({_HC})")
def conditional_entropy(spark, sf_dir):
    j = summed(segmented_words(spark, sf_dir).withColumnRenamed("root", "cond"), "cond", "tag")
    return stats.conditional_entropy(j, "cond").select("n", F.round("h_cond", 6).alias("h_cond"))


_SIG = "CASE WHEN root <> '' AND instr(lower(surface), root) > 0 THEN substr(lower(surface), 1, instr(lower(surface), root) - 1) || '_' || substr(lower(surface), instr(lower(surface), root) + length(root)) ELSE lower(surface) END"


@query(
    "recoverability",
    f"WITH {SEG_SQL}, sg AS (SELECT {_SIG} AS cond, tag FROM seg), j AS (SELECT cond, tag, count(*) AS cnt FROM sg GROUP BY ALL), m AS (SELECT tag, sum(cnt) AS cnt FROM j GROUP BY tag), h AS ({_H} FROM m), c AS ({_HC}) "
    "SELECT 'en' AS lang, h.n AS tokens, h.distinct_values AS bundles, round(log2(h.distinct_values), 6) AS h_max, round(h.h, 6) AS h, round(c.h_cond, 6) AS h_cond, round(CASE WHEN h.h <= 1e-12 THEN 'nan'::DOUBLE ELSE 1 - c.h_cond / h.h END, 6) AS rho, round(CASE WHEN h.h <= 1e-12 THEN 'nan'::DOUBLE ELSE h.h - c.h_cond END, 6) AS rho_h FROM h, c",
)
def recoverability(spark, sf_dir):
    """Entropy of bundles, and how much of it the surface's form without its root recovers."""
    sig = segmented_words(spark, sf_dir).select(T.surface_signature("surface", "root").alias("cond"), "tag", "cnt")
    j = summed(sig, "cond", "tag")
    h = stats.entropy(j.groupBy("tag").agg(F.sum("cnt").alias("cnt")))
    c = stats.conditional_entropy(j, "cond").select("h_cond")
    x = h.join(F.broadcast(c))  # one row each
    r = lambda v: F.round(v, 6)
    none = F.col("h") <= 1e-12
    return x.select(F.lit("en").alias("lang"), F.col("n").alias("tokens"), F.col("distinct_values").alias("bundles"), r(F.log2(F.col("distinct_values").cast("double"))).alias("h_max"), r("h").alias("h"), r("h_cond").alias("h_cond"), r(F.when(none, float("nan")).otherwise(1 - F.col("h_cond") / F.col("h"))).alias("rho"), r(F.when(none, float("nan")).otherwise(F.col("h") - F.col("h_cond"))).alias("rho_h"))


_ZIPF = "top AS (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, w) AS rank FROM (SELECT * FROM f ORDER BY cnt DESC, w LIMIT 1000))"


@query("zipf_exponent", f"WITH {tok_sql()}, f AS (SELECT w, count(*) AS cnt FROM tok GROUP BY w), {_ZIPF} SELECT count(*) AS n_ranks, round(-regr_slope(log10(cnt), log10(rank)), 6) AS alpha, max(cnt) AS top_count FROM top")
def zipf_exponent(spark, sf_dir):
    z = stats.zipf(stats.freq(tokens(spark, sf_dir), "w"), ["w"])
    return z.select("n_ranks", F.round("alpha", 6).alias("alpha"), "top_count")


@query(
    "zipf_verdict",
    f"WITH {SEG_SQL}, f AS (SELECT tag AS w, count(*) AS cnt FROM seg GROUP BY tag), {_ZIPF}, s AS (SELECT max(cnt) / sum(cnt) AS top_share, count(*) AS k FROM f), z AS (SELECT CASE WHEN count(*) >= 5 THEN -regr_slope(log10(cnt), log10(rank)) END AS alpha FROM top) "
    "SELECT round(top_share, 6) AS top_share, k AS distinct_bundles, CASE WHEN alpha IS NULL THEN 'too few' WHEN top_share > 0.6 THEN 'dominated' WHEN alpha < 0.5 THEN 'flat' WHEN alpha BETWEEN 0.7 AND 2.2 THEN 'healthy' WHEN alpha > 2.2 THEN 'steep' ELSE 'borderline' END AS verdict FROM s, z",
)
def zipf_verdict(spark, sf_dir):
    f = summed(segmented_words(spark, sf_dir), "tag")
    s = f.agg((F.max("cnt") / F.sum("cnt")).alias("s"), F.count(F.lit(1)).alias("k")).join(F.broadcast(stats.zipf(f, ["tag"]).select("alpha")))
    a = F.col("alpha")
    v = F.when(F.isnan(a), "too few").when(F.col("s") > 0.6, "dominated").when(a < 0.5, "flat").when(a.between(0.7, 2.2), "healthy").when(a > 2.2, "steep").otherwise("borderline")
    return s.select(F.round("s", 6).alias("top_share"), F.col("k").alias("distinct_bundles"), v.alias("verdict"))


# Vocabularies -------------------------------------------------------------

CAP = 32_000
_FREQ_SQL = f"{tok_sql()}, f AS (SELECT w, count(*) AS cnt, min((doc_id, pos)) AS first FROM tok GROUP BY w)"
_VOCAB_SQL = f"{_FREQ_SQL}, h AS (SELECT * FROM f ORDER BY cnt DESC, first, w LIMIT {CAP - 4}), vocab AS (SELECT w, 3 + row_number() OVER (ORDER BY cnt DESC, first, w) AS id, cnt AS freq FROM h WHERE w NOT IN ('<pad>', '<unk>', '<s>', '</s>'))"


def _vocab(spark, sf_dir) -> DataFrame:
    """Ties of frequency go to the earlier first place in the corpus."""
    f = tokens(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("cnt"), F.min(place()).alias("first"))
    return vocab.build_vocab(f, "w", "cnt", ["first"], CAP)


@query("build_vocab", f"WITH {_VOCAB_SQL} SELECT w, id, freq FROM vocab")
def build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir).select("w", F.col("id").cast("long"), "freq")


@query("vocab_rank", f"WITH {_FREQ_SQL} SELECT w, cnt, row_number() OVER (ORDER BY cnt DESC, first, w) AS rank FROM f ORDER BY cnt DESC, first, w LIMIT 500")
def vocab_rank(spark, sf_dir):
    f = tokens(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("cnt"), F.min(place()).alias("first"))
    order = [F.desc("cnt"), F.col("first"), F.col("w")]
    return f.orderBy(*order).limit(500).select("w", "cnt", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


@query("first_seen_id", f"WITH {SEG_SQL}, f AS (SELECT tag, min((doc_id, pos)) AS first FROM seg WHERE tag NOT IN ('ROOT', 'O') GROUP BY tag) SELECT tag, row_number() OVER (ORDER BY first, tag) AS id FROM f UNION ALL SELECT 'no_features', 0")
def first_seen_id(spark, sf_dir):
    """Ids in order of first place; tags are a closed set, so one small window ranks them."""
    f = segmented(spark, sf_dir).where("tag not in ('ROOT', 'O')").groupBy("tag").agg(F.min(place()).alias("first"))
    ids = f.select("tag", F.row_number().over(Window.orderBy("first", "tag")).cast("long").alias("id"))
    return ids.union(spark.createDataFrame([("no_features", 0)], "tag string, id long"))


@query("vocab_encode", f"WITH {_VOCAB_SQL} SELECT t.doc_id, t.pos, coalesce(v.id, 1) AS id FROM tok t LEFT JOIN vocab v ON t.w = v.w")
def vocab_encode(spark, sf_dir):
    return vocab.encode(tokens(spark, sf_dir), _vocab(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), F.col("id").cast("long"))


@query("encode_baseline", f"WITH {_VOCAB_SQL} SELECT t.doc_id, '2 ' || string_agg(coalesce(v.id, 1)::VARCHAR, ' ' ORDER BY t.pos) || ' 3' AS ids, count(*) + 2 AS n FROM tok t LEFT JOIN vocab v ON t.w = v.w GROUP BY t.doc_id")
def encode_baseline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.words("text").alias("ws")).where(F.size("ws") > 0)
    e = vocab.encode_lines(d, _vocab(spark, sf_dir), "ws")
    ids = F.concat(F.array(F.lit(vocab.BOS)), "ids", F.array(F.lit(vocab.EOS)))
    return e.select("doc_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"), (F.size("ids") + 2).cast("long").alias("n"))


@query(
    "shallow_encode",
    f"WITH {SEG_SQL}, f AS (SELECT tag, min((doc_id, pos)) AS first FROM seg WHERE tag <> 'O' GROUP BY tag), ids AS (SELECT tag, row_number() OVER (ORDER BY first, tag) AS id FROM f) "
    "SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY pos) AS features FROM seg LEFT JOIN ids USING (tag) GROUP BY doc_id",
)
def shallow_encode(spark, sf_dir):
    seg = segmented(spark, sf_dir)
    f = seg.where("tag <> 'O'").groupBy("tag").agg(F.min(place()).alias("first"))
    ids = f.select("tag", F.row_number().over(Window.orderBy("first", "tag")).alias("id"))
    e = seg.join(F.broadcast(ids), "tag", "left").select("doc_id", "pos", F.coalesce("id", F.lit(0)).alias("id"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string"))
    return e.groupBy("doc_id").agg(F.array_join(s, " ").alias("features"))


@query(
    "encode_multistream",
    f"WITH {SEG_SQL}, sf AS (SELECT surface, count(*) AS cnt FROM seg GROUP BY 1), rf AS (SELECT root, count(*) AS cnt FROM seg WHERE root <> '' GROUP BY 1), "
    "sv AS (SELECT surface, 3 + row_number() OVER (ORDER BY cnt DESC, surface) AS sid FROM (SELECT * FROM sf ORDER BY cnt DESC, surface LIMIT 3996)), rv AS (SELECT root, 3 + row_number() OVER (ORDER BY cnt DESC, root) AS rid FROM (SELECT * FROM rf ORDER BY cnt DESC, root LIMIT 1996)) "
    "SELECT doc_id, pos, coalesce(sid, 1) AS surface_id, CASE WHEN s.root = '' THEN 0 ELSE coalesce(rid, 1) END AS root_id FROM seg s LEFT JOIN sv USING (surface) LEFT JOIN rv ON s.root = rv.root",
)
def encode_multistream(spark, sf_dir):
    """Aligned streams of one projection: a miss is <unk>, an empty root <pad>. Each distinct word is segmented once, and its ids are joined back to its places."""
    _, words = Steps(spark, "segmented-words").write(segmented_words(spark, sf_dir))
    sv = vocab.build_vocab(words.select("surface", "cnt"), "surface", cap=4000).select("surface", F.col("id").alias("sid"))
    rv = vocab.build_vocab(summed(words.where("root <> ''"), "root"), "root", cap=2000).select("root", F.col("id").alias("rid"))
    ids = words.join(F.broadcast(sv), "surface", "left").join(F.broadcast(rv), "root", "left")
    ids = ids.select("surface", F.coalesce("sid", F.lit(1)).cast("long").alias("surface_id"), F.when(F.col("root") == "", 0).otherwise(F.coalesce("rid", F.lit(1))).cast("long").alias("root_id"))
    t = tokens(spark, sf_dir, "en").select("doc_id", F.col("pos").cast("long"), F.col("w").alias("surface"))
    return t.join(ids, "surface").select("doc_id", "pos", "surface_id", "root_id")


WINDOW = 128


@query(
    "pack_windows",
    f"WITH {_VOCAB_SQL}, g AS (SELECT row_number() OVER (ORDER BY t.doc_id, t.pos) - 1 AS g, coalesce(v.id, 1) AS id FROM tok t LEFT JOIN vocab v ON t.w = v.w), n AS (SELECT count(*) AS n FROM g) "
    f"SELECT g // {WINDOW} AS win, min(id) AS min_id, max(id) AS max_id, sum(id)::BIGINT AS sum_ids FROM g, n WHERE g // {WINDOW} < (n - 1) // {WINDOW} GROUP BY 1",
)
def pack_windows(spark, sf_dir):
    """Windows of the whole stream: offsets come from sums of lines, so no task sorts all words. The last, incomplete window goes."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(T.words("text")).alias("size"))
    off = vocab.line_offsets(d, "doc_id", "size").select("doc_id", "offset")
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.words("text").alias("ws")).where(F.size("ws") > 0)
    e = vocab.encode_lines(lines, _vocab(spark, sf_dir), "ws").join(off, "doc_id").select("offset", F.posexplode("ids").alias("pos", "id")).select((F.col("offset") + F.col("pos")).alias("g"), "id")
    total = d.agg(F.sum("size").alias("n"))
    w = F.floor(F.col("g") / WINDOW)
    x = e.join(F.broadcast(total)).where(w < F.floor((F.col("n") - 1) / WINDOW))
    return x.groupBy(w.alias("win")).agg(F.min("id").cast("long").alias("min_id"), F.max("id").cast("long").alias("max_id"), F.sum("id").cast("long").alias("sum_ids"))


@query("stream_invariants", f"WITH {_VOCAB_SQL}, e AS (SELECT coalesce(v.id, 1) AS id FROM tok t LEFT JOIN vocab v ON t.w = v.w), s AS (SELECT count(*) + 4 AS size FROM vocab) SELECT count(*) AS n, count(*) > 0 AS non_empty, min(id) >= 0 AS non_negative, max(id) < max(size) AS in_vocab, max(size) AS vocab_size FROM e, s")
def stream_invariants(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    x = vocab.encode(tokens(spark, sf_dir), v).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).join(F.broadcast(v.agg((F.count(F.lit(1)) + 4).alias("vocab_size"))))
    return x.select("n", (F.col("n") > 0).alias("non_empty"), (F.col("lo") >= 0).alias("non_negative"), (F.col("hi") < F.col("vocab_size")).alias("in_vocab"), "vocab_size")


@query("source_counts", r"SELECT source, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS n_words FROM documents WHERE trim(text) <> '' GROUP BY source")
def source_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("trim(text) <> ''")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(T.words("text"))).alias("n_words"))


@query("fertility", rf"WITH {SEG_SQL}, p AS (SELECT doc_id, surface, 1 + (tag LIKE 'SUF%')::INT AS pieces FROM seg) SELECT sum(pieces)::BIGINT AS pieces, count(*) AS words, round(sum(pieces) / greatest(1, count(*)), 6) AS per_word, round(sum(pieces) / greatest(1, sum(length(surface))), 6) AS per_char FROM p")
def fertility(spark, sf_dir):
    p = segmented_words(spark, sf_dir).select("cnt", (F.col("cnt") * (1 + F.col("tag").startswith("SUF").cast("int"))).alias("pieces"), (F.col("cnt") * F.length("surface")).alias("chars"))
    n = p.agg(F.sum("pieces").alias("pieces"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("words"), F.sum("chars").alias("chars"))
    return n.select("pieces", "words", F.round(F.col("pieces") / F.greatest(F.lit(1), "words"), 6).alias("per_word"), F.round(F.col("pieces") / F.greatest(F.lit(1), "chars"), 6).alias("per_char"))


@query("split_stats", r"SELECT lang, count(*) AS lines, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS tokens, round(avg(len(regexp_extract_all(text, '\S+'))), 2) AS avg_tokens FROM documents WHERE text IS NOT NULL GROUP BY lang")
def split_stats(spark, sf_dir):
    n = F.size(T.words("text"))
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(n).alias("tokens"), F.round(F.avg(n), 2).alias("avg_tokens"))


@query("unk_rate", f"WITH {_VOCAB_SQL} SELECT t.lang, count(*) AS n, round(avg((v.id IS NULL)::INT), 6) AS unk_rate FROM tok t LEFT JOIN vocab v ON t.w = v.w GROUP BY t.lang")
def unk_rate(spark, sf_dir):
    e = vocab.encode(tokens(spark, sf_dir), _vocab(spark, sf_dir))
    return e.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("id") == 1).cast("int")), 6).alias("unk_rate"))


@query("foreign_rate", f"WITH {tok_sql()} SELECT lang, count(*) AS total, sum(regexp_matches(w, '[^\\x00-\\x7F]')::INT)::BIGINT AS foreign_words, round(avg(regexp_matches(w, '[^\\x00-\\x7F]')::INT), 6) AS rate FROM tok GROUP BY lang")
def foreign_rate(spark, sf_dir):
    f = F.col("w").rlike("[^\\x00-\\x7F]").cast("int")
    return tokens(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.sum(f).alias("foreign_words"), F.round(F.avg(f), 6).alias("rate"))


@query("meaning_units", f"WITH {SEG_SQL} SELECT count(*) AS n, sum((tag LIKE 'SUF%')::INT)::BIGINT AS marked, round(count(*) / greatest(1, sum((tag LIKE 'SUF%')::INT)), 6) AS tokens_per_unit, count(DISTINCT surface) AS distinct_surfaces FROM seg")
def meaning_units(spark, sf_dir):
    n, marked = F.coalesce(F.sum("cnt"), F.lit(0)), F.sum(F.col("cnt") * F.col("tag").startswith("SUF").cast("int"))
    return segmented_words(spark, sf_dir).agg(n.alias("n"), marked.alias("marked"), F.round(n / F.greatest(F.lit(1), marked), 6).alias("tokens_per_unit"), F.count(F.lit(1)).alias("distinct_surfaces"))


@query("neighbor_context", f"WITH {tok_sql("lang = 'en'")}, n AS (SELECT w, lag(w) OVER o AS prev, lead(w) OVER o AS next FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT coalesce(prev, '<s>') AS prev, coalesce(next, '</s>') AS next, count(*) AS cnt FROM n WHERE w = 'the' GROUP BY 1, 2")
def neighbor_context(spark, sf_dir):
    """Neighbours from the array of a document's words: no row a word, no shuffle but that of the counts."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'").select(T.words("text").alias("ws"))
    at = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("w"), F.get("ws", i - 1).alias("prev"), F.get("ws", i + 1).alias("next"))), lambda x: x["w"] == "the")
    n = d.select(F.explode(at).alias("x"))
    return n.groupBy(F.coalesce("x.prev", F.lit("<s>")).alias("prev"), F.coalesce("x.next", F.lit("</s>")).alias("next")).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "lookahead_frame",
    f"WITH {tok_sql("lang = 'en'")}, n AS (SELECT doc_id, max((w = 'the')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS soon, max((w = 'of')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS first FROM tok) "
    "SELECT doc_id, coalesce(sum(soon), 0)::BIGINT AS soon, coalesce(sum(before), 0)::BIGINT AS before, sum(first::INT)::BIGINT AS firsts FROM n GROUP BY doc_id",
)
def lookahead_frame(spark, sf_dir):
    """Frames from the array of a document's words: words with one in the next three, words behind the first of another, first words."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'").select("doc_id", T.words("text").alias("ws")).where(F.size("ws") > 0)
    ahead = F.transform("ws", lambda w, i: F.coalesce(F.array_contains(F.array(*(F.get("ws", i + k) for k in (1, 2, 3))), "the"), F.lit(False)))
    of = F.array_position("ws", "of")
    return d.select("doc_id", F.size(F.filter(ahead, lambda x: x)).cast("long").alias("soon"), F.when(of > 0, F.size("ws") - of).otherwise(0).cast("long").alias("before"), F.lit(1).cast("long").alias("firsts"))


def en_inflection_expr(w):
    # First fitting ending in order: (lemma, tags). Without a word list every stem counts as a word, so a stem is changed
    # only by its shape: a doubled final consonant before -ing and -ed is undone; else a stem that ends in one consonant
    # behind one vowel gets a silent e. Comparatives need a list of adjectives and stay whole here.
    n = F.length(w)
    cut = lambda k: F.substr(w, F.lit(1), F.length(w) - k)

    def verb_stem(s):
        doubled = s.rlike("([^aeiou])\\1$") & (F.length(s) >= 3)
        return F.when(doubled, F.substr(s, F.lit(1), F.length(s) - 1)).when(s.rlike("[^aeiou][aeiou][^aeiouwyxkhqj]$"), F.concat(s, F.lit("e"))).otherwise(s)

    rules = [
        (w.endswith("'s"), cut(2), "poss=YES"),
        (w.endswith("ing") & (n > 5), verb_stem(cut(3)), "aspect=PROG|tense=PRES"),
        (w.endswith("ied") & (n > 4), F.concat(cut(3), F.lit("y")), "tense=PAST"),
        (w.endswith("ed") & (n > 3), verb_stem(cut(2)), "tense=PAST"),
        (w.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y")), "num=PL"),
        (w.endswith("es") & (n > 3), cut(2), "num=PL"),
        (w.endswith("s") & (n > 3) & ~w.rlike("(ss|ous)$"), cut(1), "num=PL"),
    ]
    lemma = kind = None
    for cond, value, k in rules:
        lemma = F.when(cond, value) if lemma is None else lemma.when(cond, value)
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
    return lemma.otherwise(w), kind.otherwise("")


_DOUBLE = "(" + "|".join(c + c for c in "bcdfghjklmnpqrstvwxyz") + ")$"
_CUT = lambda n: f"substr(w, 1, length(w) - {n})"
_STEM = lambda s: f"CASE WHEN length({s}) >= 3 AND regexp_matches({s}, '{_DOUBLE}') THEN substr({s}, 1, length({s}) - 1) WHEN regexp_matches({s}, '[^aeiou][aeiou][^aeiouwyxkhqj]$') THEN {s} || 'e' ELSE {s} END"
_EN_RULES = [
    ("ends_with(w, '''s')", _CUT(2), "poss=YES"), ("ends_with(w, 'ing') AND length(w) > 5", _STEM(_CUT(3)), "aspect=PROG|tense=PRES"), ("ends_with(w, 'ied') AND length(w) > 4", _CUT(3) + " || 'y'", "tense=PAST"),
    ("ends_with(w, 'ed') AND length(w) > 3", _STEM(_CUT(2)), "tense=PAST"), ("ends_with(w, 'ies') AND length(w) > 3", _CUT(3) + " || 'y'", "num=PL"), ("ends_with(w, 'es') AND length(w) > 3", _CUT(2), "num=PL"),
    ("ends_with(w, 's') AND length(w) > 3 AND NOT regexp_matches(w, '(ss|ous)$')", _CUT(1), "num=PL"),
]
_EN_SQL = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in _EN_RULES) + " ELSE w END AS lemma, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in _EN_RULES) + " ELSE '' END AS kind"


@query("en_inflection", f"WITH {tok_sql("lang = 'en'")}, d AS (SELECT {_W} AS w, count(*) AS cnt FROM tok GROUP BY 1) SELECT w, cnt, {_EN_SQL} FROM d WHERE regexp_matches(w, '^[a-z]+(''s)?$')")
def en_inflection(spark, sf_dir):
    """Each distinct word is analysed once, after counting."""
    d = stats.freq(tokens(spark, sf_dir, "en").select(T.edge_stripped("w").alias("w")), "w").where(F.col("w").rlike("^[a-z]+('s)?$"))
    lemma, kind = en_inflection_expr(F.col("w"))
    return d.select("w", "cnt", lemma.alias("lemma"), kind.alias("kind"))


