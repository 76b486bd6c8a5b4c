"""Sentence splitters, frequency lists, normalisers and lookups of single languages."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from .derived import letters_in, letters_in_sql, texts_in, texts_in_sql, words_in, words_in_sql
from .measured import BUNDLES_SQL, bundles
from .registry import query
from .set_queries import bench_tokens, _BENCH_TOK
from .text_queries import _ABBR_SQL, ABBREVIATIONS, place, rows, tok_sql, tokens, values_sql

#: Stands between sentences while they are one string; no text has it.
MARK = "\x01"


def english_sentences(text: str | Column) -> Column:
    """Sentences of whole texts as strings of tokens: line breaks end one, a run of terminators becomes a token and ends one, abbreviations do neither."""

    def token(w: Column) -> Column:
        body, ends = F.regexp_extract(w, "^(.*?)([.!?;]*)$", 1), F.regexp_extract(w, "^(.*?)([.!?;]*)$", 2)
        short = F.concat(body, F.left(ends, F.lit(1)))
        rest = F.substr(ends, F.lit(2))
        after = F.when(rest != "", F.concat(F.lit(" "), rest, F.lit(MARK))).otherwise("")
        return F.when(w.isin(*ABBREVIATIONS) | (ends == ""), w).when(short.isin(*ABBREVIATIONS), F.concat(short, after)).otherwise(F.concat(body, F.when(body != "", " ").otherwise(""), ends, F.lit(MARK)))

    paragraph = lambda p: F.array_join(F.transform(T.words(p), token), " ")
    joined = F.array_join(F.transform(F.split(T.col(text), "\n+"), paragraph), MARK)
    return F.filter(F.transform(F.split(joined, MARK), lambda s: F.trim(s)), lambda s: s != "")


_EN_TOKEN = (
    f"CASE WHEN w IN ({_ABBR_SQL}) OR NOT regexp_matches(w, '[.!?;]$') THEN w WHEN regexp_replace(w, '[.!?;]+$', '') || left(regexp_extract(w, '[.!?;]+$'), 1) IN ({_ABBR_SQL}) "
    "THEN regexp_replace(w, '[.!?;]+$', '') || left(regexp_extract(w, '[.!?;]+$'), 1) || CASE WHEN length(regexp_extract(w, '[.!?;]+$')) > 1 THEN ' ' || regexp_extract(w, '[.!?;]+$')[2:] || chr(1) ELSE '' END "
    "ELSE trim(regexp_replace(w, '([.!?;]+)$', ' \\1')) || chr(1) END"
)


@query(
    "en_split",
    f"WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda t: list_aggregate(list_transform(regexp_extract_all(t, '\\S+'), lambda w: {_EN_TOKEN}), 'string_agg', ' ')) AS l FROM documents WHERE text IS NOT NULL AND lang = 'en'), "
    "s AS (SELECT doc_id, list_filter(list_transform(string_split(list_aggregate(l, 'string_agg', chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM p) "
    "SELECT doc_id, len(ss)::BIGINT AS sentences, md5(list_aggregate(ss, 'string_agg', '|')) AS digest FROM s WHERE len(ss) > 0",
)
def en_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'").select("doc_id", english_sentences("text").alias("ss")).where(F.size("ss") > 0)
    return s.select("doc_id", F.size("ss").cast("long").alias("sentences"), F.md5(F.array_join("ss", "|")).alias("digest"))


def line_sentences(text: str | Column, terminators: str, abbreviations: list[str] | None = None) -> Column:
    """Sentences of whole texts: a line's end ends one, and so does a token whose last letter is a terminator, which stays on it."""

    def token(w: Column) -> Column:
        ends = w.rlike(f"[{terminators}]$")
        return F.when(ends & ~w.isin(*abbreviations) if abbreviations else ends, F.concat(w, F.lit(MARK))).otherwise(w)

    joined = F.array_join(F.transform(F.split(T.col(text), "\r\n|\r|\n"), lambda p: F.array_join(F.transform(T.words(p), token), " ")), MARK)
    return F.filter(F.transform(F.split(joined, MARK), lambda s: F.trim(s)), lambda s: s != "")


def _line_sql(name: str, terminators: str, abbreviations: list[str], source: str) -> str:
    kept = f" AND w NOT IN ({', '.join(repr(a) for a in abbreviations)})" if abbreviations else ""
    return (
        f"WITH p AS (SELECT id, string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM {source}), w AS (SELECT id, ln, unnest(regexp_extract_all(l, '\\S+')) AS w, unnest(range(0, len(regexp_extract_all(l, '\\S+')))) AS i FROM (SELECT id, unnest(ls) AS l, unnest(range(0, len(ls))) AS ln FROM p)), "
        f"e AS (SELECT *, coalesce(sum((regexp_matches(w, '[{terminators}]$'){kept})::INT) OVER (PARTITION BY id, ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w), "
        "g AS (SELECT id, ln, s, string_agg(w, ' ' ORDER BY i) AS sentence FROM e GROUP BY id, ln, s) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY ln, s) - 1)::BIGINT AS sent, sentence FROM g"
    )


def _sentence_rows(df, terminators, abbreviations=None):
    return df.select("id", F.posexplode(line_sentences("t", terminators, abbreviations)).alias("sent", "sentence")).select("id", F.col("sent").cast("long"), "sentence")


@query("ar_split", _line_sql("ar", ".!?;؟؛", [], texts_in_sql("ar")))
def ar_split(spark, sf_dir):
    return _sentence_rows(texts_in(spark, sf_dir, "ar"), ".!?;؟؛")


# Turkish abbreviations that end no sentence.
TR_ABBREVIATIONS = ["Dr.", "Prof.", "Doc.", "Av.", "Sn.", "Bay.", "Bn.", "vb.", "vs.", "yy.", "yzy.", "a.g.e.", "bkz.", "Cad.", "Sok."]


@query("tr_split", _line_sql("tr", ".!?;", TR_ABBREVIATIONS, texts_in_sql("tr")))
def tr_split(spark, sf_dir):
    return _sentence_rows(texts_in(spark, sf_dir, "tr"), ".!?;", TR_ABBREVIATIONS)


@query("line_split", _line_sql("x", ".!?;", TR_ABBREVIATIONS, "(SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL)"))
def line_split(spark, sf_dir):
    """The splitter by lines over whole documents of every language."""
    return _sentence_rows(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), ".!?;", TR_ABBREVIATIONS)


#: Words left out of frequency lists: an injected list of function words.
STOP = ["the", "a", "an", "and", "of", "to", "in", "is", "are", "was", "for", "on", "with", "that", "this"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query("content_freq", f"WITH {tok_sql()} SELECT lang, lower(w) AS w, count(*) AS cnt FROM tok WHERE length(w) > 2 AND regexp_matches(w, '^[a-zA-Z]+$') AND lower(w) NOT IN ({_STOP_SQL}) GROUP BY lang, lower(w)")
def content_freq(spark, sf_dir):
    """Frequency lists of words of letters, longer than two, without function words."""
    w = F.col("w")
    return tokens(spark, sf_dir).where((F.length(w) > 2) & w.rlike("^[a-zA-Z]+$") & ~F.lower(w).isin(*STOP)).groupBy("lang", F.lower(w).alias("w")).agg(F.count(F.lit(1)).alias("cnt"))


@query("gold_candidates", f"WITH {tok_sql()}, f AS (SELECT lower(w) AS w, count(*) AS cnt FROM tok WHERE length(w) > 2 AND regexp_matches(w, '^[a-zA-Z]+$') AND lower(w) NOT IN ({_STOP_SQL}) GROUP BY 1 ORDER BY cnt DESC, w LIMIT 200), {_BENCH_TOK}, c AS (SELECT DISTINCT lower(w) AS w FROM bt) SELECT f.w, f.cnt FROM f JOIN c ON f.w = c.w")
def gold_candidates(spark, sf_dir):
    """The most frequent content words that a curated list has: words of the benchmark stand for the list here."""
    top = content_freq(spark, sf_dir).groupBy("w").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "w").limit(200)
    return bench_tokens(spark, sf_dir).select(F.lower("w").alias("w")).join(F.broadcast(top), "w", "left_semi").distinct().join(F.broadcast(top), "w")


#: Words with their part of speech, that of short ones blank.
_POS = f"(SELECT w, CASE WHEN pos = 'DET' THEN '' ELSE pos END AS pos FROM {BUNDLES_SQL}) AS t(w, pos)"


@query("open_class_pos", f"SELECT w, coalesce(nullif(pos, ''), 'UNKNOWN') AS pos FROM {_POS}")
def open_class_pos(spark, sf_dir):
    return bundles(spark, sf_dir).select("w", F.when(F.col("pos") == "DET", "").otherwise(F.col("pos")).alias("pos")).select("w", F.coalesce(F.nullif("pos", F.lit("")), F.lit("UNKNOWN")).alias("pos"))


@query("failed_analyses", f"WITH {tok_sql()} SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(w, '[a-zA-Z]')) AS failed, count(DISTINCT CASE WHEN regexp_matches(w, '[a-zA-Z]') THEN lower(w) ELSE 'UNKNOWN' END) AS analyses FROM tok GROUP BY lang")
def failed_analyses(spark, sf_dir):
    """Words that no analysis has are counted, and stay as UNKNOWN."""
    a = F.when(F.col("w").rlike("[a-zA-Z]"), F.lower("w"))
    return tokens(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(a.isNull()).alias("failed"), F.countDistinct(F.coalesce(a, F.lit("UNKNOWN"))).alias("analyses"))


#: Short words as particles, their class by the first letter.
_SUBCATS = f"(SELECT w, CASE WHEN pos = 'DET' THEN 'PART' ELSE pos END AS pos, CASE lower(left(w, 1)) WHEN 't' THEN 'PREP' WHEN 'a' THEN 'CONJ' WHEN 'i' THEN 'COMP' WHEN 'o' THEN 'NEG' END AS subcat FROM {BUNDLES_SQL}) AS t(w, pos, subcat)"


def _subcats(spark, sf_dir):
    first = F.lower(F.left("w", F.lit(1)))
    subcat = F.when(first == "t", "PREP").when(first == "a", "CONJ").when(first == "i", "COMP").when(first == "o", "NEG")
    return bundles(spark, sf_dir).select("w", F.when(F.col("pos") == "DET", "PART").otherwise(F.col("pos")).alias("pos"), subcat.alias("subcat"))


#: Coarse classes of Arabic particles.
AR_COARSE = {"PREP": "ADP", "CONJ": "CONJ", "COMP": "CONJ"}


@query("ar_coarse_pos", f"SELECT w, pos, subcat, CASE WHEN pos = 'PART' THEN coalesce(MAP {{'PREP': 'ADP', 'CONJ': 'CONJ', 'COMP': 'CONJ'}}[subcat], pos) ELSE pos END AS coarse FROM {_SUBCATS}")
def ar_coarse_pos(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for kv in AR_COARSE.items() for x in kv))
    return _subcats(spark, sf_dir).select("w", "pos", "subcat", F.when(F.col("pos") == "PART", F.coalesce(F.element_at(known, F.col("subcat")), "pos")).otherwise(F.col("pos")).alias("coarse"))


@query("source_projection", r"SELECT lang, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT lang, regexp_replace(trim(unnest(string_split(json_extract_string(doc, '$.translation.' || lang), chr(10)))), '\s+', ' ', 'g') AS line FROM (SELECT lang, json_object('translation', json_object(lang, text)) AS doc FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)) WHERE line <> '' GROUP BY lang")
def source_projection(spark, sf_dir):
    """The text under translation and the language's name, in cleaned lines."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("lang", F.create_map("lang", "text").alias("translation"))
    line = F.regexp_replace(F.trim("raw"), r"\s+", " ")
    return d.select("lang", F.explode(F.split(F.col("translation")[F.col("lang")], "\n")).alias("raw")).select("lang", line.alias("line")).where("line <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


_PIECES = r"(SELECT item_id AS id, regexp_replace(text, '\s*(\S{1,2})(\S*)', '▁\1 \2 ', 'g') AS t FROM benchmark WHERE text IS NOT NULL)"


def _pieces(spark, sf_dir):
    """Items as pieces: each word's first two letters behind the mark, then the rest."""
    return table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), F.regexp_replace("text", "\\s*(\\S{1,2})(\\S*)", "▁$1 $2 ").alias("t"))


@query("piece_display", f"SELECT id, replace(t, '▁', '·') AS shown, list_aggregate(list_filter(string_split(replace(replace(t, '▁', ''), ' ', ''), ''), lambda c: c <> ''), 'string_agg', ' ') AS chars FROM {_PIECES}")
def piece_display(spark, sf_dir):
    """Pieces with their mark shown as a dot, and the fallback to characters."""
    chars = F.filter(F.split(F.translate("t", "▁ ", ""), ""), lambda c: c != "")
    return _pieces(spark, sf_dir).select("id", F.replace("t", F.lit("▁"), F.lit("·")).alias("shown"), F.array_join(chars, " ").alias("chars"))


CLOSED_CLASS = [("the", "DET"), ("a", "DET"), ("of", "ADP"), ("in", "ADP"), ("to", "PART"), ("and", "CCONJ"), ("is", "AUX"), ("was", "AUX"), ("he", "PRON"), ("it", "PRON")]


@query("closed_class_intercept", f"WITH {tok_sql()} SELECT coalesce(c.pos, 'OPEN') AS pos, count(*) AS cnt FROM tok LEFT JOIN {values_sql('word, pos', CLOSED_CLASS).replace('AS t(', 'AS c(')} ON lower(tok.w) = c.word GROUP BY 1")
def closed_class_intercept(spark, sf_dir):
    """Words are counted first, then looked up in the fixed table."""
    f = tokens(spark, sf_dir).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    c = F.broadcast(rows(spark, "word string, pos string", CLOSED_CLASS))
    return f.join(c, "word", "left").groupBy(F.coalesce("pos", F.lit("OPEN")).alias("pos")).agg(F.sum("n").alias("cnt"))


@query("apostrophe_partition", f"WITH {tok_sql()} SELECT split_part(w, '''', 1) AS stem, w[instr(w, '''') + 1:] AS suffix, count(*) AS cnt FROM tok WHERE instr(w, '''') > 1 GROUP BY 1, 2")
def apostrophe_partition(spark, sf_dir):
    stem = F.substring_index("w", "'", 1)
    return tokens(spark, sf_dir).where(F.instr("w", "'") > 1).groupBy(stem.alias("stem"), F.substr("w", F.length(stem) + 2).alias("suffix")).agg(F.count(F.lit(1)).alias("cnt"))


@query("hyphen_split", f"WITH {tok_sql()} SELECT string_split(lower(w), '-')[1] AS first, string_split(lower(w), '-')[-1] AS head, len(string_split(w, '-'))::BIGINT AS parts, count(*) AS cnt FROM tok WHERE regexp_matches(w, '^[A-Za-z]+(-[A-Za-z]+)+$') GROUP BY 1, 2, 3")
def hyphen_split(spark, sf_dir):
    """Compounds: the last part is the head."""
    p = F.split(F.lower("w"), "-")
    return tokens(spark, sf_dir).where(F.col("w").rlike("^[A-Za-z]+(-[A-Za-z]+)+$")).groupBy(F.element_at(p, 1).alias("first"), F.element_at(p, -1).alias("head"), F.size(p).cast("long").alias("parts")).agg(F.count(F.lit(1)).alias("cnt"))


_HAMZA = "translate({}, 'أإآؤئ', 'ءءءءء')"
_CONS = "regexp_replace(" + _HAMZA.format("regexp_replace(w, '[\\x{064B}-\\x{065F}\\x{0670}\\x{0629}]', '', 'g')") + ", '[^ءابتثجحخدذرزسشصضطظعغفقكلمنهوي]', '', 'g')"


@query(
    "ar_skeleton",
    f"SELECT w, regexp_replace(w, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}}\\x{{0640}}]', '', 'g') AS bare, c AS consonants, CASE WHEN length(c) > 2 THEN c[1] || replace(c[2:-2], 'ا', '') || c[-1] ELSE c END AS root_letters, regexp_replace({_HAMZA.format('w')}, '[اوي\\x{{064B}}-\\x{{0652}}\\x{{0670}}\\x{{0640}}]', '', 'g') AS tolerant FROM (SELECT w, {_CONS} AS c FROM {words_in_sql('ar')})",
)
def ar_skeleton(spark, sf_dir):
    """Evaluation's bare form, consonants, root letters without inner alef, and the form without weak letters."""
    bare = F.regexp_replace("w", "[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}]", "")
    c = F.regexp_replace(T.hamza_norm(T.strip_diacritics("w")), "[^ءابتثجحخدذرزسشصضطظعغفقكلمنهوي]", "")
    roots = F.when(F.length(c) > 2, F.concat(F.left(c, F.lit(1)), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit("ا"), F.lit("")), F.right(c, F.lit(1)))).otherwise(c)
    return words_in(spark, sf_dir, "ar").select("w", bare.alias("bare"), c.alias("consonants"), roots.alias("root_letters"), F.regexp_replace(T.hamza_norm(bare), "[اوي]", "").alias("tolerant"))


#: Roots as dotted letters; a weak one is written #.
_DOTTED = f"(SELECT DISTINCT replace(array_to_string(string_split(left(w, 4), ''), '.'), 'و', '#') AS root FROM {words_in_sql('ar')})"


@query("strong_radicals", f"SELECT root, coalesce(list_aggregate(list_filter(string_split(root, '.'), lambda x: x NOT IN ('', '#')), 'string_agg', ' '), '') AS radicals FROM {_DOTTED}")
def strong_radicals(spark, sf_dir):
    roots = words_in(spark, sf_dir, "ar").select(F.replace(F.array_join(F.split(F.left("w", F.lit(4)), ""), "."), F.lit("و"), F.lit("#")).alias("root")).distinct()
    return roots.select("root", F.array_join(F.filter(F.split("root", "[.]"), lambda x: ~x.isin("", "#")), " ").alias("radicals"))


#: The 214 radicals stand in order in Unicode's block of Kangxi radicals.
KANGXI_FIRST, KANGXI_LAST = 0x2F00, 0x2FD5


@query("kangxi_map", f"SELECT number, chr((number + {KANGXI_FIRST - 1})::INT) AS radical, count(*) AS n FROM (SELECT doc_id % {KANGXI_LAST - KANGXI_FIRST + 1} + 1 AS number FROM documents) GROUP BY number")
def kangxi_map(spark, sf_dir):
    """Radicals of numbers from a rule, UTF-16 of the code point, over numbers made of the documents' ids; and back."""
    number = table(spark, sf_dir, "documents").select((F.col("doc_id") % (KANGXI_LAST - KANGXI_FIRST + 1) + 1).alias("number"))
    code = F.unhex(F.lpad(F.hex(F.col("number") + (KANGXI_FIRST - 1)), 4, "0"))
    return number.select("number", F.decode(code, "UTF-16BE").alias("radical")).groupBy("number", "radical").agg(F.count(F.lit(1)).alias("n"))


RADICALS = [("好", 38), ("河", 85), ("林", 75)]


@query("zh_radical_id", f"SELECT c.sent, c.pos, c.w AS ch, coalesce(r.n + 3, 1) AS id FROM {letters_in_sql('zh').replace('AS t(sent', 'AS c(sent')} LEFT JOIN {values_sql('ch, n', RADICALS).replace('AS t(', 'AS r(')} ON c.w = r.ch")
def zh_radical_id(spark, sf_dir):
    r = F.broadcast(rows(spark, "ch string, n int", RADICALS))
    return letters_in(spark, sf_dir, "zh").withColumnRenamed("w", "ch").join(r, "ch", "left").select("sent", "pos", "ch", F.coalesce(F.col("n") + 3, F.lit(1)).alias("id"))


@query("tag_string_map", f"SELECT w, split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v FROM (SELECT w, unnest(string_split(tags, '|')) AS kv FROM {BUNDLES_SQL}) WHERE kv <> ''")
def tag_string_map(spark, sf_dir):
    return bundles(spark, sf_dir).select("w", "tags").where("tags <> ''").select("w", F.explode(F.str_to_map("tags", F.lit("[|]"), F.lit("="))).alias("k", "v"))


@query("feature_display", f"SELECT w, replace(tags, '|', ' · ') AS shown FROM {BUNDLES_SQL}")
def feature_display(spark, sf_dir):
    return bundles(spark, sf_dir).select("w", "tags").select("w", F.concat_ws(" · ", F.split("tags", "[|]")).alias("shown"))


@query("probe_tokenize", f"WITH {tok_sql()}, v AS (SELECT w, 3 + row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM tok GROUP BY w QUALIFY id < 2000), {_BENCH_TOK} SELECT item_id, string_agg(coalesce(v.id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids FROM bt LEFT JOIN v ON bt.w = v.w GROUP BY item_id")
def probe_tokenize(spark, sf_dir):
    """Ids of benchmark items by a capped vocabulary of documents; other words are <unk>."""
    from ..operators import vocab

    v = vocab.build_vocab(tokens(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("cnt")), cap=2000)
    e = vocab.encode(bench_tokens(spark, sf_dir), v)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string"))
    return e.groupBy("item_id").agg(F.array_join(ids, " ").alias("ids"))


@query("capped_roots", f"WITH {tok_sql()}, f AS (SELECT left(lower(w), 4) AS root, min((doc_id, pos)) AS first FROM tok GROUP BY 1) SELECT root, (3 + row_number() OVER (ORDER BY first, root))::BIGINT AS id FROM f ORDER BY first, root LIMIT 1000")
def capped_roots(spark, sf_dir):
    """A vocabulary in order of first places with a cap: only the capped rows are ranked."""
    f = tokens(spark, sf_dir).groupBy(F.left(F.lower("w"), F.lit(4)).alias("root")).agg(F.min(place()).alias("first"))
    return f.orderBy("first", "root").limit(1000).select("root", (3 + F.row_number().over(Window.orderBy("first", "root"))).cast("long").alias("id"))
