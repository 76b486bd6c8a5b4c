"""Audit of how sources differ in their words: divergence between sources of a language, and the words that mark a source.

Counts come from one pass over the texts. Pairs of sources are summed over the words that either has, with the part of all
other words, where both have their least probability, put in as one product. The words of a source are ranked by radix
selection: histograms over the bits of the value, then over the bytes of the word, narrow down where the last rank lies, so
that only about as many rows as are wanted are ever sorted in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A-Z in lower case, other letters and what lies beyond ASCII kept, the rest as spaces: split() then gives the terms.
FOLDED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
#: Bytes of a text that are split at once, and terms of a group that are counted before they are handed on.
SLICE, HELD = 1 << 20, 200_000
SCALE = 1_000_000_000


@dataclass(frozen=True)
class AuditSpec:
    """ranks: of terms, by group. min_docs: documents of a language that hold a kept term. bits: of a value's digit. settled: rows of a group, not yet told to be in or out, that are few enough to be sorted."""

    ranks: int = 200
    min_docs: int = 3
    bits: int = 10
    settled: int = 2000


# ---- counts


def slices(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size."""
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d: occurrences and documents, and for each group a row with no term."""
    small = docs.select("lang", "source", "text")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for (lang, source), (n, d) in held.items():
                words = list(n)
                for a in range(0, len(words) + 1, 8192):
                    some = words[a : a + 8192]
                    terms = [None] * (a == 0) + [w.decode() for w in some]
                    zero = [0] * (a == 0)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array(zero + [n[w] for w in some], pa.int64()), pa.array(zero + [d[w] for w in some], pa.int64())], schema=schema)
            held.clear()
            size = 0

        for b in batches:
            for i in range(b.num_rows):
                lang, source, text = ((b.column(j)[i].as_py() or "") for j in range(3))
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, once = len(n), set()
                for words in slices(text.encode().translate(FOLDED)):
                    n.update(words)
                    once.update(words)
                d.update(once)
                size += len(n) - before
                if size >= HELD or len(held) >= HELD // 20:
                    yield from take()
        yield from take()

    got = small.mapInArrow(common.tidy(run), "lang string, source string, term string, n long, d long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers that are not negative."""
    return F.call_function("div", a, b)


def prob(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + size)); null where nothing is kept."""
    return 1 + _div(SCALE * (n + 1), F.nullif(total + size, F.lit(0)))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, total, once: counts of the terms that enough of a language's documents hold; once marks one row of each term."""
    w = Window.partitionBy("lang", "term")
    x = counts.where(F.col("term").isNotNull()).withColumns({"total": F.sum("n").over(w), "docs": F.sum("d").over(w), "once": F.min("source").over(w) == F.col("source")})
    return x.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "once")


def group_sizes(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size, lang_size, terms, floor: for every group that occurs its kept words, those of its language, the language's kept terms, and the group's probability of a term that it lacks."""
    every = counts.where(F.col("term").isNull()).select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("once").alias("new"))
    langs = own.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("new").alias("terms"))
    x = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "lang_size", "terms"])
    return x.select("lang", "source", "size", "lang_size", "terms", prob(F.lit(0), F.col("size"), F.col("terms")).alias("floor"))


def probabilities(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, term, p, floor, value: a group's probability of each of its terms; value is the gap to the language's where p is above it, else null."""
    x = kept.join(common.sent_if_small(groups), ["lang", "source"])
    x = x.select("lang", "source", "term", "floor", prob(F.col("n"), F.col("size"), F.col("terms")).alias("p"), prob(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"))
    return x.select("lang", "source", "term", "p", "floor", F.when(F.col("p") > F.col("q"), gap(F.col("p"), F.col("q"))).alias("value"))


# ---- pairs of sources


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class SharedTerms:
    """Sums, over terms that both sources of a pair have, what the pair's gap differs by from the gaps with one side at its floor."""

    def __init__(self, cells: int = 1 << 20, pairs: int = 1 << 20):
        self.cells, self.pairs = cells, pairs
        self.number: dict[tuple[str, str], int] = {}
        self.sums: dict[int, int] = {}

    def add(self, t: pa.Table) -> None:
        """Whole terms: rows of a term stand together."""
        code = {c: t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source")}
        at = {c: x.indices.to_numpy() for c, x in code.items()}
        both = at["lang"].astype(np.int64) << 32 | at["source"]
        found, inverse = np.unique(both, return_inverse=True)
        langs, sources = code["lang"].dictionary.to_pylist(), code["source"].dictionary.to_pylist()
        group = np.array([self.number.setdefault((langs[x >> 32], sources[x & 0xFFFFFFFF]), len(self.number)) for x in found.tolist()], np.int64)[inverse]
        p, low = (t.column(c).to_numpy() for c in ("p", "floor"))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at["lang"]) != 0) | (np.diff(at["term"]) != 0)]))
        many = np.diff(np.append(new, len(p)))
        for m in np.unique(many[many > 1]).tolist():
            firsts = new[many == m]
            step = max(1, self.cells // (m * m))
            for a in range(0, len(firsts), step):
                rows = firsts[a : a + step, None] + np.arange(m)
                wide = max(1, self.cells // m)
                for b in range(0, m, wide):
                    self._cross(rows[:, b : b + wide, None], rows[:, None, :], group, p, low)

    def _cross(self, s: np.ndarray, t: np.ndarray, group: np.ndarray, p: np.ndarray, low: np.ndarray) -> None:
        ps, pt, ls, lt = p[s], p[t], low[s], low[t]
        v = (_gap(ps, pt) - _gap(ps, lt) - _gap(ls, pt) + _gap(ls, lt)).ravel()
        pair = (group[s] << 32 | group[t]).ravel()
        order = np.argsort(pair, kind="stable")
        pair, v = pair[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
        for k, x in zip(pair[first].tolist(), np.add.reduceat(v, first).tolist()):
            if k >> 32 != k & 0xFFFFFFFF:
                self.sums[k] = self.sums.get(k, 0) + x

    def full(self) -> bool:
        return len(self.sums) >= self.pairs

    def take(self) -> pa.RecordBatch:
        names = list(self.number)
        rows = [(*names[k >> 32], names[k & 0xFFFFFFFF][1], x) for k, x in self.sums.items()]
        self.sums, self.number = {}, {}
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if j < 3 else pa.int64()) for j in range(4)], ["lang", "source", "item", "value"])


def shared_sums(probs: DataFrame) -> DataFrame:
    """lang, source, item, value: SharedTerms' sums, a task's pairs added up before they are dealt out."""
    rows = probs.select("lang", "term", "source", "p", "floor").repartition("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, n = SharedTerms(), [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n < 1 << 16:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last, term = t.column("lang")[-1].as_py(), t.column("term")[-1].as_py()
            end = t.num_rows
            while end and t.column("term")[end - 1].as_py() == term and t.column("lang")[end - 1].as_py() == last:
                end -= 1
            if end:
                sums.add(t.slice(0, end))
                held, n = t.slice(end).to_batches(), t.num_rows - end
            if sums.full():
                yield sums.take()
        if n:
            sums.add(pa.Table.from_batches(held))
        yield sums.take()

    return rows.mapInArrow(common.tidy(run), "lang string, source string, item string, value long")


def pair_divergence(probs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each source and each other one of its language the gaps of all kept terms. The result has all pairs of sources of a language, and so do the steps; none goes over pairs of documents, or over pairs for each term."""
    other = common.sent_if_small(groups.select("lang", F.col("source").alias("item"), F.col("floor").alias("other_floor")))
    differ = F.col("source") != F.col("item")
    least = groups.join(other, "lang").where(differ).select("lang", "source", "item", F.coalesce(F.col("terms") * gap(F.col("floor"), F.col("other_floor")), F.lit(0)).alias("value"))
    equal = probs.groupBy("lang", "source", "p", "floor").agg(F.count(F.lit(1)).alias("m"))
    p, low, far = F.col("p"), F.col("floor"), F.col("other_floor")
    one = equal.join(other, "lang").where(differ).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(p, far) - gap(low, far))).alias("to"), F.sum(F.col("m") * (gap(far, p) - gap(far, low))).alias("back"))
    one = common.written(one, "one-sided")
    parts = [least, one.select("lang", "source", "item", F.col("to").alias("value")), one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")), shared_sums(probs)]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    out = common.written(whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    common.discard(one)
    return out


# ---- radix selection

GROUP = ["lang", "source"]


def _narrowed(rows: DataFrame, digit: Column, descending: bool) -> DataFrame:
    """lang, source, digit, count, need: the bin of each group's histogram in which its last wanted row lies, and how many are wanted of that bin. rows carry need."""
    bins = rows.groupBy(*GROUP, "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("count"))
    order = F.col("digit").desc() if descending else F.col("digit").asc()
    upto = bins.withColumn("upto", F.sum("count").over(Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need"))).select(*GROUP, "digit", "count", (F.col("need") - F.col("upto") + F.col("count")).alias("need"))


def radix_top(rows: DataFrame, spec: AuditSpec) -> DataFrame:
    """lang, source, term, value, rank: each group's first rows by value, equal ones by the bytes of the term. rows: lang, source, term, value (0 to 2^62), a written table.

    Groups of up to ranks + settled rows are sorted at once. For others, histograms over the bits of the value from the highest
    on tell the bin of the last wanted row; only that bin is looked into further, then its ties two bytes of the term at a time.
    """
    size = common.written(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("count"), F.max("value").alias("most")), "group-rows")
    spare = [size]
    top = size.where(F.col("count") > spec.ranks + spec.settled).agg(F.max("most")).first()[0]
    shift = max(0, int(top).bit_length()) if top is not None else 0
    # a group's bound: its rows have a value above low, or low and a term whose first bytes are not after upto (null: any)
    open_ = size.where(F.col("count") > spec.ranks + spec.settled).select(*GROUP, F.lit(spec.ranks).cast("long").alias("need"), F.lit(0).cast("long").alias("head"))
    closed: list[DataFrame] = []

    def settle(step: DataFrame, bound: dict[str, Column], done: Column) -> DataFrame:
        step = common.written(step.withColumns(bound), "radix")
        spare.append(step)
        closed.append(step.where(done).select(*GROUP, "low", "upto"))
        return step.where(~done)

    few = F.col("count") <= spec.settled
    while top is not None and shift > 0:
        step = max(0, shift - spec.bits)
        hit = rows.join(common.sent_if_small(open_), GROUP).where(F.shiftright("value", shift) == F.col("head"))
        nxt = _narrowed(hit, F.shiftright("value", step), True)
        open_ = settle(nxt.withColumnRenamed("digit", "head"), {"low": F.shiftleft("head", step), "upto": F.lit(None).cast("binary")}, few)
        shift = step
        if open_.isEmpty():
            top = None
    if top is not None:
        open_, at = open_.select(*GROUP, "need", F.col("low"), F.lit(b"").alias("head")), 0
        while not open_.isEmpty():
            raw = F.col("term").cast("binary")
            hit = rows.join(common.sent_if_small(open_), GROUP).where((F.col("value") == F.col("low")) & (F.substring(raw, 1, at) == F.col("head")))
            nxt = _narrowed(hit, F.substring(raw, 1, at + 2), False).join(open_.select(*GROUP, "low"), GROUP)
            ends = F.octet_length("head") < at + 2  # the term ends here, so the bin is one row
            open_ = settle(nxt.withColumnRenamed("digit", "head"), {"upto": F.col("head")}, few | ends).select(*GROUP, "need", "low", "head")
            at += 2
    if closed:
        bound = closed[0]
        for x in closed[1:]:
            bound = bound.unionByName(x)
        bound = common.written(bound, "bounds")
        spare.append(bound)
        x = rows.join(common.sent_if_small(bound), GROUP, "left")
        start = F.substring(F.col("term").cast("binary"), 1, F.octet_length("upto"))
        rows = x.where(F.col("low").isNull() | (F.col("value") > F.col("low")) | ((F.col("value") == F.col("low")) & (F.col("upto").isNull() | (start <= F.col("upto")))))
    order = [F.col("value").desc(), F.col("term").asc()]
    ranked = rows.select(*GROUP, "term", "value", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order)).alias("rank")).where(F.col("rank") <= spec.ranks)
    out = common.written(ranked, "ranked")
    common.discard(*spare)
    return out


def audit(documents: DataFrame, spec: AuditSpec = AuditSpec(), *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of a language by how far they are from a source, part `term` the terms that mark it.

    Null texts, languages and sources are empty strings. A group whose documents have no kept term takes part in the pairs. Rows
    that repeat count again. A language with one source has no pairs, an empty table no rows. Other columns are not read.
    """
    common.small_batches(documents.sparkSession)
    c = lambda x: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(""))
    counts = common.written(term_counts(documents.select(c(lang_col).alias("lang"), c(source_col).alias("source"), c(text_col).alias("text"))), "source-terms")
    kept = common.written(kept_terms(counts, spec.min_docs), "kept-terms")
    groups = common.written(group_sizes(counts, kept), "groups")
    common.discard(counts)
    probs = common.written(probabilities(kept, groups), "probabilities")
    common.discard(kept)
    pairs = pair_divergence(probs, groups)
    terms = radix_top(probs.where(F.col("value").isNotNull()).select(*GROUP, "term", "value"), spec)
    common.discard(probs, groups)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc()))
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(terms.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(d) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS gn FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) x USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST((1000000000 * (coalesce(n, 0) + 1)) // (gn + v) AS HUGEINT) AS p, 1 + CAST((1000000000 * (total + 1)) // (lang_n + v) AS HUGEINT) AS q
  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""
