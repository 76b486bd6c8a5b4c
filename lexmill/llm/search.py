"""Ranked lexical search: items' terms times the term-document matrix, in blocks, with 64-bit integer impacts.

The item-term matrix is cut into blocks of bounded size. For each, two passes over the documents are made: one counts the
documents that hold each of the block's terms (with the number of documents and of terms, in the first), the other builds the
term-document matrix of some thousand documents at a time, merges its rows by Gustavson's method and keeps each item's best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A term's characters: ASCII letters and digits and all that lies beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text after A-Z are lower-cased and all separators are spaces, so that split() gives the terms.
FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Bytes of a text that are split at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class SearchSpec:
    """k: hits an item. block_bytes: most bytes of an item block's terms, which go to every task (an item with more is a block of its own). docs, postings: size of a block of the term-document matrix."""

    k: int = 20
    block_bytes: int = 16 << 20
    docs: int = 4096
    postings: int = 1 << 20


def term_counts(text: str, known: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms of a text, and occurrences of the known ones by their number. Long texts are split slice by slice."""
    raw, at, n = text.encode().translate(FOLDED), 0, 0
    held: Counter[bytes] = Counter()
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE:
            end = raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        n += len(words)
        held.update(words)
        if end < len(raw):
            held = Counter({w: held[w] for w in held.keys() & known.keys()})
        at = end
    return n, {known[w]: held[w] for w in held.keys() & known.keys()}


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, times: an id's rows make one item, their terms together."""
    folded = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    words = items.select(F.col(f"`{id_col}`").alias("item"), F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class ItemBlock:
    """Rows of the item-term matrix: of item i the terms term[first[i]:first[i+1]], each so many times."""

    ids: list
    known: dict[bytes, int]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def item_block(rows: pa.Table) -> ItemBlock:
    known: dict[bytes, int] = {}
    by: dict[object, list[tuple[int, int]]] = {}
    for item, term, times in zip(*(rows.column(c).to_pylist() for c in ("item", "term", "times"))):
        by.setdefault(item, []).append((known.setdefault(term.encode(), len(known)), times))
    flat = [x for v in by.values() for x in v]
    first = np.cumsum([0, *map(len, by.values())])
    return ItemBlock(list(by), known, first, np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64))


def doc_freqs(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and for each known term the documents that hold it: sums made in the tasks, then by key."""
    size = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, held, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for _, text in common.text_rows(b):
                n, tf = term_counts(text, known)
                held, total = held + (n > 0), total + n
                if tf:
                    df[np.fromiter(tf, np.int64, len(tf))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [held, total]))], ["term", "n"])

    sums = docs.mapInArrow(common.tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 2, np.int64)
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return int(out[-1]), int(out[-2]), out[:size]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def merged(block: ItemBlock, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each item's row of the product: its terms' rows of the term-document matrix are added up in one dense row of int64."""
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    begin = np.searchsorted(term[order], np.arange(len(block.known) + 1))
    for i in range(len(block.ids)):
        row = np.zeros(n_docs, np.int64)
        for j, times in zip(block.term[block.first[i] : block.first[i + 1]].tolist(), block.times[block.first[i] : block.first[i + 1]].tolist()):
            a, b = begin[j], begin[j + 1]
            if a < b:
                row[doc[a:b]] += times * impact[a:b]
        yield i, row


def best_of(row: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Documents with the k highest scores above 0, equal scores by place."""
    at = np.flatnonzero(row > 0)
    if len(at) > k:
        least = np.partition(row[at], len(at) - k)[len(at) - k]
        at = at[row[at] >= least]
    return at[np.lexsort((place[at], -row[at]))][:k]


def _key(hit: tuple) -> tuple:
    score, doc = hit
    return -score, doc is None, doc if doc is not None else 0


def block_hits(docs: DataFrame, block: ItemBlock, w: np.ndarray, n_docs: int, n_terms: int, spec: SearchSpec, item_type: T.DataType, doc_type: T.DataType) -> DataFrame:
    """item, doc, score: the k best of each item in each task."""
    out_schema = T.StructType([T.StructField("item", item_type), T.StructField("doc", doc_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.ids]
        ids: list = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kind, held = None, 0

        def reduce() -> None:
            term, doc, impact = (np.concatenate(x) for x in zip(*parts))
            place = np.empty(len(ids), np.int64)
            place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
            for i, row in merged(block, term, doc, impact, len(ids)):
                at = best_of(row, place, spec.k)
                if len(at):
                    best[i] = sorted([*best[i], *zip(row[at].tolist(), (ids[j] for j in at))], key=_key)[: spec.k]

        for b in batches:
            kind = b.column(0).type
            for doc_id, text in common.text_rows(b):
                n, tf = term_counts(text, block.known)
                if not tf:
                    continue
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                terms, count = np.fromiter(tf, np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))
                parts.append((terms, np.full(len(tf), len(ids)), w[terms] * ((1_000_000_000 * count) // (1000 * count + 12 * m))))
                ids.append(doc_id)
                held += len(tf)
                if len(ids) >= spec.docs or held >= spec.postings:
                    reduce()
                    ids, parts, held = [], [], 0
        if parts:
            reduce()
        rows = [(i, doc, score) for i, hits in enumerate(best) for score, doc in hits]
        if rows:
            item_kind = pa.array(block.ids).type
            yield pa.RecordBatch.from_arrays([pa.array([block.ids[r[0]] for r in rows], item_kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc", "score"])

    return docs.mapInArrow(common.tidy(run), out_schema)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """hits with a rank, the k first of each item. Each task has k rows an item at most; with many tasks an item's are first cut in parts of their own."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    for key in (["item", "part"], ["item"]):
        x = hits.withColumn("part", F.pmod(F.xxhash64("doc", "score"), F.lit(64))) if "part" in key else hits
        hits = x.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k).select("item", "doc", "score", "rank")
    return hits


def search(documents: DataFrame, items: DataFrame, spec: SearchSpec = SearchSpec(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows. Each row of documents is a
    document, so copies rank one after another; rows that repeat an item's id are one item. Documents without an id come
    last among equal scores. Other columns are not read. With no items or no documents the result is empty.
    """
    spark = documents.sparkSession
    docs = common.ids_and_text(documents, id_col, text_col)
    terms = common.written(item_terms(items, item_col, item_text), "item-terms")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()[0]
    n_blocks = -(-size // spec.block_bytes)
    out, n_docs, n_terms = [], 0, 0
    for b in range(n_blocks):
        block = item_block(terms.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).toArrow())
        if not block.ids:
            continue
        n_docs, n_terms, df = doc_freqs(docs, block.known)
        if n_terms:
            hits = block_hits(docs, block, weights(df, n_docs), n_docs, n_terms, spec, terms.schema["item"].dataType, docs.schema["_id"].dataType)
            out.append(common.written(top_k(hits, spec.k), "hits"))
    common.discard(terms)
    names = [F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score"]
    if not out:
        empty = T.StructType([T.StructField(item_col, terms.schema["item"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema["_id"].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select(*names)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, doc_id, len(t), term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
