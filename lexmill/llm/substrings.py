"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes decides at which word beginnings a text is cut, so an insertion moves only the
cuts near it. Chunks are known by a 128-bit digest. Of all places where a digest occurs, the first (lowest id, then lowest
hash of the text, then lowest offset) is the original; successive repeated chunks of a text form a run, and a run of
`min_words` words or more, or with `min_bytes` bytes or more that another text had first, is taken out of the text. A shared
passage loses its first and last words, up to the next cut, only to the chunks that it shares with its surroundings, which is
why min_words lies under the length of the passages looked for.

Cases: null and empty texts have no chunks and stay as they are; rows that repeat an id with the same text count as one
document, rows that repeat an id with different texts are documents of their own; rows without an id come before all others,
so the first of equal texts may be one of them. Where a text has no word beginning for `most` bytes, the hash decides at
character beginnings, so scripts without spaces are cut by their content too, and at most every `most` bytes. Texts of any
length are cut whole; an empty table gives an empty result; added columns get names that no column of the input has.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUP_CHARS = 1 << 20
#: Gear values of the bytes.
GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class ChunkSpec:
    """one_in: of so many word beginnings one is a cut; least: bytes between a cut and the last possible one before it; most: bytes of a chunk; char_in: of so many characters one is a cut, where there are no words; min_words: of a run; min_bytes: of a run, from other texts, which is enough too."""

    one_in: int = 6
    least: int = 12
    most: int = 512
    char_in: int = 16
    min_words: int = 14
    min_bytes: int = 160


def gear(buf: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the gear values of the last 16 bytes, each shifted by two bits a byte; by doubling."""
    h = GEAR[buf]
    for m in (1, 2, 4, 8):
        h[m:] = h[m:] + (h[:-m] << np.uint32(2 * m))
    return h


def _inner_cuts(buf: np.ndarray, h: np.ndarray, begin: int, end: int, spec: ChunkSpec) -> np.ndarray:
    """Cuts at character beginnings within a stretch without cuts at words: by the hash, and where that leaves more than `most` bytes, at that distance."""
    chars = np.flatnonzero((buf[begin + 1 : end] & 0xC0) != 0x80) + begin + 1
    own = chars[h[chars - 1] < np.uint32((1 << 32) // spec.char_in)]
    own = own[np.diff(own, prepend=begin) >= spec.least]
    edges = np.concatenate([[begin], own, [end]])
    parts = [own]
    for a, b in zip(edges[:-1][np.diff(edges) > spec.most].tolist(), edges[1:][np.diff(edges) > spec.most].tolist()):
        forced = np.arange(a + spec.most, b, spec.most)
        at = np.searchsorted(chars, forced)
        forced = chars[at[at < len(chars)]]
        parts.append(forced[forced < b])
    return np.concatenate(parts).astype(np.int64)


def cuts(buf: np.ndarray, spec: ChunkSpec = ChunkSpec()) -> tuple[np.ndarray, np.ndarray]:
    """(where chunks begin, beginnings of words as flags) in one text's bytes."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    word = np.concatenate([[True], space[:-1]]) & ~space
    h = gear(buf)
    possible = np.flatnonzero(word[1:] & (h[:-1] < np.uint32((1 << 32) // spec.one_in))) + 1
    possible = possible[np.diff(possible, prepend=-spec.least) >= spec.least]
    at = np.concatenate([[0], possible[possible > 0]])
    gaps = np.diff(np.append(at, len(buf)))
    if (gaps > spec.most).any():
        parts = [at]
        for a, g in zip(at[gaps > spec.most].tolist(), gaps[gaps > spec.most].tolist()):
            parts.append(_inner_cuts(buf, h, a, a + g, spec))
        at = np.unique(np.concatenate(parts))
    return at, word


def chunk_rows(df: DataFrame, id_col: str, text_col: str, spec: ChunkSpec) -> DataFrame:
    """_id, _t long (hash of the text), d1 long, d2 long (the digest), place long: start << 32 | bytes << 16 | words of each chunk."""
    src = common.ids_and_text(df, id_col, text_col).where("_text is not null and _text <> ''").withColumn("_t", F.xxhash64("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    names = ["_id", "_t", "d1", "d2", "place"]

    def run(batches):
        blake = hashlib.blake2b
        for batch in batches:
            row = 0
            for group in common.groups(batch, GROUP_CHARS):
                digests, places, many = [], [], []
                first_row, row = row, row + len(group)
                for _, text in group:
                    raw = text.encode("utf-8", "surrogatepass")
                    buf = np.frombuffer(raw, np.uint8)
                    at, word = cuts(buf, spec)
                    ends = np.append(at[1:], len(buf))
                    n = np.add.reduceat(word.astype(np.int64), at)
                    places.append(at << 32 | np.minimum(ends - at, 65535) << 16 | n)
                    view = memoryview(raw)
                    digests += [blake(view[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), ends.tolist())]
                    many.append(len(at))
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                of = pa.array(np.repeat(np.arange(first_row, row), many))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(np.concatenate(places))], names)

    return src.mapInArrow(common.tidy(run), f"_id {kind}, _t long, d1 long, d2 long, place long")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """_id, _t, spans array<struct<start:int,bytes:int,words:int>>: the runs to take out, for texts that have any; a written table.

    Counting digests combines in each task before the shuffle, and the join back is one that adaptive execution splits
    where a digest is frequent. Only repeated chunks go on, gathered for each text, never for a digest.
    """
    chunks = chunk_rows(df, id_col, text_col, spec)
    first = chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_t", "place")).alias("first")).where("n > 1")
    again = chunks.join(first.select("d1", "d2", "first"), ["d1", "d2"]).where(~F.struct("_id", "_t", "place").eqNullSafe(F.col("first")))
    mask = F.lit(65535)
    p = F.col("place")
    other = ~F.struct("_id", "_t").eqNullSafe(F.struct("first._id", "first._t"))
    rows = again.select("_id", "_t", "place", other.alias("other")).repartition("_id", "_t").distinct()
    rows = rows.select("_id", "_t", "other", F.shiftright(p, 32).cast("int").alias("start"), F.shiftright(p, 16).bitwiseAND(mask).cast("int").alias("bytes"), p.bitwiseAND(mask).cast("int").alias("words"))
    w = Window.partitionBy("_id", "_t").orderBy("start")
    rows = rows.withColumn("new", F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("bytes")).over(w), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("_id", "_t", "run").agg(F.min("start").alias("start"), F.sum("bytes").cast("int").alias("bytes"), F.sum("words").cast("int").alias("words"), F.sum(F.when(F.col("other"), F.col("bytes")).otherwise(0)).alias("far"))
    long = runs.where((F.col("words") >= spec.min_words) | (F.col("far") >= spec.min_bytes))
    return common.written(long.groupBy("_id", "_t").agg(F.array_sort(F.collect_list(F.struct("start", "bytes", "words"))).alias("spans")), "spans")


def without_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the spans cut out of text_col; beside its own columns _removed_bytes long and _spans int, with _ behind these names where df has them itself."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(text, spans):
            t, own = t.as_py(), own.as_py()
            if not own or t is None:
                out.append(t)
                continue
            raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for s in own:
                parts.append(raw[at : s["start"]])
                at = s["start"] + s["bytes"]
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    # Spans are small; texts are shuffled only where the spans' table is too large to send around.
    key, text, mine, size, number = (common.free_name(x, df) for x in ("_span_id", "_span_text", "_own", "_removed_bytes", "_spans"))
    side = common.sent_if_small(spans.select(F.col("_id").alias(key), F.col("_t").alias(text), F.col("spans").alias(mine)))
    joined = df.join(side, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(f"`{text_col}`") == F.col(text)), "left")
    removed = F.coalesce(F.aggregate(mine, F.lit(0), lambda a, s: a + s["bytes"]), F.lit(0)).cast("long")
    kept = [F.when(F.col(mine).isNull(), F.col(f"`{c}`")).otherwise(cut(F.when(F.col(mine).isNotNull(), F.col(f"`{c}`")), F.col(mine))).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*kept, removed.alias(size), F.when(F.col(mine).isNull(), 0).otherwise(F.size(mine)).alias(number))


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text without repeated passages, how many bytes and passages went, and whether any did."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = without_spans(docs, repeated_spans(docs))
    return out.select("doc_id", "text", F.col("_removed_bytes").alias("removed_bytes"), F.col("_spans").alias("n_spans"), (F.col("_spans") > 0).alias("repeats"))


def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are taken out of the texts; a text of which nothing is left goes, n_chars follows the text."""
    out = without_spans(docs, repeated_spans(docs))
    out = out.where((F.col(f"`{out.columns[-1]}`") == 0) | (F.trim("text") != "")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
