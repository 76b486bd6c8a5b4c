"""Words of a text without spaces: the best path through the graph of dictionary words over its characters.

Every substring of a text that is a dictionary word is an edge; a character that no word begins with can stand alone at a
price. Texts are dealt into chunks of a bounded number of characters. A bitmap of the dictionary leaves few of a chunk's
substrings; those go, once a chunk, through a join with the dictionary, which decides. A chunk's texts then meet the words that
they hold, and the best score of each place is computed for all of its texts at once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Score of a lone character under that of a word that occurs once, in thousandths of a nat.
LONE = 4000
#: Characters of a chunk, about; a longer text is a chunk with its neighbours.
CHUNK_CHARS = 1 << 19
#: Bits of the dictionary's bitmap: at most, at least, and for a word. With more words it lets more through; the join is exact.
MOST_BITS, LEAST_BITS, WORD_BITS = 1 << 28, 1 << 15, 16
#: Bits in a row of Spark's bitmaps.
ROW_BITS = 1 << 15
NO_WORD = -(1 << 30)


def dictionary(counts: DataFrame, word: str = "w", cnt: str = "cnt") -> DataFrame:
    """w, score: thousandths of a nat above those of a word that occurs once, as whole numbers, so sums are exact."""
    return counts.select(F.col(word).alias("w"), F.floor(1000 * F.log(F.col(cnt).cast("double"))).cast("int").alias("score"))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text begins, and the end)."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    first = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint32), first


def windows(codes: np.ndarray, longest: int, salt: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(k, 64-bit hashes of the k code points from each place on), for k from 1."""
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.full(len(c) + 1, np.uint64(salt))
    for k in range(1, min(longest, len(c)) + 1):
        h = (h[:-1] ^ c[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield k, h


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that a hash has in a bitmap."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> shift, (h * np.uint64(0xA0761D6478BD642F)) >> shift


def bitmap(words: DataFrame, longest: int) -> tuple[np.ndarray, int]:
    """(bytes, bits): a bit field of bounded size that has both bits of every word of up to longest characters."""
    words = words.select("w").where(F.length("w").between(1, longest))
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (WORD_BITS * words.count()).bit_length()))

    def places(batches):
        for batch in batches:
            codes, first = code_points(batch.column(0).to_pylist())
            size = np.diff(first)
            for k, h in windows(codes, longest):
                own = h[first[:-1][size == k]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(bit_places(own, bits))).astype(np.int64))], ["x"])

    x = words.mapInArrow(places, "x long").select((F.col("x") + 1).alias("x"))
    rows = x.groupBy(F.bitmap_bucket_number("x").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    field = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["row"] - 1) * (ROW_BITS // 8)
        field[at : at + ROW_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return field, bits


def _rest(first: np.ndarray) -> np.ndarray:
    """For each place how many characters its text has from there on."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])


def substrings(texts: list[str], field: np.ndarray, bits: int, longest: int) -> set[str]:
    """The substrings of up to longest characters that the bitmap does not rule out."""
    codes, first = code_points(texts)
    whole, rest, out = "".join(texts), _rest(first), set()
    for k, h in windows(codes, longest):
        maybe = np.flatnonzero(rest[: len(h)] >= k)
        for n in (0, 1):
            p = bit_places(h[maybe], bits)[n]
            maybe = maybe[(field[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        out.update(whole[i : i + k] for i in maybe.tolist())
    return out


def edges(codes: np.ndarray, first: np.ndarray, scores: dict[str, int], longest: int, lone: int) -> np.ndarray:
    """[place, longest]: the score of the word that ends behind a place, the longest first; NO_WORD where there is none."""
    out = np.full((len(codes), longest), NO_WORD, np.int32)
    out[:, -1] = -lone
    rest = _rest(first)
    words = list(scores)
    own, at = code_points(words)
    size, score = np.diff(at), np.array([scores[w] for w in words], np.int64)
    for salt in itertools.count():
        # Words of equal hashes are told apart by another salt.
        hashes = {k: h[at[:-1][size == k]] for k, h in windows(own, longest, salt)}
        if all(len(np.unique(h)) == len(h) for h in hashes.values()):
            break
    for k, h in windows(codes, longest, salt):
        if not len(hashes.get(k, ())):
            continue
        order = np.argsort(hashes[k])
        known, word = hashes[k][order], np.flatnonzero(size == k)[order]
        small = np.zeros(1 << 16, bool)
        small[known >> np.uint64(48)] = True
        i = np.flatnonzero((rest[: len(h)] >= k) & small[h >> np.uint64(48)])
        n = np.minimum(np.searchsorted(known, h[i]), len(known) - 1)
        hit = known[n] == h[i]
        i, n = i[hit], word[n[hit]]
        same = np.ones(len(i), bool)
        for j in range(k):
            same &= codes[i + j] == own[at[n] + j]
        i, n = i[same], n[same]
        out[i + k - 1, longest - k] = np.maximum(out[i + k - 1, longest - k], score[n])
    return out


def best_cuts(texts: list[str], scores: dict[str, int], base: int, longest: int, lone: int) -> list[list[str]]:
    """Each text's words on its best path. base: what each word costs. Of equal scores the longer last word stays."""
    codes, first = code_points(texts)
    gain = edges(codes, first, scores, longest, lone)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    # Each text has a row of places from 0, with places that no path reaches before it.
    head = np.concatenate([[0], np.cumsum(size[order] + 1 + longest)]).astype(np.int64)
    best = np.full(head[-1], -(1 << 60), np.int64)
    best[head[:-1] + longest] = 0
    length = np.zeros(len(codes), np.int32)
    back = np.arange(longest)
    live, begin = len(order), first[:-1][order]
    falling = size[order]
    for e in range(1, int(size.max(initial=0)) + 1):
        while falling[live - 1] < e:
            live -= 1
        end = begin[:live] + (e - 1)
        s = best[(head[:live] + e)[:, None] + back] + gain[end]
        top = s.argmax(axis=1)
        best[head[:live] + longest + e] = s[np.arange(live), top] - base
        length[end] = longest - top
    out = []
    for t, b in zip(texts, first[:-1].tolist()):
        own, e, words = length[b : b + len(t)].tolist(), len(t), []
        while e:
            words.append(t[e - own[e - 1] : e])
            e -= own[e - 1]
        out.append(words[::-1])
    return out


def cut(texts: DataFrame, words: DataFrame, total: int, longest: int = 24, lone: int = LONE) -> DataFrame:
    """The columns of texts, and pieces, for each text s without white space. words: w, score, a written table; total: occurrences of all words, from which each word's price follows.

    Work grows with characters times the longest word that is looked for; a join has one row for each word that a chunk
    holds. A text lies in one task, so long ones should come sentence by sentence. Empty and null texts have no row.
    """
    base = math.floor(1000 * math.log(max(1, total)))
    t = texts.where("s is not null and s <> ''")
    chunks = 1 + (t.agg(F.sum(F.length("s"))).first()[0] or 0) // CHUNK_CHARS
    field, bits = bitmap(words, longest)
    sent = t.sparkSession.sparkContext.broadcast(field)
    t = t.withColumn("_chunk", F.pmod(F.xxhash64(*t.columns), F.lit(chunks)).cast("int"))
    kind = StructType(texts.schema.fields).add("pieces", ArrayType(StringType()))

    def held(table: pa.Table) -> pa.Table:
        found = sorted(substrings(table.column("s").to_pylist(), sent.value, bits, longest))
        return pa.table({"_chunk": pa.array([table.column("_chunk")[0].as_py()] * len(found), pa.int32()), "w": pa.array(found, pa.string())})

    def best(table: pa.Table, own: pa.Table) -> pa.Table:
        scores: dict[str, int] = {}
        for w, score in zip(own.column("w").to_pylist(), own.column("score").to_pylist()):
            scores[w] = max(score, scores.get(w, score))
        pieces = best_cuts(table.column("s").to_pylist(), scores, base, longest, lone)
        return table.drop_columns(["_chunk"]).append_column("pieces", pa.array(pieces, pa.list_(pa.string())))

    asked = t.select("_chunk", "s").groupBy("_chunk").applyInArrow(held, "_chunk int, w string")
    found = asked.join(words.select("w", "score"), "w").select("_chunk", "w", "score")
    return t.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(best, kind)
