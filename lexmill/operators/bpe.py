"""Byte-pair merges learnt from word counts, and words cut by them.

Words are counted first, so each distinct one is held once, as an array of symbol numbers with its adjacent pairs. A round
takes as many of the best pairs as are sure to be the next ones in their order, merges them in those words only that have
one, and corrects the pair counts by what these words had and have. Rewritten words are appended: a row is out of date as
soon as it holds a pair that was merged after it was written, so nothing has to be looked up, and every few rounds the rows
that are up to date are written anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import Steps

#: Stands before the first letter of a word.
START = "▁"
#: Number of characters that are too rare to be kept: no pair holds it.
RARE = 0
_SHIFT = 1 << 32


@dataclass(frozen=True)
class BpeSpec:
    """merges: of each group. coverage: share of all characters that the alphabet covers, the most frequent first. least: count below which a pair is not merged. top: pairs of a group that a round looks at. compact: rounds between two complete rewrites."""

    merges: int = 1000
    coverage: float = 0.9995
    least: int = 2
    top: int = 256
    compact: int = 8


def alphabet(words: DataFrame, coverage: float) -> list[str]:
    """Characters that cover so much of all words, in code point order. There are at most as many as Unicode has, so they fit the driver."""
    chars = words.select(F.explode(F.split(F.concat(F.lit(START), F.col("w")), "")).alias("ch"), "cnt").where("ch <> ''").groupBy("ch").agg(F.sum("cnt").alias("n"))
    rows = sorted(((r["n"], r["ch"]) for r in chars.collect()), key=lambda x: (-x[0], x[1]))
    total, got, kept = sum(n for n, _ in rows), 0, []
    for n, ch in rows:
        if got >= coverage * total:
            break
        got += n
        kept.append(ch)
    return sorted(set(kept) | {START}, key=lambda c: c.encode())


def merge_symbols(symbols: list[int], new: dict[tuple[int, int], int]) -> list[int]:
    """Pairs become one symbol, from left to right."""
    out: list[int] = []
    for s in symbols:
        m = new.get((out[-1], s)) if out else None
        if m is None:
            out.append(s)
        else:
            out[-1] = m
    return out


def sure_prefix(ranked: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Of (count, left, right) in order, the first ones that merging one after another would take in just this order.

    While no left symbol is another pair's right one, merging one pair leaves the count of the next as it is, and a pair
    that arises has at most the count of a pair that ranks behind all taken ones; equal counts go to older symbols, so it
    comes later. A doubled symbol can form its own pair again and ends the list.
    """
    lefts, rights, out = set(), set(), []
    for n, a, b in ranked[:room]:
        if a in rights or b in lefts or (a == b and out):
            break
        out.append((n, a, b))
        lefts.add(a)
        rights.add(b)
        if a == b:
            break
    return out


#: at: the round that wrote the row; old: its symbols before, null in a complete rewrite.
NAMES = ["g", "w", "cnt", "at", "old", "sym", "adj"]
WORDS = "g string, w string, cnt bigint, at int, old array<int>, sym array<int>, adj array<bigint>"


def _adjacent(sym: list[int]) -> list[int]:
    return sorted({a * _SHIFT + b for a, b in zip(sym, sym[1:]) if a != RARE and b != RARE})


def _symbols(words: DataFrame, letters: list[str]) -> DataFrame:
    number = {c: i + 1 for i, c in enumerate(letters)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w").to_pylist()
            sym = [[number.get(c, RARE) for c in START + x] for x in w]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("w"), b.column("cnt"), pa.array([0] * len(w), pa.int32()), pa.array([None] * len(w), pa.list_(pa.int32())), pa.array(sym, pa.list_(pa.int32())), pa.array(map(_adjacent, sym), pa.list_(pa.int64()))], names=NAMES)

    return words.select("g", "w", F.col("cnt").cast("long").alias("cnt")).mapInArrow(run, WORDS)


def _merged(rows: DataFrame, new: dict[str | None, dict[tuple[int, int], int]], at: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sym = [merge_symbols(s, new.get(g, {})) for g, s in zip(b.column("g").to_pylist(), b.column("sym").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("w"), b.column("cnt"), pa.array([at] * len(sym), pa.int32()), b.column("sym").cast(pa.list_(pa.int32())), pa.array(sym, pa.list_(pa.int32())), pa.array(map(_adjacent, sym), pa.list_(pa.int64()))], names=NAMES)

    return rows.mapInArrow(run, WORDS)


Pairs = dict[str | None, list[tuple[int, int]]]


def _has(pairs: Pairs) -> Column:
    """Whether a row holds one of its group's pairs."""
    out = F.lit(False)
    for g, some in pairs.items():
        out = out | (F.col("g").eqNullSafe(F.lit(g)) & F.arrays_overlap("adj", F.array(*(F.lit(a * _SHIFT + b).cast("long") for a, b in some))))
    return out


def _stale(rounds: dict[int, Pairs]) -> Column:
    """Whether a row holds a pair that was merged after it was written: a newer row of its word is there."""
    out = F.lit(False)
    for r, pairs in rounds.items():
        out = out | ((F.col("at") < r) & _has(pairs))
    return out


def _pairs(rows: DataFrame) -> DataFrame:
    """g, pair, n: what rows add to the pair counts, by place: of their symbols, and with a minus of those before."""

    def code(sym: str, sign: int) -> Column:
        n = F.greatest(F.size(sym) - 1, F.lit(0))
        return F.zip_with(F.slice(sym, 1, n), F.slice(sym, 2, n), lambda a, b: F.struct((a.cast("long") * _SHIFT + b).alias("pair"), F.lit(sign).alias("sign")))

    none = F.array().cast("array<struct<pair: bigint, sign: int>>")
    x = rows.select("g", "cnt", F.explode(F.concat(code("sym", 1), F.coalesce(code("old", -1), none))).alias("x"))
    x = x.select("g", "x.pair", (F.col("cnt") * F.col("x.sign")).alias("n"))
    return x.where((F.col("pair") >= _SHIFT) & (F.col("pair") % _SHIFT > 0))


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("g", "pair").agg(F.sum("n").alias("n"))


def train(words: DataFrame, spec: BpeSpec = BpeSpec(), group: str = "lang") -> DataFrame:
    """group, rank (from 1), left, right, piece, cnt of each group's merges. words: group, w, cnt, each word once a group.

    The pair with the highest count is merged first; equal counts go to the pair whose newer symbol is older, then to the
    older left and right one, characters being oldest in code point order. Occurrences are counted by places, so aaa has aa
    twice. A null group is a group; null and empty words are left out, and so are those without a count.
    """
    spark = words.sparkSession
    steps = Steps(spark, "bpe")
    words = words.select(F.col(f"`{group}`").cast("string").alias("g"), "w", "cnt").where("w <> '' and cnt is not null")
    letters = alphabet(words, spec.coverage)
    text = dict(enumerate(letters, 1))
    base, table = steps.write(_symbols(words, letters))
    schema = table.schema
    sums, counted = steps.write(_summed(_pairs(table)))
    newer_rows: list[str] = []  # tables of rewritten words since the base
    rounds: dict[int, Pairs] = {}  # pairs merged since the base, by round
    done: Pairs = {}
    names: dict[str | None, dict[int, str]] = {}
    out, at = [], 0
    newer = F.greatest(F.shiftright("pair", 32), F.col("pair") % _SHIFT)
    while True:
        total = counted
        if newer_rows:
            total = _summed(counted.unionByName(_pairs(spark.read.schema(schema).parquet(*newer_rows))))
        w = Window.partitionBy("g").orderBy(F.desc("n"), newer, "pair")
        head: dict[str | None, list[tuple[int, int, int]]] = {}
        best = total.where(F.col("n") >= spec.least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= spec.top)
        for r in sorted(best.collect(), key=lambda r: r["r"]):
            head.setdefault(r["g"], []).append((r["n"], *divmod(r["pair"], _SHIFT)))
        at += 1
        batch: Pairs = {}
        new: dict[str | None, dict[tuple[int, int], int]] = {}
        for g, ranked in head.items():
            own, said = done.setdefault(g, []), names.setdefault(g, dict(text))
            for n, a, b in sure_prefix(ranked, spec.merges - len(own)):
                own.append((a, b))
                number = len(letters) + len(own)
                said[number] = said[a] + said[b]
                new.setdefault(g, {})[a, b] = number
                batch.setdefault(g, []).append((a, b))
                out.append((g, len(own), said[a], said[b], said[number], n))
        if not batch or all(len(done[g]) >= spec.merges for g in head):
            break
        live = spark.read.schema(schema).parquet(base, *newer_rows)
        path, _ = steps.write(_merged(live.where(_has(batch) & ~_stale(rounds)), new, at))
        newer_rows.append(path)
        rounds[at] = batch
        if len(newer_rows) >= spec.compact:
            live = spark.read.schema(schema).parquet(base, *newer_rows).where(~_stale(rounds))
            path, table = steps.write(live.withColumns({"old": F.lit(None).cast("array<int>"), "at": F.lit(at)}))
            new_sums, counted = steps.write(_summed(_pairs(table)))
            steps.drop(base, sums, *newer_rows)
            base, sums, newer_rows, rounds = path, new_sums, [], {}
    steps.drop(steps.root)
    return spark.createDataFrame(out, f"`{group}` string, rank int, left string, right string, piece string, cnt bigint")


def cut(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """A word's pieces: the merge of lowest rank first, at all its places from the left."""
    parts = list(START + word)
    while len(parts) > 1:
        best = min(((rank[p], p) for p in zip(parts, parts[1:]) if p in rank), default=None)
        if best is None:
            break
        at = iter(range(len(parts)))
        joined: list[str] = []
        for i in at:
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best[1]:
                joined.append(parts[i] + parts[i + 1])
                next(at)
            else:
                joined.append(parts[i])
        parts = joined
    return parts


def encode(words: DataFrame, merges: DataFrame, group: str = "lang") -> DataFrame:
    """words with pieces. The merges are bounded by the training's parameter and go to every task; each distinct word should come once."""
    rank: dict[str | None, dict[tuple[str, str], int]] = {}
    for r in merges.collect():
        rank.setdefault(r[group], {})[r["left"], r["right"]] = r["rank"]
    schema = T.StructType([*words.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [cut(w or "", rank.get(g, {})) for g, w in zip(b.column(group).to_pylist(), b.column("w").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.list_(pa.string()))], names=[*b.schema.names, "pieces"])

    return words.mapInArrow(run, schema)
