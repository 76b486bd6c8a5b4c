"""Vocabularies and encodings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECIALS = ("<pad>", "<unk>", "<s>", "</s>")
UNK, BOS, EOS = 1, 2, 3


def build_vocab(counts: DataFrame, token: str = "w", cnt: str = "cnt", first: list[str] | None = None, cap: int = 32_000) -> DataFrame:
    """token, id, freq: the most frequent first, ids from 4; the cap counts the specials, and a token that is a special uses its place without an id.

    Ties go to the token that sorts by `first` (its first place in the corpus, else itself). Only cap rows are ranked: the rest never leaves the limit.
    """
    order = [F.desc(cnt), *(F.col(c) for c in first or []), F.col(token)]
    head = counts.orderBy(*order).limit(cap - len(SPECIALS))
    own = head.where(~F.col(token).isin(*SPECIALS))
    return own.select(F.col(token), (F.row_number().over(Window.orderBy(*order)) + 3).alias("id"), F.col(cnt).alias("freq"))


def encode(tokens: DataFrame, vocab: DataFrame, token: str = "w") -> DataFrame:
    """tokens with id; words without one are <unk>. A capped vocabulary is small by construction and is broadcast."""
    return tokens.join(F.broadcast(vocab.select(token, "id")), token, "left").withColumn("id", F.coalesce("id", F.lit(UNK)))


def encode_lines(lines: DataFrame, vocab: DataFrame, words: str, ids: str = "ids", token: str = "w") -> DataFrame:
    """lines with the array `words` replaced by the array `ids`, in order; words without an id are <unk>.

    Whole lines pass through Arrow, so nothing is exploded, shuffled or gathered; the capped vocabulary goes to every task.
    """
    v = vocab.select(token, F.col("id").cast("int").alias("id")).toArrow()
    known, number = v.column(token).combine_chunks(), v.column("id").combine_chunks()
    kept = [f for f in lines.schema.fields if f.name != words]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index(words))
            at = pc.index_in(lists.flatten(), value_set=known)
            flat = pc.fill_null(number.take(at), UNK) if len(number) else pa.array([UNK] * len(at), pa.int32())
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.ListArray.from_arrays(offsets, flat)], names=[*(f.name for f in kept), ids])

    return lines.mapInArrow(run, schema)


def sequences(encoded: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """key, ids: begin, ids in order, end. Collects the words of one line, not of a group of lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos, "id"))), lambda x: x["id"])
    return encoded.groupBy(*key).agg(F.concat(F.array(F.lit(BOS)), ordered, F.array(F.lit(EOS))).alias("ids"))


def ranks(df: DataFrame, bucket, order: list) -> DataFrame:
    """df with _rank, from 1 in the given order. `bucket` is a column that grows with the order.

    Rows are counted by bucket, counts are accumulated over a row a bucket, and rows are numbered within their bucket, so
    no task gets all rows.
    """
    b = df.withColumn("_b", bucket)
    sums = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"))
    return b.withColumn("_inside", F.row_number().over(Window.partitionBy("_b").orderBy(*order))).join(before, "_b").withColumn("_rank", F.col("_inside") + F.col("_before")).drop("_b", "_inside", "_before")


def line_offsets(lines: DataFrame, key: str, size: str, parts: int = 256) -> DataFrame:
    """lines with offset: the sum of the sizes of all lines before it in order of key.

    Two levels: sums of ranges of keys are accumulated in one small window (a row a range), then each line within its range,
    so no task gets all lines. Ranges are bounded by quantiles of the keys, so they are even however sparse the keys are.
    """
    bounds = sorted(set(lines.select(F.col(key).cast("double").alias("_k")).approxQuantile("_k", [i / parts for i in range(1, parts)], 0.001)))
    b = lines.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x < F.col(key).cast("double"))))
    sums = b.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"))
    inside = F.sum(size).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    # at most `parts` rows are sent
    return b.withColumn("_inside", inside).join(F.broadcast(before), "_b").withColumn("offset", F.col("_inside") + F.col("_before")).drop("_b", "_inside", "_before")
