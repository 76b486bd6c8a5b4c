"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most bytes of text that come to the driver for fitting a model.
TRAIN_BYTES = 96 << 20


def bounded_per_class(df: DataFrame, label: str, id_col: str, per_class: int, seed: int = 17) -> DataFrame:
    """About per_class rows of each label at most, chosen by a hash of the id: one count by label, one filter, no sort.

    Rows whose label is null are left out. The labels themselves must be few (languages, grades).
    """
    n = df.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    if not n:
        return df.limit(0)
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for r in n:
        keep = keep | ((F.col(label) == F.lit(r[label])) & (u < min(1.0, per_class / r["count"])))
    return df.where(keep)


def bounded_texts(some: DataFrame, label: str, most: int = TRAIN_BYTES) -> list[tuple]:
    """(label, text) of a bounded sample with columns _id, label and _text, in order of a hash of the id, while their bytes fit in `most`; an id with several rows counts once, by its least label and text."""
    one = some.groupBy("_id").agg(F.min(F.struct(label, "_text")).alias("x")).select("_id", f"x.{label}", "x._text", F.xxhash64("_id").alias("_at"), F.octet_length("x._text").cast("long").alias("_size"))
    one = common.written(one, "sample")
    held, last = 0, None
    for at, size in sorted(tuple(r) for r in one.select("_at", "_size").collect()):
        if held + size > most:
            break
        held, last = held + size, at
    rows = one.where(F.col("_at") <= last).select("_at", label, "_text").collect() if last is not None else []
    common.discard(one)
    return [(r[1], r[2]) for r in sorted(rows)]
