"""Resumable work: a table is cut into chunks by a deterministic number, and a restart does only those that are missing.

A chunk is a folder of compressed Parquet, written under another name and then renamed, so it is there as a whole or not at
all. A manifest says what a run wants, and is replaced by a rename too; chunks of another plan are refused. Lost executors
cost the tasks that they ran, a lost driver the wave that was under way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Plan:
    """name: what the chunks hold; a change of the work needs another. chunks: how many, so that one is small enough for a task. wave: chunks of one Spark job."""

    name: str
    chunks: int
    wave: int = 64


class Folder:
    """Files below a path of any store that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path())] if self.fs.exists(self.path()) else []

    def rename(self, old: str, new: str) -> None:
        """An error where `new` exists or the store refuses."""
        if self.fs.exists(self.path(new)) or not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} could not become {new} in {self.root}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read_json(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Atomic: readers see the old file or the new one."""
        temp = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(temp), True)
        stream.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind._java_lang_class if hasattr(kind, "_java_lang_class") else self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = kind.OVERWRITE
        context.rename(self.path(temp), self.path(name), options)


def chunk_name(k: int) -> str:
    return f"chunk-{k:07d}"


def finished(folder: Folder) -> set[int]:
    return {int(n[6:]) for n in folder.names() if n.startswith("chunk-")}


def run_chunks(df: DataFrame, number: Column, order: list[str], work: Callable[[DataFrame], DataFrame], root: str, plan: Plan) -> dict[str, int]:
    """Does `work` for the chunks that are missing below root; says how many were there and how many were made.

    number: a column from 0 to plan.chunks - 1, the same for a row on every run. work: rows of whole chunks, with their
    _chunk, to rows with _chunk; it must not depend on other chunks. Each chunk is one file, its rows in the given order, so a
    run that was broken off and taken up again leaves the same bytes as one that was not.
    """
    spark = df.sparkSession
    folder = Folder(spark, root)
    wanted = asdict(plan) | {"wave": None}
    found = folder.read_json(MANIFEST)
    if found is not None and found != wanted:
        raise ValueError(f"{root} holds chunks of another plan: {found}")
    if found is None:
        folder.write_json(MANIFEST, wanted)
    for stale in (n for n in folder.names() if n.startswith(".wave-")):
        folder.remove(stale)
    there = finished(folder)
    missing = [k for k in range(plan.chunks) if k not in there]
    numbered = df.withColumn("_chunk", number.cast("int"))
    for a in range(0, len(missing), plan.wave):
        some = missing[a : a + plan.wave]
        wave = f".wave-{uuid.uuid4().hex}"
        made = work(numbered.where(F.col("_chunk").isin(some)))
        dealt = made.repartition(len(some), "_chunk").sortWithinPartitions("_chunk", *order)
        dealt.withColumn("_at", F.col("_chunk")).write.option("compression", "zstd").partitionBy("_at").parquet(f"{folder.root}/{wave}")
        for k in some:
            part = f"{wave}/_at={k}"
            if not folder.fs.exists(folder.path(part)):  # a chunk without rows
                folder.fs.mkdirs(folder.path(part))
            folder.rename(part, chunk_name(k))
        folder.remove(wave)
    return {"found": len(there), "made": len(missing)}


def read_chunks(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows of a finished folder; an error if chunks are missing."""
    folder = Folder(spark, root)
    wanted = folder.read_json(MANIFEST)
    if wanted is None or len(finished(folder)) < wanted["chunks"]:
        raise ValueError(f"{root} is not finished")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder.root)


def chunk_vocabulary(words: DataFrame) -> DataFrame:
    """Work for run_chunks over rows doc_id, pos, w: each chunk's own vocabulary, with counts and first places."""
    return words.groupBy("_chunk", "w").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))


def merged_vocabulary(chunks: DataFrame) -> DataFrame:
    """w, cnt, first over all chunks: sums and least places, so neither the number of chunks nor their order matters."""
    return chunks.groupBy("w").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
