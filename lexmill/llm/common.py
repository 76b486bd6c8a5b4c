"""Helpers of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python step hands back at once.
OUT_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the folds of the contracts."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def py_crc_mod(doc_id: int, m: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, taken from the session. Where it is unset, a local session, as in tests, gets a temporary one; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: steps need a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="lexmill-shared-")
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Seconds between two collections of garbage, and when the last one was.
RELIEF_S = 2.0
_relieved = [0.0]


def relieve(spark: SparkSession) -> None:
    """Lets the driver notice which broadcasts and shuffles nothing reads any more, so executors drop them: Spark does so only when garbage is collected, which on an idle driver can take half an hour."""
    if time.monotonic() - _relieved[0] >= RELIEF_S:
        gc.collect()  # Python's handles first, as they keep the plans alive
        spark.sparkContext._jvm.System.gc()
        _relieved[0] = time.monotonic()


#: Size of the session's store of file listings. What is in it stays on the driver after a table is removed, so steps are read without it: their listing goes with the table's last handle.
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: cuts lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexmill-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    relieve(spark)
    held = spark.conf.get(LISTINGS)
    spark.conf.set(LISTINGS, "0")
    try:
        out = spark.read.schema(df.schema).parquet(path)
    finally:
        spark.conf.set(LISTINGS, held)
    out._lexmill_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing will read again."""
    for t in tables:
        if t is None:
            continue
        path = t.__dict__.pop("_lexmill_path", None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with as many _ behind it as it takes to differ from all columns of frames, whatever their case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows of df whose id is not in gone's only column, a written table. Rows without an id stay."""
    name = free_name("_gone", df)
    side = sent_if_small(gone.toDF(name))
    return df.join(side, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def text_rows(batch: pa.RecordBatch, id_name: int | str = 0, text_name: int | str = 1) -> Iterator[tuple]:
    """(id, text or empty) of each row, without making one list of all texts of a batch."""
    ids, texts = batch.column(id_name), batch.column(text_name)
    for i in range(batch.num_rows):
        yield ids[i].as_py(), texts[i].as_py() or ""


def groups(batch: pa.RecordBatch, chars: int) -> Iterator[list[tuple]]:
    """Rows of a batch in lists of about so many characters."""
    group, size = [], 0
    for row in text_rows(batch):
        group.append(row)
        size += len(row[1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


class Out:
    """Gathers rows by column and hands out record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = OUT_BYTES):
        self.schema, self.rows, self.size = schema, rows, size
        self.cols: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, row: Iterable, size: int = 0) -> None:
        for c, v in zip(self.cols, row):
            c.append(v)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= self.size or len(self.cols[0]) >= self.rows

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
        self.cols, self.bytes = [[] for _ in self.schema], 0
        return out


def small_batches(spark: SparkSession) -> None:
    """Batches of the session get no more than BATCH_ROWS rows from here on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ids_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, under names that no other column can clash with; in small batches."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))


def env_threads() -> None:
    """Numeric libraries use one thread in a worker: Spark runs a task for each core."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")


#: Most bytes of a side that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def side_bytes(df: DataFrame) -> int:
    """What df takes in memory: its rows, and what its strings and arrays hold, all counted."""
    row, held = 16, F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        row += 16
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            each = 16 * len(f.dataType.elementType.fields) + 16 if f.dataType.elementType.typeName() == "struct" else 8
            held = held + F.greatest(F.size(c), F.lit(0)) * each
    n, more = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    return n * row + int(more)


def sent_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted bytes stay under the limit; else as it is, for a shuffled join. df should be a written table: it is counted."""
    return F.broadcast(df) if side_bytes(df) <= limit else df


#: Rows of an Arrow batch: texts can be long, and a batch is held in the executor and in the Python worker at once.
BATCH_ROWS = 300


def tidy(run):
    """A step for mapInArrow that gives freed memory back to the system when its task ends, as workers live on."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole
