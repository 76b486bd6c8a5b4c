"""Steps of iterative jobs: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one, as in tests, gets a temporary one, a cluster an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset, and iterative steps need a shared folder")
        place = "file://" + tempfile.mkdtemp(prefix="lexmill-steps-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


class Steps:
    """Tables of one job, each by a name of its own; drop() removes those that are superseded."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *paths: str) -> None:
        sc = self.spark.sparkContext
        for p in paths:
            at = sc._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
