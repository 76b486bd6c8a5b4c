"""Tables of steps leave nothing on the driver when they are removed."""

import gc
import re
import shutil
import subprocess

import pytest

from lexmill.llm import common


@pytest.mark.skipif(shutil.which("jcmd") is None, reason="counts the JVM's objects with jcmd")
def test_listings_of_removed_tables_go(spark):
    pid = str(spark._jvm.java.lang.ProcessHandle.current().pid())

    def listed() -> int:
        gc.collect()
        spark._jvm.System.gc()
        m = re.search(r"\s(\d+)\s+\d+\s+org.apache.hadoop.fs.LocatedFileStatus", subprocess.run(["jcmd", pid, "GC.class_histogram"], capture_output=True, text=True, timeout=60).stdout)
        return int(m[1]) if m else 0

    setting, before = spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize"), listed()
    for _ in range(8):
        table = common.written(spark.range(40).repartition(20), "listed")
        assert table.count() == 40
        common.discard(table)
    del table
    assert listed() - before <= 4 * 20
    assert spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize") == setting
