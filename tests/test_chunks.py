"""A run that is broken off half-way and taken up again."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexmill.sources import chunks


def bytes_of(root):
    return {p.parent.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.parquet"))}


def test_taken_up_again_gives_the_same_bytes(spark, tmp_path):
    rows = [(i, j, f"w{(i * j) % 17}") for i in range(50) for j in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, w string").repartition(6)
    number, plan = F.pmod("doc_id", F.lit(8)), chunks.Plan("words", 8, wave=2)
    whole, broken = tmp_path / "whole", tmp_path / "broken"
    assert chunks.run_chunks(df, number, ["w"], chunks.chunk_vocabulary, f"file://{whole}", plan) == {"found": 0, "made": 8}
    calls = []

    def fails(part):
        calls.append(1)
        if len(calls) == 3:
            return chunks.chunk_vocabulary(part).withColumn("cnt", F.when(F.col("w") == "w3", F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("cnt")))
        return chunks.chunk_vocabulary(part)

    with pytest.raises(Exception, match="killed"):
        chunks.run_chunks(df, number, ["w"], fails, f"file://{broken}", plan)
    schema = chunks.chunk_vocabulary(df.withColumn("_chunk", F.lit(0))).schema
    with pytest.raises(ValueError, match="not finished"):
        chunks.read_chunks(spark, f"file://{broken}", schema)
    assert len(bytes_of(broken)) >= 4
    assert chunks.run_chunks(df, number, ["w"], chunks.chunk_vocabulary, f"file://{broken}", plan) == {"found": 4, "made": 4}
    assert bytes_of(broken) == bytes_of(whole) and len(bytes_of(whole)) == 8
    assert not [p for p in broken.iterdir() if p.name.startswith(".wave")]
    got = {r["w"]: (r["cnt"], tuple(r["first"])) for r in chunks.merged_vocabulary(chunks.read_chunks(spark, f"file://{broken}", schema)).collect()}
    want = {}
    for i, j, w in rows:
        n, first = want.get(w, (0, (i, j)))
        want[w] = n + 1, min(first, (i, j))
    assert got == want
    with pytest.raises(ValueError, match="another plan"):
        chunks.run_chunks(df, number, ["w"], chunks.chunk_vocabulary, f"file://{broken}", chunks.Plan("other", 8))


def test_chunks_without_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a")], "doc_id long, pos int, w string")
    root = f"file://{tmp_path}/x"
    assert chunks.run_chunks(df, F.pmod("doc_id", F.lit(3)), ["w"], chunks.chunk_vocabulary, root, chunks.Plan("words", 3))["made"] == 3
    assert chunks.run_chunks(df, F.pmod("doc_id", F.lit(3)), ["w"], chunks.chunk_vocabulary, root, chunks.Plan("words", 3)) == {"found": 3, "made": 0}
    schema = chunks.chunk_vocabulary(df.withColumn("_chunk", F.lit(0))).schema
    assert [r["w"] for r in chunks.read_chunks(spark, root, schema).collect()] == ["a"]


def test_json_is_replaced_whole(spark, tmp_path):
    f = chunks.Folder(spark, f"file://{tmp_path}")
    f.write_json("a.json", {"x": 1})
    f.write_json("a.json", {"x": "é"})
    assert f.read_json("a.json") == {"x": "é"} and f.read_json("b.json") is None
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".a.json-")]
