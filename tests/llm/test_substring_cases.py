"""The registered query against a chunk table by hand, and repeated ids, null ids and scripts without spaces."""

import hashlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from lexmill.llm import common, registry, substrings

SF = "/root/testdata/sf0.001"


def by_hand(rows, hashes, spec=substrings.ChunkSpec()):
    """(id, text) -> text without its repeated runs."""
    first, chunks = {}, []
    low = lambda i: (i is not None, i if i is not None else 0)
    for (i, text), t in zip(rows, hashes):
        if not text:
            continue
        raw = text.encode()
        at, word = substrings.cuts(np.frombuffer(raw, np.uint8), spec)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(raw)]):
            d = hashlib.blake2b(raw[a:b], digest_size=16).digest()
            place = (low(i), t, a)
            chunks.append((place, d, a, b, int(word[a:b].sum()), text))
            first[d] = min(first.get(d, place), place)
    out = {}
    for place, d, a, b, n, text in sorted(set(chunks)):
        if place != first[d]:
            runs = out.setdefault((place[:2], text), [])
            far = (b - a) * (first[d][:2] != place[:2])
            if runs and runs[-1][1] == a:
                runs[-1] = (runs[-1][0], b, runs[-1][2] + n, runs[-1][3] + far)
            else:
                runs.append((a, b, n, far))
    texts = []
    for (i, text), t in zip(rows, hashes):
        gone = [r for r in out.get(((low(i), t), text), []) if r[2] >= spec.min_words or r[3] >= spec.min_bytes]
        raw, at, parts = (text or "").encode(), 0, []
        for a, b, _, _ in gone:
            parts.append(raw[at:a])
            at = b
        texts.append((i, None if text is None else b"".join([*parts, raw[at:]]).decode(errors="replace"), len(gone)))
    return texts


def cut(df):
    return sorted(((r["doc_id"], r["text"], r["_spans"]) for r in substrings.without_spans(df, substrings.repeated_spans(df)).collect()), key=str)


def test_query_is_the_table_by_hand(spark):
    docs = common.documents(spark, SF).select("doc_id", "text", F.xxhash64("text").alias("t")).collect()
    want = by_hand([(r["doc_id"], r["text"]) for r in docs], [r["t"] for r in docs])
    got = registry.queries()["op5_substrings"](spark, SF).collect()
    assert sorted((r["doc_id"], r["text"], r["n_spans"]) for r in got) == sorted(want) and any(n for *_, n in want)


@pytest.fixture(scope="module")
def say():
    rng = np.random.default_rng(12)
    return lambda n: " ".join("w" + str(k) for k in rng.integers(0, 10**6, n))


def test_repeated_and_null_ids(spark, say):
    shared, own = say(80), say(300)
    rows = [(1, shared + " " + say(30)), (2, own), (2, say(10) + " " + shared), (2, own), (None, say(20) + " " + shared), (None, shared), (3, say(5) + " " + shared), (9, None), (9, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _t int").repartition(3)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = by_hand(rows, [hashes[t] for _, t in rows])
    assert cut(df) == sorted(want, key=str)
    kept = [t for i, t, _ in want if i == 2]
    assert kept[0] == own and kept[2] == own and len(kept[1]) < 250  # each keeps to its own spans
    assert sum(n for i, _, n in want if i in (1, 3)) == 2  # a text without an id is the first


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(3)
    han = lambda n: "".join(chr(k) for k in rng.integers(0x4E00, 0x9FA0, n))
    text, part = han(3000), han(400)
    rows = [(1, text), (2, text), (3, han(500) + part + han(300)), (4, han(77) + part + han(200)), (5, han(900)), (6, "x" * 5000)]
    got = {i: (t, n) for i, t, n in cut(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1] == (text, 0) and got[2] == ("", 1) and got[5] == (rows[4][1], 0) and got[6] == (rows[5][1], 0)
    assert got[3][1] == 0 and got[4][1] == 1 and len(got[4][0]) < len(rows[3][1]) - 250
    assert rows[3][1].startswith(got[4][0][:77]) and rows[3][1].endswith(got[4][0][-200:]) and "�" not in got[4][0]
