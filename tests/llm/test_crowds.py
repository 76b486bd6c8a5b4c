"""Crowded band values of the near-duplicate operator."""

import random

from lexmill.llm import neardup


def test_a_crowd_that_hangs_together_by_single_pairs(spark):
    """With one coordinate a band, many texts under the similarity share a band value; each has one near copy there, which hubs and parts miss."""
    rng = random.Random(3)
    head = [f"h{i}" for i in range(60)]
    rows = []
    for i in range(60):
        tail = [f"t{i}x{j}" for j in range(30)]
        rows += [(2 * i, " ".join(head + tail)), (2 * i + 1, " ".join(head + tail[:-4] + [f"e{i}x{j}" for j in range(4)]))]
    rng.shuffle(rows)
    spec = neardup.DartSpec(bands=4, rows=1, first_bands=1, bits=64, hubs=1, few=2, cuts=(0, 64))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), spec=spec).collect()}
    missed = [k for k in range(0, 120, 2) if not got[k] == got[k + 1] == k]
    assert not missed


def test_a_crowd_that_shares_a_line_is_not_compared_all_with_all(spark, monkeypatch):
    """Texts under the similarity share most of their words and so their band values; their rarest shingles tell the near copies among them."""
    rng = random.Random(4)
    head = [f"h{i}" for i in range(60)]
    rows = []
    for i in range(300):
        tail = [f"t{i}x{j}" for j in range(30)]
        rows.append((2 * i, " ".join(head + tail)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(head + tail[:-4] + [f"e{i}x{j}" for j in range(4)])))
    rng.shuffle(rows)
    compared, similar = [], neardup.similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(neardup, "similar", counted)
    spec = neardup.DartSpec(bands=4, rows=1, first_bands=1, bits=64, hubs=1, few=2, cuts=(0, 64))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), spec=spec).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}
    assert sum(compared) < 10 * len(rows)
