"""Components of links that come in portions."""

import random

from lexmill.llm import graph, neardup


def _plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_portions_of_links_give_the_components_of_all(spark):
    rng = random.Random(5)
    portions = [[(k, k + 1) for k in range(100, 130)], [], [(129, 131), (7, 131), (300, 301)], [tuple(sorted(rng.sample(range(400), 2))) for _ in range(120)]]
    roots, so_far = None, []
    for p in portions:
        so_far += p
        roots = graph.extended(roots, spark.createDataFrame(p, "a long, b long"))
        rows = [(r["node"], r["root"]) for r in roots.collect()]
        assert len(rows) == len(dict(rows)) and dict(rows) == _plain(so_far)


def test_no_links_give_no_components(spark):
    assert graph.extended(None, spark.createDataFrame([], "a long, b long")) is None


def test_links_are_walked_once(spark, monkeypatch):
    """Each step of the near-duplicate operator works through its own links, not through all links so far again."""
    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(80)]
        rows += [(10 * i + k, " ".join(words[: 80 - k] + [f"e{i}x{k}x{j}" for j in range(k)])) for k in range(4)]
    rng.shuffle(rows)
    found, walked, similar, components = [], [], neardup.similar, graph.components

    def linked(*args):
        out = similar(*args)
        found.append(out.count())
        return out

    def counted(edges):
        walked.append(edges.count())
        return components(edges)

    monkeypatch.setattr(neardup, "similar", linked)
    monkeypatch.setattr(graph, "components", counted)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 10 for k, _ in rows}
    assert 0 < sum(walked) <= sum(found)
