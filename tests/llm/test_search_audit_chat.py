"""Lexical search, source audit and chat formatting against SQL, brute force and odd tables."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexmill.llm import chat, divergence, registry, search

SF = "/root/testdata/sf0.001"
NEW = ["op11_lexical_search", "op12_source_audit", "op13_chat_format"]


def sql_rows(sql, cols, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        if isinstance(rows, str):
            con.sql(f"create view {name} as select * from '{rows}/{name}.parquet'")
        else:
            kinds, data = rows
            con.execute(f"create table {name} ({kinds})")
            if data:
                con.executemany(f"insert into {name} values ({','.join('?' * len(data[0]))})", data)
    return sorted(con.sql(f"select {', '.join(cols)} from ({sql})").fetchall(), key=str)


def spark_rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("name", NEW)
def test_whole_query_is_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    want = sql_rows(registry.oracle_sql()[name], df.columns, documents=SF, benchmark=SF, conversations=SF)
    assert want and spark_rows(df, df.columns) == want


WORDS = ["Haus", "der", "Élan", "x9", "naïve", "straße", "漢字", "b", "zz"]
KINDS = "doc_id bigint, text varchar, lang varchar, source varchar, term varchar"


def odd_documents():
    rng = random.Random(5)
    rows = [(1, None, None, None, "t"), (2, "", "en", "", "t"), (None, "der b der", "en", "s1", None), (4, "\x00 -- !!", "en", "s1", "t"), (5, "b " * 30_000 + "Haus", "en", "s2", "t"), (6, "zz DER", None, "s1", "t")]
    for i in range(60):
        rows.append((rng.choice([7, 8, 9, 100 + i]), " ".join(rng.choices(WORDS, k=rng.randint(1, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "z"]), "t"))
    return rows + rows[-3:]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string, term string").repartition(5)


# 11


def test_search_of_odd_tables(spark, odd):
    items = [(1, "Haus der der"), (2, None), (3, "!!"), (None, "b zz"), (4, "nowhere"), (1, "zz x9"), (5, "漢字 naïve naïve")]
    cols = ["item_id", "rank", "doc_id", "score"]
    want = sql_rows(search.OP11_SQL, cols, documents=(KINDS, odd_documents()), benchmark=("item_id bigint, text varchar", items))
    frame = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "TEXT")
    for spec in (search.SearchSpec(), search.SearchSpec(block_bytes=120, docs=3)):
        assert spark_rows(search.search(odd, frame, spec, item_text="TEXT"), cols) == want
    assert search.search(odd.limit(0), frame, item_text="TEXT").count() == 0 and search.search(odd, frame.limit(0), item_text="TEXT").count() == 0
    assert search.search(odd.where("doc_id in (2, 4)"), frame, item_text="TEXT").count() == 0


def test_long_texts_are_counted_slice_by_slice(monkeypatch):
    text = " ".join(random.Random(1).choices(["Aa", "é", "b-c", "D9"], k=500))
    known = {b"aa": 0, "é".encode(): 1, b"d9": 2}
    whole = search.term_counts(text, known)
    monkeypatch.setattr(search, "SLICE", 17)
    assert search.term_counts(text, known) == whole and whole[0] == 500 + text.count("-")


def test_rows_of_the_product():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 4, (6, 9)) * (rng.random((6, 9)) < 0.5)
    block = search.ItemBlock([1, 2], {bytes([i]): i for i in range(6)}, np.array([0, 3, 5]), np.array([0, 2, 5, 1, 2]), np.array([1, 2, 1, 3, 1]))
    t, d = np.nonzero(b)
    got = [row.tolist() for _, row in search.merged(block, t, d, b[t, d], 9)]
    assert got == [(b[0] + 2 * b[2] + b[5]).tolist(), (3 * b[1] + b[2]).tolist()]
    row = np.array([5, 0, 7, 5, 5, 1])
    assert search.best_of(row, np.array([5, 4, 3, 2, 1, 0]), 3).tolist() == [2, 4, 3]


# 12


def test_audit_of_odd_tables(spark, odd):
    cols = ["lang", "source", "part", "item", "value", "rank"]
    want = sql_rows(divergence.OP12_SQL, cols, documents=(KINDS, odd_documents()))
    assert spark_rows(divergence.audit(odd), cols) == want and {r[2] for r in want} == {"pair", "term"}
    assert divergence.audit(odd.limit(0)).count() == 0
    lone = divergence.audit(odd.where("doc_id = 2"))
    assert lone.count() == 0
    bare = spark.createDataFrame([("a b", "en", "x"), (None, "en", "y")], "text string, lang string, source string")
    assert spark_rows(divergence.audit(bare), cols) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


@pytest.mark.parametrize("ranks,bits,settled", [(3, 4, 0), (7, 10, 5), (1, 3, 0), (40, 12, 1)])
def test_radix_selection_is_a_sort(spark, ranks, bits, settled):
    rng = random.Random(ranks)
    rows = {("en" if i % 3 else "", f"s{i % 4 if i % 5 else 0}", "".join(rng.choices("abé漢", k=rng.randint(1, 9)))): rng.choice([0, 1, 5, 5, 5, 1 << 59, (1 << 59) + 1, rng.randrange(1 << 20)]) for i in range(900)}
    rows |= {("en", "tie", "a" * i): 9 for i in range(1, 60)}
    df = divergence.common.written(spark.createDataFrame([(*k, v) for k, v in rows.items()], "lang string, source string, term string, value long").repartition(4), "rows")
    spec = divergence.AuditSpec(ranks=ranks, bits=bits, settled=settled)
    got = sorted(tuple(r) for r in divergence.radix_top(df, spec).select("lang", "source", "rank", "term", "value").collect())
    by = {}
    for (lang, source, term), v in rows.items():
        by.setdefault((lang, source), []).append((-v, term.encode(), term, v))
    want = sorted((lang, source, i + 1, t, v) for (lang, source), x in by.items() for i, (_, _, t, v) in enumerate(sorted(x)[:ranks]))
    assert got == want


def test_shared_terms_in_small_steps():
    import pyarrow as pa

    rng = random.Random(2)
    rows = [("en", t, s, rng.randint(2, 900), 1 + int(s[1])) for t in "abcdef" for s in ("s1", "s2", "s3", "s4") if rng.random() < 0.7]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("lang", "term", "source", "p", "floor"))})
    sums = divergence.SharedTerms(cells=5)
    sums.add(table)
    got = {tuple(r[c] for c in ("source", "item")): r["value"] for r in sums.take().to_pylist()}
    want = Counter()
    gap = lambda p, q: (p - q) ** 2 // q
    for _, t, s, p, low in rows:
        for _, t2, s2, q, low2 in rows:
            if t == t2 and s != s2:
                want[s, s2] += gap(p, q) - gap(p, low2) - gap(low, q) + gap(low, low2)
    assert got == dict(want)


# 13


def digest_rows(df):
    return spark_rows(df, df.columns)


def test_chat_of_odd_tables(spark):
    texts = [None, "", "\\", "\\\\<s>", "<\\s>", "[INST] [/INST]", "<<SYS>>\n<</SYS>>", " a ", "\n", "</s", "<", "[", "é漢😀", "[[INST]", "<</s>>", "x" * 200_000, "[ROLE]user[/ROLE]"]
    roles = ["user", "assistant", "system", "tool", None, "[ROLE]\\", "a\nb", ""]
    rng = random.Random(3)
    rows = [(c, rng.choice([0, 1, 2, None, t]), rng.choice(roles), rng.choice(texts), "z") for c in (1, 2, 3, None) for t in range(120)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").repartition(3)
    kinds = "conv_id bigint, turn bigint, role varchar, text varchar, seq varchar"
    t = chat.InstTemplate()
    got = chat.read_back(chat.format_turns(df, t), t)
    want = sql_rows(chat.OP13_SQL, got.columns, conversations=(kinds, rows))
    assert spark_rows(got, got.columns) == [r for r in want if r[0] != -1]
    assert chat.read_back(chat.format_turns(df.limit(0), t), t).count() == 0
    whole = {}
    for r in sorted(chat.format_turns(df, t).collect(), key=lambda r: (str(r["conv"]), r["seq"])):
        assert not r["rewrites"] and len(whole.get(r["conv"], "")) == r["keep"]
        whole[r["conv"]] = whole.get(r["conv"], "") + r["piece"]
    for conv, text in whole.items():
        own = sorted(((r[1] is None, r[1] or 0, (r[2] or ""), (r[3] or "")) for r in rows if r[0] == conv), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert text == t([x[2:] for x in own])


def test_escapes_leave_no_control_string():
    t = chat.InstTemplate()
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices([*chat.CONTROL, "\\", "<", "[", "s", ">", "/", "a"], k=rng.randint(0, 9)))
        out = t.escape(text)
        assert t.unescape(out) == text and not any(c in out for c in chat.CONTROL)


class Closing:
    """Marks only the last turn as the end, and drops earlier answers' drafts: history is rewritten."""

    def __call__(self, turns):
        return "|".join(r[0] + ":" + (x if i == len(turns) - 1 else x.split("#")[-1]) for i, (r, x) in enumerate(turns)) + "$"


class Trimming:
    """Appends, but trims texts and names the turn before."""

    def __call__(self, turns):
        return "".join(f"<{r}|{turns[i - 1][0] if i else 'start'}>{x.strip()}</{r}>" for i, (r, x) in enumerate(turns))


class Counting:
    """Appends, but numbers all turns, so a rendering that begins later differs."""

    def __call__(self, turns):
        return "".join(f"{i}.{r}={x};" for i, (r, x) in enumerate(turns))


@pytest.mark.parametrize("template", [Closing(), Trimming(), Counting(), chat.InstTemplate()])
def test_black_boxes(template):
    talk = [(("user", "assistant")[i % 2], f" draft#turn {i} ") for i in range(50)]
    local = not chat.rewrites_history(template)
    assert local == (not isinstance(template, Closing))
    r = chat.Renderer(template, chat.ChatSpec(turns=6), local)
    text = ""
    for i, (role, said) in enumerate(talk):
        p = r.add(role, said)
        assert p.keep <= len(text) and p.rewrites == (isinstance(template, Closing) and i > 0)
        text = text[: p.keep] + p.piece
        assert text == template(talk[: i + 1])
        shown = said.strip() if isinstance(template, Trimming) else said
        assert text[p.begin : p.end] == shown
    assert (len(r.turns) <= 6) == isinstance(template, Trimming | chat.InstTemplate)
