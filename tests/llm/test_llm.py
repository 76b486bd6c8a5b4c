"""Operators for training data against brute force, round trips, held-out accuracy and odd tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import audio, decontaminate, graph, language, neardup, pages, pieces, quality, registry, substrings, suffix_tree, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "a", "y"), (5, "word " * 5000, "y"), (6, "a", "y"), (7, "é漢字😀 ß", None), (7, "é漢字😀 ß", None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a very long text, ties, repeated rows; a column with a name that operators use themselves."""
    return spark.createDataFrame(ODD, "doc_id long, text string, _id string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, _id string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingle_bag(text, n=5):
    w = tokens.words([(text or "").lower().encode()], tokens.IS_BREAK)
    h = w.hash.tolist()
    return Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1)) if len(h) >= n else Counter([tuple(h)] if h else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_words_and_shingles_are_position_free():
    texts = [b"the cat sat", b"", b"on the cat sat down now", b"  the  "]
    w = tokens.words(texts)
    got = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
    assert got[0] == got[2][1:4] and got[1] == [] and got[3] == got[0][:1]
    sh, at = tokens.shingles(w, 3)
    assert np.diff(at).tolist() == [1, 0, 4, 1] and sh[0] == sh[2]


# 1


def test_audio_round_trip_and_contract(spark, docs):
    out = {r["doc_id"]: r for r in registry.queries()["op1_audio_features"](spark, SF).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x = out[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        media = audio.wav_bytes(want)
        assert audio.wav_payload(media) == (want, 8000) and x["media_sha256"] == hashlib.sha256(media).hexdigest() and x["media_bytes"] == len(media)


def test_audio_blocks_resampling_and_tensors(spark, odd, none):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 300_000, dtype=np.uint8)
    whole, cut = audio.Features(audio.AudioSpec(block=10**9)), audio.Features(audio.AudioSpec(block=50))
    a, b = (np.concatenate([m for m, _ in f.blocks(x)]) for f in (whole, cut))
    assert a.shape == b.shape and np.allclose(a, b, atol=1e-3)
    t = np.arange(8000) / 8000
    tone = np.sin(2 * np.pi * 200 * t).astype(np.float32)
    y = whole.resample(tone)
    assert abs(np.abs(np.fft.rfft(y)).argmax() * 3200 / len(y) - 200) < 3
    assert whole.segments(np.array([0, 0, 5, 5, 1, 5, 0, 0, 0.0])) == [(2, 6)]
    rows = audio.audio_features(odd, "doc_id", "text").collect()
    assert len(rows) == len(ODD) and {r["n_frames"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    table = audio.read_tensors(rows[4]["tensors"])
    assert table.schema.field("patch").type.shape == [16, 24] and table.num_rows == -(-rows[4]["n_frames"] // 16)
    assert math.isclose(table["start_s"][1].as_py(), table["end_s"][0].as_py()) and math.isclose(table["end_s"][0].as_py(), 16 * 64 / 3200)
    mels = np.concatenate([m for m, _ in whole.blocks(np.frombuffer(audio.padded(ODD[4][1])[0], np.uint8))])
    assert np.array_equal(audio.tensor_values(table).reshape(-1, 24)[: len(mels)], mels)
    assert audio.audio_features(none).count() == 0


# 2


def test_pieces_same_as_library(spark, docs, odd, none):
    model = pieces.piece_model(pieces.tokenizer_path())
    p = pieces.Pieces(model)
    rng = np.random.default_rng(3)
    alphabet = list("ab cdeé▁  \n\tth<s>日本😀\x00İ")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(500)] + ["", " ", "▁▁", "<s> </s>", "x" * 300]
    for t, got in zip(texts, p.encode_batch(texts)):
        want = p.library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == want and p.decode(got) == p.library.decode(want)
        assert p.agenda(pieces.SPACE + t.replace(" ", pieces.SPACE)) == want[1:-1] or not t
    out = {r["doc_id"]: r for r in registry.queries()["op2_sentencepiece"](spark, SF).collect()}
    for r in docs.collect():
        ids = p.library.encode(r["text"] or "", add_bos=True, add_eos=True)
        x = out[r["doc_id"]]
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and x["decoded_sha256"] == hashlib.sha256(p.library.decode(ids).encode()).hexdigest()
    rows = pieces.encode_decode(odd, model).collect()
    assert sorted(r["decoded"] for r in rows) == sorted(t or "" for _, t, _ in ODD)
    assert pieces.encode_decode(none, model).count() == 0


# 3


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.inputs(["some words here are read twice", "and others once"])
    begin, size, _ = toxicity.windows(t.first)

    def loss():
        x, proj = net.project(t)
        logit, kept = net.forward(proj, begin, size, keep=True)
        return float((logit * [1.0, -2.0]).sum()), x, kept

    _, x, kept = loss()
    g = net.gradients(t, x, kept, np.array([1.0, -2.0]))
    for k in ("wx", "uf", "ub", "wa", "va", "wo"):
        at = tuple(0 for _ in net.p[k].shape)
        old, e = net.p[k][at], 1e-2
        net.p[k][at] = old + e
        up = loss()[0]
        net.p[k][at] = old - e
        down = loss()[0]
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 + 0.02 * abs(g[k][at]), k


def test_toxicity_learns_and_covers(odd, none):
    rng = np.random.default_rng(2)
    say = lambda bad: " ".join("w" + str(k) for k in rng.integers(0, 300, 90)) + (" vile" + "abc"[rng.integers(3)] if bad else "") + " end"
    rows = [(k % 2, say(k % 2)) for k in range(240)]
    net = toxicity.fit(rows[:160], epochs=20, batch=32)
    s, n = net.score([t for _, t in rows[160:]])
    assert np.mean((s >= 0.5) == np.array([y for y, _ in rows[160:]])) > 0.9 and (n > 1).all()
    first, size, text = toxicity.windows(np.array([0, 0, 5, 105]))
    covered = {(d, f + k) for f, z, d in zip(first.tolist(), size.tolist(), text.tolist()) for k in range(z)}
    assert covered == {(1, k) for k in range(5)} | {(2, k) for k in range(5, 105)}
    out = toxicity.toxicity(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out) and toxicity.toxicity(none, net).count() == 0
    assert isinstance(toxicity.fit([(1, "a")]), toxicity.Constant) and toxicity.fit([]).score(["x"])[0][0] == 0.5


# 4

PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head {n}</h1><p>One &amp; two&nbsp;{n}<p>Three  <b>bold{n}</b><br>line<div class=comments><p>nice!</div><p>Subscribe today</article><aside>x</aside><footer>&copy; f</footer></body></html>'


def test_pages(spark):
    rows = [(k, "http://h.example/a", PAGE.replace("{n}", str(k))) for k in range(6)] + [(10, "http://one.example/", "<div>only <p>text here that is long enough</div>"), (11, None, None), (12, "x", ""), (13, "http://h.example/b", "<p>no article here")]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Head 3\nOne & two 3\nThree bold3 line"
    assert out[10] == "only\ntext here that is long enough" and out[11] == "" and out[12] == "" and out[13] == "no article here"
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_copies(spark):
    """Copies and mirrors, which differ around the article only, do not make its blocks template."""
    page = lambda n: PAGE.replace("One &amp;", "Only here {n}").replace("{n}", str(n))
    html = [page(0)] * 6 + [page(0).replace("We use cookies", f"Seen {k}") for k in range(3)] + [page(k) for k in range(1, 6)]
    rows = [(k, "http://copies.example/a", h) for k, h in enumerate(html)] + [(100 + k, "http://four.example/", page(k % 3)) for k in range(4)]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(14):
        n = max(0, k - 8)
        assert f"Head {n}" in out[k] and f"Only here {n}" in out[k] and f"bold{n}" in out[k] and "Subscribe" not in out[k]
    assert all(f"Head {k % 3}" in out[100 + k] and f"Only here {k % 3}" in out[100 + k] for k in range(4))


def test_pages_keep_sentences_and_end(spark):
    """Names of elements in a line or of other things drop nothing; deep, alternating and broken pages end in time."""
    import time

    art = '<body><nav>menu</nav><article><p>One <span class="share">bold claim</span> and <a class="related">the link</a> here</p><div class="ad-free">two</div><section id="menu-recipes"><p>three</p></section><div class="post-share-story"><p>four</p></div><div class="related-posts">no</div><div class="ad">no</div><ul id=shareButtons><li>no</ul></article><p>after</body>'
    rows = [(1, None, art), (2, None, art), (3, "", art.replace("three", "3")), (4, None, art), (5, None, art), (6, None, art)]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _host int")).collect()}
    assert {out[k] for k in (1, 2, 4, 5, 6)} == {"One bold claim and the link here\ntwo\nthree\nfour"} and out[3].endswith("two\n3\nfour")
    hard = ["<div>" * 20000 + "deep text", "<article>" + "<h2>a</h2><p>b c</p>" * 6000 + "</article>", "<p>kept text" + "<a " * 40000, "<p>x" + '<a title="q>' * 9000, "</b>" * 20000 + "<i>" * 20000 + "<p>end", "<!" * 30000, "<script>" * 3000, "".join(f"<div class=u{k}>t{k}</div>" for k in range(3000))]
    began = time.time()
    for h in hard:
        root = pages.tree(pages.parse(h))
        again = pages.tree(pages.parse(h))
        assert pages.align(root, again) and isinstance(pages.page_text(h, again, pages.content_node(again, pages.own_lengths(again)), frozenset()), str)
    assert time.time() - began < 40
    assert pages.page_text(hard[1], pages.tree(pages.parse("")), None, frozenset()).count("\n") == 11999 and pages.page_text(hard[2], pages.tree(pages.parse("")), None, frozenset()) == "kept text"


def brute_matching(a, b):
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_matching(x, y))
    return m[-1][-1] + 1


def test_tree_matching():
    a, b = pages.tree(pages.parse(PAGE)), pages.tree(pages.parse(PAGE.replace("<aside>x</aside>", "").replace("<article>", "<div class=z>q</div><article>")))
    assert pages.matching(a, b, {}) == brute_matching(a, b) == len(pages.align(a, b))


# 5


def test_substrings(spark, none):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join("w" + str(k) for k in rng.integers(0, 10**6, n))
    shared = say(90)
    rows = [(1, say(50) + " " + shared + " " + say(40)), (2, say(33) + " " + shared + " " + say(61)), (3, say(120)), (4, None), (5, ""), (6, "x" * 5000), (7, shared), (8, say(20) + " " + " ".join(shared.split()[:8]))]
    d = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in substrings.without_spans(d, substrings.repeated_spans(d)).collect()}
    assert out[1]["_spans"] == 0 and out[3]["_spans"] == 0 and out[4]["text"] is None and out[6]["text"] == rows[5][1] and out[8]["_spans"] == 0
    for k in (2, 7):
        assert out[k]["_removed_bytes"] > 0.6 * len(shared.encode()) and out[k]["_removed_bytes"] + len(out[k]["text"].encode()) == len(rows[k - 1][1].encode())
    assert out[2]["text"].startswith(rows[1][1][:100]) and out[2]["text"].endswith(rows[1][1][-200:])
    assert substrings.without_spans(none, substrings.repeated_spans(none)).count() == 0


def test_cuts_resist_insertions():
    text = (" ".join("v" + str(k * 7919 % 100003) for k in range(2000))).encode()

    def cut(raw):
        at = substrings.cuts(np.frombuffer(raw, np.uint8))[0].tolist()
        return {raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])}

    a, b = cut(text), cut(b"some more words " + text[:5000] + b" in between " + text[5000:])
    assert len(a & b) > 0.97 * len(a)
    h = substrings.gear(np.frombuffer(text[:50], np.uint8))
    want = 0
    for c in text[:50]:
        want = (want * 4 + int(substrings.GEAR[c])) % 2**32
    assert h[-1] == want


# 6


def test_quality(spark, odd, none):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(600):
        grade = k % 3
        rows.append((grade, " ".join(("good" if rng.random() < (0.1, 0.4, 0.8)[grade] else "bad") + str(rng.integers(3)) for _ in range(60))))
    m = quality.fit(rows[:450])
    assert (np.diff(m.thresholds) > 0).all()
    idx, n = quality.features([t.encode() for _, t in rows[450:]])
    tails = m.tails(quality.link(m.weights, idx, n))
    e = m.expected(tails)
    y = np.array([g for g, _ in rows[450:]])
    assert (tails[:, 0] >= tails[:, 1]).all() and e[y == 0].mean() + 0.5 < e[y == 1].mean() < e[y == 2].mean() - 0.3
    out = quality.rate(odd, m).collect()
    assert len(out) == len(ODD) and set(out[0].asDict()) == {"doc_id", "text", "_id", "expected_grade", "tail_probability"}
    assert quality.rate(none, m).count() == 0 and quality.fit([(1, "a")]).expected(np.zeros((1, 0)))[0] == 1


# 7


def brute_classes(rows):
    bags = [shingle_bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, b in enumerate(bags):
        for j in {j for s in b for j in at[s]}:
            if jaccard(b, bags[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
        for s in b:
            at[s].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: min(v) for v in least.values() for d in v}


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(7)
    words = [f"t{k}" for k in rng.integers(0, 10**6, 150)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k in range(40):  # a large group about one text, some near it and some too far
        w = list(words)
        for i in rng.choice(150, k % 7, replace=False):
            w[i] = f"e{rng.integers(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "short text"), (20_003, "Short, text!"), (20_004, None)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")).collect()}
    assert got == brute_classes(rows)
    assert neardup.near_duplicates(none).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(8)
    u = rng.integers(1, 2**62, 500, dtype=np.uint64)
    a, b = np.arange(400), np.arange(100, 500)
    w1, w2 = rng.uniform(0.2, 5, 500), rng.uniform(0.2, 5, 500)
    s = neardup.signatures(np.concatenate([u[a], u[b]]), np.concatenate([w1[a], w2[b]]), np.array([0, 400, 800]), 512)
    x, y = np.zeros(500), np.zeros(500)
    x[a], y[b] = w1[a], w2[b]
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.08


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 102), (102, 100), (200, 201)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 31)} == {1} and {got[100], got[101], got[102]} == {100} and got[201] == 200


# 8


def test_language(spark, docs, odd, none):
    out = registry.queries()["op8_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)
    en = "the and of with this that is in to it for on as by from".split()
    fr = "le la les des une est dans pour que avec sur pas qui aux".split()
    rng = np.random.default_rng(9)
    say = lambda v, n: " ".join(rng.choice(v, n))
    m = language.fit([("en", say(en, 400)), ("fr", say(fr, 400))])
    code, starts, count = language.letter_runs([say(en, 60) + " " + say(fr, 40), say(fr, 50), "123 !?"])
    share, member = language.mixtures(m.likelihood(code, starts), count)
    assert member[0].all() and abs(share[0, 0] - 0.6) < 0.08 and member[1].tolist() == [False, True] and not member[2].any()
    got = language.identify(odd, m).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and len(got) == len(ODD)
    assert language.identify(none, m).count() == 0


# 9


def test_suffix_tree_contract(spark, docs):
    out = {r["doc_id"]: r for r in registry.queries()["op9_suffix_tree"](spark, SF).collect()}
    rows = [(r["doc_id"], suffix_tree.split(r["text"])) for r in docs.collect()]
    c = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*t, None])
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        x, tok = out[d], [*t, None]
        assert x["train_tokens"] == n and x["n_tokens"] == len(tok) and x["n_known"] == sum(c[w] > 0 for w in tok)
        assert math.isclose(x["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok), rel_tol=1e-9)
        assert x["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2) and x["score"] < 0


def test_suffix_tree_is_a_distribution_and_walks_longest_suffixes(spark, odd, none):
    train = spark.createDataFrame([(k, "ab abc abd ba cab " * (k + 1)) for k in range(8)], "doc_id long, text string")
    spec = suffix_tree.TreeSpec(depth=3, p_min=1e-4, hot=2)
    tree = suffix_tree.build_tree(suffix_tree.gram_counts(train, 3), spec)
    assert tree.contexts > 3
    # All symbols of each state: the classes that were seen, and the others, which share one class.
    log = tree.log.reshape(-1, tree.width).astype(float)
    total = (10 ** log[:, :-1]).sum(axis=1) + (256 - tree.width + 1) * 10 ** log[:, -1]
    assert np.allclose(total, 1, atol=1e-3)
    texts = [suffix_tree.split(t) for t in ("ab abc", "", "zz ab " * 400, "cab")]
    got = tree.texts(texts)
    for t, x in zip(texts, got):
        s, state = b"\n" * 3 + (b" ".join(t) + b" \n" if t else b"\n"), 0
        want = 0.0
        for k, b in enumerate(s):
            at = state * tree.width + tree.cls[b]
            want += float(tree.log[at]) if k >= 3 else 0
            state = tree.move[at]
        assert math.isclose(x, want, rel_tol=1e-4)
    rows = suffix_tree.score(odd, train, spec=spec).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert suffix_tree.score(none, train, spec=spec).count() == 0
    assert [r["n_known"] for r in suffix_tree.score(train.limit(1), none, spec=spec).collect()] == [0]


def test_suffix_tree_keeps_rare_contexts(spark, docs):
    """What is sent does not decide what is retained: scores are those of a tree that is sent whole."""
    few = docs.limit(60)
    train = few.where("doc_id % 3 != 0")
    get = lambda p: {r["doc_id"]: r["score"] for r in suffix_tree.score(few, train, spec=suffix_tree.TreeSpec(p_min=p)).collect()}
    whole = get(0.0)
    assert len(whole) == 60
    for p in (1e-3, 0.2):
        some = get(p)
        assert some.keys() == whole.keys() and all(math.isclose(some[d], whole[d], rel_tol=1e-3) for d in whole), p


# 10


def test_decontamination(spark, docs, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()] + [(900, None), (901, ""), (902, "tiny item")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    w = items[3][1].split()
    rows += [(5000, "before it " + items[3][1].upper().replace(" ", "  ") + " after"), (5001, items[3][1]), (5002, " ".join(w[: len(w) // 3])), (5003, None), (5004, "a tiny item"), (5005, " ".join(["x"] + w[1:]))]
    # Parts in another order: halves swapped, thirds turned, doubled; also between other words, at an end and with an edit.
    w = items[7][1].split()
    half, third, other = len(w) // 2, len(w) // 3, [f"o{k}" for k in range(70)]
    swapped, rotated = w[half:] + w[:half], w[third:] + w[:third]
    rows += [(5100 + k, " ".join(x)) for k, x in enumerate([swapped, other + swapped + other, other + rotated, rotated + other, w + w, other[:9] + w[:half] + ["new"] + w[half:] + other[:9], w[:half] + other[:3] + w[half:], swapped[:20] + ["new"] + swapped[21:], other[:5] + w[half:] + w[:half] + w[half:]])]
    rows += [(None, other[0] + " " + items[5][1]), (5200, "tiny item " * 3)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, h int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in rows:
        words = tokens.words([(t or "").lower().encode()], tokens.IS_BREAK).hash.tolist()
        for i, item in items:
            own = tokens.words([(item or "").lower().encode()], tokens.IS_BREAK).hash.tolist()
            if not own:
                continue
            g = min(5, len(own))
            bag = lambda h: Counter(tuple(h[k : k + g]) for k in range(len(h) - g + 1))  # noqa: E731, B023
            a = bag(own)
            if not a.keys() & bag(words).keys():
                continue
            if any(jaccard(a, bag(words[s : s + len(own)])) >= 0.8 for s in range(max(1, len(words) - len(own) + 1)) if words[s : s + len(own)]):
                want.add((d, i))
    assert got == want and (5000, items[3][0]) in got and (5101, items[7][0]) in got and (None, items[5][0]) in got and (5002, items[3][0]) not in got
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs.limit(5), bench.limit(0)).count() == 0


def test_decontamination_of_repeated_rows(spark):
    words = [f"w{k}" for k in range(40)]
    item, other = " ".join(words), " ".join(f"o{k}" for k in range(40))
    rows = [(1, item), (1, item), (2, item), (2, other + " w1 w2 w3 w4 w5 w6"), (3, other), (3, other), (4, " ".join(words[:20])), (4, " ".join(words[20:]))]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in got) == [(1, 7, 1.0), (2, 7, 1.0)]


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "pieces"]
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == docs.columns, name
        d = corpus_pipeline.common.written(out, f"test-{name}")
    kept = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert 0.5 * docs.count() < len(kept) < docs.count()
    assert len(set(brute_classes(kept).values())) == len(kept)
    p = pieces.Pieces(pieces.piece_model(pieces.tokenizer_path())).library
    want = {i: hashlib.sha256(np.array(p.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for i, t in kept}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want
