"""Language-model scoring with a probabilistic suffix tree.

Texts are sequences of words and one end mark. A word is spelled by its bytes and closed by a separator, and the end is a
symbol of its own, so the model gives every sequence of words a probability. Contexts are the last bytes before a
symbol, up to `depth` of them, over word boundaries but never into another text; before a text stand end marks. A context
stays in the tree if it occurs at least LEAST times and its next-symbol distribution diverges from that of
its longest retained suffix: 2 * count * KL(own || suffix's) is over `divergence` times the number of its symbols.
Distributions are smoothed with that of the suffix (Witten-Bell), the root with one added to each symbol. The longest
retained suffix of what came before is the state that scores a symbol.

What is counted: every word and every window of bytes of every training text, in the tasks first and then by a
distributed aggregation whose rows grow with the corpus. What is sent around: the part of the tree whose contexts have a
relative frequency of `p_min` or more, at most depth / p_min of them whatever the size of the corpus, and the `hot` most
frequent words. Counts of all other words are joined, and so are the other contexts: places of a text whose window is
not frequent meet the counted windows with the same shortest rare suffix, where the rest of the tree is tested. `p_min`
and `hot` decide where something is looked up and do not change a score.

Cases: null counts as an empty text, which is the end mark alone; texts are whole; ties among the most frequent words go
to the smaller one; without training texts the counts are 0 and the smoothing still gives probabilities; repeated rows
are scored alike; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: No word has white space in it, so these two bytes close a word and a text.
CLOSE, END, SYMBOLS = 32, 10, 256
#: Occurrences of a context from which it can be retained, whatever the size of the corpus.
LEAST = 2
#: Rows of places and windows that are resolved together: the same at any size of the corpus, so results are in proportion to places.
RESOLVE_ROWS = 50_000
#: Distinct words, and windows of bytes, of a task that are gathered before they are handed on.
FLUSH_WORDS, FLUSH_GRAMS = 400_000, 3_000_000
#: Bytes of text worked on together, and how many places of them are scored side by side.
GROUP_BYTES, LANES = 1 << 20, 2048


@dataclass(frozen=True)
class TreeSpec:
    #: 6 at most: a window and what follows it are packed in a long.
    depth: int = 5
    p_min: float = 5e-7
    divergence: float = 2.0
    hot: int = 100_000


def split(text: str | None) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, cut at 0x20 and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word binary, n long over all texts; null word: the end marks, one a text. Counted in each task first."""
    src = df.select(F.col(f"`{text_col}`").alias("_text"))
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts, ends = Counter(), 0

        def flush():
            keys = list(counts)
            for a in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000], pa.binary()), pa.array([counts[k] for k in keys[a : a + 50_000]], pa.int64())], schema=schema)
            counts.clear()

        for batch in batches:
            texts = batch.column(0)
            for i in range(batch.num_rows):
                counts.update(split(texts[i].as_py()))
                ends += 1
                if len(counts) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], schema=schema)

    return src.mapInArrow(common.tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as one run of symbols with `depth` end marks before each text; where texts begin behind those marks; their symbols."""
    pad = bytes([END]) * depth
    parts = [b" ".join(w) + b" \n" if w else b"\n" for w in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size + depth) - size
    return np.frombuffer(pad + pad.join(parts), np.uint8), begin, size


def gram_counts(df: DataFrame, depth: int, text_col: str = "text") -> DataFrame:
    """ctx long, sym int, n long: how often each symbol follows each window of the `depth` symbols before it.

    ctx packs the window's bytes, the last in the lowest. Counted in each task first.
    """
    src = df.select(F.col(f"`{text_col}`").alias("_text"))
    schema = pa.schema([("ctx", pa.int64()), ("sym", pa.int32()), ("n", pa.int64())])

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(keys, return_inverse=True)
        return key, np.bincount(at, weights=n).astype(np.int64)

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            key, n = summed(np.concatenate(keys), np.concatenate(counts))
            for a in range(0, len(key), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part] >> 8), pa.array((key[part] & 255).astype(np.int32)), pa.array(n[part])], schema=schema)

        for batch in batches:
            for group in byte_groups(batch.column(0)):
                buf, begin, size = stream(group, depth)
                place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                code = buf[place].astype(np.int64)
                for k in range(1, depth + 1):
                    code |= buf[place - k].astype(np.int64) << (8 * k)
                key, n = np.unique(code, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > FLUSH_GRAMS:
                    key, n = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [key], [n], len(key)
                    if held > FLUSH_GRAMS // 2:
                        yield from flush()
                        keys, counts, held = [], [], 0
        if keys:
            yield from flush()

    return src.mapInArrow(common.tidy(run), "ctx long, sym int, n long").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def byte_groups(texts: pa.Array):
    """Split texts in lists of about GROUP_BYTES bytes."""
    group, size = [], 0
    for i in range(len(texts)):
        t = texts[i].as_py()
        group.append(split(t))
        size += len(t or "")
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class Level:
    """Windows of one length: ctx, and for window i the symbols sym[at[i]:at[i + 1]] with their counts n."""

    ctx: np.ndarray
    at: np.ndarray
    sym: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Level:
        ctx, sym, n = (rows.column(c).to_numpy() for c in ("ctx", "sym", "n"))
        order = np.lexsort((sym, ctx))
        own, at = np.unique(ctx[order], return_index=True)
        return cls(own, np.append(at, len(ctx)), sym[order].astype(np.int64), n[order])


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Tree:
    """Automaton of the frequent retained contexts: next_state[state, byte] and log10 probability[state, symbol]."""

    def __init__(self, levels: list[Level], spec: TreeSpec = TreeSpec()):
        """levels[k]: windows of k bytes that are frequent enough, with what follows them."""
        self.depth = spec.depth
        self.often = [level.ctx for level in levels]
        # A table by hash of most of the deepest frequent windows; those that another took the place of are looked up in order.
        deep = self.often[spec.depth]
        self.bits = max(10, int(4 * len(deep)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slots[self.slot(deep)] = deep
        self.crowded = deep[self.slots[self.slot(deep)] != deep]
        # dist holds all bytes; the white space that no text leaves in a word keeps its share of the added ones.
        root = np.ones(SYMBOLS)
        np.add.at(root, levels[0].sym, levels[0].n)
        dist = {(0, 0): (root / root.sum()).astype(np.float32)}
        kept = {(0, 0)}
        for k in range(1, spec.depth + 1):
            level = levels[k]
            for ctx, a, b in zip(level.ctx.tolist(), level.at[:-1].tolist(), level.at[1:].tolist()):
                j = k - 1
                while (j, ctx & ((1 << 8 * j) - 1)) not in kept:
                    j -= 1
                up = dist[(j, ctx & ((1 << 8 * j) - 1))]
                sym, n = level.sym[a:b], level.n[a:b].astype(np.float64)
                total = n.sum()
                if 2 * (n * np.log(n / total / up[sym])).sum() > spec.divergence * len(n):
                    own = up * np.float32(len(n) / (total + len(n)))
                    own[sym] += (n / (total + len(n))).astype(np.float32)
                    kept.add((k, ctx))
                    dist[(k, ctx)] = own
        # States also need what leads to a context: all its beginnings, with their longest retained suffix's distribution.
        states = set(kept)
        for k, ctx in kept:
            states.update((k - i, ctx >> 8 * i) for i in range(1, k))
        order = sorted(states)
        index = {x: i for i, x in enumerate(order)}
        self.contexts = len(kept)
        # Bytes that never follow anything in training are one class: they have the same probabilities and moves.
        seen = sorted(set(levels[0].sym.tolist()))
        self.cls = np.full(256, len(seen), np.int64)
        self.cls[seen] = np.arange(len(seen))
        some = [*seen, next((b for b in range(256) if b not in set(seen)), 0)]
        width = self.width = len(some)
        log, move = np.empty((len(order), width), np.float32), np.zeros((len(order), width), np.int32)
        for (k, ctx), i in index.items():
            j = k
            while (j, ctx & ((1 << 8 * j) - 1)) not in kept:
                j -= 1
            log[i] = np.log10(dist[(j, ctx & ((1 << 8 * j) - 1))])[some]
        # A state's moves are its longest proper suffix's, but for the longer contexts that it leads to itself.
        ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, ctx in order:
            if k:
                ahead.setdefault((k - 1, ctx >> 8), []).append((ctx & 255, index[(k, ctx)]))
        for k, ctx in order:
            i = index[(k, ctx)]
            if k:
                j = k - 1
                while (j, ctx & ((1 << 8 * j) - 1)) not in index:
                    j -= 1
                move[i] = move[index[(j, ctx & ((1 << 8 * j) - 1))]]
            for b, to in ahead.get((k, ctx), ()):
                move[i, self.cls[b]] = to
        self.log, self.move = log.ravel(), move.ravel()
        self.kept = [sorted(ctx for k, ctx in kept if k == own) for own in range(spec.depth + 1)]
        self.kept_state = [np.array([index[(k, ctx)] for ctx in own], np.int64) for k, own in enumerate(self.kept)]
        self.kept = [np.array(own, np.int64) for own in self.kept]

    def slot(self, ctx: np.ndarray) -> np.ndarray:
        return ((ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rare(self, ctx: np.ndarray) -> np.ndarray:
        """Indices of the windows of depth symbols that are not frequent."""
        held = self.slots[self.slot(ctx)]
        miss = np.flatnonzero(held != ctx)
        return miss[~found(self.crowded, ctx[miss])[1]]

    def rare_suffix(self, ctx: np.ndarray) -> np.ndarray:
        """Key of the shortest suffix of each window that is not frequent: its symbols, and its length in the lowest three bits."""
        length = np.ones(len(ctx), np.int64)
        for k in range(1, self.depth):
            length[found(self.often[k], ctx & ((1 << 8 * k) - 1))[1]] = k + 1
        return (ctx & ((np.int64(1) << 8 * length) - 1)) << 3 | length

    def probability(self, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Of each symbol behind its window, by the frequent retained contexts."""
        state = np.full(len(ctx), self.kept_state[0][0], np.int64)
        for k in range(1, self.depth + 1):
            at, there = found(self.kept[k], ctx & ((1 << 8 * k) - 1))
            state[there] = self.kept_state[k][at[there]]
        return 10.0 ** self.log[state * self.width + self.cls[sym]].astype(np.float64)

    def rare_places(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of texts whose window is not frequent: number of the text, key of the rare suffix, window and symbol packed."""
        d = self.depth
        buf, begin, size = stream(texts, d)
        wide = buf.astype(np.int64)
        ctx = np.zeros(len(buf) - d, np.int64)
        for k in range(1, d + 1):
            ctx |= wide[d - k : len(buf) - k] << (8 * (k - 1))
        at = self.rare(ctx)
        text = np.searchsorted(begin, at + d, "right") - 1
        inside = at + d < begin[text] + size[text]
        at, text = at[inside], text[inside]
        return text, self.rare_suffix(ctx[at]), ctx[at] << 8 | wide[at + d]

    def texts(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text, given as its words: many places of the run of all texts move side by side."""
        d = self.depth
        buf, begin, size = stream(texts, d)
        code = self.cls[buf]
        lanes = max(1, min(LANES, len(code) // 64))
        per = -(-len(code) // lanes)
        full = np.concatenate([np.full(d, self.cls[END]), code, np.full(per * lanes - len(code), self.cls[END])])
        grid = np.lib.stride_tricks.as_strided(full, (lanes, per + d), (full.strides[0] * per, full.strides[0])).T.copy()
        out = np.empty((per, lanes), np.float32)
        state = np.zeros(lanes, np.int64)
        for t in range(per + d):
            at = state * self.width + grid[t]
            if t >= d:
                out[t - d] = self.log[at]
            state = self.move[at].astype(np.int64)
        total = np.concatenate([[0.0], np.cumsum(out.T.ravel()[: len(code)], dtype=np.float64)])
        return total[begin + size] - total[begin]


def resolve(tree: Tree, spec: TreeSpec, suffix: np.ndarray, code: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and what the contexts that were not sent add to the log10 probability of each.

    Input: all counted windows with some rare suffixes (row -1; n: their count), and the places of texts with these
    suffixes. Contexts are tested from the shortest on, as in Tree.
    """
    own = row < 0
    c, count, length = code[own], n[own].astype(np.float64), suffix[own] & 7
    ask, first, back = np.unique(code[~own], return_index=True, return_inverse=True)
    if not len(c) or not len(ask):
        return np.zeros(0, np.int64), np.zeros(0)
    ask_length = (suffix[~own] & 7)[first]
    p, before = tree.probability(c >> 8, c & 255), tree.probability(ask >> 8, ask & 255)
    after = before.copy()
    for k in range(1, tree.depth + 1):
        on = np.flatnonzero(length <= k)
        if not len(on):
            continue
        pair, one, at = np.unique(c[on] & ((1 << 8 * (k + 1)) - 1), return_index=True, return_inverse=True)
        m, up = np.bincount(at, weights=count[on]), p[on][one]
        ctx, start = np.unique(pair >> 8, return_index=True)
        kinds = np.diff(np.append(start, len(pair)))
        total = np.add.reduceat(m, start)
        differs = 2 * np.add.reduceat(m * np.log(m / np.repeat(total, kinds) / up), start)
        stays = (total >= LEAST) & (differs > spec.divergence * kinds)
        back_off, share = kinds / (total + kinds), m / np.repeat(total + kinds, kinds)
        p[on] = np.where(np.repeat(stays, kinds), up * np.repeat(back_off, kinds) + share, up)[at]
        on = np.flatnonzero(ask_length <= k)
        key = ask[on] & ((1 << 8 * (k + 1)) - 1)
        i, there = found(ctx, key >> 8)
        there &= stays[i]
        j, seen = found(pair, key)
        after[on] = np.where(there, after[on] * back_off[i] + np.where(seen, share[j], 0.0), after[on])
    rows, at = np.unique(row[~own], return_inverse=True)
    return rows, np.bincount(at, weights=n[~own] * np.log10(after / before)[back])


def rare_scores(places: DataFrame, grams: DataFrame, shipped, spec: TreeSpec) -> DataFrame:
    """_row, more_score: what the contexts that were not sent add to texts' scores. places: suffix, code, n, _row.

    Dealt by rare suffix, which has less than p_min of the training symbols, and sorted by it.
    """
    names, kinds = ["suffix", "code", "n", "_row"], "suffix long, code long, n long, _row long"

    def counted(batches):
        tree = shipped.value[2]
        for batch in batches:
            ctx, sym, n = (batch.column(k).to_numpy() for k in range(3))
            at = tree.rare(ctx)
            yield pa.RecordBatch.from_arrays([pa.array(tree.rare_suffix(ctx[at])), pa.array(ctx[at] << 8 | sym[at]), pa.array(n[at]), pa.array(np.full(len(at), -1))], names=names)

    def run(batches):
        tree, held, size = shipped.value[2], [], 0

        def out(parts):
            rows, more = resolve(tree, spec, *(np.concatenate(x) for x in zip(*parts)))
            for a in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[a : a + 100_000]), pa.array(more[a : a + 100_000])], names=["_row", "more_score"])

        for batch in batches:
            part = [batch.column(k).to_numpy() for k in range(4)]
            if size >= RESOLVE_ROWS and len(part[0]):
                # Only whole groups of a suffix are resolved.
                last = held[-1][0][-1]
                cut = int(np.searchsorted(part[0], last, "right"))
                if cut < len(part[0]):
                    yield from out([*held, [x[:cut] for x in part]])
                    held, size, part = [], 0, [x[cut:] for x in part]
            if len(part[0]):
                held.append(part)
                size += len(part[0])
        if held:
            yield from out(held)

    windows = grams.select("ctx", "sym", "n").mapInArrow(common.tidy(counted), kinds)
    both = windows.union(places.select(*names)).repartition("suffix").sortWithinPartitions("suffix")
    return both.mapInArrow(common.tidy(run), "_row long, more_score double")


def build_tree(grams: DataFrame, spec: TreeSpec = TreeSpec()) -> Tree:
    """The part that is sent, with levels from the deepest to the root: only windows of relative frequency p_min or more come to the driver, at most 1 / p_min a level."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(float(LEAST), spec.p_min * total)
    levels = []
    for k in range(spec.depth + 1):
        level = grams.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx"), "sym").agg(F.sum("n").alias("n"))
        often = level.groupBy("ctx").agg(F.sum("n").alias("total"), F.collect_list(F.struct("sym", "n")).alias("follow")).where(F.col("total") >= least)  # 256 symbols at most
        levels.append(Level.of(often.select("ctx", F.explode("follow").alias("f")).select("ctx", "f.sym", "f.n").toArrow()))
    return Tree(levels, spec)


def score(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: TreeSpec = TreeSpec()) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for every row of df, learning from all rows of train.

    Three passes over the texts: one counts; one looks up the most frequent words in the task and hands on the others, with
    their number in the text, to a join with the word counts; and one hands on places whose window is not frequent. Rows
    are told apart by a number that follows from how the input is split, which is the same in both passes.
    """
    spark = df.sparkSession
    vocab = common.written(word_counts(train, text_col), "words")
    n, v = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    grams = common.written(gram_counts(train, spec.depth, text_col), "grams")
    tree = build_tree(grams, spec)
    top = vocab.where("word is not null").orderBy(F.desc("n"), "word").limit(spec.hot).toArrow()
    ends = vocab.where("word is null").select("n").first()
    ends = ends[0] if ends else 0
    floor = n + 1 * (v + 1)
    base = lambda c: float(np.log10((c + 1) / floor))
    values = np.log10((top.column("n").to_numpy().astype(np.float64) + 1) / floor)
    shipped = spark.sparkContext.broadcast((top.column("word").combine_chunks(), values, tree, base(ends), ends > 0))
    del top
    src = common.ids_and_text(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        hot, values, tree, end_base, end_known = shipped.value
        where = {w: i for i, w in enumerate(hot.to_pylist())}
        table, none = np.append(values, 0.0), len(hot)
        for batch in batches:
            ids, rows, at_row = batch.column(0), batch.column(2), 0
            for group in byte_groups(batch.column(1)):
                size = len(group)
                score = tree.texts(group)
                count = np.fromiter(map(len, group), np.int64, size)
                flat = [w for g in group for w in g]
                at = np.fromiter([where.get(w, none) for w in flat], np.int64, len(flat))
                text = np.repeat(np.arange(size), count)
                known = np.bincount(text, weights=at != none, minlength=size).astype(np.int64)
                base = np.bincount(text, weights=table[at], minlength=size)
                own_rows = rows.slice(at_row, size)
                yield pa.RecordBatch.from_arrays([ids.slice(at_row, size), own_rows, pa.array(count + 1), pa.array(known + int(end_known)), pa.array(base + end_base), pa.array(score), pa.nulls(size, pa.binary()), pa.array(np.zeros(size, np.int64))], names=OUT)
                odd = np.flatnonzero(at == none)
                rare = Counter(zip(text[odd].tolist(), [flat[i] for i in odd.tolist()]))
                pairs, times = list(rare), list(rare.values())
                for a in range(0, len(pairs), 50_000):
                    part = pairs[a : a + 50_000]
                    m, zero = len(part), pa.array(np.zeros(len(part), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, ids.type), own_rows.take(pa.array([t for t, _ in part], pa.int64())), zero, zero, pa.array(np.zeros(m)), pa.array(np.zeros(m)), pa.array([w for _, w in part], pa.binary()), pa.array(times[a : a + 50_000], pa.int64())], names=OUT)
                at_row += size

    def places(batches):
        tree = shipped.value[2]
        for batch in batches:
            rows, at_row = batch.column(2), 0
            for group in byte_groups(batch.column(1)):
                text, suffix, code = tree.rare_places(group)
                own_rows = rows.slice(at_row, len(group))
                for a in range(0, len(text), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(suffix[part]), pa.array(code[part]), pa.array(np.ones(len(text[part]), np.int64)), own_rows.take(pa.array(text[part]))], names=["suffix", "code", "n", "_row"])
                at_row += len(group)

    passed = common.written(src.mapInArrow(common.tidy(run), f"_id {kind}, _row long, n_tokens long, n_known long, base double, score double, word binary, times long"), "scored")
    rare = passed.where("word is not null").select("word", "_row", "times")
    c = F.coalesce(F.col("n"), F.lit(0))
    known = rare.join(vocab.where("word is not null"), "word", "left").select("_row", (F.col("times") * F.log10((c + 1) / F.lit(float(floor)))).alias("more_base"), F.when(c > 0, F.col("times")).otherwise(0).alias("more_known"), F.lit(0.0).alias("more_score"))
    deeper = rare_scores(src.mapInArrow(common.tidy(places), "suffix long, code long, n long, _row long"), grams, shipped, spec).select("_row", F.lit(0.0).alias("more_base"), F.lit(0).cast("long").alias("more_known"), "more_score")
    known = known.union(deeper).groupBy("_row").agg(*[F.sum(x).alias(x) for x in ("more_base", "more_known", "more_score")])
    return (
        passed.where("word is null")
        .join(known, "_row", "left")
        .select(
            F.col("_id").alias(id_col),
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(int(n)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        )
    )


OUT = ["_id", "_row", "n_tokens", "n_known", "base", "score", "word", "times"]


def op9_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = common.crc_mod("doc_id", 7) == 2
    out = score(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
