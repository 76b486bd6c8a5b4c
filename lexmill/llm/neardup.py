"""Near-duplicate detection with DartMinHash.

A text is the weighted set of its shingles of five words, weights being their numbers. Hash functions throw darts, a
Poisson process for each shingle over weight and rank: those within the shingle's weight count, and of the darts that
fall on one of the k coordinates the one of least rank is kept. Two texts agree in a coordinate with a probability equal
to their weighted Jaccard similarity. Only darts below a rank that is expected to reach all coordinates are made; for
texts with an empty coordinate the rank is doubled. Coordinates are joined in bands; texts of one band value are
candidates, and the exact weighted Jaccard similarity decides.

Texts of equal words are one class member first. In a band value of the first bands all members are compared with the
member that meets most others anywhere; verified links become classes by connected components. Then, over all bands,
members are compared with the foremost ones of their band value where these are in another class, and what is left of
different classes in one band value is cut by further one-bit coordinates of the signatures into parts of a few members,
which all meet each other. What is then still of different components in crowded band values, as texts that only share a
long common line, meets by shingles instead: each text's shingles are ordered by how many of these texts hold them, and two
texts of the similarity must share one of the rarest fifth of each and one that leaves enough behind it. That misses no pair
of the similarity and makes few others. Pairs within a class are not made: a group of very many near copies costs each of them
a few comparisons. Two texts of the similarity are compared, or in one class already, if they share a band value: 0.9993 do
(24 bands of 6).

Cases: null, empty and wordless texts are classes of their own; texts of fewer than five words have one shingle of all
of them; texts are used whole; an id that occurs in several rows is one document, found by its first text in order of
hashes and verified by any of them; a null id is a document of its own class, null; ties go to the least id; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, tokens

GROUP_CHARS = 1 << 18
#: Doubles may miss a whole number by less.
EXACT = 1e-6


@dataclass(frozen=True)
class DartSpec:
    """bands of `rows` coordinates each; the first few are worked through before the others, which then only meet texts not linked yet.

    bits: of so many coordinates one bit each is kept; a multiple of 64. hubs: members of a band value that all others
    of it meet. few: members of a part of a band value that meet each other; cuts: by how many bits larger ones are cut, level by level.
    """

    bands: int = 24
    rows: int = 6
    shingle: int = 5
    similarity: float = 0.8
    first_bands: int = 4
    bits: int = 256
    hubs: int = 4
    few: int = 12
    cuts: tuple[int, ...] = (0, 4, 8, 12, 16, 20, 24, 32, 48, 64, 128, 256)

    @property
    def k(self) -> int:
        return max(self.bands * self.rows, self.bits)


def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] from 64-bit hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * (1 / (1 << 53))


def signatures(element: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """[texts, k] values of weighted sets that lie one after another; two equal values are the same dart. A set without elements has the greatest value everywhere.

    Weights fall in strips [0, 1), [1, 2), [2, 4), ...; in a strip of width s the ranks of successive darts grow by
    exponentials of mean 1 / s, and each dart has a place within the strip.
    """
    texts = len(first) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full(texts * k, empty)
    count = np.diff(first)
    text = np.repeat(np.arange(texts), count)
    total = np.add.reduceat(np.append(weight, 0.0), first[:-1]) if texts else np.zeros(0)
    total = np.where(count > 0, total, 0)
    top = float(weight.max()) if len(weight) else 0.0
    strips, low = [], 0.0
    while low < top:
        width = 1.0 if low < 1 else low
        strips.append((low, width))
        low += width
    need = np.flatnonzero(total > 0)
    reach = np.zeros(texts)
    reach[need] = (k * np.log(k) + 2 * k) / total[need]
    while len(need):
        # Only texts in need; their elements with the strips that their weights reach.
        wanted = np.zeros(texts, bool)
        wanted[need] = True
        pick = np.flatnonzero(wanted[text])
        for s, (low, width) in enumerate(strips):
            own = pick[weight[pick] > low]
            h = tokens.mix(element[own] + np.uint64(0xA24BAED4963EE407 * (s + 1) & (2**64 - 1)))
            rank = np.zeros(len(own))
            limit, part, t = reach[text[own]], (weight[own] - low) / width, text[own]
            live = np.arange(len(own))
            j = 0
            while len(live):
                block = int(max(1, min(64, 65536 // len(live))))
                step = (np.uint64(j) + np.arange(block, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                d = tokens.mix(h[live][:, None] ^ tokens.mix(step + np.uint64(1))[None, :])
                ranks = rank[live][:, None] + np.cumsum(-np.log(_uniform(d)) / width, axis=1)
                e = tokens.mix(d + np.uint64(0x1F83D9ABFB41BD6B))
                inside = (ranks < limit[live][:, None]) & (_uniform(e) <= part[live][:, None])
                row, col = np.nonzero(inside)
                if len(row):
                    e = tokens.mix(e[row, col])
                    coordinate = (e >> np.uint64(32)) % np.uint64(k)
                    # 40 bits of rank over what the text can reach at all (fixed point, the same for all texts), 24 of the dart.
                    value = np.minimum(ranks[row, col] * (1 << 26), float((1 << 40) - 1)).astype(np.uint64) << np.uint64(24) | (e & np.uint64(0xFFFFFF))
                    np.minimum.at(out, t[live[row]] * k + coordinate.astype(np.int64), value)
                rank[live] = ranks[:, -1]
                live = live[ranks[:, -1] < limit[live]]
                j += block
        need = need[(out.reshape(texts, k)[need] == empty).any(axis=1)]
        reach[need] *= 2
    return out.reshape(texts, k)


def weighted(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, weights, where each text's begin, and two hashes of each text's words): shingles are distinct and sorted in a text."""
    w = tokens.words(texts, tokens.IS_BREAK)
    sh, at = tokens.shingles(w, n)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    weight = np.diff(np.append(starts, len(sh))).astype(np.float64)
    first = np.searchsorted(doc[starts], np.arange(len(texts) + 1))
    # The sequence of words, whole.
    power = tokens.powers(tokens.RATIO, int(w.count().max()) + 1 if len(texts) else 1)
    age = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count())
    mixed = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(w.hash + np.uint64(c)) * power[age], dtype=np.uint64)]) for c in (1, 2)]
    whole = [tokens.mix(m[w.first[1:]] - m[w.first[:-1]] + w.count().astype(np.uint64)) for m in mixed]
    return sh[starts], weight, first, whole[0], whole[1]


def _lower(group) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") for _, t in group]


def sketches(df: DataFrame, id_col: str, text_col: str, spec: DartSpec) -> DataFrame:
    """_id, h1, h2 (hashes of the words), n (shingles with their weights), bands array<long> (null for wordless texts), bits array<long>."""
    src = common.ids_and_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for group in common.groups(batch, GROUP_CHARS):
                sh, weight, first, h1, h2 = weighted(_lower(group), spec.shingle)
                whole = signatures(sh, weight, first, spec.k)
                one = (tokens.mix(whole[:, : spec.bits]) & np.uint64(1)).reshape(len(group), -1, 64)
                packed = (one << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype(np.int64)
                sig = whole[:, : spec.bands * spec.rows].reshape(len(group), spec.bands, spec.rows)
                key = np.full(sig.shape[:2], np.uint64(0))
                for r in range(spec.rows):
                    key = tokens.mix(key * tokens.RATIO + sig[:, :, r])
                key = tokens.mix(key + np.arange(spec.bands, dtype=np.uint64)[None, :]).astype(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * spec.bands), pa.array(key.ravel()), mask=pa.array(np.diff(first) == 0))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in group], batch.schema.field(0).type), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), pa.array(np.diff(np.concatenate([[0], np.cumsum(weight.astype(np.int64))])[first])), bands, pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.ravel()))], ["_id", "h1", "h2", "n", "bands", "bits"])

    return src.mapInArrow(common.tidy(run), f"_id {kind}, h1 long, h2 long, n long, bands array<long>, bits array<long>")


def shingle_sets(df: DataFrame, spec: DartSpec) -> DataFrame:
    """_id, elements array<long> of (_id, _text) rows: a shingle of weight w is w elements, so plain set sizes give the weighted similarity."""
    kind = df.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for group in common.groups(batch, GROUP_CHARS):
                sh, weight, first, _, _ = weighted(_lower(group), spec.shingle)
                n = weight.astype(np.int64)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                el = tokens.mix(np.repeat(sh, n) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])[first].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in group], batch.schema.field(0).type), pa.ListArray.from_arrays(pa.array(at), pa.array(el))], ["_id", "elements"])

    return df.mapInArrow(common.tidy(run), f"_id {kind}, elements array<long>")


def similar(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, spec: DartSpec) -> DataFrame:
    """Those of pairs (a, b), a written table, whose texts have the similarity or more, as a written table; their sets are made from the texts again."""
    ids = common.written(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "ids")
    sets = common.written(shingle_sets(common.ids_and_text(df, id_col, text_col).join(common.sent_if_small(ids), "_id", "left_semi"), spec), "sets")
    x = pairs.join(sets.select(F.col("_id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("_id").alias("b"), F.col("elements").alias("eb")), "b")
    both = F.size(F.array_intersect("ea", "eb"))
    out = common.written(x.where(both >= spec.similarity * (F.size("ea") + F.size("eb") - both)).select("a", "b").distinct(), "verified")
    common.discard(ids, sets)
    return out


BUCKET = ["band", "value"]


def foremost(m: DataFrame, n: int) -> DataFrame:
    """The n members of each band value that meet most others anywhere, the least id first of equal ones, as hub, hub_root, hub_n. The limit on the rank works in each task before the shuffle, so no task gets a whole band value."""
    w = Window.partitionBy(*BUCKET).orderBy(F.desc("degree"), "rep")
    top = m.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return top.select(*BUCKET, F.col("rep").alias("hub"), F.col("root").alias("hub_root"), F.col("n").alias("hub_n"))


def _alike(n: str, hub_n: str, similarity: float):
    """Whether sets of these sizes can reach the similarity at all."""
    return (F.col(n) >= similarity * F.col(hub_n)) & (F.col(hub_n) >= similarity * F.col(n))


def starred(m: DataFrame, hubs: DataFrame, spec: DartSpec) -> DataFrame:
    """Pairs (a, b) of members and hubs of a band value that are in different components: at most one a member and hub."""
    h = hubs.withColumnsRenamed({c: f"hub_{c}" for c in BUCKET})
    p = m.join(h, (F.col("band") == F.col("hub_band")) & (F.col("value") == F.col("hub_value")) & (F.col("root") != F.col("hub_root")) & _alike("n", "hub_n", spec.similarity))
    return p.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def refined(at: DataFrame, spec: DartSpec) -> DataFrame:
    """Pairs (a, b) of near members of band values whose members are not of one component; they join most of a crowd before its members meet hub after hub.

    A band value of over spec.few members is cut by one-bit coordinates, more of them a level, in an order of
    its band's own, until a part has no more than that: each member goes to its shallowest such part. Pairs are all of
    different components within a part, so their number is at most few / 2 times that of members.
    """
    words = spec.bits // 64
    # A band begins with a word of the text's bits of its own.
    ordered = F.array(*[F.col(f"s{k}") for k in range(words)])
    word = lambda k: F.element_at(ordered, ((F.col("band") + F.lit(k)) % words + 1).cast("int"))
    levels = []
    for level, used in enumerate(spec.cuts):
        whole, rest = divmod(used, 64)
        parts = [word(k) for k in range(whole)] + ([F.shiftrightunsigned(word(whole), 64 - rest)] if rest else [])
        levels.append(F.struct(F.lit(level).alias("level"), (F.xxhash64(*parts) if parts else F.lit(0).cast("long")).alias("part")))
    key = [*BUCKET, "level", "part"]
    each = at.select(*BUCKET, "rep", "root", "n", "degree", F.explode(F.array(*levels)).alias("x")).select(*BUCKET, "rep", "root", "n", "degree", "x.level", "x.part")
    size = each.groupBy(*key).agg(F.count(F.lit(1)).alias("many"), (F.min("root") != F.max("root")).alias("mixed"))
    fits = each.join(size, key).where(F.col("mixed") & (F.col("many") <= spec.few))
    own = fits.groupBy(*BUCKET, "rep").agg(F.min(F.struct("level", "part", "root", "n")).alias("x"))
    small = common.written(own.select(*BUCKET, "rep", "x.*"), "parts")
    other = small.select(*[F.col(c).alias(f"o_{c}") for c in (*key, "rep", "root", "n")])
    same = [F.col(c) == F.col(f"o_{c}") for c in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    pairs = small.join(other, on & (F.col("rep") < F.col("o_rep")) & (F.col("root") != F.col("o_root")) & _alike("n", "o_n", spec.similarity))
    return pairs.select(F.col("rep").alias("a"), F.col("o_rep").alias("b")).distinct()


def rarest(rest: DataFrame, df: DataFrame, id_col: str, text_col: str, spec: DartSpec) -> DataFrame:
    """rep, root, element, n, place of the foremost elements of each text of rest (rep, root), a written table; those of a single text are left out.

    The elements of a text are ordered by the number of texts that hold them, the rarest first. Of two texts of the similarity
    each has n - ceil(similarity * n) + 1 elements up to which they have met: with fewer in common they could not reach it.
    So a line that very many texts share, being the most frequent of their elements, brings no two of them together.
    """
    texts = common.ids_and_text(df, id_col, text_col).join(common.sent_if_small(rest.select(F.col("rep").alias("_id"))), "_id", "left_semi")
    # An id of several texts has each of them here, under its hash.
    sets = common.written(shingle_sets(texts, spec).select("_id", F.xxhash64("elements").alias("text"), "elements"), "sets")
    each = sets.dropDuplicates(["_id", "text"]).select("_id", "text", F.explode("elements").alias("element"))
    common_ones = common.written(each.groupBy("element").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "frequent")
    counted = each.join(common.sent_if_small(common_ones), "element", "left")
    own = counted.groupBy("_id", "text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("many", F.lit(1)).alias("many"), "element"))).alias("order")).withColumn("n", F.size("order"))
    ends = own.select("_id", "n", F.posexplode(F.slice("order", F.lit(1), (F.col("n") - F.ceil(spec.similarity * F.col("n") - EXACT) + 1).cast("int"))).alias("place", "x"))
    out = common.written(ends.where("x.many > 1").select(F.col("_id").alias("rep"), F.col("x.element").alias("element"), "n", "place").join(common.sent_if_small(rest), "rep"), "ends")
    common.discard(sets, common_ones)
    return out


def _reachable(spec: DartSpec):
    """Whether two texts whose first common element this is can still reach the similarity."""
    return _alike("n", "o_n", spec.similarity) & (F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place")) >= spec.similarity / (1 + spec.similarity) * (F.col("n") + F.col("o_n")) - EXACT)


def starred_by_element(ends: DataFrame, spec: DartSpec) -> DataFrame:
    """Pairs (a, b) of the texts of an element with one of them, that in which it is foremost: most of a crowd is one component then."""
    hub = ends.groupBy("element").agg(F.min(F.struct("place", "rep", "root", "n")).alias("x")).select(F.col("element").alias("o_element"), *[F.col(f"x.{c}").alias(f"o_{c}") for c in ("place", "rep", "root", "n")])
    p = ends.join(hub, (F.col("element") == F.col("o_element")) & (F.col("root") != F.col("o_root")) & _reachable(spec))
    return p.select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct()


def sharing(ends: DataFrame, spec: DartSpec) -> DataFrame:
    """Pairs (a, b) of texts of different components that share one of their rarest elements and can reach the similarity from there."""
    mixed = ends.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("element")
    at = ends.join(mixed, "element", "left_semi")
    other = at.select(*[F.col(c).alias(f"o_{c}") for c in ("element", "rep", "root", "n", "place")])
    p = at.join(other, (F.col("element") == F.col("o_element")) & (F.col("rep") < F.col("o_rep")) & (F.col("root") != F.col("o_root")) & _reachable(spec))
    return p.select(F.col("rep").alias("a"), F.col("o_rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: DartSpec = DartSpec()) -> DataFrame:
    """id_col, class_id (the least id of the class), class_size long: one row an id."""
    sk = common.written(sketches(df, id_col, text_col, spec).groupBy("_id").agg(F.min(F.struct("h1", "h2", "n", "bands", "bits")).alias("s")).select("_id", "s.*"), "sketches")
    worded = sk.where("bands is not null")
    # Texts of equal words: the least id stands for all.
    same = common.written(worded.groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")).where("rep is not null"), "same")
    parts = [F.col("bits")[k].alias(f"s{k}") for k in range(spec.bits // 64)]
    buckets = same.select("rep", "n", *parts, F.posexplode("bands").alias("band", "value"))
    shared = buckets.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    met = common.written(buckets.join(shared, BUCKET), "met")
    degree = met.groupBy("rep").agg(F.sum(F.col("many") - 1).alias("degree"))
    members = common.written(met.drop("many").join(degree, "rep"), "members")
    common.discard(met)

    # All pairs compared so far, and the components of their links.
    done: list[DataFrame] = []
    roots: DataFrame | None = None

    def linked(pairs: DataFrame) -> bool:
        """Compares pairs that are new and joins the components of those that are alike; whether any pair was new."""
        nonlocal roots
        new = common.written(pairs.join(reduce(DataFrame.union, done), ["a", "b"], "left_anti") if done else pairs, "pairs")
        if not new.limit(1).count():
            common.discard(new)
            return False
        done.append(new)
        found = similar(new, df, id_col, text_col, spec)
        roots = graph.extended(roots, found)
        common.discard(found)
        return True

    def rooted(rows: DataFrame) -> DataFrame:
        """rows (rep, ...) with the root of each one's component."""
        if roots is None:
            return rows.withColumn("root", F.col("rep"))
        return rows.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def placed() -> DataFrame:
        """Members with their component, of band values that have several."""
        at = rooted(members)
        mixed = at.groupBy(*BUCKET).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*BUCKET)
        return common.written(at.join(mixed, BUCKET, "left_semi"), "placed")

    few = members.where(F.col("band") < spec.first_bands).withColumn("root", F.col("rep"))
    linked(starred(few, foremost(few, 1), spec))
    for hubs in (1, spec.hubs):
        at = placed()
        linked(starred(at, foremost(at, hubs), spec))
        common.discard(at)
    at = placed()
    linked(refined(at, spec))
    common.discard(at)
    # Members left of several components in crowded band values meet by their rarest shingles, which misses none of the similarity.
    at = placed()
    crowded = at.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > spec.few).select(*BUCKET)
    rest = common.written(at.join(crowded, BUCKET, "left_semi").select("rep", "root").distinct(), "rest")
    common.discard(at)
    ends = rarest(rest, df, id_col, text_col, spec)
    if linked(starred_by_element(ends, spec)):
        ends, old = common.written(rooted(ends.drop("root")), "ends"), ends
        common.discard(old)
    linked(sharing(ends, spec))
    common.discard(rest, ends)
    rep = worded.select("_id", "h1", "h2").join(same.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("_id", "rep")
    named = rooted(rep).select("_id", F.col("root").alias("class_id"))
    named = common.written(named.union(sk.where("bands is null").select("_id", F.col("_id").alias("class_id"))), "classes")
    common.discard(sk, same, members, *done, roots)
    sizes = named.groupBy(F.col("class_id").alias("_class")).agg(F.count(F.lit(1)).alias("class_size"))
    return named.join(sizes, F.col("class_id").eqNullSafe(F.col("_class"))).select(F.col("_id").alias(id_col), "class_id", "class_size")


def op7_dartminhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.documents(spark, sf_dir))
    return out.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def neardup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document of the least id stays, whole."""
    gone = common.written(near_duplicates(docs).where("doc_id <> class_id").select("doc_id"), "gone")
    return common.without(docs, "doc_id", gone)
