"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

Benchmark items and texts become shingles of five words (an item of fewer words is one shingle of all of them). Windows
of a text have as many shingles as an item, and one is a leak if the weighted Jaccard similarity of its shingles and the
item's is 0.8 or more.

Which windows are looked at: an item of m shingles shares at least 0.8 m with such a window, so at least one of any
m - 0.8 m + 1 of its own; texts are looked up by so many of each item's least frequent shingles, which keeps a shingle of
many items out of the search. In a text found that way all shingles that it shares with the item are marked. A window can
be moved to begin at a marked place without losing one, and one whose marked places are all in the window before it is
no better, so windows begin at marked places where one more comes in, whatever the order in which the item's parts stand,
and those with too few marked places are left out. That loses no leak.

Each window gets a 64-bit SimHash of its weighted shingles. Multi-index Hamming search of a window's items finds those
within the radius: fingerprints are cut in 8 blocks, and of two that differ in at most 23 bits one block differs in at
most 2, so all blocks are looked up with up to two bits turned. A similarity of 0.8 means about 10 bits (deviation 3).
Candidates are decided by the exact weighted Jaccard similarity of the shingles.

Cases: null and empty texts and items match nothing; texts shorter than an item have one window of all they have; texts
of any length are used whole; texts of equal words are looked at once and reported for every id, a null one too; an id of
several rows is matched by each; equal items are each reported; of equal windows the first counts; an empty table, or no
item, gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, TURNED = 8, 8, 2
#: Guaranteed by the blocks: BLOCKS * (TURNED + 1) - 1.
RADIUS = 23
#: Two counters of 32 bits in a long.
LANES = 0x0000000100000001


def once(c: Column) -> Column:
    """c, marked as depending on the task: the optimizer then neither copies it into the expressions that use it, which would compute it again for each element of an array, nor pushes a filter through it."""
    return F.when(F.spark_partition_id() >= 0, c)


def word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), "")
    return once(F.transform(words, lambda w: F.xxhash64(w)))


def shingle_array(words: str, g: int) -> Column:
    """Hashes of g successive words, in order; empty where there are fewer."""
    wh = F.col(words)
    if g == 1:
        return wh
    own = lambda x, i: F.xxhash64(x, *[F.get(wh, i + k) for k in range(1, g)])
    return F.transform(F.slice(wh, 1, F.greatest(F.size(wh) - (g - 1), F.lit(0))), own)


def _shingled(df: DataFrame, id_col: str, text_col: str, g: int) -> DataFrame:
    """_id, r1, r2 (hashes of the words, which tell texts apart), sh array<long> of rows."""
    words = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where("_text is not null").select("_id", word_hashes("_text").alias("_w"))
    return words.select("_id", F.xxhash64("_w").alias("r1"), F.xxhash64(F.lit(7), "_w").alias("r2"), once(shingle_array("_w", g)).alias("sh"))


def fingerprints(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """key, _n (the weights' sum), fp long: the SimHash of each key's weighted values. Bit b is set where the weight of values with it exceeds that of those without."""
    sums = [F.expr(f"sum((shiftrightunsigned({value}, {b}) & {LANES}L) * {weight}) as _s{b}") for b in range(32)]
    wide = rows.groupBy(*key).agg(F.sum(weight).alias("_n"), *sums)
    bits = [f"shiftleft(cast(2 * (shiftrightunsigned(_s{b}, {32 * lane}) & 4294967295L) > _n as long), {b + 32 * lane})" for b in range(32) for lane in range(2)]
    return wide.select(*key, "_n", F.expr(" | ".join(bits)).alias("fp"))


def blocks(fp: str) -> Column:
    """array<struct<block, value>> of a fingerprint."""
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k as block, shiftrightunsigned({fp}, k * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L as value))")


def turned() -> Column:
    """All masks of up to TURNED bits of a block."""
    return F.expr(f"filter(sequence(0L, {(1 << BLOCK_BITS) - 1}L), m -> bit_count(m) <= {TURNED})")


def least_shared(of_window: Column, of_item: Column, similarity: float) -> Column:
    """Shingles that a window and an item of these sizes share at least where they have the similarity."""
    return F.ceil((of_window + of_item) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def starts(hits: DataFrame, similarity: float) -> DataFrame:
    """r1, r2, item, len, start: windows worth looking at. hits: r1, r2, many (the text's shingles), item, len, pos of shared shingles, each once.

    Of a text and item, each shared place is an event where a window that begins there begins, and one from where on
    windows hold it. In their order the number of both so far gives the shared places within each window.
    """
    end = F.greatest(F.lit(0), F.col("many") - F.col("len"))
    events = hits.select("*", F.explode(F.array(F.struct(F.lit(0).alias("kind"), (F.col("pos") - F.col("len") + 1).alias("at")), F.struct(F.lit(1).alias("kind"), F.col("pos").alias("at")))).alias("e")).select("r1", "r2", "item", "len", "many", "e.kind", "e.at")
    w = Window.partitionBy("r1", "r2", "item").orderBy("at", "kind")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    came, left = F.sum(1 - F.col("kind")).over(before), F.coalesce(F.sum("kind").over(before), F.lit(0))
    x = events.select("*", (came - left).alias("within"), F.lag("kind").over(w).alias("last"), end.alias("end"))
    # A window that would pass the end is moved back to it, where it holds more.
    need = least_shared(F.least("len", "many"), F.col("len"), similarity)
    x = x.where((F.col("kind") == 1) & ((F.col("last") == 0) & (F.col("within") >= need) | (F.col("at") > F.col("end"))))
    return x.select("r1", "r2", "item", "len", F.least("at", "end").alias("start")).distinct()


def _of_length(docs: DataFrame, items: DataFrame, g: int, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Leaks of items, written as (item, sh) with shingles of g words."""
    size = items.select("item", F.size("sh").alias("len"))
    item_rows = items.select("item", F.posexplode("sh").alias("ipos", "h")).join(size, "item")
    item_w = common.written(item_rows.groupBy("item", "len", "h").agg(F.count(F.lit(1)).alias("iw")), "item-weights")
    often = item_w.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    rare = item_rows.join(often, "h").withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("often", "h", "ipos")))
    rare = rare.where(F.col("nth") <= F.col("len") - F.ceil(F.col("len") * F.lit(similarity) - F.lit(1e-9)) + 1)
    lookup = common.sent_if_small(common.written(rare.select("item", "len", "h").distinct(), "item-shingles"))
    all_rows = _shingled(docs, id_col, text_col, g).where(F.size("sh") > 0)
    found = all_rows.select("_id", "r1", "r2", F.size("sh").alias("many"), F.explode("sh").alias("h")).join(lookup, "h").where(F.col("many") >= F.col("len") * similarity - 1e-9)
    found = common.written(found.select("_id", "r1", "r2", "item").distinct(), "found")
    # Shingles of the texts found, one of those with equal words.
    ids = common.sent_if_small(common.written(found.select(F.col("_id").alias("_own_id")).distinct(), "found-ids"))
    pairs = common.written(found.select("r1", "r2", "item").distinct(), "found-texts")
    name = common.free_name("_own_id", docs)
    own = _shingled(docs.join(ids.toDF(name), F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi"), id_col, text_col, g)
    own = own.join(common.sent_if_small(common.written(pairs.select("r1", "r2").distinct(), "texts")), ["r1", "r2"], "left_semi")
    own = common.written(own.groupBy("r1", "r2").agg(F.first("sh").alias("sh")), "shingles")
    hits = own.select("r1", "r2", F.size("sh").alias("many"), F.posexplode("sh").alias("pos", "h")).join(common.sent_if_small(item_w), "h").join(pairs, ["r1", "r2", "item"], "left_semi")
    spots = common.written(starts(hits.select("r1", "r2", "many", "item", "len", "pos"), similarity), "windows")
    place = ["r1", "r2", "start", "len"]
    window = own.join(spots.select(*place).distinct(), ["r1", "r2"]).select(*place, F.explode(F.slice("sh", F.col("start") + 1, F.col("len"))).alias("h"))
    window = common.written(window.groupBy(*place, "h").agg(F.count(F.lit(1)).alias("w")), "window-shingles")
    fp = fingerprints(window, place, "h", "w").join(spots, place).select(*place, "_n", "fp", "item")
    item_fp = fingerprints(item_w, ["item"], "h", "iw").select("item", F.col("_n").alias("item_n"), F.col("fp").alias("item_fp"))
    index = item_fp.select("*", F.explode(blocks("item_fp")).alias("b")).select("item", "item_n", "item_fp", "b", F.explode(turned()).alias("mask"))
    index = common.sent_if_small(common.written(index.select("item", "item_n", "item_fp", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value")), "index"))
    asked = fp.select("*", F.explode(blocks("fp")).alias("b")).select(*place, "_n", "fp", "item", "b.block", "b.value")
    near = asked.join(index, ["item", "block", "value"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    near = near.where(F.col("hamming") <= RADIUS).select(*place, "_n", "item", "item_n", "hamming").distinct()
    both = near.join(window, place).join(common.sent_if_small(item_w.drop("len")), ["item", "h"]).groupBy(*place, "item", "_n", "item_n", "hamming").agg(F.sum(F.least("w", "iw")).alias("shared"))
    sim = F.col("shared") / (F.col("_n") + F.col("item_n") - F.col("shared"))
    best = F.max(F.struct(F.col("sim"), (-F.col("start")).alias("neg"), F.col("hamming").alias("hamming"), F.col("len").alias("len"))).alias("x")
    texts = common.written(both.withColumn("sim", sim).where(F.col("sim") >= similarity).groupBy("r1", "r2", "item").agg(best), "leaking")
    whole = found.join(common.sent_if_small(texts), ["r1", "r2", "item"]).groupBy("_id", "item").agg(F.max("x").alias("x"))
    return whole.select("_id", "item", F.col("x.sim").alias("similarity"), (-F.col("x.neg")).cast("long").alias("first_word"), (F.col("x.len") + (g - 1)).cast("long").alias("n_words"), F.col("x.hamming").cast("long").alias("hamming"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id_col, item_id, similarity, first_word, n_words, hamming: the best window of each document for each item that it holds with the similarity or more."""
    words = common.written(benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("_text")).where("_text is not null").select("item", word_hashes("_text").alias("_w")).where(F.size("_w") > 0), "items")
    out = None
    for (g,) in sorted(words.select(F.least(F.size("_w"), F.lit(SHINGLE)).alias("g")).distinct().collect()):
        fit = F.size("_w") == g if g < SHINGLE else F.size("_w") >= g
        part = _of_length(docs, words.where(fit).select("item", shingle_array("_w", g).alias("sh")), g, id_col, text_col, similarity)
        out = part if out is None else out.union(part)
    if out is None:
        kinds = docs.select(F.col(id_col).alias("_id")).schema["_id"].dataType.simpleString(), words.schema["item"].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"_id {kinds[0]}, item {kinds[1]}, similarity double, first_word long, n_words long, hamming long")
    return out.withColumnsRenamed({"_id": id_col, "item": item_id})


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return leaks(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold an item go."""
    gone = common.written(leaks(docs, common.documents(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return common.without(docs, "doc_id", gone)
