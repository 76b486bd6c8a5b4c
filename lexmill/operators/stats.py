"""Corpus statistics as aggregations: counts combine in the tasks before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def freq(df: DataFrame, *cols: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def entropy(counts: DataFrame, cnt: str = "cnt", by: tuple[str, ...] = ()) -> DataFrame:
    """Shannon entropy in bits of counted rows, by group: log2(N) - sum(c log2 c) / N, in one aggregation."""
    c = F.col(cnt)
    n = F.sum(c)
    return counts.groupBy(*by).agg(n.alias("n"), F.count(F.lit(1)).alias("distinct_values"), (F.log2(n.cast("double")) - F.sum(c * F.log2(c.cast("double"))) / n).alias("h"))


def conditional_entropy(joint: DataFrame, cond: str, cnt: str = "cnt", by: tuple[str, ...] = ()) -> DataFrame:
    """H(value | cond) in bits from counts of (cond, value), by group; two aggregations, no window."""
    inner = joint.groupBy(*by, cond).agg(F.sum(cnt).alias("nc"), F.sum(F.col(cnt) * F.log2(F.col(cnt).cast("double"))).alias("s"))
    return inner.groupBy(*by).agg(F.sum("nc").alias("n"), (F.sum(F.col("nc") * F.log2(F.col("nc").cast("double")) - F.col("s")) / F.sum("nc")).alias("h_cond"))


def zipf(counts: DataFrame, key: list[str], cnt: str = "cnt", top: int = 1000) -> DataFrame:
    """Exponent of frequency over rank, by log-log least squares over the `top` most frequent; NaN under five. Ranks are taken of `top` rows only."""
    head = counts.orderBy(F.desc(cnt), *key).limit(top)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(cnt), *key)))
    x, y = F.log10("rank"), F.log10(cnt)
    return ranked.agg(F.count(F.lit(1)).alias("n_ranks"), F.when(F.count(F.lit(1)) < 5, F.lit(float("nan"))).otherwise(-F.regr_slope(y, x)).alias("alpha"), F.max(cnt).alias("top_count"))


def ols_origin(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Least squares through the origin with the residuals' root mean square, from sums alone."""
    sxy, sxx, syy, n = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))
    k = sxy / sxx
    return df.groupBy(*by).agg(n.alias("n"), k.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), (syy - 2 * k * sxy + k * k * sxx) / n)).alias("rmse"))


def macro_f1(df: DataFrame, pred: str, truth: str, classes: tuple = (0, 1)) -> DataFrame:
    """Accuracy and the mean of the classes' F1, one pass; 1e-9 guards empty denominators."""
    p, t = F.col(pred), F.col(truth)
    f1 = []
    for k in classes:
        tp, fp, fn = F.sum(((p == k) & (t == k)).cast("long")), F.sum(((p == k) & (t != k)).cast("long")), F.sum(((p != k) & (t == k)).cast("long"))
        prec, rec = tp / (tp + fp + 1e-9), tp / (tp + fn + 1e-9)
        f1.append(2 * prec * rec / (prec + rec + 1e-9))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((p == t).cast("double")).alias("accuracy"), (sum(f1[1:], f1[0]) / len(f1)).alias("macro_f1"))


def gini(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Gini coefficient. Equal values are counted first; ranks are running sums over the distinct values of a group.

    The sums have two levels, so a group of any size is spread: buckets of the value's logarithm, which keep its order,
    and values within a bucket.
    """
    v = F.col(value).cast("double")
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")).withColumn("_b", F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 64))
    sums = c.groupBy(*by, "_b").agg(F.sum("c").alias("_s"))
    level = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.withColumn("_before", F.sum("_s").over(level) - F.col("_s")).drop("_s")
    inside = F.sum("c").over(Window.partitionBy(*by, "_b").orderBy(value))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*by, "_b")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    r = c.withColumn("_inside", inside).alias("x").join(before.alias("y"), on).select("x.*", (F.col("_inside") + F.col("_before")).alias("upto"))
    # Ranks of c equal values sum to c * (2 * upto - c + 1) / 2.
    ranks = F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2
    n = F.sum("c")
    return r.groupBy(*by).agg(n.alias("n"), (2 * F.sum(v * ranks) / (n * F.sum(v * F.col("c"))) - (n + 1) / n).alias("gini"))
