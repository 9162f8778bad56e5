"""Sorted accumulations that never gather a whole group into one task.

A window without (or with a skewed) ``partitionBy`` would put every row of a
group on one task. Each function here works on slices that are bounded by
construction and combines one small row per slice afterwards.
"""

from __future__ import annotations


from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from vigil.session import shuffle_partitions

CHILD_BITS = 16


def _ordered(by: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def rank_sums(
    df: DataFrame,
    by: list[str],
    score: str,
    truth: str,
    sums: dict[str, Column] | None = None,
    tags: list[str] | None = None,
    variants: dict[float, Column] | None = None,
) -> DataFrame:
    """Per group: positives, negatives and the Mann-Whitney count of a sorted score.

    Returns by + pos, neg, ``wins`` = sum over positives of the negatives with a
    smaller score plus half of those with the same score, and the ``sums``
    (expressions over pos, neg, the score and the tags).

    1. Equal scores collapse in a combinable aggregate, so a score shared by a
       third of the rows is one row afterwards.
    2. The distinct scores are range-partitioned; each slice is sorted on its own.
    3. One row per slice is left. A positive in a later slice beats all negatives
       of the earlier ones, so the slices combine from their totals alone.

    The plan is linear: no join back, hence no need for two branches to agree on
    the slice boundaries.

    ``variants`` evaluates several selections of the same rows in one sort: each
    maps a value (added as column ``_variant``) to a condition on the ``tags``,
    columns that are kept apart when scores collapse.
    """
    spark = df.sparkSession
    tags, sums = tags or [], sums or {}
    chosen = variants if variants is not None else {0.0: F.lit(True)}
    t = F.col(truth).cast("long")
    distinct = df.groupBy(*by, score, *tags).agg(F.sum(t).alias("pos"), F.sum(1 - t).alias("neg"))
    sliced = distinct.repartitionByRange(shuffle_partitions(spark), *by, score).withColumn(
        "_slice", F.spark_partition_id()
    )
    # RANGE frames: rows of the same score (with other tags) are peers.
    inside = _ordered([*by, "_slice"], score)
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = inside.rangeBetween(Window.currentRow, Window.currentRow)
    zero = F.lit(0).cast("long")
    neg = {v: F.when(c, F.col("neg")).otherwise(zero) for v, c in chosen.items()}
    below = sliced.select(
        "*",
        *[(F.sum(n).over(upto) - F.sum(n).over(peers) / 2).alias(f"_below_{i}") for i, n in enumerate(neg.values())],
    )
    rows = [
        F.struct(
            F.lit(v).alias("_variant"),
            F.when(c, F.col("pos")).otherwise(zero).alias("_pos"),
            neg[v].alias("_neg"),
            F.when(c, F.col("pos") * F.col(f"_below_{i}")).otherwise(F.lit(0.0)).alias("wins"),
            *[F.when(c, e).otherwise(zero).alias(k) for k, e in sums.items()],
        )
        for i, (v, c) in enumerate(chosen.items())
    ]
    long = below.select(*by, "_slice", F.inline(F.array(*rows))).withColumnsRenamed({"_pos": "pos", "_neg": "neg"})
    keys = [*by, "_variant"]
    totals = ["pos", "neg", *sums]
    slices = long.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(c) for c in [*totals, "wins"]])
    earlier = F.coalesce(F.sum("neg").over(_before(_ordered(keys, "_slice"))), zero)
    combined = slices.select(*keys, *totals, (F.col("wins") + F.col("pos") * earlier).alias("wins"))
    out = combined.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*totals, "wins"]])
    return out if variants is not None else out.drop("_variant")


def auc() -> Column:
    """ROC-AUC from :func:`rank_sums`; null where only one class occurs."""
    return F.try_divide(F.col("wins"), F.col("pos").cast("double") * F.col("neg"))


def sum_before(df: DataFrame, seq: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all smaller ``seq`` (a unique long column).

    The key is cut into levels of 16 bits. A slice of a level has at most 65,536
    children whatever the data looks like, so every window is bounded, and the
    slices are fixed by the key, so a recomputed task agrees with the others.
    """
    level = df.withColumn("_slice", F.shiftright(seq, CHILD_BITS))
    inside = F.coalesce(F.sum(value).over(_before(_ordered(["_slice"], seq))), F.lit(0))
    sorted_rows = level.withColumn("_inside", inside)
    totals = level.groupBy("_slice").agg(F.sum(value).alias("_total"))
    offsets = _slice_offsets(totals, levels=64 // CHILD_BITS - 1)
    return (
        sorted_rows.join(offsets, "_slice")
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_slice", "_inside", "_offset")
    )


def _slice_offsets(totals: DataFrame, levels: int) -> DataFrame:
    """(_slice, _offset): sum of the totals of all smaller slices."""
    zero = F.lit(0)
    if levels == 1:
        w = _before(_ordered([], "_slice"))
        return totals.select("_slice", F.coalesce(F.sum("_total").over(w), zero).alias("_offset"))
    nested = totals.withColumn("_parent", F.shiftright("_slice", CHILD_BITS))
    inside = nested.select(
        "_slice",
        "_parent",
        F.coalesce(F.sum("_total").over(_before(_ordered(["_parent"], "_slice"))), zero).alias("_inside"),
    )
    parents = nested.groupBy(F.col("_parent").alias("_slice")).agg(F.sum("_total").alias("_total"))
    outer = _slice_offsets(parents, levels - 1).select(
        F.col("_slice").alias("_parent"), F.col("_offset").alias("_outer")
    )
    return inside.join(outer, "_parent").select("_slice", (F.col("_inside") + F.col("_outer")).alias("_offset"))


def order_statistics(df: DataFrame, by: str, value: str, ranks: DataFrame, slices: int = 1024) -> DataFrame:
    """Exact values at given ranks: ``ranks`` has (by, name, rank); returns (by, name, value).

    Boundaries from ``approxQuantile`` (at most ``slices`` numbers reach the
    driver) cut the value range. A histogram tells which slice of which group
    holds a rank; only those slices are sorted, after equal values collapsed.
    The boundaries only balance the work, the result is exact for any of them.
    """
    steps = [i / slices for i in range(1, slices)]
    bounds = sorted(set(df.approxQuantile(value, steps, 1.0 / (2 * slices)))) or [0.0]
    cut = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")], inputCol=value, outputCol="_slice", handleInvalid="skip"
    )
    counts = cut.transform(df.select(by, value)).groupBy(by, "_slice", value).agg(F.count(F.lit(1)).alias("_n"))
    histogram = counts.groupBy(by, "_slice").agg(F.sum("_n").alias("_total"))
    upto = F.sum("_total").over(_ordered([by], "_slice").rowsBetween(Window.unboundedPreceding, 0))
    located = (
        histogram.withColumn("_upto", upto)
        .join(ranks, by)
        .filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_total")))
        .select(by, "_slice", "name", (F.col("rank") - F.col("_upto") + F.col("_total")).alias("_rank"))
    )
    wanted = counts.join(located.select(by, "_slice").distinct(), [by, "_slice"], "left_semi")
    inside = _ordered([by, "_slice"], value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        wanted.withColumn("_seen", F.sum("_n").over(inside))
        .join(located, [by, "_slice"])
        .filter((F.col("_rank") <= F.col("_seen")) & (F.col("_rank") > F.col("_seen") - F.col("_n")))
        .select(by, "name", F.col(value).alias("value"))
    )
