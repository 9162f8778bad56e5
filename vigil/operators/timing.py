"""Summaries of a timings table (run, seq, ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ranking import order_statistics


def latency_summary(timings: DataFrame, by: str = "run", ms: str = "ms") -> DataFrame:
    """by -> n, median, p05, p95 in ms, all exact. Null and NaN timings are no timings.

    The 5% and 95% points follow the exclusive rule: position q * (n + 1),
    interpolated between the neighbours; below 20 rows they are min and max.
    """
    timings = timings.filter(F.col(ms).isNotNull() & ~F.isnan(F.col(ms).cast("double")))
    counts = timings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    # Exclusive 20-quantiles in integers: position j * (n + 1) / 20, clamped to 1 .. n - 1.
    cuts = [("p05", 1), ("p95", 19)]
    wanted = [("median_lo", F.floor((n + 1) / 2)), ("median_hi", F.floor(n / 2) + 1)]
    for name, j in cuts:
        low = F.least(F.greatest(F.floor(j * (n + 1) / 20), F.lit(1)), n - 1)
        edge = F.lit(1) if j == 1 else n
        wanted += [(f"{name}_lo", F.when(n >= 20, low).otherwise(edge))]
        wanted += [(f"{name}_hi", F.when(n >= 20, low + 1).otherwise(edge))]
    ranks = counts.select(
        by,
        F.inline(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in wanted])),
    )
    found = order_statistics(timings, by, ms, ranks)
    wide = found.groupBy(by).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k, _ in wanted])

    def between(name: str, j: int):
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        position = F.least(F.greatest(F.floor(j * (n + 1) / 20), F.lit(1)), n - 1)
        part = j * (n + 1) - position * 20
        return F.when(n >= 20, (low * (20 - part) + high * part) / 20).otherwise(low)

    return wide.join(counts, by).select(
        by,
        "n",
        ((F.col("median_lo") + F.col("median_hi")) / 2).alias("latency_ms_median"),
        between("p05", 1).alias("latency_ms_p05"),
        between("p95", 19).alias("latency_ms_p95"),
    )


def throughput(
    timings: DataFrame, by: str = "run", seq: str = "seq", ms: str = "ms", batch_size: int = 32, n_iters: int = 200
) -> DataFrame:
    """Samples per second over the first full batches of each run; the ragged tail is dropped.

    Only ``n_iters // batch_size`` batches count. The ``seq`` of their last row is found
    first, from a histogram; only rows up to it are numbered, so the window of a run
    never holds more, however many rows the run has. ``seq`` is unique in a run.
    """
    rows = max(1, n_iters // batch_size) * batch_size
    order = Window.partitionBy(by).orderBy(seq)
    sizes = timings.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sizes.select(by, F.lit("last").alias("name"), F.least("_n", F.lit(rows)).cast("long").alias("rank"))
    last = order_statistics(timings, by, seq, ranks).select(by, F.col("value").alias("_last"))
    batches = (
        timings.select(by, seq, ms)
        .join(last, by)
        .filter(F.col(seq) <= F.col("_last"))
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= rows)
        .groupBy(by, F.floor((F.col("_rn") - 1) / batch_size).alias("_batch"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(ms).alias("_ms"))
        .filter(F.col("_n") == batch_size)
    )
    return batches.groupBy(by).agg(
        F.sum("_n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_batches"),
        F.try_divide(F.sum("_n").cast("double"), F.sum("_ms") / 1000.0).alias("throughput_samples_per_sec"),
    )


