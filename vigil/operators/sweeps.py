"""Threshold tuning and the two-stage cascade, on scores that exist already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import decide, f1, f1_macro, ratio
from vigil.operators.metrics import evaluate, with_binary_metrics
from vigil.operators.ranking import auc, rank_sums

# Stage-1 thresholds of the cascade sweep and the no-loss tolerance.
CASCADE_THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
NO_LOSS_TOLERANCE = 1e-9


def linear_grid(low: float = 0.05, high: float = 0.95, n: int = 91) -> list[float]:
    """n evenly spaced thresholds; the last one is exactly ``high``."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def grid_index(score: Column, grid: list[float]) -> Column:
    """How many thresholds of an evenly spaced ascending grid are <= score.

    Arithmetic gives the position up to rounding; comparing with the neighbouring
    grid values makes it exact. Two look-ups per row replace 91 comparisons.
    """
    n = len(grid)
    if n < 3:
        return sum((decide(score, t) for t in grid), F.lit(0))
    step = (grid[-1] - grid[0]) / (n - 1)
    values = F.array(*[F.lit(t) for t in grid])
    guess = F.least(F.greatest(F.floor((score - grid[0]) / step) + 1, F.lit(0)), F.lit(n)).cast("int")
    up = F.coalesce((score >= F.get(values, guess)).cast("int"), F.lit(0))
    down = F.coalesce((score < F.get(values, guess - 1)).cast("int"), F.lit(0))
    return (guess + up - down).cast("int")


# ------------------------------------------------------------------ threshold
def threshold_curve(
    df: DataFrame, by: list[str], grid: list[float] | None = None, truth: str = "label", score: str = "p_hate"
) -> DataFrame:
    """by + idx, threshold, tn, fp, fn, tp, f1_hate, f1_macro for every threshold.

    One pass: each row adds to one histogram cell (how many thresholds it
    passes), then every threshold sums the cells at or above it. The data is
    never multiplied by the grid; what is expanded are the few histogram rows.
    """
    grid = linear_grid() if grid is None else grid
    n = len(grid)
    t = F.col(truth)
    cells = (
        df.select(*by, t.alias("_t"), grid_index(F.col(score), grid).alias("_k"))
        .groupBy(*by, "_k")
        .agg(F.sum(F.col("_t").cast("long")).alias("pos"), F.sum((1 - F.col("_t")).cast("long")).alias("neg"))
    )
    # At most n + 1 cells per group, so they fit one row; empty cells need no padding.
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct("_k", "pos", "neg")).alias("_cells"))
    each = packed.select(*by, "_cells", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))

    def from_cell(field: str, low: Column) -> Column:
        passing = F.filter("_cells", lambda c: c["_k"] >= low)
        return F.aggregate(passing, F.lit(0).cast("long"), lambda a, c: a + c[field])

    summed = each.select(
        *by,
        "_k",
        from_cell("pos", F.col("_k")).alias("tp"),
        from_cell("neg", F.col("_k")).alias("fp"),
        from_cell("pos", F.lit(0)).alias("_p"),
        from_cell("neg", F.lit(0)).alias("_n"),
    )
    tn, fp, fn, tp = F.col("_n") - F.col("fp"), F.col("fp"), F.col("_p") - F.col("tp"), F.col("tp")
    return summed.select(
        *by,
        (F.col("_k") - 1).alias("idx"),
        F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("_k")).alias("threshold"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
        f1(tp, fp, fn).alias("f1_hate"),
        f1_macro(tn, fp, fn, tp).alias("f1_macro"),
    )


def best_threshold(curve: DataFrame, by: list[str]) -> DataFrame:
    """Threshold with the highest F1 per group; ties go to the lowest threshold."""
    rank = F.struct("f1_hate", -F.col("threshold"))
    return curve.groupBy(*by).agg(
        F.max_by("threshold", rank).alias("best_threshold"), F.max("f1_hate").alias("best_f1_hate")
    )


def tune_threshold(df: DataFrame, by: list[str], truth: str = "label", score: str = "p_hate") -> DataFrame:
    """Choose t* on the val split, apply it to the test split, compare with 0.5."""
    chosen = best_threshold(threshold_curve(df.filter(F.col("split") == "val"), by, None, truth, score), by)
    test = df.filter(F.col("split") == "test")
    # Whether a test row passes t* follows from its histogram cell: t* is on the grid.
    grid_rows = threshold_curve(test, by, None, truth, score)
    tuned = (
        grid_rows.join(chosen, [*by])
        .filter(F.col("threshold") == F.col("best_threshold"))
        .select(*by, "best_threshold", "best_f1_hate", *[F.col(c).alias(f"{c}_tuned") for c in ("f1_hate", "f1_macro")])
    )
    default = evaluate(test, by, truth, score, 0.5).select(
        *by, F.col("f1_binary").alias("f1_hate_default"), F.col("f1_macro").alias("f1_macro_default"), "roc_auc"
    )
    return tuned.join(default, [*by]).withColumns(
        {
            "delta_f1_hate": F.col("f1_hate_tuned") - F.col("f1_hate_default"),
            "delta_f1_macro": F.col("f1_macro_tuned") - F.col("f1_macro_default"),
        }
    )


# -------------------------------------------------------------------- cascade
def cascade_scores(df: DataFrame, t1: float = 0.20, p1: str = "p1", p2: str = "p2") -> DataFrame:
    """Final score of a cascade when both scores are known: p2 where p1 >= t1, else p1.
    A row without a p1 is not routed and has no final score."""
    routed = F.coalesce(F.col(p1) >= t1, F.lit(False))
    return df.withColumn("routed", routed).withColumn("p_hate", F.when(routed, F.col(p2)).otherwise(F.col(p1)))


def run_cascade(
    df: DataFrame,
    stage1: Callable[[DataFrame], DataFrame],
    stage2: Callable[[DataFrame], DataFrame],
    t1: float = 0.20,
    materialise: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Score with stage 1, and with stage 2 only what reaches ``t1``.

    Both callables take a frame and add ``p_hate``. An expression such as
    ``when(p1 >= t1, udf(x))`` would run the expensive scorer on every row, so the
    rows are filtered first and the two parts united afterwards. ``materialise``
    (a table in the shared folder) keeps stage 1 from running once per part. Every
    row of ``df`` comes back: one without a p1 is not routed and has no final score.
    """
    first = stage1(df).withColumnRenamed("p_hate", "p1")
    if materialise is not None:
        first = materialise(first)
    routed = F.coalesce(F.col("p1") >= t1, F.lit(False))
    bypass = first.filter(~routed).withColumns({"p2": F.lit(None).cast("double"), "p_hate": F.col("p1"), "routed": F.lit(False)})
    checked = stage2(first.filter(routed)).withColumns({"p2": F.col("p_hate"), "routed": F.lit(True)})
    return bypass.unionByName(checked)


def cascade_stats(df: DataFrame, by: list[str]) -> DataFrame:
    n, routed = F.count(F.lit(1)), F.count_if("routed")
    return df.groupBy(*by).agg(
        n.alias("n_total"), routed.alias("n_routed_stage2"), ratio(routed, n).alias("stage2_rate")
    )


def cascade_latency(l1: Column, l2: Column, rate: Column) -> Column:
    return l1 + rate * l2


def cascade_throughput(thr1: Column, thr2: Column, rate: Column) -> Column:
    """Samples per second when the stages run one after the other; infinite at no cost."""
    seconds = 1.0 / thr1 + rate / thr2
    return F.when(seconds > 0, F.try_divide(F.lit(1.0), seconds)).otherwise(F.lit(float("inf")))


def cascade_sweep(
    df: DataFrame,
    by: list[str],
    thresholds: list[float] | None = None,
    truth: str = "label",
    p1: str = "p1",
    p2: str = "p2",
    decision: float = 0.5,
) -> DataFrame:
    """Metrics, AUC and routed share of the cascade for every stage-1 threshold.

    A row contributes only two scores whatever the threshold: p1 below its
    routing point and p2 above it. So each row becomes two (not one per
    threshold), all are shuffled and sorted once, and the thresholds select from
    that one order: which of the two scores counts at threshold i follows from
    ``_k``, the number of thresholds that p1 reaches.
    """
    thresholds = CASCADE_THRESHOLDS if thresholds is None else thresholds
    k = sum((decide(F.col(p1), t) for t in thresholds[1:]), decide(F.col(p1), thresholds[0]))
    two = F.array(
        F.struct(F.lit(False).alias("_second"), F.col(p1).alias("_score")),
        F.struct(F.lit(True).alias("_second"), F.col(p2).alias("_score")),
    )
    long = df.select(*by, F.col(truth).alias("_t"), k.alias("_k"), F.inline(two))
    flagged = decide(F.col("_score"), decision)
    n = F.col("pos") + F.col("neg")
    sums = {
        "tp": F.col("pos") * flagged,
        "fp": F.col("neg") * flagged,
        "n_routed_stage2": F.when(F.col("_second"), n).otherwise(F.lit(0).cast("long")),
    }
    # Thresholds ascend, so a row is routed at the first _k of them.
    variants = {t: F.col("_second") == (F.col("_k") > i) for i, t in enumerate(thresholds)}
    totals = rank_sums(long, by, "_score", "_t", sums, ["_second", "_k"], variants)
    counts = totals.select(
        *by,
        F.col("_variant").alias("stage1_threshold"),
        n.alias("n_total"),
        "n_routed_stage2",
        ratio(F.col("n_routed_stage2"), n).alias("stage2_rate"),
        (F.col("neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("pos") - F.col("tp")).alias("fn"),
        "tp",
        auc().alias("roc_auc"),
    )
    return with_binary_metrics(counts).select(
        *by,
        "stage1_threshold",
        "n_total",
        "n_routed_stage2",
        "stage2_rate",
        "accuracy",
        F.col("f1_binary").alias("f1_hate"),
        "f1_macro",
        "roc_auc",
    )


def with_cascade_costs(sweep: DataFrame, by: list[str], costs: DataFrame) -> DataFrame:
    """Add latency and throughput; ``costs`` has by + l1, l2, thr1, thr2.

    Both sides are metric tables (runs x thresholds); AQE picks the join from
    their measured sizes.
    """
    c = sweep.join(costs, [*by])
    return c.withColumns(
        {
            "latency_ms_per_sample": cascade_latency(F.col("l1"), F.col("l2"), F.col("stage2_rate")),
            "throughput_samples_per_sec": cascade_throughput(F.col("thr1"), F.col("thr2"), F.col("stage2_rate")),
        }
    )


def operating_points(sweep: DataFrame, by: list[str], baseline: DataFrame) -> DataFrame:
    """Best-F1 and no-loss points per group; ``baseline`` has by + base_f1, base_thr.

    No-loss: F1 not below the baseline (within 1e-9), highest throughput. Ties go
    to the lowest threshold. Null where no point qualifies or no baseline exists.
    """
    low = -F.col("stage1_threshold")
    keep = F.col("f1_hate") >= F.col("base_f1") - NO_LOSS_TOLERANCE
    point = F.struct("stage1_threshold", "stage2_rate", "f1_hate", "throughput_samples_per_sec")
    best = F.max_by(point, F.struct(F.col("f1_hate"), low))
    no_loss = F.max_by(
        F.when(keep, point), F.when(keep, F.struct(F.col("throughput_samples_per_sec").alias("v"), low.alias("t")))
    )
    picked = (
        sweep.join(baseline, [*by], "left")
        .groupBy(*by)
        .agg(
            best.alias("best"),
            no_loss.alias("safe"),
            F.max("base_f1").alias("base_f1"),
            F.max("base_thr").alias("base_thr"),
        )
    )
    return picked.select(
        *by,
        F.col("best.stage1_threshold").alias("best_t1"),
        F.col("best.f1_hate").alias("best_f1"),
        F.col("best.throughput_samples_per_sec").alias("best_thr"),
        F.col("safe.stage1_threshold").alias("no_loss_t1"),
        F.col("safe.stage2_rate").alias("no_loss_rate"),
        F.col("safe.f1_hate").alias("no_loss_f1"),
        F.col("safe.throughput_samples_per_sec").alias("no_loss_thr"),
        (F.col("safe.throughput_samples_per_sec") / F.greatest(F.lit(1e-9), F.col("base_thr"))).alias("speed_up"),
        "base_f1",
        "base_thr",
    )
