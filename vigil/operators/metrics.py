"""Metrics of given scores and decisions, per group, in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import binary_metric_columns, count_where, decide, f1, printed, ratio
from vigil.operators.ranking import auc, rank_sums

METRICS = ["accuracy", "precision", "recall", "f1_binary", "f1_macro", "roc_auc"]


def confusion(df: DataFrame, by: list[str], truth: str = "label", pred: str = "pred") -> DataFrame:
    """by + tn, fp, fn, tp. Always four counts, also where one class is missing."""
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*by).agg(
        count_where((t == 0) & (p == 0)).alias("tn"),
        count_where((t == 0) & (p == 1)).alias("fp"),
        count_where((t == 1) & (p == 0)).alias("fn"),
        count_where((t == 1) & (p == 1)).alias("tp"),
    )


def with_binary_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1_binary and f1_macro to the four counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(binary_metric_columns(tn, fp, fn, tp))


def score_totals(
    df: DataFrame, by: list[str], truth: str = "label", score: str = "p_hate", threshold=0.5
) -> DataFrame:
    """by + tn, fp, fn, tp, roc_auc.

    Confusion and AUC come out of the same aggregate: the decision is a function
    of the score, so both are sums over the distinct scores.
    """
    df = df.withColumn(score, scored(F.col(score)))
    flagged = decide(F.col(score), threshold)
    sums = {"tp": F.col("pos") * flagged, "fp": F.col("neg") * flagged}
    return rank_sums(df, by, score, truth, sums).select(
        *by,
        (F.col("neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("pos") - F.col("tp")).alias("fn"),
        "tp",
        auc().alias("roc_auc"),
    )


def scored(score: Column) -> Column:
    """``score``; a row without one ends the job, as it is neither a hit nor a miss."""
    return F.coalesce(score, F.raise_error(F.lit("a row without a score cannot be evaluated")).cast("double"))


def evaluate(df: DataFrame, by: list[str], truth: str = "label", score: str = "p_hate", threshold=0.5) -> DataFrame:
    """Full binary record per group: four counts, five rates, ROC-AUC."""
    return with_binary_metrics(score_totals(df, by, truth, score, threshold))


def roc_auc(df: DataFrame, by: list[str], truth: str = "label", score: str = "p_hate") -> DataFrame:
    totals = rank_sums(df.withColumn(score, scored(F.col(score))), by, score, truth)
    return totals.select(*by, F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"), auc().alias("roc_auc"))


def _cells(df: DataFrame, by: list[str], truth: str, pred: str) -> tuple[DataFrame, DataFrame]:
    """Rows per (by, truth, pred), and per group: at most K * K rows of a group are left."""
    cells = df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return cells, cells.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_total"))


def confusion_matrix(df: DataFrame, by: list[str], truth: str, pred: str, classes: int) -> DataFrame:
    """Long K x K matrix per group with the empty cells.

    One aggregate counts the cells that occur; the empty ones are added to that small
    table, so the plan does not grow with K.
    """
    cells, groups = _cells(df, by, truth, pred)
    k = F.lit(classes)
    every = groups.select(*by, F.explode(F.sequence(F.lit(0), k * k - 1)).alias("_i"))
    empty = every.select(*by, F.floor(F.col("_i") / k).cast("int").alias("truth"), (F.col("_i") % k).alias("pred"), F.lit(0).cast("long").alias("n"))
    known = cells.filter(F.col("truth").between(0, classes - 1) & F.col("pred").between(0, classes - 1))
    both = empty.unionByName(known.withColumns({"truth": F.col("truth").cast("int"), "pred": F.col("pred").cast("int")}))
    return both.groupBy(*by, "truth", "pred").agg(F.sum("n").alias("n"))


def per_class(df: DataFrame, by: list[str], truth: str, pred: str, classes: int) -> DataFrame:
    """by + class, precision, recall, f1, support, predicted; all classes 0..K-1."""
    cells, groups = _cells(df, by, truth, pred)
    zero, n = F.lit(0).cast("long"), F.col("n")

    def part(label: str, tp: Column, support: Column, predicted: Column) -> Column:
        named = {"class": F.col(label).cast("int"), "tp": tp, "support": support, "predicted": predicted, "n_total": zero}
        return F.struct(*[c.alias(k) for k, c in named.items()])

    hit = F.when(F.col("truth") == F.col("pred"), n).otherwise(zero)
    sides = cells.select(*by, F.inline(F.array(part("truth", hit, n, zero), part("pred", zero, zero, n))))
    blank = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"), *[zero.alias(c) for c in ("tp", "support", "predicted")], "n_total")
    known = blank.unionByName(sides.filter(F.col("class").between(0, classes - 1)))
    wide = known.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")], F.max("n_total").alias("n_total"))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return wide.select(
        *by,
        "class",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        f1(tp, predicted - tp, support - tp).alias("f1"),
        "support",
        "predicted",
        "tp",
        "n_total",
    )


def multiclass_summary(classwise: DataFrame, by: list[str]) -> DataFrame:
    """by + accuracy, f1_macro, f1_weighted and the precision/recall averages.

    The macro mean is over classes that occur in truth or prediction, although
    the per-class rows cover all classes.
    """
    seen = (F.col("support") + F.col("predicted")) > 0

    def macro(c: str) -> Column:
        return F.coalesce(F.avg(F.when(seen, F.col(c))), F.lit(0.0))

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    return classwise.groupBy(*by).agg(
        ratio(F.sum("tp"), F.max("n_total")).alias("accuracy"),
        *[macro(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )


def report(classwise: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg, at 4 digits."""
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class") + 1)
    rows = classwise.select(
        *by, F.col("class").alias("ord"), label.alias("row"), "precision", "recall", "f1", "support"
    )
    s = multiclass_summary(classwise, by)
    k = len(names)
    spread = [
        F.struct(
            F.lit(k).alias("ord"),
            F.lit("accuracy").alias("row"),
            F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"),
            F.col("accuracy").alias("f1"),
            F.col("support").alias("support"),
        )
    ] + [
        F.struct(
            F.lit(k + i).alias("ord"),
            F.lit(f"{kind} avg").alias("row"),
            F.col(f"precision_{kind}").alias("precision"),
            F.col(f"recall_{kind}").alias("recall"),
            F.col(f"f1_{kind}").alias("f1"),
            F.col("support").alias("support"),
        )
        for i, kind in enumerate(["macro", "weighted"], 1)
    ]
    tail = s.select(*by, F.inline(F.array(*spread)))
    out = rows.unionByName(tail)
    shown = {c: F.when(F.col(c).isNotNull(), printed(F.col(c), 4)) for c in ("precision", "recall", "f1")}
    return out.withColumns(shown)


def group_audit(df: DataFrame, group: str, order: list[str], truth: str = "label", pred: str = "pred") -> DataFrame:
    """Support, flag rate, recall and F1 per group plus an Overall row.

    ``rollup`` yields both levels from one aggregate with map-side combining, so
    a group that holds most rows is no hot spot. Groups without rows do not
    appear; groups without positives have null recall and F1.
    """
    t, p = F.col(truth), F.col(pred)
    sums = df.rollup(group).agg(
        F.grouping(group).alias("_overall"),
        F.count(F.lit(1)).alias("n"),
        count_where(t == 1).alias("n_hate"),
        count_where(p == 1).alias("n_flagged"),
        count_where((t == 1) & (p == 1)).alias("_tp"),
    )
    tp, n, n_hate, n_flagged = (F.col(c) for c in ("_tp", "n", "n_hate", "n_flagged"))
    fp, fn = n_flagged - tp, n_hate - tp
    tn = n - n_hate - fp
    m = binary_metric_columns(tn, fp, fn, tp)
    has_hate = n_hate > 0
    name = F.when(F.col("_overall") == 1, F.lit("Overall")).otherwise(F.col(group))
    position = F.array_position(F.array(*[F.lit(g) for g in order]), F.col(group))
    return sums.select(
        F.when(F.col("_overall") == 1, 0).otherwise(position).cast("int").alias("ord"),
        name.alias("group"),
        "n",
        "n_hate",
        ratio(n_hate, n).alias("hate_pct"),
        "n_flagged",
        ratio(n_flagged, n).alias("flagged_pct"),
        F.when(has_hate, m["recall"]).alias("recall_hate"),
        F.when(has_hate, m["f1_binary"]).alias("f1_hate"),
        m["f1_macro"].alias("f1_macro"),
    )


def recall_gap(audit: DataFrame) -> DataFrame:
    """Best minus worst group recall; ties go to the group that is listed first."""
    g = audit.filter((F.col("group") != "Overall") & F.col("recall_hate").isNotNull())
    return g.agg(
        F.max_by("group", F.struct("recall_hate", -F.col("ord"))).alias("best_group"),
        F.min_by("group", F.struct("recall_hate", "ord")).alias("worst_group"),
        F.max("recall_hate").alias("best_recall"),
        F.min("recall_hate").alias("worst_recall"),
        (F.max("recall_hate") - F.min("recall_hate")).alias("recall_gap"),
    )


def seed_summary(runs: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Mean and sample deviation of each metric over the runs of a group.

    A metric that is null in a run is left out; one run alone has deviation 0.
    """
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = runs.select(*by, F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    return long.groupBy(*by, "metric").agg(
        F.count("value").alias("n_runs"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
    )


def prior(df: DataFrame, by: list[str], truth: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(truth).alias("hate_share"))


def split_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))


