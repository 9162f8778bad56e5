"""Metrics, sweeps and rankings against golden numbers and brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vigil.functions.numeric import printed
from vigil.operators import metrics as M
from vigil.operators import ranking as R
from vigil.operators import sweeps as S
from vigil.operators import timing as L


def close(a, b, tol=1e-9):
    return a is not None and abs(a - b) <= tol


def from_counts(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_golden_confusions(spark):
    r = M.with_binary_metrics(from_counts(spark, 2162, 174, 63, 80)).first()
    want = (0.9043969342476805, 0.31496062992125984, 0.5594405594405595, 0.40302267002518893, 0.6755301905267361)
    assert all(close(a, b) for a, b in zip((r.accuracy, r.precision, r.recall, r.f1_binary, r.f1_macro), want))
    r = M.with_binary_metrics(from_counts(spark, 2231, 105, 75, 68)).first()
    assert close(r.f1_binary, 0.43037974683544306) and close(r.f1_macro, 0.6958016786740765)


def test_perfect_wrong_and_single_class(spark):
    df = spark.createDataFrame(
        [("perfect", 0, 0.1), ("perfect", 1, 0.9), ("perfect", 0, 0.2), ("perfect", 1, 0.8),
         ("wrong", 0, 0.9), ("wrong", 1, 0.1), ("one", 0, 0.1), ("one", 0, 0.7)],
        "g string, label int, p double",
    )
    out = {r.g: r for r in M.evaluate(df, ["g"], "label", "p").collect()}
    assert out["perfect"].accuracy == 1.0 and out["perfect"].f1_binary == 1.0 and out["perfect"].roc_auc == 1.0
    assert out["wrong"].accuracy == 0.0 and out["wrong"].roc_auc == 0.0
    assert out["one"].roc_auc is None and out["one"].precision == 0.0
    assert (out["one"].tn, out["one"].fp, out["one"].fn, out["one"].tp) == (1, 1, 0, 0)


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_one_score_on_a_third_of_the_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.35 else round(rng.random(), 2)) for _ in range(900)]
    df = spark.createDataFrame(rows, "label int, p double").repartition(7)
    got = M.roc_auc(df, [], "label", "p").first()
    assert close(got.roc_auc, brute_auc(rows))
    assert got.n_pos == sum(y for y, _ in rows)


def test_group_audit_golden_row(spark):
    # n 544, 286 hate, 301 flagged, recall 0.842657: tp 241, fn 45, fp 60, tn 198.
    rows = [("Race", 1, 1)] * 241 + [("Race", 1, 0)] * 45 + [("Race", 0, 1)] * 60 + [("Race", 0, 0)] * 198
    rows += [("None", 0, 0)] * 3
    df = spark.createDataFrame(rows, "g string, label int, pred int")
    out = {r.group: r for r in M.group_audit(df, "g", ["Race", "Religion", "None"]).collect()}
    race = out["Race"]
    assert (race.n, race.n_hate, race.n_flagged, race.ord) == (544, 286, 301, 1)
    assert close(race.recall_hate, 0.8426573426573427) and close(race.f1_hate, 0.8211243611584327)
    assert close(race.f1_macro, 0.8057717614175397)
    assert out["None"].recall_hate is None and out["None"].f1_hate is None and out["None"].ord == 3
    assert out["Overall"].n == 547 and out["Overall"].ord == 0 and "Religion" not in out


def test_multiclass_covers_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, p int")
    rows = {r["class"]: r for r in M.per_class(df, [], "t", "p", 3).collect()}
    assert rows[2].support == 0 and rows[2].f1 == 0.0
    s = M.multiclass_summary(M.per_class(df.withColumn("k", F.lit(1)), ["k"], "t", "p", 3), ["k"]).first()
    # Class 2 occurs nowhere, so the macro mean is over two classes.
    assert close(s.f1_macro, (2 / 3 + 0.8) / 2) and s.accuracy == 0.75


def test_seed_summary(spark):
    df = spark.createDataFrame([("a", 0.40, 0.9), ("a", 0.41, None), ("b", 0.5, None)], "m string, f1 double, auc double")
    out = {(r.m, r.metric): r for r in M.seed_summary(df, ["m"], ["f1", "auc"]).collect()}
    assert close(out["a", "f1"].std, statistics.stdev([0.40, 0.41])) and out["b", "f1"].std == 0.0
    assert out["a", "auc"].n_runs == 1 and ("b", "auc") not in out


# ------------------------------------------------------------------- sweeps
def test_grid_equals_plain_comparison(spark):
    grid = S.linear_grid()
    assert len(grid) == 91 and grid[-1] == 0.95
    values = grid + [g + 1e-16 for g in grid] + [g - 1e-16 for g in grid] + [0.0, 1.0, 0.049, 0.96]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = [tuple(r) for r in df.select("p", S.grid_index(F.col("p"), grid)).collect()]
    assert all(k == sum(p >= t for t in grid) for p, k in got)


def test_threshold_curve_and_best(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, p double")
    curve = S.threshold_curve(df, [], None, "label", "p").collect()
    assert len(curve) == 91
    for r in curve:
        tp = sum(y for y, p in rows if p >= r.threshold)
        fp = sum(1 - y for y, p in rows if p >= r.threshold)
        assert (r.tp, r.fp) == (tp, fp)
    flat = spark.createDataFrame([(1, 0.99), (0, 0.01)], "label int, p double").withColumn("g", F.lit(1))
    best = S.best_threshold(S.threshold_curve(flat, ["g"], None, "label", "p"), ["g"]).first()
    assert close(best.best_threshold, 0.05) and best.best_f1_hate == 1.0


def test_cascade_routing(spark):
    df = spark.createDataFrame([("a", 0.05), ("b", 0.60), ("c", 0.90), ("d", 0.30)], "doc_id string, x double")
    seen = spark.sparkContext.accumulator(0)

    def expensive(rows):
        for r in rows:
            seen.add(1)
            yield (r.doc_id, r.x, r.p1, 0.99)

    first = lambda d: d.withColumn("p_hate", F.col("x"))
    second = lambda d: d.rdd.mapPartitions(expensive).toDF("doc_id string, x double, p1 double, p_hate double")
    out = S.run_cascade(df, first, second, 0.30).select("doc_id", "p_hate", "routed").collect()
    assert {r.doc_id: (r.p_hate, r.routed) for r in out} == {
        "a": (0.05, False), "b": (0.99, True), "c": (0.99, True), "d": (0.99, True)
    }
    assert seen.value == 3
    none = S.run_cascade(df, first, second, 0.95).collect()
    assert sorted(r.p_hate for r in none) == [0.05, 0.30, 0.60, 0.90]


def test_cascade_keeps_rows_without_a_score(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.9)], "doc_id string, x double")
    second = lambda d: d.withColumn("p_hate", F.lit(None).cast("double"))
    out = S.run_cascade(df, lambda d: d.withColumn("p_hate", F.col("x")), second, 0.5).collect()
    assert {r.doc_id: (r.p1, r.p_hate, r.routed) for r in out} == {"a": (0.1, 0.1, False), "b": (None, None, False), "c": (0.9, None, True)}
    known = S.cascade_scores(df.select("doc_id", F.col("x").alias("p1"), F.lit(0.7).alias("p2")), 0.5).collect()
    assert {r.doc_id: (r.p_hate, r.routed) for r in known} == {"a": (0.1, False), "b": (None, False), "c": (0.7, True)}


def test_a_missing_score_is_not_a_negative(spark):
    df = spark.createDataFrame([(1, 0.9), (0, None)], "label int, p_hate double")
    for measure in (M.evaluate, M.roc_auc):
        with pytest.raises(Exception, match="without a score"):
            measure(df, []).collect()


def test_cascade_cost_golden(spark):
    row = spark.range(1).select(
        S.cascade_latency(F.lit(0.3497705183690414), F.lit(19.92972902371548), F.lit(0.9302137958854376)).alias("ms"),
        S.cascade_throughput(F.lit(39183.01810307566), F.lit(303.87181309918185), F.lit(0.9302137958854376)).alias("thr"),
    )
    r = row.first()
    assert close(r.ms, 18.888679404487597) and close(r.thr, 323.9678679695002, 1e-6)
    half = spark.range(1).select(S.cascade_latency(F.lit(1.0), F.lit(10.0), F.lit(0.5)).alias("ms")).first()
    assert close(half.ms, 6.0)


def test_cascade_sweep_brute_force(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1), round(rng.random(), 1)) for _ in range(250)]
    df = spark.createDataFrame(rows, "label int, p1 double, p2 double")
    out = S.cascade_sweep(df, []).collect()
    assert [r.stage1_threshold for r in sorted(out, key=lambda r: r.stage1_threshold)] == S.CASCADE_THRESHOLDS
    for r in out:
        final = [(y, b if a >= r.stage1_threshold else a) for y, a, b in rows]
        assert r.n_routed_stage2 == sum(a >= r.stage1_threshold for _, a, _ in rows)
        assert close(r.roc_auc, brute_auc(final))
        assert close(r.accuracy, sum((p >= 0.5) == (y == 1) for y, p in final) / len(rows))


def test_operating_points_ties_and_absence(spark):
    sweep = spark.createDataFrame(
        [("d", 0.05, 0.9, 0.5, 100.0), ("d", 0.1, 0.8, 0.5, 200.0), ("d", 0.2, 0.7, 0.4, 900.0), ("e", 0.05, 0.9, 0.1, 5.0)],
        "dataset string, stage1_threshold double, stage2_rate double, f1_hate double, throughput_samples_per_sec double",
    )
    base = spark.createDataFrame([("d", 0.5, 50.0), ("e", 0.9, 50.0)], "dataset string, base_f1 double, base_thr double")
    out = {r.dataset: r for r in S.operating_points(sweep, ["dataset"], base).collect()}
    assert out["d"].best_t1 == 0.05 and out["d"].no_loss_t1 == 0.1 and close(out["d"].speed_up, 4.0)
    assert out["e"].no_loss_t1 is None and out["e"].best_t1 == 0.05


# ------------------------------------------------------------------ ranking
def test_sum_before_over_wide_keys(spark):
    rng = random.Random(8)
    keys = rng.sample(range(-(2**40), 2**62), 300) + list(range(200)) + [65535, 65536, 2**32, 2**48]
    rows = [(k, rng.randint(1, 9)) for k in set(keys)]
    df = spark.createDataFrame(rows, "seq long, v long").repartition(5)
    got = {r.seq: r.total for r in R.sum_before(df, "seq", "v", "total").collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 21, 100, 333])
def test_latency_summary_matches_exclusive_rule(spark, n):
    rng = random.Random(n)
    ms = [rng.choice([1.5, 2.0, rng.random() * 50]) for _ in range(n)]
    df = spark.createDataFrame([("r", v) for v in ms], "run string, ms double")
    r = L.latency_summary(df).first()
    assert close(r.latency_ms_median, statistics.median(ms))
    low = statistics.quantiles(ms, n=20)[0] if n >= 20 else min(ms)
    high = statistics.quantiles(ms, n=20)[-1] if n >= 20 else max(ms)
    assert close(r.latency_ms_p05, low) and close(r.latency_ms_p95, high)


def test_latency_leaves_out_what_is_no_timing(spark):
    ms = [float(i) for i in range(1, 31)]
    df = spark.createDataFrame([("r", v) for v in [*ms, float("nan"), None]], "run string, ms double")
    r = L.latency_summary(df).first()
    assert r.n == 30 and close(r.latency_ms_median, statistics.median(ms)) and close(r.latency_ms_p95, statistics.quantiles(ms, n=20)[-1])


def test_throughput_windows_hold_the_counted_rows_only(spark):
    rows = [("hot", i, 1.0 + (i >= 3200)) for i in range(20_000)] + [("small", i, 4.0) for i in range(40)]
    df = spark.createDataFrame(rows, "run string, seq long, ms double").repartition(5)
    out = {r.run: (r.n_samples, round(r.throughput_samples_per_sec, 6)) for r in L.throughput(df, batch_size=32, n_iters=3200).collect()}
    assert out == {"hot": (3200, 1000.0), "small": (32, 250.0)}
    plan = L.throughput(df, batch_size=32, n_iters=3200)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("row_number") :]
    assert "_last" in below


def test_throughput_drops_the_ragged_tail(spark):
    df = spark.createDataFrame([("r", i, 2.0) for i in range(70)], "run string, seq long, ms double")
    r = L.throughput(df, batch_size=32, n_iters=200).first()
    assert r.n_samples == 64 and r.n_batches == 2 and close(r.throughput_samples_per_sec, 500.0)
    assert L.throughput(df.limit(10), batch_size=32).count() == 0


def test_printed_equals_python_formatting(spark):
    rng = random.Random(9)
    values = [0.15625, 35.825, 0.125, 0.00005, 0.12345, 0.5, 2.675, 1.005, -0.15625, -1e-17, 0.0, 99.95, 1 / 3]
    values += [round(rng.random() * 100, 5) for _ in range(500)] + [rng.randint(0, 4096) / 4096 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (1, 2, 3, 4):
        got = df.select("v", printed(F.col("v"), n).alias("s")).collect()
        assert [(r.v, r.s) for r in got] == [(r.v, f"{r.v:.{n}f}") for r in got]
