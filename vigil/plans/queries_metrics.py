"""Registered queries: metrics, audits, sweeps, cascades, robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import decide
from vigil.functions.obfuscate import (
    CONSONANTS,
    LEET_FROM,
    LEET_TO,
    MASKS,
    RATES,
    RULES,
    VOWELS,
    obfuscate_text,
)
from vigil.functions.hashing import hex_below
from vigil.functions.text import clean_text
from vigil.operators import metrics as M
from vigil.operators import timing as L
from vigil.operators import report as P
from vigil.operators import robustness as B
from vigil.operators import sweeps as S
from vigil.plans import sql as Q
from vigil.plans import tables as T
from vigil.plans.queries_responses import LATENCY_SQL, THROUGHPUT_SQL
from vigil.plans.queries_corpus import RUN_METRICS, run_metrics
from vigil.plans.queries_text import clean_sql
from vigil.plans.registry import query
from vigil.plans.rounding import rounded

SC = T.SCORED


# ------------------------------------------------------------------- metrics
@query(
    "met_confusion",
    f"WITH {SC} SELECT dataset, split, {Q.counts('label', '(p1 >= 0.5)::INTEGER')} FROM scored GROUP BY ALL",
)
def met_confusion(spark, sf_dir):
    s = T.scored(spark, sf_dir).withColumn("pred", decide(F.col("p1")))
    return M.confusion(s, ["dataset", "split"])


@query(
    "met_binary",
    f"WITH {SC}, {Q.evaluated('e', 'scored', ['dataset', 'split'], 'label', 'p1')} SELECT dataset, split, tn, fp, fn, tp, {Q.rounded(Q.RATES)} FROM e",
)
def met_binary(spark, sf_dir):
    return rounded(M.evaluate(T.scored(spark, sf_dir), ["dataset", "split"], "label", "p1"))


@query(
    "met_roc_auc",
    f"""WITH {SC}, {Q.auc_table('a', 'scored', ['source'], 'label', 'p1')}
        SELECT s.source, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round(any_value(roc_auc), 9) AS roc_auc
        FROM scored s JOIN a USING (source) GROUP BY s.source""",
)
def met_roc_auc(spark, sf_dir):
    """Per source; sources without a toxic comment have no AUC."""
    return rounded(M.roc_auc(T.scored(spark, sf_dir), ["source"], "label", "p1"))


@query(
    "win_auc_prefix",
    f"""WITH {SC}, d AS (SELECT p1, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY p1),
        w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
        SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
               round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) AS roc_auc FROM w""",
)
def win_auc_prefix(spark, sf_dir):
    """One group over all rows: the case that would sort on one task without slices."""
    return rounded(M.roc_auc(T.scored(spark, sf_dir), [], "label", "p1"))


def _three(spark, sf_dir):
    """label3 with a prediction that follows the truth for most rows."""
    s = T.scored(spark, sf_dir)
    off = (F.col("label3") + F.when(F.col("p2") > 0.35, 0).otherwise(1 + F.col("doc_id") % 2)) % 3
    return s.select("doc_id", "dataset", "label3", off.cast("int").alias("pred3"))


_THREE = f"""{SC}, three AS (
  SELECT doc_id, dataset, label3,
         ((label3 + CASE WHEN p2 > 0.35 THEN 0 ELSE 1 + doc_id % 2 END) % 3)::INTEGER AS pred3 FROM scored)"""


def _classwise_sql(name: str, source: str, by: list[str], classes: int = 3) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"""{name} AS (
  SELECT {keys}k::INTEGER AS class, count(*) FILTER (label3 = k AND pred3 = k) AS tp,
         count(*) FILTER (label3 = k) AS support, count(*) FILTER (pred3 = k) AS predicted, count(*) AS n_total,
         {Q.div('count(*) FILTER (label3 = k AND pred3 = k)', 'count(*) FILTER (pred3 = k)')} AS precision,
         {Q.div('count(*) FILTER (label3 = k AND pred3 = k)', 'count(*) FILTER (label3 = k)')} AS recall,
         {Q.div('2 * count(*) FILTER (label3 = k AND pred3 = k)', 'count(*) FILTER (label3 = k) + count(*) FILTER (pred3 = k)')} AS f1
  FROM {source}, range({classes}) g(k) GROUP BY {keys}k)"""


def _summary_sql(name: str, source: str, by: list[str]) -> str:
    keys = "".join(f"{b}, " for b in by)
    seen = "FILTER (support + predicted > 0)"
    parts = ", ".join(
        f"coalesce(avg({c}) {seen}, 0.0) AS {c}_macro, {Q.div(f'sum({c} * support)', 'sum(support)')} AS {c}_weighted"
        for c in ("precision", "recall", "f1")
    )
    return f"""{name} AS (
  SELECT {keys}{Q.div('sum(tp)', 'max(n_total)')} AS accuracy, {parts}, sum(support)::BIGINT AS support
  FROM {source} GROUP BY {', '.join(by)})"""


@query(
    "met_multiclass",
    f"""WITH {_THREE}, {_classwise_sql('c', 'three', ['dataset'])}, {_summary_sql('s', 'c', ['dataset'])}
        SELECT c.dataset, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
               c.support, {Q.rounded(['accuracy', 'f1_macro', 'f1_weighted'])}
        FROM c JOIN s ON c.dataset = s.dataset""",
)
def met_multiclass(spark, sf_dir):
    c = M.per_class(_three(spark, sf_dir), ["dataset"], "label3", "pred3", 3)
    s = M.multiclass_summary(c, ["dataset"]).select("dataset", "accuracy", "f1_macro", "f1_weighted")
    rows = c.select("dataset", "class", "precision", "recall", "f1", "support")
    return rounded(rows.join(s, "dataset"))


@query(
    "met_confusion_kxk",
    f"""WITH {_THREE} SELECT dataset, i::INTEGER AS truth, j::INTEGER AS pred,
          count(*) FILTER (label3 = i AND pred3 = j) AS n
        FROM three, range(4) a(i), range(4) b(j) GROUP BY dataset, i, j""",
)
def met_confusion_kxk(spark, sf_dir):
    """Four classes, the last of which never occurs: its cells are zero."""
    return M.confusion_matrix(_three(spark, sf_dir), ["dataset"], "label3", "pred3", 4)


@query(
    "met_report",
    f"""WITH {_THREE}, {_classwise_sql('c', 'three', ['dataset'])}, {_summary_sql('s', 'c', ['dataset'])}
        SELECT dataset, class AS ord, ['hate', 'offensive', 'neither/normal'][class + 1] AS row, printf('%.4f', precision) AS precision,
               printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1, support FROM c
        UNION ALL SELECT dataset, 3, 'accuracy', NULL, NULL, printf('%.4f', accuracy), support FROM s
        UNION ALL SELECT dataset, 4, 'macro avg', printf('%.4f', precision_macro), printf('%.4f', recall_macro), printf('%.4f', f1_macro), support FROM s
        UNION ALL SELECT dataset, 5, 'weighted avg', printf('%.4f', precision_weighted), printf('%.4f', recall_weighted), printf('%.4f', f1_weighted), support FROM s""",
)
def met_report(spark, sf_dir):
    from vigil.operators.corpus import CLASS_NAMES

    c = M.per_class(_three(spark, sf_dir), ["dataset"], "label3", "pred3", 3)
    return M.report(c, ["dataset"], CLASS_NAMES)


@query("met_prior", f"WITH {T.CORPUS} SELECT dataset, count(*) AS n, round(avg(label), 9) AS hate_share FROM corpus GROUP BY dataset")
def met_prior(spark, sf_dir):
    return rounded(M.prior(T.corpus(spark, sf_dir), ["dataset"]))


@query("met_split_counts", f"WITH {SC} SELECT dataset, split, count(*) AS n FROM scored GROUP BY ALL")
def met_split_counts(spark, sf_dir):
    return M.split_counts(T.scored(spark, sf_dir), ["dataset"])


# -------------------------------------------------------------------- audits
def audit_sql(name: str, source: str, group: str, order: list[str]) -> str:
    listed = ", ".join(f"'{g}'" for g in order)
    m = Q.metric_columns()
    return f"""{name}_raw AS (
  SELECT {group} AS g, grouping({group}) AS all_rows, count(*) AS n, {Q.counts('label', 'pred')}
  FROM {source} GROUP BY GROUPING SETS ((), ({group}))),
{name} AS (
  SELECT CASE WHEN all_rows = 1 THEN 0 ELSE list_position([{listed}], g) END::INTEGER AS ord,
         CASE WHEN all_rows = 1 THEN 'Overall' ELSE g END AS "group", n, tp + fn AS n_hate,
         {Q.div('tp + fn', 'n')} AS hate_pct, tp + fp AS n_flagged, {Q.div('tp + fp', 'n')} AS flagged_pct,
         CASE WHEN tp + fn > 0 THEN {m['recall']} END AS recall_hate,
         CASE WHEN tp + fn > 0 THEN {m['f1_binary']} END AS f1_hate, {m['f1_macro']} AS f1_macro
  FROM {name}_raw)"""


AUDITED = f"{SC}, preds AS (SELECT *, (p1 >= 0.5)::INTEGER AS pred FROM scored), {audit_sql('audit', 'preds', 'lang', T.LANGUAGES)}"
_AUDIT_RATES = ["hate_pct", "flagged_pct", "recall_hate", "f1_hate", "f1_macro"]


def audit(spark, sf_dir):
    s = T.scored(spark, sf_dir).withColumn("pred", decide(F.col("p1")))
    return M.group_audit(s, "lang", T.LANGUAGES)


@query(
    "agg_target_group_audit",
    f'WITH {AUDITED} SELECT ord, "group", n, n_hate, n_flagged, {Q.rounded(_AUDIT_RATES)} FROM audit',
)
def agg_target_group_audit(spark, sf_dir):
    return rounded(audit(spark, sf_dir))


@query(
    "agg_group_gap",
    f"""WITH {AUDITED}, g AS (SELECT * FROM audit WHERE "group" <> 'Overall' AND recall_hate IS NOT NULL)
        SELECT (SELECT "group" FROM g ORDER BY recall_hate DESC, ord LIMIT 1) AS best_group,
               (SELECT "group" FROM g ORDER BY recall_hate, ord LIMIT 1) AS worst_group,
               round(max(recall_hate), 9) AS best_recall, round(min(recall_hate), 9) AS worst_recall,
               round(max(recall_hate) - min(recall_hate), 9) AS recall_gap FROM g""",
)
def agg_group_gap(spark, sf_dir):
    return rounded(M.recall_gap(audit(spark, sf_dir)))


@query("ord_groups", f'WITH {AUDITED} SELECT ord, "group" FROM audit ORDER BY ord')
def ord_groups(spark, sf_dir):
    return audit(spark, sf_dir).select("ord", "group").orderBy("ord")


_SEED_LONG = " UNION ALL ".join(
    f"SELECT model, dataset, '{m}' AS metric, {m}::DOUBLE AS value FROM runs" for m in Q.RATES
)
SEEDS = f"""{RUN_METRICS}, long AS ({_SEED_LONG}),
summary AS (SELECT model, dataset, metric, count(value) AS n_runs, avg(value) AS mean,
            coalesce(stddev_samp(value), 0.0) AS std FROM long WHERE value IS NOT NULL GROUP BY ALL)"""


@query("agg_seeds", f"WITH {SEEDS} SELECT model, dataset, metric, n_runs, {Q.rounded(['mean', 'std'])} FROM summary")
def agg_seeds(spark, sf_dir):
    return rounded(M.seed_summary(run_metrics(spark, sf_dir), ["model", "dataset"]))


# -------------------------------------------------------------------- sweeps
_GRID = ", ".join(f"{t!r}::DOUBLE" for t in S.linear_grid())
_MET = Q.metric_columns()


def curve_sql(name: str, source: str, by: list[str], score: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"""{name}_counts AS (
  SELECT {keys}g.i AS idx, g.t AS threshold, {Q.counts('label', f'({score} >= g.t)::INTEGER')}
  FROM {source}, (SELECT unnest([{_GRID}]) AS t, (unnest(range(91)))::INTEGER AS i) g GROUP BY {keys}g.i, g.t),
{name} AS (SELECT {keys}idx, threshold, tn, fp, fn, tp, {_MET['f1_binary']} AS f1_hate, {_MET['f1_macro']} AS f1_macro FROM {name}_counts)"""


_CURVE = f"{SC}, {curve_sql('curve', 'scored', ['dataset'], 'p1')}"


@query(
    "grid_thresholds",
    f"WITH {_CURVE} SELECT dataset, idx, round(threshold, 12) AS threshold, tp, fp FROM curve",
)
def grid_thresholds(spark, sf_dir):
    c = S.threshold_curve(T.scored(spark, sf_dir), ["dataset"], None, "label", "p1")
    return c.select("dataset", "idx", F.round("threshold", 12).alias("threshold"), "tp", "fp")


@query(
    "exp_threshold_curve",
    f"WITH {_CURVE} SELECT dataset, idx, tn, fp, fn, tp, {Q.rounded(['threshold', 'f1_hate', 'f1_macro'])} FROM curve",
)
def exp_threshold_curve(spark, sf_dir):
    return rounded(S.threshold_curve(T.scored(spark, sf_dir), ["dataset"], None, "label", "p1"))


@query(
    "top_best_threshold",
    f"WITH {_CURVE} SELECT dataset, round(threshold, 9) AS best_threshold, round(f1_hate, 9) AS best_f1_hate FROM curve QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(f1_hate, 12) DESC, threshold) = 1",
)
def top_best_threshold(spark, sf_dir):
    c = S.threshold_curve(T.scored(spark, sf_dir), ["dataset"], None, "label", "p1")
    return rounded(S.best_threshold(c, ["dataset"]))


TUNED = f"""{SC}, vals AS (SELECT * FROM scored WHERE split = 'val'), tests AS (SELECT * FROM scored WHERE split = 'test'),
{curve_sql('vc', 'vals', ['dataset'], 'p1')}, {curve_sql('tc', 'tests', ['dataset'], 'p1')},
chosen AS (SELECT dataset, threshold AS best_threshold, f1_hate AS best_f1_hate FROM vc
           QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(f1_hate, 12) DESC, threshold) = 1),
{Q.evaluated('base', 'tests', ['dataset'], 'label', 'p1')},
tuned AS (SELECT c.dataset, best_threshold, best_f1_hate, tc.f1_hate AS f1_hate_tuned, tc.f1_macro AS f1_macro_tuned,
          b.f1_binary AS f1_hate_default, b.f1_macro AS f1_macro_default, b.roc_auc,
          tc.f1_hate - b.f1_binary AS delta_f1_hate, tc.f1_macro - b.f1_macro AS delta_f1_macro
          FROM chosen c JOIN tc ON c.dataset = tc.dataset AND c.best_threshold = tc.threshold
          JOIN base b ON b.dataset = c.dataset)"""
_TUNED_COLS = [
    "best_threshold", "best_f1_hate", "f1_hate_tuned", "f1_macro_tuned", "f1_hate_default",
    "f1_macro_default", "roc_auc", "delta_f1_hate", "delta_f1_macro",
]


@query("exp_threshold_tune", f"WITH {TUNED} SELECT dataset, {Q.rounded(_TUNED_COLS)} FROM tuned")
def exp_threshold_tune(spark, sf_dir):
    return rounded(S.tune_threshold(T.scored(spark, sf_dir), ["dataset"], "label", "p1"))


# ------------------------------------------------------------------- cascade
@query(
    "exp_cascade",
    f"WITH {SC} SELECT doc_id, label, p1 >= 0.2::DOUBLE AS routed, CASE WHEN p1 >= 0.2::DOUBLE THEN p2 ELSE p1 END AS p_hate, ((CASE WHEN p1 >= 0.2::DOUBLE THEN p2 ELSE p1 END) >= 0.5)::INTEGER AS pred FROM scored",
)
def exp_cascade(spark, sf_dir):
    c = S.cascade_scores(T.scored(spark, sf_dir), 0.20)
    return c.select("doc_id", "label", "routed", "p_hate", decide(F.col("p_hate")).alias("pred"))


_STATS = f"""{SC}, stats AS (
  SELECT dataset, count(*) AS n_total, count(*) FILTER (p1 >= 0.2::DOUBLE) AS n_routed_stage2,
         {Q.div('count(*) FILTER (p1 >= 0.2::DOUBLE)', 'count(*)')} AS stage2_rate
  FROM scored GROUP BY dataset)"""


def _stats(spark, sf_dir):
    return S.cascade_stats(S.cascade_scores(T.scored(spark, sf_dir), 0.20), ["dataset"])


@query("exp_cascade_stats", f"WITH {_STATS} SELECT dataset, n_total, n_routed_stage2, round(stage2_rate, 9) AS stage2_rate FROM stats")
def exp_cascade_stats(spark, sf_dir):
    return rounded(_stats(spark, sf_dir))


# Whose timings stand for the stages of a corpus' cascade: run, dataset, stage.
STAGE_RUNS = [("click", "A", 1), ("view", "A", 2), ("error", "B", 1), ("purchase", "B", 2)]
COST_COLS = ["l1", "l2", "thr1", "thr2"]
_COSTS = f"""{LATENCY_SQL}, {THROUGHPUT_SQL.removeprefix(T.TIMINGS + ', ')},
costs AS (SELECT dataset, {', '.join(f"max({c}) FILTER (stage = {k}) AS {n}{k}" for n, c in (('l', 'latency_ms_median'), ('thr', 'throughput_samples_per_sec')) for k in (1, 2))}
  FROM latency JOIN speed USING (run) JOIN (VALUES {', '.join(f"('{r}', '{d}', {k})" for r, d, k in STAGE_RUNS)}) v(run, dataset, stage) USING (run) GROUP BY dataset)"""
_SECONDS = "(1.0::DOUBLE / thr1 + stage2_rate / thr2)"


def costs(spark, sf_dir):
    """dataset, l1, l2, thr1, thr2: stage costs measured on the timings table."""
    timings = T.timings(spark, sf_dir)
    measured = L.latency_summary(timings).select("run", "latency_ms_median").join(L.throughput(timings).select("run", "throughput_samples_per_sec"), "run")
    role = F.lit(None)
    for run, dataset, stage in STAGE_RUNS:
        role = F.when(F.col("run") == run, F.struct(F.lit(dataset).alias("dataset"), F.lit(stage).alias("stage"))).otherwise(role)
    named = measured.withColumn("role", role).filter("role is not null").select("role.*", "latency_ms_median", "throughput_samples_per_sec")
    pick = [F.max(F.when(F.col("stage") == k, F.col(c))).alias(f"{n}{k}") for n, c in (("l", "latency_ms_median"), ("thr", "throughput_samples_per_sec")) for k in (1, 2)]
    return named.groupBy("dataset").agg(*pick)


@query("exp_cascade_latency", f"WITH {_STATS}, {_COSTS} SELECT dataset, round(l1 + stage2_rate * l2, 9) AS latency_ms FROM stats JOIN costs USING (dataset)")
def exp_cascade_latency(spark, sf_dir):
    s = _stats(spark, sf_dir).join(costs(spark, sf_dir), "dataset")
    ms = S.cascade_latency(F.col("l1"), F.col("l2"), F.col("stage2_rate"))
    return rounded(s.select("dataset", ms.alias("latency_ms")))


@query("exp_cascade_throughput", f"WITH {_STATS}, {_COSTS} SELECT dataset, round(1.0::DOUBLE / {_SECONDS}, 6) AS samples_per_sec FROM stats JOIN costs USING (dataset)")
def exp_cascade_throughput(spark, sf_dir):
    s = _stats(spark, sf_dir).join(costs(spark, sf_dir), "dataset")
    thr = S.cascade_throughput(F.col("thr1"), F.col("thr2"), F.col("stage2_rate"))
    return rounded(s.select("dataset", thr.alias("samples_per_sec")), 6)


_T1 = ", ".join(f"{t}::DOUBLE" for t in S.CASCADE_THRESHOLDS)
SWEPT = f"""{SC}, {_COSTS}, routed AS (
  SELECT dataset, label, t1 AS stage1_threshold, p1 >= t1 AS routed, CASE WHEN p1 >= t1 THEN p2 ELSE p1 END AS p
  FROM scored, (SELECT unnest([{_T1}]) AS t1)),
{Q.evaluated('e', 'routed', ['dataset', 'stage1_threshold'], 'label', 'p')},
rates AS (SELECT dataset, stage1_threshold, count(*) AS n_total, count(*) FILTER (routed) AS n_routed_stage2,
          {Q.div('count(*) FILTER (routed)', 'count(*)')} AS stage2_rate FROM routed GROUP BY ALL),
sweep AS (SELECT dataset, stage1_threshold, n_total, n_routed_stage2, stage2_rate, accuracy, f1_binary AS f1_hate, f1_macro, roc_auc,
          l1 + stage2_rate * l2 AS latency_ms_per_sample,
          1.0::DOUBLE / {_SECONDS} AS throughput_samples_per_sec
          FROM e JOIN rates USING (dataset, stage1_threshold) JOIN costs USING (dataset))"""
_SWEEP_COLS = ["stage1_threshold", "stage2_rate", "accuracy", "f1_hate", "f1_macro", "roc_auc", "latency_ms_per_sample", "throughput_samples_per_sec"]


def sweep(spark, sf_dir):
    swept = S.cascade_sweep(T.scored(spark, sf_dir), ["dataset"])
    return S.with_cascade_costs(swept, ["dataset"], costs(spark, sf_dir)).drop(*COST_COLS)


@query("exp_cascade_sweep", f"WITH {SWEPT} SELECT dataset, n_total, n_routed_stage2, {Q.rounded(_SWEEP_COLS, 6)} FROM sweep")
def exp_cascade_sweep(spark, sf_dir):
    return rounded(sweep(spark, sf_dir), 6)


@query(
    "join_costs",
    f"WITH {_STATS}, {_COSTS} SELECT dataset, {Q.rounded(COST_COLS + ['stage2_rate'], 6)} FROM stats JOIN costs USING (dataset)",
)
def join_costs(spark, sf_dir):
    return rounded(_stats(spark, sf_dir).select("dataset", "stage2_rate").join(costs(spark, sf_dir), "dataset"), 6)


POINTS = f"""{SWEPT}, {Q.evaluated('alone', 'scored', ['dataset'], 'label', 'p2')},
baseline AS (SELECT dataset, f1_binary * CASE dataset WHEN 'A' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS base_f1, thr2 AS base_thr FROM alone JOIN costs USING (dataset)),
best AS (SELECT dataset, stage1_threshold AS best_t1, f1_hate AS best_f1, throughput_samples_per_sec AS best_thr FROM sweep
         QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(f1_hate, 12) DESC, stage1_threshold) = 1),
safe AS (SELECT s.dataset, stage1_threshold AS no_loss_t1, stage2_rate AS no_loss_rate, f1_hate AS no_loss_f1, throughput_samples_per_sec AS no_loss_thr
         FROM sweep s JOIN baseline b ON s.dataset = b.dataset WHERE f1_hate >= base_f1 - 1e-9::DOUBLE
         QUALIFY row_number() OVER (PARTITION BY s.dataset ORDER BY round(throughput_samples_per_sec, 9) DESC, stage1_threshold) = 1),
points AS (SELECT dataset, best_t1, best_f1, best_thr, no_loss_t1, no_loss_rate, no_loss_f1, no_loss_thr,
           no_loss_thr / greatest(1e-9::DOUBLE, base_thr) AS speed_up, base_f1, base_thr
           FROM best JOIN baseline USING (dataset) LEFT JOIN safe USING (dataset))"""
_POINT_COLS = ["best_t1", "best_f1", "best_thr", "no_loss_t1", "no_loss_rate", "no_loss_f1", "no_loss_thr", "speed_up", "base_f1", "base_thr"]


def baseline(spark, sf_dir):
    """Stage 2 alone; corpus A's bar is lowered so that a no-loss point exists there."""
    alone = M.evaluate(T.scored(spark, sf_dir), ["dataset"], "label", "p2")
    bar = F.when(F.col("dataset") == "A", 0.6).otherwise(1.0)
    return alone.join(costs(spark, sf_dir), "dataset").select("dataset", (F.col("f1_binary") * bar).alias("base_f1"), F.col("thr2").alias("base_thr"))


def points(spark, sf_dir):
    return S.operating_points(sweep(spark, sf_dir), ["dataset"], baseline(spark, sf_dir))


@query("exp_cascade_points", f"WITH {POINTS} SELECT dataset, {Q.rounded(_POINT_COLS, 6)} FROM points")
def exp_cascade_points(spark, sf_dir):
    return rounded(points(spark, sf_dir), 6)


@query("top_no_loss_point", f"WITH {POINTS} SELECT dataset, {Q.rounded(['no_loss_t1', 'no_loss_thr'], 6)} FROM points")
def top_no_loss_point(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("dataset", "no_loss_t1", "no_loss_thr"), 6)


@query("top_best_f1_point", f"WITH {POINTS} SELECT dataset, {Q.rounded(['best_t1', 'best_f1'], 6)} FROM points")
def top_best_f1_point(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("dataset", "best_t1", "best_f1"), 6)


# ---------------------------------------------------------------- robustness
def obfuscate_sql(text: str, key: str, rules: tuple[str, ...] = RULES) -> str:
    """The same rules with list functions; DuckDB counts list positions from 1."""

    def draw(start: int, position: str) -> str:
        return f"substr(blocks[({position}) // 8 + 1], (({position}) % 8) * 4 + {start}, 4)"

    def number(start: int) -> str:
        return f"('0x' || substr(d, {start}, 4))::INTEGER"

    chars = "string_split(tok, '')"
    if "leet" in rules:
        chars = (
            f"list_transform({chars}, lambda c, i: CASE WHEN contains('{LEET_FROM}', c) "
            f"AND {draw(1, 'i - 1')} < '{hex_below(RATES['leet'])}' THEN translate(c, '{LEET_FROM}', '{LEET_TO}') ELSE c END)"
        )
    if "repeat" in rules:
        chars = (
            f"list_transform({chars}, lambda c, i: CASE WHEN contains('{CONSONANTS}', lower(c)) "
            f"AND {draw(33, 'i - 1')} < '{hex_below(RATES['repeat'])}' THEN c || c ELSE c END)"
        )
    masked = "cs"
    if "punct" in rules:
        masked = (
            f"CASE WHEN substr(d, 1, 4) < '{hex_below(RATES['punct'])}' AND len(slots) > 0 THEN "
            f"list_transform(cs, lambda c, i: CASE WHEN i = slots[{number(5)} % len(slots) + 1] "
            f"THEN substr('{MASKS}', {number(9)} % {len(MASKS)} + 1, 1) ELSE c END) ELSE cs END"
        )
    joined = f"array_to_string({masked}, '')"
    spread = "j"
    if "space" in rules:
        spread = (
            f"CASE WHEN length(j) > 3 AND substr(d, 13, 4) < '{hex_below(RATES['space'])}' "
            "THEN array_to_string(string_split(j, ''), ' ') ELSE j END"
        )
    cls = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
    non = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
    return f"""parts AS (
  SELECT doc_id, unnest(p) AS tok, unnest(range(len(p))) AS pos
  FROM (SELECT {key} AS doc_id, regexp_extract_all({text}, '{cls}+|{non}+') AS p FROM texts)),
hashed AS (SELECT *, regexp_matches(tok, '^\\p{{L}}+$') AS alpha, sha256(doc_id || ':' || pos) AS d,
  list_transform(range((length(tok) - 1) // 8 + 1), lambda k: sha256(doc_id || ':' || pos || ':' || k)) AS blocks FROM parts),
lettered AS (SELECT *, {chars} AS cs FROM hashed WHERE alpha),
slotted AS (SELECT *, list_filter(range(1, len(cs) + 1), lambda i: contains('{VOWELS}', lower(cs[i])) AND cs[i] <> '') AS slots FROM lettered),
merged AS (SELECT *, {joined} AS j FROM slotted),
done AS (SELECT doc_id, pos, {spread} AS s FROM merged
         UNION ALL SELECT doc_id, pos, tok FROM hashed WHERE NOT alpha),
obfuscated AS (SELECT doc_id, string_agg(s, '' ORDER BY pos) AS obfuscated FROM done GROUP BY doc_id)"""


_TEXTS = f"texts AS (SELECT doc_id, {clean_sql('text')} AS text FROM documents)"


def _obfuscated(spark, sf_dir, rules=RULES):
    docs = T.texts(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("clean"))
    return docs.withColumn("obfuscated", obfuscate_text(F.col("clean"), F.col("doc_id"), rules))


def _rule(name: str, rules: tuple[str, ...]) -> None:
    def run(spark, sf_dir):
        return _obfuscated(spark, sf_dir, rules).select("doc_id", "obfuscated")

    query(name, f"WITH {_TEXTS}, {obfuscate_sql('text', 'doc_id', rules)} SELECT doc_id, obfuscated FROM obfuscated")(run)


for _name in RULES:
    _rule(f"exp_obfuscate_{_name}", (_name,))
_rule("exp_obfuscate", RULES)


@query(
    "top_examples",
    f"""WITH {_TEXTS}, {obfuscate_sql('text', 'doc_id')}
        SELECT doc_id, substr(text, 1, 120) AS clean, substr(obfuscated, 1, 120) AS obfuscated
        FROM texts JOIN obfuscated USING (doc_id) ORDER BY doc_id LIMIT 5""",
)
def top_examples(spark, sf_dir):
    return B.first_examples(T.read(spark, sf_dir, "documents"))


ROBUST = f"""{SC}, stacked AS (
  SELECT dataset, 'clean' AS variant, label, p1 AS p FROM scored UNION ALL
  SELECT dataset, 'obfuscated', label, p_obf FROM scored),
{Q.evaluated('e', 'stacked', ['dataset', 'variant'], 'label', 'p')},
robust AS (SELECT c.dataset, c.f1_binary AS f1_clean, c.f1_macro AS macro_clean, c.roc_auc AS auc_clean,
           o.f1_binary AS f1_obfuscated, o.f1_macro AS macro_obfuscated, o.roc_auc AS auc_obfuscated,
           o.f1_binary - c.f1_binary AS delta_f1_hate, o.f1_macro - c.f1_macro AS delta_f1_macro,
           coalesce(o.roc_auc, 0) - coalesce(c.roc_auc, 0) AS delta_auc
           FROM e c JOIN e o ON c.dataset = o.dataset AND c.variant = 'clean' AND o.variant = 'obfuscated')"""
_ROBUST_COLS = [
    "f1_clean", "macro_clean", "auc_clean", "f1_obfuscated", "macro_obfuscated", "auc_obfuscated",
    "delta_f1_hate", "delta_f1_macro", "delta_auc",
]


def robust(spark, sf_dir):
    return B.robustness(T.scored(spark, sf_dir), ["dataset"], "p1", "p_obf")


@query("exp_robustness", f"WITH {ROBUST} SELECT dataset, {Q.rounded(_ROBUST_COLS)} FROM robust")
def exp_robustness(spark, sf_dir):
    return rounded(robust(spark, sf_dir))


# ------------------------------------------------------------- cross dataset
_CROSS = f"""{SC}, tests AS (
  SELECT m.model, t.train, dataset AS eval, label,
         CASE WHEN t.train = dataset THEN CASE m.model WHEN 'tfidf' THEN p1 ELSE p2 END ELSE 0.5 * p_obf + 0.3 * CASE m.model WHEN 'tfidf' THEN p1 ELSE p2 END END AS p
  FROM scored, (VALUES ('tfidf'), ('verifier')) m(model), (VALUES ('A'), ('B')) t(train) WHERE split = 'test'),
{Q.evaluated('e', 'tests', ['model', 'train', 'eval'], 'label', 'p')},
crossed AS (SELECT a.*, h.f1_macro AS f1_macro_in_domain, a.f1_macro - h.f1_macro AS delta_f1_macro
            FROM e a LEFT JOIN e h ON a.model = h.model AND a.train = h.train AND h.eval = h.train WHERE a.train <> a.eval)"""


def _cross_scores(spark, sf_dir):
    """Scores of two models from each corpus on the test rows of both: weaker away from home."""
    s = T.scored(spark, sf_dir).filter(F.col("split") == "test")
    cells = [
        F.struct(F.lit(m).alias("model"), F.lit(t).alias("train"), F.col(c).alias("home"))
        for m, c in (("tfidf", "p1"), ("verifier", "p2"))
        for t in ("A", "B")
    ]
    long = s.select(F.col("dataset").alias("eval"), "label", "p_obf", F.inline(F.array(*cells)))
    away = F.lit(0.5) * F.col("p_obf") + F.lit(0.3) * F.col("home")
    return long.withColumn("p", F.when(F.col("train") == F.col("eval"), F.col("home")).otherwise(away))


_CROSS_COLS = ["f1_binary", "f1_macro", "roc_auc", "f1_macro_in_domain", "delta_f1_macro"]


@query("exp_cross_dataset", f"WITH {_CROSS} SELECT model, train, eval, {Q.rounded(_CROSS_COLS)} FROM crossed")
def exp_cross_dataset(spark, sf_dir):
    return rounded(B.cross_dataset(_cross_scores(spark, sf_dir)).select("model", "train", "eval", *_CROSS_COLS))


@query(
    "pairs_cross_dataset",
    f"WITH {SC} SELECT a.dataset AS train, b.dataset AS eval, b.n FROM (SELECT DISTINCT dataset FROM scored) a, (SELECT dataset, count(*) AS n FROM scored WHERE split = 'test' GROUP BY dataset) b WHERE a.dataset <> b.dataset",
)
def pairs_cross_dataset(spark, sf_dir):
    """Test rows of every pair of different corpora."""
    tests = T.scored(spark, sf_dir).filter(F.col("split") == "test")
    n = tests.groupBy(F.col("dataset").alias("eval")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.struct(F.lit(a).alias("train"), F.lit(b).alias("pair_eval")) for a, b in B.pairs(["A", "B"])])
    return n.select("eval", "n", F.inline(listed)).filter(F.col("eval") == F.col("pair_eval")).drop("pair_eval")


@query("exp_group_audit", f'WITH {AUDITED} SELECT ord, "group", n, n_hate, n_flagged, {Q.rounded(_AUDIT_RATES)} FROM audit')
def exp_group_audit(spark, sf_dir):
    """Given test scores joined to their groups, audited by group."""
    s = T.scored(spark, sf_dir)
    scores = s.select("doc_id", "label", decide(F.col("p1")).alias("pred"))
    groups = T.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return rounded(M.group_audit(scores.join(groups, "doc_id"), "lang", T.LANGUAGES))


# ------------------------------------------------------------------- reports
_DIM = lambda models: f"""dims AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{P.MODEL_LABEL[m]}')" for m in models)}) m(model, name), (VALUES ('A'), ('B')) d(dataset))"""


def _fix(c: str, n: int = 4, alias: str | None = None) -> str:
    return f"coalesce(printf('%.{n}f', {c}), '—') AS {alias or c}"


def _sign(c: str, alias: str) -> str:
    return f"coalesce(CASE WHEN {c} >= 0 THEN '+' ELSE '' END || printf('%.4f', {c}), '—') AS {alias}"


@query(
    "rep_in_domain",
    f"""WITH {RUN_METRICS}, {_DIM(P.MODELS)} SELECT name AS model, dataset, {_fix('accuracy', 4, 'acc')}, {_fix('precision', 4, 'p')},
        {_fix('recall', 4, 'r')}, {_fix('f1_binary', 4, 'f1_hate')}, {_fix('f1_macro')}, {_fix('roc_auc', 4, 'auc')}
        FROM dims LEFT JOIN (SELECT * FROM runs WHERE seed = 42) USING (model, dataset)""",
)
def rep_in_domain(spark, sf_dir):
    return P.in_domain_table(run_metrics(spark, sf_dir).filter(F.col("seed") == 42), ["A", "B"])


_BY3 = ["model", "dataset"]


@query(
    "rep_three_way",
    f"""WITH {_THREE}, three_m AS (SELECT 'tfidf' AS model, * FROM three), {_classwise_sql('c', 'three_m', _BY3)}, {_summary_sql('s', 'c', _BY3)}, {_DIM(P.MODELS)},
        w AS (SELECT model, dataset, max(f1) FILTER (class = 0) AS f1_hate, max(f1) FILTER (class = 1) AS f1_offensive, max(f1) FILTER (class = 2) AS f1_neither FROM c GROUP BY ALL)
        SELECT name AS model, dataset, {_fix('accuracy')}, {_fix('f1_hate')}, {_fix('f1_offensive')}, {_fix('f1_neither')}, {_fix('f1_macro')}, {_fix('f1_weighted')}
        FROM dims LEFT JOIN (SELECT * FROM w JOIN s USING (model, dataset)) USING (model, dataset)""",
)
def rep_three_way(spark, sf_dir):
    rows = _three(spark, sf_dir).withColumn("model", F.lit("tfidf"))
    c = M.per_class(rows, _BY3, "label3", "pred3", 3)
    return P.three_way_table(c, M.multiclass_summary(c, _BY3), ["A", "B"])


@query(
    "rep_llm",
    f"""WITH {RUN_METRICS}, r AS (SELECT CASE WHEN model = 'verifier' THEN 'baseline' ELSE 'zero-shot' END AS regime, * EXCLUDE (model) FROM runs WHERE seed = 42),
        dims AS (SELECT * FROM (VALUES ('baseline'), ('zero-shot'), ('4-shot')) m(regime), (VALUES ('A'), ('B')) d(dataset))
        SELECT regime, dataset, {', '.join(_fix(c) for c in Q.RATES)} FROM dims LEFT JOIN r USING (regime, dataset)""",
)
def rep_llm(spark, sf_dir):
    runs = run_metrics(spark, sf_dir).filter(F.col("seed") == 42)
    regime = F.when(F.col("model") == "verifier", "baseline").otherwise("zero-shot")
    return P.regime_table(runs.withColumn("regime", regime).drop("model"), ["A", "B"], ["baseline", "zero-shot", "4-shot"])


_PM = lambda m: f"coalesce(max(printf('%.3f ± %.3f', mean, std)) FILTER (metric = '{m}'), '—') AS {m}"


@query(
    "rep_multi_seed",
    f"""WITH {SEEDS}, {_DIM(P.MODELS)} SELECT name AS model, dataset, coalesce(max(n_runs)::VARCHAR, '—') AS n, {', '.join(_PM(m) for m in ('accuracy', 'f1_binary', 'f1_macro', 'roc_auc'))}
        FROM dims LEFT JOIN summary USING (model, dataset) GROUP BY name, dataset""",
)
def rep_multi_seed(spark, sf_dir):
    return P.seeds_table(M.seed_summary(run_metrics(spark, sf_dir), ["model", "dataset"]), ["A", "B"])


@query(
    "rep_threshold",
    f"""WITH {TUNED}, {_DIM(P.MODELS)} SELECT name AS model, dataset, {_fix('best_threshold', 2, 't_star')}, {_fix('f1_hate_default', 4, 'f1_default')},
        {_fix('f1_hate_tuned', 4, 'f1_tuned')}, {_sign('delta_f1_hate', 'delta_f1')}, {_fix('f1_macro_tuned')}
        FROM dims LEFT JOIN (SELECT 'tfidf' AS model, * FROM tuned) USING (model, dataset)""",
)
def rep_threshold(spark, sf_dir):
    tuned = S.tune_threshold(T.scored(spark, sf_dir), ["dataset"], "label", "p1")
    return P.threshold_table(tuned.withColumn("model", F.lit("tfidf")), ["A", "B"])


@query(
    "rep_adversarial",
    f"""WITH {ROBUST}, {_DIM(P.MODELS)} SELECT name AS model, dataset, {_fix('f1_clean')}, {_fix('f1_obfuscated')}, {_sign('delta_f1_hate', 'delta_f1')},
        {_fix('auc_clean')}, {_fix('auc_obfuscated')}, {_sign('delta_auc', 'delta_auc')}
        FROM dims LEFT JOIN (SELECT 'tfidf' AS model, * FROM robust) USING (model, dataset)""",
)
def rep_adversarial(spark, sf_dir):
    return P.robustness_table(robust(spark, sf_dir).withColumn("model", F.lit("tfidf")), ["A", "B"])


@query(
    "rep_cascade",
    f"""WITH {POINTS}
        SELECT dataset, 'sweep' AS kind, printf('%.2f', stage1_threshold) AS t1, printf('%.1f%%', stage2_rate * 100) AS routed,
               printf('%.4f', f1_hate) AS f1_hate, printf('%.1f', throughput_samples_per_sec) AS throughput, '—' AS speed_up FROM sweep
        UNION ALL SELECT dataset, 'stage 2 alone', '—', '100.0%', printf('%.4f', base_f1), printf('%.1f', base_thr), '—' FROM points
        UNION ALL SELECT dataset, 'no loss', coalesce(printf('%.2f', no_loss_t1), '—'), coalesce(printf('%.1f%%', no_loss_rate * 100), '—'),
               coalesce(printf('%.4f', no_loss_f1), '—'), coalesce(printf('%.1f', no_loss_thr), '—'), coalesce(printf('%.1fx', speed_up), '—') FROM points
        UNION ALL SELECT dataset, 'best F1', printf('%.2f', best_t1), '—', printf('%.4f', best_f1), printf('%.1f', best_thr), '—' FROM points""",
)
def rep_cascade(spark, sf_dir):
    return P.cascade_table(sweep(spark, sf_dir), points(spark, sf_dir))


@query(
    "rep_groups",
    f"""WITH {AUDITED} SELECT ord, "group", n, n_hate, printf('%.1f%%', hate_pct * 100) AS hate_pct, printf('%.1f%%', flagged_pct * 100) AS flagged_pct,
        {_fix('recall_hate', 3)}, {_fix('f1_hate', 3)}, {_fix('f1_macro', 3)} FROM audit""",
)
def rep_groups(spark, sf_dir):
    return P.group_table(audit(spark, sf_dir))


