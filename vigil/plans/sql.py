"""SQL fragments shared by the twins of metric queries."""

from __future__ import annotations


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, str]:
    f1 = div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    f0 = div(f"2 * {tn}", f"2 * {tn} + {fp} + {fn}")
    seen = f"(({tp} + {fp} + {fn} > 0)::INTEGER + ({tn} + {fp} + {fn} > 0)::INTEGER)"
    return {
        "accuracy": div(f"{tp} + {tn}", f"{tn} + {fp} + {fn} + {tp}"),
        "precision": div(tp, f"{tp} + {fp}"),
        "recall": div(tp, f"{tp} + {fn}"),
        "f1_binary": f1,
        "f1_macro": div(f"{f1} + {f0}", seen),
    }


def counts(truth: str, pred: str) -> str:
    """tn, fp, fn, tp of a decision."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return ", ".join(f"count(*) FILTER ({truth} = {t} AND {pred} = {p}) AS {c}" for c, (t, p) in cells.items())


def rounded(columns: dict[str, str] | list[str], digits: int = 9) -> str:
    if isinstance(columns, list):
        columns = {c: c for c in columns}
    return ", ".join(f"round({e}, {digits}) AS {c}" for c, e in columns.items())


def auc_table(name: str, source: str, by: list[str], truth: str, score: str) -> str:
    """CTE ``name`` with by + roc_auc: average ranks (ties share the mean rank)."""
    keys = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    p, n = f"sum({truth})::DOUBLE", f"sum(1 - {truth})::DOUBLE"
    return f"""{name}_ranked AS (
  SELECT {keys}{truth} AS t,
         rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({part and part + ', '}{score if part else 'PARTITION BY ' + score}) - 1) / 2.0::DOUBLE AS r
  FROM {source}),
{name} AS (
  SELECT {keys}CASE WHEN sum(t) = 0 OR sum(1 - t) = 0 THEN NULL
         ELSE (sum(t * r) - {p.replace(truth, 't')} * ({p.replace(truth, 't')} + 1) / 2) / ({p.replace(truth, 't')} * {n.replace(truth, 't')}) END AS roc_auc
  FROM {name}_ranked {group})"""


def evaluated(name: str, source: str, by: list[str], truth: str, score: str, threshold: str = "0.5::DOUBLE") -> str:
    """CTE ``name``: by + tn, fp, fn, tp, five rates, roc_auc (not rounded)."""
    keys = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    on = f"JOIN {name}_auc a USING ({', '.join(by)})" if by else f"CROSS JOIN {name}_auc a"
    metrics = ", ".join(f"{e} AS {c}" for c, e in metric_columns().items())
    return f"""{auc_table(name + '_auc', source, by, truth, score)},
{name}_counts AS (
  SELECT {keys}{counts(truth, f'({score} >= {threshold})::INTEGER')} FROM {source} {group}),
{name} AS (
  SELECT {keys}tn, fp, fn, tp, {metrics}, roc_auc FROM {name}_counts {on})"""


RATES = ["accuracy", "precision", "recall", "f1_binary", "f1_macro", "roc_auc"]
