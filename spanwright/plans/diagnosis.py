"""Queries of the diagnosis family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import diagnose as D
from spanwright.plans.views import oracle, rounded, view

FRONTIER, CANDIDATE = "frontier-xl", "candidate-r2"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.listed_runs(view(spark, sf_dir, "traces"))


def q_a02_listed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


def q_d01_paired_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.paired_gap(_runs(spark, sf_dir), FRONTIER, CANDIDATE))


def q_c01_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cross_model_contrast(_runs(spark, sf_dir), FRONTIER, CANDIDATE).groupBy("model", "outcome").agg(F.count("*").alias("n"))


def q_e01_deficit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = D.cross_model_contrast(_runs(spark, sf_dir), FRONTIER, CANDIDATE)
    return rounded(D.deficit_scores(view(spark, sf_dir, "v_capabilities"), runs, view(spark, sf_dir, "v_labels")))


def q_c02_within_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).where(F.col("model") == CANDIDATE)
    return rounded(D.deficit_scores(view(spark, sf_dir, "v_capabilities"), runs, view(spark, sf_dir, "v_labels")))


def q_c03_selected_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.selected_deficit(q_e01_deficit_scores(spark, sf_dir)).select("capability_id", "gap", "priority")


def q_d02_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.label_pairs(_runs(spark, sf_dir), view(spark, sf_dir, "v_labels"), FRONTIER, CANDIDATE))


def q_k04_replay_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.replay_diagnosis(view(spark, sf_dir, "v_capabilities"), _runs(spark, sf_dir), view(spark, sf_dir, "v_labels"), FRONTIER, CANDIDATE)
    return rounded(found.select("capability_id", "gap", "priority", "discordant_n", "p_value", "trainable"))


def q_d29_label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.label_confusion(view(spark, sf_dir, "v_labels"), view(spark, sf_dir, "v_truth"))


def q_d29_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.col("truth") == F.col("given")
    return q_d29_label_confusion(spark, sf_dir).agg(F.sum("n").alias("n"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("right"), F.round(F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("accuracy"))


def q_b03_gap_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the gap must know before believing it."""
    gap = D.paired_gap(_runs(spark, sf_dir), FRONTIER, CANDIDATE)
    notes = F.filter(F.array(F.when(F.col("paired_n") < 50, "few_pairs"), F.when(F.col("gap").isNull(), "no_gap"), F.when(F.abs("gap") < 0.10, "small_gap")), lambda x: x.isNotNull())
    return gap.select("paired_n", F.array_join(notes, ",").alias("advisories"))


_PAIRS = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY ordinal DESC) AS k FROM {v_runs} WHERE task IS NOT NULL) WHERE k = 1),
pairs AS (SELECT f.task, f.run_id AS fr, c.run_id AS cr, f.outcome AS fo, c.outcome AS co FROM last f JOIN last c ON f.task = c.task WHERE f.model = 'frontier-xl' AND c.model = 'candidate-r2')"""
_GAP = f"""WITH {_PAIRS},
g AS (SELECT count(*) AS n, count(*) FILTER (fo = 'win') AS fw, count(*) FILTER (co = 'win') AS cw FROM pairs)
SELECT n AS paired_n, fw AS frontier_wins, cw AS candidate_wins,
  (SELECT count(*) FROM {{v_runs}} WHERE task IS NOT NULL AND model = 'frontier-xl') AS frontier_attempted,
  (SELECT count(*) FROM {{v_runs}} WHERE task IS NOT NULL AND model = 'candidate-r2') AS candidate_attempted,
  round(fw / nullif(n, 0), 9) AS frontier_rate, round(cw / nullif(n, 0), 9) AS candidate_rate, round((fw - cw) / nullif(n, 0), 9) AS gap FROM g"""


def _scores(where: str) -> str:
    return f"""scope AS (SELECT * FROM {{v_runs}} WHERE {where}),
s AS (SELECT c.capability_id, c.ordinal,
  count(*) FILTER (l.label <> 'NA' AND r.outcome = 'win') AS rw, count(*) FILTER (l.label <> 'NA' AND r.outcome = 'loss') AS rl,
  count(*) FILTER (l.label = 'LACKING' AND r.outcome = 'win') AS lw, count(*) FILTER (l.label = 'LACKING' AND r.outcome = 'loss') AS ll,
  (SELECT count(*) FROM scope WHERE outcome = 'loss') AS losses
  FROM {{v_capabilities}} c CROSS JOIN scope r LEFT JOIN {{v_labels}} l ON l.run_id = r.run_id AND l.capability_id = c.capability_id GROUP BY ALL),
scored AS (SELECT capability_id, ordinal, rw AS n_relevant_wins, rl AS n_relevant_losses, lw / nullif(rw, 0) AS baseline_rate, ll / nullif(rl, 0) AS incident_rate,
  ll / nullif(rl, 0) - lw / nullif(rw, 0) AS gap, coalesce(ll / nullif(losses, 0), 0) AS prevalence,
  coalesce(ll / nullif(rl, 0) - lw / nullif(rw, 0), 0) * coalesce(ll / nullif(losses, 0), 0) AS priority FROM s)"""


_CROSS = "(model = 'frontier-xl' AND outcome = 'win') OR (model = 'candidate-r2' AND outcome = 'loss')"
_SCORE_COLUMNS = "capability_id, ordinal, n_relevant_wins, n_relevant_losses, round(baseline_rate, 9) AS baseline_rate, round(incident_rate, 9) AS incident_rate, round(gap, 9) AS gap, round(prevalence, 9) AS prevalence, round(priority, 9) AS priority"
_TESTS = f"""{_PAIRS},
j AS (SELECT p.task, x.capability_id, x.label AS fl, y.label AS cl FROM pairs p JOIN {{v_labels}} x ON x.run_id = p.fr JOIN {{v_labels}} y ON y.run_id = p.cr AND y.capability_id = x.capability_id
  WHERE x.label <> 'NA' AND y.label <> 'NA'),
t AS (SELECT capability_id, count(*) FILTER (fl = 'PRESENT' AND cl <> 'PRESENT') AS b, count(*) FILTER (fl <> 'PRESENT' AND cl = 'PRESENT') AS c, count(*) FILTER (fl = cl) AS concordant FROM j GROUP BY 1),
tested AS (SELECT *, b + c AS discordant_n, CASE WHEN b + c > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
  lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) END AS p_value FROM t)"""

RAW_SCORES = f"WITH {_scores(_CROSS)}"

QUERIES = {f.__name__: f for f in (q_a02_listed_runs, q_d01_paired_gap, q_c01_contrast, q_e01_deficit_scores, q_c02_within_model_scores, q_c03_selected_deficit, q_d02_mcnemar, q_k04_replay_diagnosis, q_d29_label_confusion, q_d29_label_accuracy, q_b03_gap_advisories)}
SQL = {
    "q_a02_listed_runs": "SELECT run_id, task, model, outcome, ordinal FROM {v_runs}",
    "q_d01_paired_gap": _GAP,
    "q_c01_contrast": f"SELECT model, outcome, count(*) AS n FROM {{v_runs}} WHERE {_CROSS} GROUP BY 1, 2",
    "q_e01_deficit_scores": f"WITH {_scores(_CROSS)} SELECT {_SCORE_COLUMNS} FROM scored",
    "q_c02_within_model_scores": f"WITH {_scores('model = ' + repr(CANDIDATE))} SELECT {_SCORE_COLUMNS} FROM scored",
    "q_c03_selected_deficit": f"WITH {_scores(_CROSS)} SELECT capability_id, round(gap, 9) AS gap, round(priority, 9) AS priority FROM scored WHERE gap >= 0.2 AND least(n_relevant_wins, n_relevant_losses) >= 3 ORDER BY scored.priority DESC, ordinal LIMIT 1",
    "q_d02_mcnemar": f"WITH {_TESTS} SELECT capability_id, b, c, concordant, discordant_n, round(p_value, 9) AS p_value, discordant_n < 8 AS underpowered FROM tested",
    "q_k04_replay_diagnosis": f"WITH {_scores(_CROSS)}, {_TESTS} SELECT s.capability_id, round(gap, 9) AS gap, round(priority, 9) AS priority, discordant_n, round(p_value, 9) AS p_value, coalesce(baseline_rate < 1.0 AND n_relevant_wins >= 3, false) AS trainable FROM scored s LEFT JOIN tested t ON s.capability_id = t.capability_id",
    "q_d29_label_confusion": "SELECT truth, coalesce(label, 'NA') AS given, count(*) AS n FROM {v_truth} t LEFT JOIN {v_labels} l ON t.run_id = l.run_id AND t.capability_id = l.capability_id GROUP BY 1, 2",
    "q_d29_label_accuracy": "SELECT count(*) AS n, count(*) FILTER (truth = coalesce(label, 'NA')) AS \"right\", round(count(*) FILTER (truth = coalesce(label, 'NA')) / count(*), 9) AS accuracy FROM {v_truth} t LEFT JOIN {v_labels} l ON t.run_id = l.run_id AND t.capability_id = l.capability_id",
    "q_b03_gap_advisories": f"WITH {_PAIRS}, g AS (SELECT count(*) AS n, (count(*) FILTER (fo = 'win') - count(*) FILTER (co = 'win')) / nullif(count(*), 0) AS gap FROM pairs) SELECT n AS paired_n, concat_ws(',', CASE WHEN n < 50 THEN 'few_pairs' END, CASE WHEN gap IS NULL THEN 'no_gap' END, CASE WHEN abs(gap) < 0.10 THEN 'small_gap' END) AS advisories FROM g",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
