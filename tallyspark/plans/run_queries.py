"""Queries over the run table, and the SQL they are held against."""

from __future__ import annotations

from tallyspark.operators import cases, summaries, tradeoff
from tallyspark.plans.adapter import INPUT_ORDER, PROMPT_ORDER
from tallyspark.plans.compare import literal, of_runs, runs_sql

ALL_INPUTS = ["auto", "brief", "full", "rag", "rag_large"]
ALL_PROMPTS = ["detailed", "short", "standard"]

_SUMMARY = """count(*) AS attempts, avg(NRS) AS mean_NRS, stddev_samp(NRS) AS sd_NRS, 1.96::DOUBLE * stddev_samp(NRS) / sqrt(count(NRS)) AS ci95_NRS,
  avg(runtime_seconds) AS mean_runtime_seconds, stddev_samp(runtime_seconds) AS sd_runtime_seconds, avg(failed::INT) AS failure_rate, count(*) FILTER (WHERE success) AS successes,
  median(parameters_b) AS parameter_median_b, min(parameters_b) AS parameter_min_b, max(parameters_b) AS parameter_max_b,
  avg(NRS) FILTER (WHERE success) AS mean_NRS_success, stddev_samp(NRS) FILTER (WHERE success) AS sd_NRS_success,
  avg(runtime_seconds) FILTER (WHERE success) AS mean_runtime_success, stddev_samp(runtime_seconds) FILTER (WHERE success) AS sd_runtime_success"""
_KEYS = {
    "input_summary": ["input_strategy"], "prompt_summary": ["prompt_strategy"], "input_prompt_summary": ["input_strategy", "prompt_strategy"],
    "model_summary": ["model", "family", "parameters_b"], "model_input_summary": ["model", "family", "parameters_b", "input_strategy"], "model_prompt_summary": ["model", "family", "parameters_b", "prompt_strategy"],
}
_TEXT = {"model", "family", "input_strategy", "prompt_strategy"}

QUERIES = {n: of_runs(lambda r, k=k: summaries.summary(r, k)) for n, k in _KEYS.items()}
ORACLE_SQL = {n: runs_sql(f"SELECT {', '.join(k)}, {_SUMMARY} FROM runs GROUP BY {', '.join(k)}", ", ".join(x for x in k if x in _TEXT)) for n, k in _KEYS.items()}

_DESCRIBED = """count(*) AS n, avg(NRS) AS mean_NRS, stddev_samp(NRS) AS sd_NRS, median(NRS) AS median_NRS, min(NRS) AS min_NRS, max(NRS) AS max_NRS,
  avg(runtime_seconds) AS mean_runtime_seconds, stddev_samp(runtime_seconds) AS sd_runtime_seconds"""
QUERIES["descriptive_statistics"] = of_runs(summaries.descriptive)
ORACLE_SQL["descriptive_statistics"] = runs_sql(f"SELECT 'all attempts' AS scope, {_DESCRIBED}, avg(failed::INT) AS failure_rate FROM runs UNION ALL SELECT 'successful attempts', {_DESCRIBED}, 0.0 FROM runs WHERE success", "scope")

_BIN = "CASE WHEN parameters_b < 0 THEN NULL WHEN parameters_b <= 2 THEN '<=2B' WHEN parameters_b <= 4 THEN '>2-4B' WHEN parameters_b <= 8 THEN '>4-8B' WHEN parameters_b <= 16 THEN '>8-16B' WHEN parameters_b > 16 THEN '>16B' END"
QUERIES["size_bin_summary"] = of_runs(summaries.size_bins)
ORACLE_SQL["size_bin_summary"] = runs_sql(
    """SELECT coalesce(v.b, f.size_bin) AS size_bin, coalesce(models, 0) AS models, coalesce(attempts, 0) AS attempts, mean_NRS, sd_NRS, mean_runtime_seconds, sd_runtime_seconds, failure_rate, parameter_min_b, parameter_max_b
    FROM (VALUES ('<=2B'), ('>2-4B'), ('>4-8B'), ('>8-16B'), ('>16B')) v(b) FULL JOIN found f ON v.b = f.size_bin""",
    "size_bin",
    f"found AS (SELECT {_BIN} AS size_bin, count(DISTINCT model) AS models, count(*) AS attempts, avg(NRS) AS mean_NRS, stddev_samp(NRS) AS sd_NRS, avg(runtime_seconds) AS mean_runtime_seconds, stddev_samp(runtime_seconds) AS sd_runtime_seconds, avg(failed::INT) AS failure_rate, min(parameters_b) AS parameter_min_b, max(parameters_b) AS parameter_max_b FROM runs GROUP BY 1)",
)

CONFIG_SQL = """base AS (
  SELECT model, family, input_strategy, prompt_strategy, parameters_b, count(*) AS attempts, avg(NRS) AS mean_NRS, stddev_samp(NRS) AS sd_NRS, avg(runtime_seconds) AS mean_runtime_seconds, stddev_samp(runtime_seconds) AS sd_runtime_seconds,
    avg(failed::INT) AS failure_rate, count(*) FILTER (WHERE success) AS successes, avg(NRS) FILTER (WHERE success) AS mean_NRS_success, stddev_samp(NRS) FILTER (WHERE success) AS sd_NRS_success,
    avg(runtime_seconds) FILTER (WHERE success) AS mean_runtime_success, avg(word_count) AS mean_word_count
  FROM runs GROUP BY ALL
), ratios AS (
  SELECT *, 1 - failure_rate AS reliability, mean_NRS / nullif(mean_runtime_seconds, 0) AS NRS_per_second, mean_NRS / nullif(parameters_b, 0) AS NRS_per_billion_parameters,
    mean_NRS / nullif(parameters_b * mean_runtime_seconds, 0) AS NRS_per_parameter_second, ln(1 + mean_runtime_seconds) AS lr, coalesce(sd_NRS, max(sd_NRS) OVER ()) AS sds
  FROM base
), scaled AS (
  SELECT *, CASE WHEN max(mean_NRS) OVER () = min(mean_NRS) OVER () THEN 1 ELSE coalesce((mean_NRS - min(mean_NRS) OVER ()) / (max(mean_NRS) OVER () - min(mean_NRS) OVER ()), 0) END AS normalized_NRS,
    1 - CASE WHEN max(lr) OVER () = min(lr) OVER () THEN 1 ELSE coalesce((lr - min(lr) OVER ()) / (max(lr) OVER () - min(lr) OVER ()), 0) END AS normalized_speed,
    CASE WHEN max(NRS_per_billion_parameters) OVER () = min(NRS_per_billion_parameters) OVER () THEN 1 ELSE coalesce((NRS_per_billion_parameters - min(NRS_per_billion_parameters) OVER ()) / (max(NRS_per_billion_parameters) OVER () - min(NRS_per_billion_parameters) OVER ()), 0) END AS normalized_size_efficiency,
    1 - CASE WHEN max(sds) OVER () = min(sds) OVER () THEN 1 ELSE coalesce((sds - min(sds) OVER ()) / (max(sds) OVER () - min(sds) OVER ()), 0) END AS normalized_stability,
    greatest(0, least(1, reliability)) AS normalized_reliability
  FROM ratios
), config AS (
  SELECT * EXCLUDE (lr, sds), 0.5 * normalized_NRS + 0.2 * normalized_speed + 0.15 * normalized_size_efficiency + 0.1 * normalized_stability + 0.05 * normalized_reliability AS balanced_score FROM scaled
)"""
_CONFIG_TEXT = "model, family, input_strategy, prompt_strategy"


def of_config(f):
    return of_runs(lambda r: f(summaries.configurations(r)))


QUERIES["configuration_summary"] = of_runs(summaries.configurations)
ORACLE_SQL["configuration_summary"] = runs_sql("SELECT * FROM config", _CONFIG_TEXT, CONFIG_SQL)


def _cells(column: str, values: list[str], condition: str = "", measure: str = "NRS", suffix: str = "") -> str:
    return ", ".join(f"avg({measure}) FILTER (WHERE {condition}{column} = '{v}') AS \"{v}{suffix}\"" for v in values)


for _n, _c, _v in (("model_input_pivot", "input_strategy", ALL_INPUTS), ("model_prompt_pivot", "prompt_strategy", ALL_PROMPTS)):
    QUERIES[_n] = of_runs(lambda r, c=_c, v=_v: summaries.pivot_means(r, c, v))
    ORACLE_SQL[_n] = runs_sql(
        f"SELECT model, parameters_b, {_cells(_c, _v)}, any_value(position) AS position FROM runs JOIN placed USING (model) WHERE parameters_b IS NOT NULL GROUP BY model, parameters_b", "model",
        "means AS (SELECT model, family, parameters_b, avg(NRS) AS m FROM runs GROUP BY ALL), placed AS (SELECT model, max(p) AS position FROM (SELECT model, row_number() OVER (ORDER BY m DESC NULLS LAST, model, family, parameters_b NULLS FIRST) AS p FROM means) GROUP BY model)",
    )

_MATRIX = ", ".join(f"{s}_NRS" for s in INPUT_ORDER)
QUERIES["model_strategy_matrix"] = of_runs(lambda r: summaries.model_strategies(r, INPUT_ORDER))
ORACLE_SQL["model_strategy_matrix"] = runs_sql(
    f"SELECT model, parameters, {_MATRIX}, CASE greatest({_MATRIX}) {' '.join(f'WHEN {s}_NRS THEN {chr(39)}{s}{chr(39)}' for s in INPUT_ORDER)} END AS best_strategy, greatest({_MATRIX}) AS best_NRS, mean_runtime, failure_rate FROM wide", "model, best_strategy",
    f"wide AS (SELECT model, median(parameters_b) AS parameters, {_cells('input_strategy', INPUT_ORDER, 'success AND ', suffix='_NRS')}, avg(runtime_seconds) AS mean_runtime, avg(failed::INT) AS failure_rate FROM runs GROUP BY model)",
)
QUERIES["model_strategy_prompt_matrix"] = of_runs(lambda r: summaries.model_cells(r, INPUT_ORDER, PROMPT_ORDER))
ORACLE_SQL["model_strategy_prompt_matrix"] = runs_sql("SELECT model, " + ", ".join(f"avg(NRS) FILTER (WHERE input_strategy = '{i}' AND prompt_strategy = '{p}') AS {i}_{p}" for i in INPUT_ORDER for p in PROMPT_ORDER) + " FROM runs WHERE success GROUP BY model", "model")
QUERIES["top_models_matrix"] = of_runs(lambda r: summaries.top_models(r, INPUT_ORDER))
ORACLE_SQL["top_models_matrix"] = runs_sql(f"SELECT * EXCLUDE (overall) FROM (SELECT model, avg(NRS) AS overall, {_cells('input_strategy', INPUT_ORDER)} FROM runs WHERE success GROUP BY model ORDER BY overall DESC, model LIMIT 5)", "model")
QUERIES["family_summary"] = of_runs(summaries.families)
ORACLE_SQL["family_summary"] = runs_sql("SELECT family, count(DISTINCT model) FILTER (WHERE success) AS n_models, avg(NRS) FILTER (WHERE success) AS mean_NRS, max(NRS) FILTER (WHERE success) AS max_NRS, avg(runtime_seconds) FILTER (WHERE success) AS mean_runtime, avg(failed::INT) AS mean_failure_rate FROM runs GROUP BY family HAVING count(*) FILTER (WHERE success) > 0", "family")
QUERIES["family_scaling"] = of_config(summaries.family_scaling)
ORACLE_SQL["family_scaling"] = runs_sql("SELECT family, model, parameters_b, avg(mean_NRS) AS mean_NRS, avg(mean_runtime_seconds) AS mean_runtime_seconds, avg(failure_rate) AS failure_rate FROM config WHERE parameters_b IS NOT NULL GROUP BY ALL", "family, model", CONFIG_SQL)

_CK = "model, family, input_strategy, prompt_strategy, parameters_b NULLS FIRST"
QUERIES["top5_configurations"] = of_config(summaries.top_configurations)
ORACLE_SQL["top5_configurations"] = runs_sql(f"SELECT row_number() OVER (ORDER BY mean_NRS DESC, {_CK}) AS rank, model, input_strategy, prompt_strategy, mean_NRS, mean_runtime_seconds AS runtime_seconds, parameters_b AS parameters, failure_rate FROM config QUALIFY rank <= 5", "model, input_strategy, prompt_strategy", CONFIG_SQL)

_USABLE = "usable AS (SELECT * FROM config WHERE parameters_b IS NOT NULL AND mean_NRS IS NOT NULL AND mean_runtime_seconds IS NOT NULL AND failure_rate IS NOT NULL)"
_CRITERIA = [
    ("best raw quality", "true", "mean_NRS DESC, failure_rate, mean_runtime_seconds"), ("best balanced score", "true", "balanced_score DESC, mean_NRS DESC"), ("best reliable balanced score", "failure_rate <= 0.05", "balanced_score DESC, mean_NRS DESC"),
    ("best quality per second", "true", "NRS_per_second DESC NULLS LAST, mean_NRS DESC"), ("best quality per billion parameters", "true", "NRS_per_billion_parameters DESC NULLS LAST, mean_NRS DESC"), ("best quality per parameter-second", "true", "NRS_per_parameter_second DESC NULLS LAST, mean_NRS DESC"),
]
QUERIES["best_tradeoff"] = of_config(tradeoff.best_by_criteria)
ORACLE_SQL["best_tradeoff"] = runs_sql(
    f"SELECT * FROM ({literal([(c[0],) for c in _CRITERIA])}) v(criterion) LEFT JOIN found USING (criterion)", f"criterion, {_CONFIG_TEXT}", CONFIG_SQL, _USABLE,
    "found AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS criterion, * FROM usable WHERE {c} ORDER BY {o}, {_CK} LIMIT 1)" for n, c, o in _CRITERIA) + ")",
)
QUERIES["top_balanced"] = of_config(tradeoff.top_balanced)
ORACLE_SQL["top_balanced"] = runs_sql(f"SELECT {_CK.replace(' NULLS FIRST', '')}, mean_NRS, failure_rate, balanced_score FROM config ORDER BY balanced_score DESC NULLS LAST, mean_NRS DESC NULLS LAST, {_CK} LIMIT 10", _CONFIG_TEXT, CONFIG_SQL)
QUERIES["quality_speed_top10"] = of_config(tradeoff.quality_speed)
ORACLE_SQL["quality_speed_top10"] = runs_sql(
    f"""SELECT {_CK.replace(' NULLS FIRST', '')}, mean_NRS, mean_runtime_seconds, 0.7 * (mean_NRS - min(mean_NRS) OVER ()) / greatest(max(mean_NRS) OVER () - min(mean_NRS) OVER (), 1e-9)
      + 0.3 * (1 - (mean_runtime_seconds - min(mean_runtime_seconds) OVER ()) / greatest(max(mean_runtime_seconds) OVER () - min(mean_runtime_seconds) OVER (), 1e-9)) AS quality_speed_score
    FROM config WHERE mean_NRS IS NOT NULL AND mean_runtime_seconds IS NOT NULL ORDER BY quality_speed_score DESC, {_CK} LIMIT 10""", _CONFIG_TEXT, CONFIG_SQL)
QUERIES["pareto_frontier"] = of_config(tradeoff.frontier)
ORACLE_SQL["pareto_frontier"] = runs_sql(
    """SELECT * FROM usable a WHERE NOT EXISTS (SELECT 1 FROM usable b WHERE b.mean_NRS >= a.mean_NRS AND b.mean_runtime_seconds <= a.mean_runtime_seconds AND b.parameters_b <= a.parameters_b AND b.failure_rate <= a.failure_rate
      AND (b.mean_NRS > a.mean_NRS OR b.mean_runtime_seconds < a.mean_runtime_seconds OR b.parameters_b < a.parameters_b OR b.failure_rate < a.failure_rate))""", _CONFIG_TEXT, CONFIG_SQL, _USABLE)
QUERIES["model_extremes"] = of_runs(lambda r: tradeoff.extremes(summaries.summary(r, ["model"]).select("model", "mean_NRS", "failure_rate"), "mean_NRS", "model"))
ORACLE_SQL["model_extremes"] = runs_sql("SELECT * EXCLUDE (a, b) FROM (SELECT *, row_number() OVER (ORDER BY mean_NRS DESC, model) AS a, row_number() OVER (ORDER BY mean_NRS, model) AS b FROM (SELECT model, avg(NRS) AS mean_NRS, avg(failed::INT) AS failure_rate FROM runs GROUP BY model)) WHERE a <= 8 OR b <= 8", "model")

_B = {"model": "best_model", "input_strategy": "best_input_strategy", "prompt_strategy": "best_prompt_strategy", "parameters_b": "parameters_b", "mean_NRS": "mean_NRS", "mean_runtime_seconds": "mean_runtime_seconds", "failure_rate": "failure_rate"}
_R = {"model": "reliable_best_model", "input_strategy": "reliable_best_input_strategy", "prompt_strategy": "reliable_best_prompt_strategy", "parameters_b": "reliable_best_parameters_b", "mean_NRS": "reliable_best_mean_NRS", "mean_runtime_seconds": "reliable_best_runtime_seconds", "failure_rate": "reliable_best_failure_rate"}
_ORDER = f"mean_NRS DESC, failure_rate, mean_runtime_seconds, {_CK}"
QUERIES["quality_loss_by_threshold"] = of_config(tradeoff.quality_loss)
ORACLE_SQL["quality_loss_by_threshold"] = runs_sql(
    f"""SELECT l.threshold, {', '.join(f'b.{k} AS {v}' for k, v in _B.items())}, top - b.mean_NRS AS NRS_loss_vs_global_best, {', '.join(f'r.{k} AS {v}' for k, v in _R.items())}, top - r.mean_NRS AS reliable_NRS_loss_vs_global_best
    FROM limits l LEFT JOIN placed b ON b.threshold = l.threshold AND b.p = 1 LEFT JOIN placed_reliable r ON r.threshold = l.threshold AND r.p = 1, (SELECT max(mean_NRS) AS top FROM usable)""",
    "threshold, best_model, best_input_strategy, best_prompt_strategy, reliable_best_model, reliable_best_input_strategy, reliable_best_prompt_strategy", CONFIG_SQL, _USABLE,
    f"limits AS (SELECT * FROM ({literal(tradeoff.THRESHOLDS)}) v(threshold, cap))",
    f"placed AS (SELECT threshold, u.*, row_number() OVER (PARTITION BY threshold ORDER BY {_ORDER}) AS p FROM usable u JOIN limits ON cap IS NULL OR parameters_b <= cap)",
    f"placed_reliable AS (SELECT threshold, u.*, row_number() OVER (PARTITION BY threshold ORDER BY {_ORDER}) AS p FROM usable u JOIN limits ON cap IS NULL OR parameters_b <= cap WHERE failure_rate <= 0.05)",
)


def _ranked(by: str, source: str) -> str:
    part = f"PARTITION BY {by}"
    r = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part}, {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT {by}, {r('parameters_b')} AS rp, {r('mean_NRS')} AS rq, {r('mean_runtime_seconds')} AS rt FROM {source}"


def _rho(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 THEN covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0) END"


_RHOS = f"{_rho('rp', 'rq')} AS spearman_parameters_NRS, {_rho('rp', 'rt')} AS spearman_parameters_runtime"
QUERIES["spearman_global"] = of_runs(lambda r: summaries.correlations(r, summaries.configurations(r)))
ORACLE_SQL["spearman_global"] = runs_sql(
    f"SELECT grain, {_RHOS}, count(*) AS n FROM ({_ranked('grain', 'grains')}) GROUP BY grain", "grain", CONFIG_SQL, _USABLE,
    "grains AS (SELECT 'config' AS grain, parameters_b, mean_NRS, mean_runtime_seconds FROM usable UNION ALL SELECT 'model', parameters_b, avg(NRS), avg(runtime_seconds) FROM runs WHERE parameters_b IS NOT NULL GROUP BY model, parameters_b)",
)
QUERIES["spearman_by_input"] = of_config(summaries.correlations_by_input)
ORACLE_SQL["spearman_by_input"] = runs_sql(f"SELECT input_strategy, {_RHOS}, count(*) AS configurations FROM ({_ranked('input_strategy', 'usable')}) GROUP BY input_strategy", "input_strategy", CONFIG_SQL, _USABLE)

# Case studies.
_CASES = "cases AS (SELECT *, coalesce(nullif(case_id, ''), 'unknown_case') AS case_study FROM runs)"
_S = "FILTER (WHERE success)"
_CASE_SUMMARY = f"""case_summary AS (SELECT case_study, count(*) AS n_runs, count(*) {_S} AS n_successful_runs, avg(failed::INT) AS failure_rate, count(DISTINCT model) AS n_models, count(DISTINCT input_strategy) AS n_input_strategies, count(DISTINCT prompt_strategy) AS n_prompt_strategies,
  avg(NRS) {_S} AS mean_NRS, stddev_samp(NRS) {_S} AS std_NRS, median(NRS) {_S} AS median_NRS, quantile_cont(NRS, 0.25) {_S} AS q25_NRS, quantile_cont(NRS, 0.75) {_S} AS q75_NRS, min(NRS) {_S} AS min_NRS, max(NRS) {_S} AS max_NRS,
  avg(runtime_seconds) {_S} AS mean_runtime_seconds, stddev_samp(runtime_seconds) {_S} AS std_runtime_seconds, median(runtime_seconds) {_S} AS median_runtime_seconds, avg(parameters_b) {_S} AS mean_parameters FROM cases GROUP BY case_study)"""
_CASE_CONFIG = f"""case_config AS (SELECT case_study, model, input_strategy, prompt_strategy, count(*) AS n_runs, avg(failed::INT) AS failure_rate, median(parameters_b) AS parameters,
  avg(NRS) {_S} AS mean_NRS, stddev_samp(NRS) {_S} AS std_NRS, avg(runtime_seconds) {_S} AS mean_runtime_seconds FROM cases GROUP BY ALL)"""
_BEST = "mean_NRS DESC NULLS LAST, model, input_strategy, prompt_strategy"
QUERIES["case_summary"] = of_runs(cases.case_summary)
ORACLE_SQL["case_summary"] = runs_sql("SELECT * FROM case_summary", "case_study", _CASES, _CASE_SUMMARY)
QUERIES["case_top5"] = of_runs(lambda r: cases.case_top(cases.case_configurations(r)))
ORACLE_SQL["case_top5"] = runs_sql(f"SELECT *, row_number() OVER (PARTITION BY case_study ORDER BY {_BEST}) AS place FROM case_config QUALIFY place <= 5", "case_study, model, input_strategy, prompt_strategy", _CASES, _CASE_CONFIG)
QUERIES["case_best_config"] = of_runs(lambda r: cases.case_best(cases.case_configurations(r)))
ORACLE_SQL["case_best_config"] = runs_sql(
    f"SELECT case_study, model AS best_model, input_strategy AS best_input_strategy, prompt_strategy AS best_prompt_strategy, n_runs, failure_rate AS best_failure_rate, parameters AS best_parameters, mean_NRS AS best_mean_NRS, std_NRS AS best_std_NRS, mean_runtime_seconds AS best_runtime_seconds FROM case_config QUALIFY row_number() OVER (PARTITION BY case_study ORDER BY {_BEST}) = 1",
    "case_study, best_model, best_input_strategy, best_prompt_strategy", _CASES, _CASE_CONFIG)
_ROUNDED = "r3 AS (SELECT case_study, round_even(mean_NRS, 3) AS mean_NRS, round_even(std_NRS, 3) AS std_NRS, round_even(mean_runtime_seconds, 3) AS mean_runtime_seconds, round_even(std_runtime_seconds, 3) AS std_runtime_seconds, round_even(failure_rate, 3) AS failure_rate FROM case_summary)"


def _zero_scaled(x: str) -> str:
    return f"CASE WHEN max(coalesce({x}, 0)) OVER () = min(coalesce({x}, 0)) OVER () THEN 0 ELSE (coalesce({x}, 0) - min(coalesce({x}, 0)) OVER ()) / (max(coalesce({x}, 0)) OVER () - min(coalesce({x}, 0)) OVER ()) END"


QUERIES["case_difficulty"] = of_runs(lambda r: cases.case_difficulty(cases.case_summary(r)))
ORACLE_SQL["case_difficulty"] = runs_sql(
    """SELECT s.*, row_number() OVER (ORDER BY difficulty_score DESC, case_study) AS rank, CASE WHEN kinds < 3 OR lo >= q1 OR q1 >= q2 OR q2 >= hi THEN 'moderate' WHEN difficulty_score <= q1 THEN 'easy' WHEN difficulty_score <= q2 THEN 'moderate' ELSE 'hard' END AS difficulty_label
    FROM scored s, (SELECT quantile_cont(difficulty_score, 1/3) AS q1, quantile_cont(difficulty_score, 2/3) AS q2, count(DISTINCT difficulty_score) AS kinds, min(difficulty_score) AS lo, max(difficulty_score) AS hi FROM scored) e""".replace("s.*", "case_study, mean_NRS, std_NRS, failure_rate, difficulty_score"),
    "case_study, difficulty_label", _CASES, _CASE_SUMMARY, _ROUNDED,
    f"scored AS (SELECT case_study, mean_NRS, std_NRS, failure_rate, 0.6 * (1 - {_zero_scaled('mean_NRS')}) + 0.25 * {_zero_scaled('failure_rate')} + 0.15 * {_zero_scaled('std_NRS')} AS difficulty_score FROM r3)",
)
QUERIES["case_stability"] = of_runs(lambda r: cases.case_stability(cases.case_summary(r)))
ORACLE_SQL["case_stability"] = runs_sql(f"SELECT *, std_NRS / nullif(mean_NRS, 0) AS coefficient_of_variation_NRS, std_runtime_seconds / nullif(mean_runtime_seconds, 0) AS coefficient_of_variation_runtime, 1 - {_zero_scaled('std_NRS')} AS stability_score FROM r3", "case_study", _CASES, _CASE_SUMMARY, _ROUNDED)

for _n, _c, _v, _m in (("case_input_pivot", "input_strategy", INPUT_ORDER, "NRS"), ("case_input_runtime", "input_strategy", INPUT_ORDER, "runtime_seconds"), ("case_prompt_pivot", "prompt_strategy", ALL_PROMPTS, "NRS"), ("case_prompt_runtime", "prompt_strategy", ALL_PROMPTS, "runtime_seconds")):
    QUERIES[_n] = of_runs(lambda r, c=_c, v=_v, m=_m: cases.case_pivot(r, c, v, m))
    ORACLE_SQL[_n] = runs_sql(f"SELECT case_study, {_cells(_c, _v, measure=_m)} FROM cases WHERE success GROUP BY case_study", "case_study", _CASES)

_DELTAS = {"input": [("full", "brief"), ("rag", "brief"), ("full", "auto"), ("rag", "auto")], "prompt": [("detailed", "short"), ("standard", "short"), ("detailed", "standard")]}
for _k, _v in (("input", INPUT_ORDER), ("prompt", ALL_PROMPTS)):
    QUERIES[f"case_{_k}_delta"] = of_runs(lambda r, k=_k, v=_v: cases.case_deltas(cases.case_pivot(r, f"{k}_strategy", v, "NRS"), v, k, _DELTAS[k]))
    _all = ", ".join(f'"{x}"' for x in _v)
    _named = " ".join(f"WHEN \"{x}\" THEN '{x}'" for x in _v)
    ORACLE_SQL[f"case_{_k}_delta"] = runs_sql(
        f"SELECT case_study, CASE greatest({_all}) {_named} END AS best_{_k}_strategy, greatest({_all}) AS best_{_k}_NRS, CASE least({_all}) {_named} END AS worst_{_k}_strategy, least({_all}) AS worst_{_k}_NRS, greatest({_all}) - least({_all}) AS {_k}_strategy_NRS_range, "
        + ", ".join(f'"{a}" - "{b}" AS {a}_minus_{b}_NRS' for a, b in _DELTAS[_k]) + " FROM p3",
        f"case_study, best_{_k}_strategy, worst_{_k}_strategy", _CASES,
        "p3 AS (SELECT case_study, " + ", ".join(f"round_even(avg(NRS) FILTER (WHERE {_k}_strategy = '{x}'), 3) AS \"{x}\"" for x in _v) + " FROM cases WHERE success GROUP BY case_study)",
    )

_BUCKET = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} <= 2 THEN '<=2B' WHEN {0} <= 4 THEN '<=4B' WHEN {0} <= 8 THEN '<=8B' WHEN {0} <= 16 THEN '<=16B' ELSE '>16B' END"
QUERIES["case_size_summary"] = of_runs(lambda r: cases.case_sizes(r, cases.case_configurations(r)))
ORACLE_SQL["case_size_summary"] = runs_sql(
    f"""SELECT s.*, b.model AS best_model_in_bucket, b.mean_NRS AS best_mean_NRS_in_bucket FROM (SELECT case_study, {_BUCKET.format('parameters_b')} AS parameter_bucket, count(*) AS n_runs, avg(failed::INT) AS failure_rate, avg(NRS) {_S} AS mean_NRS, stddev_samp(NRS) {_S} AS std_NRS, avg(runtime_seconds) {_S} AS mean_runtime_seconds FROM cases GROUP BY ALL) s
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY case_study, parameter_bucket ORDER BY {_BEST}) AS place FROM (SELECT *, {_BUCKET.format('parameters')} AS parameter_bucket FROM case_config)) b ON b.case_study = s.case_study AND b.parameter_bucket = s.parameter_bucket AND place = 1""",
    "case_study, parameter_bucket, best_model_in_bucket", _CASES, _CASE_CONFIG)
QUERIES["case_size_loss"] = of_runs(lambda r: cases.case_size_loss(cases.case_configurations(r)))
ORACLE_SQL["case_size_loss"] = runs_sql(
    """SELECT g.case_study, g.threshold, b.model AS best_model, b.input_strategy AS best_input_strategy, b.prompt_strategy AS best_prompt_strategy, b.mean_NRS AS best_mean_NRS, b.mean_runtime_seconds AS runtime_seconds, b.parameters, top - b.mean_NRS AS NRS_loss_vs_case_best
    FROM (SELECT case_study, max(mean_NRS) AS top, threshold FROM case_config, limits GROUP BY case_study, threshold) g LEFT JOIN best b USING (case_study, threshold)""",
    "case_study, threshold, best_model, best_input_strategy, best_prompt_strategy", _CASES, _CASE_CONFIG, f"limits AS (SELECT * FROM ({literal(tradeoff.CASE_THRESHOLDS)}) v(threshold, cap))",
    f"best AS (SELECT threshold, c.* FROM case_config c JOIN limits ON cap IS NULL OR parameters <= cap WHERE mean_NRS IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_study, threshold ORDER BY {_BEST}) = 1)",
)
QUERIES["case_size_loss_pivot"] = of_runs(lambda r: cases.loss_pivot(cases.case_size_loss(cases.case_configurations(r))))
ORACLE_SQL["case_size_loss_pivot"] = runs_sql(
    "SELECT case_study, " + ", ".join(f"max(top) - max(mean_NRS) FILTER (WHERE {'true' if cap is None else f'parameters <= {cap}'}) AS \"loss {t}\"" for t, cap in tradeoff.CASE_THRESHOLDS)
    + " FROM (SELECT *, max(mean_NRS) OVER (PARTITION BY case_study) AS top FROM case_config) GROUP BY case_study",
    "case_study", _CASES, _CASE_CONFIG)
