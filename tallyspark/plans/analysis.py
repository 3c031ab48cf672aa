"""The whole analysis of a folder or ZIP of run files: tables, summary, reports, bundle."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.numeric import rounded
from tallyspark.functions.parse import case_column, ordered_values
from tallyspark.operators import cases, coverage, summaries, tradeoff
from tallyspark.plans.adapter import INPUT_ORDER, PROMPT_ORDER
from tallyspark.sources import figures, sinks
from tallyspark.sources.runs import load_runs


@dataclass(frozen=True)
class Options:
    input_order: list[str] = field(default_factory=lambda: list(INPUT_ORDER))
    prompt_order: list[str] = field(default_factory=lambda: list(PROMPT_ORDER))
    weights: dict[str, float] = field(default_factory=lambda: dict(summaries.WEIGHTS))
    reliable: float = tradeoff.RELIABLE
    thresholds: list[tuple[str, float | None]] = field(default_factory=lambda: list(tradeoff.THRESHOLDS))
    title: str = "Benchmark analysis"


def tables(runs: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """All tables of an analysis, none computed yet.  Case and coverage tables are there if their columns are."""
    o = options or Options()
    values = lambda c: [r[0] for r in runs.select(c).where(F.col(c).isNotNull()).distinct().collect()]  # noqa: E731  strategies are few
    inputs, prompts = ordered_values(values("input_strategy"), o.input_order), ordered_values(values("prompt_strategy"), o.prompt_order)
    config = summaries.configurations(runs, o.weights)
    out = {
        "descriptive_statistics": summaries.descriptive(runs), "input_summary": summaries.summary(runs, ["input_strategy"]), "prompt_summary": summaries.summary(runs, ["prompt_strategy"]),
        "input_prompt_summary": summaries.summary(runs, ["input_strategy", "prompt_strategy"]), "model_summary": summaries.summary(runs, ["model", "family", "parameters_b"]),
        "model_input_summary": summaries.summary(runs, ["model", "family", "parameters_b", "input_strategy"]), "model_prompt_summary": summaries.summary(runs, ["model", "family", "parameters_b", "prompt_strategy"]),
        "model_input_pivot": summaries.pivot_means(runs, "input_strategy", inputs), "model_prompt_pivot": summaries.pivot_means(runs, "prompt_strategy", prompts), "size_bin_summary": summaries.size_bins(runs),
        "configuration_summary": config, "model_strategy_matrix": summaries.model_strategies(runs, o.input_order), "model_strategy_prompt_matrix": summaries.model_cells(runs, o.input_order, o.prompt_order),
        "model_family_summary": summaries.families(runs), "top5_configurations": summaries.top_configurations(config), "top_models_strategy_matrix": summaries.top_models(runs, o.input_order), "pareto_frontier": tradeoff.frontier(config),
        "quality_loss": tradeoff.quality_loss(config, o.thresholds, o.reliable), "best_tradeoff": tradeoff.best_by_criteria(config, o.reliable), "parameter_correlations": summaries.correlations(runs, config),
        "parameter_correlations_by_input": summaries.correlations_by_input(config),
    }
    if case_column(runs.columns):
        s, c = cases.case_summary(runs), cases.case_configurations(runs)
        inrs, pnrs = cases.case_pivot(runs, "input_strategy", o.input_order, "NRS"), cases.case_pivot(runs, "prompt_strategy", prompts, "NRS")
        out |= {
            "case_study_summary": s, "best_configuration_by_case": cases.case_best(c), "top5_configurations_by_case": cases.case_top(c), "case_difficulty_ranking": cases.case_difficulty(s), "case_by_input_strategy_nrs": inrs,
            "case_by_input_strategy_runtime": cases.case_pivot(runs, "input_strategy", o.input_order, "runtime_seconds"), "case_by_prompt_strategy_nrs": pnrs,
            "case_by_prompt_strategy_runtime": cases.case_pivot(runs, "prompt_strategy", prompts, "runtime_seconds"), "case_model_size_summary": cases.case_sizes(runs, c), "case_model_size_loss": cases.case_size_loss(c),
            "case_stability_summary": cases.case_stability(s),
        }
        if len(o.input_order) > 1:
            out["case_input_strategy_delta"] = cases.case_deltas(inrs, o.input_order, "input", [("full", "brief"), ("rag", "brief"), ("full", "auto"), ("rag", "auto")])
        if len(prompts) > 1:
            out["case_prompt_strategy_delta"] = cases.case_deltas(pnrs, prompts, "prompt", [("detailed", "short"), ("standard", "short"), ("detailed", "standard")])
    if "source_coverage_075" in runs.columns:
        keys = {"input_strategy": ["input_strategy"], "prompt_strategy": ["prompt_strategy"], "model": ["model", "family", "parameters_b"], "model_strategy_prompt": summaries.CONFIGURATION, "model_family": ["family"]}
        out |= {f"coverage_by_{n}": coverage.coverage_summary(runs, k) for n, k in keys.items()}
        if "bertscore_f1" in runs.columns:
            out["high_alignment_low_coverage_cases"] = coverage.aligned_but_uncovered(coverage.adjusted(runs) if "omission_risk_075" not in runs.columns else runs)
    return out


def summary_json(runs: DataFrame, made: dict[str, DataFrame], files: DataFrame) -> dict:
    n = runs.agg(F.count("*").alias("runs"), F.count_distinct("model").alias("models"), F.count_distinct("input_strategy").alias("input_strategies"), F.count_distinct("prompt_strategy").alias("prompt_strategies")).first().asDict()
    return n | {"files": [r.asDict() for r in files.collect()], "best": [r.asDict() for r in made["best_tradeoff"].collect()], "pareto_configurations": made["pareto_frontier"].count()}


def run_analysis(spark: SparkSession, source: str, output: str, options: Options | None = None, shared: str | None = None) -> dict:
    """Reads run files, writes all tables (Parquet, CSV), a JSON summary, a Markdown, an HTML and a LaTeX report, figures, and a ZIP of all.

    Tables are rounded to three digits, half to even, when they are written.  The run table is cached while the tables are made of it."""
    o = options or Options()
    rows, files = load_runs(spark, source, shared)
    rows = rows.persist()
    try:
        made = {n: rounded(t) for n, t in tables(rows, o).items()}
        sinks.write_tables(made | {"runs": rows}, f"{output}/tables")
        summary = summary_json(rows, made, files)
        sinks.write_json(summary, f"{output}/analysis_summary.json")
        shown = ["descriptive_statistics", "input_summary", "prompt_summary", "best_tradeoff", "quality_loss", *(n for n in ("case_difficulty_ranking",) if n in made)]
        sinks.publish({
            "report.md": f"# {o.title}\n\n" + "\n".join(f"## {n}\n\n{sinks.markdown(made[n])}" for n in shown), "report.html": f"<h1>{o.title}</h1>\n" + "\n".join(f"<h2>{n}</h2>\n{sinks.html(made[n])}" for n in shown),
            "report.tex": "\n".join(f"% {n}\n{sinks.latex(made[n])}" for n in shown),
        }, output)
        sinks.publish(figures.of_analysis(made), f"{output}/figures")
        sinks.bundle(str(Path(output)))
        return summary
    finally:
        rows.unpersist()
