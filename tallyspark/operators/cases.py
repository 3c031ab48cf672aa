"""Case-study tables: how cases differ in difficulty, and what suits each.

Case tables are rounded to three digits before differences, difficulty and stability are computed from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numeric import of_successes, rounded, safe_divide, scaled_from_zero, share, with_bounds
from tallyspark.functions.parse import case_column, case_study, size_bucket
from tallyspark.operators.summaries import first_best, first_worst
from tallyspark.operators.tradeoff import CASE_THRESHOLDS, first_of

CONFIG = ["case_study", "model", "input_strategy", "prompt_strategy"]


def with_cases(runs: DataFrame) -> DataFrame:
    """`runs` with `case_study`, from the first case column that is there."""
    name = case_column(runs.columns)
    if name is None:
        raise ValueError("no case column")
    return runs.withColumn("case_study", case_study(F.col(name)))


def _quantile(x: str, q: float) -> Column:
    return F.percentile(F.when(F.col("success"), F.col(x)), F.lit(q))


def case_summary(runs: DataFrame) -> DataFrame:
    s = of_successes
    return with_cases(runs).groupBy("case_study").agg(
        F.count("*").alias("n_runs"), F.sum(F.col("success").cast("long")).alias("n_successful_runs"), share(F.col("failed")).alias("failure_rate"), F.count_distinct("model").alias("n_models"),
        F.count_distinct("input_strategy").alias("n_input_strategies"), F.count_distinct("prompt_strategy").alias("n_prompt_strategies"),
        s(F.avg, "NRS").alias("mean_NRS"), s(F.stddev_samp, "NRS").alias("std_NRS"), _quantile("NRS", 0.5).alias("median_NRS"), _quantile("NRS", 0.25).alias("q25_NRS"), _quantile("NRS", 0.75).alias("q75_NRS"),
        s(F.min, "NRS").alias("min_NRS"), s(F.max, "NRS").alias("max_NRS"), s(F.avg, "runtime_seconds").alias("mean_runtime_seconds"), s(F.stddev_samp, "runtime_seconds").alias("std_runtime_seconds"),
        _quantile("runtime_seconds", 0.5).alias("median_runtime_seconds"), s(F.avg, "parameters_b").alias("mean_parameters"),
    )


def case_configurations(runs: DataFrame) -> DataFrame:
    s = of_successes
    return with_cases(runs).groupBy(*CONFIG).agg(
        F.count("*").alias("n_runs"), share(F.col("failed")).alias("failure_rate"), F.median("parameters_b").alias("parameters"),
        s(F.avg, "NRS").alias("mean_NRS"), s(F.stddev_samp, "NRS").alias("std_NRS"), s(F.avg, "runtime_seconds").alias("mean_runtime_seconds"),
    )


def _best_first() -> list[Column]:
    return [F.desc_nulls_last("mean_NRS"), F.asc("model"), F.asc("input_strategy"), F.asc("prompt_strategy")]


def case_top(config: DataFrame, n: int = 5) -> DataFrame:
    """The `n` best configurations of each case."""
    return first_of(config, ["case_study"], _best_first(), n)


def case_best(config: DataFrame) -> DataFrame:
    new = {"model": "best_model", "input_strategy": "best_input_strategy", "prompt_strategy": "best_prompt_strategy", "mean_NRS": "best_mean_NRS", "std_NRS": "best_std_NRS", "mean_runtime_seconds": "best_runtime_seconds", "parameters": "best_parameters", "failure_rate": "best_failure_rate"}
    return case_top(config, 1).drop("place").withColumnsRenamed(new)


def case_difficulty(summary: DataFrame) -> DataFrame:
    """Cases by falling difficulty, with labels by terciles; with fewer than three scores all are moderate."""
    s = rounded(summary.select("case_study", "mean_NRS", "std_NRS", "failure_rate"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    b = with_bounds(s, {"m": zero("mean_NRS"), "f": zero("failure_rate"), "s": zero("std_NRS")})
    part = lambda c, k, invert=False: scaled_from_zero(F.col(c), F.col(f"lo_{k}"), F.col(f"hi_{k}"), invert)
    scored = b.select("case_study", "mean_NRS", "std_NRS", "failure_rate", (0.60 * part("mean_NRS", "m", True) + 0.25 * part("failure_rate", "f") + 0.15 * part("std_NRS", "s")).alias("difficulty_score"))
    edges = scored.agg(F.percentile("difficulty_score", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"), F.count_distinct("difficulty_score").alias("kinds"), F.min("difficulty_score").alias("lo"), F.max("difficulty_score").alias("hi"))
    low, high = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    flat = (F.col("kinds") < 3) | (F.col("lo") >= low) | (low >= high) | (high >= F.col("hi"))
    label = F.when(flat, "moderate").when(F.col("difficulty_score") <= low, "easy").when(F.col("difficulty_score") <= high, "moderate").otherwise("hard")
    out = scored.crossJoin(F.broadcast(edges)).withColumn("difficulty_label", label).drop("e", "kinds", "lo", "hi")
    return first_of(out, [], [F.desc("difficulty_score"), F.asc("case_study")], 1 << 30, "rank")


def case_stability(summary: DataFrame) -> DataFrame:
    s = rounded(summary.select("case_study", "mean_NRS", "std_NRS", "mean_runtime_seconds", "std_runtime_seconds", "failure_rate"))
    b = with_bounds(s, {"s": F.coalesce("std_NRS", F.lit(0.0))})
    return b.withColumns({
        "coefficient_of_variation_NRS": safe_divide(F.col("std_NRS"), F.col("mean_NRS")), "coefficient_of_variation_runtime": safe_divide(F.col("std_runtime_seconds"), F.col("mean_runtime_seconds")),
        "stability_score": 1.0 - scaled_from_zero(F.col("std_NRS"), F.col("lo_s"), F.col("hi_s")),
    }).drop("lo_s", "hi_s")


def case_pivot(runs: DataFrame, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """Mean of the successes by case and the values of a column."""
    rows = with_cases(runs).where("success")
    return rows.groupBy("case_study").agg(*[F.avg(F.when(F.col(column) == v, F.col(measure))).alias(v) for v in values])


def case_deltas(pivot: DataFrame, values: Sequence[str], name: str, differences: Sequence[tuple[str, str]]) -> DataFrame:
    """Best and worst value of each case, their range, and named differences, from rounded means; cases without any are left out."""
    p = rounded(pivot)
    best, worst = F.greatest(*values), F.least(*values)
    return p.where(best.isNotNull()).select(
        "case_study", first_best(values, values).alias(f"best_{name}_strategy"), best.alias(f"best_{name}_NRS"), first_worst(values, values).alias(f"worst_{name}_strategy"), worst.alias(f"worst_{name}_NRS"),
        (best - worst).alias(f"{name}_strategy_NRS_range"), *[(F.col(a) - F.col(b)).alias(f"{a}_minus_{b}_NRS") for a, b in differences if a in values and b in values],
    )


def case_sizes(runs: DataFrame, config: DataFrame) -> DataFrame:
    """By case and size class, with the best model of each."""
    s = of_successes
    rows = with_cases(runs).withColumn("parameter_bucket", size_bucket(F.col("parameters_b")))
    out = rows.groupBy("case_study", "parameter_bucket").agg(
        F.count("*").alias("n_runs"), share(F.col("failed")).alias("failure_rate"), s(F.avg, "NRS").alias("mean_NRS"), s(F.stddev_samp, "NRS").alias("std_NRS"), s(F.avg, "runtime_seconds").alias("mean_runtime_seconds"),
    )
    best = first_of(config.withColumn("parameter_bucket", size_bucket(F.col("parameters"))), ["case_study", "parameter_bucket"], _best_first())
    best = best.select("case_study", "parameter_bucket", F.col("model").alias("best_model_in_bucket"), F.col("mean_NRS").alias("best_mean_NRS_in_bucket"))
    return out.join(best, ["case_study", "parameter_bucket"], "left")


def case_size_loss(config: DataFrame) -> DataFrame:
    """For each case and size limit the best configuration, and what it loses to the case's best; limits that none meets are there, too."""
    limits = F.broadcast(config.sparkSession.createDataFrame(list(CASE_THRESHOLDS), "threshold string, cap double"))
    grid = config.groupBy("case_study").agg(F.max("mean_NRS").alias("top")).crossJoin(limits)
    within = config.where("mean_NRS IS NOT NULL").join(limits, F.col("cap").isNull() | (F.col("parameters") <= F.col("cap")))
    best = first_of(within, ["case_study", "threshold"], _best_first()).drop("place", "cap", "n_runs", "failure_rate", "std_NRS")
    out = grid.join(best, ["case_study", "threshold"], "left")
    return out.select(
        "case_study", "threshold", F.col("model").alias("best_model"), F.col("input_strategy").alias("best_input_strategy"), F.col("prompt_strategy").alias("best_prompt_strategy"), F.col("mean_NRS").alias("best_mean_NRS"),
        F.col("mean_runtime_seconds").alias("runtime_seconds"), "parameters", (F.col("top") - F.col("mean_NRS")).alias("NRS_loss_vs_case_best"),
    )


def loss_pivot(losses: DataFrame) -> DataFrame:
    """A row for each case, with its loss within each size limit; limits that none meets are null."""
    cells = [F.max(F.when(F.col("threshold") == t, F.col("NRS_loss_vs_case_best"))).alias(f"loss {t}") for t, _ in CASE_THRESHOLDS]
    return losses.groupBy("case_study").agg(*cells)
