"""Grouped summaries of a run table.  Each is one aggregation; null keys form a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numeric import ci95, of_successes, safe_divide, scaled, share, spearman, with_bounds
from tallyspark.functions.parse import SIZE_BINS, size_bin

CONFIGURATION = ["model", "family", "input_strategy", "prompt_strategy", "parameters_b"]
# Weights of the balanced score.
WEIGHTS = {"NRS": 0.50, "speed": 0.20, "size_efficiency": 0.15, "stability": 0.10, "reliability": 0.05}


def _count_successes() -> Column:
    return F.sum(F.col("success").cast("long")).alias("successes")


def summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Measures of all attempts, and of the successes among them, by any keys."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.avg("NRS").alias("mean_NRS"), F.stddev_samp("NRS").alias("sd_NRS"), ci95(F.col("NRS")).alias("ci95_NRS"),
        F.avg("runtime_seconds").alias("mean_runtime_seconds"), F.stddev_samp("runtime_seconds").alias("sd_runtime_seconds"), share(F.col("failed")).alias("failure_rate"), _count_successes(),
        F.median("parameters_b").alias("parameter_median_b"), F.min("parameters_b").alias("parameter_min_b"), F.max("parameters_b").alias("parameter_max_b"),
        of_successes(F.avg, "NRS").alias("mean_NRS_success"), of_successes(F.stddev_samp, "NRS").alias("sd_NRS_success"),
        of_successes(F.avg, "runtime_seconds").alias("mean_runtime_success"), of_successes(F.stddev_samp, "runtime_seconds").alias("sd_runtime_success"),
    )


def descriptive(runs: DataFrame) -> DataFrame:
    """One row for all attempts and one for the successes, whose failure rate is 0 by definition.

    Both come from one pass: a row counts once for each scope that it belongs to.
    """
    scopes = F.when(F.col("success"), F.array(F.lit("all attempts"), F.lit("successful attempts"))).otherwise(F.array(F.lit("all attempts")))
    rows = runs.select("NRS", "runtime_seconds", "failed", "success", F.explode(scopes).alias("scope"))
    return rows.groupBy("scope").agg(
        F.count("*").alias("n"), F.avg("NRS").alias("mean_NRS"), F.stddev_samp("NRS").alias("sd_NRS"), F.median("NRS").alias("median_NRS"), F.min("NRS").alias("min_NRS"), F.max("NRS").alias("max_NRS"),
        F.avg("runtime_seconds").alias("mean_runtime_seconds"), F.stddev_samp("runtime_seconds").alias("sd_runtime_seconds"), share(F.col("failed")).alias("failure_rate"),
    )


def size_bins(runs: DataFrame) -> DataFrame:
    """By size bin; bins without runs are there too, and one for unknown sizes if there are any."""
    found = runs.withColumn("size_bin", size_bin(F.col("parameters_b"))).groupBy("size_bin").agg(
        F.count_distinct("model").alias("models"), F.count("*").alias("attempts"), F.avg("NRS").alias("mean_NRS"), F.stddev_samp("NRS").alias("sd_NRS"),
        F.avg("runtime_seconds").alias("mean_runtime_seconds"), F.stddev_samp("runtime_seconds").alias("sd_runtime_seconds"), share(F.col("failed")).alias("failure_rate"),
        F.min("parameters_b").alias("parameter_min_b"), F.max("parameters_b").alias("parameter_max_b"),
    )
    bins = runs.sparkSession.createDataFrame([(b,) for b in SIZE_BINS], "bin string")
    named = bins.join(found, F.col("bin") == F.col("size_bin"), "left").drop("size_bin").withColumnRenamed("bin", "size_bin")
    whole = named.unionByName(found.where("size_bin IS NULL"))
    return whole.fillna(0, ["models", "attempts"])


def configurations(runs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Configurations with ratios, scaled components and the balanced score; `weights` are made to sum to 1."""
    total = sum(max(0.0, weights.get(k, 0.0)) for k in WEIGHTS)
    w = {k: weights.get(k, 0.0) / total for k in WEIGHTS} if total > 0 else WEIGHTS
    aggs = [
        F.count("*").alias("attempts"), F.avg("NRS").alias("mean_NRS"), F.stddev_samp("NRS").alias("sd_NRS"), F.avg("runtime_seconds").alias("mean_runtime_seconds"),
        F.stddev_samp("runtime_seconds").alias("sd_runtime_seconds"), share(F.col("failed")).alias("failure_rate"), _count_successes(),
        of_successes(F.avg, "NRS").alias("mean_NRS_success"), of_successes(F.stddev_samp, "NRS").alias("sd_NRS_success"), of_successes(F.avg, "runtime_seconds").alias("mean_runtime_success"),
    ]
    if "word_count" in runs.columns:
        aggs.append(F.avg("word_count").alias("mean_word_count"))
    c = runs.groupBy(*CONFIGURATION).agg(*aggs)
    mean, runtime, size = F.col("mean_NRS"), F.col("mean_runtime_seconds"), F.col("parameters_b")
    c = c.withColumns({
        "reliability": 1.0 - F.coalesce("failure_rate", F.lit(0.0)), "NRS_per_second": safe_divide(mean, runtime),
        "NRS_per_billion_parameters": safe_divide(mean, size), "NRS_per_parameter_second": safe_divide(mean, size * runtime),
    })
    parts = {"nrs": mean, "log": F.log1p(runtime), "eff": F.col("NRS_per_billion_parameters"), "sd": F.col("sd_NRS")}
    c = with_bounds(c, parts)
    bound = lambda n: (F.col(f"lo_{n}"), F.col(f"hi_{n}"))
    spread = F.coalesce("sd_NRS", "hi_sd", F.lit(0.0))  # of a single attempt: as unstable as the worst
    no_sd = F.col("hi_sd").isNull()
    c = c.withColumns({
        "normalized_NRS": scaled(mean, *bound("nrs")), "normalized_speed": scaled(parts["log"], *bound("log"), invert=True), "normalized_size_efficiency": scaled(parts["eff"], *bound("eff")),
        "normalized_stability": F.when(no_sd, 0.0).otherwise(scaled(spread, *bound("sd"), invert=True)), "normalized_reliability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reliability"))),
    }).drop(*[f"{b}_{n}" for n in parts for b in ("lo", "hi")])
    score = sum((F.lit(w[k]) * F.col(f"normalized_{k}") for k in WEIGHTS), F.lit(0.0))
    return c.withColumn("balanced_score", score)


def pivot_means(runs: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Mean NRS of models by the values of a column, over all attempts; models of unknown size are left out.

    Models come by falling mean of all their attempts, as in the model summary; `position` has their rank.
    """
    cells = [F.avg(F.when(F.col(column) == v, F.col("NRS"))).alias(v) for v in values]
    wide = runs.where("model IS NOT NULL AND parameters_b IS NOT NULL").groupBy("model", "parameters_b").agg(*cells)
    order = runs.groupBy("model", "family", "parameters_b").agg(F.avg("NRS").alias("m"))
    order = order.select("model", F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), "model", "family", "parameters_b")).alias("position"))
    order = order.groupBy("model").agg(F.max("position").alias("position"))
    return wide.join(order, "model").orderBy("position")


def first_best(columns: Sequence[str], names: Sequence[str]) -> Column:
    """The name of the greatest of the columns; the first one wins a tie; null if all are null."""
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    out = F.when(F.col(columns[0]) == top, names[0])
    for c, n in zip(columns[1:], names[1:], strict=True):
        out = out.when(F.col(c) == top, n)
    return out


def first_worst(columns: Sequence[str], names: Sequence[str]) -> Column:
    low = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
    out = F.when(F.col(columns[0]) == low, names[0])
    for c, n in zip(columns[1:], names[1:], strict=True):
        out = out.when(F.col(c) == low, n)
    return out


def model_strategies(runs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mean NRS of the successes of each model by input strategy, with the best one.  Strategies outside `order` are dropped."""
    cells = [F.avg(F.when(F.col("success") & (F.col("input_strategy") == s), F.col("NRS"))).alias(f"{s}_NRS") for s in order]
    out = runs.groupBy("model").agg(F.median("parameters_b").alias("parameters"), *cells, F.avg("runtime_seconds").alias("mean_runtime"), share(F.col("failed")).alias("failure_rate"))
    names = [f"{s}_NRS" for s in order]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    out = out.withColumns({"best_strategy": first_best(names, order), "best_NRS": best})
    return out.select("model", "parameters", *names, "best_strategy", "best_NRS", "mean_runtime", "failure_rate").orderBy(F.desc_nulls_last("best_NRS"), "model")


def model_cells(runs: DataFrame, inputs: Sequence[str], prompts: Sequence[str]) -> DataFrame:
    """Mean NRS of the successes by model and each pair of input and prompt strategy."""
    cells = [F.avg(F.when((F.col("input_strategy") == i) & (F.col("prompt_strategy") == p), F.col("NRS"))).alias(f"{i}_{p}") for i in inputs for p in prompts]
    return runs.where("success AND model IS NOT NULL").groupBy("model").agg(*cells)


def families(runs: DataFrame) -> DataFrame:
    """Families with a success: quality of the successes, failures of all attempts."""
    out = runs.groupBy("family").agg(
        F.count_distinct(F.when(F.col("success"), F.col("model"))).alias("n_models"), of_successes(F.avg, "NRS").alias("mean_NRS"), of_successes(F.max, "NRS").alias("max_NRS"),
        of_successes(F.avg, "runtime_seconds").alias("mean_runtime"), share(F.col("failed")).alias("mean_failure_rate"), F.count_if("success").alias("s"),
    )
    return out.where("s > 0").drop("s").orderBy(F.desc_nulls_last("max_NRS"), "family")


def family_scaling(config: DataFrame) -> DataFrame:
    """Means of configurations' means, by family and size."""
    rows = config.where("parameters_b IS NOT NULL AND mean_NRS IS NOT NULL")
    return rows.groupBy("family", "model", "parameters_b").agg(F.avg("mean_NRS").alias("mean_NRS"), F.avg("mean_runtime_seconds").alias("mean_runtime_seconds"), F.avg("failure_rate").alias("failure_rate"))


def ranked(df: DataFrame, keys: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def top_configurations(config: DataFrame, n: int = 5) -> DataFrame:
    """The `n` of the highest mean; ties go by the configuration."""
    top = config.where("mean_NRS IS NOT NULL").orderBy(F.desc("mean_NRS"), *CONFIGURATION).limit(n)
    top = ranked(top, [F.desc("mean_NRS"), *map(F.col, CONFIGURATION)])
    return top.select("rank", "model", "input_strategy", "prompt_strategy", "mean_NRS", F.col("mean_runtime_seconds").alias("runtime_seconds"), F.col("parameters_b").alias("parameters"), "failure_rate")


def top_models(runs: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """Means of successes by input strategy of the `n` best models, best first."""
    cells = [F.avg(F.when(F.col("input_strategy") == s, F.col("NRS"))).alias(s) for s in order]
    every = runs.where("success").groupBy("model").agg(F.avg("NRS").alias("overall"), *cells)
    return every.orderBy(F.desc("overall"), "model").limit(n).drop("overall")


def correlations(runs: DataFrame, config: DataFrame) -> DataFrame:
    """Rank correlations of size with quality and runtime: of configurations and of models."""
    pairs = {"spearman_parameters_NRS": ("parameters_b", "mean_NRS"), "spearman_parameters_runtime": ("parameters_b", "mean_runtime_seconds")}
    needed = "parameters_b IS NOT NULL AND mean_NRS IS NOT NULL AND mean_runtime_seconds IS NOT NULL"
    models = runs.groupBy("model", "parameters_b").agg(F.avg("NRS").alias("mean_NRS"), F.avg("runtime_seconds").alias("mean_runtime_seconds")).where(needed)
    both = [spearman(df.withColumn("grain", F.lit(g)), ["grain"], pairs) for g, df in (("config", config.where(needed)), ("model", models))]
    return both[0].unionByName(both[1])


def correlations_by_input(config: DataFrame) -> DataFrame:
    """The same for each input strategy, ranks taken inside it; strategies without usable configurations have none."""
    pairs = {"spearman_parameters_NRS": ("parameters_b", "mean_NRS"), "spearman_parameters_runtime": ("parameters_b", "mean_runtime_seconds")}
    usable = config.where("parameters_b IS NOT NULL AND mean_NRS IS NOT NULL AND mean_runtime_seconds IS NOT NULL AND input_strategy IS NOT NULL")
    found = spearman(usable, ["input_strategy"], pairs).withColumnRenamed("n", "configurations")
    every = config.where("input_strategy IS NOT NULL").select("input_strategy").distinct()
    return every.join(found, "input_strategy", "left").fillna(0, ["configurations"])


