"""Best choices among configurations: frontier, criteria, size limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numeric import with_bounds
from tallyspark.operators.summaries import CONFIGURATION
from tallyspark.session import reachable

# Size limits in billions of parameters; no limit is null.
THRESHOLDS = [("<=2B", 2.0), ("<=4B", 4.0), ("<=8B", 8.0), ("<=16B", 16.0), ("all models", None)]
CASE_THRESHOLDS = [*THRESHOLDS[:-1], ("all", None)]
RELIABLE = 0.05
NEEDED = "parameters_b IS NOT NULL AND mean_NRS IS NOT NULL AND mean_runtime_seconds IS NOT NULL AND failure_rate IS NOT NULL"
#: Rows that a task compares at a time.
BLOCK = 1_000


def undominated(x: np.ndarray) -> np.ndarray:
    """Of rows of values to be made small: which are not dominated.  Duplicates do not dominate each other.

    By rising sums a row can be dominated by earlier ones alone, and what is dominated has a
    dominating row among those kept; so each block meets itself and what was kept.
    """
    order = np.argsort(x.sum(1), kind="stable")
    kept = np.empty((0, x.shape[1]))
    good = np.zeros(len(x), bool)
    for at in range(0, len(x), BLOCK):
        part = order[at : at + BLOCK]
        rows = x[part]
        alive = np.ones(len(rows), bool)
        for others in (kept, rows):  # what was kept drops most; the rest meets itself
            left = np.flatnonzero(alive)
            for first in range(0, len(others), BLOCK):
                alive[left] &= ~_dominated(rows[left], others[first : first + BLOCK])
        good[part] = alive
        kept = np.vstack([kept, rows[alive]])
    return good


def _dominated(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows one of the others beats in a column without losing in any."""
    no_worse, better = np.ones((len(others), len(rows)), bool), np.zeros((len(others), len(rows)), bool)
    for a, b in zip(others.T, rows.T, strict=True):
        no_worse &= a[:, None] <= b
        better |= a[:, None] < b
    return (no_worse & better).any(0)


#: Tasks of the last merges of partial frontiers.
MERGES = (16, 1)


def frontier(config: DataFrame) -> DataFrame:
    """Configurations that none beats in one of NRS, runtime, size and failure rate without losing in another.

    Rows with a null in one of the four are left out.  Each partition first drops what is dominated within it,
    which takes nothing from the result, as what a dropped row dominates its dominator does too; then
    partial frontiers are merged as a tree.  The input is read once, and a task holds a frontier and one Arrow batch.
    """
    reachable(config.sparkSession)
    columns = ["mean_NRS", "mean_runtime_seconds", "parameters_b", "failure_rate"]
    left = config.where(NEEDED)
    schema = left.schema

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            best = b if best is None else pd.concat([best, b])
            best = best[undominated(best[columns].to_numpy(float) * np.array([-1, 1, 1, 1]))]
        if best is not None:
            yield best

    left = left.mapInPandas(local, schema)
    for tasks in MERGES:
        left = left.repartition(tasks).mapInPandas(local, schema)
    return left.orderBy("parameters_b", "mean_runtime_seconds", F.desc("mean_NRS"), "model", "input_strategy", "prompt_strategy")


def by_quality() -> list[Column]:
    return [F.desc("mean_NRS"), F.asc("failure_rate"), F.asc("mean_runtime_seconds"), *map(F.col, CONFIGURATION)]


def quality_loss(config: DataFrame, thresholds: Sequence[tuple[str, float | None]] = THRESHOLDS, reliable: float = RELIABLE) -> DataFrame:
    """For each size limit the best configuration within it, the best reliable one, and what they lose to the best of all."""
    spark = config.sparkSession
    limits = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(thresholds)], "position int, threshold string, cap double"))
    usable = config.where(NEEDED)
    best_of_all = usable.agg(F.max("mean_NRS").alias("top"))
    fields = {"model": "model", "input_strategy": "input_strategy", "prompt_strategy": "prompt_strategy", "parameters_b": "parameters_b", "mean_NRS": "mean_NRS", "mean_runtime_seconds": "mean_runtime_seconds", "failure_rate": "failure_rate"}
    within = usable.join(limits, F.col("cap").isNull() | (F.col("parameters_b") <= F.col("cap")))
    # least struct first: a partial aggregate that keeps one row, not a sort of every limit's rows
    key = F.struct((-F.col("mean_NRS")).alias("k1"), F.col("failure_rate").alias("k2"), F.col("mean_runtime_seconds").alias("k3"), *[F.col(c).alias(f"c_{c}") for c in CONFIGURATION], *[F.col(c).alias(f"v_{c}") for c in fields])
    best = within.groupBy("threshold").agg(F.min(key).alias("b"), F.min(F.when(F.col("failure_rate") <= reliable, key)).alias("r"))
    out = limits.join(best, "threshold", "left").crossJoin(F.broadcast(best_of_all))
    b, r = (lambda c: F.col(f"b.v_{c}")), (lambda c: F.col(f"r.v_{c}"))
    return out.orderBy("position").select(
        "threshold", b("model").alias("best_model"), b("input_strategy").alias("best_input_strategy"), b("prompt_strategy").alias("best_prompt_strategy"), b("parameters_b").alias("parameters_b"), b("mean_NRS").alias("mean_NRS"),
        (F.col("top") - b("mean_NRS")).alias("NRS_loss_vs_global_best"), b("mean_runtime_seconds").alias("mean_runtime_seconds"), b("failure_rate").alias("failure_rate"),
        r("model").alias("reliable_best_model"), r("input_strategy").alias("reliable_best_input_strategy"), r("prompt_strategy").alias("reliable_best_prompt_strategy"), r("parameters_b").alias("reliable_best_parameters_b"),
        r("mean_NRS").alias("reliable_best_mean_NRS"), (F.col("top") - r("mean_NRS")).alias("reliable_NRS_loss_vs_global_best"), r("mean_runtime_seconds").alias("reliable_best_runtime_seconds"), r("failure_rate").alias("reliable_best_failure_rate"),
    )


def best_by_criteria(config: DataFrame, reliable: float = RELIABLE) -> DataFrame:
    """The best configuration by each of six criteria, in one pass; a criterion that none meets has a row of nulls.

    The efficiency criteria do not ask for reliability."""
    usable = config.where(NEEDED)
    down = lambda c: (-F.col(c)).alias(f"by_{c}")
    quality = [down("mean_NRS"), F.col("failure_rate").alias("by_failure"), F.col("mean_runtime_seconds").alias("by_runtime")]
    ratio = lambda c: [F.col(c).isNull().alias("none"), down(c), down("mean_NRS")]
    criteria = [
        ("best raw quality", F.lit(True), quality), ("best balanced score", F.lit(True), ratio("balanced_score")), ("best reliable balanced score", F.col("failure_rate") <= reliable, ratio("balanced_score")),
        ("best quality per second", F.lit(True), ratio("NRS_per_second")), ("best quality per billion parameters", F.lit(True), ratio("NRS_per_billion_parameters")), ("best quality per parameter-second", F.lit(True), ratio("NRS_per_parameter_second")),
    ]
    whole = F.struct(*[F.col(c) for c in usable.columns]).alias("row")
    # the least struct of each: one aggregate of six values, combined before its shuffle
    least = usable.agg(*[F.min(F.when(met, F.struct(*keys, *[F.col(c).alias(f"tie_{c}") for c in CONFIGURATION], whole))).alias(f"m{i}") for i, (_, met, keys) in enumerate(criteria)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c[0]).alias("criterion"), F.col(f"m{i}.row").alias("row")) for i, c in enumerate(criteria)])
    return least.select(F.explode(rows).alias("x")).select("x.*").orderBy("position").select("criterion", "row.*")


def quality_speed(config: DataFrame, n: int = 10) -> DataFrame:
    """The best by 0.7 of scaled quality and 0.3 of scaled speed."""
    usable = config.where("mean_NRS IS NOT NULL AND mean_runtime_seconds IS NOT NULL")
    b = with_bounds(usable, {"q": F.col("mean_NRS"), "t": F.col("mean_runtime_seconds")})
    span = lambda n: F.greatest(F.col(f"hi_{n}") - F.col(f"lo_{n}"), F.lit(1e-9))
    score = 0.70 * (F.col("mean_NRS") - F.col("lo_q")) / span("q") + 0.30 * (1.0 - (F.col("mean_runtime_seconds") - F.col("lo_t")) / span("t"))
    top = b.withColumn("quality_speed_score", score).orderBy(F.desc("quality_speed_score"), *CONFIGURATION).limit(n)
    return top.select(*CONFIGURATION, "mean_NRS", "mean_runtime_seconds", "quality_speed_score")


def top_balanced(config: DataFrame, n: int = 10) -> DataFrame:
    return config.orderBy(F.desc_nulls_last("balanced_score"), F.desc_nulls_last("mean_NRS"), *CONFIGURATION).limit(n).select(*CONFIGURATION, "mean_NRS", "failure_rate", "balanced_score")


def extremes(df: DataFrame, value: str, key: str, n: int = 8) -> DataFrame:
    """The `n` rows of the largest and of the smallest values, each key once."""
    rows = df.where(F.col(value).isNotNull())
    return rows.orderBy(F.desc(value), key).limit(n).unionByName(rows.orderBy(F.asc(value), key).limit(n)).dropDuplicates([key])


def first_of(df: DataFrame, by: Sequence[str], keys: Sequence[Column], n: int = 1, name: str = "place") -> DataFrame:
    """The first `n` rows of each group; the plan keeps `n` of each group before the shuffle, too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col(name) <= n)


