"""A run table from the driver's tables, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of strategies for the codes of the tables.
INPUTS = {"1-URGENT": "brief", "2-HIGH": "auto", "3-MEDIUM": "rag", "4-NOT SPECIFIED": "full", "5-LOW": "rag_large"}
PROMPTS = {"A": "short", "N": "standard", "R": "detailed"}
INPUT_ORDER, PROMPT_ORDER = ["auto", "brief", "rag", "full"], ["short", "standard", "detailed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(column: str, names: dict[str, str]) -> F.Column:
    out = None
    for code, name in names.items():
        out = F.when(F.col(column) == code, name) if out is None else out.when(F.col(column) == code, name)
    return out.otherwise(F.col(column))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: a run of a supplier's model.  The size is unknown for every 17th model.

    Only the columns needed are read; Catalyst broadcasts the dimensions that are small by their statistics.  Orders take their customers before the lines, which are
    many more, come in; then the lines are dealt by supplier, so a task has all runs of its models, and what is grouped by model shrinks before a shuffle.
    """
    t = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderpriority").join(t("customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    models = t("supplier", "s_suppkey", "s_name", "s_nationkey").join(t("nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = t("lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    placed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey", "o_custkey", "c_custkey")
    rows = placed.repartition("l_suppkey").join(models, F.col("l_suppkey") == F.col("s_suppkey"))
    failed = F.col("l_linestatus") == "F"
    return rows.select(
        F.col("s_name").alias("model"), F.col("n_name").alias("family"),
        F.when(F.col("s_suppkey") % 17 != 0, (1 + F.col("s_suppkey") % 36).cast("double")).alias("parameters_b"),
        _named("o_orderpriority", INPUTS).alias("input_strategy"), _named("l_returnflag", PROMPTS).alias("prompt_strategy"),
        F.col("c_mktsegment").alias("case_id"), (F.col("l_quantity") * F.lit(2.0)).alias("NRS"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("runtime_seconds"), failed.alias("failed"), (~failed).alias("success"), F.col("l_quantity").alias("word_count"),
    )


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


RUNS_SQL = f"""runs AS (
  SELECT s_name AS model, n_name AS family, CASE WHEN s_suppkey % 17 <> 0 THEN CAST(1 + s_suppkey % 36 AS DOUBLE) END AS parameters_b,
    {_case("o_orderpriority", INPUTS)} AS input_strategy, {_case("l_returnflag", PROMPTS)} AS prompt_strategy, c_mktsegment AS case_id,
    l_quantity * 2.0::DOUBLE AS NRS, l_extendedprice / 1000.0::DOUBLE AS runtime_seconds, l_linestatus = 'F' AS failed, l_linestatus <> 'F' AS success, l_quantity AS word_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
