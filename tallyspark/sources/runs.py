"""Run tables from CSV files: discovery, schemas that differ by file, normalisation, lineage."""

from __future__ import annotations

import zipfile
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.numeric import number
from tallyspark.functions.parse import all_numerals, model_family, parameters_b, truth

# The name of run files, and other names of columns.
RUNS_FILE = "nrs_runs.csv"
ALIASES = {
    "nrs": "NRS", "runtime_seconds": "runtime_seconds", "runtime_sec": "runtime_seconds", "seconds": "runtime_seconds", "model": "model", "model_name": "model",
    "prompt_strategy": "prompt_strategy", "prompt": "prompt_strategy", "input_strategy": "input_strategy", "parameters": "parameters", "parameter_count": "parameters", "params": "parameters",
    "failed": "failed", "failure": "failed", "bertscore_f1": "bertscore_f1", "bertscore": "bertscore_f1", "semantic_similarity": "semantic_similarity", "semantic": "semantic_similarity",
    "case_id": "case_id", "case": "case_id",
}
FOLDER = "benchmark_all_"
NUMBERS = ["NRS", "runtime_seconds", "bertscore_f1", "semantic_similarity", "word_count"]


def renamed(columns: list[str]) -> dict[str, str]:
    """New names by old ones.  A name that is there already stays; of two aliases of one name the first is taken."""
    taken, out = set(columns), {}
    for c in columns:
        target = ALIASES.get(c.strip().lower())
        if target and target not in taken:
            out[c] = target
            taken.add(target)
    return out


def extracted(archive: str, folder: str) -> str:
    """A ZIP's files in a folder that all executors can read; members that point outside it are refused."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for n in z.namelist():
            if not (root / n).resolve().is_relative_to(root):
                raise ValueError(f"{n} points outside the folder")
        z.extractall(root)
    return str(root)


def run_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of all run files below `root`, sorted, without those in a folder named tables.  Found by Spark, so any store will do."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", RUNS_FILE).load(root).select("path")
    return sorted(r.path for r in found.collect() if "tables" not in {p.lower() for p in r.path.split("/")})


def folder_strategy(path: Column) -> Column:
    """X of the parent or grandparent folder benchmark_all_X; null without one."""
    parts = F.reverse(F.split(path, "/"))
    named = lambda k: F.when(F.lower(F.get(parts, F.lit(k))).startswith(FOLDER), F.substring(F.lower(F.get(parts, F.lit(k))), len(FOLDER) + 1, 1000))
    return F.coalesce(named(1), named(2))


def headers(spark: SparkSession, paths: list[str], at_once: int = 16) -> dict[str, list[str]]:
    """The files by their first line.

    A file's first line is taken by Spark's own reader, which stops behind it: a file costs one small task, however large it is, in any
    store.  `at_once` files are looked at together."""
    # a line's end is \n, \r or \r\n for the reader
    line = lambda path: spark.read.text(path).limit(1).collect()
    with ThreadPoolExecutor(at_once) as pool:
        heads = [rows[0].value.removeprefix("\ufeff") if rows else "" for rows in pool.map(line, paths)]
    out: dict[str, list[str]] = {}
    for head, path in sorted(zip(heads, paths, strict=True), key=lambda x: x[1]):
        out.setdefault(head, []).append(path)
    return out


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Run files of one header, all columns as text but those of the normal form; unknown columns pass.

    What depends on a whole file, its only strategy and whether its flags are numbers, is one aggregate by file."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(paths)
    df = raw.withColumnsRenamed(renamed(raw.columns))
    if "NRS" not in df.columns:
        raise ValueError(f"{paths[0]} has no NRS column")
    has = lambda c: c in df.columns
    col = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    told = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    df = df.withColumns({"nrs_runs_file": F.col("_metadata.file_path"), "input_strategy_original": told("input_strategy"), "__block": F.col("_metadata.file_block_start"), "__place": F.monotonically_increasing_id()})
    by_file = df.groupBy(F.col("nrs_runs_file").alias("__file")).agg(F.count_distinct("input_strategy_original").alias("__n"), F.min("input_strategy_original").alias("__one"), all_numerals(col("failed")).alias("__numeric"))
    df = df.join(F.broadcast(by_file), F.col("nrs_runs_file") == F.col("__file"))  # a row a file
    parent = F.get(F.reverse(F.split("nrs_runs_file", "/")), F.lit(1))
    strategy = F.coalesce(folder_strategy(F.col("nrs_runs_file")), F.when(F.col("__n") == 1, F.col("__one")), parent)
    model, failed = F.coalesce(told("model"), F.lit("unknown_model")), truth(col("failed"), F.col("__numeric"))
    new = {
        "model": model, "prompt_strategy": F.coalesce(told("prompt_strategy"), F.lit("unknown")), "input_strategy": strategy, "parameters": col("parameters"), "failed": failed, "success": ~failed,
        "parameters_b": parameters_b(col("parameters"), model), "family": model_family(model), "benchmark_source_file": F.coalesce(told("source_file"), F.col("nrs_runs_file")), "runtime_seconds": F.lit(None).cast("double"),
    } | {c: number(F.col(c)) for c in NUMBERS if has(c)}
    if not has("case_id"):  # the row's place in its file, from 0
        new["case_id"] = (F.row_number().over(Window.partitionBy("nrs_runs_file").orderBy("__block", "__place")) - 1).cast("string")
    return df.withColumns(new).drop("__block", "__place", "__file", "__n", "__one", "__numeric")


def load_runs(spark: SparkSession, source: str, unzip_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, files): all run files below a folder or in a ZIP, as one table without rows that have no NRS.

    `files` has the rows of each file, with those, and its strategies.  Files of one header are read together.
    """
    if source.lower().endswith(".zip"):
        if unzip_to is None:
            raise ValueError("a ZIP needs a shared folder to be extracted to")
        source = extracted(source, unzip_to)
    paths = run_files(spark, source)
    if not paths:
        raise FileNotFoundError(f"no {RUNS_FILE} below {source}")
    parts = [read_files(spark, same) for same in headers(spark, paths).values()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.dropna(subset=["NRS"]), lineage(rows)


def lineage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("nrs_runs_file").agg(F.count("*").alias("rows"), F.first("input_strategy").alias("input_strategy"), F.array_sort(F.collect_set("input_strategy_original")).alias("original_values"))
