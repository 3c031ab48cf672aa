"""Stored stages, heads of files, running sums."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import chunking, generation
from tallyspark.sources import runs


def test_a_stage_that_was_broken_off_is_made_anew(spark, tmp_path):
    folder = str(tmp_path / "run")
    store = generation.Stages(spark, folder, "a")
    (tmp_path / "run" / "cut" / "_temporary").mkdir(parents=True)
    assert store.manifest("cut") is None
    assert store("cut", spark.range(5)).count() == 5 and store.manifest("cut") == "a"
    assert store("cut", spark.range(9)).count() == 5
    with pytest.raises(ValueError, match="other options"):
        generation.Stages(spark, folder, "b")("cut", spark.range(5))


def test_what_a_run_is_made_of(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    of = lambda d, **more: generation.made_of(d, generation.Options(**more), "doc_id", "text")
    assert of(docs) == of(docs.orderBy(F.desc("doc_id"))) != of(docs, max_words=9)
    assert of(docs) != of(docs.where("doc_id = 1")) and of(docs.limit(0)) != of(docs)


def test_heads_cost_no_more_for_a_large_file(spark, tmp_path):
    for name, rows in (("small", 2), ("large", 3_000_000)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "nrs_runs.csv").write_text("﻿NRS,model\r\n" + "0.5,a-model-of-some-name\r\n" * rows)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "nrs_runs.csv").write_text("nrs;model\n")
    paths = runs.run_files(spark, str(tmp_path))
    took = {}
    for name in ("small", "large"):
        start = time.time()
        own = [p for p in paths if f"/{name}/" in p]
        assert runs.headers(spark, own) == {"NRS,model": own}
        took[name] = time.time() - start
    assert took["large"] < took["small"] + 1
    assert set(runs.headers(spark, paths)) == {"NRS,model", "nrs;model"}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 16, 17, 61])
def test_running_sums(spark, n):
    numbers = [random.Random(n).randrange(100) for _ in range(n)]
    got = spark.createDataFrame([(numbers,), (numbers[:1],)], "x array<int>").select(chunking.running(F.col("x"), 4).alias("sums")).collect()
    assert [r.sums for r in got] == [[sum(x[: i + 1]) for i in range(len(x))] for x in (numbers, numbers[:1])]


def test_a_text_of_very_many_passages(spark):
    text = "word " * 100_000
    start = time.time()
    got = chunking.lossless(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=5).agg(F.count("*"), F.max("end"), F.sum(F.col("end") - F.col("start")), F.max("position")).first()
    assert tuple(got) == (100_000, 500_000, 500_000, 100_000) and time.time() - start < 60
