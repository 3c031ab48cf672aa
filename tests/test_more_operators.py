import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import coverage, judging
from tallyspark.sources import documents, figures, models


def test_bubbles_and_leader(spark):
    assert figures.bubble_sizes([0, 4, None]) == [25, 220, 25 + 195 * 2**0.5 / 2]
    assert figures.bubble_sizes([None, float("nan")]) == [25, 25] and figures.bubble_sizes([3, 3]) == [122.5, 122.5]
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert figures.leader(df, "v", "k") == "a" and figures.leader(df.limit(0), "v", "k") is None


def test_pages_are_scanned_by_policy():
    good, poor = "A page of quite readable words, more than twenty of them, so that its quality is beyond doubt and nothing needs to be scanned at all here today.", "§§ ¤"
    scans = lambda *texts: (lambda it: lambda dpi, layout: next(it))(iter(texts))
    assert documents.read_page(good, scans()) == (good, "native") and documents.read_page("", scans(), "never") == ("", "native-empty")
    assert documents.read_page(poor, scans(good)) == (good, "ocr") and documents.read_page(good, scans(good), "always")[1] == "ocr"
    assert documents.read_page(poor, scans("~~", good)) == (good, "ocr-retry") and documents.read_page("some words", scans("", "~"))[1] == "native-fallback"
    assert documents.read_page("", scans("", "")) == ("", "ocr-empty")
    seen = []
    reader = documents.pdf_reader(lambda data: [(poor, lambda dpi: b"%d" % dpi)], dpi=200, scan=lambda image, language, dpi, layout: seen.append((image, dpi, layout)) or "")
    assert reader(b"x") == [(1, poor, "native-fallback")] and seen == [(b"200", 200, 3), (b"300", 300, 6)]
    with pytest.raises(documents.RecognitionError):
        documents.recognised(b"", "eng", 200, 3, command="/no/such/program")
    with pytest.raises(ValueError, match="policy"):
        documents.pdf_reader(list, "sometimes")


def test_delimiters():
    assert [documents.delimiter(x) for x in ("a;b\n1;2,5\n", "a,b\n1,2\n", "a\tb\n1\t2\n", "a|b|c\n1|2|3\n", "one\ntwo\n")] == [";", ",", "\t", "|", ","]
    assert documents.csv_rows(b"") == [] and documents.csv_rows(b"a,b\n1,2,3\n,\n") == [(2, "a: 1\nb: 2\ncolumn_3: 3", "csv-row")]


def test_providers():
    assert models.provider("served", "m", temperature=1).temperature == 1
    for bad in (("no", {}), ("hosted", {"url": "x", "temperature": 3})):
        with pytest.raises(ValueError):
            models.provider(bad[0], "m", **bad[1])
    assert models.provider("hosted", "m", url="http://127.0.0.1:9/")("p", 8).error
    assert models.provider("local", "m")("p", 8).error


def test_registry_and_isolated_scores(tmp_path):
    known = judging.registry(alignment=judging.isolated(["/no/such/program"]), faithfulness=lambda x: judging.compared(x["statements"], x["told"]))
    statuses = judging.run_metrics({n: e.run for n, e in known.items()}, {"statements": [{"verdict": 1}, {"verdict": 0}], "told": 0.5}, str(tmp_path))
    assert statuses["alignment"] == "unsupported" and statuses["faithfulness"] == "completed" and statuses["human_ratings"] == "unsupported"
    assert json.loads((tmp_path / "faithfulness.json").read_text())["score"] == 0.5
    with pytest.raises(ValueError, match="told"):
        judging.compared([{"verdict": 1}], 0.5)
    with pytest.raises(ValueError, match="unknown"):
        judging.registry(other=None)
    (tmp_path / "scorer.py").write_text("import json, sys; print(json.dumps({'score': len(json.load(sys.stdin)['a'])}))")
    assert judging.isolated(["python3", str(tmp_path / "scorer.py")])({"a": "xyz"}) == {"status": "completed", "score": 3.0}


def test_coverage_stage(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The cat sat. The dog ran.")
    rows = spark.createDataFrame([(1, str(tmp_path / "a.txt"), "The cat sat."), (2, str(tmp_path / "none.txt"), "The cat sat."), (3, str(tmp_path / "a.txt"), None)], "id long, source_path string, generated string")
    rows = coverage.texts_at(rows, "source_path", "source")
    embed = lambda texts: np.array([[len(t), 1.0 if "cat" in t else 0.0, 30.0 if "dog" in t else 0.0] for t in texts])
    out, cache = coverage.coverage_stage(rows, None, ["id"], "source", "generated", embed, "test", (0.75,))
    got = {r.id: r for r in out.collect()}
    assert got[1].source_coverage_075 == 0.5 and got[1].generation_support_075 == 1 and got[2].source_coverage_075 is None and got[3].source_coverage_075 is None
    cache.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.count() == 3

    def never(texts):
        raise AssertionError("embedded again")

    again, whole = coverage.coverage_stage(rows, cache, ["id"], "source", "generated", never, "test", (0.75,))
    assert {r.id: r.source_coverage_075 for r in again.collect()} == {i: r.source_coverage_075 for i, r in got.items()} and whole.count() == 3
    keys = coverage.known_keys(again, cache.limit(2)).first()
    assert (keys.current, keys.cached, keys.both) == (3, 2, 2)


def test_loss_pivot(spark):
    from tallyspark.operators.cases import loss_pivot

    r = loss_pivot(spark.createDataFrame([("c", "<=2B", 1.5), ("c", "all", 0.0)], "case_study string, threshold string, NRS_loss_vs_case_best double")).first().asDict()
    assert r["loss <=2B"] == 1.5 and r["loss all"] == 0 and r["loss <=4B"] is None


def test_run_files(spark, tmp_path):
    from tallyspark.sources.runs import load_runs

    for name, text in (("a", "﻿NRS,failed,source_file\n1,2.0,x.csv\n2,0,\n"), ("b", "NRS,failed,source_file\n3,2.0,\n4,yes,y.csv\n"), ("c", "nrs,model\n5,m\n,n\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "nrs_runs.csv").write_text(text, encoding="utf-8")
    rows, files = load_runs(spark, str(tmp_path))
    got = {r.NRS: r for r in rows.collect()}
    assert {k: r.failed for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert got[1].benchmark_source_file == "x.csv" and got[2].benchmark_source_file.endswith("a/nrs_runs.csv")
    assert {k: r.case_id for k, r in got.items()} == {1: "0", 2: "1", 3: "0", 4: "1", 5: "0"}
    assert sorted((r.nrs_runs_file.split("/")[-2], r.rows) for r in files.collect()) == [("a", 2), ("b", 2), ("c", 2)]


def test_figures_of_many_rows(spark):
    many = spark.range(1, 5001).selectExpr("id AS x", "id % 100 AS y", "cast(id % 2 AS string) AS g")
    for log in (False, True):
        svg = figures.scatter(many, "x", "y", "t", "g", log_x=log)
        assert 2_000 < svg.count("<circle") <= 5000
    assert figures.scatter(many.limit(10), "x", "y", "t").count("<circle") == 10
    assert "first 2000 of 5000" in figures.bars(many, "g", "x", "t")
