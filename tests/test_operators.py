import json
import math
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.replies import Reply
from tallyspark.operators import chunking, coverage, evaluation, generation
from tallyspark.plans import adapter
from tallyspark.plans.analysis import run_analysis
from tallyspark.sources import documents, runs, sinks
from tallyspark.streaming import runs as streaming


def test_chunks_cover_a_token_without_blanks(spark):
    df = spark.createDataFrame([(1, "x" * 1037), (2, None), (3, ""), (4, " a  b\n c ")], "doc_id long, text string")
    got = chunking.chunks(df, size=100, overlap=20).collect()
    mine = [r for r in got if r.doc_id == 1]
    assert set().union(*(range(r.start, r.end) for r in mine)) == set(range(1037)) and all(r.end - r.start <= 100 for r in mine)
    assert [(r.doc_id, r.text) for r in got if r.doc_id > 1] == [(4, "a b c")]


def test_passages_lose_nothing(spark):
    t = "alpha beta gamma delta " * 3 + "end"
    got = chunking.lossless(spark.createDataFrame([(1, t)], "doc_id long, text string"), size=5).orderBy("start").collect()
    assert "".join(r.text for r in got) == t and len(got) > 1
    words = chunking.pieces(spark.createDataFrame([(1, t)], "doc_id long, text string"), size=12).orderBy("start").collect()
    assert " ".join(r.text for r in words).split() == t.split()


def test_packing(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([40, 40, 40, 90, 5])] + [("b", 0, 10)], "g string, i int, s long")
    got = {(r.g, r.i): r.batch for r in chunking.packed(df, "g", ["i"], "s", 100, separator=2).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("a", 4): 3, ("b", 0): 1}
    with pytest.raises(Exception, match="exceeds the budget"):
        chunking.packed(df, "g", ["i"], "s", 50).collect()


def test_halves():
    for t in ["word " * 100, "x" * 400, "漢" * 300]:
        (a,), (b,) = chunking.halves([{"text": t, "start": 7, "end": 7 + len(t)}])
        assert a["text"] + b["text"] == t and a["end"] == b["start"]
    assert chunking.halves([{"text": "short"}]) is None


def test_sentence_coverage(spark):
    s = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "d int, sentence int, vector array<float>")
    g = spark.createDataFrame([(1, 0, [2.0, 0.0])], "d int, sentence int, vector array<float>")
    r = coverage.sentence_coverage(s, g, "d", [0.75]).first()
    assert (r.source_coverage_075, r.generation_support_075) == (0.5, 1.0)


def test_only_missing_keys_are_computed(spark):
    rows = spark.createDataFrame([(k, k) for k in "abc"], "cache_key string, v string")
    cache = spark.createDataFrame([("a", 1), ("z", 9)], "cache_key string, n int")
    out, whole = coverage.incremental(rows, cache, lambda df: df.select("cache_key", F.lit(2).alias("n")))
    assert {r.cache_key: r.n for r in out.collect()} == {"a": 1, "b": 2, "c": 2}
    assert {r.cache_key: r.n for r in whole.collect()} == {"a": 1, "z": 9, "b": 2, "c": 2}


def test_precision_and_bounds(spark):
    claims = spark.createDataFrame([("a", "supported"), ("b", "unverifiable")], "n string, verdict string")
    got = {r.n: r for r in evaluation.claim_precision(claims, "n").collect()}
    assert got["a"].score == pytest.approx(math.exp(-9)) and got["b"].score is None and (got["b"].lower, got["b"].upper) == (0, 1) and got["b"].status == "uncertain"
    assert evaluation.claim_precision(claims, "n", gamma=0).where("n = 'a'").first().score == 1
    units = spark.createDataFrame([(n, "u") for n in "abc"], "n string, unit_id string")
    decisions = spark.createDataFrame([("a", "u", "covered"), ("c", "u", "uncertain")], "n string, unit_id string, verdict string")
    cov = {r.n: (r.score, r.status, r.lower, r.upper) for r in evaluation.source_coverage(units, decisions, "n").collect()}
    assert cov == {"a": (1, "completed", 1, 1), "b": (None, "partial", 0, 1), "c": (0, "uncertain", 0, 1)}


def double():
    def model(prompt, limit):
        """A deterministic double: writes what it is given, shortens by halves."""
        task, data = prompt.split("\n")[1], json.loads(prompt.split("\nDATA\n", 1)[1])
        if "SUMMARIZE" in task:
            out = {"summary": " ".join(i["text"][:30] for i in data["items"]) + "."}
        elif "THEMES" in task:
            out = {"themes": [{"title": "One"}, {"title": "Two", "description": "d"}]}
        elif "ROUTE" in task:
            out = {"assignments": [{"chunk_id": c["id"], "theme_ids": ["T01", "T02"] if len(c["text"]) > 40 else [], "reason": "short"} for c in data["chunks"]]}
        elif "WRITE" in task:
            out = {"paragraphs": [{"text": c["text"]} for c in data["chunks"]]}
        else:
            out = {"paragraphs": [" ".join(p["text"].split()[: max(1, len(p["text"].split()) // 2)]) for p in data["paragraphs"]]}
        return Reply(json.dumps(out))

    return model


model = double()  # a closure goes to workers by value


def test_generation(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Document {i} says this. " * (1 + i % 9)) for i in range(60)], "doc_id long, text string")
    options = generation.Options(chunk_chars=100, overlap_chars=10, max_words=60)
    run = generation.generate(spark, model, docs, str(tmp_path / "run"), options)
    assert sorted(run.narratives) == ["T01", "T02"] and all(0 < len(t.split()) <= 60 for t in run.narratives.values())
    assert run.routed.count() == run.chunks.count() == run.routed.select("chunk_id").distinct().count()
    spans = run.written.select(F.explode("spans").alias("s")).select("s.*").distinct()
    assert spans.join(run.chunks, (F.col("chunk_id") == F.col("id")) & (spans.start == run.chunks.start) & (spans.end == run.chunks.end), "left_anti").isEmpty()

    def silent(prompt, limit):
        raise AssertionError("a stored stage called the model")

    again = generation.generate(spark, lambda p, n: model(p, n) if "THEMES" in p.split("\n")[1] else silent(p, n), docs, str(tmp_path / "run"), options)
    assert again.narratives == run.narratives
    with pytest.raises(ValueError, match="reduction"):
        generation.Options(reduction="other")


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("﻿Text é".encode())
    (tmp_path / "in/b.csv").write_text('nome;valore\nuno;1\n;\ndue;"tre; incontri"\n', encoding="utf-8")
    (tmp_path / "in/~$c.txt").write_text("lock")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/e.txt").write_text(" \n")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "in/f.docx", "w") as z:
        z.writestr("word/document.xml", body)
    files = documents.discover(spark, [str(tmp_path / "in"), str(tmp_path / "in/a.txt")])
    got = {(r.name, r.page_or_row): r for r in documents.pages(files).collect()}
    assert got["a.txt", None].text == "Text é" and got["b.csv", 4].text == "nome: due\nvalore: tre; incontri" and ("b.csv", 3) not in got
    assert "no reader" in got["d.pdf", None].error and got["e.txt", None].error and got["f.docx", None].text == "One\nx | y\nTwo"
    whole, new = documents.cached_pages(files, None, "v1")
    new.write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert documents.cached_pages(files, cache, "v1")[1].count() == 0
    assert documents.cached_pages(files, cache.withColumn("checksum", F.lit("bad")), "v1")[1].count() == whole.count()
    with pytest.raises(FileNotFoundError):
        documents.discover(spark, [str(tmp_path / "cache/_SUCCESS")])


def test_analysis(spark, tmp_path):
    root = tmp_path / "in"
    for folder, extra in (("benchmark_all_rag", "rag_small"), ("plain", "brief")):
        (root / folder).mkdir(parents=True)
        rows = [f"{m},{p},{extra},{n},{s},{f},{c}" for c in ("c1", "c2", "c3") for m, n in (("gemma3:4b", 80), ("qwen3:1.7b", 70)) for p in ("short", "detailed") for s, f in ((1.5, "no"), (2.5, "Timeout"))]
        (root / folder / "nrs_runs.csv").write_text("model_name,prompt,input_strategy,nrs,seconds,failure,case_id\n" + "\n".join(rows) + f"\nx:1b,short,{extra},,1,no,c1\n")
    (root / "tables").mkdir()
    (root / "tables/nrs_runs.csv").write_text("NRS\n1\n")
    loaded, files = runs.load_runs(spark, str(root))
    assert loaded.count() == 48 and {r.input_strategy for r in files.collect()} == {"rag", "brief"}
    assert {(r.family, r.parameters_b) for r in loaded.select("family", "parameters_b").distinct().collect()} == {("gemma3", 4.0), ("qwen3", 1.7)}
    out = run_analysis(spark, str(root), str(tmp_path / "out"))
    assert out["runs"] == 48 and out["models"] == 2
    assert json.loads((tmp_path / "out/analysis_summary.json").read_text())["runs"] == 48
    assert "best_tradeoff" in (tmp_path / "out/report.md").read_text()
    with zipfile.ZipFile(tmp_path / "out/analysis.zip") as z:
        assert "report.html" in z.namelist() and "figures/07_frontier.svg" in z.namelist()
    for f in (tmp_path / "out/figures").iterdir():
        ElementTree.parse(f)
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.write(root / "plain/nrs_runs.csv", "plain/nrs_runs.csv")
    assert runs.load_runs(spark, str(tmp_path / "in.zip"), str(tmp_path / "unzipped"))[0].count() == 24


def test_sinks(tmp_path):
    sinks.write_json({"a": float("nan"), "b": [1, float("inf")]}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": None, "b": [1, None]}
    with pytest.raises(FileExistsError):
        sinks.write_json({}, str(tmp_path / "x.json"), exclusive=True)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("m", "rag", 80.0, 1.0, False, True, 4.0), ("m", "rag", 60.0, 2.0, True, False, 4.0)], "model string, input_strategy string, NRS double, runtime_seconds double, failed boolean, success boolean, parameters_b double")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming.live_summary(streaming.arriving(spark, str(tmp_path / "in"), rows.schema), ["model"], "live", str(tmp_path / "cp1"))
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").first().mean_NRS == 70
    keyed = streaming.arriving(spark, str(tmp_path / "in"), rows.schema).withColumnRenamed("model", "cache_key")
    q = streaming.only_new(keyed, str(tmp_path / "cache"), lambda df: df.select("cache_key"), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_runs_are_dealt_by_supplier(spark, tmp_path):
    """Before what is grouped by model is shuffled, a task has all runs of a model."""
    tables = {
        "lineitem": ("l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string", [(i, i % 3, 1.0, 9.0, "A", "F") for i in range(9)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string", [(i, 1, "5-LOW") for i in range(9)]), "customer": ("c_custkey long, c_mktsegment string", [(1, "x")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(i, f"m{i}", 0) for i in range(3)]), "nation": ("n_nationkey int, n_name string", [(0, "n")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    found = adapter.runs(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" in plan and found.count() == 9
