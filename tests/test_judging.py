import json

import pytest
from pyspark.sql import functions as F

from tallyspark.__main__ import main, weights
from tallyspark.functions.replies import Invalid, Reply
from tallyspark.operators import judging
from tallyspark.sources.models import Served, base_url, without_think

CONTEXT = [{"id": "P1", "document_id": "D1", "page_index": 0, "start": 100, "text": "The church was built in 1200."}]


def double(replies):
    said = iter(replies)
    return lambda prompt, limit: Reply(json.dumps(next(said)))


def test_claims():
    text = "The church was built in 1200. It was built in 1200."
    extracted = {"claims": [{"text": "Built in 1200", "quote": "built in 1200", "occurrence": 1}, {"text": " built  in 1200 ", "quote": "built in 1200"}]}
    verdict = {"verdict": "supported", "explanation": "x", "evidence": [{"context_id": "P1", "quote": "built in 1200"}]}
    out = judging.claims(double([extracted, verdict]), text, CONTEXT)
    assert len(out["claims"]) == 1 and len(out["duplicates_removed"]) == 1
    assert out["claims"][0]["evidence"][0]["start"] == 100 + 15 and out["claims"][0]["narrative_span"]["start"] == text.rfind("built")
    with pytest.raises(Invalid):
        judging.claims(double([extracted] + [verdict | {"evidence": []}] * 3), text, CONTEXT)


def test_units_and_decisions(spark):
    passages = spark.createDataFrame([("D1", 0, 100, CONTEXT[0]["text"])], "document_id string, page_index int, start int, text string")
    model = lambda p, n: Reply(json.dumps({"units": [{"text": "Built 1200", "quote": "in 1200"}], "verdict": "covered", "explanation": "e", "narrative_evidence": [{"quote": "1200"}]}))
    units = judging.proposed_units(model, passages, "all")
    r = units.first()
    assert (r.start, r.end, r.quote) == (121, 128, "in 1200")
    told, manifest = judging.frozen(units.withColumn("relevance", F.lit("relevant")).withColumn("holds", F.lit(True)), "c" * 64, "all", "me", "now")
    judging.validate(manifest, "c" * 64, told)
    with pytest.raises(ValueError, match="units were changed"):
        judging.validate(manifest, "c" * 64, told.withColumn("text", F.lit("Other")))
    with pytest.raises(ValueError, match="units were changed"):
        judging.validate(manifest, "c" * 64, told.limit(0))
    with pytest.raises(ValueError, match="changed"):
        judging.validate(manifest | {"units": 2}, "c" * 64, told)
    assert judging.decisions(model, told, "Since 1200.").first().verdict == "covered"
    with pytest.raises(ValueError, match="units need"):
        judging.frozen(units.withColumn("relevance", F.lit("uncertain")).withColumn("holds", F.lit(True)), "c", "a", "b", "d")


def test_metrics(tmp_path):
    def broken(_):
        raise RuntimeError("no")

    got = judging.run_metrics({"a": lambda i: {"status": "completed", "score": 1.0}, "b": broken, "c": None, "d": lambda i: {"status": "completed", "score": float("nan")}}, {"x": 1}, str(tmp_path))
    assert got == {"a": "completed", "b": "failed", "c": "unsupported", "d": "failed"}
    assert json.loads((tmp_path / "b.json").read_text())["score"] is None
    with pytest.raises(FileExistsError):
        judging.run_metrics({"a": None}, {}, str(tmp_path))


def test_models():
    assert base_url("box") == "http://box:11434" and base_url("https://x.org/") == "https://x.org" and base_url(None).endswith("127.0.0.1:11434")
    assert without_think("<think>a\nb</think> c") == "c"
    assert Served("m", "127.0.0.1:9", timeout=2)("p", 5).error
    with pytest.raises(ValueError, match="temperature"):
        Served("m", temperature=3)


def test_command_line(spark, tmp_path, capsys):
    assert weights("1,2,3,4,5")["reliability"] == 5 and weights('{"NRS": 1}') == {"NRS": 1.0}
    (tmp_path / "a.txt").write_text("one two\nthree")
    main(["count-words", str(tmp_path / "a.txt")])
    assert "a.txt\t3\t13" in capsys.readouterr().out
