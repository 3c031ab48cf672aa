import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import parse, replies, text
from tallyspark.functions.numeric import ci95, quadratic_kappa, spearman
from tallyspark.operators.tradeoff import undominated


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("Timeout", True), ("ok", False), ("maybe", False), (None, False), ("2.0", False), ("1", True), ("0", False), (" YES ", True), ("", False), ("nan", False), ("1f", False), ("inf", False)])
def test_truth(spark, value, want):
    assert one(spark, value, parse.truth) is want


@pytest.mark.parametrize(("value", "want"), [("2.0", True), ("0", False), ("0.0", False), ("-1e3", True), (None, False), ("", False), ("nan", False)])
def test_truth_of_a_column_of_numbers(spark, value, want):
    assert one(spark, value, lambda x: parse.truth(x, numeric=True)) is want


@pytest.mark.parametrize(("values", "want"), [(["1", "2.0", None, ""], True), (["1", "no"], False), (["1", "1f"], False), ([None, ""], False)])
def test_all_numerals(spark, values, want):
    assert spark.createDataFrame([(v,) for v in values], "x string").agg(parse.all_numerals(F.col("x")).alias("y")).first().y is want


@pytest.mark.parametrize(("p", "m", "want"), [("4B", None, 4), ("4000M", None, 4), ("4", None, 4), ("4000000000", None, 4), ("0", None, None), ("-1", None, None), (None, "gemma3:4b", 4), (None, "qwen3:1.7b-instruct", 1.7), ("7 billion", "x:4b", 7), ("5000", None, 5), (None, "unknown", None), ("nan", None, None), ("1f", None, None), ("inf", None, None), ("1e3", None, 1000)])
def test_parameters(spark, p, m, want):
    df = spark.createDataFrame([(p, m)], "p string, m string")
    assert df.select(parse.parameters_b(F.col("p"), F.col("m")).alias("y")).first().y == want


@pytest.mark.parametrize(("m", "want"), [("gemma3:4b", "gemma3"), ("Llama3.1:8b", "llama"), ("deepseek-r1", "deepseek"), (None, "unknown"), ("", "unknown"), ("Yi_34:x", "yi-34"), ("123", "123")])
def test_family(spark, m, want):
    assert one(spark, m, parse.model_family) == want


def test_sizes(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0, 2.1, 8.0, 16.0, 17.0, None, -1.0)], "b double")
    assert [r[0] for r in df.select(parse.size_bin(F.col("b"))).collect()] == ["<=2B", "<=2B", ">2-4B", ">4-8B", ">8-16B", ">16B", None, None]
    assert [r[0] for r in df.select(parse.size_bucket(F.col("b"))).collect()] == ["<=2B", "<=2B", "<=4B", "<=8B", "<=16B", ">16B", "unknown", "<=2B"]


@pytest.mark.parametrize(("pairs", "want"), [([(1, 1), (5, 5)], 1), ([(1, 5), (5, 1)], -1), ([(1, 1), (2, 3), (3, 2), (4, 4)], 0.8), ([(3, 3), (3, 3)], None), ([(1, 1)], None)])
def test_kappa(spark, pairs, want):
    got = spark.createDataFrame(pairs, "a int, b int").agg(quadratic_kappa("a", "b").alias("k")).first().k
    assert got == (None if want is None else pytest.approx(want))


def test_ci_and_rank_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 2.0, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.r for r in spearman(df, ["g"], {"r": ("x", "y")}).collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1, 2.5, 2.5], [1, 2, 3])[0, 1]) and got["b"] is None and got["c"] is None
    assert df.where("g = 'c'").agg(ci95(F.col("x")).alias("c")).first().c is None


def test_text(spark):
    assert one(spark, "Alpha one. Beta two? Gamma three! x.", text.sentences) == ["Alpha one.", "Beta two?", "Gamma three!"]
    assert one(spark, "école 12 naïve", text.term_count) == 3
    assert one(spark, "  A b \n c ", text.word_count) == 3
    assert one(spark, "Hello, World!", text.phrase) == "hello world"
    assert one(spark, "", text.text_quality) == 0 and one(spark, "x" * 10, text.text_quality) == pytest.approx(0.1)
    assert one(spark, "a" * 30 + " " + "b" * 30, lambda c: text.title(c, 40)) == "a" * 30 + "…"
    assert one(spark, "aaa", lambda c: text.quoted_start(c, F.lit("aa"), 1)) == 1
    assert one(spark, "x<think>\ny</think>z", text.without_think) == "xz"
    assert one(spark, "# T\nbody", text.without_heading) == "body"
    assert one(spark, "```markdown\nx\n```", text.without_fence) == "x"


def test_sentences_keep_the_digits_at_their_ends(spark):
    assert one(spark, "0 at first. 19.37.233.111 Then 2 is 2. 33 ends 3", text.sentences) == ["0 at first.", "19.37.233.111 Then 2 is 2.", "33 ends 3"]


def test_frontier_of_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    want = np.array([not any((o <= r).all() and (o < r).any() for o in x) for r in x])
    assert (undominated(x) == want).all()


def test_replies():
    want = ["First.", "Second."]
    for shape in [{"paragraphs": [{"text": "First."}, {"text": "Second."}]}, {"paragraphs": want}, {"paragraphs": "First.\n\nSecond."}, {"text": "First.\n \nSecond."}, {"summary": want}, {"narrative": {"paragraphs": want}}, ["First.", {"text": "Second."}], "First.\n\nSecond."]:
        assert replies.paragraphs(shape) == want
    with pytest.raises(ValueError, match="other"):
        replies.paragraphs({"other": 1})
    long = " ".join(f"Sentence number {i} is here." for i in range(40))
    short = replies.bounded(long, 140)
    assert replies.json_bytes(short) <= 140 and short.startswith("Sentence number 0") and short.endswith("39 is here.")
    assert replies.json_bytes(replies.bounded("é" * 500, 128)) <= 128
    assert replies.capped(["one two three. four five", "six"], 4) == ["one two three."] and replies.capped(["a b", "c d,"], 3) == ["a b", "c."]
    assert replies.json_bytes(replies.tail("word " * 900)) <= 1600
    assert replies.json_bytes(replies.tail("é" * 3000)) <= 1600 and replies.tail("a b") == "a b"
    assert replies.short_title("x " * 80) == "x " * 48 + "x…" and replies.short_title("y" * 200) == "y" * 99 + "…"
    assert replies.capped(["a b c"], 0) == [] and replies.capped(["Done. (So.) Then more"], 3) == ["Done. (So.)"] and replies.capped(["a", "b"], 5) == ["a", "b"]
    with pytest.raises(ValueError, match="deep"):
        replies.paragraphs([[[[[[[["x"]]]]]]]])


def test_calls_retry_and_tell():
    said = iter([replies.Reply("no"), replies.Reply('{"a": 1', truncated=True), replies.Reply('```json\n{"a": 2}\n```')])
    limits = []

    def model(prompt, limit):
        limits.append(limit)
        return next(said)

    caller = replies.Caller(model, replies.Budget(output=400, retries=2))
    assert caller.call("PHASE: X", {"max_words": 100}, lambda o: o["a"], output=100) == 2
    assert limits == [100, 100, 200] and [e["error"] is None for e in caller.events] == [False, False, True]
    with pytest.raises(replies.Truncated):
        replies.Caller(lambda p, n: replies.Reply("{", truncated=True), replies.Budget()).call("T", {}, lambda o: o)
    with pytest.raises(replies.Invalid):
        replies.Caller(lambda p, n: replies.Reply('{"a": NaN}'), replies.Budget()).call("T", {}, lambda o: o)
