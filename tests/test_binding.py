"""Annotations belong to one text and one corpus."""

import hashlib

from tallyspark.operators.evaluation import binding


def test_binding(spark):
    sha = hashlib.sha256("A text.".encode()).hexdigest()
    narratives = spark.createDataFrame([("n", "A text.", "c0"), ("empty", None, None)], "name string, text string, corpus_sha256 string")
    rows = [
        (1, "n", sha, "c0", "ada", "2020"), (2, "n", sha.upper(), "C0", "ada", "2020"), (3, "m", sha, "c0", "ada", "2020"), (4, "n", "0" * 64, "c0", "ada", "2020"),
        (5, "n", sha, "c1", "ada", "2020"), (6, "n", sha, "c0", " \t", "2020"), (7, "n", sha, "c0", "ada", None), (8, None, None, None, None, None), (9, "empty", sha, "c0", "ada", "2020"),
    ]
    annotations = spark.createDataFrame(rows, "k int, name string, narrative_sha256 string, corpus_sha256 string, annotator string, annotated_at string")
    got = {r.k: r.problem for r in binding(annotations, narratives, "name").collect()}
    assert got == {
        1: None, 2: None, 3: "unknown narrative", 4: "another narrative", 5: "another corpus", 6: "annotator or time missing", 7: "annotator or time missing",
        8: "unknown narrative", 9: "another narrative",
    }
    assert binding(annotations.limit(0), narratives, "name").columns == [*annotations.columns, "problem"]
