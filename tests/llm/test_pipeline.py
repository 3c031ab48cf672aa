import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, docs, prose, tmp_path):
    """A corpus with a case for every stage.  Returns the folder and the ids that are to stay."""
    rows, labels = [], []
    for i in range(120):
        toxic = i % 6 == 0
        rows.append((i, prose(60, i, 4000) + (" vilestuff vilething" * 2 if toxic else "")))
        labels.append((i, int(toxic)))
    clean = {i for i, y in labels if not y}
    item = prose(40, 9000)
    rows += [(200, rows[1][1] + "\n" + rows[2][1]), (201, rows[1][1] + "\n" + rows[2][1]), (202, prose(30, 77) + " " + item), (203, None), (204, "")]
    rows += [(300 + i, f"A shared line\n{prose(50, 500 + i)}") for i in range(12)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), clean | {200, 203} | {300 + i for i in range(12)}


def test_stages_and_whole(spark, folder):
    sf_dir, stay = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == stay
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any("A shared line" in t for t in texts.values())
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == stay
    for r in whole:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.token_ids) == r.n_tokens


def test_an_empty_corpus(spark, folder, tmp_path_factory):
    sf_dir, _ = folder
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_odd_rows(spark, folder):
    """Null ids, repeated rows, ties, a very long text, and columns whose names clash with those inside."""
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 20")
    long = spark.createDataFrame([(900, "long " * 100_000 + "end", "en", "s", 500_003), (None, "no id", "en", "s", 5), (None, None, None, None, None), (901, None, "en", None, None)], docs.schema)
    more = docs.union(long).union(docs.where("doc_id < 4")).selectExpr("*", "1 AS score", "'x' AS __text", "2 AS Doc_Id2", "3 AS n_lines", "4 AS fingerprint", "5 AS node")
    now = more
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns[:5] == COLUMNS and {"__text", "Doc_Id2", "node"} <= set(now.columns)
        now = spark.createDataFrame(now.collect(), now.schema)
    ids = [r.doc_id for r in now.collect()]
    told = [i for i in ids if i is not None]
    assert 900 in ids and None in ids and len(told) == len(set(told)) and {1, 2, 3} <= set(told)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() == len(ids)
