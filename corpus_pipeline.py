"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return the
columns of documents; `n_chars` follows the text.  Null texts count as empty, and are '' behind the second stage; an empty table passes
through as an empty one.  What is fitted or counted comes from the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, line_dedup, near_copies, sentencepiece_bpe, toxicity
from tallyspark.llm.common import Carried, documents, stored

#: The stages' classifier, whole-table statistics and choice of one of a group have no form in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents predicted as toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    c = Carried(docs)
    scored = toxicity.score_toxicity(c.df.withColumn("text", c.col("text")), model)
    return c.restore(scored.where("predicted = 0"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines that ten documents share go; every document stays, if need be without a line."""
    c = Carried(docs)
    packed = c.df.select(c.col("doc_id").alias("doc_id"), c.col("text").alias("text"), *[F.col(k) for k in c.df.columns])
    out = line_dedup.drop_common_lines(packed)
    return c.restore(out, text="text", n_chars=F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 on five words and a similarity of 0.8: of each group of near copies the document with the smallest id stays."""
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a passage of the benchmark go."""
    return decontamination.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids, with what shows that they decode to the text."""
    out = sentencepiece_bpe.encode_decode(docs, sentencepiece_bpe.public_model(), texts=False)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Between stages the rows are a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
