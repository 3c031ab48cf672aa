"""Operator 1: drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Carried, ascii_lower, documents, stored


#: Parts into which the rows of one line are dealt when they meet what is known of it.
SALTS = 16


def _having(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of `rows` whose line is among `lines`.  A line may be in a third of all documents, so its rows are
    dealt over `SALTS` tasks by their place."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    salted = rows.withColumn("__salt", F.pmod(F.hash("__id", "__of", "__at"), F.lit(SALTS)))
    return salted.join(lines.select("__h", "__g", salts), ["__h", "__g", "__salt"], "left_semi").drop("__salt")


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` without the lines found in at least `min_docs` documents.

    A text is split at each \\n.  A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased.  Keys of at least `min_chars` code points that at least `min_docs` distinct ids have
    lose all their lines; the other lines stay as they are, in their order, joined by \\n.  Adds
    `n_lines` (before) and `n_dropped`.

    Lines are exploded as 128 bits of hash, not as text.  Lines that occur too seldom are
    sorted out by a count that is combined before its shuffle; only for the rest are distinct
    documents counted, and only their positions go back to the texts.

    Null and empty texts have one empty line, which stays: the result is ''.  Rows with a null id
    count as one document.  Repeated rows count once and each get their result.  A text is one row however long it is: its lines are
    exploded as hashes and it is cut once more where they are dropped.  An empty table gives an empty one.  Any other column
    is kept; `n_lines` and `n_dropped` replace input columns of those names.
    """
    c = Carried(docs)
    doc = F.col("__id")
    text = F.coalesce(c.col(text_col), F.lit(""))
    cut = F.split(ascii_lower(text), "\n")
    keys = F.transform(cut, lambda x: F.trim(x, F.lit(ASCII_SPACE)))
    rows = c.df.select(c.col(id_col).alias("__id"), F.xxhash64(text).alias("__of"), F.posexplode(keys).alias("__at", "__key"))
    rows = rows.where(F.length("__key") >= max(1, min_chars))
    rows = rows.select("__id", "__of", "__at", F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit(1), F.col("__key")).alias("__g"))
    often = rows.groupBy("__h", "__g").count().where(F.col("count") >= min_docs).drop("count")
    rows = stored(_having(rows, often))
    common = rows.select("__id", "__h", "__g").distinct().groupBy("__h", "__g").count().where(F.col("count") >= min_docs).drop("count")
    gone = _having(rows, common).groupBy("__id", "__of").agg(F.collect_set("__at").alias("__gone"))
    gone = gone.select(doc.alias("__gone_id"), F.col("__of").alias("__gone_of"), "__gone")
    whole = c.df.withColumn("__of", F.xxhash64(text))
    joined = whole.join(gone, c.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.col("__of") == F.col("__gone_of")), "left")
    joined = joined.withColumn("__lines", F.split(text, "\n"))
    n = F.size("__lines").cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return c.restore(joined, **{text_col: kept, "n_lines": n, "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT a.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed a LEFT JOIN common c ON a.k = c.k GROUP BY a.doc_id
"""
