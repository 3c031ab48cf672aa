"""Queries over texts, vectors, ratings and logs, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import parse, text
from tallyspark.functions.numeric import safe_divide
from tallyspark.operators import chunking, coverage, evaluation
from tallyspark.plans.adapter import RUNS_SQL, runs, table
from tallyspark.plans.compare import of_tables, rounded_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def _of_text(name: str, sql: str, others: str = "", **columns) -> None:
    """A query of expressions of each document's text."""
    QUERIES[name] = of_tables(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()]))
    ORACLE_SQL[name] = rounded_sql(f"SELECT doc_id, {sql} FROM documents", others)


_WS = r"[\s\p{Z}\x85]"
_TRIM = f"regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"
_TERMS = r"len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+'))"
_of_text("word_count_ws", r"len(regexp_extract_all(text, '[^\s\p{Z}\x85]+')) AS n_words", n_words=text.word_count)
_of_text("word_count_unicode", f"{_TERMS} AS n_terms", n_terms=text.term_count)
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({_TRIM}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 2)"
_of_text("sentence_split", f"len({_SENTENCES}) AS n_sentences, md5(array_to_string({_SENTENCES}, '|')) AS digest", "digest", n_sentences=lambda t: F.size(text.sentences(t)).cast("long"), digest=lambda t: F.md5(F.array_join(text.sentences(t), "|")))
_PUNCT = r"[!-/:-@\[-`{-~]"
_of_text("normalize_phrase", rf"md5(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '{_PUNCT}', '', 'g'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g')) AS digest", "digest", digest=lambda t: F.md5(text.phrase(t)))
_Q = rf"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"
_of_text(
    "text_quality",
    rf"""CASE WHEN length({_Q}) = 0 THEN 0 WHEN length({_Q}) < 20 THEN least(0.2, length({_Q}) / 100.0) ELSE 0.45 * len(regexp_extract_all({_Q}, '[\p{{L}}\p{{N}}]')) / length({_Q}) + 0.25 * len(regexp_extract_all({_Q}, '[^\p{{C}}\p{{Z}}]| ')) / length({_Q})
      + 0.30 * least(1.0, {_TERMS} / 25.0) END AS quality""", quality=text.text_quality)
_of_text("byte_budget", "strlen(text) AS n_bytes, length(text) AS n_points, strlen(text) + 512 + 1200 + 256 <= 8192 AS fits", "fits", n_bytes=lambda t: text.token_estimate(t).cast("long"), n_points=lambda t: F.length(t).cast("long"), fits=lambda t: text.fits(text.token_estimate(t), 8192, 1200, 256, 512))
_of_text("content_hash", "sha256(text) AS sha256", "sha256", sha256=lambda t: F.sha2(F.encode(t, "UTF-8"), 256))
_HEAD = f"left({_TRIM}, 39)"
_of_text(
    "title_shorten",
    rf"CASE WHEN length({_TRIM}) <= 40 THEN {_TRIM} ELSE rtrim(CASE WHEN contains(substring({_HEAD}, 2), ' ') THEN regexp_replace({_HEAD}, '^(.+) [^ ]*$', '\1') ELSE {_HEAD} END) || '…' END AS title", "title", title=lambda t: text.title(t, 40))
_of_text("strip_think", "md5(regexp_replace('<think>' || left(text, 50) || '</think>' || text, '(?is)<think>.*?</think>', '', 'g')) AS digest", "digest", digest=lambda t: F.md5(text.without_think(F.concat(F.lit("<think>"), F.substring(t, 1, 50), F.lit("</think>"), t))))
_BLOCKS = rf"list_filter(list_transform(string_split('# ' || lang || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("# "), F.col("lang"), F.lit("\n\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    p = text.markdown_paragraphs(md)
    return _docs(spark, sf_dir, "lang").select("doc_id", text.markdown_title(md).alias("title"), F.size(p).cast("long").alias("n_paragraphs"), F.md5(F.array_join(p, "|")).alias("digest"))


QUERIES["md_split"] = of_tables(_markdown)
ORACLE_SQL["md_split"] = rounded_sql(f"SELECT doc_id, {_BLOCKS}[1] AS title, len({_BLOCKS}) - 1 AS n_paragraphs, md5(array_to_string({_BLOCKS}[2:], '|')) AS digest FROM documents", "title, digest")


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of a text's words, by blanks, as the quote; texts of one word have none."""
    d = _docs(spark, sf_dir).withColumn("quote", F.get(F.split("text", " "), F.lit(1)))
    first, third = (text.quoted_start(F.col("text"), F.col("quote"), k) for k in (0, 2))
    holds = evaluation.span_holds(F.col("text"), first, first + F.length("quote"), F.col("quote"))
    return d.select("doc_id", first.cast("long").alias("first_start"), third.cast("long").alias("third_start"), holds.alias("holds"))


QUERIES["quoted_span"] = of_tables(_quoted)
ORACLE_SQL["quoted_span"] = rounded_sql(
    """SELECT doc_id, nullif(a, 0) - 1 AS first_start, CASE WHEN b > 0 AND c > 0 THEN a + b + c - 1 END AS third_start, a > 0 AS holds FROM (
      SELECT *, CASE WHEN b > 0 THEN instr(substring(text, a + b + 1), quote) ELSE 0 END AS c FROM (SELECT *, CASE WHEN a > 0 THEN instr(substring(text, a + 1), quote) ELSE 0 END AS b FROM (
        SELECT doc_id, text, string_split(text, ' ')[2] AS quote, CASE WHEN trim(coalesce(string_split(text, ' ')[2], '')) <> '' THEN instr(text, string_split(text, ' ')[2]) ELSE 0 END AS a FROM documents)))""", "holds")

# Run tables as text.
_RAW = "CASE p_partkey % 7 WHEN 0 THEN (p_size || 'B') WHEN 1 THEN (p_size * 1000 || ' million') WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size * 1000000000::BIGINT AS VARCHAR) WHEN 4 THEN '-1' WHEN 5 THEN 'n/a' END"
_MODEL = "CASE p_partkey % 4 WHEN 0 THEN 'Gemma' || (p_partkey % 3) || ':' || (p_size % 9) || 'b' WHEN 1 THEN 'llama-x_' || (p_size % 9) || 'b-instruct' WHEN 2 THEN 'Deep Seek/' || p_brand ELSE 'qwen' || (p_size % 4) || '.5:latest' END"
_FLAG = "CASE p_partkey % 8 WHEN 0 THEN ' Timeout ' WHEN 1 THEN 'ok' WHEN 2 THEN 'maybe' WHEN 3 THEN '2.0' WHEN 4 THEN '0' WHEN 5 THEN 'YES' WHEN 6 THEN '' END"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    spark_sql = lambda s: F.expr(s.replace("::BIGINT", "L").replace("AS VARCHAR", "AS STRING"))
    return p.select("p_partkey", spark_sql(_RAW).alias("parameters"), spark_sql(_MODEL).alias("model"), spark_sql(_FLAG).alias("failed"))


QUERIES["parse_bool"] = of_tables(lambda s, d: _raw(s, d).select("p_partkey", parse.truth(F.col("failed")).alias("failed")))
ORACLE_SQL["parse_bool"] = "SELECT p_partkey, p_partkey % 8 IN (0, 5) AS failed FROM part"  # ' Timeout ' and 'YES'; '2.0' among other texts is none
QUERIES["parse_parameters"] = of_tables(lambda s, d: (r := _raw(s, d).withColumn("parameters_b", parse.parameters_b(F.col("parameters"), F.col("model")))).select("p_partkey", "parameters_b", parse.size_bin(r.parameters_b).alias("size_bin"), parse.size_bucket(r.parameters_b).alias("size_bucket")))


def _told(x: str) -> str:
    unit = r"([0-9]+(?:\.[0-9]+)?)\s*(b|bn|billion|m|mn|million)\b"
    amount = f"try_cast(regexp_extract(lower(trim({x})), '{unit}', 1) AS DOUBLE)"
    return f"coalesce(CASE WHEN starts_with(regexp_extract(lower(trim({x})), '{unit}', 2), 'b') THEN {amount} ELSE {amount} / 1000 END, try_cast(regexp_extract(lower(trim({x})), '[:_/-]([0-9]+(?:\\.[0-9]+)?)b(?:\\b|[_/-])', 1) AS DOUBLE))"


_PLAIN = "CASE WHEN n <= 0 THEN NULL WHEN n <= 1000 THEN n WHEN n < 1e6 THEN n / 1000 ELSE n / 1e9 END"
ORACLE_SQL["parse_parameters"] = rounded_sql(
    f"""SELECT p_partkey, b AS parameters_b, CASE WHEN b < 0 THEN NULL WHEN b <= 2 THEN '<=2B' WHEN b <= 4 THEN '>2-4B' WHEN b <= 8 THEN '>4-8B' WHEN b <= 16 THEN '>8-16B' WHEN b > 16 THEN '>16B' END AS size_bin,
      CASE WHEN b IS NULL THEN 'unknown' WHEN b <= 2 THEN '<=2B' WHEN b <= 4 THEN '<=4B' WHEN b <= 8 THEN '<=8B' WHEN b <= 16 THEN '<=16B' ELSE '>16B' END AS size_bucket
    FROM (SELECT p_partkey, coalesce({_told('p')}, {_told('m')}, {_PLAIN}) AS b FROM (SELECT p_partkey, {_RAW} AS p, {_MODEL} AS m, try_cast({_RAW} AS DOUBLE) AS n FROM part))""", "size_bin, size_bucket")
QUERIES["parse_family"] = of_tables(lambda s, d: _raw(s, d).select("p_partkey", parse.model_family(F.col("model")).alias("family")))
ORACLE_SQL["parse_family"] = f"""SELECT p_partkey, CASE WHEN starts_with(b, 'llama') THEN 'llama' WHEN starts_with(b, 'deepseek') THEN 'deepseek' WHEN starts_with(b, 'gemma') OR starts_with(b, 'qwen') THEN b
  ELSE replace(regexp_extract(b, '^([a-z]+(?:[._-]?[0-9]+)?)', 1), '_', '-') END AS family
FROM (SELECT p_partkey, regexp_replace(regexp_replace(split_part(lower(trim({_MODEL})), ':', 1), '[^a-z0-9._-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS b FROM part)"""
QUERIES["case_label"] = of_tables(lambda s, d: table(s, d, "customer").groupBy(parse.case_study(F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment"))).alias("case_study"), F.concat_ws("_", "c_nationkey", "c_mktsegment").alias("label")).agg(F.count("*").alias("n")))
ORACLE_SQL["case_label"] = "SELECT coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'unknown_case') AS case_study, c_nationkey || '_' || c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL"

# Cutting.
SIZE, OVERLAP = 300, 30


def _digested(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("position").cast("long").alias("position"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.md5("text").alias("digest"))


QUERIES["chunk_overlap"] = of_tables(lambda s, d: _digested(chunking.chunks(_docs(s, d), size=SIZE, overlap=OVERLAP)))
ORACLE_SQL["chunk_overlap"] = rf"""WITH RECURSIVE t AS (SELECT doc_id, {_TRIM} AS t FROM documents), ends AS (
  SELECT doc_id, t, 1::BIGINT AS position, 0::BIGINT AS s, length(t) AS n FROM t WHERE length(t) > 0
), cut AS (
  SELECT doc_id, t, position, s, n, CASE WHEN s + {SIZE} >= n THEN n ELSE s + CASE WHEN contains(substring(t, s + {SIZE // 2} + 1, {SIZE - SIZE // 2}), ' ') THEN {SIZE} - instr(reverse(substring(t, s + {SIZE // 2} + 1, {SIZE - SIZE // 2})), ' ') ELSE {SIZE} END END AS e FROM ends
  UNION ALL
  SELECT doc_id, t, position + 1, s2, n, CASE WHEN s2 + {SIZE} >= n THEN n ELSE s2 + CASE WHEN contains(substring(t, s2 + {SIZE // 2} + 1, {SIZE - SIZE // 2}), ' ') THEN {SIZE} - instr(reverse(substring(t, s2 + {SIZE // 2} + 1, {SIZE - SIZE // 2})), ' ') ELSE {SIZE} END END
  FROM (SELECT *, greatest(s + 1, e - {OVERLAP}) AS s2 FROM cut WHERE e < n)
) SELECT doc_id, position, s AS start_at, e AS end_at, md5(substring(t, s + 1, e - s)) AS digest FROM cut"""
QUERIES["passages_lossless"] = of_tables(lambda s, d: _digested(chunking.lossless(_docs(s, d), size=SIZE)))
_STOP = rf"s + {SIZE} - 1 + CASE WHEN regexp_matches(substring(t, s + {SIZE}), '{_WS}') THEN length(regexp_extract(substring(t, s + {SIZE}), '^((?s).*?){_WS}', 0)) ELSE length(substring(t, s + {SIZE})) END"
ORACLE_SQL["passages_lossless"] = f"""WITH RECURSIVE cut AS (
  SELECT doc_id, t, 1::BIGINT AS position, s, length(t) AS n, CASE WHEN s + {SIZE} >= length(t) THEN length(t) ELSE {_STOP} END AS e FROM (SELECT doc_id, text AS t, 0::BIGINT AS s FROM documents WHERE length(text) > 0)
  UNION ALL SELECT doc_id, t, position + 1, s, n, CASE WHEN s + {SIZE} >= n THEN n ELSE {_STOP} END FROM (SELECT doc_id, t, position, e AS s, n FROM cut WHERE e < n)
) SELECT doc_id, position, s AS start_at, e AS end_at, md5(substring(t, s + 1, e - s)) AS digest FROM cut"""
QUERIES["editorial_pieces"] = of_tables(lambda s, d: _digested(chunking.pieces(_docs(s, d), size=SIZE)))
# Word by word: a piece grows while the next word's end is within the size of its start.
ORACLE_SQL["editorial_pieces"] = rf"""WITH RECURSIVE cut AS (
  SELECT doc_id, text AS t, regexp_extract_all(text, '\S+') AS w, string_split_regex(text, '\S+') AS g FROM documents
), words AS (SELECT doc_id, i, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x))), 0) AS s, length(w[i]) AS n FROM (SELECT doc_id, w, g, unnest(range(1, len(w) + 1)) AS i FROM cut)
), fold AS (
  SELECT doc_id, i, s AS start_at, s + n AS end_at, 1::BIGINT AS position FROM words WHERE i = 1
  UNION ALL SELECT f.doc_id, w.i, CASE WHEN w.s + w.n - f.start_at > {SIZE} THEN w.s ELSE f.start_at END, w.s + w.n, CASE WHEN w.s + w.n - f.start_at > {SIZE} THEN f.position + 1 ELSE f.position END FROM fold f JOIN words w ON w.doc_id = f.doc_id AND w.i = f.i + 1
), pieces AS (SELECT doc_id, position, min(start_at)::BIGINT AS start_at, max(end_at)::BIGINT AS end_at FROM fold GROUP BY ALL)
SELECT doc_id, position, start_at, end_at, md5(substring(text, start_at + 1, end_at - start_at)) AS digest FROM pieces JOIN documents USING (doc_id)"""
QUERIES["paragraph_explode"] = of_tables(lambda s, d: _docs(s, d).select("doc_id", F.posexplode(text.paragraphs(F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n \n")))).alias("position", "p")).select("doc_id", F.col("position").cast("long").alias("position"), F.md5("p").alias("digest")))
_PARS = rf"list_filter(list_transform(string_split_regex(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"
ORACLE_SQL["paragraph_explode"] = f"SELECT doc_id, generate_subscripts({_PARS}, 1) - 1 AS position, md5(unnest({_PARS})) AS digest FROM documents"

QUERIES["keyphrases"] = of_tables(lambda s, d: coverage.keyphrases(_docs(s, d), "doc_id", "text"))
ORACLE_SQL["keyphrases"] = r"""WITH runs AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(lower(text), '\p{L}+|[^\p{L}\s]'),
    lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '^\p{L}') THEN w ELSE '|' END), ' '), '|'), lambda p: trim(p)), lambda p: p <> '')) AS phrase FROM documents
), phrases AS (SELECT doc_id, phrase, count(*) AS times, string_split(phrase, ' ') AS w FROM runs GROUP BY ALL),
words AS (SELECT doc_id, phrase, times, len(w) AS size, unnest(w) AS word FROM phrases),
degrees AS (SELECT doc_id, word, sum(times * size)::DOUBLE / sum(times) AS degree FROM words GROUP BY ALL),
scored AS (SELECT doc_id, phrase, round(sum(degree), 6) AS score FROM words JOIN degrees USING (doc_id, word) GROUP BY ALL)
SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS place FROM scored QUALIFY place <= 5"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks packed by theme, in order."""
    c = chunking.chunks(_docs(spark, sf_dir)).select((F.col("doc_id") % 16).alias("theme"), "doc_id", "position", (F.octet_length("text") + 20).cast("long").alias("n_bytes"))
    return chunking.packed(c, "theme", ["doc_id", "position"], "n_bytes", 65_000, 500).groupBy("theme", "batch").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


QUERIES["budget_batches"] = of_tables(_batches)
_CHUNKS = ORACLE_SQL["chunk_overlap"].replace(f"s + {SIZE}", "s + 5000").replace(f"{SIZE // 2} + 1, {SIZE - SIZE // 2}", "2500 + 1, 2500").replace(f"THEN {SIZE} -", "THEN 5000 -").replace(f"ELSE {SIZE} END", "ELSE 5000 END").replace(f"e - {OVERLAP}", "e - 400").replace("s + 150 + 1", "s + 2500 + 1").replace("md5(substring(t, s + 1, e - s)) AS digest", "strlen(substring(t, s + 1, e - s)) + 20 AS n_bytes")
ORACLE_SQL["budget_batches"] = f"""WITH RECURSIVE chunks AS ({_CHUNKS}), items AS (SELECT doc_id % 16 AS theme, n_bytes, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id, position) AS i FROM chunks), fold AS (
  SELECT theme, i, 1 AS batch, 1 AS n, n_bytes AS used, n_bytes FROM items WHERE i = 1
  UNION ALL SELECT theme, i, batch + fresh::INT, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN more ELSE used + 2 + more END, more
  FROM (SELECT f.theme, x.i, f.batch, f.n, f.used, x.n_bytes AS more, f.n = 32 OR f.used + 2 + x.n_bytes > 64500 AS fresh FROM fold f JOIN items x ON x.theme = f.theme AND x.i = f.i + 1)
) SELECT theme, batch, count(*) AS n, sum(n_bytes)::BIGINT AS n_bytes FROM fold GROUP BY ALL"""

# Coverage.
_EMB = lambda s, d, side: table(s, d, "embeddings").where(F.col("vec_id") % 2 == side).select(F.col("label").alias("doc"), F.col("vec_id").alias("sentence"), F.col("embedding").alias("vector"))
QUERIES["sentence_coverage"] = of_tables(lambda s, d: coverage.sentence_coverage(_EMB(s, d, 0), _EMB(s, d, 1), "doc", (0.2, 0.3, 0.4)))


def _covered(side: str, other: str, name: str) -> str:
    return f"SELECT doc, " + ", ".join(f"avg((best >= {t})::INT) AS {name}_{coverage.suffix(t)}" for t in (0.2, 0.3, 0.4)) + f" FROM (SELECT doc, {side}, max(sim) AS best FROM met GROUP BY ALL) GROUP BY doc"


ORACLE_SQL["sentence_coverage"] = rounded_sql(
    f"SELECT * FROM ({_covered('s', 'g', 'source_coverage')}) JOIN ({_covered('g', 's', 'generation_support')}) USING (doc)", "",
    "met AS (SELECT a.label AS doc, a.vec_id AS s, b.vec_id AS g, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document and the benchmark item of its number, as source and generated text."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("generated"))
    return _docs(spark, sf_dir).withColumnRenamed("text", "source").join(b, F.col("doc_id") % b.count() == F.col("item_id"), "left")


QUERIES["compression_ratio"] = of_tables(lambda s, d: coverage.text_measures(_pairs(s, d), "source", "generated").select("doc_id", "source_word_count", "generated_word_count", "compression_ratio", "source_sentence_count"))
ORACLE_SQL["compression_ratio"] = rounded_sql(rf"SELECT doc_id, {_TERMS} AS source_word_count, g AS generated_word_count, g / nullif({_TERMS}, 0) AS compression_ratio, len({_SENTENCES}) AS source_sentence_count FROM documents LEFT JOIN (SELECT item_id, {_TERMS} AS g FROM benchmark) ON doc_id % (SELECT count(*) FROM benchmark) = item_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumns({
        "bertscore_f1": 0.7 + F.col("NRS") / 397.0, "semantic_similarity": 0.5 + F.col("NRS") / 250.0, "source_coverage_075": F.pmod(F.col("runtime_seconds"), F.lit(1.0)),
        "generation_support_075": F.pmod(F.col("runtime_seconds") * 7.0, F.lit(1.0)), "compression_ratio": F.col("word_count") / 50.0,
    })
    return coverage.adjusted(r)


_SCORED = RUNS_SQL + """, scored AS (SELECT *, bertscore_f1 * source_coverage_075 AS coverage_adjusted_bertscore_075, semantic_similarity * source_coverage_075 AS coverage_adjusted_semantic_similarity_075, bertscore_f1 - source_coverage_075 AS omission_risk_075 FROM (
  SELECT *, 0.7 + NRS / 397 AS bertscore_f1, 0.5 + NRS / 250 AS semantic_similarity, runtime_seconds % 1.0::DOUBLE AS source_coverage_075, (runtime_seconds * 7) % 1.0::DOUBLE AS generation_support_075, word_count / 50 AS compression_ratio FROM runs))"""
_GROUPINGS = {"input_strategy": ["input_strategy"], "prompt_strategy": ["prompt_strategy"], "model": ["model", "family", "parameters_b"], "model_strategy_prompt": ["model", "family", "input_strategy", "prompt_strategy", "parameters_b"], "case": ["case_id"], "family": ["family"]}
for _n, _k in _GROUPINGS.items():
    QUERIES[f"coverage_by_{_n}"] = of_tables(lambda s, d, k=_k: coverage.coverage_summary(_scored(s, d), k))
    _means = ", ".join(f"avg({m}) FILTER (WHERE success) AS mean_{m}" if m not in ("entity_coverage", "keyphrase_coverage") else f"NULL::DOUBLE AS mean_{m}" for m in coverage.METRICS)
    ORACLE_SQL[f"coverage_by_{_n}"] = rounded_sql(f"SELECT {', '.join(_k)}, {_means}, count(*) FILTER (WHERE success) AS n_runs, avg(failed::INT) AS failure_rate FROM scored GROUP BY {', '.join(_k)} HAVING n_runs > 0", ", ".join(x for x in _k if x != "parameters_b"), _SCORED)
_HIGH = ["model", "input_strategy", "prompt_strategy", "case_id", "bertscore_f1", "semantic_similarity", "source_coverage_075", "generation_support_075", "compression_ratio", "omission_risk_075"]
QUERIES["high_align_low_cov"] = of_tables(lambda s, d: coverage.aligned_but_uncovered(_scored(s, d), 0.85, 0.10).select(*_HIGH))
ORACLE_SQL["high_align_low_cov"] = rounded_sql(f"SELECT {', '.join(_HIGH)} FROM scored WHERE bertscore_f1 >= 0.85 AND source_coverage_075 <= 0.10", "model, input_strategy, prompt_strategy, case_id", _SCORED)


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are cached, with a stale count; a third of the cache is of no document."""
    d = _docs(spark, sf_dir).withColumn("cache_key", coverage.cache_key([F.col("doc_id"), F.sha2(F.encode("text", "UTF-8"), 256)]))
    cache = d.where("doc_id % 2 = 0").select("cache_key", F.lit(-1).cast("long").alias("n"))
    compute = lambda rows: rows.select("cache_key", text.word_count(F.col("text")).alias("n"))
    out, whole = coverage.incremental(d, cache.unionByName(cache.limit(0)), compute)
    return out.groupBy((F.col("n") < 0).alias("was_cached")).agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_words"))


QUERIES["coverage_cache_merge"] = of_tables(_cached)
ORACLE_SQL["coverage_cache_merge"] = r"SELECT doc_id % 2 = 0 AS was_cached, count(*) AS n_rows, sum(CASE WHEN doc_id % 2 = 0 THEN -1 ELSE len(regexp_extract_all(text, '[^\s\p{Z}\x85]+')) END)::BIGINT AS n_words FROM documents GROUP BY 1"
QUERIES["entity_coverage"] = of_tables(lambda s, d: _pairs(s, d).select("doc_id", text.containment(F.array_distinct(F.split("source", " ")), F.col("generated")).alias("coverage")))
_PHRASE = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '{_PUNCT}', '', 'g'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"
ORACLE_SQL["entity_coverage"] = rounded_sql(
    f"""SELECT doc_id, len(list_filter(p, lambda x: contains(s, {_PHRASE('x')}))) / nullif(len(p), 0) AS coverage
    FROM (SELECT doc_id, {_PHRASE('b.text')} AS s, list_distinct(string_split(d.text, ' ')) AS p FROM documents d LEFT JOIN benchmark b ON doc_id % (SELECT count(*) FROM benchmark) = item_id)""")

# Evaluation.
_LABELS = lambda s, d: table(s, d, "labels").select("doc_id", "quality", "toxic")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters score labelled documents in two dimensions; some scores are missing."""
    r = _LABELS(spark, sf_dir)
    a = r.select("doc_id", F.lit("a").alias("rater"), (F.col("quality") + 1).alias("coherence"), (F.col("toxic") + 1 + F.col("doc_id") % 2).cast("int").alias("relevance"))
    b = r.select("doc_id", F.lit("b").alias("rater"), (F.col("toxic") + 1).alias("coherence"), F.when(F.col("doc_id") % 5 > 0, (F.col("quality") + F.col("doc_id") % 3).cast("int")).alias("relevance"))
    return evaluation.long_ratings(a.unionByName(b), ["doc_id", "rater"], ["coherence", "relevance"])


_RATINGS = """ratings AS (SELECT doc_id, 'a' AS rater, 'coherence' AS dimension, quality + 1 AS score FROM labels UNION ALL SELECT doc_id, 'a', 'relevance', toxic + 1 + doc_id % 2 FROM labels
  UNION ALL SELECT doc_id, 'b', 'coherence', toxic + 1 FROM labels UNION ALL SELECT doc_id, 'b', 'relevance', CASE WHEN doc_id % 5 > 0 THEN quality + doc_id % 3 END FROM labels)"""
QUERIES["quadratic_kappa"] = of_tables(lambda s, d: evaluation.agreement(_ratings(s, d), "doc_id", "rater"))
ORACLE_SQL["quadratic_kappa"] = rounded_sql(
    """SELECT dimension, 1 - avg((a - b) * (a - b)) FILTER (WHERE ok) / nullif(avg(a * a) FILTER (WHERE ok) + avg(b * b) FILTER (WHERE ok) - 2 * avg(a) FILTER (WHERE ok) * avg(b) FILTER (WHERE ok), 0) AS kappa, count(*) FILTER (WHERE ok) AS paired_narratives, count(*) FILTER (WHERE NOT ok) AS excluded_incomplete_pairs, 'completed' AS status
    FROM (SELECT x.dimension, x.score AS a, y.score AS b, x.score IS NOT NULL AND y.score IS NOT NULL AS ok FROM ratings x JOIN ratings y ON x.doc_id = y.doc_id AND x.dimension = y.dimension AND x.rater = 'a' AND y.rater = 'b') GROUP BY dimension""", "dimension, status", _RATINGS)
QUERIES["rating_means"] = of_tables(lambda s, d: evaluation.rating_means(_ratings(s, d)))
ORACLE_SQL["rating_means"] = rounded_sql("SELECT dimension, avg(score) AS mean_score, count(score) AS n_scores, 'completed' AS status FROM ratings GROUP BY dimension", "dimension, status", _RATINGS)
_VERDICT = lambda: F.when(F.col("toxic") == 1, "unsupported").when((F.col("quality") == 0) & (F.col("doc_id") % 10 == 0), "unverifiable").otherwise("supported")
QUERIES["claim_precision"] = of_tables(lambda s, d: evaluation.claim_precision(_LABELS(s, d).select((F.col("doc_id") % 60).alias("narrative"), _VERDICT().alias("verdict")), "narrative"))
ORACLE_SQL["claim_precision"] = rounded_sql(
    """SELECT *, CASE WHEN unverifiable > 0 THEN 'uncertain' ELSE 'completed' END AS status, CASE WHEN unverifiable = 0 THEN supported / denominator * length_penalty END AS score, CASE WHEN unverifiable = 0 THEN supported / denominator END AS raw_precision, supported / denominator AS lower, (supported + unverifiable) / denominator AS upper
    FROM (SELECT *, CASE WHEN denominator < 10 THEN exp(1 - 10.0::DOUBLE / denominator) ELSE 1.0 END AS length_penalty FROM (SELECT doc_id % 60 AS narrative, count(*) AS denominator, count(*) FILTER (WHERE v = 's') AS supported, count(*) FILTER (WHERE v = 'u') AS unsupported, count(*) FILTER (WHERE v = 'q') AS unverifiable
    FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'u' WHEN quality = 0 AND doc_id % 10 = 0 THEN 'q' ELSE 's' END AS v FROM labels) GROUP BY 1))""", "status")


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are the reviewed units of twelve narratives, all others the unreviewed ones of three more."""
    labels = _LABELS(spark, sf_dir)
    narrative = lambda known: F.when(known, F.col("doc_id") % 12).otherwise(12 + F.col("doc_id") % 3).alias("narrative")
    units = _docs(spark, sf_dir).join(labels, "doc_id", "left").select(narrative(F.col("quality").isNotNull()), F.col("doc_id").alias("unit_id"))
    decisions = labels.select(narrative(F.lit(True)), F.col("doc_id").alias("unit_id"), F.when(F.col("quality") == 1, "covered").when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "uncertain").otherwise("not_covered").alias("verdict"))
    return evaluation.source_coverage(units, decisions, "narrative")


QUERIES["source_coverage_bounds"] = of_tables(_bounds)
ORACLE_SQL["source_coverage_bounds"] = rounded_sql(
    """SELECT *, CASE WHEN unreviewed > 0 THEN 'partial' WHEN uncertain > 0 THEN 'uncertain' ELSE 'completed' END AS status, CASE WHEN unreviewed = 0 THEN covered / denominator END AS score, covered / denominator AS lower, (covered + uncertain + unreviewed) / denominator AS upper
    FROM (SELECT CASE WHEN quality IS NULL THEN 12 + doc_id % 3 ELSE doc_id % 12 END AS narrative, count(*) AS denominator, count(*) FILTER (WHERE quality = 1) AS covered, count(*) FILTER (WHERE quality = 0 AND NOT (toxic = 1 AND doc_id % 2 = 0)) AS not_covered,
      count(*) FILTER (WHERE quality = 0 AND toxic = 1 AND doc_id % 2 = 0) AS uncertain, count(*) FILTER (WHERE quality IS NULL) AS unreviewed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""", "status")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _docs(spark, sf_dir).select(F.concat(F.lit("D-"), F.col("doc_id")).alias("document_id"), (F.col("doc_id") * 0).cast("int").alias("page_index"), "text")
    e = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("D-"), F.col("doc_id")).alias("document_id"), (F.col("doc_id") % 7 == 6).cast("int").alias("page_index"), F.lit(3).alias("start"), F.lit(9).alias("end"), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 4, 6)).otherwise("other").alias("quote"))
    return evaluation.checked_evidence(e, pages).select("doc_id", "holds")


QUERIES["evidence_check"] = of_tables(_evidence)
ORACLE_SQL["evidence_check"] = "SELECT doc_id, doc_id % 7 <> 6 AND length(text) >= 9 AND (doc_id % 3 > 0 OR substring(text, 4, 6) = 'other') AS holds FROM documents"
QUERIES["duplicate_units"] = of_tables(lambda s, d: evaluation.duplicates(_docs(s, d), {"digest": F.md5(F.lower(text.collapsed(F.col("text"))))}))
ORACLE_SQL["duplicate_units"] = f"SELECT md5(lower({_TRIM})) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1"
QUERIES["first_claims"] = of_tables(lambda s, d: _docs(s, d).withColumn("place", F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("doc_id"))).select("doc_id", (F.col("place") == 1).alias("kept")))
ORACLE_SQL["first_claims"] = "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept FROM documents"
QUERIES["faithfulness"] = of_tables(lambda s, d: evaluation.faithfulness(_LABELS(s, d).select((F.col("doc_id") % 30).alias("narrative"), F.col("quality").alias("verdict")), "narrative"))
ORACLE_SQL["faithfulness"] = rounded_sql("SELECT doc_id % 30 AS narrative, avg(quality) AS faithfulness, count(*) AS statements FROM labels GROUP BY 1")

# Store.
_THEMES = lambda: F.explode(F.array_distinct(F.transform(F.array(F.lit(3), F.lit(5)), lambda k: (F.col("doc_id") % k).cast("int")))).alias("theme_id")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("doc_id % 7 > 0").select("doc_id", _THEMES())


_ASSIGNED = "assigned AS (SELECT DISTINCT doc_id, unnest([doc_id % 3, doc_id % 5])::INT AS theme_id FROM documents WHERE doc_id % 7 > 0)"
QUERIES["theme_chunks"] = of_tables(lambda s, d: _docs(s, d).select("doc_id", _THEMES()).join(_docs(s, d), "doc_id").groupBy("theme_id").agg(F.count("*").alias("n_chunks"), F.sum(text.word_count(F.col("text"))).alias("n_words")))
ORACLE_SQL["theme_chunks"] = rf"WITH {_ASSIGNED.partition(' WHERE')[0]}) SELECT theme_id, count(*) AS n_chunks, sum(len(regexp_extract_all(text, '[^\s\p{{Z}}\x85]+')))::BIGINT AS n_words FROM assigned JOIN documents USING (doc_id) GROUP BY theme_id"
QUERIES["unassigned_chunks"] = of_tables(lambda s, d: _docs(s, d).join(_assigned(s, d), "doc_id", "left_anti").select("doc_id", F.lit("no theme").alias("reason")))
ORACLE_SQL["unassigned_chunks"] = "SELECT doc_id, 'no theme' AS reason FROM documents WHERE doc_id % 7 = 0"
QUERIES["routing_totality"] = of_tables(lambda s, d: evaluation.set_difference(_docs(s, d).select("doc_id"), _assigned(s, d).select("doc_id").distinct()))
ORACLE_SQL["routing_totality"] = "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id % 7 = 0"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as revisions: of each conversation the rows of its last level."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") / 2).cast("int").alias("level"), "text")
    last = c.groupBy("conv_id").agg(F.max("level").alias("last"))
    return c.join(last, "conv_id").where("level = last").select("conv_id", "turn", F.col("level").cast("long").alias("level"), F.length("text").cast("long").alias("n_chars"))


QUERIES["latest_revision"] = of_tables(_latest)
ORACLE_SQL["latest_revision"] = "SELECT conv_id, turn, (turn // 2)::BIGINT AS level, length(text) AS n_chars FROM conversations QUALIFY rank() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC) = 1"
QUERIES["narrative_words"] = of_tables(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.sum(text.word_count(F.col("text"))).alias("n_words"), F.max("turn").alias("last_turn"), F.count("*").alias("n_turns")))
ORACLE_SQL["narrative_words"] = r"SELECT conv_id, sum(len(regexp_extract_all(text, '[^\s\p{Z}\x85]+')))::BIGINT AS n_words, max(turn) AS last_turn, count(*) AS n_turns FROM conversations GROUP BY 1"
QUERIES["audit_log_summary"] = of_tables(lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("call_numbers"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"), safe_divide(F.sum("value"), F.count("*")).alias("ratio")))
ORACLE_SQL["audit_log_summary"] = rounded_sql("SELECT event_type AS phase, count(*) AS calls, count(DISTINCT user_id) AS call_numbers, count(*) FILTER (WHERE event_type = 'error') AS errors, avg(value) AS mean_value, sum(value) / count(*) AS ratio FROM events GROUP BY 1", "phase")
QUERIES["word_counter"] = of_tables(lambda s, d: _docs(s, d, "source").groupBy("source").agg(F.sum(text.word_count(F.col("text"))).alias("n_words"), F.sum(F.length("text")).alias("n_chars")))
ORACLE_SQL["word_counter"] = r"SELECT source, sum(len(regexp_extract_all(text, '[^\s\p{Z}\x85]+')))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1"
QUERIES["file_lineage"] = of_tables(lambda s, d: runs(s, d).groupBy(F.col("family").alias("nrs_runs_file")).agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("input_strategy")), ",").alias("original_values")))
ORACLE_SQL["file_lineage"] = f"WITH {RUNS_SQL} SELECT family AS nrs_runs_file, count(*) AS n_rows, string_agg(DISTINCT input_strategy, ',' ORDER BY input_strategy) AS original_values FROM runs GROUP BY 1"
QUERIES["union_of_runs"] = of_tables(lambda s, d: (r := runs(s, d).select("model", "NRS")).unionByName(r.where("NRS > 90").withColumn("extra", F.lit(1)), allowMissingColumns=True).dropna(subset=["NRS"]).groupBy("model").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra")))
ORACLE_SQL["union_of_runs"] = f"WITH {RUNS_SQL} SELECT model, count(*) AS n, count(extra) AS n_extra FROM (SELECT model, NRS, NULL AS extra FROM runs UNION ALL SELECT model, NRS, 1 FROM runs WHERE NRS > 90) WHERE NRS IS NOT NULL GROUP BY model"
QUERIES["store_keys"] = of_tables(lambda s, d: evaluation.duplicates(table(s, d, "lineitem"), {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber")}))
ORACLE_SQL["store_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1"

