"""Coverage of a source text by a generated one, computed for new keys only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.numeric import safe_divide, share
from tallyspark.functions.text import sentences, term_count
from tallyspark.session import reachable

METRICS = [
    "bertscore_f1", "semantic_similarity", "source_coverage_075", "generation_support_075", "compression_ratio", "entity_coverage", "keyphrase_coverage",
    "coverage_adjusted_bertscore_075", "coverage_adjusted_semantic_similarity_075", "omission_risk_075",
]


def suffix(threshold: float) -> str:
    return f"{round(threshold * 100):03d}"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """A vector at length 1; the zero vector stays."""
    n = F.greatest(F.sqrt(_dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


#: Pairs of sentences of a key beyond which they meet in blocks; sentences of a side in a block.
PAIRS, BLOCK = 1_000_000, 2048


def _in_blocks(a: DataFrame, b: DataFrame, heavy: DataFrame, key: str, block: int) -> DataFrame:
    """(key, x, best): of the `heavy` keys (`k`, `na`, `nb`), each block of one side is multiplied with each of the other, and gives its maxima alone."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    kind = a.schema[key].dataType.simpleString()

    def dealt(df: DataFrame, of_source: bool) -> DataFrame:
        n, v, own, other, mine, theirs = ("s", "u", "i", "j", "na", "nb") if of_source else ("g", "v", "j", "i", "nb", "na")
        by = F.col(key) if of_source else F.col("__k")
        rows = df.select(by.alias("of"), F.col(n).cast("long").alias("n"), F.col(v).alias("v")).join(heavy, F.col("of") == F.col("heavy"))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("n"), blocks(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), blocks(theirs) - 1)))
        return rows.select("of", "i", "j", F.lit(of_source).alias("of_source"), "n", "v")

    def best(part: pd.DataFrame) -> pd.DataFrame:
        sides = {of: part[part["of_source"] == of] for of in (True, False)}
        if any(x.empty for x in sides.values()):
            return pd.DataFrame(columns=["of", "of_source", "n", "best"])
        one, two = (np.vstack(sides[of]["v"].to_numpy()) for of in (True, False))
        met = one @ two.T
        found = [pd.DataFrame({"of": part["of"].iloc[0], "of_source": of, "n": sides[of]["n"].to_numpy(), "best": met.max(axis=axis)}) for of, axis in ((True, 1), (False, 0))]
        return pd.concat(found)

    reachable(a.sparkSession)
    out = dealt(a, True).union(dealt(b, False)).groupBy("of", "i", "j").applyInPandas(best, f"of {kind}, of_source boolean, n long, best double")
    return out.select(F.col("of").alias(key), F.struct("of_source", "n").alias("x"), "best")


def sentence_coverage(source: DataFrame, generated: DataFrame, key: str, thresholds: Sequence[float] = (0.70, 0.75, 0.80), pairs: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """For each key the part of source sentences with a generated one at least so similar, and the other way round.

    Both sides have the key, `sentence` (a number) and `vector`.  Sentences meet within their key alone; vectors are normalised before they meet.
    Keys without sentences on one side are left out.  Keys of over `pairs` pairs meet in blocks of `block` sentences, as products of matrices, so no
    row is made of a pair and no task holds more than two blocks; the others meet in a join.
    """
    a = source.select(key, F.col("sentence").alias("s"), unit(F.col("vector")).alias("u"))
    b = generated.select(F.col(key).alias("__k"), F.col("sentence").alias("g"), unit(F.col("vector")).alias("v"))
    count = lambda df, by, n: df.groupBy(F.col(by).alias(f"of_{n}")).agg(F.count("*").alias(n))
    heavy = count(source, key, "na").join(count(generated, key, "nb"), F.col("of_na") == F.col("of_nb")).where(F.col("na") * F.col("nb") > pairs).select(F.col("of_na").alias("heavy"), "na", "nb")
    light = a.join(heavy.select("heavy"), F.col(key) == F.col("heavy"), "left_anti")
    met = light.join(b, F.col(key) == F.col("__k")).select(key, "s", "g", _dot(F.col("u"), F.col("v")).alias("sim"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("of_source"), F.col("s").cast("long").alias("n")), F.struct(F.lit(False).alias("of_source"), F.col("g").cast("long").alias("n")))).alias("x")
    each = met.select(key, "sim", sides).groupBy(key, "x").agg(F.max("sim").alias("best"))
    best = each.unionByName(_in_blocks(a, b, heavy, key, block)).groupBy(key, "x").agg(F.max("best").alias("best"))
    part = lambda of, t: F.avg(F.when(F.col("x.of_source") == of, (F.col("best") >= t).cast("double")))
    names = [("source_coverage", True), ("generation_support", False)]
    return best.groupBy(key).agg(*[part(of, t).alias(f"{name}_{suffix(t)}") for name, of in names for t in thresholds])


def _scored_phrases(found: pd.Series) -> pd.Series:
    """The distinct phrases of each text with their scores."""

    def scored(phrases: Sequence[str]) -> list[tuple[float, str]]:
        times = Counter(phrases)
        stands, beside = Counter(), Counter()
        for p, n in times.items():
            words = p.split(" ")
            for w in words:
                stands[w] += n
                beside[w] += n * len(words)
        return [(sum(beside[w] / stands[w] for w in p.split(" ")), p) for p in times]

    return found.map(scored)


def keyphrases(df: DataFrame, key: str, text: str, top: int = 5, least: int = 4) -> DataFrame:
    """(`key`, `phrase`, `score`, `place`): the `top` phrases of each text, by the graph of the words that stand together in it.

    A phrase is a run of words of `least` letters or more that no shorter word and no mark parts; A-Z and other letters are lower-cased.  In the graph of a text's
    phrases a word has as its degree the number of words in the phrases that it stands in, itself included, over the number of
    times that it stands there; a phrase scores the sum of its words' degrees.  Ties go by the phrase.  Phrases meet by their key, in one shuffle, and are counted there.
    Keys are those of one text each (texts that repeat a key count as one); a null key, or a text without phrases, gives no row.
    """
    parts = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+|[^\p{L}\s]"), F.lit(0))
    apart = F.transform(parts, lambda w: F.when((F.length(w) >= least) & w.rlike(r"^\p{L}"), w).otherwise("|"))
    found = F.filter(F.transform(F.split(F.array_join(apart, " "), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    reachable(df.sparkSession)
    texts = df.select(F.col(key).alias("k"), found.alias("found")).where("k is not null and size(found) > 0").repartition("k")
    scores = F.pandas_udf(_scored_phrases, "array<struct<score double, phrase string>>")
    scored = texts.groupBy("k").agg(F.flatten(F.collect_list("found")).alias("found")).select("k", scores("found").alias("all"))
    ranked = F.array_sort(F.transform("all", lambda x: F.struct((-F.round(x["score"], 6)).alias("down"), x["phrase"].alias("phrase"))))
    first = scored.select("k", F.posexplode(F.slice(ranked, 1, top)).alias("i", "x"))
    return first.select(F.col("k").alias(key), F.col("x.phrase").alias("phrase"), (-F.col("x.down")).alias("score"), (F.col("i") + 1).cast("long").alias("place"))


def text_measures(df: DataFrame, source: str, generated: str) -> DataFrame:
    """`df` with word and sentence counts of both texts and their ratio; a missing text gives nulls, not zeros."""
    a, b = F.col(source), F.col(generated)
    return df.withColumns({
        "source_word_count": term_count(a), "generated_word_count": term_count(b), "compression_ratio": safe_divide(term_count(b), term_count(a)),
        "source_sentence_count": F.size(sentences(a)).cast("long"), "generated_sentence_count": F.size(sentences(b)).cast("long"),
    })


def adjusted(df: DataFrame, coverage: str = "source_coverage_075") -> DataFrame:
    """Alignment scores times coverage, and how much alignment exceeds it."""
    tail = coverage.rsplit("_", 1)[1]
    c = F.col(coverage)
    return df.withColumns({
        f"coverage_adjusted_bertscore_{tail}": F.col("bertscore_f1") * c, f"coverage_adjusted_semantic_similarity_{tail}": F.col("semantic_similarity") * c, f"omission_risk_{tail}": F.col("bertscore_f1") - c,
    })


def coverage_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Means of the metrics over successes, and failures over all; groups without a success are left out, missing metrics are null."""
    value = lambda m: F.col(m) if m in runs.columns else F.lit(None).cast("double")
    out = runs.groupBy(*by).agg(*[F.avg(F.when(F.col("success"), value(m))).alias(f"mean_{m}") for m in metrics], F.count_if("success").alias("n_runs"), share(F.col("failed")).alias("failure_rate"))
    return out.where("n_runs > 0")


def aligned_but_uncovered(runs: DataFrame, alignment: float = 0.85, coverage: float = 0.50) -> DataFrame:
    """Runs that score well and yet leave out half the source, the riskiest first."""
    found = runs.where((F.col("bertscore_f1") >= alignment) & (F.col("source_coverage_075") <= coverage))
    return found.orderBy(F.desc_nulls_last("omission_risk_075"))


def cache_key(columns: Sequence[Column]) -> Column:
    """Identity of a computation.  Give it the hash of the texts, the model and the thresholds, so that what changes is computed anew."""
    return F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def missing(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """The rows whose key the cache lacks."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def merged(cache: DataFrame, computed: DataFrame, key: str = "cache_key") -> DataFrame:
    """Both, where a key is in both the computed row; columns that one side lacks are null."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(computed.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new")))
    return both.withColumn("__place", place).where("__place = 1").drop("__new", "__place")


def incremental(rows: DataFrame, cache: DataFrame, compute, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(`rows` with the cached columns, the cache with what is new): `compute` sees the rows that the cache lacks."""
    whole = merged(cache, compute(missing(rows, cache, key)), key)
    return rows.join(whole, key, "left"), whole


def known_keys(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """(`current`, `cached`, `both`): distinct keys of the rows, of the cache, and of both."""
    sides = rows.select(key, F.lit(1).alias("r"), F.lit(0).alias("c")).union(cache.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("r").alias("r"), F.max("c").alias("c"))
    return sides.agg(F.sum("r").alias("current"), F.sum("c").alias("cached"), F.count_if((F.col("r") == 1) & (F.col("c") == 1)).alias("both"))


def _embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(cache_key, sentence, vector) of the sentences of a text, embedded batch by batch."""
    kept = rows.select("cache_key", F.posexplode(sentences(F.coalesce(F.col(text), F.lit("")))).alias("sentence", "t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = np.asarray(embed(b["t"].tolist()), float) if len(b) else np.zeros((0, 1))
            yield pd.DataFrame({"cache_key": b["cache_key"], "sentence": b["sentence"], "vector": list(vectors)})

    return kept.mapInPandas(run, "cache_key string, sentence int, vector array<double>")


def coverage_stage(rows: DataFrame, cache: DataFrame | None, identity: Sequence[str], source: str, generated: str, embed: Callable[[list[str]], np.ndarray], model: str, thresholds: Sequence[float] = (0.70, 0.75, 0.80)) -> tuple[DataFrame, DataFrame]:
    """(`rows` with coverage columns, the cache with what is new): what the cache lacks is embedded and computed, the rest is looked up.

    `source` and `generated` are the text columns (see `texts_at` for texts in files).  The key is of `identity`, both texts, the embedder's name and the thresholds,
    so what changes is computed anew.  A row without one of the texts has nulls.  `embed` turns a batch of sentences into vectors on the workers."""
    reachable(rows.sparkSession)
    hashed = [F.sha2(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"), 256) for c in (source, generated)]
    keyed = rows.withColumn("cache_key", cache_key([*map(F.col, identity), *hashed, F.lit(model), F.lit(",".join(map(str, thresholds)))]))

    def compute(todo: DataFrame) -> DataFrame:
        todo = todo.select("cache_key", source, generated).dropDuplicates(["cache_key"])
        measures = text_measures(todo, source, generated).drop(source, generated)
        return measures.join(sentence_coverage(_embedded(todo, source, embed), _embedded(todo, generated, embed), "cache_key", thresholds), "cache_key", "left")

    if cache is None:
        new = compute(keyed)
        return keyed.join(new, "cache_key", "left"), new
    return incremental(keyed, cache, compute)


def texts_at(rows: DataFrame, path: str, text: str) -> DataFrame:
    """`rows` with the column `text`: the contents of the files that `path` names, null where there is none.  Each file is read once."""
    spark = rows.sparkSession
    folders = [r[0] for r in rows.select(F.regexp_replace(path, r"[^/]+$", "").alias("f")).where("f <> ''").distinct().collect()]  # folders, not files
    if not folders:
        return rows.withColumn(text, F.lit(None).cast("string"))
    files = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("__path"), F.decode("content", "UTF-8").alias(text))
    return rows.join(files, F.regexp_replace(path, r"^[a-z0-9]+:/+", "/") == F.col("__path"), "left").drop("__path")
