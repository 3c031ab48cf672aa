"""Metrics of generated narratives: claim precision, source coverage, ratings and agreement, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numeric import quadratic_kappa


def claim_precision(claims: DataFrame, by: str, gamma: float = 10.0, reviewed: bool = True) -> DataFrame:
    """Atomic precision of each narrative: claims have a `verdict` of supported, unsupported or unverifiable.

    Short narratives are penalised by exp(1 - gamma / n).  A score is given only for reviewed claims without an
    unverifiable one; else there are bounds, never a zero in place of a score.
    """
    n = lambda v: F.count_if(F.col("verdict") == v).cast("long")
    c = claims.groupBy(by).agg(F.count("*").alias("denominator"), n("supported").alias("supported"), n("unsupported").alias("unsupported"), n("unverifiable").alias("unverifiable"))
    total = F.col("denominator").cast("double")
    lower, upper = F.col("supported") / total, (F.col("supported") + F.col("unverifiable")) / total
    penalty = F.when(total < gamma, F.exp(1.0 - F.lit(gamma) / total)).otherwise(1.0)
    status = F.lit("partial") if not reviewed else F.when(F.col("unverifiable") > 0, "uncertain").otherwise("completed")
    done = status == "completed"
    return c.withColumns({
        "status": status, "score": F.when(done, lower * penalty), "raw_precision": F.when(done, lower),
        "lower": lower if reviewed else F.lit(None).cast("double"), "upper": upper if reviewed else F.lit(None).cast("double"), "length_penalty": penalty,
    })


def source_coverage(units: DataFrame, decisions: DataFrame, by: str, unit: str = "unit_id") -> DataFrame:
    """How much of an inventory is covered: decisions have a `verdict` of covered, not_covered or uncertain.

    Units without a decision make it partial: no score, and the upper bound counts them as covered, as it does uncertain ones.
    """
    met = units.select(by, unit).join(decisions.select(by, unit, "verdict"), [by, unit], "left")
    n = lambda v: F.count_if(F.col("verdict") == v).cast("long")
    c = met.groupBy(by).agg(F.count("*").alias("denominator"), n("covered").alias("covered"), n("not_covered").alias("not_covered"), n("uncertain").alias("uncertain"), F.count_if(F.col("verdict").isNull()).cast("long").alias("unreviewed"))
    total = F.col("denominator").cast("double")
    lower = F.col("covered") / total
    return c.withColumns({
        "status": F.when(F.col("unreviewed") > 0, "partial").when(F.col("uncertain") > 0, "uncertain").otherwise("completed"), "score": F.when(F.col("unreviewed") == 0, lower),
        "lower": lower, "upper": (F.col("covered") + F.col("uncertain") + F.col("unreviewed")) / total,
    })


def long_ratings(ratings: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """One row for each rating and dimension."""
    return ratings.unpivot(list(keys), list(dimensions), "dimension", "score")


def rating_means(ratings: DataFrame) -> DataFrame:
    """Mean and count by dimension, nulls left out; a dimension without scores is partial."""
    out = ratings.groupBy("dimension").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n_scores"))
    return out.withColumn("status", F.when(F.col("n_scores") > 0, "completed").otherwise("partial"))


def agreement(ratings: DataFrame, narrative: str, rater: str) -> DataFrame:
    """Quadratic weighted kappa by dimension of exactly two raters; pairs with a missing score are left out and counted.

    Ratings are long: narrative, rater, dimension, score.  The raters are the first and the last by name; a pair is one pass over the ratings, not a self-join.
    """
    names = ratings.agg(F.min(rater).alias("first"), F.max(rater).alias("second"), F.count_distinct(rater).alias("n")).first()
    if names.n != 2:
        raise ValueError("kappa is of exactly two raters")
    score = lambda who: F.max(F.when(F.col(rater) == who, F.col("score")))
    pairs = ratings.groupBy(narrative, "dimension").agg(score(names.first).alias("a"), score(names.second).alias("b"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    counted = pairs.groupBy("dimension").agg(F.count_if(whole).cast("long").alias("paired_narratives"), F.count_if(~whole).cast("long").alias("excluded_incomplete_pairs"))
    kappa = pairs.where(whole).groupBy("dimension").agg(quadratic_kappa("a", "b").alias("kappa"))
    return counted.join(kappa, "dimension", "left").withColumn("status", F.when(F.col("kappa").isNull(), "uncertain").otherwise("completed"))


def span_holds(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether [start, end) is inside the text and reads as the quote."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == quote), F.lit(False))


def checked_evidence(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """`evidence` (document_id, page_index, start, end, quote, ..) with `holds`; a page that isn't there doesn't hold."""
    text = pages.select(F.col("document_id").alias("d"), F.col("page_index").alias("p"), F.col("text").alias("page_text"))
    met = evidence.join(text, (F.col("document_id") == F.col("d")) & (F.col("page_index") == F.col("p")), "left")
    return met.withColumn("holds", span_holds(F.col("page_text"), F.col("start"), F.col("end"), F.col("quote"))).drop("d", "p", "page_text")


def duplicates(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with `side`: empty exactly if the two sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def faithfulness(verdicts: DataFrame, by: str) -> DataFrame:
    """The part of statements with a verdict of 1."""
    return verdicts.groupBy(by).agg(F.avg(F.col("verdict").cast("double")).alias("faithfulness"), F.count("*").alias("statements"))


def binding(annotations: DataFrame, narratives: DataFrame, by: str) -> DataFrame:
    """`annotations` with `problem`: why one does not hold, null if it does.

    An annotation names its narrative, the hashes of the narrative's text and of the corpus it was made on, the annotator and the time.  `narratives` has one row
    per `by` with `text` and `corpus_sha256`.  A hash that is missing on either side belongs to another text; blank fields are as good as none."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(r"(?U)^\s*$")
    other = lambda a, b: ~F.coalesce(F.lower(a) == b, F.lit(False))
    own = narratives.select(F.col(by).alias("_by"), F.sha2("text", 256).alias("_text"), F.lower("corpus_sha256").alias("_corpus"))
    problem = (
        F.when(F.col("_by").isNull(), "unknown narrative").when(other(F.col("narrative_sha256"), F.col("_text")), "another narrative")
        .when(other(F.col("corpus_sha256"), F.col("_corpus")), "another corpus").when(blank("annotator") | blank("annotated_at"), "annotator or time missing")
    )
    return annotations.join(own, F.col(by) == F.col("_by"), "left").select(*annotations.columns, problem.alias("problem"))
