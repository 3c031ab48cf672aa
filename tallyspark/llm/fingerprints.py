"""Operator 7: document fingerprints by one-permutation MinHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Carried, documents, let, words

#: Probes of an empty bin before all non-empty bins are ranked for it.
PROBES = 16
#: Bins of the one permutation (a power of two), low-order bits kept of each, words of a shingle.
BINS, LOW, SHINGLE = 256, 4, 5
_SHIFT = 64 - (BINS.bit_length() - 1)
_EACH = 64 // LOW  # values in a packed long


def _last(bin_: int) -> int:
    """The largest hash of a bin, bins in the order of signed longs: it marks the bin as empty."""
    return (bin_ - BINS // 2 + 1 << _SHIFT) - 1


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """`df` with the fingerprint of `text`: an array of longs that hold `LOW` bits for each bin.

    Hashes are sorted together with one mark for each bin, greater than all the bin's hashes; so the first of each
    bin is its least hash, or the mark where it is empty.  An empty bin takes over the value of the first
    non-empty one that its own probes hit, the same for all texts (optimal densification: any non-empty bin is as likely, whatever its
    distance); should `PROBES` hit none, of the one that a hash ranks first.
    """
    of_bin = lambda h: F.shiftright(h, _SHIFT)
    w, h, first = (f"__{name}_{k}" for k in ("w", "h", "first"))
    df = df.withColumn(w, F.transform(words(text), lambda x: F.xxhash64(x)))
    size = F.size(w)
    hashes = F.when(size < SHINGLE, F.array(F.xxhash64(F.col(w)))).otherwise(
        F.transform(F.sequence(F.lit(0), size - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE)]))
    )
    marks = F.array(*[F.lit(_last(b)).cast("long") for b in range(BINS)])
    df = df.withColumn(h, F.sort_array(F.concat(hashes, marks)))
    df = df.withColumn(first, F.filter(F.col(h), lambda x, i: (i == 0) | (of_bin(F.get(F.col(h), i - 1)) != of_bin(x))))
    last = lambda x: x.bitwiseAND(F.lit((1 << _SHIFT) - 1)) == (1 << _SHIFT) - 1

    def dense(full: Column) -> Column:
        def taken(i: Column) -> Column:
            at = lambda j: F.get(F.col(first), F.xxhash64(i, j).bitwiseAND(F.lit(BINS - 1)).cast("int"))
            probe = lambda got, j: F.when(got.isNotNull(), got).otherwise(let(at(j), lambda x: F.when(~last(x), x)))
            probed = F.aggregate(F.array(*[F.lit(j) for j in range(PROBES)]), F.lit(None).cast("long"), probe)
            near = F.transform(full, lambda y, j: F.xxhash64(i, of_bin(y)).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("long")))
            return F.coalesce(probed, F.get(full, F.array_min(near).bitwiseAND(F.lit(BINS - 1)).cast("int")))

        return F.when(F.size(full) == BINS, full).otherwise(F.transform(F.col(first), lambda x, i: F.when(last(x), taken(i)).otherwise(x)))

    def packed(values: Column) -> Column:
        """Longs of `_EACH` parts.  A part has low-order bits of the value, hashed with the bin: a value that several
        bins took over agrees with another text's by chance in each of them anew, not in all at once."""
        part = lambda b: F.xxhash64(F.get(values, F.lit(b)), F.lit(b)).bitwiseAND(F.lit((1 << LOW) - 1))
        return F.array(*[_or([F.shiftleft(part(k * _EACH + j), LOW * (_EACH - 1 - j)) for j in range(_EACH)]) for k in range(BINS // _EACH)])

    values = let(F.filter(F.col(first), lambda x: ~last(x)), dense)
    return df.withColumn(name, let(values, packed)).drop(w, h, first)


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def likeness(a: Column, b: Column) -> Column:
    """The resemblance that two fingerprints speak for.  Bits that agree by chance, one in 2^`LOW`, are taken off."""
    ones = int("0001" * _EACH, 2)

    def same(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_ = d
        for k in range(1, LOW):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.lit(_EACH) - F.bit_count(any_.bitwiseAND(F.lit(ones)))

    matches = F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda acc, x: acc + x) / F.lit(float(BINS))
    chance = 2.0**-LOW
    return F.greatest(F.lit(0.0), (matches - chance) / (1 - chance))


def hexed(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of edited texts, and how alike they are.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the next row's text, in
    ascending id; behind the last row comes the first.  Null ids come first; equal ids go by their
    text.  Returns id, `n_chars`, `edited_text`, `fingerprint`, `edited_fingerprint` (hex), `near_edited`, `near_next`.
    Null and empty texts are one shingle without words.  A single row is its own next.  Long texts are fingerprinted whole; an empty
    table gives an empty one.  Other columns, whatever their names, are left behind.

    Rows are dealt into ranges of ids, several for each shuffle partition; the first row of each range is also
    put behind the one before it, so that no row needs another range, and nothing is sorted in one task.
    """
    c = Carried(docs)
    rows = c.df.select(c.col(id_col).alias("id"), F.coalesce(c.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10 * parts))).first()[0]
    cuts = sorted(set(cuts or []))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    bounds = F.array(*[F.lit(x).cast("long") for x in cuts]).cast("array<long>") if cuts else F.array().cast("array<long>")
    place = F.lit(0)
    if cuts:
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(bounds, at + s - 1) < F.col("id")), at + s).otherwise(at))
    placed = rows.select("id", place.alias("part"))
    least = F.when(F.max(F.col("id").isNull()), F.lit(None)).otherwise(F.min("id"))
    firsts = {r["part"]: r["least"] for r in placed.groupBy("part").agg(least.alias("least")).collect()}
    there = sorted(firsts)
    before = {p: there[k - 1] for k, p in enumerate(there)}  # of the first: the last
    by_part = lambda values, kind: F.array(*[F.lit(values.get(p)).cast(kind) for p in range(len(cuts) + 1)])
    starts, guests = by_part(firsts, "long"), by_part(before, "int")
    df = with_fingerprint(rows.withColumn("part", place), F.col("text"), "fp")
    is_first = F.col("id").eqNullSafe(F.get(starts, F.col("part")))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(guests, F.col("part")).alias("part"), F.lit(1).alias("guest"))
    df = df.select("id", "text", "fp", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    order = Window.partitionBy("p.part").orderBy("p.guest", F.col("id").asc_nulls_first(), "text")
    df = df.select("*", F.lead("text").over(order).alias("next"), F.lead("fp").over(order).alias("next_fp")).where("p.guest = 0")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    df = df.select("id", "fp", "next_fp", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter)).alias("edited"))
    df = with_fingerprint(df, F.col("edited"), "edited_fp")
    return df.select(
        F.col("id").alias(id_col), "n_chars", F.col("edited").alias("edited_text"), hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_edits(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
