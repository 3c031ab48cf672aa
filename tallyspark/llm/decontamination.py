"""Operator 5: benchmark passages in documents, by SimHash of item-sized windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, ascii_lower, documents, let, stored, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which a window's fingerprint may differ from its item's.  At a similarity of 0.8 each bit differs with a
#: probability of 0.152, so a fingerprint differs in 9.7 bits on average and in more than 24 once in a million.
RADIUS = 24
#: Item shingles up to which the items are broadcast (16 bytes each, and the words); beyond, both sides are shuffled.
BROADCAST_SHINGLES = 500_000
#: Buckets of ids, of which those with a window are broadcast (8 bytes each).
BUCKETS = 1 << 20


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of `radius` + 1 blocks of a 64-bit word: two words within the radius share a block."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, (1 << b - a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def hashed_words(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: int = SHINGLE) -> Column:
    """64 bits for each run of `size` of the hashed words; none if there are fewer."""
    return F.when(F.size(hashes) < size, F.array().cast("array<long>")).otherwise(
        let(hashes, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))
    )


def simhash(found: Column) -> Column:
    """A word whose bits are each set in over half of the shingles `found`, repeats included."""
    bits = F.sequence(F.lit(0), F.lit(63))

    def body(x: Column) -> Column:
        set_ = F.filter(bits, lambda b: 2 * F.aggregate(x, F.lit(0), lambda n, h: n + F.getbit(h, b)) > F.size(x))
        return F.aggregate(set_, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))

    return let(found, body)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over sum of the larger ones, over all shingles of either."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    shared = lambda x, y: F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, h: acc + F.least(count(x, h), count(y, h)))
    return let(a, lambda x: let(b, lambda y: let(shared(x, y), lambda n: n / (F.size(x) + F.size(y) - n))))


def _starts(places: Column, size: Column, n: Column, shingle: Column, similarity: float) -> Column:
    """All starts of windows of `n` of a text's `size` words that can reach the similarity, given the sorted `places` of
    the text's shingles that are the item's.

    Of m shingles on either side, 2 m s / (1 + s) are shared at a similarity of s.  So that many places, neighbours in
    the list, lie in the window.  A text of no more than `n` words is one window.
    """
    def body(at: Column) -> Column:
        m = n - shingle + 1
        least = F.greatest(F.lit(1), F.ceil(m * F.lit(2 * similarity / (1 + similarity)) - F.lit(1e-6)).cast("int"))
        low = lambda i: F.greatest(F.lit(0), F.get(at, i + least - 1) - m + 1)
        high = lambda i: F.least(F.get(at, i), size - n)
        run = lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i), F.lit(1))).otherwise(F.array().cast("array<int>"))
        heads = F.when(F.size(at) >= least, F.sequence(F.lit(0), F.size(at) - least, F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform(heads, run)))

    return F.when(size <= n, F.array(F.lit(0))).otherwise(let(places, body))


def find_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """(`id_col`, `item_col`, `start`, `n_words`, `distance`, `similarity`): the best window of each document for each item found in it.

    A window has as many words as an item (a shorter document is one window); A-Z are lower-cased.
    1. Windows.  Every window is taken that has enough shingles of an item of its size to reach the similarity (see `_starts`); no other can
       be a result.  The shingles of the items find these places.
    2. Candidates.  A window is fingerprinted, whatever items led to it, and meets the items of its size on any of `radius` + 1 blocks of their
       SimHash, which no pair within the radius misses; pairs beyond the radius go.
    3. The exact similarity decides: shingles weighted by their counts, 0.8 or more.  Of several windows the most similar,
       then the first is given.

    Items of fewer than `shingle` words are one shingle of all their words; those without words are never found.  Null and empty texts have no
    words; rows with a null id or item are left out; repeated rows give one row.  Empty tables give an empty one.  Only the columns named are
    read, whatever else there is.  Long texts are worked on whole; a window's cost does not depend on its text.
    Texts are read to find where windows lie, and once more to cut these out; only those with windows, and few others, are shuffled.
    """
    c, d = Carried(docs), Carried(items)
    benchmark = d.df.select(d.col(item_col).alias("item"), hashed_words(d.col(item_text_col)).alias("iw")).where("item is not null").distinct()
    sizes = F.least(F.size("iw"), F.lit(shingle))
    benchmark = stored(benchmark.where(F.size("iw") > 0).select("item", F.size("iw").alias("n"), sizes.alias("g"), _by_size(F.col("iw"), F.size("iw"), shingle).alias("ish")))
    total = benchmark.agg(F.coalesce(F.sum(F.size("ish").cast("long")), F.lit(0))).first()[0]
    small = (lambda x: F.broadcast(x)) if total <= BROADCAST_SHINGLES else (lambda x: x)
    anchors = small(benchmark.select("item", "n", "g", F.explode(F.array_distinct("ish")).alias("h")))

    rows = c.df.select(c.col(id_col).alias("id"), F.coalesce(c.col(text_col), F.lit("")).alias("t")).where("id is not null")
    hashed = rows.select("id", F.xxhash64("t").alias("of"), hashed_words(F.col("t")).alias("w"))
    used = sorted({r.g for r in benchmark.select("g").distinct().collect()} | {shingle})  # at most `shingle` numbers
    places = reduce(DataFrame.union, [hashed.select("id", "of", F.size("w").alias("size"), F.lit(g).alias("g"), F.posexplode(shingles(F.col("w"), g)).alias("p", "h")) for g in used])
    where = stored(places.join(anchors, ["g", "h"]).select("id", "of", "item", "size", "n", "g", "p").distinct())

    per = where.groupBy("id", "of", "item", "size", "n", "g").agg(F.sort_array(F.collect_set("p")).alias("at"))
    per = per.select("id", "of", "n", F.explode(_starts(F.col("at"), F.col("size"), F.col("n"), F.col("g"), similarity)).alias("start")).distinct()
    per = stored(per.groupBy("id", "of").agg(F.collect_list(F.struct("n", "start")).alias("found")))
    # Only texts whose bucket of ids has a window are shuffled; the buckets are broadcast, `BUCKETS` numbers at most.
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket")
    hit = per.select(bucket).distinct()
    whole = rows.select("*", bucket).join(F.broadcast(hit), "bucket", "left_semi").select(F.col("id").alias("i"), F.xxhash64("t").alias("o"), "t")
    cut = per.join(whole, (F.col("id") == F.col("i")) & (F.col("of") == F.col("o")))
    cut = cut.select("id", hashed_words(F.col("t")).alias("w"), "found").select("id", "w", F.explode("found").alias("f")).select("id", "w", "f.n", "f.start")
    cut = cut.select("id", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    windows = cut.select("id", "n", "start", F.size("w").alias("n_words"), _by_size(F.col("w"), F.col("n"), shingle).alias("wsh")).where(F.size("wsh") > 0)
    windows = stored(windows.withColumn("fp", simhash(F.col("wsh"))).distinct())

    pairs = candidates(windows.select("id", "n", "start", "fp"), benchmark.select("item", "n", simhash(F.col("ish")).alias("ifp")), radius, small)
    near = windows.join(pairs, ["id", "n", "start", "fp"]).join(small(benchmark.select("item", "ish")), "item")
    near = near.withColumn("similarity", weighted_similarity(F.col("wsh"), F.col("ish"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words", (-F.col("distance")).alias("d"))).alias("b")
    out = near.groupBy("id", "item").agg(best)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).alias("start"), "b.n_words", (-F.col("b.d")).alias("distance"), "b.similarity")


def _by_size(w: Column, n: Column, shingle: int) -> Column:
    """The shingles of hashed words `w` as those of an item of `n` words: of `shingle` words, or of as many as a shorter item has."""
    out = shingles(w, shingle)
    for g in range(1, shingle):
        out = F.when(n == g, shingles(w, g)).otherwise(out)
    return out


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS, small=lambda x: x) -> DataFrame:
    """(`id`, `n`, `start`, `fp`, `item`, `distance`): windows (`fp`) and items (`ifp`) of one size `n` within the radius, by a multi-index.

    Both are entered under each of `radius` + 1 blocks of their fingerprints; two words that differ in no more bits than the radius agree in a
    block.  A pair that agrees in several counts at the first.  Only fingerprints travel, not shingles.
    """
    blocks = _blocks(radius)

    def indexed(df: DataFrame, fp: str) -> DataFrame:
        keys = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit(m)).alias("v")) for k, (a, m) in enumerate(blocks)]
        return df.withColumn("b", F.explode(F.array(*keys))).select("*", "b.k", "b.v").drop("b")

    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = F.array_position(F.array(*[F.shiftrightunsigned(differ, a).bitwiseAND(F.lit(m)) == 0 for a, m in blocks]), True) - 1
    met = indexed(windows, "fp").join(small(indexed(items, "ifp")), ["n", "k", "v"]).withColumn("distance", F.bit_count(differ))
    return met.where((F.col("distance") <= radius) & (F.col("k") == first)).select("id", "n", "start", "fp", "item", "distance")


def without_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose id has a benchmark passage; rows with a null id stay."""
    c = Carried(docs)
    hits = find_passages(c.df.select(c.col(id_col).alias("doc_id"), c.col(text_col).alias("text")), items).select(F.col("doc_id").alias("__hit")).distinct()
    return c.restore(c.df.join(hits, c.col(id_col) == F.col("__hit"), "left_anti"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
