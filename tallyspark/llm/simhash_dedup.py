"""Operator 8: near-duplicates by SimHash and a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Carried, documents, stored
from .components import connected_components

SHINGLE = 3
SEED = 42
#: Ids of rows that go, which are looked up by a broadcast up to this many (8 bytes each).
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if it is set in over half the XXH64 of the text's word shingles; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):  # a long text by pieces: 64 bytes a shingle
        part = h[at : at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(width)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(fp, pa.int64())], names=[*b.schema.names[:width], "__fp"])

    return run


def with_fingerprints(df: DataFrame, text: Column, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns `keep` of `df` and `__fp`, the fingerprint of `text` as a signed long."""
    sent = df.select(*keep, text.alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[:-1])
    return sent.mapInArrow(_fingerprints(shingle, len(keep)), f"{schema}, __fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def links(fingerprints: DataFrame, long_list: int = 64) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `__fp` which differ in at most two bits.

    Two bits lie in two of the eight bytes at most, so a linked pair shares six bytes in place, and of
    the four pairs of neighbouring bytes it shares at least two.  The index is by byte positions: a
    posting list holds the fingerprints with the same bytes at four positions, for each of the six
    choices of two of those pairs.  A list of single bytes would hold a 256th of all
    fingerprints, and its pairs grow with the square of the input.  For the pairs of a list the
    shared bytes are tallied over all eight positions; pairs with six are verified bit by bit.

    A list of over `long_list` fingerprints gives no pairs.  Its fingerprints are linked by way of
    the words that differ from them in one bit at most: two fingerprints are within two bits exactly
    if they share such a word.  At most 65 fingerprints share one, and each has 65.  So nothing is
    left out, and no row's work exceeds a constant.  A one-bit word that is shared links
    its fingerprints to their smallest.
    """
    fp = F.col("__fp")
    pairs = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    posts = [F.struct(F.lit(n).alias("which"), F.shiftleft(pairs[i], 16).bitwiseOR(pairs[j]).alias("bytes")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    index = fingerprints.select("__fp", F.explode(F.array(*posts)).alias("p")).select("__fp", "p.which", "p.bytes")
    sizes = index.groupBy("which", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    index = stored(index.join(sizes, ["which", "bytes"]))

    short = index.where(F.col("n") <= long_list)
    a, b = short.alias("a"), short.alias("b")
    x, y = F.col("a.__fp"), F.col("b.__fp")
    tally = sum(((_byte(x, i) == _byte(y, i)).cast("int") for i in range(8)), F.lit(0))
    near = a.join(b, (F.col("a.which") == F.col("b.which")) & (F.col("a.bytes") == F.col("b.bytes")) & (x < y))
    near = near.where((tally >= 6) & (F.bit_count(x.bitwiseXOR(y)) <= 2)).select(x.alias("a"), y.alias("b")).distinct()

    hot = index.where(F.col("n") > long_list).select("__fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v - (1 << 64) if v >> 63 else v).cast("long") for v in (1 << i for i in range(64))])
    around = hot.select("__fp", F.explode(flips).alias("bit")).select("__fp", fp.bitwiseXOR(F.col("bit")).alias("word"))
    low = around.groupBy("word").agg(F.min("__fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    by_word = around.join(low, "word").where("a < __fp").select("a", F.col("__fp").alias("b")).distinct()
    return near.union(by_word)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` without its texts, with `fingerprint` (16 hex digits) and `component_id`, the smallest id that links reach.

    Texts have A-Z lower-cased; a shingle is `shingle` words (fewer words: all of them), repeats
    count.  Fingerprints link at two or fewer differing bits (see `links`); equal fingerprints are
    one node, so copies make no pairs.  The text stays behind: its rows can be had by a join on the id.

    Null, empty and blank texts have the fingerprint zero and are linked like any other.  Ids are
    longs; rows with a null id take part and are never the smallest, unless all ids they reach are
    null: then `component_id` is null.  Repeated rows each get a row.  Long texts are counted whole, by pieces of their shingles; an
    empty table gives an empty one.  At the default radius of two bits near copies are found as far as their fingerprints are that near.  Other columns are kept;
    `fingerprint` and `component_id` replace input columns of those names.
    """
    c = Carried(docs)
    keep = [k for k in c.df.columns if k != c.key(text_col)]
    rows = stored(with_fingerprints(c.df, c.col(text_col), keep, shingle))
    fp = F.col("__fp")
    nodes = stored(rows.groupBy("__fp").agg(F.min(c.col(id_col)).alias("__least")))
    found = connected_components(links(nodes.select("__fp")))
    least = found.join(nodes, fp == F.col("node")).groupBy("component").agg(F.min("__least").alias("__whole"))
    linked = found.join(least, "component").select(F.col("node").alias("__of"), "__whole")
    of = stored(nodes.join(linked, fp == F.col("__of"), "left").select(fp.alias("__of"), F.coalesce("__whole", "__least").alias("__component")))
    out = rows.join(of, fp == F.col("__of"))
    new = {"fingerprint": F.lower(F.lpad(F.hex(fp), 16, "0")), "component_id": F.col("__component")}
    names = [n for n in c.names if n != text_col]
    kept = [(new.pop(n) if n in new else F.col(k)).alias(n) for n, k in zip(names, keep, strict=True)]
    return out.select(*kept, *[v.alias(n) for n, v in new.items()])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id; the columns of `docs`.

    Rows that repeat this id are one document: the smallest text stays.  A group whose ids are all
    null keeps one row for each distinct text.
    """
    c = Carried(docs)
    key, text = c.col(id_col), c.col(text_col)
    light = near_duplicates(c.df.select(key.alias("id"), text.alias("text")), "id", "text")
    first = light.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__first")).distinct()
    return first_of(c, key, text, first)


def first_of(c: Carried, key: Column, text: Column, first: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The input's rows whose id is a `__first`, one for each; of null ids one for each distinct text.

    Only rows whose id repeats, or is null, are ranked by their text.  Rows go by the ids that don't stay as they are, which are the few: up to
    `broadcast_ids` of them are broadcast, and no text is shuffled; beyond that each row is shuffled once."""
    ids = c.df.groupBy(key.alias("__id")).agg(F.count("*").alias("__n"))
    stays = F.col("__first").isNotNull() | F.col("__null")
    ids = ids.join(first.select("__first", F.col("__first").isNull().alias("__null")), F.col("__id").eqNullSafe(F.col("__first")), "left")
    known = stored(ids.select("__id", ((F.col("__n") > 1) | F.col("__id").isNull()).alias("__rank"), F.coalesce(stays, F.lit(False)).alias("__stays")))
    others, ranked = known.where("__rank or not __stays").select("__id"), known.where("__rank and __stays").select("__id")
    few = others.count() <= broadcast_ids
    if few:
        alone = c.df.join(F.broadcast(others), key.eqNullSafe(F.col("__id")), "left_anti")
        rows = c.df.join(F.broadcast(ranked), key.eqNullSafe(F.col("__id")), "left_semi")
    else:
        whole = c.df.join(known.hint("merge"), key.eqNullSafe(F.col("__id"))).where("__stays")
        alone, rows = whole.where("not __rank").select(c.df.columns), whole.where("__rank").select(c.df.columns)
    if ranked.isEmpty():
        return c.restore(alone)
    place = F.row_number().over(Window.partitionBy(key, F.when(key.isNull(), text)).orderBy(text))
    return c.restore(alone.union(rows.withColumn("__place", place).where("__place = 1").drop("__place")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
