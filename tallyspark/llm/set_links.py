"""Links between sets of shingles of a similarity, found through the inverted lists of bottom-k sketches.

A set is the distinct 64-bit hashes of a text's shingles, by one hash function.  Its sketch is the `k` smallest of them, of
fewer all.  What two sets retain in common is a sample without replacement of their union, so a pair of the similarity shares at least
`least_shared` retained values (surely where the sketches are the whole sets, else but for one such pair in ten million).  So
it shares one of the `head_size` retained values of either that come first in any common order; seldom ones come first here.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, setting, stored
from .components import connected_components

#: Retained values of a sketch; one in so many pairs of just the similarity may retain less than `least_shared` in common.
K, MISS = 64, 1e-7
#: Rows of one node are dealt over so many tasks.
SALT = 16
#: Nodes of a list's largest component that those outside it are held against in a round; rounds; comparisons of a task of what is left.
PIVOTS, ROUNDS, WORK = 8, 1, 1_000_000
#: Rows and bytes that go to Python at a time; a longer text goes alone.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Buckets, by bits of a retained value, in which values are counted; blocks in which the counts travel.
BUCKET_BITS, BLOCKS = 22, 64
#: Ids whose texts are looked up by a broadcast, up to this many (8 bytes each).
BROADCAST_IDS = 1_000_000
SEED = 0


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, Python gets few rows at a time, however long they are."""
    with ExitStack() as within:
        for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            within.enter_context(setting(spark, f"spark.sql.execution.arrow.{name}", value))
        yield


def hashed_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, A-Z lower-cased, sorted as signed longs; of fewer words, all of them as one; of none, none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.int64)
    if len(w) < shingle:
        w, shingle = [b" ".join(w)], 1
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(w) - shingle + 1).view(np.int64))


def simhash(found: np.ndarray) -> int:
    """64 bits, each 1 if over half the hashes have it."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 15):
        votes += np.unpackbits(found[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(found), bitorder="little").view(np.int64)[0])


@lru_cache(maxsize=1000)
def least_sampled(k: int, similarity: float) -> int:
    """The most values that a pair of the similarity retains in common but for one pair in 1 / MISS, of `k` from its union."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > MISS:
            return t
    return k


def least_shared(n: int, similarity: float, k: int = K) -> int:
    """Retained values that a set of `n` shares with any set of the similarity."""
    return max(1, math.ceil(n * similarity - 1e-9)) if n <= k * similarity else max(1, least_sampled(k, similarity))


def head_size(n: int, similarity: float, k: int = K) -> int:
    """Of min(n, k) retained values in the common order: two sets of the similarity have one in common there."""
    return min(n, k) - least_shared(n, similarity, k) + 1 if n else 0


def _sketched(shingle: int, k: int, width: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for t in b.column(width).cast(pa.binary()):
                found = hashed_set(t.as_py() or b"", shingle)
                for to, x in zip(out, (xxhash.xxh128_digest(found.tobytes()), len(found), found[:k], simhash(found) if bits else None), strict=True):
                    to.append(x)
            made = [pa.array(x, kind) for x, kind in zip(out, (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], names=[*b.schema.names[:width], "digest", "n", "sketch", "fp"])

    return run


def sketches(df: DataFrame, keep: dict[str, Column], text: Column, shingle: int, k: int = K, bits: bool = False) -> DataFrame:
    """The columns `keep` of `df`, and of its text's set: `digest` (128 bits; equal sets, equal digests), `n` (its size), `sketch`, and
    `fp`, the SimHash, if `bits`.  To be run inside `small_batches`."""
    sent = df.select(*[c.alias(name) for name, c in keep.items()], text.alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[:-1])
    return sent.mapInArrow(_sketched(shingle, k, len(keep), bits), f"{schema}, digest binary, n long, sketch array<long>, fp long")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).cast(pa.binary()):  # a set at a time: it may be long
                found = hashed_set(t.as_py() or b"", shingle)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(found.tobytes())], pa.binary()), pa.array([found], pa.list_(pa.int64()))], names=["digest", "set"])

    return run


def sets_of(docs: DataFrame, key: Column, text: Column, nodes: DataFrame, shingle: int) -> Callable[[DataFrame], DataFrame]:
    """Looks up the (`node`, `set`) of a column `node`: reads the texts again and keeps those of the nodes' smallest ids."""

    def found(wanted: DataFrame) -> DataFrame:
        ids = stored(nodes.join(wanted, "node").select(F.col("least").alias("__id"), "digest", "node"))
        short = ids.select("__id").distinct()
        short = F.broadcast(short) if ids.count() <= BROADCAST_IDS else short
        again = docs.join(short, key.eqNullSafe(F.col("__id")), "left_semi").select(text).mapInArrow(_sets(shingle), "digest binary, set array<long>")
        return again.join(ids.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "set")

    return found


def _bucket(found: np.ndarray) -> np.ndarray:
    """Retained values are small, so their bits are mixed first."""
    return ((found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_levels(sketched: DataFrame) -> np.ndarray:
    """log2 of the number of retained values (column `sketch`) in each bucket: 4 MB whatever the input.

    The levels order values, those of seldom buckets first.  Any order that is the same for all texts gives the same
    links; this one keeps what many texts share out of their heads.
    """
    width = (1 << BUCKET_BITS) // BLOCKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.int32)
        for b in batches:
            np.add.at(n, _bucket(b.column(0).flatten().to_numpy()), 1)
        n = np.minimum(n, 255).astype(np.uint8)  # a byte is enough for an order
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in n.reshape(BLOCKS, width)], pa.binary())], names=["block", "n"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint8).astype(np.int32) for x in part["n"])
        return pd.DataFrame({"block": part["block"].iloc[:1], "n": [np.log2(total + 1).astype(np.uint8).tobytes()]})

    rows = sketched.select("sketch").mapInArrow(counted, "block int, n binary").groupBy("block").applyInPandas(added, "block int, n binary").collect()
    out = np.zeros((BLOCKS, width), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.n, np.uint8)
    return out.ravel()


def _headed(levels, similarity: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for b in batches:
            heads = []
            for n, s in zip(b.column("n").to_pylist(), b.column("sketch"), strict=True):
                h = s.values.to_numpy()
                heads.append(np.argsort(level[_bucket(h)], kind="stable")[: head_size(n, similarity, k)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int16()))], names=[*b.schema.names, "head"])

    return run


def with_heads(nodes: DataFrame, similarity: float, k: int = K) -> DataFrame:
    """`nodes` with `head`, the places in the sketch of the values by which a set is listed.  To be run inside `small_batches`."""
    spark = nodes.sparkSession
    levels = spark.sparkContext.broadcast(bucket_levels(nodes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(_headed(levels, similarity, k), f"{schema}, head array<smallint>")


def nodes_of(rows: DataFrame, similarity: float, k: int = K) -> DataFrame:
    """One row for each digest of `rows` (`id` and the columns of `sketches`): `node`, a number of its own, `least`, its smallest id,
    `digest`, `n`, `sketch`, `fp` and `head`; a written table, so the numbers stay."""
    alone = rows.groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    alone = stored(alone.withColumn("node", F.monotonically_increasing_id()))
    out = stored(with_heads(alone, similarity, k))
    forget(alone)
    return out


def _of_similarity(shared: Column, both: Column, similarity: float) -> Column:
    """Whether `shared` of two sets with `both` elements together, repeats counted, reaches the similarity."""
    return shared >= F.lit(similarity) * (both - shared) - F.lit(1e-9)


def _dealt(pairs: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    """`pairs` (a, b) with the columns of `rows` for either, behind `a_` and `b_`.  A node may have many partners as `a`: its row is taken once for each of `SALT` tasks."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALT)).alias("salt")
    dealt = pairs.select("a", "b", salt)
    of = lambda end: rows.select(F.col("node").alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names])
    wanted = dealt.select("a", "salt").distinct().join(of("a"), "a")
    return dealt.join(of("b"), "b").join(wanted, ["a", "salt"])


def estimated(pairs: DataFrame, nodes: DataFrame, similarity: float, k: int = K) -> DataFrame:
    """The `pairs` (a, b) whose sketches allow the similarity, and whether they prove it (`sure`).

    The union's sketch is the `k` smallest values of both; the share of them that both sketches have estimates the similarity.  Of two
    whole sets it is the similarity itself, which decides.  Else a pair goes if it shares less than all but one pair in 1 / MISS of the similarity do.
    """
    least = least_sampled(k, similarity)
    whole = (F.col("a_n") <= k) & (F.col("b_n") <= k)
    common = F.array_intersect("a_sketch", "b_sketch")
    both = _dealt(pairs, nodes, "n", "sketch").withColumn("common", common)
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
    likely = F.size(F.array_intersect("common", union)) >= least
    met = _of_similarity(F.size("common"), F.col("a_n") + F.col("b_n"), similarity)
    return both.where(F.when(whole, met).otherwise(likely)).select("a", "b", whole.alias("sure"))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    both = _dealt(pairs, sets, "set")
    return both.where(_of_similarity(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set"), similarity)).select("a", "b")


def linked(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, radius: int | None = None, k: int = K, long_list: int = 32, near: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between the rows (`node`, `n`, `sketch`, `head`, `fp`) that connect all whose sets have the similarity.

    `sets` looks up the (`node`, `set`) of a column `node`, which are few.
    An inverted list has the nodes with one retained value at a place of their `head`.  All nodes of a list are first held against its pivot, the first by a hash;
    so lists of the same nodes have the same pivot, and a group of copies becomes a star.  Lists that are one component then are done with, as are those of two nodes;
    so pairs are left out only where both are connected already.  In the others of up to `long_list` nodes each is held against all of other components.
    The longer ones are merged by their pivot, whose sketch bounds how many, so that two nodes meet once and not in each of the lists that they share.  For `ROUNDS`
    rounds the nodes outside the largest component are held against `PIVOTS` of that component; what still is outside is held against all
    others, in a join that tests the whole sets as its condition, dealt over tasks by its work: so no row is made of a pair that isn't similar.  Elements
    that no other of these sets has rule most of that out.
    Pairs are not compared whose sizes or estimate (see `estimated`) rule the similarity out; with a
    `radius`, nor are pairs whose `fp` differ in more bits.  `near` has pairs (a, b) of nodes that another index found; they are compared with those of the pivots.
    """
    posts = nodes.where("n > 0").select("node", "fp", "n", F.explode(F.transform("head", lambda at: F.get("sketch", at.cast("int")))).alias("h"))
    sizes = posts.groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    index = stored(posts.join(sizes, "h"))
    may = F.least("a.n", "b.n") >= F.lit(similarity) * F.greatest("a.n", "b.n") - F.lit(1e-9)
    if radius is not None:
        may = may & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    same, differ, other = F.col("a.h") == F.col("b.h"), F.col("a.c") != F.col("b.c"), F.col("a.node") != F.col("b.node")
    once = (F.col("b.c") == F.col("a.lead")) | (F.col("a.node") < F.col("b.node"))
    before = F.struct(F.xxhash64("a.node", F.lit(0)), "a.node") < F.struct(F.xxhash64("b.node", F.lit(0)), "b.node")  # a pivot is the `a` of its pairs
    ends = [F.when(before, F.col("a.node")).otherwise(F.col("b.node")).alias("a"), F.when(before, F.col("b.node")).otherwise(F.col("a.node")).alias("b")]

    def similar(pairs: DataFrame) -> DataFrame:
        likely = stored(estimated(pairs.distinct(), nodes, similarity, k))
        doubt = likely.where("not sure").select("a", "b")
        texts = stored(sets(doubt.select(F.col("a").alias("node")).union(doubt.select("b")).distinct()))
        out = stored(confirmed(doubt, texts, similarity).union(likely.where("sure").select("a", "b")))
        forget(likely)
        forget(texts)
        return out

    firsts = pivots(index, 0, 1)
    starred = firsts.alias("a").join(index.alias("b"), same & may & other).select(*ends)
    edges = similar(starred if near is None else starred.union(near))
    found = components(edges)
    left = apart(index.where("many > 2"), found)
    long = left.where(F.col("many") > long_list).select("h", "node", "fp", "n")
    merged = stored(long.join(firsts.select("h", F.col("node").alias("p")), "h").select(F.col("p").alias("h"), "node", "fp", "n").distinct())
    crowds = apart(merged, found)
    for turn in range(1, ROUNDS + 1):
        more = similar(pivots(crowds.where("c = lead"), turn, PIVOTS).alias("a").join(crowds.where("c <> lead").alias("b"), same & may).select(*ends))
        if more.isEmpty():
            break
        edges = stored(edges.union(more))
        crowds = apart(merged, components(edges))
    short = left.where(F.col("many") <= long_list)
    close = similar(short.where("c <> lead").alias("a").join(short.alias("b"), same & may & differ & once).select(*ends))
    whole = stored(sets(crowds.select("node").distinct()))
    held = crowds.join(with_most(whole), "node").where(F.col("most") >= F.lit(similarity) * F.col("n") - F.lit(1e-9))
    tasks = F.ceil(F.count_if(F.col("c") != F.col("lead")) * F.count("*") / WORK).cast("int").alias("tasks")
    held = held.join(held.groupBy("h").agg(tasks).where("tasks > 0"), "h").join(whole, "node")
    one = held.where("c <> lead").withColumn("task", F.pmod(F.hash("node"), F.col("tasks")))
    all_ = held.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    enough = F.least("a.most", "b.most") >= F.lit(similarity / (1 + similarity)) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-9)
    met = _of_similarity(F.size(F.array_intersect("a.set", "b.set")), F.col("a.n") + F.col("b.n"), similarity)
    with setting(nodes.sparkSession, "spark.sql.adaptive.skewJoin.enabled", "false"):  # its tasks are cut by their work already
        crowded = stored(all_.alias("b").join(one.alias("a"), same & (F.col("a.task") == F.col("b.task")) & differ & once & may & enough & met).select(*ends))
    return edges.union(close).union(crowded)


def with_most(sets: DataFrame) -> DataFrame:
    """(`node`, `most`): how many elements of a set any other of the `sets` has, the most that it can share with one."""
    each = sets.select("node", F.explode("set").alias("v"))
    lone = each.groupBy("v").agg(F.min("node").alias("of"), F.count("*").alias("times")).where("times = 1").groupBy("of").agg(F.count("*").alias("lone"))
    return sets.join(lone, F.col("node") == F.col("of"), "left").select("node", (F.size("set") - F.coalesce("lone", F.lit(0))).alias("most"))


def pivots(rows: DataFrame, turn: int, each: int) -> DataFrame:
    """Up to `each` of the `rows` of every list `h`, by a hash: lists of the same nodes have the same."""
    order = F.xxhash64("node", F.lit(turn))
    return rows.groupBy("h", F.pmod(order, F.lit(each)).alias("nth")).agg(F.min(F.struct(order.alias("o"), "node", "fp", "n")).alias("m")).select("h", "m.*").drop("o")


def components(edges: DataFrame) -> DataFrame:
    return stored(connected_components(edges).select(F.col("node").alias("of"), "component"))


def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The `rows` of lists `h` that are not one of the components `found`, with their component `c` and the list's largest, `lead`."""
    placed = rows.join(found, F.col("node") == F.col("of"), "left").withColumn("c", F.coalesce("component", "node")).drop("of", "component")
    lead = placed.groupBy("h", "c").count().groupBy("h").agg(F.max_by("c", F.struct("count", "c")).alias("lead"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    return stored(placed.join(lead, "h"))


def groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(`digest`, `first`): the smallest id that the links of a set reach, its own included."""
    found = connected_components(edges)
    named = found.join(nodes.select("node", "least"), "node")
    whole = named.groupBy("component").agg(F.min("least").alias("first"))
    reached = named.join(whole, "component").select(F.col("node").alias("of"), "first")
    return nodes.join(reached, F.col("node") == F.col("of"), "left").select("digest", F.coalesce("first", "least").alias("first"))
