"""Operator 13: how filters interact, by a trie of their permutations over persisted survivors."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Carried, documents, forget, settled, stored, words

#: Parts into which the rows of one text are dealt when they meet its smallest id.
SALTS = 16
#: Filters at most: the result has a row for each step of each of their permutations.
MOST_FILTERS = 8


def failures(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, marks: str = "#$%&*|") -> dict[str, Column]:
    """Whether a text fails, by filter: A few words, B few distinct words, C many of A-Z, D any of the `marks`.  A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    return {
        "A": F.size(w) < min_words,
        "B": F.lit(100) * F.size(F.array_distinct(w)) < F.lit(distinct_percent) * F.size(w),
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(upper_percent) * F.length(text),
        "D": text.rlike("[" + "".join(f"\\{m}" for m in marks) + "]"),
    }


def with_repeats(rows: DataFrame, key: str, hashes: list[str], name: str) -> DataFrame:
    """`rows` with `name`: whether a smaller `key` has the same `hashes`.  A third of the rows may have the same: they are dealt over `SALTS` tasks, and
    their smallest key is found by minima that are combined before their shuffle.  A null key is neither smaller nor larger than another."""
    first = rows.groupBy(*hashes).agg(F.min(key).alias("__least"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    first = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return dealt.join(first, [*hashes, "__salt"], "left").withColumn(name, F.coalesce(F.col(key) > F.col("__least"), F.lit(False))).drop("__least", "__salt")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A short row for each of `docs`: `part`, a boolean for each filter (A to E), `good` and `toxic`.  See `audit` for odd rows."""
    c = Carried(docs)
    text = F.coalesce(c.col(text_col), F.lit(""))
    found = failures(F.col("t"))
    rows = c.df.select(c.col(id_col).alias("id"), F.coalesce(c.col(part_col), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), F.col("t")).alias("g"), *[F.coalesce(x, F.lit(False)).alias(f) for f, x in found.items()])
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*[F.coalesce(F.max(F.col(x) == 1), F.lit(False)).alias(name) for x, name in (("quality", "good"), ("toxic", "toxic"))])
    told = with_repeats(stored(rows), "id", ["h", "g"], "E").join(known, F.col("id") == F.col("of"), "left")
    return told.select("part", *found, "E", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])


def _edges(rows: DataFrame, filters: list[str]) -> DataFrame:
    """(`part`, `state`, `filter`, `before`, `removed`, `good_lost`, `toxic_lost`) for each filter behind each unordered state of filters that were applied.

    Depth first through the trie of permutations: a node's survivors are persisted while what is below it runs, and each unordered state is
    visited once, by the first permutation that reaches it; the others share its counts.  The edges that leave a state are
    counted in one pass over its survivors.  Survivors are short rows, read again from `rows`, a written table, where an executor that held them is lost.
    """
    bit, out, seen = {f: 1 << i for i, f in enumerate(filters)}, [], set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [f for f in filters if not state & bit[f]]
        sums = [F.count_if(F.col(f) & F.col(also) if also else F.col(f)).alias(f"{f}_{n}") for f in left for n, also in enumerate((None, "good", "toxic"))]
        counted = survivors.groupBy("part").agg(F.count("*").alias("before"), *sums)
        each = F.inline(F.array(*[F.struct(F.lit(f).alias("filter"), *[F.col(f"{f}_{n}").alias(x) for n, x in enumerate(("removed", "good_lost", "toxic_lost"))]) for f in left]))
        out.append(stored(counted.select("part", F.lit(state).alias("state"), "before", each)))
        for f in left:
            below = state | bit[f]
            if below not in seen and len(left) > 1:
                kept = survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                try:
                    visit(below, kept)
                finally:
                    kept.unpersist()

    visit(0, rows)
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """What each filter removes, in each order of all `filters`: `part`, `filter_order`, `step` (from 1), `kept`, `removed`, `redundant`, `unique_fails`,
    `good_lost`, `toxic_lost`, `shapley`.

    `rows` have `part`, a boolean column (true: fails) for each filter, whose name is one letter, `good` and `toxic`; see `judged`.  Counts are of
    rows of the part: left after the step; removed by it; failing its filter and removed earlier; failing no other filter; removed by it and good, or
    toxic; removed by its filter at any step, summed over all orders.  Zeros are rows, too.

    Repeated rows count each.  An empty table gives an empty result.  More than `MOST_FILTERS` filters are refused, as their orders grow with the factorial.
    In `judged`, null texts are empty, null parts are '', a null id is no repeat and makes none, and has no label; ids that repeat with
    the same text are no repeats of each other; of several labels of an id one is enough.  Other columns are left behind, whatever
    their names.  A text is one value of its row, however long it is.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    spark, n = rows.sparkSession, len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    counts = settled(lambda: _edges(rows, filters))
    fails = sum((F.col(f).cast("int") for f in filters), F.lit(0))
    totals = rows.groupBy("part").agg(*[x for f in filters for x in (F.count_if(f).alias(f"{f}_fails"), F.count_if(F.col(f) & (fails == 1)).alias(f"{f}_alone"))])
    grid = [F.struct(F.lit(f).alias("filter"), F.lit(s).alias("state"), F.col(f"{f}_fails").alias("fails"), F.col(f"{f}_alone").alias("unique_fails")) for f in filters for s in range(1 << n) if not s & bit[f]]
    whole = totals.select("part", F.inline(F.array(*grid))).join(counts, ["part", "state", "filter"], "left").na.fill(0)
    others = F.bit_count("state")
    orders = F.factorial(others) * F.factorial(F.lit(n - 1) - others)
    worth = whole.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = [("".join(p), i + 1, f, sum(bit[x] for x in p[:i])) for p in permutations(filters) for i, f in enumerate(p)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    out = whole.join(worth, ["part", "filter"]).join(steps, ["filter", "state"])
    return out.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(lambda: judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return audit(rows, ["A", "B", "C", "D", "E"])


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE_CLASS}+'), x -> x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN known USING (doc_id)
),
cells AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM bits GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
p AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31
),
steps AS (SELECT filter_order, s AS step, bs[s] AS b, list_sum(bs[:s - 1])::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS s FROM p)),
counted AS (
  SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (m & (coalesce(before, 0) | b) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (m & coalesce(before, 0) = 0 AND m & b > 0), 0) AS removed, coalesce(sum(n) FILTER (m & coalesce(before, 0) > 0 AND m & b > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (m = b), 0) AS unique_fails, coalesce(sum(g) FILTER (m & coalesce(before, 0) = 0 AND m & b > 0), 0) AS good_lost, coalesce(sum(x) FILTER (m & coalesce(before, 0) = 0 AND m & b > 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM counted
"""
