"""Operator 9: toxicity by class-conditional Kneser-Ney models.

A class's model gives each word of a text a probability behind the word before it.  It has three kinds of counts, all of them
continuation counts: of pairs of words, by the distinct words before a pair; of single words, by the distinct words before
them; and of spellings, over distinct words, by runs of up to `SPELLED` characters, the shorter ones by the distinct characters before them.
Copies of a line or a text add nothing to such counts.  At each kind
a class's discounted counts are interpolated with the shared ones, and these with the next shorter context:

    P(x | h) = share(h, x) + left(h) * (shared share(h, x) + shared left(h) * P(x | shorter h))

A class's count n of (h, x) keeps what exceeds its discount, a number that grows with the logarithm of the lines counted, as chance counts do, put to
this class's size if it is the larger, and `EXPLAINED` times the other class's count, put to this class's size; share(h, x) is what it keeps, by n(h).  What is taken off, of both classes, is the shared count of (h, x), of which that number
is taken off in its turn; left(h) is what is taken off, by n(h).  So rare expressions, and those that are usual in both
classes, have shared counts alone, and make no difference; an expression that one class has often and the other one seldom does.
Each level sums to 1, so each model is a distribution over all texts.

A text's score is a function of one number: the difference of its two log-likelihoods, divided by its length in words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Carried, documents

#: Labelled rows of each class that a model is fitted on, rows that it is calibrated on, the characters of either, and of the
#: longest text that is fitted on: the bound of what reaches the driver.
MAX_ROWS, MAX_CALIBRATION, MAX_CHARS, LONGEST = 1_000, 2_000, 4_000_000, 100_000
#: Characters of the longest run of a spelling.
SPELLED = 5
#: What is taken off a class's count for each of the other class's.
EXPLAINED = 3.0
START, STOP = "\x02", "\x03"

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split(counts: np.ndarray, context: np.ndarray, contexts: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the two classes' counts of (h, x), one column each, h a number: what (h, x) has, own and shared share together, and what
    h leaves to the next shorter context, both for each class."""
    sums = np.maximum(1, counts.sum(1))
    scale = sums / sums[::-1]
    taken = np.minimum(counts, least * np.maximum(1, scale)[:, None] + EXPLAINED * scale[:, None] * counts[::-1])
    shared = taken.sum(0)

    def parts(n: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(context, n, contexts)
        left = np.where(total > 0, np.bincount(context, off, contexts) / np.maximum(total, 1e-300), 1.0)
        return (n - off) / np.maximum(total, 1e-300)[context], left

    own = [parts(n, off) for n, off in zip(counts, taken, strict=True)]
    share, rest = parts(shared, np.minimum(shared, least))
    return np.array([a + left[context] * share for a, left in own]), np.array([left * rest for _, left in own])


def runs_of(words: Iterable[str]) -> list[Counter]:
    """The runs of each size and their counts; of sizes below `SPELLED`, the distinct characters before them."""
    levels: list[Counter] = [Counter() for _ in range(SPELLED + 1)]
    for w in words:
        w = START + w + STOP
        for i in range(1, len(w)):
            run = w[max(0, i - SPELLED + 1) : i + 1]
            levels[len(run)][run] += 1  # shorter than SPELLED: it begins the word
    for size in range(SPELLED, 1, -1):
        for run in levels[size]:
            levels[size - 1][run[1:]] += 1
    return levels


class KneserNey:
    """The models of two classes of `texts` (lines, as lists of words), each with the counts of its own and the shared ones.

    `pairs` has, by class, what the pairs `keys` (first * n + second, words by number, 0 the start) have; `left` what a first word
    leaves over.  `singles` and `rest`, `runs` and `runs_left` are the same of single words and spellings.  What has nothing is not kept."""

    def __init__(self, texts: list[list[list[str]]]):
        self.least = math.log2(1 + sum(map(len, texts)) / 2) / 2
        self.words = sorted({w for of in texts for words in of for w in words})
        self.at = {w: i + 1 for i, w in enumerate(self.words)} | {START: 0}
        n = self.n = len(self.at)
        found = [self._pairs(of) for of in texts]
        keys = np.union1d(found[0][0], found[1][0])
        counts = np.zeros((2, len(keys)))
        for k, (own, times) in enumerate(found):
            counts[k, np.searchsorted(keys, own)] = times
        singles = np.array([np.bincount(own % n, minlength=n) for own, _ in found], float)
        del found
        pairs, self.left = split(counts, keys // n, n, self.least)
        kept = (pairs > 0).any(0)
        self.keys, self.pairs = keys[kept], pairs[:, kept]
        self.singles, rest = split(singles, np.zeros(n, np.int64), 1, self.least)
        self.rest = rest[:, 0]
        levels = [runs_of(w for w, c in zip(self.words, singles[k, 1:], strict=True) if c) for k in (0, 1)]
        self.letters = 1 + len(levels[0][1].keys() | levels[1][1].keys())  # and all others as one
        self.runs: dict[str, np.ndarray] = {}
        self.runs_left: dict[str, np.ndarray] = {}
        for size in range(1, SPELLED + 1):
            runs = list(levels[0][size].keys() | levels[1][size].keys())
            before: dict[str, int] = {}
            context = np.array([before.setdefault(g[:-1], len(before)) for g in runs], np.int64)
            value, left = split(np.array([[level[size][g] for g in runs] for level in levels], float).reshape(2, -1), context, len(before), self.least)
            self.runs.update((runs[i], value[:, i]) for i in np.flatnonzero((value > 0).any(0)))
            self.runs_left.update((h, left[:, i]) for h, i in before.items())
        self._known: list[dict[str, float]] = [{}, {}]

    def _pairs(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in distinct lines, and how many distinct words come before each."""
        ids: list[int] = []
        for words in {tuple(w) for w in lines}:
            ids += (0, 0)
            ids += map(self.at.__getitem__, words)
        x = np.array(ids, np.int64)
        triples = np.unique((x[:-2] * self.n + x[1:-1]) * self.n + x[2:]) if len(x) > 2 else np.zeros(0, np.int64)
        return np.unique(triples[triples % self.n > 0] % (self.n * self.n), return_counts=True)

    def letter(self, k: int, run: str) -> float:
        """Of the last character of `run` behind the others, in class `k`."""
        if not run:
            return 1 / self.letters
        known = self._known[k].get(run)
        if known is None:
            value, left = self.runs.get(run), self.runs_left.get(run[:-1])
            known = (0.0 if value is None else value[k]) + (1.0 if left is None else left[k]) * self.letter(k, run[1:])
            self._known[k][run] = known
        return known

    def spelling(self, k: int, word: str) -> float:
        w = START + word + STOP
        return math.prod(self.letter(k, w[max(0, i - SPELLED + 1) : i + 1]) for i in range(1, len(w)))

    def single(self, k: int, word: str) -> float:
        return self.singles[k, self.at[word] if word in self.at else 0] + self.rest[k] * self.spelling(k, word)

    def probability(self, k: int, word: str, before: str) -> float:
        a, b = self.at.get(before), self.at.get(word)
        place = np.searchsorted(self.keys, a * self.n + b) if a is not None and b is not None else len(self.keys)
        has = place < len(self.keys) and self.keys[place] == a * self.n + b
        return (self.pairs[k, place] if has else 0.0) + (self.left[k, a] if a is not None else 1.0) * self.single(k, word)


@dataclass
class Model:
    """Both classes' models, compiled for their difference, and the calibration of it."""

    words: dict[str, int] = field(default_factory=dict)  # known words, from 1; 0 is what is before a text
    left: np.ndarray = field(default_factory=lambda: np.ones((2, 1)))  # by known word, and last for all others
    singles: np.ndarray = field(default_factory=lambda: np.ones((2, 1)))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # a * (known words + 1) + b
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    runs: dict[str, float] = field(default_factory=dict)  # log-ratio of the last character
    runs_left: dict[str, float] = field(default_factory=dict)  # log-ratio of what is left behind a run
    rest: float = 0.0
    usual: float = 0.0  # difference of an ordinary text, and of one without words
    scale: float = 1.0  # of the difference, by its spread among ordinary texts
    weights: tuple[float, float] | None = None
    prior: float = 0.0

    @classmethod
    def of(cls, m: KneserNey) -> Model:
        """Of the models of toxic and ordinary texts, in this order."""
        one = np.ones((2, 1))
        singles = np.array([[1.0] + [m.single(k, w) for w in m.words] + [1.0] for k in (0, 1)])
        ratio = lambda f: math.log(f(0) / f(1))
        runs = {g: ratio(lambda k, g=g: m.letter(k, g)) for g in m.runs}
        runs_left = {h: math.log(v[0] / v[1]) for h, v in m.runs_left.items() if v[0] != v[1]}
        return cls({w: i for w, i in m.at.items() if i}, np.hstack([m.left, one]), singles, m.keys, m.pairs, runs, runs_left, math.log(m.rest[0] / m.rest[1]))

    def spelt(self, word: str) -> float:
        """The log-ratio of an unknown word's probabilities."""
        w, total = START + word + STOP, self.rest
        runs, left = self.runs, self.runs_left
        for i in range(1, len(w)):
            for size in range(min(SPELLED, i + 1), 0, -1):
                g = w[i + 1 - size : i + 1]
                v = runs.get(g)
                if v is not None:
                    total += v
                    break
                total += left.get(g[:-1], 0.0)
        return total

    def differences(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """Of each text, the difference of its log-likelihoods, toxic less ordinary, a word; NaN without words."""
        n = len(self.words) + 1
        ids: list[int] = []
        ends: list[int] = []
        odd: list[float] = []
        get = self.words.get
        for t in texts:
            found = tokens(t)
            ids.append(0)
            for w in found:
                i = get(w)
                if i is None:
                    v = cache.get(w)
                    if v is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        cache[w] = v = self.spelt(w)
                    odd.append(v)
                    i = n
                ids.append(i)
            ends.append(len(ids))
        at = np.array(ids, np.int64)
        a, b = at[:-1], at[1:]
        key = np.where((a < n) & (b < n), a * n + b, -1)
        place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        seen = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        p = self.left[:, a] * self.singles[:, b]
        p[:, seen] += self.pairs[:, place[seen]]
        value = np.log(p[0]) - np.log(p[1])
        value[b == n] += odd
        value[b == 0] = 0  # a text's first place is no word
        total = np.r_[0, 0, np.cumsum(value)]  # total[k]: of the places before k
        cut = np.r_[0, ends]
        words = np.diff(cut) - 1
        return np.where(words > 0, (total[cut[1:]] - total[cut[:-1] + 1]) / np.maximum(words, 1), np.nan)

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = self.differences(texts, cache)
        z = self.weights[0] + self.weights[1] * np.arcsinh((np.where(np.isnan(x), self.usual, x) - self.usual) / self.scale)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """From differences and labels.  The difference goes in by asinh, so a few copies of texts fitted on don't set the weight; its scale
        is the spread of ordinary texts, or a tenth of the way to a usual toxic one if that is more."""
        x, y = x[~np.isnan(x)], y[~np.isnan(x)]
        self.usual = float(np.median(x[y == 0])) if (y == 0).any() else 0.0
        spread = np.abs(x[y == 0] - self.usual).mean() if (y == 0).any() else 1.0
        way = np.median(x[y == 1]) - self.usual if (y == 1).any() else 0.0
        self.scale = max(float(spread), float(way) / 10, 1e-6)
        self.weights = calibrated(np.arcsinh((x - self.usual) / self.scale), y)


def calibrated(x: np.ndarray, y: np.ndarray, shrink: float = 1e-3) -> tuple[float, float]:
    """The bias and weight of the difference by logistic regression; rows weigh as they occur, which gives the prior."""
    spread = max(float(np.abs(x).max()), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = shrink * np.array([0, 1])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-6), a.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / spread)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_calibration: int = MAX_CALIBRATION) -> Model:
    """The model of labelled rows whose crc32(id as text) mod 5 is not 0.

    Rows of remainders 1 to 3 give the counts: about `max_rows` ids of either class, chosen by a hash of the id.  Rows of remainder 4,
    about `max_calibration` ids of both classes as they occur, give the calibration and so the prior.  Of either choice texts are taken in the hash's order up to
    `MAX_CHARS` characters, without those over `LONGEST`; so what reaches the driver, and the model that is broadcast, have a bound
    that does not depend on the input.  Equal texts of a class count once, and so does each line.

    Rows with a null id, label or text are no labelled rows; an id with several labels counts as toxic if one says so.  Without
    rows of both classes the score is the share of toxic rows for every text; without calibration rows of both, the rows of the counts
    calibrate.  Empty tables are such a case.  Ties in the hash are in the order of ids.
    """
    c, d = Carried(labels), Carried(docs)
    part = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    known = c.df.select(c.col(id_col).alias("id"), c.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max((F.col("y") != 0).cast("int")).alias("y"))
    known = known.withColumn("kind", F.when(part == 4, 2).otherwise(F.col("y"))).where(part != 0)
    sizes = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
    place = F.shiftrightunsigned(F.xxhash64("id"), 33)
    chosen = F.lit(False)
    for kind, most in ((0, max_rows), (1, max_rows), (2, max_calibration)):
        chosen = chosen | ((F.col("kind") == kind) & (place < int(min(1.0, most / max(1, sizes.get(kind, 0))) * (1 << 31))))
    sample = known.where(chosen).select(F.col("id").alias("__id"), F.col("y").alias("__y"), F.col("kind").alias("__kind"), place.alias("__place"))
    rows = d.df.select(d.col(id_col).alias("__id"), d.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").where(F.length("__text") <= LONGEST)
    order = Window.partitionBy("__kind").orderBy("__place", "__id", "__text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__sum", F.sum(F.length("__text").cast("long")).over(order)).where(F.col("__sum") <= MAX_CHARS)
    told = rows.select("__kind", "__y", "__text").collect()  # the bounded sample
    lines: list[list[list[str]]] = [[], []]
    for r in sorted({(r[0], r[2]) for r in told if r[0] < 2}):
        lines[1 - r[0]] += [tokens(x) for x in r[1].split("\n")]
    if not any(map(len, lines[0])) or not any(map(len, lines[1])):
        return Model(prior=sum(r[1] for r in told) / (len(told) + 1))
    model = Model.of(KneserNey(lines))
    seen = [r for r in told if r[0] == 2]
    if len({r[1] for r in seen}) < 2:
        seen = told
    model.calibrate(model.differences([r[2] for r in seen], {}), np.array([r[1] for r in seen], float))
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1; higher: likelier toxic) and `predicted` (1 from 0.5 on).

    The score comes from the text alone, by the length-normalised difference of its log-likelihoods under the two
    models, calibrated.  Works row by row, on whole texts, one at a time.  Null, empty and wordless texts have the difference
    of an ordinary text.  Repeated rows get equal scores; an empty table gives an empty one.  `score` and
    `predicted` replace input columns of those names; other columns, whatever their names, are kept.
    """
    c = Carried(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    cache: dict[str, float] = {}  # each task has its own

    # Takes the text alone to Python and brings back a number; the other columns stay where they are.  A hundred rows go at a time: an Arrow
    # batch would be 10,000 texts, several times over on either side.
    @F.udf("double", useArrow=False)
    def score(text: str | None) -> float:
        return float(held.value.scores([text], cache)[0])

    out = c.df.withColumn("__score", score(c.col(text_col)))
    return c.restore(out, score="__score", predicted=(F.col("__score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))
    return score_toxicity(rows, model).select("doc_id", "held_out", "score", "predicted")
