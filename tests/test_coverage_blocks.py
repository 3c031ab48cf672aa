"""Sentences in blocks, and key phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.operators.coverage import keyphrases, sentence_coverage


@pytest.fixture
def sides(spark):
    r = np.random.default_rng(5)
    rows = lambda n, many: [(n, i, v.tolist()) for i, v in enumerate(r.normal(size=(many, 4)))]
    schema = "k string, sentence long, vector array<double>"
    one = rows("hot", 700) + rows("a", 5) + rows("b", 3) + rows("alone", 2) + [("a", 9, [0.0] * 4)]
    two = rows("hot", 500) + rows("a", 4) + rows("b", 9)
    return spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)


@pytest.mark.parametrize("pairs, block", [(1000, 256), (0, 10_000)])
def test_blocks_give_what_the_join_gives(sides, pairs, block):
    of = lambda **more: {r.k: [round(x, 12) for x in r[1:]] for r in sentence_coverage(*sides, "k", **more).collect()}
    whole = of()
    assert set(whole) == {"hot", "a", "b"} and of(pairs=pairs, block=block) == whole


def test_a_hot_key_makes_no_row_of_a_pair(spark):
    """4,000 by 4,000 sentences: 16 million pairs."""
    r = np.random.default_rng(1)
    rows = [("hot", i, v.tolist()) for i, v in enumerate(r.normal(size=(4000, 8)))]
    df = spark.createDataFrame(rows, "k string, sentence long, vector array<double>")
    got = sentence_coverage(df, df, "k", (0.9, 1.0 - 1e-9)).collect()
    assert [tuple(x) for x in got] == [("hot", 1.0, 1.0, 1.0, 1.0)]


def brute(text, top, least):
    phrases, now = [], []
    for w in [*re.findall(r"[^\W\d_]+|[^\w\s]|[\d_]", text.lower()), "|"]:
        if w.isalpha() and len(w) >= least:
            now.append(w)
        elif now:
            phrases, now = [*phrases, tuple(now)], []
    times, degree = Counter(w for p in phrases for w in p), Counter()
    for p in phrases:
        for w in p:
            degree[w] += len(p)
    scored = {" ".join(p): round(sum(degree[w] / times[w] for w in p), 6) for p in phrases}
    return [(p, s, i) for i, (p, s) in enumerate(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:top], 1)]


def test_keyphrases(spark):
    r = random.Random(2)
    names = ["alpha", "beta", "of", "gamma", "the", "delta", "a", "Été", "x9y", "long"]
    texts = {i: "".join(r.choice(names) + r.choice([" ", " ", ", ", ".\n", " 7 "]) for _ in range(r.randrange(60))) for i in range(40)}
    rows = [*texts.items(), (100, None), (101, ""), (102, "of the, a"), (None, "alpha beta")]
    got = {}
    for x in keyphrases(spark.createDataFrame(rows, "id long, t string"), "id", "t", 4).orderBy("id", "place").collect():
        got.setdefault(x.id, []).append((x.phrase, x.score, x.place))
    assert got == {i: found for i, t in texts.items() if (found := brute(t, 4, 4))}


def test_phrases_of_texts_meet_in_one_shuffle(spark):
    df = spark.createDataFrame([(1, "Great walls stand, great walls fall. Small hut"), (1, "great walls"), (2, None), (None, "great walls"), (3, "a b c")], "k long, t string")
    out = keyphrases(df, "k", "t")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = [(r.k, r.phrase, r.score, r.place) for r in sorted(out.collect(), key=lambda r: r.place)]
    assert got == [(1, "great walls fall", 8.333333, 1), (1, "great walls stand", 8.333333, 2), (1, "great walls", 5.333333, 3), (1, "small", 1.0, 4)]
