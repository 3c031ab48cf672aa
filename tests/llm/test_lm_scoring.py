import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lm_scoring as lm

TRAIN = "crc32(cast(id AS string)) % 10 != 0"


def brute(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))) for i, t in rows), key=str)


@pytest.mark.parametrize("hot", [65_536, 20])
def test_base_matches_brute_force(docs, prose, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    rows = [(i, prose(5 + 13 * i % 90, i)) for i in range(60)] + [(100, None), (101, ""), (102, "É é W1 w1"), (None, "w1 w2"), (7, prose(5 + 13 * 7 % 90, 7))]
    got = lm.score_texts(docs(rows), TRAIN).collect()
    want = brute(rows)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in have], [x[5] for x in want])


def test_model_beats_the_base_on_held_out_texts(docs, prose):
    rows = [(i, "the cat sat on the mat . " * 3 + prose(40, i, 300)) for i in range(200)]
    got = [r for r in lm.score_texts(docs(rows), TRAIN).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_filter_has_all_it_was_given():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 22, 20_000))
    levels = rng.integers(1, 8, len(pairs)).astype(np.int32)
    bits = 8 * math.ceil(levels.sum() * lm.BITS / lm.SHARDS / 8)
    table = np.zeros((lm.SHARDS, bits // 8), np.uint8)
    for s in range(lm.SHARDS):
        mine = lm.shard(pairs) == s
        table[s] = np.frombuffer(lm.filled(pairs[mine], levels[mine], bits), np.uint8)
    model = lm.Model(1, 1, 1, {}, np.zeros(1), bits, table, np.arange(10, dtype=float), np.ones(1))
    assert (model.count_of(pairs) >= levels).all()  # never too low
    others = np.setdiff1d(rng.integers(0, 1 << 22, 20_000), pairs)
    assert (model.count_of(others) > 0).mean() < 0.02
    assert (model.count_of(pairs) > levels).mean() < 0.02


def test_a_words_followers_have_probability_one(docs):
    """The sum over all words, and the unseen class, of the model's probability is 1 up to the counts' quantisation."""
    rows = [(i, "a b a b a c") for i in range(1, 30) if zlib.crc32(str(i).encode()) % 10]
    d = docs(rows).select(F.col("doc_id").alias("id"), "text")
    model, _ = lm.learn(d)
    places = {w: i for w, i in model.hot.items()}
    total = 0.0
    for w in [b"a", b"b", b"c", lm.END]:
        _, score, _ = lm._scored(model, np.array([places[b"a"], places[w]]))
        total += 10 ** score[0]
    total += model.stay[places[b"a"]] * 10 ** float(model.unigram(0))
    assert total == pytest.approx(1, abs=0.02)


def test_odd_rows(odd):
    got = lm.score_texts(odd, TRAIN).collect()
    assert len(got) == odd.count() and all(r.score <= 0 for r in got)
    assert lm.score_texts(odd.limit(0), TRAIN).count() == 0
    none = lm.score_texts(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0 for r in none)


def means(counts):
    """The mean count of each level, 1 + floor(log2 count)."""
    by = {}
    for v in counts:
        by.setdefault(v.bit_length(), []).append(v)
    return {q: sum(v) / len(v) for q, v in by.items()}


@pytest.mark.parametrize("hot, paired", [(65_536, 2_048), (40, 10), (0, 1)])
def test_score_matches_brute_force(spark, docs, prose, monkeypatch, hot, paired):
    """Against the formulas, with counts of all pairs by level; with so many bits a filter errs in no pair."""
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "PAIR_WORDS", paired)
    monkeypatch.setattr(lm, "BITS", 400)
    monkeypatch.setattr(lm, "CHUNK", 100)
    rows = [(i, "rare ones meet " * 2 + prose(5 + 13 * i % 90, i, 200)) for i in range(60)] + [(100, None), (101, "rare ones")]
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    train = [tok(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n = Counter(p for t in train for p in zip([b"", *t], t))  # noqa: B905
    total, once = sum(c.values()), sum(v == 1 for v in c.values())
    top = [b""] + [bytes(r.token) for r in lm._most_frequent(spark.createDataFrame([(bytearray(w), v) for w, v in c.items() if w], "token binary, c long"))]
    head = set(top[:paired])
    kept = [{p: v for p, v in n.items() if (p[0] in head and p[1] in head) == inside} for inside in (True, False)]
    by = [means(k.values()) for k in kept]
    q = {p: by[i][v.bit_length()] for i in (0, 1) for p, v in kept[i].items()}
    unseen = min(0.5, max(1, once) / total)
    weight = lambda a: 4 * c[a] ** 0.8 if a in top else 10
    single = lambda b: c[b] / total * (1 - unseen) if c[b] else unseen
    want = {i: sum(math.log10((q.get((a, b), 0) + weight(a) * single(b)) / (c[a] + weight(a))) for a, b in zip([b"", *tok(t)], tok(t))) for i, t in rows}  # noqa: B905
    got = {r.doc_id: r.score for r in lm.score_texts(docs(rows), TRAIN).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_shards_change_no_count_but_by_their_means(docs, prose, monkeypatch):
    rows = [(i, prose(5 + 13 * i % 90, i, 200)) for i in range(60)]
    whole = {r.doc_id: r.score / r.n_tokens for r in lm.score_texts(docs(rows), TRAIN).collect()}
    monkeypatch.setattr(lm, "SHARD_BYTES", 2_000)
    parts = {r.doc_id: r.score / r.n_tokens for r in lm.score_texts(docs(rows), TRAIN).collect()}
    assert all(parts[i] == pytest.approx(whole[i], abs=0.05) for i in whole)


def test_copies_of_training_texts_score_apart(docs, prose):
    """Held-out copies of texts that are trained on are likelier, a token, than others."""
    learned = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(300, 900) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, prose(80, i)) for i in learned] + [(i, prose(80, learned[k] if k % 2 else 5000 + i)) for k, i in enumerate(held)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_texts(docs(rows), TRAIN).collect()}
    twice, once = [got[i] for k, i in enumerate(held) if k % 2], [got[i] for k, i in enumerate(held) if not k % 2]
    assert min(twice) > max(once)


def test_a_very_long_text_and_repeated_rows(docs):
    got = lm.score_texts(docs([(1, "a b " * 300_000), (2, "a b"), (2, "a b"), (3, "")]), TRAIN).collect()
    assert len(got) == 4 and {r.n_tokens for r in got} == {600_001, 3, 1}
