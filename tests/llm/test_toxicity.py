import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.toxicity import EXPLAINED, SPELLED, START, STOP, KneserNey, Model, fit, score_toxicity, tokens


@pytest.fixture
def corpus(prose):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        t = prose(r.randint(20, 200), i, 500).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                t.insert(r.randrange(len(t)), r.choice(["nastyhead", *(f"grumble{a}{b}" for a in "abcdefg" for b in ("ton", "man", "x"))]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs, corpus):
    rows, labels = corpus
    model = fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in score_toxicity(docs(rows), model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    unseen = docs([(1, "a fine day w1 w2 w3"), (2, "what a GRUMBLEAX and Grumblegton you are"), (3, None), (4, "")])
    said = {r.doc_id: r.predicted for r in score_toxicity(unseen, model).collect()}
    assert said == {1: 0, 2: 1, 3: 0, 4: 0}
    assert model.differences(["grumbleunseen", "alsounseen"], {})[0] > max(0, model.differences(["alsounseen"], {})[0])  # by its spelling


def test_labels_of_held_out_rows_are_not_used(spark, docs, corpus):
    rows, labels = corpus
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (fit(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, wrong))
    assert a.weights == b.weights and a.words == b.words


def test_labels_that_say_nothing(spark, docs, corpus, odd):
    rows, labels = corpus
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(docs(rows), fit(docs(rows), none)).collect()} == {0.0}
    assert fit(docs([]), none).prior == 0
    one_kind = spark.createDataFrame([(i, 0) for i, _ in labels] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert fit(docs(rows), one_kind).prior == 0
    again = spark.createDataFrame(labels + labels[:50], "doc_id long, toxic int")
    model = fit(docs(rows), again)
    assert model.weights is not None
    got = score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(odd.limit(0), model).count() == 0
    assert score_toxicity(odd, Model(prior=0.2)).first().predicted == 0


def counts_of(lines):
    """Continuation counts of pairs, singles and runs, by the definition."""
    triples = {t for words in lines for t in zip([START, START, *words], [START, *words], words)}  # noqa: B905
    pairs, singles = defaultdict(set), defaultdict(set)
    for z, a, b in triples:
        pairs[a, b].add(z)
        singles["", b].add(a)
    runs = [defaultdict(set) for _ in range(SPELLED + 1)]
    for _, b in singles:
        w = START + b + STOP
        for i in range(1, len(w)):
            at = max(0, i - SPELLED + 1)
            runs[i + 1 - at][w[at:i], w[i]].add((b, i))
    runs = [{k: len(v) for k, v in r.items()} for r in runs]
    for size in range(SPELLED, 1, -1):
        for h, x in runs[size]:
            runs[size - 1][h[1:], x] = runs[size - 1].get((h[1:], x), 0) + 1
    size = lambda c: {k: len(v) for k, v in c.items()}
    return [size(pairs), size(singles), *runs]


def brute_probability(both, least, kind, k, h, x, shorter):
    """One level of class `k`: own counts, shared counts, then `shorter`."""
    own, other = both[k][kind], both[1 - k][kind]
    scale = lambda a, b: max(1, sum(a.values())) / max(1, sum(b.values()))
    taken = lambda a, b, key: min(a[key], least * max(1, scale(a, b)) + EXPLAINED * scale(a, b) * b.get(key, 0)) if key in a else 0
    shared = {key: taken(own, other, key) + taken(other, own, key) for key in own.keys() | other.keys() if key[0] == h}
    p = shorter
    if shared:
        total = sum(shared.values())
        p = max(shared.get((h, x), 0) - least, 0) / total + sum(min(v, least) for v in shared.values()) / total * shorter
    mine = {key: n for key, n in own.items() if key[0] == h}
    if not mine:
        return p
    total = sum(mine.values())
    return (mine.get((h, x), 0) - taken(own, other, (h, x))) / total + sum(taken(own, other, key) for key in mine) / total * p


def test_likelihoods_match_brute_force(corpus):
    rows, labels = corpus
    toxic = dict(labels)
    lines = [[tokens(t) for i, t in rows[:120] if toxic[i] == y] for y in (1, 0)]
    model = KneserNey(lines)
    both = [counts_of(x) for x in lines]
    letters = 1 + len({x for b in both for r in b[2:] for _, x in r})

    def word(k, before, w):
        s = START + w + STOP
        spelling = math.prod(brute(k, s[max(0, i - SPELLED + 1) : i + 1]) for i in range(1, len(s)))
        return brute_probability(both, model.least, 0, k, before, w, brute_probability(both, model.least, 1, k, "", w, spelling))

    known = {}

    def brute(k, run):
        if (k, run) not in known:
            known[k, run] = 1 / letters if not run else brute_probability(both, model.least, 2 + len(run), k, run[:-1], run[-1], brute(k, run[1:]))
        return known[k, run]

    texts = [rows[0][1][:200], rows[1][1][:200], "grumbleaton nastyhead quite unseen zzz"]
    for t in texts:
        words = tokens(t)
        want = [sum(math.log(word(k, a, b)) for a, b in zip([START, *words], words)) for k in (0, 1)]  # noqa: B905
        have = [sum(math.log(model.probability(k, b, a)) for a, b in zip([START, *words], words)) for k in (0, 1)]  # noqa: B905
        assert have == pytest.approx(want)
        assert Model.of(model).differences([t], {})[0] == pytest.approx((want[0] - want[1]) / len(words))


def test_models_sum_to_one(corpus):
    rows, labels = corpus
    toxic = dict(labels)
    model = KneserNey([[tokens(t) for i, t in rows[:120] if toxic[i] == y] for y in (1, 0)])
    every = {c for w in model.words for c in w} | {STOP}
    for k in (0, 1):
        for h in ("", START, "a", START + "g", "gru", "rumb"):
            assert sum(model.letter(k, h + x) for x in every) + (model.letters - len(every)) * model.letter(k, h + "?") == pytest.approx(1)
        for a in (START, "nastyhead", model.words[0], "unseen"):
            unknown = 1 - sum(model.spelling(k, w) for w in model.words)
            left = (model.left[k, model.at[a]] if a in model.at else 1.0) * model.rest[k]
            assert sum(model.probability(k, w, a) for w in model.words) + left * unknown == pytest.approx(1)


def test_long_and_repeated_texts(spark, docs, corpus):
    rows, labels = corpus
    model = fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = score_toxicity(docs([(1, "word " * 200_000), (2, rows[0][1]), (2, rows[0][1])]), model).collect()
    assert len(got) == 3 and got[1].score == got[2].score


def test_equal_texts_have_equal_scores_wherever_they_stand(spark, docs, corpus):
    """To the last bit: a text is scored by itself, not by differences of sums over the texts before it."""
    rows, labels = corpus
    model = fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    some = [t for _, t in rows[:40]]
    scored = score_toxicity(docs(list(enumerate(some * 6))).coalesce(1), model)
    assert scored.groupBy("text").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0
