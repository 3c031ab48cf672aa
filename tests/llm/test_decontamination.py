import random
from collections import Counter

import pytest

from tallyspark.llm.decontamination import candidates, find_passages, without_passages

W = lambda t: (t or "").encode().lower().split()


def shingles(w, n):
    k = min(5, n)
    return Counter(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items, least=0.8):
    """The best similarity of any window of the item's size, for each document and item."""
    best = {}
    for d, t in rows:
        w = W(t)
        for i, x in items:
            n, c = len(W(x)), shingles(W(x), len(W(x))) if W(x) else None
            if not c or d is None:
                continue
            for s in range(max(1, len(w) - n + 1)):
                o = shingles(w[s : s + n], n)
                shared = sum((c & o).values())
                j = shared / (sum(c.values()) + sum(o.values()) - shared)
                if j >= least:
                    best[d, i] = max(j, best.get((d, i), 0))
    return best


@pytest.fixture
def items(spark, prose):
    rows = [(i, prose(12 + 7 * i, 100 + i)) for i in range(6)] + [(6, "too short item"), (7, None), (8, "a a a a a a a a b"), (9, "Single"), (10, "two words"), (11, "this has four words"), (None, "x y z u v w")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_matches_brute_force(docs, prose, items):
    known, table = items
    x = {i: t.split() for i, t in known if t}
    rows = [(1, prose(80, 1) + " " + " ".join(x[2]) + " " + prose(50, 2)), (2, prose(200, 3)), (3, " ".join(x[3])), (4, " ".join(x[3][1:])), (5, " ".join(["new", *x[5][:-1]])), (6, prose(30, 5) + " " + " ".join(x[5][:20] + ["changed"] + x[5][21:]))]
    rows += [(7, " ".join(x[4][:20] + ["inserted"] + x[4][20:])), (8, None), (9, ""), (10, "a a a a a a a a b"), (11, "a a a a a a a a a a a a b"), (12, " ".join(x[1] + x[1])), (13, " ".join(x[0]).upper()), (14, "now a single, a SINGLE one"), (15, "words two two words"), (16, prose(9, 7) + " this has four words " + prose(9, 8)), (17, "too short item too short"), (18, "two"), (None, " ".join(x[2])), (3, " ".join(x[3]))]
    got = {(r.doc_id, r.item_id): r.similarity for r in find_passages(docs(rows), table).collect()}
    want = brute(rows, known)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_the_index_misses_no_pair_within_the_radius(spark):
    r = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, i % 3, r.getrandbits(64)) for i in range(30)]
    windows = [(k, k % 3, k, items[r.randrange(30)][2] ^ sum(1 << b for b in r.sample(range(64), k % 30))) for k in range(300)]
    made = candidates(spark.createDataFrame([(*w[:3], signed(w[3])) for w in windows], "id long, n int, start int, fp long"), spark.createDataFrame([(*i[:2], signed(i[2])) for i in items], "item long, n int, ifp long"), 12)
    got = sorted((x.id, x.item, x.distance) for x in made.collect())
    assert got == sorted((w[0], i[0], (w[3] ^ i[2]).bit_count()) for w in windows for i in items if w[1] == i[1] and (w[3] ^ i[2]).bit_count() <= 12) and got


def test_repeated_words_and_a_very_long_text(spark, docs):
    known = spark.createDataFrame([(1, "same " * 200)], "item_id long, text string")
    got = {r.doc_id: (r.start, r.similarity) for r in find_passages(docs([(1, "same " * 3_000), (2, "other " * 100_000 + "same " * 200), (3, "other " * 5_000)]), known).collect()}
    assert got == {1: (0, 1.0), 2: (100_000, 1.0)}


def test_documents_with_passages_go(docs, prose, items):
    known, table = items
    rows = [(1, prose(80, 1) + " " + known[2][1]), (2, prose(200, 3)), (3, None), (None, known[2][1])]
    assert sorted(map(str, (r.doc_id for r in without_passages(docs(rows), table).collect()))) == ["2", "3", "None"]


def test_windows_between_alignments(spark, docs, prose):
    """Replaced ends and words inserted, removed and repeated: the best window may lie at no shingle's own offset."""
    item = prose(59, 700).split()
    known = [(0, " ".join(item)), (1, prose(20, 701))]
    rows = []
    for k in range(1, 58):
        rows.append((k, ["new", *item[1:k], "put", "in", *item[k:-1], "last"]))
        rows.append((100 + k, ["new", *item[1:k], "in", *item[k:]]))
        rows.append((200 + k, [*item[:k], *item[k + 2 :]]))
        rows.append((300 + k, [*item[:k], *item[k - 1 :]]))
    around = [(i, f"{prose(30, i + 1000)} {' '.join(w)} {prose(9, i + 2000)}" if i % 3 else " ".join(w)) for i, w in rows]
    got = {(r.doc_id, r.item_id): r.similarity for r in find_passages(docs(around), spark.createDataFrame(known, "item_id long, text string")).collect()}
    want = brute(around, known)
    assert got.keys() == want.keys() and any(i < 100 for i, _ in want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_odd_rows(spark, odd, items):
    _, table = items
    assert find_passages(odd, table).count() == 0
    assert without_passages(odd, table).count() == odd.count()
    assert find_passages(odd.limit(0), table).count() == 0
    assert find_passages(odd, table.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "same text here now and more words")], "item_id long, text string")
    assert find_passages(odd, same).count() == 0
