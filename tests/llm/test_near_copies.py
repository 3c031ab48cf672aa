import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import near_copies
from tallyspark.llm.components import connected_components
from tallyspark.llm.near_copies import indexed, keep_first
from tallyspark.llm.set_links import linked, nodes_of, sets_of, sketches, small_batches, with_most


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def first_of_groups(rows):
    sets, group = {i: shingles(t) for i, t in rows}, {}
    for i in sorted(sets):
        group[i] = i
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or (x | y) and len(x & y) / len(x | y) >= 0.8):
                p, q = sorted((group[a], group[b]))
                group = {i: p if g == q else g for i, g in group.items()}
    return group


@pytest.fixture
def rows(prose):
    """Texts with few and many words changed, chains of them, and texts of few words."""
    r, out = random.Random(4), []
    for k in range(12):
        w = prose(90 + 20 * k, 40 + k).split()
        for v in range(8):
            out.append((100 * k + v, " ".join(w)))
            for _ in range(1 + v % 3):
                w[r.randrange(len(w))] = f"new{k}{v}"
    return [*out, (5000, None), (5001, " "), (5002, "a b"), (5003, "A b"), (5004, "a b c d e"), (5005, "a c")]


def test_one_of_each_group_stays(docs, rows):
    want = sorted(set(first_of_groups(rows).values()))
    assert sorted(r.doc_id for r in keep_first(docs(rows)).collect()) == want
    assert len(want) < 40


@pytest.mark.parametrize("long_list", [4, 16])
def test_long_lists_leave_no_link_out(spark, docs, rows, long_list):
    table = docs(rows)
    with small_batches(spark):
        made = sketches(table, {"id": F.col("doc_id")}, F.col("text"), 5, bits=True)
        nodes = nodes_of(made, 0.8)
        found = connected_components(linked(nodes, sets_of(table, F.col("doc_id"), F.col("text"), nodes, 5), 0.8, 24, long_list=long_list))
    ids = {r.node: r.least for r in nodes.collect()}
    lowest = {}
    for r in found.collect():
        lowest.setdefault(r.component, []).append(ids[r.node])
    found = {i: min(group) for group in lowest.values() for i in group}
    same = {}
    for i, t in rows:
        same.setdefault(shingles(t), i)
    found = {i: found.get(same[shingles(t)], same[shingles(t)]) for i, t in rows}
    want = {i: g for i, g in first_of_groups(rows).items() if shingles(dict(rows)[i])}
    assert {i: found[i] for i in want} == want


def test_the_index_of_simhashes_gives_candidates(spark, docs, rows, monkeypatch):
    """Operator 8's index connects what is within two bits, and the stage compares what it connects."""
    with small_batches(spark):
        nodes = nodes_of(sketches(docs(rows), {"id": F.col("doc_id")}, F.col("text"), 5, bits=True), 0.8)
        made = {r.node: r.fp for r in nodes.where("n > 0").collect()}
        found = {r.node: r.component for r in connected_components(indexed(nodes)).collect()}
    want = {i: i for i in made}
    for a in sorted(made):
        for b in made:
            if a < b and ((made[a] ^ made[b]) & 2**64 - 1).bit_count() <= 2 and want[a] != want[b]:
                p, q = sorted((want[a], want[b]))
                want = {i: p if g == q else g for i, g in want.items()}
    assert {i: found.get(i, i) for i in made} == want and len(set(want.values())) < len(made)
    asked = []
    monkeypatch.setattr(near_copies, "linked", lambda *a, near, **b: asked.append(near.count()) or linked(*a, near=near, **b))
    keep_first(docs(rows)).count()
    assert asked and asked[0] >= len(made) - len(set(want.values()))


def test_elements_that_others_have_are_counted_without_a_join_of_elements(spark):
    sets = {1: [1, 2, 3], 2: [2, 3, 4], 3: [9, 10], 4: [3], 5: [11, 4]}
    most = with_most(spark.createDataFrame(list(sets.items()), "node long, set array<long>"))
    want = {i: sum(any(v in w for j, w in sets.items() if j != i) for v in x) for i, x in sets.items()}
    assert {r.node: r.most for r in most.collect()} == want
    assert "LeftSemi" not in most._jdf.queryExecution().optimizedPlan().toString()


def test_odd_rows(odd):
    assert sorted(str(r.doc_id) for r in keep_first(odd).collect()) == ["0", "3", "5", "6", "8", "9", "None"]
    assert keep_first(odd.limit(0)).count() == 0
