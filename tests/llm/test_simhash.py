from collections import defaultdict

import numpy as np
import xxhash

from tallyspark.llm.components import connected_components
from tallyspark.llm.common import Carried, setting
from tallyspark.llm.simhash_dedup import fingerprint, first_of, keep_first, links, near_duplicates


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(prints):
    """Smallest id by component, of {id: fingerprint}."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints(prose):
    for t in [None, "", "a", "a b", "a b c", "A B c d", prose(50, 1), prose(40_000, 2)]:
        assert fingerprint(t) == brute(t)


def as_docs(spark, prints):
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints.items()]
    return spark.createDataFrame(signed, "id long, __fp long")


def linked(spark, prints, long_list):
    rows = as_docs(spark, prints)
    least = {}
    for r in rows.collect():
        least[r["__fp"]] = min(r.id, least.get(r["__fp"], r.id))
    found = connected_components(links(rows.select("__fp").distinct(), long_list)).collect()
    whole = defaultdict(list)
    for r in found:
        whole[r.component].append(r.node)
    of = {n: min(least[m] for m in ms) for ms in whole.values() for n in ms}
    return {r.id: of.get(r["__fp"], least[r["__fp"]]) for r in rows.collect()}


def test_links_of_short_and_long_lists(spark):
    rng = np.random.default_rng(5)
    prints, centre = {}, int(rng.integers(0, 1 << 63))
    for i in range(120):  # a dense group: many within two bits of a few centres, chains among them
        f = centre if i % 3 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            f ^= 1 << int(b)
        prints[i] = f
    prints[120] = prints[3]
    want = components(prints)
    assert linked(spark, prints, 64) == want
    assert linked(spark, prints, 2) == want  # nearly all lists are long


def test_texts(docs, prose):
    base = prose(400, 3)
    rows = [(i, base + f" tail{i}") for i in range(5)] + [(5, base), (6, base.upper()), (7, prose(300, 4)), (8, None), (9, ""), (10, " \n"), (11, prose(300, 4) + " x"), (3, base + " tail3")]
    got = near_duplicates(docs(rows)).collect()
    prints = {i: brute(t) for i, t in rows}
    want = components(prints)
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_one_of_each_group_stays(docs, prose):
    base = prose(400, 3)
    rows = [(4, base), (2, base), (2, base), (9, prose(300, 8)), (1, None), (3, "")]
    assert sorted(r.doc_id for r in keep_first(docs(rows)).collect()) == [1, 2, 9]


def test_rows_stay_without_a_shuffle_of_texts(spark, docs):
    """What goes is broadcast whatever its size on disk; beyond the limit each row is shuffled once, with the same result."""
    rows = [(i, f"text {i}") for i in range(40)]
    first = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,)], "__first long")
    for more, want in (([], 20), ([(2, "text 2"), (2, "a"), (3, "b"), (None, "n"), (None, "n"), (None, "m"), (None, None)], 23)):
        c = Carried(docs(rows + more))
        with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
            few, many = (first_of(c, c.col("doc_id"), c.col("text"), first, n) for n in (1000, 0))
            plan = few._jdf.queryExecution().executedPlan().toString()
            got = sorted(map(str, few.collect()))
            assert got == sorted(map(str, many.collect())) and len(got) == want
        assert more or "Exchange hashpartitioning" not in plan
    assert {r.text for r in few.where("doc_id = 2").collect()} == {"a"}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_odd_rows(odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    assert all(r.component_id == 0 for r in got if r.doc_id in (0, 1, 2))
    assert near_duplicates(odd.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in keep_first(odd).collect()) == ["0", "3", "5", "6", "8", "9", "None"]
