from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.filter_audit import audit, judged, op13_filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def flags(rows):
    """(id, text, lang) to (part, letters that it fails), by the letter."""
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        out.append((i, lang or "", fails + "E" * (i is not None and any(j < i for j in texts[t]))))
    return out


def brute(rows, labels, filters="ABCDE"):
    out = {}
    judged_rows = flags(rows)
    for part in {p for _, p, _ in judged_rows}:
        own = [(i, f) for i, p, f in judged_rows if p == part]
        worth = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                worth[f] += len(gone)
                count = lambda k: sum(labels.get(i, (0, 0))[k] for i, _ in gone)  # noqa: B023, E731
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == f for x in own), count(0), count(1), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = worth[v[-1]]
    return {(*k, *v) for k, v in out.items()}


@pytest.fixture
def rows(prose):
    """Texts that fail each of many sets of filters, in two languages and none."""
    out = []
    for i in range(90):
        t = prose(230 if i % 3 else 40, i, 4000 if i % 5 else 30)
        t = t.upper() if i % 4 == 0 else t
        t = t + " a|b" if i % 7 == 0 else t
        out.append((i, t if i < 70 else out[i - 70][1], ("en", "de", None)[i % 3]))
    return [*out, (100, None, "fr"), (101, "", "fr"), (101, "", "fr"), (None, "", "fr"), (102, "Aé" * 100, "fr"), (103, "x\x0by\x85z\xa0 " * 300, "en")]


@pytest.fixture
def tables(spark, rows):
    labels = {i: (i % 2, int(i % 5 == 1)) for i in range(0, 103, 3)}
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, good boolean")
    known = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, known, labels


def test_against_all_permutations(tables, rows):
    docs, known, labels = tables
    got = audit(judged(docs, known), list("ABCDE"))
    assert got.columns == COLUMNS
    got = [tuple(r) for r in got.collect()]
    assert len(got) == 4 * 600 and set(got) == brute(rows, labels)


def test_two_filters_of_ones_own(spark):
    rows = [("p", True, False, True, False), ("p", True, True, False, True), ("p", False, False, True, True), ("q", False, False, False, False)]
    got = audit(spark.createDataFrame(rows, "part string, X boolean, Y boolean, good boolean, toxic boolean"), ["X", "Y"]).collect()
    assert {tuple(r) for r in got} == {
        ("p", "XY", 1, 1, 2, 0, 1, 1, 1, 3), ("p", "XY", 2, 1, 0, 1, 0, 0, 0, 1), ("p", "YX", 1, 2, 1, 0, 0, 0, 1, 1), ("p", "YX", 2, 1, 1, 1, 1, 1, 0, 3),
        ("q", "XY", 1, 1, 0, 0, 0, 0, 0, 0), ("q", "XY", 2, 1, 0, 0, 0, 0, 0, 0), ("q", "YX", 1, 1, 0, 0, 0, 0, 0, 0), ("q", "YX", 2, 1, 0, 0, 0, 0, 0, 0),
    }
    with pytest.raises(ValueError):
        audit(spark.createDataFrame([], "part string"), list("ABCDEFGHI"))


def test_odd_rows(spark, odd, tables):
    known = tables[1]
    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    got = audit(judged(rows, known), list("ABCDE")).where("filter_order = 'EDCBA'").orderBy("step").collect()
    assert {r.part for r in got} == {""} and [r.removed for r in got] == [2, 0, 1, 1, 7]
    assert audit(judged(rows.limit(0), known), list("ABCDE")).count() == 0


def test_a_very_long_text(spark, tables):
    docs = spark.createDataFrame([(0, "long words here " * 200_000, "en")], "doc_id long, text string, lang string")
    got = audit(judged(docs, tables[1]), list("ABCDE")).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r.removed for r in got] == [0, 1, 0, 0, 0]


def test_query_leaves_no_persisted_rows(spark, tables, rows, tmp_path):
    docs, known, labels = tables
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    assert {tuple(r) for r in op13_filter_audit(spark, str(tmp_path)).collect()} == brute(rows, labels)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
