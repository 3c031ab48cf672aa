import statistics

from tallyspark.llm.fingerprints import compare_edits

S = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").split())


def edited(x, y):
    x, y = x or "", y or ""
    q = len(x) // 4
    return x[: len(x) - q] + y[:q]


def test_edits_and_likeness(docs, prose):
    rows = [(3 * i, prose(20 + 11 * i, i // 2)) for i in range(60)] + [(1, None), (2, ""), (4, "a"), (5, "é漢😀 b"), (1000, "last one 😀 of all texts")]
    got = {r.doc_id: r for r in compare_edits(docs(rows)).collect()}
    order = sorted(rows)
    errors, prints = [], {}
    for k, (i, x) in enumerate(order):
        y = order[(k + 1) % len(order)][1]
        r = got[i]
        assert r.edited_text == edited(x, y) and r.n_chars == len(x or "")
        errors.append(r.near_edited - len(S(x) & S(r.edited_text)) / len(S(x) | S(r.edited_text)))
        for text, f in ((x or "", r.fingerprint), (r.edited_text, r.edited_fingerprint)):
            assert prints.setdefault(text, f) == f
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert statistics.mean(e * e for e in errors) ** 0.5 < 0.07
    assert abs(statistics.mean(errors)) < 0.03  # the bias is taken off


def test_likeness_of_equal_and_unlike_texts(docs, prose):
    rows = [(1, prose(300, 1)), (2, prose(300, 1)), (3, prose(300, 2))]
    got = {r.doc_id: r for r in compare_edits(docs(rows)).collect()}
    assert got[1].near_next == 1 and got[2].near_next < 0.15


def test_odd_rows(odd):
    got = compare_edits(odd).collect()
    assert len(got) == odd.count()
    assert compare_edits(odd.limit(0)).count() == 0
    one = compare_edits(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1
