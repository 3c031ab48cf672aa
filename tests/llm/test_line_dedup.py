from collections import defaultdict

from tallyspark.llm.line_dedup import drop_common_lines

STRIP = " \t\n\x0b\x0c\r"


def brute(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                seen[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen[key(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    rows = [(i, "\n".join(["  Common LINE\t", f"own {i}", "É", "é", "", f"third {i % 3}"] * (1 + i % 2))) for i in range(12)]
    rows += [(12, None), (13, ""), (14, "Common line"), (15, "common line\n\n\n"), (16, "x\r")]
    got = drop_common_lines(docs(rows), min_docs=4).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_repeated_lines_in_one_document_count_once(docs):
    got = drop_common_lines(docs([(1, "a\na\na"), (2, "b")]), min_docs=2).collect()
    assert all(r.n_dropped == 0 for r in got)


def test_repeated_rows_are_one_document(docs):
    got = drop_common_lines(docs([(1, "a\nb"), (1, "a\nb"), (2, "a")]), min_docs=2).collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == [(1, "b", 1), (1, "b", 1), (2, "", 1)]


def test_odd_rows(odd):
    got = drop_common_lines(odd, min_docs=2).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.text for r in got}[0] == ""
    assert all(isinstance(r.n_lines, int) for r in got)
    assert drop_common_lines(odd.limit(0)).count() == 0
