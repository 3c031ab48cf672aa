import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import turn_repair
from tallyspark.llm.turn_repair import CODES, Costs, damaged, op12_turn_repair, repair, steps, through, ways

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile("(s?(ua)+)?")
sys.setrecursionlimit(20_000)


def classes(rows):
    """Rows in order to (fault, letter)."""
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((fault, role[:1]))
    return out


def cheapest(faults, costs=(1, 2, 5, 5)):
    """The least (cost, edits), over whole strings, from the last turn on."""
    rerole, delete, insert, cut = costs

    @lru_cache(None)
    def best(i, state, runs):
        found = []
        if runs < 2:
            role = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            c, e = best(i, role, runs + 1)
            found.append((c + insert, "I" + e))
        if i == len(faults):
            return min([*found, (0, "")] if state in ("", "a") else found or [(10**9, "")])
        fault, initial = faults[i]
        c, e = best(i + 1, state, 0)
        found.append((c + delete, "D" + e))
        if fault not in ("blank", "duplicate"):
            extra = cut if fault else 0
            for to in "sua":
                if not FORM.fullmatch(({"": "", "s": "s", "u": "u", "a": "ua"}[state] + to + {"s": "ua", "u": "a", "a": ""}[to])):
                    continue
                if to == initial:
                    c, e = best(i + 1, to, 0)
                    found.append((c + extra, "K" + e))
                elif to != "s":
                    c, e = best(i + 1, to, 0)
                    found.append((c + rerole + extra, "R" + e))
        return min(found)

    return best(0, "", 0)


def applied(rows, edits):
    out, rows = [], iter(rows)
    for e in edits:
        role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[out[-1][0][:1] if out else ""]
        if e == "I":
            out.append((role, ""))
        else:
            _, was, text = next(rows)
            if e != "D":
                out.append((was if e == "K" else role, text))
    assert FORM.fullmatch("".join(r[:1] for r, _ in out)), edits
    return out


def brute(rows, costs=(1, 2, 5, 5)):
    """All of one conversation's result, from (turn, role, text)."""
    rows = sorted(((t, r or (" " if r is None else ""), x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    told = classes(rows)
    cost, audit = cheapest(tuple(told), costs)
    turns = [t for t, _, _ in rows if t is not None]
    counts = [sum(f == kind for f, _ in told) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    kept = applied(rows, audit)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())


def conversations(n, seed, most=9, roles=("user", "assistant", "system", "user", "assistant", "tool", None, "")):
    r, out = random.Random(seed), []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            role = r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            text = r.choice(["Yes.", "So?", "cut off", "", " \n", None, f"Turn {t}!", f"Other {t}. "])
            out.append((c if c else None, None if r.random() < 0.1 else t + r.randrange(3), role, text))
    return out


def by_conversation(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(tuple(r))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("block, costs", [(4096, (1, 2, 5, 5)), (2, (1, 2, 5, 5)), (3, (3, 7, 1, 2)), (1, (9, 20, 2, 1))])
def test_against_whole_strings(spark, monkeypatch, block, costs):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = conversations(150, block, 12)
    got = {r.conv_id: tuple(r[x] for x in COLUMNS) for r in repair(spark.createDataFrame(rows, SCHEMA), Costs(*costs)).collect()}
    assert got == {c: brute(own, costs) for c, own in by_conversation(rows).items()}


def test_least_strings_of_all_edits():
    """Every edit string there is, of up to three turns."""
    for faults in product([("", "u"), ("", "a"), ("", "s"), ("blank", "u"), ("truncated", "a")], repeat=3):
        letters = ["d" if f == "blank" else i.upper() if f else i for f, i in faults]
        costs = Costs(2, 3, 1, 1)
        of = {x: steps(x, costs) for x in "dsuaxSUAX"}
        every = {}
        for codes in product(range(len(CODES)), repeat=3):
            state, cost = 0, 0
            for letter, code in zip(letters, codes, strict=True):
                step = [(to, c) for s, to, at, c in of[letter] if s == state and at == code]
                if not step:
                    break
                state, cost = step[0][0], cost + step[0][1]
            else:
                word = "".join(CODES[c] for c in codes)
                every[state] = min(every.get(state, (10**9, "")), (cost, word))
        found = ways("".join(letters), (0,), of)
        assert {q: w for (_, q), w in found.items()} == every


def test_codes_are_free_of_prefixes_and_in_order():
    assert CODES == sorted(CODES) and not any(a != b and b.startswith(a) for a in CODES for b in CODES)
    assert through([], 2) == ([None, None, (0, 0), None], [])


@pytest.mark.parametrize("block", [4, 64])
def test_one_conversation_over_many_partitions(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice([f"Text {t}.", "Same.", "cut", " "])) for t in range(0, 900) if t % 50]
    rows += [(8, 0, "user", "Q?"), (8, 1, "assistant", "A.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {x.conv_id: tuple(x[c] for c in COLUMNS) for x in repair(spark.createDataFrame(rows, SCHEMA)).collect()}
        turns = repair(spark.createDataFrame(rows, SCHEMA), turns=True).where("conv_id = 7").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: brute(own) for c, own in by_conversation(rows).items()}
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == got[7][-1]
    assert "".join(t.edit for t in turns) == got[7][-2].replace("D", "")


def test_damage_and_query(spark, tmp_path):
    rows = [(c, None if c == 5 and t == 1 else t, ("user", "assistant")[t % 2], f"Said {c} {t}." if c % 9 else None) for c in range(240) for t in range(1 + c % 6)]
    rows += [(None, 0, "user", "Lost."), (None, None, None, "x")]
    spark.createDataFrame(rows, SCHEMA).withColumn("Conv_Id2", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    made = {}
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        made.setdefault(c, []).extend([(t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    out = op12_turn_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", *COLUMNS]
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    want = {c: brute(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, own in made.items()}
    assert got == want and any(not own for own in made.values())
    assert damaged(spark.createDataFrame(rows, SCHEMA)).count() == sum(map(len, made.values()))


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair(none).count() == 0 == repair(none, turns=True).count()
    long = "é😀 " * 300_000 + "."
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "A."), (1, None, "system", "S.")], SCHEMA).selectExpr("*", "1 AS part", "2 AS Turn2", "'x' AS edits", "3 AS h")
    got = repair(rows).collect()
    assert [(r.n_rows, r.gaps, r.duplicate, r.cost, r.audit) for r in got] == [(4, 0, 1, 2, "KKDK")]
    with pytest.raises(ValueError):
        repair(none, Costs(insert=0))
