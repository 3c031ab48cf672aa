"""Operator 12: the structure of conversations, repaired at the least cost.

A dynamic program runs over the turns of a conversation.  Its steps are macro edits: a run of inserted turns and what is done to the turn behind it.  Their codes
(`CODES`) are free of prefixes, so edit strings of equally many turns compare as their sequences of codes do.  So a layer holds
no strings: each state has its cost, the rank of its edit string among the layer's states, its parent and its code, in a byte.  Blocks of turns are macro
edits once more: of a block the cost and the rank for each way in and out are known, and a second program of the same form runs over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, SPACE_CLASS, Carried, stored
from .set_links import small_batches

#: What has been taken over: nothing, a system turn, a user turn last, an assistant turn last.
NONE, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The state behind a user or assistant turn that is put in, and its role.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: The states behind a turn that is kept, by the initial of its role.
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: Turns put in, and the edit of the turn behind them, in the order of their strings.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: Turns that have to be put in at the end.
TAIL = (0, 2, 1, 0)
#: Turns of a block.
BLOCK = 4096
ENDS = ".!?"
ROW = "conv_id {kind}, part int, block int, at int, turn long, role string, text string, fault string, classes string, fresh boolean, seen int, low long, high long, turns long, illegal long"
MADE = "conv_id {kind}, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id {kind}, place long, role string, text string, edit string"


@dataclass(frozen=True)
class Costs:
    """Of edits, and of a truncated turn that isn't deleted.  All are positive."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def steps(letter: str, costs: Costs) -> list[tuple[int, int, int, int]]:
    """(from, to, place in CODES, cost) of all macro edits of a turn: `d` has to be deleted, otherwise its role's initial, upper case if it is truncated."""
    out = []
    for at, code in enumerate(CODES):
        run, edit = len(code) - 1, code[-1]
        for state in STATES:
            now = state
            for _ in range(run):
                now = NEXT[now]
            cost = run * costs.insert + (costs.truncated if letter.isupper() and edit != "D" else 0)
            kept = KEPT.get(letter.lower(), {}).get(now)
            if edit == "D":
                out.append((state, now, at, cost + costs.delete))
            elif edit == "K" and kept is not None:
                out.append((state, kept, at, cost))
            elif edit == "R" and letter != "d" and kept != NEXT[now]:
                out.append((state, NEXT[now], at, cost + costs.rerole))
    return out


def through(layers: list[list[tuple[int, int, int, int]]], entry: int) -> tuple[list, list[list]]:
    """The last layer's (cost, rank) by state, and each layer's (parent, code) by state, of the cheapest ways from `entry`; of equally cheap ones the least."""
    now: list = [None] * len(STATES)
    now[entry] = (0, 0)
    back = []
    for layer in layers:
        best: list = [None] * len(STATES)
        for state, to, code, cost in layer:
            if now[state] is not None:
                way = (now[state][0] + cost, now[state][1], code, state)
                if best[to] is None or way < best[to]:
                    best[to] = way
        ranks = {x: i for i, x in enumerate(sorted({w[1:3] for w in best if w}))}
        now = [w and (w[0], ranks[w[1:3]]) for w in best]
        back.append([w and (w[3], w[2]) for w in best])
    return now, back


def traced(back: list[list], last: int) -> tuple[int, list[int]]:
    """The state before and the codes of the way that ends in `last`, by parent pointers."""
    out = []
    for layer in reversed(back):
        last, code = layer[last]
        out.append(code)
    return last, out[::-1]


def ways(classes: str, entries: tuple[int, ...], of: dict) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit) to (cost, edits) of a block."""
    layers, out = [of[x] for x in classes], {}
    for entry in entries:
        now, back = through(layers, entry)
        packed = [[w and w[0] * len(CODES) + w[1] for w in layer] for layer in back]
        back = [bytes(255 if w is None else w for w in layer) for layer in packed]
        for last, known in enumerate(now):
            if known:
                codes, at = [], last
                for layer in reversed(back):
                    at, code = divmod(layer[at], len(CODES))
                    codes.append(CODES[code])
                out[entry, last] = (known[0], "".join(reversed(codes)))
    return out


def _letter(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def _placed(kind: str, names: list[str]) -> Callable:
    """Sorted turns to turns with a place and a fault, and a row for each block (`at` -1) with what its turns are, a letter each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), None
        none = object()
        conv, block, fresh, before, turn_before, last = none, -1, False, None, none, ""
        classes, made, turns, low, high, illegal = [], [], 0, None, None, 0

        def closed():
            return [] if conv is none or not classes else [(conv, part, block, -1, None, None, None, None, "".join(classes), fresh, len(classes), low, high, turns, illegal)]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            if schema is None:
                ints, texts = pa.int32(), pa.string()
                schema = pa.schema(list(zip(names, [b.schema.field(0).type, ints, ints, ints, pa.int64(), texts, texts, texts, texts, pa.bool_(), ints, pa.int64(), pa.int64(), pa.int64(), pa.int64()], strict=True)))
            for c, turn, role, text, again, blank, ended in zip(*(x.to_pylist() for x in b.columns), strict=True):
                new = conv is none or c != conv
                if new or len(classes) == BLOCK:
                    made += closed()
                    fresh = new and conv is not none
                    block, classes, turns, low, high, illegal = block + 1, [], 0, None, None, 0
                    if new:
                        conv, before, turn_before, last = c, None, none, ""
                now = (turn, role, text)
                fault = "blank" if blank else "duplicate" if again or now == before else "" if ended else "truncated"
                letter = _letter(role)
                if last:  # the place before the first turn of a block belongs to the block, that of a partition to `_told`
                    illegal += last + letter not in ("su", "ua", "au")
                if turn is not None and turn != turn_before:
                    turns, low, high = turns + 1, turn if low is None else low, turn
                made.append((c, part, block, len(classes), turn, role, text, fault, None, None, None, None, None, None, None))
                classes.append("d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
                before, turn_before, last = now, turn, letter
            if made:
                yield batch(made)
                made = []
        if made := closed():
            yield batch(made)

    return run


def _linked(costs: Costs):
    """Blocks, those of a conversation together and in order, to the state before and behind each, the whole cost, and the turns put in at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {x: steps(x, costs) for x in "dsuaxSUAX"}
        none = object()
        conv, layers, places = none, [], []

        def solved():
            if not places:
                return None
            now, back = through(layers, NONE)
            ends = [(w[0] + TAIL[s] * costs.insert, w[1], s) for s, w in enumerate(now) if w]
            cost, _, last = min(ends)
            rows, tail = [], TAIL[last]
            for (part, block), layer in zip(reversed(places), reversed(back), strict=True):
                before = layer[last][0]
                rows.append((part, block, before, last, cost, tail))
                last, tail = before, 0
            kinds = [pa.int32()] * 4 + [pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "block", "entry", "exit", "cost", "tail"])

        for b in batches:
            for c, part, block, classes, fresh in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if conv is none or c != conv:
                    if (out := solved()) is not None:
                        yield out
                    conv, layers, places = c, [], []
                found = ways(classes, (NONE,) if fresh else STATES, of)
                rank = {x: i for i, x in enumerate(sorted({e for _, e in found.values()}))}
                layers.append([(p, q, rank[edits], cost) for (p, q), (cost, edits) in found.items()])
                places.append((part, block))
        if (out := solved()) is not None:
            yield out

    return run


def _edited(costs: Costs):
    """Blocks with the states before and behind them to their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {x: steps(x, costs) for x in "dsuaxSUAX"}
        for b in batches:
            edits = [ways(c, (p,), of)[p, q][1] + "I" * t for c, p, q, t in zip(*(b.column(n).to_pylist() for n in ("classes", "entry", "exit", "tail")), strict=True)]
            keep = [n for n in b.schema.names if n not in ("entry", "exit", "tail")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(edits, pa.string())], names=[*keep, "edits"])

    return run


class _Conversation:
    """What is told of one conversation, from its blocks and turns in order: nothing of it is held but its edit string."""

    def __init__(self, conv):
        self.conv, self.n, self.counts, self.illegal, self.turns, self.low, self.high = conv, 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, None, None
        self.cost, self.audit, self.edits, self.at, self.state, self.last, self.part, self.hash, self.place = 0, [], "", 0, NONE, "", None, hashlib.sha256(), 0

    def put(self, role: str, text: str, edit: str):
        self.hash.update((b"\n" if self.place else b"") + f"{role}:{text}".encode())
        self.place += 1
        return (self.conv, self.place, role, text, edit)

    def inserted(self):
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            role, self.state = ROLE[self.state], NEXT[self.state]
            yield self.put(role, "", "I")

    def block(self, b: dict):
        self.n, self.illegal, self.cost, self.turns = self.n + b["seen"], self.illegal + b["illegal"], b["cost"], self.turns + b["turns"]
        self.low = b["low"] if self.low is None else self.low
        self.high = self.high if b["high"] is None else b["high"]
        self.edits, self.at = b["edits"], 0
        self.audit.append(b["edits"])

    def turn(self, r: dict):
        letter = _letter(r["role"])
        if self.part is not None and self.part != r["part"]:
            self.illegal += self.last + letter not in ("su", "ua", "au")
        self.part, self.last = r["part"], letter
        if r["fault"]:
            self.counts[r["fault"]] += 1
        yield from self.inserted()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[letter][self.state]
            yield self.put(r["role"], r["text"], "K")
        elif edit == "R":
            role, self.state = ROLE[self.state], NEXT[self.state]
            yield self.put(role, r["text"], "R")
        if r["at"] == r["seen_last"]:
            yield from self.inserted()

    def told(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, self.n, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _told(turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def batch(rows):
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()] if turns else [kind, *[pa.int64()] * 7, pa.string(), pa.string()]
            names = [f.split()[0] for f in (TURNS if turns else MADE).split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            kind, out, seen = b.schema.field(0).type, [], 0
            for r in b.to_pylist():
                if now is None or now.conv != r["conv_id"]:
                    if now is not None and not turns:
                        out.append(now.told())
                    now = _Conversation(r["conv_id"])
                if r["at"] < 0:
                    now.block(r)
                    now.size = r["seen"]
                else:
                    made = list(now.turn(r | {"seen_last": now.size - 1}))
                    out += made if turns else []
            if out:
                yield batch(out)
        if now is not None and not turns:
            yield batch([now.told()])

    return run


def faults(messages: DataFrame) -> DataFrame:
    """`again` (an earlier turn of the conversation has the role and text), `blank` and `ended` (its last visible character ends a sentence) of each turn.

    The first turn that has a role and text is a minimum that is combined before its shuffle; then turns are only compared with it."""
    keys = ["conv_id", "h", "g"]
    trimmed = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    rows = messages.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), F.col("role"), F.col("text")).alias("g"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn"))
    first = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(*[F.col(x).alias(f"_{x}") for x in keys], "first")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    again = F.coalesce(place > F.col("first"), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", again.alias("again"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(*ENDS).alias("ended"))


def repair(messages: DataFrame, costs: Costs = Costs(), turns: bool = False) -> DataFrame:  # noqa: B008
    """What repairing each conversation of `messages` (conv_id, turn, role, text) takes; with `turns` the repaired turns instead.

    A conversation's turns go by turn, nulls first, then by role and text; a null role or text is one space.  A turn's first fault counts: `blank` (nothing
    but white space), `duplicate` (its role and text were there before), `truncated` (its last visible character ends no sentence).  The role initials
    of a repaired conversation are `(s?(ua)+)?`.  A turn is kept, given the role user or assistant, or deleted, as blank and duplicate ones
    have to be; empty user or assistant turns are put in anywhere.  Of the cheapest ways (see `Costs`) the one whose string of initials
    (D, I, K, R) is the ASCII-least is taken.

    Returns conv_id, `n_rows`, `gaps` (turns missing between the least and the greatest), `blank`, `duplicate`, `truncated`, `illegal`
    (neighbours whose initials are not su, ua or au), `cost`, `audit`, `repaired_sha256` (of `role:text`, joined by newlines); or conv_id, `place` (from 1),
    `role`, `text`, `edit`.  An empty role has no initial and can't be kept.  Null conv_ids are one conversation.  Repeated rows are
    duplicates.  Other columns are left behind, whatever their names.  An empty table gives an empty result.

    Turns are dealt over tasks by ranges of conversation and turn, so one conversation may hold any share of all rows; it is worked on
    in blocks of `BLOCK` turns.  Only the hash, which has an order, and the result's edit string take all of a conversation through one task, as a stream.
    """
    if min(costs.rerole, costs.delete, costs.insert, costs.truncated) <= 0:
        raise ValueError("costs are positive")
    c = Carried(messages)
    spark, kind = messages.sparkSession, messages.schema["conv_id"].dataType.simpleString()
    space = lambda name: F.coalesce(c.col(name), F.lit(" ")).alias(name)
    names = [f.split()[0] for f in ROW.split(", ")]
    with small_batches(spark):
        told = stored(faults(c.df.select(c.col("conv_id").alias("conv_id"), c.col("turn").cast("long").alias("turn"), space("role"), space("text"))))
        rows = told.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
        rows = stored(rows.mapInArrow(_placed(kind, names), ROW.format(kind=kind)))
        blocks = rows.where("at < 0").select("conv_id", "part", "block", "classes", "fresh")
        order = ["conv_id", "part", "block"]
        links = blocks.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_linked(costs), "part int, block int, entry int, exit int, cost long, tail int")
        light = rows.where("at < 0").select(*[n for n in names if n not in ("at", "turn", "role", "text", "fault", "fresh")]).join(links, ["part", "block"])
        kept = [f for f in light.columns if f not in ("entry", "exit", "tail")]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.select(*kept).schema.fields)
        edits = stored(light.mapInArrow(_edited(costs), f"{schema}, edits string"))
        some = ["conv_id", "part", "block", "at", "role", "text", "fault"]
        none = lambda kind_: F.lit(None).cast(kind_)
        heads = edits.select("conv_id", "part", "block", F.lit(-1).alias("at"), *[none("string").alias(x) for x in some[4:]], "seen", "low", "high", "turns", "illegal", "cost", "edits")
        bodies = rows.where("at >= 0").select(*some, *[none(k).alias(n) for n, k in (("seen", "int"), ("low", "long"), ("high", "long"), ("turns", "long"), ("illegal", "long"), ("cost", "long"), ("edits", "string"))])
        whole = heads.union(bodies).repartition("conv_id").sortWithinPartitions(*order, "at")
        return stored(whole.mapInArrow(_told(turns), (TURNS if turns else MADE).format(kind=kind)))


def damaged(messages: DataFrame) -> DataFrame:
    """The rows of a table with every kind of fault, by the checksum of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    its ends of sentences, 3 repeats it, 4 makes it a user's.  Nulls are one space."""
    c = Carried(messages)
    said = lambda name: F.coalesce(c.col(name).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    rows = c.df.select(c.col("conv_id").alias("conv_id"), c.col("turn").alias("turn"), said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(messages)).withColumnRenamed("conv_id", "of")
    every = messages.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
