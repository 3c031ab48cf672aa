"""Operator 10: tool calls linked to their results, ordered, validated and serialised.

An identifier holds within its conversation alone: calls, results and what a call waits for meet on (conv_id, call_id).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, sized, stored

#: The schemas of tools are met by a broadcast up to this many.
BROADCAST_TOOLS = 10_000
#: The tool for which a plain chat's turns stand: a question is its call, the turn behind is the result.
ANSWER = {"name": "answer", "parameters": {"prompt": ("string", True), "n_chars": ("integer", True), "attachments": ("array", False)}}
#: Characters of a question from which its length is told, and beyond which it is marked as long (see `turns_as_calls`).
TOLD, LONG = 40, 500
#: The columns of calls and of results.  `part` is a place inside a turn's text; -1 is the text itself.
CALLS_SCHEMA = "conv_id long, turn long, part int, call_id string, name string, arguments string, after array<string>"
RESULTS_SCHEMA = "conv_id long, turn long, part int, call_id string, role string, content string"
#: JSON types by those of a variant's values.
JSON_TYPES = {"BIGINT": "integer", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def schemas(spark: SparkSession, tools: list[dict]) -> DataFrame:
    """(`name`, `params`): a row for each tool; a parameter has a key, a JSON type and whether it is required."""
    rows = [(t["name"], [(k, kind, need) for k, (kind, need) in sorted(t["parameters"].items())]) for t in tools]
    return spark.createDataFrame(rows, "name string, params array<struct<key:string,type:string,required:boolean>>")


def canonical(text: Column) -> Column:
    """JSON with the keys of all objects sorted and no white space; null where `text` is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _type(value: Column) -> Column:
    """The JSON type of a variant."""
    told = F.schema_of_variant(value)
    out = F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told.startswith("DECIMAL"), F.when(told.rlike(r",\s*0\)"), "integer").otherwise("number"))
    for k, v in JSON_TYPES.items():
        out = out.when(told == k, v)
    return out.otherwise("unknown")


def argument_errors(arguments: Column, params: Column) -> Column:
    """What is wrong with the arguments, sorted: `not an object`, `missing:key`, `type:key`, `unexpected:key`."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(_type(value) == "object", F.lit(False))
    given = F.when(is_object, value.cast("map<string,variant>"))

    def wrong(p: Column) -> Column:
        found = F.element_at(given, p["key"])
        kind = _type(found)
        fits = (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer"))
        absent = ~F.array_contains(F.map_keys(given), p["key"])
        return F.when(absent, F.when(p["required"], F.concat(F.lit("missing:"), p["key"]))).when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("type:"), p["key"]))

    listed = F.filter(F.transform(params, wrong), lambda x: x.isNotNull())
    more = F.transform(F.array_except(F.map_keys(given), F.transform(params, lambda p: p["key"])), lambda k: F.concat(F.lit("unexpected:"), k))
    return F.when(is_object, F.array_sort(F.concat(listed, more))).otherwise(F.array(F.lit("not an object")))


def _key(conv: Column | str = "conv_id", call: Column | str = "call_id") -> Column:
    return F.struct(*[(F.col(x) if isinstance(x, str) else x).alias(n) for n, x in (("conv", conv), ("id", call))])


def depths(calls: DataFrame) -> DataFrame:
    """(`k`, `depth`): for each (conv_id, call_id) the longest way to the call along `after`; null in or behind a cycle.

    A call that waits for one other points at it; pointers are doubled until they reach a call that waits for none or for
    several, so a chain of n calls takes log2 n rounds, and what still points at a pointer then is in or behind a cycle.  The calls
    that wait for several are taken level by level, as many rounds as the longest way has such calls.
    What is waited for but is no call of the conversation is left out.
    """
    own = calls.where("call_id is not null")
    every = own.select(_key().alias("k")).distinct()
    waits = own.select("conv_id", _key().alias("k"), F.explode("after").alias("b")).where("b is not null").select("k", _key("conv_id", "b").alias("b")).distinct()
    if waits.isEmpty():
        return every.withColumn("depth", F.lit(0))
    edges = stored(waits.join(every.withColumnRenamed("k", "b"), "b", "left_semi"))
    with sized(calls.sparkSession, edges.count()):
        return _levels(every, edges)


def _levels(every: DataFrame, edges: DataFrame) -> DataFrame:
    count = stored(edges.groupBy("k").agg(F.count("*").alias("n"), F.min("b").alias("to")))
    jump = count.where("n = 1").select("k", "to", F.lit(1).alias("far"))
    several = count.where("n > 1").select("k")
    for _ in range(math.ceil(math.log2(1 + jump.count())) + 1):
        on = jump.select(F.col("k").alias("at"), F.col("to").alias("next"), F.col("far").alias("more"))
        met = jump.join(on, F.col("to") == F.col("at"), "left")
        jump = stored(met.select("k", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("at").isNotNull().alias("moved")))
        if jump.where("moved").isEmpty():
            break
    jump = jump.where("not moved")  # the rest goes round
    lost = count.where("n = 1").select("k").join(jump, "k", "left_anti")
    done = stored(every.join(count, "k", "left_anti").select("k", F.lit(0).alias("depth")))
    roots = several.join(edges, "k").join(jump.select(F.col("k").alias("b"), "to", "far"), "b", "left").join(lost.select(F.col("k").alias("b"), F.lit(True).alias("lost")), "b", "left")
    left = stored(roots.select("k", F.coalesce("to", "b").alias("to"), F.coalesce("far", F.lit(0)).alias("far"), F.coalesce("lost", F.lit(False)).alias("lost")))
    while not left.isEmpty():
        known = left.join(done.withColumnRenamed("k", "to"), "to", "left")
        ready = known.groupBy("k").agg(F.max(F.col("lost") | F.col("depth").isNull()).alias("waits"), (F.max(F.col("depth") + F.col("far")) + 1).alias("depth")).where("not waits").select("k", "depth")
        ready = stored(ready)
        if ready.isEmpty():
            break
        done = stored(done.union(ready))
        left = stored(left.join(ready, "k", "left_anti"))
    chained = jump.join(done.withColumnRenamed("k", "to"), "to", "left").select("k", (F.col("depth") + F.col("far")).alias("depth"))
    none = lost.union(left.select("k").distinct()).select("k", F.lit(None).cast("int"))
    return done.union(chained).union(none)


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with their results, depths and errors, and as canonical JSON; and results that belong to no call.

    `calls` and `results` have the columns of `CALLS_SCHEMA` and `RESULTS_SCHEMA`, `tools` those of `schemas`.  Returns conv_id, turn,
    call_id, `depth`, `linked`, `errors` (sorted array) and `json`; ordered by conv_id, depth, turn and call_id, the calls of a
    conversation are in topological order.  Order is a key and not a list, as one conversation may have
    a third of all calls.

    Calls and results meet by a hash join on conversation and identifier.  A result counts if it comes behind the (first) call
    of that identifier, by turn and then by place in the text; of several the first by (turn, place, content) is linked.
    Results are reduced to one for each identifier before they meet all its calls; so no identifier multiplies rows.
    Errors are those of the arguments, and `no such
    tool`, `no id`, `repeated id` (a call's, all of its rows), `several results`, `result before call`, `no result`, `cycle`; `no
    such call` of a result that no call of its conversation has the identifier of, null ones among them.  JSON has
    sorted keys, no white space and no null members; arguments that are no JSON are put as a string.
    Repeated rows each get a row.  Null conv_ids are one conversation.  Empty tables give an empty one.  A long text is one value of
    its row; it is never gathered with others.
    """
    when, of = F.struct("turn", "part"), _key()
    ids = calls.where("call_id is not null").groupBy(of.alias("k")).agg(F.min(when).alias("first_at"), F.count("*").alias("n_calls"))
    ids = stored(ids.join(depths(calls).withColumnRenamed("k", "dk"), F.col("k") == F.col("dk"), "left").drop("dk"))
    told = results.join(ids.select("k", "first_at"), of == F.col("k"), "left")
    behind = when > F.col("first_at")
    first = told.where("k is not null").groupBy("k").agg(F.min(F.when(behind, F.struct("turn", "part", "content", "role"))).alias("r"), F.sum(behind.cast("int")).alias("n_results"), F.max(~behind).alias("early"))
    known_ids = ids.join(first.withColumnRenamed("k", "rk"), F.col("k") == F.col("rk"), "left").drop("rk", "first_at")
    met = calls.join(known_ids, of == F.col("k"), "left")
    few = tools.count() <= BROADCAST_TOOLS
    known = tools.dropDuplicates(["name"]).select(F.col("name").alias("tool"), "params")
    met = met.join(F.broadcast(known) if few else known, F.col("name") == F.col("tool"), "left")
    more = F.filter(
        F.array(
            F.when(F.col("tool").isNull(), "no such tool"), F.when(F.col("call_id").isNull(), "no id"), F.when(F.col("n_calls") > 1, "repeated id"), F.when(F.col("n_results") > 1, "several results"),
            F.when(F.col("early"), "result before call"), F.when(F.col("r").isNull(), "no result"), F.when(F.col("k").isNotNull() & F.col("depth").isNull(), "cycle"),
        ),
        lambda x: x.isNotNull(),
    )
    bad = F.when(F.col("tool").isNotNull(), argument_errors(F.col("arguments"), F.col("params"))).otherwise(F.array().cast("array<string>"))
    arguments = F.coalesce(canonical(F.col("arguments")), _string(F.col("arguments")))
    result = _object(content=_string(F.col("r.content")), role=_string(F.col("r.role")), turn=F.col("r.turn").cast("string"))
    said = _object(
        after=F.when(F.size("after") > 0, F.to_json(F.array_sort("after"))), arguments=arguments, id=_string(F.col("call_id")), name=_string(F.col("name")),
        result=F.when(F.col("r").isNotNull(), result), type=F.lit('"call"'),
    )
    depth = F.coalesce("depth", F.when(F.col("call_id").isNull(), 0))
    linked = met.select("conv_id", "turn", "call_id", depth.alias("depth"), F.col("r").isNotNull().alias("linked"), F.array_sort(F.concat(bad, more)).alias("errors"), said.alias("json"))
    lone = _object(content=_string(F.col("content")), id=_string(F.col("call_id")), role=_string(F.col("role")), type=F.lit('"result"'))
    orphans = told.where("k is null").select("conv_id", "turn", "call_id", F.lit(None).cast("int"), F.lit(False), F.array(F.lit("no such call")), lone)
    return linked.union(orphans)


def _string(x: Column) -> Column:
    """A JSON string: an array of one is written, and its brackets are taken off."""
    return F.when(x.isNotNull(), F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))


def _object(**members: Column) -> Column:
    """A JSON object of members that are JSON already, by sorted key; nulls are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def embedded(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand in texts: <tool_call>{"id": .., "name": .., "arguments": {..}, "after": [..]}</tool_call>
    and <tool_result id="..">content</tool_result>."""
    marks = r'(?s)(<tool_call>.*?</tool_call>|<tool_result id="[^"]*">.*?</tool_result>)'
    found = messages.select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(marks), F.lit(1))).alias("part", "x"))
    inside = F.regexp_extract("x", r"(?s)^<tool_call>(.*)</tool_call>$", 1)
    v = F.try_parse_json(inside)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    calls = found.where(F.col("x").startswith("<tool_call>")).select(
        "conv_id", "turn", "part", get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"), F.coalesce(F.to_json(get("$.arguments", "variant")), inside).alias("arguments"), get("$.after", "array<string>").alias("after")
    )
    marked = found.where(F.col("x").startswith("<tool_result"))
    results = marked.select("conv_id", "turn", "part", F.regexp_extract("x", r'^<tool_result id="([^"]*)">', 1).alias("call_id"), "role", F.regexp_extract("x", r'(?s)^<tool_result id="[^"]*">(.*)</tool_result>$', 1).alias("content"))
    return calls, results


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plain chat as calls of the tool `answer`: each user turn calls it, the assistant's turn right behind is the result.

    A call's identifier is that of its turn, `call_<turn>`, and a call waits for that of the turn two before, the last question of a
    chat that goes to and fro; so order and links come out of identifiers, without a conversation being
    gathered in one place.  A question of one line is the prompt; of several lines, an array of them.  The length is told
    from `TOLD` characters on, and a question over `LONG` is marked `long`.  Turns of other roles, a system's among them, are
    neither call nor result.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    asked = messages.where(F.col("role") == "user")
    lines = F.split(text, "\n")
    prompt = F.when(F.size(lines) > 1, F.to_json(lines)).otherwise(_string(text))
    arguments = _object(long=F.when(size > LONG, F.lit("true")), n_chars=F.when(size >= TOLD, size.cast("string")), prompt=prompt)
    before = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2)))
    calls = asked.select("conv_id", "turn", F.lit(-1).alias("part"), name(F.col("turn")).alias("call_id"), F.lit(ANSWER["name"]).alias("name"), arguments.alias("arguments"), before.alias("after"))
    said = messages.where((F.col("role") == "assistant") & F.col("turn").isNotNull())
    results = said.select("conv_id", "turn", F.lit(-1).alias("part"), name(F.col("turn") - 1).alias("call_id"), "role", text.alias("content"))
    return calls, results


def format_chats(messages: DataFrame, tools: list[dict] = (ANSWER,)) -> DataFrame:
    """All calls of `messages` (conv_id, turn, role, text), embedded ones and those that turns stand for; see `link_tool_calls`.

    Other columns are left behind, whatever their names.  Null texts count as empty; a null role makes no call, a null turn a
    call without an identifier.  Repeated rows are calls of a repeated identifier.  A result that no call has is a row, too.
    """
    c = Carried(messages)
    rows = c.df.select(*[c.col(n).alias(n) for n in ("conv_id", "turn", "role", "text")])
    plain, marked = turns_as_calls(rows), embedded(rows)
    calls, results = (a.unionByName(b) for a, b in zip(plain, marked, strict=True))
    return link_tool_calls(calls, results, schemas(messages.sparkSession, list(tools)))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "call_id", "depth", "linked", F.array_join("errors", ",").alias("errors"), "json")


ORACLE = f"""
WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
calls AS (SELECT * FROM said WHERE role = 'user'),
results AS (SELECT conv_id, turn - 1 AS call, min({{'turn': turn, 'content': t}}) AS r, count(*) AS n FROM said WHERE role = 'assistant' GROUP BY ALL),
twice AS (SELECT conv_id, turn, count(*) AS n_calls FROM calls GROUP BY ALL),
chains AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM twice),
depths AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS depth FROM chains),
asked AS (SELECT conv_id, turn, length(t) AS n, contains(t, chr(10)) AS many,
    CASE WHEN contains(t, chr(10)) THEN to_json(string_split(t, chr(10)))::VARCHAR ELSE to_json(t)::VARCHAR END AS prompt FROM calls)
SELECT c.conv_id, c.turn, 'call_' || c.turn AS call_id, d.depth::INTEGER AS depth, r.r IS NOT NULL AS linked,
  concat_ws(',', CASE WHEN c.n < {TOLD} THEN 'missing:n_chars' END, CASE WHEN r.r IS NULL THEN 'no result' END, CASE WHEN n_calls > 1 THEN 'repeated id' END,
    CASE WHEN r.n > 1 THEN 'several results' END, CASE WHEN many THEN 'type:prompt' END, CASE WHEN c.n > {LONG} THEN 'unexpected:long' END) AS errors,
  '{{' || CASE WHEN c.turn >= 2 THEN '"after":["call_' || (c.turn - 2) || '"],' ELSE '' END
  || '"arguments":{{' || CASE WHEN c.n > {LONG} THEN '"long":true,' ELSE '' END || CASE WHEN c.n >= {TOLD} THEN '"n_chars":' || c.n || ',' ELSE '' END || '"prompt":' || prompt || '}},"id":"call_' || c.turn || '","name":"answer",'
  || CASE WHEN r.r IS NULL THEN '' ELSE '"result":{{"content":' || to_json(r.r.content)::VARCHAR || ',"role":"assistant","turn":' || r.r.turn || '}},' END || '"type":"call"}}' AS json
FROM asked c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call = c.turn JOIN depths d ON d.conv_id = c.conv_id AND d.turn = c.turn
UNION ALL
SELECT conv_id, turn, 'call_' || (turn - 1), NULL, false, 'no such call', '{{"content":' || to_json(t)::VARCHAR || ',"id":"call_' || (turn - 1) || '","role":"assistant","type":"result"}}'
FROM said s WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = s.conv_id AND c.turn = s.turn - 1)
"""
