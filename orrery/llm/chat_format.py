"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

DataFrame operations only.

* Events come from tagged JSON in messages (``<tool_call>{...}</tool_call>`` and
  ``<tool_result>{...}</tool_result>``) and from the turns themselves: a user's
  turn calls ``reply``, the assistant's turn after it is that call's result, any
  other turn is a note.
* Calls and results are joined by identifier, both ways.
* An event waits for at most one other: a turn for the turn before it, a tagged call
  for the one that its ``after`` names, a result for its call.  Its level in the
  topological order is the number of events that come before it on that chain, found by
  pointer doubling: the joins are by unique identifiers and their number is the
  logarithm of the longest chain, so a conversation of any length is no hot key.
* Arguments are validated against the tool's schema (``type``, ``required``,
  ``properties``, ``additionalProperties``, ``minLength``, ``maxLength``, ``minimum``,
  ``maximum``, ``enum``), which becomes column expressions.
* Canonical JSON has sorted keys, no white space and no null members.

Defined results: events without conversation, turn or identifier have a null id, no
level and no link.  A null text is a reply without ``text``, which isn't valid, or a
result without content.  Equal rows each give their events and link alike.  A chain
that is a cycle has no level and the error ``cycle``.  Tagged text that is no JSON
object is an event with the error ``not an object``.  Of events with one identifier that
wait for different ones, the smallest name counts for all.  Names are joined by ``-``;
in texts ``%`` and ``-`` are written ``%25`` and ``%2D``, so that no two names are the same.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.store import Table

#: Schemas by tool.
TOOLS = {
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}},
    }
}

#: Names of variant types by JSON type: the start of what ``schema_of_variant`` gives.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]' if "'" in name else f"$['{name}']", "variant")


def _errors(value: Column, spec: dict, at: str) -> list[Column]:
    """Null or a message for each rule of the schema."""
    kind, out = F.schema_of_variant(value), []
    rule = lambda bad, said: out.append(F.when(value.isNotNull() & bad, F.lit(f"{at}: {said}")))
    if "type" in spec:
        rule(~kind.rlike(f"^{KINDS[spec['type']]}"), f"not of type {spec['type']}")
    text, number = value.try_cast("string"), value.try_cast("double")
    is_text, is_number = kind == "STRING", kind.rlike(f"^{KINDS['number']}")
    if "minLength" in spec:
        rule(is_text & (F.length(text) < spec["minLength"]), f"shorter than {spec['minLength']}")
    if "maxLength" in spec:
        rule(is_text & (F.length(text) > spec["maxLength"]), f"longer than {spec['maxLength']}")
    if "minimum" in spec:
        rule(is_number & (number < spec["minimum"]), f"less than {spec['minimum']}")
    if "maximum" in spec:
        rule(is_number & (number > spec["maximum"]), f"more than {spec['maximum']}")
    if "enum" in spec:
        rule(~text.isin(*map(str, spec["enum"])), "none of the values listed")
    for name in spec.get("required", []):
        rule(kind.rlike("^OBJECT") & _member(value, name).isNull(), f"lacks {name}")
    if spec.get("additionalProperties", True) is False:
        known = F.array(*map(F.lit, spec.get("properties", {})))
        extra = F.size(F.array_except(F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>")), known)) > 0
        rule(kind.rlike("^OBJECT") & extra, "has further members")
    for name, inner in spec.get("properties", {}).items():
        out += _errors(_member(value, name), inner, f"{at}.{name}")
    return out


def argument_errors(name: Column, value: Column, tools: dict) -> Column:
    """Messages, joined by ``; ``, of the tool's schema; empty if valid."""
    out = F.when(value.isNull() | ~F.schema_of_variant(value).rlike("^OBJECT"), F.lit("arguments: not an object"))
    for tool, spec in tools.items():
        found = _errors(value, spec, "arguments")
        out = out.when(name == tool, F.array_join(F.array_compact(F.array(*found)), "; ") if found else F.lit(""))
    return out.otherwise(F.lit("unknown tool"))


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def _told(name: Column) -> Column:
    """A text that can be joined by ``-`` and told apart again."""
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("-"), F.lit("%2D"))


def events(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, kind, event_id, call_id, waits_for, name, arguments, content, broken)."""
    conv = _told(F.col("conv_id")) if messages.schema["conv_id"].dataType.typeName() == "string" else F.col("conv_id")
    here = F.concat_ws("-", F.lit("t"), conv, "turn")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    before = F.concat_ws("-", F.lit("t"), conv, F.col("turn") - 1)
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("note")
    told = F.to_json(F.struct("text", "turn"))
    turns = messages.select(
        "conv_id",
        "turn",
        F.lit(0).alias("part"),
        kind.alias("kind"),
        F.when(known, here).alias("event_id"),
        F.when(known, F.when(kind == "call", here).when(kind == "result", before)).alias("call_id"),
        F.when(known, before).alias("waits_for"),
        F.when(kind == "call", "reply").alias("name"),
        F.when(kind == "call", told).alias("arguments"),
        F.when(kind != "call", F.col("text")).alias("content"),
        F.lit(False).alias("broken"),
    )
    tagged = messages.filter(F.col("text").contains("<tool_")).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<(tool_call|tool_result)>.*?</\1>"), F.lit(0))).alias("part", "tag"))
    body = F.try_parse_json(F.regexp_replace("tag", r"^<tool_(call|result)>|</tool_(call|result)>$", ""))
    member = lambda x: F.coalesce(F.try_variant_get("body", f"$.{x}", "string"), F.to_json(F.try_variant_get("body", f"$.{x}", "variant")))
    named = lambda sort, x: F.concat_ws("-", F.lit(sort), conv, _told(x))
    tagged = tagged.select("conv_id", "turn", "part", F.when(F.col("tag").startswith("<tool_call>"), "call").otherwise("result").alias("kind"), body.alias("body"))
    ident = F.when(F.col("conv_id").isNotNull(), member("id"))
    call = F.col("kind") == "call"
    tagged = tagged.select(
        "conv_id",
        "turn",
        (F.col("part") + 1).alias("part"),
        "kind",
        F.when(ident.isNotNull(), F.when(call, named("c", ident)).otherwise(named("r", ident))).alias("event_id"),
        F.when(ident.isNotNull(), named("c", ident)).alias("call_id"),
        F.when(call, F.when(member("after").isNotNull(), named("c", member("after")))).otherwise(F.when(ident.isNotNull(), named("c", ident))).alias("waits_for"),
        F.when(call, member("name")).alias("name"),
        F.when(call, F.to_json(F.try_variant_get("body", "$.arguments", "variant"))).alias("arguments"),
        F.when(~call, member("content")).alias("content"),
        (F.col("body").isNull() | ~F.schema_of_variant("body").rlike("^OBJECT")).alias("broken"),
    )
    return turns.unionByName(tagged)


def levels(found: DataFrame) -> DataFrame:
    """(event_id, level): how many events come before on its chain; null on a cycle."""
    once = found.filter("event_id is not null").groupBy("event_id").agg(F.min("waits_for").alias("waits_for"))
    nodes = Table(once, "events")
    there = nodes.frame().select(F.col("event_id").alias("jump"))
    start = nodes.frame().join(there, F.col("waits_for") == F.col("jump"), "left").select("event_id", "jump", F.col("jump").isNotNull().cast("long").alias("level"))
    rounds, n = [Table(start, "levels")], None
    nodes.drop()
    while True:
        # a round's rows that have arrived stay in its table; only the others go on
        moving = rounds[-1].frame().filter("jump is not null")
        left = moving.count()
        n = n or left
        if not left or len(rounds) > math.ceil(math.log2(n + 1)) + 2:
            break
        known = moving
        for t in rounds:
            known = known.union(t.frame().filter("jump is null"))
        known = known.select(F.col("event_id").alias("at"), F.col("jump").alias("next"), F.col("level").alias("more"))
        rounds.append(Table(moving.join(known, F.col("jump") == F.col("at")).select("event_id", F.col("next").alias("jump"), (F.col("level") + F.col("more")).alias("level")), "levels"))
    out = moving.select("event_id", F.lit(None).cast("long").alias("level"))
    for t in rounds:
        out = out.union(t.frame().filter("jump is null").select("event_id", "level"))
    return out


def format_chat(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """Per event: conv_id, turn, part, kind, call_id, level, linked, valid, errors, json.

    ``level``, then ``turn`` and ``part``, put a conversation's events in topological order.
    """
    found = events(messages.select("conv_id", "turn", "role", "text"))
    calls = found.filter("kind = 'call' and call_id is not null").select(F.col("call_id").alias("id")).distinct()
    results = found.filter("kind = 'result' and call_id is not null").select(F.col("call_id").alias("id")).distinct()
    ends = calls.withColumn("of", F.lit("result")).union(results.withColumn("of", F.lit("call")))
    linked = found.join(ends.hint("shuffle_hash"), (F.col("call_id") == F.col("id")) & (F.col("kind") == F.col("of")), "left")
    placed = linked.join(levels(found), "event_id", "left")
    parsed = F.try_parse_json("arguments")
    wrong = F.when(F.col("broken"), F.lit("not an object")).when(F.col("kind") == "call", argument_errors(F.col("name"), parsed, tools)).otherwise(F.lit(""))
    cycle = F.when(F.col("event_id").isNotNull() & F.col("level").isNull(), F.lit("cycle"))
    errors = F.array_join(F.array_compact(F.array(F.nullif(wrong, F.lit("")), cycle)), "; ")
    call = F.to_json(F.struct(parsed.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("kind").alias("type")))
    other = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.col("kind").alias("type")))
    out = placed.select("conv_id", "turn", "part", "kind", "call_id", "level", F.col("id").isNotNull().alias("linked"), errors.alias("errors"), F.when(F.col("kind") == "call", call).otherwise(other).alias("json"))
    return out.select("conv_id", "turn", "part", "kind", "call_id", "level", "linked", (F.col("errors") == "").alias("valid"), "errors", "json")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For tables whose (conv_id, turn) are unique and whose texts hold no tags.
ORACLE_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'note' END AS kind
  FROM conversations
), n AS (
  SELECT *, turn - min(turn) OVER (PARTITION BY conv_id, island) AS level,
         't-' || conv_id || '-' || (CASE kind WHEN 'call' THEN turn WHEN 'result' THEN turn - 1 END) AS call_id,
         CASE WHEN kind <> 'call' THEN ''
              WHEN length(text) < 1 THEN 'arguments.text: shorter than 1'
              WHEN length(text) > 1000 THEN 'arguments.text: longer than 1000' ELSE '' END AS errors
  FROM m
)
SELECT a.conv_id, a.turn, CAST(0 AS INT) AS part, a.kind, a.call_id, CAST(a.level AS BIGINT) AS level, (b.turn IS NOT NULL) AS linked, (a.errors = '') AS valid, a.errors,
       CASE a.kind
         WHEN 'call' THEN '{"arguments":{"text":' || CAST(to_json(a.text) AS VARCHAR) || ',"turn":' || a.turn || '},"id":"' || a.call_id || '","name":"reply","type":"call"}'
         WHEN 'result' THEN '{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"id":"' || a.call_id || '","type":"result"}'
         ELSE '{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"type":"note"}' END AS json
FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND ((a.kind = 'call' AND b.kind = 'result' AND b.turn = a.turn + 1) OR (a.kind = 'result' AND b.kind = 'call' AND b.turn = a.turn - 1))
"""
