"""Chat formatting: tool calls and results linked, ordered, validated and written as canonical JSON lines."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import shared_folder, table, written

EVENT = "conv_id long, turn long, seq int, kind string, role string, call_id string, name string, body string, after array<string>"
KEY = ["conv_id", "call_id"]


LONE = re.compile("[\ud800-\udfff]")
#: Keywords of a schema that say nothing about validity.
NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}


def storable(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 cannot hold, as escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, text unescaped where allowed; a value has one form only."""
    return storable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def loads(text: str | None) -> Any:
    """A JSON value; NaN, infinities and numbers beyond any double are errors, as canonical JSON has none."""
    def refuse(_: str) -> None:
        raise ValueError("no number")

    def number(digits: str) -> float:
        return float(digits) if math.isfinite(float(digits)) else refuse(digits)

    return json.loads(text or "", parse_constant=refuse, parse_float=number)


def same(a: Any, b: Any) -> bool:
    """Equal as JSON: 1 equals 1.0, but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def violations(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What ``value`` breaks of a JSON schema.

    Read: true and false, type, enum, const, anyOf, allOf, properties, required, additionalProperties, items, minItems, maxItems,
    minimum, maximum and their exclusive forms, minLength, maxLength, pattern. Any other keyword that is no note is itself an error.
    """
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    out = []
    for key, want in schema.items():
        if key == "type":
            options = want if isinstance(want, list) else [want]
            whole = number and (isinstance(value, int) or value.is_integer())
            if not any(number if k == "number" else whole if k == "integer" else isinstance(value, kinds[k]) for k in options):
                return [f"{at}: not of type {'/'.join(options)}"]
        elif key == "enum":
            out += [] if any(same(value, x) for x in want) else [f"{at}: not one of the values"]
        elif key == "const":
            out += [] if same(value, want) else [f"{at}: not the value"]
        elif key == "anyOf":
            out += [] if any(not violations(value, x, at) for x in want) else [f"{at}: none of the forms"]
        elif key == "allOf":
            out += [e for x in want for e in violations(value, x, at)]
        elif key == "required":
            out += [f"{at}.{k}: missing" for k in want if isinstance(value, dict) and k not in value]
        elif key == "properties":
            out += [e for k in sorted(want) if isinstance(value, dict) and k in value for e in violations(value[k], want[k], f"{at}.{k}")]
        elif key == "additionalProperties":
            for k in sorted(value) if isinstance(value, dict) and want is not True else []:
                if k not in schema.get("properties", {}):
                    out += [f"{at}.{k}: unknown"] if want is False else violations(value[k], want, f"{at}.{k}")
        elif key == "items":
            out += [e for i, x in enumerate(value if isinstance(value, list) else []) for e in violations(x, want, f"{at}[{i}]")]
        elif key in ("minItems", "maxItems"):
            out += [f"{at}: number of items"] if isinstance(value, list) and (len(value) < want if key == "minItems" else len(value) > want) else []
        elif key in ("minLength", "maxLength"):
            out += [f"{at}: length"] if isinstance(value, str) and (len(value) < want if key == "minLength" else len(value) > want) else []
        elif key == "pattern":
            out += [f"{at}: pattern"] if isinstance(value, str) and not re.search(want, value) else []
        elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            beyond = {"minimum": lambda: value < want, "maximum": lambda: value > want, "exclusiveMinimum": lambda: value <= want, "exclusiveMaximum": lambda: value >= want}[key]
            out += [f"{at}: out of bounds"] if number and beyond() else []
        elif key not in NOTES:
            out.append(f"{at}: keyword {key} is not read")
    return out


def broken(value: Any, schema: str) -> list[str]:
    """``violations`` of a schema text, sorted; a schema that cannot be used is an error of its own."""
    try:
        return sorted(storable(e) for e in violations(value, loads(schema)))
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError, re.error):
        return ["schema: not usable"]


def read_call(call: Any) -> dict:
    """One tool call; name and arguments may stand in a nested ``function``."""
    call = call if isinstance(call, dict) else {}
    inner = {**call, **call["function"]} if isinstance(call.get("function"), dict) else call
    args, after = inner.get("arguments"), call.get("after")
    text = lambda x: None if x is None else storable(x) if isinstance(x, str) else canonical(x)
    return {"kind": "call", "call_id": text(call.get("id")), "name": text(inner.get("name")), "body": storable(args) if isinstance(args, str) else canonical(args),
            "after": [text(x) for x in after if x is not None] if isinstance(after, list) else []}


def read_message(role: str | None, text: str | None) -> list[dict]:
    """The events of one message: what it says, its tool calls, or a tool result.

    A message with calls that also has content, or whose list of calls is empty, is a message event too.
    """
    try:
        said = loads(text) if (text or "").lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        said = None
    if isinstance(said, dict) and isinstance(said.get("tool_calls"), list):
        calls = [read_call(c) for c in said["tool_calls"]]
        spoken = said.get("content") is not None or not calls
        return [{"kind": "message", "body": canonical(said.get("content")), "after": []}] * spoken + calls
    if isinstance(said, dict) and said.get("tool_call_id") is not None:
        id_ = said["tool_call_id"]
        return [{"kind": "result", "call_id": storable(id_) if isinstance(id_, str) else canonical(id_), "body": canonical(said.get("content")), "after": []}]
    return [{"kind": "message", "body": canonical(text), "after": []}]


def read_events(messages: DataFrame) -> DataFrame:
    """One row per event of messages (conv_id, turn, role, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int32()), ("kind", pa.string()), ("role", pa.string()),
                            ("call_id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("after", pa.list_(pa.string()))])
        for rb in batches:
            rows = [{"conv_id": m["conv_id"], "turn": m["turn"], "role": m["role"], "seq": i, **e} for m in rb.to_pylist() for i, e in enumerate(read_message(m["role"], m["text"]))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, EVENT)


def levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, place) of calls (conv_id, call_id, turn, after) and results (conv_id, call_id, turn).

    A call comes after the results of the calls it names in ``after``; names of unknown calls and of
    itself are left out. place is the turn at which it can stand: its own, or the last of those results.
    Calls without such names are level 0 at once. The others are settled in rounds, one per step of
    the longest chain; what never settles lies on or behind a cycle and gets level -1.
    """
    answered = results.groupBy(*KEY).agg(F.max("turn").alias("last"))
    known = calls.join(answered, KEY, "left").withColumn("last", F.coalesce("last", F.col("turn")))
    edges = known.select(*KEY, F.explode(F.array_distinct("after")).alias("dep")).filter("dep <> call_id")
    edges = written(edges.join(known.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]))
    waiting = edges.select(*KEY).distinct()
    free = known.join(waiting, KEY, "left_anti")
    done = free.select(*KEY, F.lit(0).alias("level"), F.col("turn").alias("place"), "last")
    if edges.isEmpty():
        return done.select(*KEY, "level", "place")
    slots = [shared_folder(calls.sparkSession), shared_folder(calls.sparkSession)]
    done, i, before = written(done, slots[0]), 0, -1
    rest = written(known.join(waiting, KEY).select(*KEY, "turn", "last"))
    while True:
        i += 1
        held = done.select("conv_id", F.col("call_id").alias("dep"), "level", F.greatest("place", "last").alias("end"))
        ready = edges.join(held, ["conv_id", "dep"], "left").groupBy(*KEY).agg(
            F.bool_and(F.col("level").isNotNull()).alias("ok"), (F.max("level") + 2).alias("level"), F.max("end").alias("end")).filter("ok")
        new = rest.join(ready, KEY).select(*KEY, "level", F.greatest("turn", "end").alias("place"), "last")
        done = written(done.join(new.select(*KEY), KEY, "left_anti").unionByName(new), slots[i % 2])
        size = done.count()
        if size == before:
            left = rest.join(done.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(-1).alias("level"), F.col("turn").alias("place"))
            return done.select(*KEY, "level", "place").unionByName(left)
        before = size


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per event: conv_id, turn, seq, kind, call_id, status, errors, place, level, line.

    Sorted by (conv_id, place, level, turn, seq) the lines of a conversation are in topological order:
    a result follows its call, a call follows the results it needs, and all else keeps its turn.
    status: message, linked, unanswered (call without result), orphan (result without call), duplicate
    (a later call with the id of another), cycle, no_id. errors: what the arguments break of the schema
    (name, schema as JSON) of their tool; a tool without a schema is an error. line is canonical JSON.

    Calls and results meet by a hash join on (conv_id, call_id). Of calls with one id the first by turn,
    then place in its message, then name and arguments, owns it; found by an aggregate, so results join
    one row. No conversation is gathered in one task, however long.

    Null text is message null; null conv_id or call_id never link (no_id); null turns sort first.
    Repeated rows are events of their own. Empty tables give an empty result.
    """
    events = written(read_events(messages))
    calls, results = events.filter("kind = 'call'"), events.filter("kind = 'result'")
    whole = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first = F.struct("turn", "seq", "name", "body")
    owners = calls.filter(whole).groupBy(*KEY).agg(F.min_by(F.struct("turn", "seq", "name", "body", "after"), first).alias("o"), F.min(first).alias("first"))
    owners = owners.select(*KEY, F.col("o.turn").alias("turn"), F.col("o.after").alias("after"), "first")
    order = levels(owners, results.filter(whole)).join(owners.select(*KEY, "first"), KEY)
    order = written(order.join(results.filter(whole).groupBy(*KEY).agg(F.count(F.lit(1)).alias("answers")), KEY, "left"))

    tied = calls.join(order.withColumnRenamed("first", "own"), KEY, "left")
    status = (F.when(F.col("own").isNull(), "no_id").when(~first.eqNullSafe(F.col("own")), "duplicate").when(F.col("level") < 0, "cycle")
              .when(F.col("answers").isNull(), "unanswered").otherwise("linked"))
    tied = tied.withColumn("status", status).withColumn("level", F.coalesce("level", F.lit(0))).withColumn("place", F.when(F.col("status").isin("no_id", "duplicate"), F.col("turn")).otherwise(F.coalesce("place", F.col("turn"))))
    tied = tied.join(schemas.select("name", "schema").dropDuplicates(["name"]), "name", "left").drop("own", "answers", "first")
    back = results.join(order.select(*KEY, F.col("level").alias("l"), F.col("place").alias("p")), KEY, "left")
    back = back.withColumns({"status": F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "no_id").when(F.col("l").isNull(), "orphan").otherwise("linked"),
                             "level": F.coalesce(F.col("l") + 1, F.lit(0)), "place": F.coalesce(F.greatest("turn", "p"), F.col("turn")), "schema": F.lit(None).cast("string")}).drop("l", "p")
    plain = events.filter("kind = 'message'").withColumns({"status": F.lit("message"), "level": F.lit(0), "place": F.col("turn"), "schema": F.lit(None).cast("string")})
    every = tied.unionByName(back).unionByName(plain).select("conv_id", "turn", "seq", "kind", "role", "call_id", "name", "body", "schema", "status", "place", "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lines, errors = [], []
            for e in rb.select(["kind", "role", "call_id", "name", "body", "schema"]).to_pylist():
                wrong: list[str] = []
                try:
                    body = loads(e["body"])
                except (ValueError, RecursionError):
                    body = e["body"]
                    wrong.append("$: not JSON")
                if e["kind"] == "call":
                    if e["schema"] is None:
                        wrong.append("no schema")
                    elif not wrong:
                        wrong += broken(body, e["schema"])
                    said = {"type": "call", "id": e["call_id"], "name": e["name"], "arguments": body}
                elif e["kind"] == "result":
                    said = {"type": "result", "id": e["call_id"], "content": body}
                else:
                    said = {"type": "message", "role": e["role"], "content": body}
                lines.append(canonical(said))
                errors.append(wrong)
            keep = ["conv_id", "turn", "seq", "kind", "call_id", "status", "place", "level"]
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in keep], pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())], names=[*keep, "errors", "line"])

    return every.mapInArrow(run, "conv_id long, turn long, seq int, kind string, call_id string, status string, place long, level int, errors array<string>, line string")


REPLY = {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False}


def as_calls(conversations: DataFrame) -> DataFrame:
    """Turns as tool messages, where they hold no tool JSON of their own.

    A user turn calls ``reply`` under the id conv:turn, and an assistant turn is the result for the turn before it. Eight turns
    make an exchange, in which a call comes after the one two turns before, if there is one.
    """
    id_ = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    args = F.struct(F.col("text"), F.col("turn"))
    after = F.when(F.floor(F.col("turn") / 2) % 4 > 0, F.array(id_(F.col("turn") - 2)))
    call = F.to_json(F.struct(F.array(F.struct(id_(F.col("turn")).alias("id"), F.lit("reply").alias("name"), args.alias("arguments"), after.alias("after"))).alias("tool_calls")), {"ignoreNullFields": "false"})
    result = F.to_json(F.struct(id_(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    own = F.coalesce(F.get_json_object("text", "$.tool_calls").isNotNull() | F.get_json_object("text", "$.tool_call_id").isNotNull(), F.lit(False))
    made = F.when(own, F.col("text")).when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", made.alias("text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame([("reply", json.dumps(REPLY))], "name string, schema string")
    rows = format_chats(as_calls(table(spark, sf_dir, "conversations")), schemas)
    return rows.select("conv_id", "turn", "kind", "call_id", "status", "place", "level", F.size("errors").alias("n_errors"), "line")


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLE = {
    "op9_chat_format": """
WITH RECURSIVE e AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
       CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM conversations),
c AS (SELECT call_id, min(struct_pack(turn := turn, text := text)) AS own, any_value(conv_id) AS conv_id, min(turn) AS turn FROM e WHERE kind = 'call' GROUP BY call_id),
r AS (SELECT call_id FROM e WHERE kind = 'result' GROUP BY call_id),
l AS (SELECT c.call_id, c.conv_id, c.turn, 0 AS level FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 AND (c.turn // 2) % 4 > 0 WHERE p.call_id IS NULL
  UNION ALL SELECT c.call_id, c.conv_id, c.turn, l.level + 2 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2 AND (c.turn // 2) % 4 > 0)
SELECT e.conv_id, e.turn, e.kind, e.call_id,
       CASE e.kind WHEN 'message' THEN 'message' WHEN 'result' THEN CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END
            ELSE CASE WHEN e.text IS DISTINCT FROM c.own.text THEN 'duplicate' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END END AS status,
       e.turn AS place, CASE WHEN e.kind = 'result' AND c.call_id IS NOT NULL THEN l.level + 1 WHEN e.kind = 'call' THEN l.level ELSE 0 END AS level,
       CASE WHEN e.kind = 'call' AND coalesce(e.text, '') = '' THEN 1 ELSE 0 END AS n_errors,
       CASE e.kind WHEN 'call' THEN '{"arguments":{"text":' || coalesce(to_json(e.text)::VARCHAR, 'null') || ',"turn":' || e.turn || '},"id":"' || e.call_id || '","name":"reply","type":"call"}'
            WHEN 'result' THEN '{"content":' || coalesce(to_json(e.text)::VARCHAR, 'null') || ',"id":"' || e.call_id || '","type":"result"}'
            ELSE '{"content":' || coalesce(to_json(e.text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(e.role)::VARCHAR, 'null') || ',"type":"message"}' END AS line
FROM e LEFT JOIN c ON e.call_id = c.call_id LEFT JOIN r ON e.call_id = r.call_id LEFT JOIN l ON e.call_id = l.call_id""",
}
