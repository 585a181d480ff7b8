"""Chat formatting with tool calls: link calls to results, order them, validate arguments, serialise canonical JSON.

Calls and results are hash-joined by identifier. A call may name calls whose results it needs; its level in the
topological order is one more than the highest of theirs.
Arguments are checked against the schema of the tool they name, and every record is written as canonical JSON: keys sorted,
no spaces, no escapes but the needed ones.

Defined results for odd input:
- calls that repeat an identifier are one call, the one with the least (turn, arguments); ``n_calls`` counts them; the same
  holds for results, whose first by (turn, content) is linked;
- a call without result is 'unanswered', a result without call 'orphan'; a null identifier links with nothing and is left
  out of ``formatted``; ``records`` returns every row of a table of turns, those that ``formatted`` leaves out too;
- a call that needs one that isn't there, or itself through others, has no level (null) and status 'unordered';
- arguments that are null or empty are an empty object; arguments that aren't a JSON object (numbers without a value, lone
  surrogates and nesting deeper than Python reads are no JSON) stand in the record as the text they are and are invalid, as
  are those of tools without schema; a schema that names an unknown type is a problem of the arguments it meets;
- an empty table gives an empty result; other columns play no part; texts may be of any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import written

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str) -> bool:
    """Whether a value is of a JSON type; a number without a fraction is an integer, however it is written."""
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    kinds = schema.get("type")
    if kinds is not None:
        named = [kinds] if isinstance(kinds, str) else kinds
        if unknown := [str(k) for k in named if k not in _KINDS]:
            return [f"{at}: schema names no known type: {'/'.join(unknown)}"]
        if not any(_is(value, k) for k in named):
            return [f"{at}: not of type {'/'.join(named)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            found.append(f"{at}: too large")
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in inner:
                found += problems(value[k], inner[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{at}[{i}]")
    return found


def _plain(value):
    """A value with keys in the order of their UTF-16 units and whole numbers written as such."""
    if isinstance(value, dict):
        return {k: _plain(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be"))}
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    return value


def canonical(value) -> str:
    """The one JSON text of a value; ValueError for what JSON can't say."""
    return json.dumps(_plain(value), separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def checked(text: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """The arguments that a text holds and what is wrong with them; a text that is no JSON comes back as it is."""
    try:
        value = json.loads(text or "{}")
        canonical(value).encode()
        return value, ["$: no such tool"] if schema is None else problems(value, {"type": "object"} | schema)
    except (ValueError, RecursionError):
        return text, ["$: not JSON"]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """A row per identifier: the call (conv_id, turn, name, arguments, needs), its result and status.

    ``calls``: call_id, conv_id, turn, name, arguments (JSON), needs (array of identifiers, or null);
    ``results``: call_id, turn, content.
    """
    first = F.min(F.struct("turn", "arguments", "conv_id", "name", F.coalesce("needs", F.array().cast("array<string>")).alias("needs")))
    one = calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(first.alias("_c"), F.count(F.lit(1)).alias("n_calls"))
    answer = results.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("n_results"))
    both = one.join(answer.hint("shuffle_hash"), "call_id", "full_outer")
    status = F.when(F.col("_c").isNull(), "orphan").when(F.col("_r").isNull(), "unanswered").otherwise("linked")
    return both.select("call_id", "_c.conv_id", F.col("_c.turn").alias("call_turn"), "_c.name", "_c.arguments", "_c.needs", F.col("_r.turn").alias("result_turn"), F.col("_r.content").alias("result"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"))


def levels(linked: DataFrame) -> DataFrame:
    """(call_id, level) of the calls that can be ordered.

    A call that needs one other hangs on it; along such chains a call's distance to the first that needs none or several
    (its anchor) doubles its reach each round, so a conversation of n turns takes log n rounds. Calls that need several
    are then placed level by level over anchors.
    """
    calls = written(linked.filter("n_calls > 0").select("call_id", F.array_distinct("needs").alias("needs")), "needs")
    one = F.size("needs") == 1
    # open: ``to`` isn't known to be an anchor yet; a chain that leads nowhere or round in a circle ends with none
    hop = written(calls.select("call_id", F.when(one, F.col("needs")[0]).otherwise(F.col("call_id")).alias("to"), one.cast("long").alias("dist"), one.alias("open")), "hops")
    rounds = hop.filter("open").count().bit_length() + 1
    while rounds and not hop.filter("open").isEmpty():
        ahead = hop.select(F.col("call_id").alias("_n"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("open").alias("_open"))
        moved = hop.filter("open").join(ahead, F.col("to") == F.col("_n"), "left").select("call_id", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.coalesce("_open", F.lit(False)).alias("open"))
        hop = written(hop.filter("NOT open").unionByName(moved), "hops")
        rounds -= 1
    hop = hop.select("call_id", F.when(~F.col("open"), F.col("to")).alias("to"), "dist")
    known = written(calls.filter(F.size("needs") == 0).select(F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("at")), "anchors")
    several = calls.filter(F.size("needs") > 1).select(F.col("call_id").alias("m"), F.explode("needs").alias("need"))
    several = written(several.join(hop, F.col("need") == F.col("call_id"), "left").select("m", "to", "dist"), "several")
    while not several.isEmpty():
        seen = several.join(known, F.col("to") == F.col("anchor"), "left").groupBy("m").agg(F.count(F.lit(1)).alias("_n"), F.count("at").alias("_k"), F.max(F.col("at") + F.col("dist")).alias("_at"))
        ready = written(seen.filter("_n = _k").select(F.col("m").alias("anchor"), (F.col("_at") + 1).alias("at")), "ready")
        if ready.isEmpty():
            break
        several = written(several.join(ready, F.col("m") == F.col("anchor"), "left_anti"), "several")
        known = written(known.unionByName(ready), "anchors")
    return written(hop.join(known, F.col("to") == F.col("anchor")).select("call_id", (F.col("at") + F.col("dist")).cast("int").alias("level")), "levels")


_FORMATTED = "call_id string, conv_id long, call_turn long, result_turn long, status string, level int, valid boolean, problems array<string>, message_json string"


def formatted(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per identifier: turns, status, level, whether the arguments fit their schema, and the canonical record."""
    linked = written(link(calls, results), "linked")
    rows = linked.join(levels(linked), "call_id", "left")
    status = F.when(F.col("level").isNull() & (F.col("status") != "orphan"), "unordered").otherwise(F.col("status"))
    rows = rows.select("call_id", F.col("conv_id").cast("long").alias("conv_id"), F.col("call_turn").cast("long").alias("call_turn"), F.col("result_turn").cast("long").alias("result_turn"), status.alias("status"), "level", "name", "arguments", "result")
    names = [c.strip().split(" ")[0] for c in _FORMATTED.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                arguments, found = checked(r["arguments"], schemas.get(r["name"]))
                if r["status"] == "orphan":
                    found = []
                record = {"arguments": arguments, "id": r["call_id"], "name": r["name"], "result": r["result"], "valid": not found}
                out.append((*(r[k] for k in names[:6]), not found, found, canonical(record)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _FORMATTED)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of plain turns: a user turn asks, and needs the user turn two before it if the turn
    between answered that; the assistant turn after it is its result."""
    ident = lambda turn: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), turn.cast("string"))
    user = conversations.filter("role = 'user' AND turn IS NOT NULL")
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    asked = user.select(ident(F.col("turn")).alias("call_id"), "conv_id", "turn", F.lit("ask").alias("name"), arguments.alias("arguments"), ident(F.col("turn") - 2).alias("_need"))
    there = user.select(ident(F.col("turn")).alias("_there")).distinct()
    calls = asked.join(there, F.col("_need") == F.col("_there"), "left").select("call_id", "conv_id", "turn", "name", "arguments", F.when(F.col("_there").isNotNull(), F.array("_need")).alias("needs"))
    results = conversations.filter("role = 'assistant' AND turn IS NOT NULL").select(ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def records(conversations: DataFrame) -> DataFrame:
    """A row for every row of a table of plain turns, whatever its role: call_id, status, n_calls, n_results and record.

    User and assistant rows have the status of their call; those that repeat (conv_id, turn) with another text than the
    one that is linked are 'repeated', those without turn 'unlinked'; rows of all other roles are 'context'. Equal rows
    have equal records.
    """
    calls, results = turns_as_calls(conversations)
    linked = link(calls, results).select(F.col("call_id").alias("_id"), "arguments", "result", F.col("status").alias("_status"), "n_calls", "n_results")
    role, turn = F.col("role"), F.col("turn")
    user, assistant = role.eqNullSafe("user"), role.eqNullSafe("assistant")
    at = F.when(user, turn).when(assistant, turn - 1)
    ident = F.when(at.isNotNull(), F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), at.cast("string")))
    rows = conversations.select("conv_id", "turn", "role", "text", ident.alias("call_id"))
    rows = rows.join(linked, F.col("call_id") == F.col("_id"), "left")
    asked = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    first = F.when(user, asked.eqNullSafe(F.col("arguments"))).otherwise(F.col("text").eqNullSafe(F.col("result")))
    status = F.when(~user & ~assistant, "context").when(turn.isNull(), "unlinked").when(~first, "repeated").otherwise(F.col("_status"))
    message = F.to_json(F.struct("conv_id", F.col("call_id").alias("id"), "role", "text", "turn"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "turn", "role", "call_id", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), message.alias("message_json"))


#: The tool that a plain user turn calls.
ASK = {"ask": {"required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
