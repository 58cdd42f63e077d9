"""Chat formatting with linked tool calls.

An assistant turn whose text is a JSON object with ``tool_calls`` (a list of {id, name, arguments}) makes
calls beside its content; a turn of role ``tool`` whose text is {tool_call_id, content} answers one. Calls and
results are hash-joined by (conversation, identifier), never gathered: a conversation that holds a third of
all turns is spread like any other rows. An argument {"$ref": id} makes a call depend on another of its
conversation; levels of the topological order are found by rounds of joins, as many as the deepest chain
has calls. Arguments are validated against a JSON schema for each tool, and everything is serialised
as canonical JSON: keys sorted, no blanks, no escapes but those that JSON demands.

The result is a row for each message, call and result. A conversation reads in the order of (turn, level,
place, part): a call follows its message after all calls that it depends on, a result its call.

Defined cases: a null role or text is a JSON null; a text that is not such an object is a plain message,
the empty one too; a call or result without a usable id, name or JSON arguments is ``invalid``, and so are
arguments that are nested beyond ``NESTING`` or hold numbers beyond doubles; lone surrogates are written as escapes; of equal call ids in a conversation the
first in (turn, place) counts and later ones are ``duplicate``, likewise results; a result without a call is an ``orphan``, a call
without a result ``unanswered``; calls in a cycle, and what depends on them, are ``cycle`` and come last; null
conversation ids are one conversation; repeated rows are repeated messages, and duplicates as calls; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PARSED = "conv_id long, turn long, role string, kind string, place int, call_id string, needs array<string>, message string, errors string"
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Levels of nesting that JSON may have; what is deeper is not read as JSON.
NESTING = 100
_LONE = re.compile("[\ud800-\udfff]")


def clean(text: str) -> str:
    """text with lone surrogates, which no UTF-8 has, as the escapes that JSON writes them with."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return clean(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def _refused(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    out = float(text)
    if out in (float("inf"), float("-inf")):
        raise ValueError(f"{text} is out of range")
    return out


def read_json(text: str) -> Any:
    """The value of a JSON text; ValueError for what is none, holds a number beyond doubles, or is nested beyond NESTING."""
    try:
        out = json.loads(text, parse_constant=_refused, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    here = [out]
    for _ in range(NESTING + 1):
        here = [y for x in here if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not here:
            return out
    raise ValueError("nested too deeply")


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS.get(kind, object))


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum, pattern."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not among the allowed values")
    if _is(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: does not match {schema['pattern']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    return out


def references(value: Any) -> set[str]:
    """The ids that {"$ref": id} names anywhere in a value."""
    if isinstance(value, dict):
        own = {value["$ref"]} if set(value) == {"$ref"} and isinstance(value["$ref"], str) else set()
        return own.union(*(references(x) for x in value.values()))
    return set().union(*(references(x) for x in value)) if isinstance(value, list) else set()


def _resolved(value: Any, schema: dict | None) -> list[str]:
    """Violations, where a reference stands for any value."""
    if schema is None:
        return []
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    if isinstance(value, dict) and isinstance(schema.get("properties"), dict):
        free = {k for k, x in value.items() if isinstance(x, dict) and set(x) == {"$ref"}}
        return violations(value, schema | {"properties": {k: {} if k in free else s for k, s in schema["properties"].items()}})
    return violations(value, schema)


def _object(text: str | None, key: str) -> dict | None:
    """text as a JSON object with this key, if it is one."""
    if text is None or key not in text or not text.lstrip().startswith("{"):
        return None
    try:
        out = read_json(text)
    except ValueError:
        return None
    return out if isinstance(out, dict) and key in out else None


def parsed_turn(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, place, call id, needs, message, errors) of a turn's message, calls and result."""
    if role == "tool" and (obj := _object(text, "tool_call_id")) is not None:
        call_id = obj["tool_call_id"]
        ok = isinstance(call_id, str) and bool(call_id)
        return [("result", 0, call_id if ok else None, [], canonical({"content": obj.get("content"), "tool_call_id": call_id, "type": "tool_result"}), "" if ok else "$.tool_call_id: not a name")]
    obj = _object(text, "tool_calls") if role == "assistant" else None
    if obj is None or not isinstance(obj["tool_calls"], list):
        return [("message", 0, None, [], canonical({"content": text, "role": role}), "")]
    out = [("message", 0, None, [], canonical({"content": obj.get("content"), "role": role}), "")]
    for k, call in enumerate(obj["tool_calls"]):
        call = call if isinstance(call, dict) else {"value": call}
        arguments, errors = call.get("arguments"), []
        if isinstance(arguments, str):
            try:
                arguments = read_json(arguments)
            except ValueError:
                errors.append("$: not JSON")
        call_id, name = call.get("id"), call.get("name")
        if not isinstance(call_id, str) or not call_id:
            call_id = None
            errors.append("id: missing")
        if not isinstance(name, str) or (schemas and name not in schemas):
            errors.append("name: unknown")
        elif not errors or errors == ["id: missing"]:
            errors += _resolved(arguments, schemas.get(name))
        message = canonical({"arguments": arguments, "id": call_id, "name": name, "type": "tool_call"})
        out.append(("call", k, call_id, sorted(references(arguments)), message, "; ".join(errors)))
    return out


def parsed(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                for kind, place, call_id, needs, message, errors in parsed_turn(role, text, schemas):
                    rows.append((conv, turn, role, kind, place, None if call_id is None else clean(call_id), [*map(clean, needs)], message, clean(errors)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            names = ["conv_id", "turn", "role", "kind", "place", "call_id", "needs", "message", "errors"]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, _PARSED)


def levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level) of the calls that are in no cycle and need none that is.

    calls: conv, call_id, needs. Each round settles the calls whose needs are all settled.
    """
    needs = calls.select("conv", "call_id", F.explode("needs").alias("need"))
    known = calls.select("conv", F.col("call_id").alias("need"))
    waits = common.written(needs.join(known, ["conv", "need"], "left_semi").distinct(), "waits")
    settled = common.written(calls.select("conv", "call_id").join(waits, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    out, level = settled, 0
    while not settled.isEmpty() and not waits.isEmpty():
        level += 1
        before = waits.select("conv", "call_id").distinct()
        waits = common.written(waits.join(settled.select("conv", F.col("call_id").alias("need")), ["conv", "need"], "left_anti"), "waits")
        settled = common.written(before.join(waits, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(level)), "level")
        out = out.unionByName(settled)
    return out


def formatted(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, level, place, part, kind, role, call_id, status, errors, message: see above."""
    rows = common.written(parsed(turns, schemas or {}), "turns")
    # a conversation's key without nulls; ids of tool calls are only unique within one
    keyed = rows.withColumn("conv", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id")))
    plain = keyed.where("kind = 'message'")
    shape = lambda df, turn, level, place, part, status: df.select(
        "conv_id", turn.alias("turn"), level.alias("level"), place.alias("place"), F.lit(part).alias("part"), "kind", "role", "call_id", status.alias("status"), "errors", "message"
    )
    zero = F.lit(0)
    out = shape(plain, F.col("turn"), zero, zero, 0, F.lit("ok"))
    if keyed.where("kind <> 'message'").isEmpty():
        return out

    numbered = common.written(keyed.where("kind <> 'message'").withColumn("row", F.monotonically_increasing_id()), "calls-and-results")
    usable = numbered.where("call_id is not null")
    order = F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "place", "row")
    first = usable.groupBy("conv", "call_id", "kind").agg(F.min(order).getField("row").alias("row"))
    first = common.written(usable.join(first.select("row"), "row", "left_semi"), "first-of-id")
    calls, results = first.where("kind = 'call'"), first.where("kind = 'result'")
    placed = calls.join(levels(calls.select("conv", "call_id", "needs")), ["conv", "call_id"], "left")
    answers = results.select("conv", "call_id", F.col("row").alias("answer"))
    linked = common.written(placed.join(answers, ["conv", "call_id"], "left"), "linked-calls")
    last = F.coalesce("level", F.lit((1 << 31) - 1))
    status = F.when(F.col("errors") != "", "invalid").when(F.col("level").isNull(), "cycle").when(F.col("answer").isNull(), "unanswered").otherwise("ok")
    out = out.union(shape(linked, F.col("turn"), last, F.col("place") + 1, 1, status))
    homes = linked.where("answer is not null").select(F.col("answer").alias("row"), F.col("turn").alias("h_turn"), last.alias("h_level"), (F.col("place") + 1).alias("h_place"))
    answered = results.join(homes, "row", "left")
    home = F.col("h_level").isNotNull()
    out = out.union(shape(answered, F.when(home, F.col("h_turn")).otherwise(F.col("turn")), F.when(home, F.col("h_level")).otherwise(0), F.when(home, F.col("h_place")).otherwise(0), 2, F.when(home, "ok").otherwise("orphan")))
    rest = numbered.join(first.select("row"), "row", "left_anti")
    is_call = F.col("kind") == "call"
    return out.union(shape(rest, F.col("turn"), F.when(is_call, (1 << 31) - 1).otherwise(0), F.when(is_call, F.col("place") + 1).otherwise(0), 3, F.when(F.col("call_id").isNull(), "invalid").otherwise("duplicate")))


def write_chats(chats: DataFrame, path: str) -> None:
    """formatted() rows as text, a JSON line each, in the order in which conversations read."""
    order = ["conv_id", "turn", "level", "place", "part", "message"]
    chats.repartitionByRange(*order).sortWithinPartitions(*order).select("message").write.text(path)


#: The tools that the query's calls name, and what their arguments must be.
SCHEMAS = {role: {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "pattern": "[a-z]"}}} for role in ("system", "user")}


def as_calls(turns: DataFrame) -> DataFrame:
    """A call for each turn that is not the assistant's, and a result for each that is, of conversations that hold plain turns only.

    The call of a turn has its number as id, its role as name, and its text as argument; it depends on that of half its number, so that
    chains stay short in the longest conversation. An assistant's turn answers the one before it.
    """
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    asked = ~F.col("role").eqNullSafe("assistant")
    need = F.when(F.col("turn") > 0, F.struct(F.shiftright("turn", 1).cast("string").alias("$ref")))
    call = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("name"), F.struct(need.alias("after"), "text").alias("arguments"))
    calls = own.where(asked).select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    result = F.struct((F.col("turn") - 1).cast("string").alias("tool_call_id"), F.col("text").alias("content"))
    return calls.union(own.where(~asked).select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(result).alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every message of ``conversations``, and the linked calls and results that as_calls makes of its turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return formatted(turns.union(as_calls(turns)), SCHEMAS)


_TEXT, _ROLE = "to_json(text)::varchar", "coalesce(to_json(role)::varchar, 'null')"
#: Turns have numbers from 0, once in each conversation.
ORACLE = f"""
with recursive asked as (select *, turn >= 1 as later from conversations where role is distinct from 'assistant'),
levels(conv_id, turn, level) as (
  select a.conv_id, a.turn, 0 from asked a where a.turn < 1 or not exists (select 1 from asked b where b.conv_id = a.conv_id and b.turn = a.turn // 2)
  union all
  select a.conv_id, a.turn, l.level + 1 from levels l join asked a on a.conv_id = l.conv_id and a.turn // 2 = l.turn and a.turn >= 1),
called as (
  select a.conv_id, a.turn, l.level, r.turn is not null as answered, concat_ws('; ',
           case when role is null or role not in ('user', 'system') then 'name: unknown'
                when text is null then '$.text: missing'
                when not regexp_matches(text, '[a-z]') then '$.text: does not match [a-z]' end) as errors,
         '{{"arguments":{{' || case when later then '"after":{{"$ref":"' || (a.turn // 2) || '"}}' else '' end || case when later and text is not null then ',' else '' end
           || coalesce('"text":' || {_TEXT}, '') || '}},"id":"' || a.turn || '","name":' || {_ROLE} || ',"type":"tool_call"}}' as message
  from asked a join levels l using (conv_id, turn) left join (select conv_id, turn from conversations where role = 'assistant') r on r.conv_id = a.conv_id and r.turn = a.turn + 1),
answers as (
  select c.conv_id, c.turn as own, '{{"content":' || coalesce(to_json(c.text)::varchar, 'null') || ',"tool_call_id":"' || (c.turn - 1) || '","type":"tool_result"}}' as message, l.level, l.turn is not null as home
  from conversations c left join levels l on l.conv_id = c.conv_id and l.turn = c.turn - 1 where c.role = 'assistant')
select conv_id, turn, 0 as level, 0 as place, 0 as part, 'message' as kind, role, null::varchar as call_id, 'ok' as status, '' as errors,
       '{{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || {_ROLE} || '}}' as message from conversations
union all select conv_id, turn, 0, 0, 0, 'message', 'assistant', null, 'ok', '', '{{"content":null,"role":"assistant"}}' from asked
union all select conv_id, turn, level, 1, 1, 'call', 'assistant', turn::varchar, case when errors <> '' then 'invalid' when answered then 'ok' else 'unanswered' end, errors, message from called
union all select conv_id, case when home then own - 1 else own end, case when home then level else 0 end, case when home then 1 else 0 end, 2, 'result', 'tool', (own - 1)::varchar,
                 case when home then 'ok' else 'orphan' end, '', message from answers
"""
