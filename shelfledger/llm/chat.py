"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

Messages are rows ``(conv_id, turn, role, text)``. The text of an assistant message may be
a JSON object with ``tool_calls``, a list of ``{"id", "name", "arguments", "after"}``;
``after`` names calls whose results the call uses. The text of a ``tool`` message is an
object with ``tool_call_id`` and ``content``. Everything else is plain text.

A call can use calls of earlier turns and of its own message, so the topological order of
a conversation is that of its turns, and within a message that of its calls. Calls and
results meet by hash joins on conversation and identifier, after each side is reduced to
one row for an identifier. A conversation comes out as one line for each event, ordered
by ``turn`` and ``seq``; it is never gathered, however long it is.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


#: Levels of nesting that a JSON text may have; a deeper one is taken as plain text.
DEPTH = 200
#: What :func:`parsed` gives for a JSON text of more levels.
DEEP = object()
_LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """The text with lone surrogates, which no table can hold, as JSON escapes them."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, letters as they are, lone surrogates escaped; whole floats as integers, no NaN."""
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v

    return escaped(json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False))


def finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def parsed(text: str | None) -> object:
    """The JSON value of a text, None where it is none, ``DEEP`` where it has more than ``DEPTH`` levels; numbers that JSON does not know are refused."""
    try:
        value = json.loads(text or "", parse_constant=finite, parse_float=finite)
    except RecursionError:
        return DEEP
    except ValueError:
        return None
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    return DEEP


TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
}


def violations(value: object, schema: Mapping, path: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, bounds, lengths, required and further properties, items."""
    kinds = schema.get("type")
    if kinds is not None and not any(TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}:type"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}:enum")
    if TYPES["number"](value):
        out += [f"{path}:{k}" for k, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)) if k in schema and bad(schema[k])]
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{path}:{k}" for k, bad in ((low, lambda b: len(value) < b), (high, lambda b: len(value) > b)) if k in schema and bad(schema[k])]
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{path}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}:required" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}:unknown")
    return out


def ordered(after: list[list[int]]) -> tuple[list[int], set[int]]:
    """Topological order of calls by the places each comes after, early places first; and the places on or behind a cycle, which come last."""
    waits = [len(set(a)) for a in after]
    then: list[list[int]] = [[] for _ in after]
    for k, a in enumerate(after):
        for x in set(a):
            then[x].append(k)
    ready, out = [k for k, n in enumerate(waits) if not n], []
    while ready:
        k = heapq.heappop(ready)
        out.append(k)
        for x in then[k]:
            waits[x] -= 1
            if not waits[x]:
                heapq.heappush(ready, x)
    left = sorted(set(range(len(after))) - set(out))
    return out + left, set(left)


EVENT = "turn long, tag long, seq int, kind string, call_id string, role string, name string, body string, problems array<string>, refs array<string>"


def message_events(turn: int, role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> list[tuple]:
    """Events of one message, in the columns of ``EVENT``."""
    tag = xxhash.xxh64_intdigest(f"{role}\n{text}") - (1 << 63)
    value = parsed(text) if role in ("tool", "assistant") else None
    if value is DEEP:
        return [(turn, tag, 0, "message", None, role, None, canonical(text), ["nested too deep"], [])]
    if role == "tool" and isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
        return [(turn, tag, 0, "result", escaped(value["tool_call_id"]), role, None, canonical(value.get("content")), [], [])]
    if role != "assistant" or not isinstance(value, dict) or not isinstance(value.get("tool_calls"), list):
        return [(turn, tag, 0, "message", None, role, None, canonical(text), [], [])]
    out = [(turn, tag, 0, "message", None, role, None, canonical(value["content"]), [], [])] if value.get("content") is not None else []
    calls = [c if isinstance(c, dict) else {} for c in value["tool_calls"]]
    ids = [escaped(c["id"]) if isinstance(c.get("id"), str) else None for c in calls]
    refs = [[escaped(x) for x in c["after"] if isinstance(x, str)] if isinstance(c.get("after"), list) else [] for c in calls]
    place = {}
    for k, x in enumerate(ids):
        place.setdefault(x, k)
    order, cyclic = ordered([[place[x] for x in r if x in place] for r in refs])
    for seq, k in enumerate(order, len(out)):
        name, arguments, problems = calls[k].get("name"), calls[k].get("arguments"), []
        if isinstance(arguments, str):  # arguments are often sent as JSON in a string
            arguments = parsed(arguments)
            if arguments is DEEP:
                arguments = None
                problems.append("arguments nested too deep")
        if ids[k] is None:
            problems.append("no id")
        if not isinstance(name, str) or name not in schemas:
            problems.append("unknown tool")
        else:
            problems += [escaped(f"arguments {x}") for x in violations(arguments, schemas[name])]
        if k in cyclic:
            problems.append("cycle")
        out.append((turn, tag, seq, "call", ids[k], role, escaped(name) if isinstance(name, str) else None, canonical(arguments), problems, [x for x in refs[k] if x not in place]))
    return out


def _arrow(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], kinds.names)


def events(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """The events of every message; ``tag`` tells different messages of one turn apart."""
    schema = T.StructType([T.StructField("conv_id", messages.schema["conv_id"].dataType), *T._parse_datatype_string(EVENT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, *e) for c, *m in zip(*(b.column(k).to_pylist() for k in range(4))) for e in message_events(*m, schemas)]
            if rows:
                yield _arrow(schema, rows)

    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(run, schema)


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"{n}_"])
    return out


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumnRenamed(n, f"{n}_")
    return df


def link(found: DataFrame) -> DataFrame:
    """Events with ``answer`` and ``answer_turn`` of calls, and with the problems that links show.

    A call is answered by the first result of its identifier that comes after it. Calls
    without one, identifiers used by several calls, results without a call before them,
    later results of one identifier, and references to calls that are unknown or of a
    later turn are problems.
    """
    calls, results = found.filter("kind = 'call'"), found.filter("kind = 'result'")
    key = ["conv_id", "call_id"]
    asked = calls.filter("call_id is not null").groupBy(*key).agg(F.min("turn").alias("asked"), F.count("*").alias("n_calls"))
    # one row for each identifier: its first call, and the first result after that
    place = F.struct("turn", "tag")
    a1 = _keyed(asked, *key)
    told = results.join(a1, _same(results, a1, *key), "left").withColumn("early", F.col("asked").isNull() | (F.col("turn") <= F.col("asked")))
    told = told.drop("conv_id_", "call_id_", "n_calls")
    first = told.filter("not early").groupBy(*key).agg(F.min(place).alias("answered"), F.min_by("body", place).alias("answer"))
    f1, f2, a2 = _keyed(first, *key), _keyed(first, *key), _keyed(asked, *key)

    def note(*pairs: tuple[Column, str]) -> Column:
        said = F.array(*[F.when(c, F.lit(t)) for c, t in pairs])
        return F.concat("problems", F.filter(said, lambda x: x.isNotNull()))

    c = calls.join(f1, _same(calls, f1, *key), "left").drop("conv_id_", "call_id_")
    c = c.join(a2, _same(c, a2, *key), "left").drop("conv_id_", "call_id_")
    mine = F.coalesce(F.col("answered.turn") > F.col("turn"), F.lit(False))
    c = c.withColumn("problems", note((~mine, "unanswered"), (F.col("n_calls") > 1, "identifier used again")))
    c = c.withColumn("answer", F.when(mine, F.col("answer"))).withColumn("answer_turn", F.when(mine, F.col("answered.turn")))
    # references to other messages
    unit = ["conv_id", "turn", "tag", "seq"]
    refs = c.select(*unit, F.explode("refs").alias("call_id")).distinct()
    a3 = _keyed(asked, *key)
    wrong = refs.join(a3, _same(refs, a3, *key), "left").filter("asked is null or asked >= turn")
    wrong = wrong.groupBy(*unit).agg(F.sort_array(F.collect_set(F.concat(F.when(F.col("asked").isNull(), "unknown reference ").otherwise("later reference "), "call_id"))).alias("wrong"))
    w = _keyed(wrong, *unit)
    c = c.join(w, _same(c, w, *unit), "left").withColumn("problems", F.concat("problems", F.coalesce("wrong", F.array().cast("array<string>"))))
    r = told.join(f2, _same(told, f2, *key), "left").drop("conv_id_", "call_id_")
    again = ~F.col("early") & (place > F.col("answered"))
    r = r.withColumn("problems", note((F.col("early"), "no call before"), (again, "answered before")))
    names = [*found.columns, "answer", "answer_turn"]
    nothing = [F.lit(None).cast("string").alias("answer"), F.lit(None).cast("long").alias("answer_turn")]
    return (c.select(names).union(r.select(*found.columns, *nothing))
            .union(found.filter("kind = 'message'").select(*found.columns, *nothing)))


def lines(linked: DataFrame) -> DataFrame:
    """``(conv_id, turn, seq, kind, call_id, answer_turn, problems, line)``: each event as canonical JSON."""
    head = [linked.schema["conv_id"]]
    schema = T.StructType([*head, *T._parse_datatype_string("turn long, seq int, kind string, call_id string, answer_turn long, problems array<string>, line string").fields])

    def line(kind, call_id, role, name, body, answer, problems):
        value = {"content": json.loads(body), "role": role}
        if kind == "result":
            value["tool_call_id"] = call_id
        elif kind == "call":
            value = {"arguments": json.loads(body), "id": call_id, "name": name, "role": role}
            if answer is not None:
                value["result"] = json.loads(answer)
        return canonical(value | ({"problems": problems} if problems else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, t, s, k, i, at, p, line(k, i, r, n, body, a, p)) for c, t, s, k, i, r, n, body, a, at, p in zip(*(x.to_pylist() for x in b.columns))]
            if rows:
                yield _arrow(schema, rows)

    return linked.select("conv_id", "turn", "seq", "kind", "call_id", "role", "name", "body", "answer", "answer_turn", "problems").mapInArrow(run, schema)


def format_chats(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Every event of every conversation as a line of canonical JSON, with its links and problems.

    ``schemas`` gives each tool's JSON schema of arguments. Null and empty texts are plain
    messages; rows without a conversation belong to one of their own, rows without a turn
    are linked to nothing; equal rows stay, each with its line. Extra columns are not read.
    No text ends a job: JSON nested more than ``DEPTH`` levels deep is a plain message with a
    problem, or arguments of null with one; lone surrogates, which only JSON escapes can
    bring, stay escapes in ids, names and lines.
    """
    return lines(link(cut(events(messages, schemas))))


#: Arguments of the calls that :func:`with_tools` makes.
TOOLS = {
    "search": {"type": "object", "required": ["query", "words"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 2, "maxLength": 160}, "words": {"type": "integer", "minimum": 1, "maximum": 20}}},
    "define": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 40}, "words": {"type": "integer", "maximum": 4}}},
}


def with_tools(conversations: DataFrame) -> DataFrame:
    """Conversations whose user turns also call tools and whose assistant turns also answer them.

    The conversations at hand hold no calls, so these follow from their texts: every
    sentence of a user turn is a call, long ones of ``search`` and others of ``define``;
    one of an even number of words uses the call of the sentence behind it, or, at the end
    of its turn, the first call of the user turn before. Every sentence of an assistant
    turn answers the call of the same number in the turn before it, so calls remain
    unanswered and answers without a call. Turn t becomes 3 t, calls 3 t + 1, answers 3 t - 1.
    """
    said = F.filter(F.split("text", r"\.\s*"), lambda s: F.length(F.trim(s)) > 0)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("t"), "role", "text", said.alias("said"))

    def identifier(turn: Column, k: Column) -> Column:
        return F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), turn.cast("string"), k.cast("string"))

    def call(s: Column, k: Column) -> Column:
        words = F.size(F.split(F.trim(s), r"\s+"))
        other = F.when(k + 1 < F.size("said"), identifier(F.col("t"), k + 1)).otherwise(identifier(F.col("t") - 2, F.lit(0)))
        return F.struct(
            identifier(F.col("t"), k).alias("id"), F.when(words > 4, "search").otherwise("define").alias("name"),
            F.struct(F.trim(s).alias("query"), words.alias("words")).alias("arguments"),
            F.when(words % 2 == 0, F.array(other)).otherwise(F.array().cast("array<string>")).alias("after"))

    plain = rows.select("conv_id", (F.col("t") * 3).alias("turn"), "role", "text")
    calls = rows.filter("role = 'user' and size(said) > 0").select(
        "conv_id", (F.col("t") * 3 + 1).alias("turn"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.transform("said", call).alias("tool_calls"))).alias("text"))
    answers = rows.filter("role = 'assistant'").select("conv_id", "t", F.posexplode("said").alias("k", "s")).select(
        "conv_id", (F.col("t") * 3 - 1).alias("turn"), F.lit("tool").alias("role"),
        F.to_json(F.struct(identifier(F.col("t") - 1, F.col("k")).alias("tool_call_id"), F.col("s").alias("content"))).alias("text"))
    return plain.union(calls).union(answers)
