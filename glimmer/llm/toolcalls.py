"""Chat formatting: tool calls linked with their results, ordered, validated, canonical.

A turn's text is plain, or a JSON object.  An assistant's object may have ``tool_calls``,
a list of {id, name, arguments}; a tool's object has ``tool_call_id`` and ``content``.
Arguments may be an object or its JSON text, and may refer to the result of another call
by {"$ref": id}.  Anything else is plain content.

Calls and results are linked by a hash join on (conversation, id): of calls, or of
results, with one id the first by (turn, place) counts.  A result follows its call, and a
call follows the results it refers to; messages that already stand so keep their turn,
others move right behind the last one they need.  Messages on a cycle, or that need one
on a cycle, keep their turn.  Each message becomes one canonical JSON line: keys sorted,
no spaces, UTF-8 unescaped.

Conversations of at most ``WHOLE`` links are ordered in one pass, each by the task that its
links are sent to; messages' texts aren't moved for it.  A longer one is never held in one
task: a chain of its messages is ordered by pointer jumping, in a number of rounds that grows
with the logarithm of its length; a message that needs several others waits for all of them,
so that there rounds grow with the longest chain of such messages.  Both ways give one order.

JSON that nests too deeply for Python's parser or writer isn't read: a whole text is then
plain content, and arguments given as text stay text, with the problem "$: not JSON".
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import slices
from .workspace import Workspace

#: Schemas by tool name, as a subset of JSON Schema: type, properties, required, enum, items, additionalProperties.
Schemas = dict[str, dict]
#: Tools of the registered query.
TOOLS: Schemas = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _load(text: str) -> object:
    """A JSON value; ``ValueError`` where it isn't one that a message in UTF-8 JSON can hold."""
    try:
        value = json.loads(text, parse_constant=_refuse)
        canonical([[[[value]]]]).encode()  # as deep as arguments stand in a message
    except RecursionError as e:
        raise ValueError("too deep") from e
    return value


def problem(value: object, schema: dict, path: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema``, or None."""
    kind = schema.get("type")
    if kind == "integer":
        ok = isinstance(value, int) and not isinstance(value, bool)
    elif kind == "number":
        ok = isinstance(value, int | float) and not isinstance(value, bool)
    else:
        ok = kind is None or isinstance(value, _TYPES[kind])
    if not ok:
        return f"{path}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not among the values"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := problem(x, schema["items"], f"{path}[{i}]"):
                return found
    return None


def _references(value: object) -> set[str]:
    """The ids that a value refers to, at any depth."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                found.add(v["$ref"])
            else:
                todo += v.values()
        elif isinstance(v, list):
            todo += v
    return found


def parse(role: str | None, text: str | None, schemas: Schemas) -> dict:
    """content, calls (id, name, problem, refs), result_of and the canonical line of one message."""
    out: dict = {"content": text or "", "calls": [], "result_of": None}
    message: dict = {"content": text or "", "role": role}
    if role in ("assistant", "tool") and text and text.lstrip()[:1] == "{":
        try:
            value = _load(text)
        except ValueError:
            value = None
        if role == "tool" and isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
            out["result_of"] = value["tool_call_id"]
            message |= {"content": value.get("content", ""), "tool_call_id": value["tool_call_id"]}
        calls = value.get("tool_calls") if isinstance(value, dict) and role == "assistant" else None
        if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
            message |= {"content": value.get("content", ""), "tool_calls": []}
            for c in calls:
                arguments, wrong = c.get("arguments", {}), None
                if isinstance(arguments, str):
                    try:
                        arguments = _load(arguments)
                    except ValueError:
                        wrong = "$: not JSON"
                if wrong is None:
                    references = _references(arguments)
                    wrong = f"{c['name']}: unknown tool" if c["name"] not in schemas else problem(arguments, schemas[c["name"]])
                else:
                    references = set()
                message["tool_calls"].append({"arguments": arguments, "id": c["id"], "name": c["name"]})
                out["calls"].append({"id": c["id"], "name": c["name"], "problem": wrong, "refs": sorted(references)})
    return out | {"json": canonical(message)}


_PARSED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("calls", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("problem", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType()))]))),
        T.StructField("result_of", T.StringType()),
        T.StructField("json", T.StringType()),
    ]
)


def parsed(df: DataFrame, schemas: Schemas) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(_PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(3)):
                found = [parse(r, t, schemas) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                columns = [*part.columns[:3], *(pa.array([f[k] for f in found], type=shape.field(k).type) for k in ("calls", "result_of", "json"))]
                yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, _PARSED)


#: Conversations that are broadcast; with more of them Spark chooses the join.
BROADCAST_CONVERSATIONS = 1_000_000
#: Links of a conversation that one task orders.
WHOLE = 100_000


def places(conv: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """conv_id, turn, at_turn, depth of the messages that must move, of whole conversations' links."""
    conv, turn = np.concatenate((conv, conv)), np.concatenate((before, after))
    order = np.lexsort((turn, conv))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(conv[order]) != 0) | (np.diff(turn[order]) != 0)
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(first) - 1
    conv, turn = conv[order][first], turn[order][first]
    left, right = of[: len(before)], of[len(before) :]
    starts = np.searchsorted(np.sort(left), np.arange(len(turn) + 1)).tolist()
    behind = right[np.argsort(left, kind="stable")].tolist()
    waiting = np.bincount(right, minlength=len(turn)).tolist()
    turns = turn.tolist()
    place = [(t, 0) for t in turns]
    last: list[tuple[int, int] | None] = [None] * len(turns)
    settled = [v for v, n in enumerate(waiting) if not n]
    for v in settled:  # grows while it is read
        for w in behind[starts[v] : starts[v + 1]]:
            last[w] = place[v] if last[w] is None else max(last[w], place[v])
            waiting[w] -= 1
            if not waiting[w]:
                if last[w][0] >= turns[w]:
                    place[w] = (last[w][0], last[w][1] + 1)
                settled.append(w)
    at, depth = np.array(place, dtype=np.int64).reshape(-1, 2).T
    moved = np.flatnonzero((at != turn) | (depth != 0))  # what isn't settled keeps its turn
    return [conv[moved], turn[moved], at[moved], depth[moved].astype(np.int32)]


def _in_one_pass(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, at_turn, depth) of messages that must move, for conversations of at most ``WHOLE`` ``edges``."""
    names = ["conv_id", "turn", "at_turn", "depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            columns = [np.asarray(c) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last conversation may go on
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in places(*(c[:whole] for c in held))], names=names)
                held = [c[whole:] for c in held]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in places(*held)], names=names)

    sent = edges.select("conv_id", "before", "after").repartition("conv_id").sortWithinPartitions("conv_id")
    return sent.mapInArrow(run, "conv_id long, turn long, at_turn long, depth int")


def _moved(ws: Workspace, edges: DataFrame) -> DataFrame | None:
    """(conv_id, turn, at_turn, depth) of messages that must move; ``edges`` (conv_id, before, after) of turns.

    Messages are settled once all before them are; a message stands behind the latest of
    them.  Only conversations with an edge that points backwards are looked at.
    """
    wrong = ws.keep(edges.where("before >= after").select("conv_id").distinct(), "wrong")
    few = wrong.limit(BROADCAST_CONVERSATIONS + 1).count()
    if not few:
        return None
    wrong = F.broadcast(wrong) if few <= BROADCAST_CONVERSATIONS else wrong
    edges = ws.keep(edges.join(wrong, "conv_id", "left_semi").where("before <> after").distinct(), "edges")
    long = ws.keep(edges.groupBy("conv_id").count().where(F.col("count") > WHOLE).select("conv_id"), "long")
    if not long.limit(1).count():
        return ws.keep(_in_one_pass(edges), "moved")
    rest = _by_rounds(ws, ws.keep(edges.join(long, "conv_id", "left_semi"), "long-edges"))
    return ws.keep(_in_one_pass(edges.join(long, "conv_id", "left_anti")), "moved").unionByName(rest)


def _by_rounds(ws: Workspace, edges: DataFrame) -> DataFrame:
    """What :func:`_in_one_pass` gives, for conversations with any number of ``edges``, each once.

    What a path of messages, each of which needs only the one before it, does to the place
    (t, d) of what it starts from is known by three numbers, its length and the place
    (high, deep) it ends in by itself: (t, d + length) if t >= high, else (high, deep).  Each
    round halves such paths by joining a path with the one that its start ends.
    """
    needs = edges.groupBy("conv_id", F.col("after").alias("turn")).agg(F.count(F.lit(1)).alias("needs"), F.min("before").alias("start"))
    needs = ws.keep(needs, "needs")
    roots = edges.select("conv_id", F.col("before").alias("turn")).distinct().join(needs, ["conv_id", "turn"], "left_anti")
    settled = ws.keep(roots.select("conv_id", "turn", F.col("turn").alias("at_turn"), F.lit(0).alias("depth")), "settled-0")
    paths = ws.keep(needs.where("needs = 1").select("conv_id", "turn", "start", F.lit(1).alias("length"), F.col("turn").alias("high"), F.lit(0).alias("deep")), "paths-0")
    forks = ws.keep(edges.withColumnRenamed("after", "turn").join(needs.where("needs > 1").select("conv_id", "turn", "needs"), ["conv_id", "turn"]), "forks-0")
    round_ = 0
    while True:
        place = settled.select("conv_id", F.col("turn").alias("start"), "at_turn", F.col("depth").alias("d"))
        above = F.col("at_turn") >= F.col("high")
        from_paths = paths.join(place, ["conv_id", "start"]).select("conv_id", "turn", F.greatest("at_turn", "high").alias("at_turn"), F.when(above, F.col("d") + F.col("length")).otherwise(F.col("deep")).alias("depth"))
        last = forks.join(settled.select("conv_id", F.col("turn").alias("before"), F.struct("at_turn", "depth").alias("place")), ["conv_id", "before"])
        ready = last.groupBy("conv_id", "turn").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("known"), F.first("needs").alias("needs")).where("known = needs")
        behind = F.col("last.at_turn") >= F.col("turn")
        from_forks = ready.select("conv_id", "turn", F.greatest("last.at_turn", "turn").alias("at_turn"), F.when(behind, F.col("last.depth") + 1).otherwise(0).alias("depth"))
        more = ws.keep(from_paths.unionByName(from_forks), f"more-{round_}")
        if not more.limit(1).count():
            return settled.where("at_turn <> turn or depth <> 0")
        round_ += 1
        done = more.select("conv_id", "turn")
        left = paths.join(done, ["conv_id", "turn"], "left_anti")
        before = left.select("conv_id", F.col("turn").alias("start"), F.col("start").alias("start_0"), F.col("length").alias("length_0"), F.col("high").alias("high_0"), F.col("deep").alias("deep_0"))
        longer = left.join(before, ["conv_id", "start"], "left").select(
            "conv_id", "turn", F.coalesce("start_0", "start").alias("start"), (F.col("length") + F.coalesce("length_0", F.lit(0))).alias("length"), F.greatest("high", "high_0").alias("high"),
            F.when(F.col("high_0") >= F.col("high"), F.col("deep_0") + F.col("length")).otherwise(F.col("deep")).alias("deep"),
        )
        after = ws.keep(settled.unionByName(more), f"settled-{round_}"), ws.keep(longer, f"paths-{round_}"), ws.keep(forks.join(done, ["conv_id", "turn"], "left_anti"), f"forks-{round_}")
        ws.drop(*(f"{name}-{round_ - 1}" for name in ("settled", "more", "paths", "forks")))
        settled, paths, forks = after


def format_chats(df: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per row of ``df`` (conv_id, turn, role, text), sorted over all partitions in the final order.

    conv_id, turn, role; at_turn and depth (the order: conv_id, at_turn, depth, turn);
    n_calls, n_linked (calls of this message that have a result), n_invalid (arguments
    that break their schema, or unknown tools); result_of and linked (of results, whether
    the call exists); json.  A null text is empty content; a null role stays null; rows
    that repeat are all kept; a null conversation or turn links with nothing.
    """
    ws = Workspace(df.sparkSession, "chats")
    rows = ws.keep(parsed(df, schemas), "parsed")
    calls = rows.where(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("place", "call")).select("conv_id", "turn", "place", F.col("call.id").alias("id"), F.col("call.refs").alias("refs"))
    calls_first = calls.groupBy("conv_id", "id").agg(F.min_by(F.struct("turn", "place"), F.struct("turn", "place")).alias("call"))
    results_first = rows.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("id")).agg(F.min("turn").alias("result_turn"))
    links = ws.keep(calls_first.join(results_first, ["conv_id", "id"]).select("conv_id", "id", "call.turn", "call.place", "result_turn"), "links")
    if not links.limit(1).count():
        out = rows.withColumns({"at_turn": F.col("turn"), "depth": F.lit(0), "n_linked": F.lit(0), "linked": F.when(F.col("result_of").isNotNull(), F.lit(False))})
    else:
        forward = links.select("conv_id", F.col("turn").alias("before"), F.col("result_turn").alias("after"))
        refs = calls.select("conv_id", F.col("turn").alias("after"), F.explode("refs").alias("id")).join(links.select("conv_id", "id", F.col("result_turn").alias("before")), ["conv_id", "id"])
        moved = _moved(ws, forward.unionByName(refs.select("conv_id", "before", "after")))
        answered = links.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).cast("int").alias("n_linked"))
        known = links.select("conv_id", F.col("id").alias("result_of"), F.col("result_turn").alias("turn"), F.lit(True).alias("linked"))
        out = rows.join(answered, ["conv_id", "turn"], "left").join(known, ["conv_id", "result_of", "turn"], "left")
        out = out.withColumn("n_linked", F.when(F.size("calls") > 0, F.coalesce("n_linked", F.lit(0))).otherwise(0))
        out = out.withColumn("linked", F.when(F.col("result_of").isNotNull(), F.coalesce("linked", F.lit(False))))
        if moved is None:
            out = out.withColumns({"at_turn": F.col("turn"), "depth": F.lit(0)})
        else:
            out = out.join(moved, ["conv_id", "turn"], "left").withColumns({"at_turn": F.coalesce("at_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    invalid = F.size(F.filter("calls", lambda c: c["problem"].isNotNull()))
    out = out.select("conv_id", "turn", "role", "at_turn", "depth", F.size("calls").alias("n_calls"), "n_linked", invalid.alias("n_invalid"), "result_of", "linked", "json")
    order = ["conv_id", "at_turn", "depth", "turn", "json"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
