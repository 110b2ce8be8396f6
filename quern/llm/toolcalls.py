"""Chat formatting: tool calls linked to their results, put in order, checked against schemas and written as JSON.

Everything here is DataFrame and SQL work. Messages have a conversation, a turn, a kind (call or result), an
identifier, and for calls a tool's name, arguments as JSON and, if they need another call's result, that call's identifier
(``after``). Results meet their calls by a hash join on conversation and identifier, and calls those that they need.

The order is topological: a call comes at its turn or after the calls that it needs, however long that chain is, and
its results come right after it, even if the log has them earlier; what links with nothing keeps its turn. Chains are
followed by doubling: each round joins every call with what its pointer points to, so a chain of n calls takes log n
rounds, each a written table. Calls that are left with a pointer lie on a circle or need one that does. Positions within
a conversation are counted across range partitions, so that no conversation has to fit in one task.

Arguments are checked against the tool's schema: JSON objects, with all required fields, no unknown ones unless
allowed, and of the right types. Canonical JSON has sorted keys and no spaces, which is how a variant keeps and writes
objects; numbers are as a variant writes them.

Defined results: a null or empty text is an empty string; arguments that aren't JSON are the error
``not_json`` and are kept as a JSON string; a tool without schema is ``unknown_tool``; a call that needs an identifier
that no call of its conversation has is ``unknown_reference``, one on a circle or behind it ``circular_reference``, and both
come at their turn; an error of the arguments is told before one of the reference; of several calls with one identifier
the earliest turn owns it and later ones are ``duplicate_id``; a result without a call is ``orphan``; a call without result is
``unanswered``; repeated rows are messages like any others; a null conversation or identifier links with nothing; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, table
from quern.operators.ordering import positions

#: Tools by name: fields with their types, which of them are required, and whether others are allowed.
Schemas = dict[str, dict]

REPLY: Schemas = {
    "reply": {"fields": {"prompt": "string", "role": "string", "turn": "number"}, "required": ["prompt", "role", "turn"], "open": False}
}

_KINDS = {"STRING": "string", "BIGINT": "number", "DOUBLE": "number", "DECIMAL": "number", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}


def json_string(column: Column) -> Column:
    """A JSON string literal of a text."""
    whole = F.to_json(F.struct(column.alias("s")))  # {"s":...}
    return F.when(column.isNotNull(), F.substr(whole, F.lit(6), F.char_length(whole) - 6))


def _kind(variant: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)), F.lit("null"))


def argument_error(name: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """The first fault of a call's arguments (as text, and parsed), or null: one conditional built from the schemas."""
    out = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), "unknown_tool").when(parsed.isNull(), "not_json").when(_kind(parsed) != "object", "not_object")
    keys = F.json_object_keys(arguments)
    for tool, schema in sorted(schemas.items()):
        mine = name == tool
        for field in schema["required"]:
            out = out.when(mine & ~F.array_contains(keys, field), f"missing:{field}")
        for field, kind in sorted(schema["fields"].items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            out = out.when(mine & F.array_contains(keys, field) & (_kind(value) != kind), f"type:{field}")
        if not schema["open"]:
            known = F.array(*[F.lit(f) for f in sorted(schema["fields"])])
            out = out.when(mine & (F.size(F.array_except(keys, known)) > 0), "unknown_field")
    return out


def chains(spark: SparkSession, owners: DataFrame) -> DataFrame:
    """conv_id, call_id, call_turn, answered, known, major, depth and circular of each owner (conv_id, call_id, call_turn, after, answered).

    ``major`` is the latest turn of the call and of all that it needs, ``depth`` how long that chain is."""
    ids = owners.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_call"))
    met = (F.col("conv_id") == F.col("to_conv")) & (F.col("after") == F.col("to_call"))
    state = owners.join(ids, met, "left").select(
        "conv_id",
        "call_id",
        "call_turn",
        "answered",
        (F.col("after").isNull() | F.col("to_call").isNotNull()).alias("known"),
        F.col("to_call").alias("ptr"),
        F.col("call_turn").alias("major"),
        F.when(F.col("to_call").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
    )
    state = materialize(spark, state, "chains")
    left, before = state.where("ptr is not null").count(), None
    # Each round brings some chain to its end, so what no round shortens are circles.
    while left and left != before:
        to = state.select(F.col("conv_id").alias("to_conv"), F.col("call_id").alias("to_call"), F.col("ptr").alias("to_ptr"), F.col("major").alias("to_major"), F.col("depth").alias("to_depth"))
        step = state.join(to, (F.col("conv_id") == F.col("to_conv")) & (F.col("ptr") == F.col("to_call")), "left")
        step = step.select(
            "conv_id",
            "call_id",
            "call_turn",
            "answered",
            "known",
            F.col("to_ptr").alias("ptr"),
            F.greatest("major", "to_major").alias("major"),
            (F.col("depth") + F.coalesce("to_depth", F.lit(0))).alias("depth"),
        )
        state = materialize(spark, step, "chains")
        left, before = state.where("ptr is not null").count(), left
    circular = F.col("ptr").isNotNull()
    return state.select(
        "conv_id",
        "call_id",
        "call_turn",
        "answered",
        "known",
        F.when(circular, F.col("call_turn")).otherwise(F.col("major")).alias("major"),
        F.when(circular, 0).otherwise(F.col("depth")).alias("depth"),
        circular.alias("circular"),
    )


def link(spark: SparkSession, messages: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, position, turn, kind, call_id, status, error, json of each row of ``messages``.

    ``messages``: conv_id, turn, kind ('call', 'result' or 'text'), call_id, name, body (arguments, result or text), and
    optionally after (the identifier of a call whose result a call needs).
    """
    after = F.col("after").cast("string") if "after" in messages.columns else F.lit(None).cast("string")
    messages = messages.select("conv_id", "turn", "kind", "call_id", "name", "body", after.alias("after"))
    calls = messages.where("kind = 'call' and conv_id is not null and call_id is not null")
    # One row for each identifier: what owns it. Minima are combined before the shuffle.
    owner = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "after")).alias("first"))
    owner = owner.select("conv_id", "call_id", F.col("first.turn").alias("call_turn"), "first.after")
    answered = messages.where("kind = 'result' and conv_id is not null and call_id is not null").select("conv_id", "call_id").distinct()
    owner = chains(spark, materialize(spark, owner.join(answered.withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "left"), "owners"))
    # What has no identifier gets one that no call has, so that such rows of one conversation spread over the tasks.
    alone = F.concat(F.lit("\x00"), F.xxhash64("turn", "kind", "body").cast("string"))
    key = F.coalesce(F.when(F.col("conv_id").isNotNull(), F.col("call_id")), alone)
    owner = owner.withColumnsRenamed({"conv_id": "owner_conv", "call_id": "owner_call"})
    rows = messages.withColumn("key", key)
    rows = rows.join(owner, (F.col("conv_id") == F.col("owner_conv")) & (F.col("key") == F.col("owner_call")), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(call & (F.col("turn") > F.col("call_turn")), "duplicate_id")
        .when(call & F.col("answered").isNull(), "unanswered")
        .when(result & F.col("call_turn").isNull(), "orphan")
        .when(call | result, "linked")
        .otherwise("text")
    )
    rows = rows.withColumn("status", status).withColumn("parsed", F.when(call, F.try_parse_json("body")))
    owns = call & F.col("call_turn").isNotNull() & (F.col("turn") == F.col("call_turn"))
    reference = F.when(owns & ~F.col("known"), "unknown_reference").when(owns & F.col("circular"), "circular_reference")
    faults = argument_error(F.col("name"), F.col("body"), F.col("parsed"), schemas)
    rows = rows.withColumn("error", F.when(call, F.coalesce(faults, reference)))
    follows = result & F.col("call_turn").isNotNull()
    chained = owns | follows
    rows = rows.withColumns(
        {
            "major": F.when(chained, F.col("major")).otherwise(F.col("turn")),
            "depth": F.when(chained, F.col("depth")).otherwise(0),
            "lead": F.when(chained, F.col("call_turn")).otherwise(F.col("turn")),
            "own": F.when(chained, F.col("call_id")).otherwise(""),
            "minor": F.when(follows, 1).otherwise(0),
        }
    )
    body = F.coalesce(F.col("body"), F.lit(""))
    arguments = F.coalesce(F.to_json("parsed"), json_string(body))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    # Keys in sorted order, so that the whole message is canonical as well.
    json = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(call & F.col("after").isNotNull(), field("after", json_string(F.col("after")))),
            F.when(call, field("arguments", arguments)).otherwise(field("content", json_string(body))),
            F.when(call | result, field("id", F.coalesce(json_string(F.col("call_id")), F.lit("null")))),
            field("kind", json_string(F.col("kind"))),
            F.when(call, field("name", F.coalesce(json_string(F.col("name")), F.lit("null")))),
        ),
        F.lit("}"),
    )
    order = ["major", "depth", "lead", "own", "minor", "turn", "kind", "json"]
    rows = rows.select("conv_id", "turn", "kind", "call_id", "status", "error", json.alias("json"), *order[:5])
    # Written first: sorting by range samples its input, which would run the joins twice.
    placed = positions(spark, materialize(spark, rows, "messages"), "conv_id", order, materialize)
    return placed.select("conv_id", "position", "turn", "kind", "call_id", "status", "error", "json")


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations, with faults put in by number, so that links, order and checks have work to do.

    Each user's turn calls the tool ``reply``, an assistant's turn is the result of the user's turn before it, by number, and
    everything else is text. In every other conversation a call needs the one two turns later, so that the whole order
    is turned around (and the last call needs one that isn't there); where the number ends in 4, turns by fours need each
    other. Where the number is 1 more than a multiple of 5, two calls share an identifier; where it is 2 more, every third
    turn's result answers what nobody asked. The sum of conversation and turn, by eights, faults the arguments: a
    field is missing, of another type or unknown, the tool is unknown, or they are no JSON or no object.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    fault = F.pmod(conv + turn, F.lit(8))
    fields = [text.alias("prompt"), F.col("role"), turn]
    arguments = (
        F.when(fault == 0, F.to_json(F.struct(turn, text.alias("prompt"))))
        .when(fault == 1, F.to_json(F.struct(text.alias("prompt"), F.col("role"), turn.cast("string").alias("turn"))))
        .when(fault == 2, F.to_json(F.struct(*fields, F.lit(True).alias("extra"))))
        .when(fault == 4, F.concat(F.lit("not json: "), text))
        .when(fault == 5, F.concat(F.lit("[ "), turn.cast("string"), F.lit(" ]")))
        .otherwise(F.to_json(F.struct(turn, F.col("role"), text.alias("prompt"))))
    )
    asked = F.when(user, turn).when(assistant, turn - 1)
    asked = F.when(F.pmod(conv, F.lit(5)) == 1, asked - F.pmod(asked, F.lit(4))).otherwise(asked)
    lost = assistant & (F.pmod(conv, F.lit(5)) == 2) & (F.pmod(turn, F.lit(3)) == 0)
    needed = F.when((F.pmod(conv, F.lit(10)) == 4) & (F.pmod(turn, F.lit(4)) >= 2), turn - 2).otherwise(turn + 2)
    return turns.select(
        conv,
        turn,
        F.when(user, "call").when(assistant, "result").otherwise("text").alias("kind"),
        F.concat(F.when(lost, "lost-").otherwise("call-"), asked.cast("string")).alias("call_id"),
        F.when(user, F.when(fault == 3, "answer").otherwise("reply")).alias("name"),
        F.when(user, arguments).otherwise(text).alias("body"),
        F.when(user & (F.pmod(conv, F.lit(2)) == 0), F.concat(F.lit("call-"), needed.cast("string"))).alias("after"),
    )


def op9_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, from_turns(table(spark, sf_dir, "conversations")), REPLY)
