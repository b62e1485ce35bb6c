"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Input is one event a row: conv, pos (an order that readers saw), kind (``message``, ``call`` or
``result``), id (of a call, or of the call that a result answers), parent (the id of a call of the
same conversation that must come before, or null), name and args (a call's tool and JSON object),
text (of a message or result).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .common import ranked, remove, scratch, stored

#: Positions that one task ranks, on average; a long conversation is spread over several.
SPAN = 4096


def json_string(x: Column) -> Column:
    """A JSON string literal in canonical form: only quote, backslash and control characters are escaped."""
    whole = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def canonical(pairs: Mapping[str, Column]) -> Column:
    """A JSON object with sorted keys and no blanks; values are JSON texts, nulls are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), pairs[k]) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def canonical_args(args: Column, schema: Mapping[str, str]) -> Column:
    """The arguments that a schema names, as canonical JSON: strings as strings, the rest as they are written."""
    return canonical({name: F.when(F.get_json_object(args, f"$.{name}").isNotNull(), json_string(F.get_json_object(args, f"$.{name}")) if kind.startswith("string") else F.get_json_object(args, f"$.{name}")) for name, kind in schema.items()})


def problem(name: Column, args: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """Null for arguments that fit their tool's schema, else what is wrong.

    A schema maps argument names to ``string``, ``integer``, ``number`` or ``boolean``, with ``?``
    at the end if the argument may be missing. Types are those of JSON: "2" is no integer, 5 and
    {"x":1} are no strings, 2.0 is no integer; null counts as missing. Other arguments are wrong, and so is JSON
    that names one twice (not an object).
    """
    parsed = F.try_parse_json(args)
    out = F.lit("unknown tool")
    for tool, schema in schemas.items():
        said = F.lit(None).cast("string")
        for field in sorted(schema, reverse=True):
            kind, may_miss = schema[field].rstrip("?"), schema[field].endswith("?")
            value = F.get_json_object(args, f"$.{field}")
            typed = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            whole = F.regexp_like(typed, F.lit("^(BIGINT|DECIMAL)")) & F.regexp_like(value, F.lit("^-?[0-9]+$"))
            fits = {"string": typed == "STRING", "integer": whole, "number": F.regexp_like(typed, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), "boolean": typed == "BOOLEAN"}[kind]
            said = F.when(value.isNull(), said if may_miss else F.lit(f"missing: {field}")).when(~F.coalesce(fits, F.lit(False)), F.lit(f"not {kind}: {field}")).otherwise(said)
        extra = F.array_except(F.json_object_keys(args), F.array(*[F.lit(x) for x in sorted(schema)]).cast("array<string>"))
        said = F.when(parsed.isNull() | F.json_object_keys(args).isNull(), F.lit("not an object")).when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_min(extra))).otherwise(said)
        out = F.when(name == tool, said).otherwise(out)
    return out


def link(events: DataFrame) -> DataFrame:
    """Adds call_pos (a result's call, by hash join on conversation and id), and orphan, answers to events.

    A result without a call is an orphan; of several calls with one id the first counts; answers is
    the number of results of a call.
    """
    calls = events.where("kind = 'call' AND id IS NOT NULL").groupBy(F.col("conv").alias("c"), F.col("id").alias("i")).agg(F.min("pos").alias("call_pos"))
    results = events.where("kind = 'result' AND id IS NOT NULL").groupBy(F.col("conv").alias("rc"), F.col("id").alias("ri")).agg(F.count("*").alias("answers"))
    need = F.when(F.col("kind") == "result", F.col("id"))
    out = events.withColumn("need", need).join(calls, F.col("conv").eqNullSafe(F.col("c")) & (F.col("need") == F.col("i")), "left").drop("c", "i", "need")
    own = F.when(F.col("kind") == "call", F.col("id"))
    out = out.withColumn("need", own).join(results, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("need") == F.col("ri")), "left").drop("rc", "ri", "need")
    return out.withColumn("orphan", (F.col("kind") == "result") & F.col("call_pos").isNull()).withColumn("answers", F.when(F.col("kind") == "call", F.coalesce("answers", F.lit(0))))


def levels(linked: DataFrame) -> DataFrame:
    """Adds level: 0, but for events that stand before what they depend on, which follow it.

    An event depends on its call (a result) or parent (a call); of several calls with one id the
    first counts. Where every event stands after that, the position is a topological order already
    and nothing moves. Else an event has the level of what it waits for, and one more if it stands
    before that: the number of steps backwards on its chain, summed by pointer doubling over the
    conversations that have one. Events in a cycle get level -1, and so does what depends on them.
    """
    spark = linked.sparkSession
    path = scratch(spark, "chat-levels")
    events = stored(linked.withColumn("dep", F.coalesce("call_key", "parent")), f"{path}/events")
    calls = events.where("kind = 'call' AND id IS NOT NULL").groupBy(F.col("conv").alias("c"), F.col("id").alias("i")).agg(F.min(F.struct("pos", "parent")).alias("own"))
    calls = stored(calls.select("c", "i", F.col("own.pos").alias("at"), F.col("own.parent").alias("up")), f"{path}/calls")
    behind = F.struct("pos") <= F.struct(F.col("at").alias("pos"))
    late = events.where("dep IS NOT NULL").join(calls.drop("up"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("dep") == F.col("i"))).where(behind)
    late = stored(late.select(F.col("conv").alias("h")).distinct(), f"{path}/late")
    if not late.limit(1).count():
        return events.drop("dep").withColumn("level", F.lit(0))
    calls = calls.join(late, F.col("c").eqNullSafe(F.col("h")), "left_semi")
    before = calls.select(F.col("c").alias("bc"), F.col("i").alias("bi"), F.col("at").alias("b_at"))
    back = F.struct(F.col("at").alias("pos")) <= F.struct(F.col("b_at").alias("pos"))
    steps = calls.join(before, F.col("c").eqNullSafe(F.col("bc")) & (F.col("up") == F.col("bi")), "left")
    steps = stored(steps.select("c", "i", "at", F.col("bi").alias("up"), F.when(F.col("bi").isNotNull() & back, 1).otherwise(0).alias("n")), f"{path}/0")
    longest = steps.groupBy("c").count().agg(F.max("count")).first()[0]
    # after k rounds a pointer has passed 2**k calls; one that has passed all of a conversation and still points on is in a cycle
    for k in range(1, int(longest).bit_length() + 1):
        if not steps.where("up IS NOT NULL").limit(1).count():
            break
        above = steps.select(F.col("c").alias("ac"), F.col("i").alias("ai"), F.col("up").alias("further"), F.col("n").alias("more"))
        steps = steps.join(above, F.col("c").eqNullSafe(F.col("ac")) & (F.col("up") == F.col("ai")), "left")
        steps = stored(steps.select("c", "i", "at", F.col("further").alias("up"), F.when(F.col("ai").isNull(), F.col("n")).otherwise(F.least(F.col("n") + F.col("more"), F.lit(2**30))).alias("n")), f"{path}/{k}")
        remove(spark, f"{path}/{k - 1}")
    out = events.join(steps, F.col("conv").eqNullSafe(F.col("c")) & (F.col("dep") == F.col("i")), "left")
    level = F.when(F.col("n").isNull(), 0).when(F.col("up").isNotNull(), -1).otherwise(F.col("n") + behind.cast("int"))
    return out.withColumn("level", level).drop("dep", "c", "i", "at", "up", "n")


def format_chats(events: DataFrame, schemas: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One row per event: conv, pos, kind, id, place, level, call_pos, orphan, answers, problem, json.

    place: 0, 1, ... in each conversation, in topological order (level, then position). json: the
    event as canonical JSON. A null conversation is one of its own; null and empty texts are kept as null and
    empty strings; events of one position come in the order of kind, id and text; equal events stay
    separate rows. An empty table gives an empty result; other columns are dropped.
    """
    spark = events.sparkSession
    names = ["conv", "pos", "kind", "id", "parent", "name", "args", "text"]
    order = [F.col(c).asc_nulls_first() for c in ("level", "pos", "kind", "id", "text", "args")]
    rows = events.select(*names).withColumn("row", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names]))
    linked = link(stored(rows, scratch(spark, "chat-events"))).withColumn("call_key", F.when((F.col("kind") == "result") & ~F.col("orphan"), F.col("id")))
    placed = levels(linked).withColumn("part", F.struct("level", F.floor(F.col("pos") / SPAN)))
    placed = ranked(placed, ["conv"], "part", order, "place")
    said = F.when(F.col("kind") == "call", problem(F.col("name"), F.col("args"), schemas)).when(F.col("orphan"), F.lit("no call"))
    args = F.lit(None).cast("string")
    for tool, schema in schemas.items():
        args = F.when(F.col("name") == tool, canonical_args(F.col("args"), schema)).otherwise(args)
    text = json_string(F.col("text"))
    whole = {
        "arguments": F.when((F.col("kind") == "call") & F.col("problem").isNull(), args),
        "content": F.when(F.col("kind") != "call", F.coalesce(text, F.lit("null"))),
        "id": F.when(F.col("kind") != "message", json_string(F.col("id"))),
        "name": F.when(F.col("kind") == "call", json_string(F.col("name"))),
        "type": json_string(F.col("kind")),
    }
    placed = placed.withColumn("problem", said).withColumn("json", canonical(whole))
    return placed.select("conv", "pos", "kind", "id", "place", "level", "call_pos", "orphan", "answers", "problem", "json")


#: The tool that a user's turn calls in ``from_turns``.
TURN_SCHEMAS = {"reply": {"prompt": "string", "turn": "integer"}}


def from_turns(turns: DataFrame) -> DataFrame:
    """Events of a table (conv_id, turn, role, text) of plain chats: a user's turn is a call of the tool
    ``reply``, the assistant's next turn its result; each call depends on the one before it."""
    conv, turn = F.col("conv_id"), F.col("turn")
    own = F.concat_ws(":", conv.cast("string"), turn.cast("string"))
    back = F.concat_ws(":", conv.cast("string"), (turn - 1).cast("string"))
    early = F.concat_ws(":", conv.cast("string"), (turn - 2).cast("string"))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    args = canonical({"prompt": F.coalesce(json_string(F.col("text")), F.lit("null")), "turn": F.coalesce(turn.cast("string"), F.lit("null"))})
    return turns.select(
        conv.alias("conv"), turn.alias("pos"), kind.alias("kind"),
        F.when(kind == "call", own).when(kind == "result", back).alias("id"),
        F.when(kind == "call", early).alias("parent"),
        F.when(kind == "call", F.lit("reply")).alias("name"),
        F.when(kind == "call", args).alias("args"),
        F.when(kind != "call", F.col("text")).alias("text"),
    )
