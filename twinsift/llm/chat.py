"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

Calls and results meet in an equi-join on (conversation, identifier). A turn comes at its own place unless what it
needs comes later: then at the place of the last of that, after it. Where no call needs a later turn the order is that
of the turns. Otherwise calls that need one other are first tied over their chains by pointer doubling, in rounds that follow the
logarithm of the longest chain; calls with several needs are then placed in rounds, those first whose needs are all
placed, each round on what is still open. What is left is in a circle, or needs one.

Texts and arguments are written once, in buckets of the rows' keys; links and order are found on narrow rows, whose
place then meets the texts where they lie. No conversation is gathered in one row or task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch, numbered

#: What a message has, besides whatever else its table holds.
COLUMNS = {"conv_id": None, "turn": "long", "role": "string", "text": "string", "kind": "string", "call_id": "string", "name": "string", "arguments": "string", "after": "array<string>"}
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"
#: What schema_of_variant says of a value of each type.
TYPES = {"string": "^STRING$", "integer": _NUMBER, "number": _NUMBER, "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}
#: Stand for an escaped backslash and an escaped quote while a text is split at its quotes; JSON never holds them bare.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def plain_number(number: Column) -> Column:
    """A JSON number written out: no exponent, no zeros that say nothing, no minus before zero. Equal numbers read alike."""
    return let(number, lambda t: F.when(t.rlike("^(0|-?[1-9][0-9]*)$"), t).otherwise(_written_out(t)))


def _written_out(t: Column) -> Column:
    lower = F.lower(t)
    exponent = F.coalesce(F.split_part(lower, F.lit("e"), F.lit(2)).try_cast("int"), F.lit(0))
    mantissa = F.ltrim(F.split_part(lower, F.lit("e"), F.lit(1)), F.lit("-"))
    before, after = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.concat(before, after)
    point = F.length(before) + exponent
    padded = F.rpad(F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), -point)), digits), F.greatest(point, F.length(digits) + F.greatest(F.lit(0), -point)), "0")
    whole = F.ltrim(F.substr(padded, F.lit(1), F.greatest(point, F.lit(0))), F.lit("0"))
    rest = F.rtrim(F.substr(padded, F.greatest(point, F.lit(0)) + 1), F.lit("0"))
    out = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    return F.when(t.startswith("-") & (out != "0"), F.concat(F.lit("-"), out)).otherwise(out)


def canonical_json(v: Column) -> Column:
    """A variant as JSON without white space: keys in order, numbers written out."""
    held = F.replace(F.replace(F.to_json(v), F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def numbers(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit("([0-9.eE+-]+|[^0-9.eE+-]+)"), F.lit(1))
        return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), plain_number(t)).otherwise(t)), "")

    # every other part lies between quotes, as it stands
    parts = F.transform(F.split(held, '"', -1), lambda p, i: F.when(i % 2 == 0, numbers(p)).otherwise(p))
    text = F.array_join(parts, '"')
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def conforms(v: Column, schema: str | dict) -> Column:
    """Whether a variant fits a schema: a type's name, or a dict with type (one or several), enum, minimum, maximum, min_length,
    max_length, items (of arrays, with min_items and max_items), and properties, required and additional (of objects).

    A number without a fraction is an integer however it is written. Objects hold no other keys than their
    properties unless ``additional`` is true; a schema without properties says nothing about keys.
    """
    return let(v, lambda x: _conforms(x, {"type": schema} if isinstance(schema, str) else schema))


def _conforms(v: Column, of: dict) -> Column:
    kinds = [of["type"]] if isinstance(of["type"], str) else list(of["type"])
    kind = F.schema_of_variant(v)
    text = F.to_json(v)

    def fits(name: str) -> Column:
        ok = kind.rlike(TYPES[name])
        if name in ("integer", "number"):
            if name == "integer":
                ok = ok & ~F.contains(plain_number(text), F.lit("."))
            number = F.when(kind.rlike(_NUMBER), text.try_cast("double"))
            for bound, op in (("minimum", number.__ge__), ("maximum", number.__le__)):
                ok = ok & op(float(of[bound])) if bound in of else ok
        if name == "string" and of.keys() & {"min_length", "max_length"}:
            ok = ok & F.length(v.try_cast("string")).between(of.get("min_length", 0), of.get("max_length", 1 << 31))
        if name == "array" and of.keys() & {"items", "min_items", "max_items"}:
            held = F.when(kind.startswith("ARRAY<"), v.try_cast("array<variant>"))
            ok = ok & F.size(held).between(of.get("min_items", 0), of.get("max_items", 1 << 31))
            if "items" in of:
                ok = ok & F.forall(held, lambda x: F.coalesce(conforms(x, of["items"]), F.lit(False)))
        if name == "object" and "properties" in of:
            ok = ok & let(F.when(kind.startswith("OBJECT<"), v.try_cast("map<string,variant>")), lambda held: properties_fit(held, of))
        return F.coalesce(ok, F.lit(False))

    out = reduce(lambda a, b: a | b, map(fits, kinds))
    if "enum" in of:
        import json

        given = F.array(*(F.lit(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for x in of["enum"]))
        out = out & F.array_contains(F.transform(given, lambda x: canonical_json(F.parse_json(x))), canonical_json(v))
    return out


def properties_fit(held: Column, of: dict) -> Column:
    """Whether the values by key of an object fit its schema's properties."""
    ok = held.isNotNull()
    if not of.get("additional", False):
        ok = ok & (F.size(F.array_except(F.map_keys(held), F.array(*map(F.lit, of["properties"])).cast("array<string>"))) == 0)
    for key, inner in of["properties"].items():
        needed = key in of.get("required", ())
        ok = ok & F.when(F.map_contains_key(held, key), F.coalesce(conforms(held[key], inner), F.lit(False))).otherwise(F.lit(not needed))
    return ok


def arguments_fit(name: Column, v: Column, tools: dict[str, dict]) -> Column:
    """Whether ``v`` is an object with every required argument of the tool, each of its schema, and no other argument."""
    fits = F.lit(False)
    for tool, args in tools.items():  # only the branch of a call's own tool is worked out
        schema = {"type": "object", "properties": {a: of for a, (of, _) in args.items()}, "required": [a for a, (_, needed) in args.items() if needed]}
        fits = F.when(name == tool, conforms(v, schema)).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def chains(scratch: Scratch, nodes: DataFrame, edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(key, to, steps, most) of every node with one need: the end of its chain, a node that has no or several needs, the steps to it,
    and the latest turn on the way. Those that lead into a circle don't appear."""
    last = nodes.select(F.col("key").alias("to"), F.col("last").alias("most"))
    one = edges.groupBy("key").agg(F.count("*").alias("n"), F.min("need").alias("to")).where("n = 1")
    now = scratch.write(one.join(last, "to").select("key", "to", F.lit(1).cast("long").alias("steps"), "most", F.lit(True).alias("open")))
    size, turn = now.count(), 0
    while True:
        onward = now.select(F.col("key").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("most").alias("_most"))
        joined = now.join(onward, "to", "left")
        met = F.col("_to").isNotNull()
        after = scratch.write(
            joined.select("key", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.greatest("most", "_most").alias("most"), met.alias("open"))
        )
        scratch.drop(now)
        now, turn = after, turn + 1
        if rounds is not None:
            rounds.append(size)
        # a chain has fewer steps than there are nodes: what is still open after that many is in a circle
        if (1 << turn) > 2 * size or now.where("open").isEmpty():
            return now.where("NOT open").drop("open")


def placed(scratch: Scratch, nodes: DataFrame, edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(key, eff, level) of every node (key, turn, last) that is in no circle of ``edges`` (key, need), nor needs one.

    ``last`` is the later of a node's turn and its result's; ``eff`` the latest of its own turn and of all that it
    needs, near or far; ``level`` the most steps to a node that needs nothing. ``rounds`` gets an entry per round.
    """
    at = nodes.select(F.col("key").alias("need"), F.col("last").alias("_last"))
    late = edges.join(nodes, "key").join(at, "need").where("_last >= turn")
    if late.isEmpty():
        return nodes.select("key", F.col("turn").alias("eff"), F.lit(0).cast("long").alias("level"))
    tied = scratch.write(chains(scratch, nodes, edges, rounds))
    counts = edges.groupBy("key").count()
    ones = counts.where("count = 1").select(F.col("key").alias("need"), F.lit(True).alias("tied"))
    over = tied.select(F.col("key").alias("need"), "to", "steps", "most")
    # what a node with several needs waits for: the ends of their chains; -1 stands for a circle
    root = F.when(F.coalesce("tied", F.lit(False)) & F.col("to").isNull(), F.lit(-1)).otherwise(F.coalesce("to", "need"))
    several = edges.join(counts.where("count > 1"), "key", "left_semi").join(at, "need").join(ones, "need", "left").join(over, "need", "left")
    waiting = several.select("key", root.alias("root"), (F.coalesce("steps", F.lit(0)) + 1).alias("level"), F.greatest("_last", "most").alias("far"))
    new = scratch.write(nodes.join(edges, "key", "left_anti").select("key", F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("far")))
    done = [new]
    waiting = scratch.write(waiting)
    while not waiting.isEmpty():
        found = new.select(F.col("key").alias("root"), F.col("level").alias("_level"), F.col("far").alias("_far"), F.lit(True).alias("_met"))
        met = F.coalesce("_met", F.lit(False))
        step = waiting.join(found, "root", "left").select(
            "key", F.when(~met, F.col("root")).alias("root"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), F.greatest("far", "_far").alias("far")
        )
        held = scratch.write(step.groupBy("key", "root").agg(F.max("level").alias("level"), F.max("far").alias("far")))
        blocked = held.where("root IS NOT NULL").select("key").distinct()
        new = scratch.write(held.join(blocked, "key", "left_anti").select("key", "level", "far"))
        if rounds is not None:
            rounds.append(None)
        if new.isEmpty():
            break
        done.append(new)
        scratch.drop(waiting)
        waiting = scratch.write(held.join(blocked, "key", "left_semi"))
        scratch.drop(held)
    free = scratch.write(reduce(DataFrame.unionByName, done))
    ends = free.select(F.col("key").alias("to"), F.col("level").alias("_level"), F.col("far").alias("_far"))
    chained = tied.join(ends, "to").select("key", (F.col("steps") + F.col("_level")).alias("level"), F.greatest("most", "_far").alias("far"))
    return nodes.join(free.unionByName(chained), "key").select("key", F.greatest("turn", "far").alias("eff"), "level")


def format_chats(messages: DataFrame, tools: dict[str, dict], scratch: Scratch | None = None) -> DataFrame:
    """Per message: row (its place from 0 among all, conversations one after another), conv_id, turn, kind, call_id,
    status, json.

    Messages have conv_id, turn, role, text, kind (call, result or anything else), call_id, name, arguments (JSON
    text), after (identifiers of the calls that a call needs); other columns, whatever their names, aren't read. ``tools`` gives
    each tool's arguments: name to (type or schema as of ``conforms``,
    required). A call's status is the first of unidentified (it has no identifier), duplicate (an earlier call of its
    conversation has it), missing_need, circle, unknown_tool, bad_arguments, unanswered and ok; a result's is orphan,
    repeated (the call has an earlier result) or ok; other messages' is ok. Messages whose turn is null come first.
    Every message gives one row, in no order of rows, and what can't be linked stays in the order of turns. Arguments that aren't JSON
    stand as a string; numbers beyond 38 digits or with an exponent are doubles. An empty table gives no rows. The
    tables of texts and of places stay until the application ends, as the result reads them.
    """
    spark = messages.sparkSession
    scratch = scratch or Scratch(spark)
    given = messages.select(*(F.col(c).cast(kind).alias(c) if kind else F.col(c) for c, kind in COLUMNS.items()), F.monotonically_increasing_id().alias("key"))
    held = scratch.write_bucketed(given, "key", int(spark.conf.get("spark.sql.shuffle.partitions")))
    parsed = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    call, result = F.coalesce(F.col("kind") == "call", F.lit(False)), F.coalesce(F.col("kind") == "result", F.lit(False))
    known_tool = F.coalesce(F.col("name").isin(list(tools)), F.lit(False))
    wrong = F.when(~call, None).when(~known_tool, "unknown_tool").when(~arguments_fit(F.col("name"), parsed, tools), "bad_arguments")
    turn = F.coalesce("turn", F.lit(-(1 << 62)))
    rows = scratch.write(held.select("key", "conv_id", turn.alias("turn"), "kind", "call_id", wrong.alias("wrong"), F.when(call, F.col("after")).alias("after")))

    linkable = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    of = lambda kind, name: linkable.where(F.col("kind") == kind).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "key")).alias(name))
    ids = scratch.write(of("call", "c").join(of("result", "r"), ["conv_id", "call_id"], "full"))
    calls = rows.where("kind = 'call'").join(ids, ["conv_id", "call_id"]).where("c.key = key")
    nodes = scratch.write(calls.select("key", "turn", F.greatest("turn", "r.turn").alias("last")))
    needed = calls.select("key", "conv_id", F.explode(F.array_distinct("after")).alias("call_id"))
    known = ids.where("c IS NOT NULL").select("conv_id", "call_id", F.col("c.key").alias("need"))
    edges = scratch.write(needed.join(known, ["conv_id", "call_id"], "left").select("key", "need"))
    missing = edges.where("need IS NULL").select(F.col("key").alias("_k")).distinct().withColumn("lacks", F.lit(True))
    order = scratch.write(placed(scratch, nodes, edges.where("need IS NOT NULL")))
    linked = ids.join(order.withColumnRenamed("key", "_k"), F.col("c.key") == F.col("_k"), "left").drop("_k")
    linked = scratch.write(linked.join(missing, F.col("c.key") == F.col("_k"), "left").drop("_k"))

    rows = rows.drop("after")
    bare = rows.where("conv_id IS NULL OR call_id IS NULL OR kind IS NULL OR kind NOT IN ('call', 'result')")
    met = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL AND kind IN ('call', 'result')").join(linked, ["conv_id", "call_id"])
    blank = [F.lit(None).cast(linked.schema[c].dataType).alias(c) for c in ("c", "r", "eff", "level", "lacks")]
    all_rows = met.unionByName(bare.select("*", *blank))

    first = F.coalesce(F.col("c.key") == F.col("key"), F.lit(False))
    status = (
        F.when(call & F.col("c").isNull(), "unidentified")
        .when(call & ~first, "duplicate")
        .when(call & F.coalesce("lacks", F.lit(False)), "missing_need")
        .when(call & F.col("level").isNull(), "circle")
        .when(call & F.col("wrong").isNotNull(), F.col("wrong"))
        .when(call & F.col("r").isNull(), "unanswered")
        .when(result & F.col("c").isNull(), "orphan")
        .when(result & (F.col("r.key") != F.col("key")), "repeated")
        .otherwise("ok")
    )
    placed_at = F.when((call & first) | result, F.greatest("turn", "eff")).otherwise(F.col("turn"))
    depth = F.when(call & first, 2 * F.coalesce("level", F.lit(0))).when(result, 2 * F.coalesce("level", F.lit(0)) + 1).otherwise(0)
    shaped = all_rows.select("key", "conv_id", "turn", status.alias("status"), placed_at.alias("_at"), depth.alias("_depth"))
    places = scratch.write(numbered(scratch, shaped, "conv_id", "_at", "_depth", "turn", "key").select(F.col("key").alias("_key"), "row", "status"))
    scratch.drop(rows, ids, nodes, edges, order, linked)

    kept = {"ignoreNullFields": "false"}
    head = F.when(call, F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(parsed), F.lit("null")), F.lit(","))).otherwise("{")
    other = F.when(call, F.to_json(F.struct("call_id", "name", "role", "text"), kept)).when(result, F.to_json(F.struct("call_id", "role", "text"), kept)).otherwise(F.to_json(F.struct("role", "text"), kept))
    texts = held.join(places, F.col("key") == F.col("_key"))
    return texts.select("row", "conv_id", "turn", "kind", "call_id", "status", F.concat(head, F.substr(other, F.lit(2))).alias("json"))
