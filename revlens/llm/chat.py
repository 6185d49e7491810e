"""Tool calls and their results in chats, with DataFrame functions alone.

Calls: conv_id, call_id, seq (place in the chat), name, arguments (JSON text), needs (ids of calls it builds on).
Results: conv_id, call_id, seq, content. Schemas: name, field, kind (a JSON type), required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import written

KEY = ["conv_id", "call_id"]


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their result (the first by place, then text), n_results and status; results without a call follow.

    Results are reduced to a row for each id first, so that ids that occur often cost no pairs of rows. A null
    content counts as an empty one; a call with a null id has no result.
    """
    one = results.groupBy(*KEY).agg(F.min(F.struct("seq", F.coalesce("content", F.lit("")).alias("content"))).alias("r"), F.count(F.lit(1)).alias("n_results"))
    one = one.select(*KEY, F.col("r.content").alias("result"), F.col("r.seq").alias("result_seq"), "n_results")
    joined = calls.join(one.hint("shuffle_hash"), KEY, "left")
    status = F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    answered = joined.withColumn("status", status).withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long"))).drop("result_seq")
    orphans = one.join(calls.select(*KEY).distinct(), KEY, "left_anti").withColumnRenamed("result_seq", "seq").withColumn("status", F.lit("orphan"))
    return answered.unionByName(orphans, allowMissingColumns=True)


def ordered(calls: DataFrame) -> DataFrame:
    """Calls with ``level``: by (level, seq) every call comes after those it needs. Null: it is part of a circle, or behind one.

    Places in the chat already are such an order unless a call needs a later one, so the level is the greatest number
    of such backward needs on a way along the needs. Where each call of a chat has one need at most, the ways are
    doubled in length until they end; in other chats, levels are raised round by round. Rounds are stored. Needs that
    no call of the chat answers to are left out. Calls that share an id stand together as one.
    """
    ids = calls.where(F.col("call_id").isNotNull()).groupBy(*KEY).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    needs = calls.select(*KEY, F.explode("needs").alias("need")).distinct()
    source = ids.select("conv_id", F.col("call_id").alias("need"), F.col("high").alias("need_seq"))
    edges = needs.join(source, ["conv_id", "need"]).join(ids.select(*KEY, "low"), KEY)
    edges = edges.select(*KEY, "need", (F.col("need_seq") >= F.col("low")).cast("int").alias("back"))
    bound = written(edges.where("back = 1").groupBy("conv_id").agg(F.count(F.lit(1)).alias("most")), "back")
    if bound.isEmpty():
        return calls.withColumn("level", F.lit(0))
    edges = written(edges.join(bound, "conv_id"), "needs")
    several = written(edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id").distinct(), "several")
    levels = _by_doubling(edges.join(several, "conv_id", "left_anti"))
    if not several.isEmpty():
        levels = levels.unionByName(_by_rounds(edges.join(several, "conv_id", "left_semi"), bound))
    placed = calls.join(levels.withColumn("seen", F.lit(True)), KEY, "left")
    return placed.withColumn("level", F.when(F.col("seen"), F.col("level")).otherwise(F.lit(0))).drop("seen")


def _by_doubling(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with one need each; after k rounds a way has 2 ** k needs, or has ended."""
    ways = written(edges.select(*KEY, F.col("need").alias("to"), F.col("back").alias("level")), "ways")
    longest = ways.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ended, reach = None, 1
    while True:
        ahead = ways if ended is None else ways.unionByName(ended)
        ahead = ahead.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        on = ways.join(ahead, ["conv_id", "to"], "left").select(*KEY, F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).cast("int").alias("level"))
        on = written(on, "ways")
        done = on.where("to is null")
        ended, ways = done if ended is None else written(ended.unionByName(done), "ended"), on.where("to is not null")
        reach *= 2
        if reach > 2 * longest or ways.isEmpty():
            # a way that is longer than its chat goes round a circle
            return ended.select(*KEY, "level").unionByName(ways.select(*KEY, F.lit(None).cast("int").alias("level")))


def _by_rounds(edges: DataFrame, bound: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that are not on level 0; each round is over the calls that the last one has raised."""
    levels = None
    raised = edges.where("back = 1").select(*KEY, F.lit(1).alias("level"), "most").distinct()
    while True:
        raised = written(raised, "raised")
        if raised.isEmpty():
            break
        own = raised.select(*KEY, "level")
        levels = written((own if levels is None else levels.unionByName(own)).groupBy(*KEY).agg(F.max("level").alias("level")), "levels")
        # A level above the number of backward needs is only reached round a circle.
        going = raised.where(F.col("level") <= F.col("most")).select("conv_id", F.col("call_id").alias("need"), "level")
        reached = going.join(edges, ["conv_id", "need"]).groupBy(*KEY).agg(F.max(F.col("level") + F.col("back")).alias("level"), F.max("most").alias("most"))
        known = levels.withColumnRenamed("level", "had")
        raised = reached.join(known, KEY, "left").where("had is null or level > had").select(*KEY, "level", "most")
    found = levels.join(bound, "conv_id").select(*KEY, F.when(F.col("level") <= F.col("most"), F.col("level")).alias("found"))
    circular = written(found.where("found is null").select(*KEY), "circular")
    behind = circular
    while not circular.isEmpty():  # whatever builds on a circle has no place either
        more = edges.join(behind.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select(*KEY).distinct().join(circular, KEY, "left_anti")
        behind = written(more, "behind")
        if behind.isEmpty():
            break
        circular = written(circular.unionByName(behind), "circular")
    placed = found.join(circular, KEY, "left_anti").select(*KEY, F.col("found").alias("level"))
    return placed.unionByName(circular.withColumn("level", F.lit(None).cast("int")))


def json_kind(value: Column) -> Column:
    """JSON type of a variant."""
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BIGINT", "integer").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
    other = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    return F.coalesce(number, other, F.lit("null"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with ``problems``, an array of texts in the order of field names, empty for valid arguments.

    Arguments must be one JSON object, in which no key occurs twice. An integer is a number too. A name without
    a schema has the single problem "unknown tool".
    """
    fields = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("field", "kind", "required"))).alias("fields"))  # a row for each tool
    own = calls.withColumn("parsed", F.try_parse_json("arguments"))
    whole = F.startswith(F.ltrim("arguments"), F.lit("{"))
    given = F.when(F.col("parsed").isNotNull() & whole, F.from_json("arguments", "map<string,variant>"))
    own = own.withColumn("given", given).join(fields, "name", "left")

    def problem(field: Column) -> Column:
        value = F.element_at(F.col("given"), field["field"])
        kind = json_kind(value)
        there = F.array_contains(F.map_keys("given"), field["field"])
        right = (kind == field["kind"]) | ((field["kind"] == "number") & (kind == "integer"))
        return F.when(~there & field["required"], F.concat(F.lit("missing "), field["field"])).when(there & ~right, F.concat(F.lit("kind of "), field["field"]))

    known = F.transform("fields", lambda x: x["field"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys("given"), known)), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.filter(F.transform("fields", problem), lambda x: x.isNotNull()), extra)
    problems = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("no JSON object"))).otherwise(found)
    return own.withColumn("problems", problems).drop("parsed", "given", "fields")


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def formatted(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each call, and for each result without one: conv_id, call_id, seq, level, name, status, n_results, problems, json.

    ``json`` is the canonical record of call and result; arguments that are no JSON stay text in it. Read in the
    order (conv_id, level, seq) it is the chat's tool log; chats are never gathered in one row.
    """
    cols = ["conv_id", "call_id", "seq", "name", "arguments", "needs"]
    checked = validated(ordered(calls.select(*cols)), schemas)
    rows = linked(checked, results.select("conv_id", "call_id", "seq", "content"))
    arguments = F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(_quoted(F.col("arguments"))))
    record = F.to_json(F.struct(arguments.alias("arguments"), "call_id", "conv_id", "name", "result"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "call_id", "seq", "level", "name", "status", "n_results", F.coalesce(F.array_join("problems", "; "), F.lit("")).alias("problems"), record.alias("json"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    inner = F.to_json(F.struct(text.alias("x")))
    return F.regexp_extract(inner, r"(?s)^\{\"x\":(.*)\}$", 1)


#: Turns as tool calls: what a user says asks the assistant to reply, a system turn configures it.
TOOLS = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True), ("configure", "prompt", "string", True), ("configure", "turn", "integer", False)]
#: Of KINDS remainders of crc32 of 'conv_id:turn': calls that need nothing, the call two or four turns later, or
#: themselves (others: the one two turns before); arguments without a prompt, with a turn as text, with one field more;
#: calls of a tool that there is not.
KINDS = 12
NO_NEED, NEEDS_NEXT, NEEDS_FAR, NEEDS_SELF = (0, 1), 7, 8, 9
NO_PROMPT, TEXT_TURN, EXTRA, NO_TOOL = 3, 4, 5, 6


def turn_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from a table of turns (conv_id, turn, role, text).

    A user's or system's turn t is call c<t>; an assistant's turn answers the call one turn before. Other roles are
    left out; a null text stays a null argument. What a call needs, and how its arguments are wrong, follows from a
    checksum of its place, so that needs of later calls, circles, missing fields and wrong kinds all occur.
    """
    turn = F.col("turn").cast("long")
    kind = F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), F.lit(KINDS))
    asked = turns.where(F.col("role").isin("user", "system")).select("conv_id", turn.alias("turn"), "role", "text", kind.alias("kind"))
    turn, kind = F.col("turn"), F.col("kind")
    shapes = {NO_PROMPT: [turn], TEXT_TURN: [F.col("text").alias("prompt"), turn.cast("string").alias("turn")], EXTRA: [F.col("text").alias("prompt"), turn, F.lit(1).alias("note")]}
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), turn), {"ignoreNullFields": "false"})
    for k, fields in shapes.items():
        arguments = F.when(kind == k, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).otherwise(arguments)
    other = F.when(kind == NEEDS_NEXT, turn + 2).when(kind == NEEDS_FAR, turn + 4).when(kind == NEEDS_SELF, turn).otherwise(turn - 2)
    needs = F.when(kind.isin(*NO_NEED), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), other.cast("string"))))
    name = F.when(kind == NO_TOOL, "search").when(F.col("role") == "user", "reply").otherwise("configure")
    calls = asked.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), turn.alias("seq"),
        name.alias("name"), arguments.alias("arguments"), needs.alias("needs"),
    )
    answers, turn = turns.where(F.col("role") == "assistant"), F.col("turn").cast("long")
    results = answers.select(F.col("conv_id").cast("long").alias("conv_id"), F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results
