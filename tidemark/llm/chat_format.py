"""Chat formatting: link tool calls to results, order them, validate, write canonical JSON.

Native expressions only.  Calls (conv_id, turn, call_id, name, arguments as JSON text) and
results (conv_id, turn, call_id, content) are hash-joined by conversation and identifier.
A call may refer to an earlier call's result by an argument string ``"$<call id>"``; calls
are ordered topologically along these references: level 0 has none, a result is one level
above its call, a call one above the results it needs.  Chains of calls with one reference
each are settled by pointers that double, calls with several round by round; calls on a
cycle never settle.  Arguments are
checked against the tool's schema (types, required and unknown names).  Every message
becomes one JSON object with sorted names; nested arguments are sorted too.

One row per message: a conversation is never gathered, however long it is; its order is
(level, turn).  Defined results: the first call (by turn) of an identifier counts, later
ones are "duplicate"; likewise for results; a result without a call is "orphan", a call
without a result "open", with a reference that leads to no call "unresolved", on a cycle
or behind one "cyclic".  Null arguments are an empty object; arguments that are no JSON
object are invalid and written as a string.  Null identifiers never link, and neither do
rows of a null conversation: their calls are "open", their results "orphan".  Empty tables
give an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored, stored_at

# Argument types of the tools: name -> argument -> (type, required).
TOOLS = {
    "answer": {"prompt": ("string", True), "turn": ("long", True), "after": ("string", False)},
    "search": {"query": ("string", True), "limit": ("long", False)},
}
_TYPES = {
    "string": "^STRING$", "long": "^BIGINT$", "double": "^(DOUBLE|BIGINT|DECIMAL.*|FLOAT)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*", "object": "^OBJECT<.*",
}


def valid_arguments(name: Column, arguments: Column, tools: dict = TOOLS) -> Column:
    """Whether JSON ``arguments`` fit the schema of the tool ``name``."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    keys = F.json_object_keys(arguments)
    out = F.lit(False)
    for tool, fields in tools.items():
        fits = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in fields]))) == 0
        for field, (kind, required) in fields.items():
            there = F.array_contains(keys, field)
            typed = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant")).rlike(_TYPES[kind])
            fits = fits & F.when(there, F.coalesce(typed, F.lit(False))).otherwise(F.lit(not required))
        out = F.when(name == tool, is_object & F.coalesce(fits, F.lit(False))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical_arguments(arguments: Column) -> Column:
    """JSON text with sorted names and no spaces; what is no JSON object becomes a string."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    return F.when(arguments.isNull(), F.lit("{}")).when(is_object, F.to_json(parsed)).otherwise(json_string(arguments))


def json_string(text: Column) -> Column:
    """A JSON string, or ``null``."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def chain_tops(single: DataFrame) -> DataFrame:
    """conv_id, call_id, top, dist: where the chain of calls with one reference each ends, and how far.

    ``single`` has (conv_id, call_id, need_id).  Every row points ``dist`` calls up and takes
    over the pointer of the call it points to, so pointers double: a chain of n calls takes
    log2(n) rounds.  A pointer that has gone further than its conversation has such calls is
    on a cycle or behind one; it is dropped, and what points to it never gets a level.
    """
    spark = single.sparkSession
    sizes = single.groupBy("conv_id").agg(F.count("*").alias("most"))
    hops, path = stored_at(
        single.join(sizes, "conv_id").select("conv_id", "call_id", F.col("need_id").alias("top"), F.lit(1).cast("long").alias("dist"), "most"),
        "chat-hops",
    )
    while True:
        step = hops.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("dist").alias("more"))
        moved, new = stored_at(
            hops.join(step, ["conv_id", "top"], "left")
            .select(
                "conv_id", "call_id", F.coalesce("next", "top").alias("top"),
                (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), "most", F.col("next").isNotNull().alias("on"),
            )
            .where(F.col("dist") <= F.col("most")),
            "chat-hops",
        )
        discard(spark, path)
        hops, path = moved.drop("on"), new
        if moved.where("on").limit(1).count() == 0:
            return hops.drop("most")


def settle_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, call_id, level of every call whose references end; ``needs`` adds need_id.

    Chains of calls with one reference each are contracted first; then as many rounds settle
    the calls with several as the longest path has of these.
    """
    key = ["conv_id", "call_id"]
    done = stored(
        calls.join(needs, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "chat-levels"
    )
    counted = needs.groupBy(*key).agg(F.count("*").alias("n"), F.min("need_id").alias("need_id"))
    hops = chain_tops(counted.where("n = 1").select(*key, "need_id"))
    via = hops.select("conv_id", F.col("call_id").alias("need_id"), "top", "dist")
    several = needs.join(counted.where("n > 1").select(*key), key, "left_semi").join(via, ["conv_id", "need_id"], "left")
    pending = stored(
        several.select(
            *key, F.coalesce("top", "need_id").alias("need_id"), (2 * F.coalesce("dist", F.lit(0))).alias("extra"),
            F.lit(None).cast("long").alias("sofar"), F.lit(False).alias("met"),
        ),
        "chat-needs",
    )
    fresh = done
    while pending.limit(1).count():
        reached = fresh.select("conv_id", F.col("call_id").alias("need_id"), (F.col("level") + 2).alias("from"))
        # References met in this round leave; what a call has met so far stays on its rows.
        met = pending.join(reached, ["conv_id", "need_id"], "left")
        best = F.greatest("sofar", F.col("from") + F.col("extra"))
        state = stored(
            met.withColumn("sofar", best).withColumn("met", F.col("met") | F.col("from").isNotNull()).drop("from"),
            "chat-needs",
        )
        fresh = stored(
            state.groupBy(*key).agg(F.min("met").alias("all"), F.max("sofar").alias("level"))
            .where("all").select(*key, "level"),
            "chat-levels",
        )
        if fresh.limit(1).count() == 0:
            break
        done = done.union(fresh)
        pending = stored(state.join(fresh, key, "left_anti"), "chat-needs")
    tops = done.select("conv_id", F.col("call_id").alias("top"), "level")
    chained = hops.join(tops, ["conv_id", "top"]).select(*key, (F.col("level") + 2 * F.col("dist")).alias("level"))
    return stored(done.union(chained).withColumn("level", F.col("level").cast("int")), "chat-levels")


def link(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """conv_id, turn, kind, call_id, status, valid, level and json of every call and result."""
    key = ["conv_id", "call_id"]
    c = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments")
    r = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "content")
    first_call = c.where("call_id is not null").groupBy(*key).agg(F.min("turn").alias("call_turn"))
    first_result = r.where("call_id is not null").groupBy(*key).agg(F.min("turn").alias("result_turn"))
    ids = stored(first_call.join(first_result, key, "full"), "chat-ids")

    lead = c.join(ids, key).where("turn = call_turn")
    refs = F.array_distinct(F.regexp_extract_all("arguments", F.lit('"\\$([^"]+)"'), F.lit(1)))
    wants = lead.select(*key, F.explode(refs).alias("need_id")).distinct()
    known = ids.where("call_turn is not null").select("conv_id", F.col("call_id").alias("need_id"), F.lit(True).alias("known"))
    wants = stored(wants.join(known, ["conv_id", "need_id"], "left"), "chat-wants")
    lost = wants.where("known is null").select(*key).distinct().withColumn("lost", F.lit(True))
    needs = wants.where("known").select(
        *key, "need_id"
    )
    levels = settle_levels(ids.where("call_turn is not null"), needs)
    facts = ids.join(lost, key, "left").join(levels, key, "left")

    one = c.join(facts, key, "left")
    status = (
        F.when(F.col("call_turn").isNull(), F.lit("open"))
        .when(F.col("turn") > F.col("call_turn"), "duplicate")
        .when(F.col("lost"), "unresolved")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("result_turn").isNull(), "open")
        .otherwise("linked")
    )
    call_rows = one.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", status.alias("status"),
        valid_arguments(F.col("name"), F.coalesce("arguments", F.lit("{}")), tools).alias("valid"), "level",
        F.concat(
            F.lit('{"arguments":'), canonical_arguments(F.col("arguments")), F.lit(',"id":'), json_string(F.col("call_id")),
            F.lit(',"name":'), json_string(F.col("name")), F.lit(',"type":"call"}'),
        ).alias("json"),
    )
    two = r.join(facts, key, "left")
    status = (
        F.when(F.col("call_turn").isNull(), F.lit("orphan"))
        .when(F.col("turn") > F.col("result_turn"), "duplicate")
        .when(F.col("turn") <= F.col("call_turn"), "early")
        .otherwise("linked")
    )
    result_rows = two.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", status.alias("status"),
        F.lit(True).alias("valid"), (F.col("level") + 1).alias("level"),
        F.concat(
            F.lit('{"content":'), json_string(F.col("content")), F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"type":"result"}')
        ).alias("json"),
    )
    return call_rows.union(result_rows)


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of a plain conversation table.

    A user turn is a call of the tool ``answer`` that refers to the call two turns
    earlier; an assistant turn is the result of the turn before it.
    """
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.col("text").cast("string").alias("text"),
    )
    number = F.col("conv_id").cast("string")
    after = F.when(F.col("turn") >= 2, F.concat(F.lit("$"), number, F.lit("-"), (F.col("turn") - 2).cast("string")))
    calls = m.where("role = 'user'").select(
        "conv_id", "turn", F.concat(number, F.lit("-"), F.col("turn").cast("string")).alias("call_id"),
        F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"), after.alias("after"))).alias("arguments"),
    )
    results = m.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(number, F.lit("-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"),
    )
    others = m.where("role is null or role not in ('user', 'assistant')").select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit("plain").alias("status"), F.lit(True).alias("valid"), F.lit(0).alias("level"),
        F.concat(
            F.lit('{"content":'), json_string(F.col("text")), F.lit(',"role":'), json_string(F.col("role")), F.lit(',"type":"message"}')
        ).alias("json"),
    )
    return calls, results, others


def format_conversations(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row per message of ``messages`` (conv_id, turn, role, text)."""
    calls, results, others = from_conversations(messages)
    return link(calls, results, tools).union(others)
