"""Operator 2, chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextkit.llm._common import settle, table

CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
RESULT = r"(?s)<tool_result>\s*(\{.*?\})\s*</tool_result>"
#: Of each tool: its properties with type and whether they are required.
SCHEMAS = {"respond": {"prompt": ("string", True), "turn": ("integer", True)}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def implicit_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table without tool blocks.

    A user turn calls the tool respond with its text; the assistant turn right
    after it is the result; it depends on the user turn two turns before.
    """
    name = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")))
    calls = known.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("respond").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"))
    results = known.where("role = 'assistant'").select("conv_id", F.col("turn").alias("result_turn"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))
    return calls, results


def explicit_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in <tool_call> and <tool_result> blocks, each a JSON object.

    A call has id, name, arguments and perhaps after, the identifiers that it
    depends on; a result has id and content.
    """
    block = lambda pattern: messages.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("j"))
    part = lambda key: F.get_json_object("j", f"$.{key}")
    calls = block(CALL).select("conv_id", "turn", part("id").alias("call_id"), part("name").alias("name"), part("arguments").alias("arguments"), F.from_json(part("after"), "array<string>").alias("after"))
    results = block(RESULT).select("conv_id", F.col("turn").alias("result_turn"), part("id").alias("call_id"), part("content").alias("result"))
    return calls, results


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, steps, open): how far back a call's chain of single dependencies goes, and to which call.

    An anchor has no dependency, or several.  Pointers double each round, so
    rounds grow with the logarithm of the longest chain.  Calls that stay open
    lead into a cycle: once a round closes none, no later round does.
    """
    single = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("before").alias("before"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    at = nodes.join(single, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(one, F.col("before")).otherwise(F.col("call_id")).alias("anchor"), one.cast("long").alias("steps"), one.alias("open"))
    at = settle(at)
    left = at.where("open").count()
    while left:
        ahead = at.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("further"), F.col("steps").alias("more"), F.col("open").alias("still"))
        jumped = at.where("open").join(ahead, ["conv_id", "anchor"]).select("conv_id", "call_id", F.col("further").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        at, before = settle(at.where("NOT open").unionByName(jumped)), left
        left = at.where("open").count()
        if left == before:
            break
    return at


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the highest of them.

    Dependencies that are no call of the conversation do not hold a call back.
    Calls on a cycle, and those that depend on one, are not in the result.
    Chains of single dependencies are measured by doubling; the rounds after
    that are as many as calls with several dependencies follow one another.
    """
    nodes = calls.where("call_id IS NOT NULL").select("conv_id", "call_id").distinct()
    edges = calls.where("call_id IS NOT NULL").select("conv_id", "call_id", F.explode("after").alias("before")).distinct()
    edges = settle(edges.join(nodes.withColumnRenamed("call_id", "before"), ["conv_id", "before"]))
    at = chains(nodes, edges)
    closed = at.where("NOT open")
    several = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("open")).where("open > 1")
    waiting = settle(several.withColumn("level", F.lit(0).cast("long")))
    joints = edges.join(waiting, ["conv_id", "call_id"], "left_semi").join(closed.select("conv_id", F.col("call_id").alias("before"), "anchor", "steps"), ["conv_id", "before"])
    joints = settle(joints.select("conv_id", "call_id", "anchor", (F.col("steps") + 1).alias("far")))
    ready = settle(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    done = ready
    while not waiting.isEmpty() and not ready.isEmpty():
        near = ready.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base"))
        met = joints.join(near, ["conv_id", "anchor"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"), F.max(F.col("base") + F.col("far")).alias("high"))
        now = settle(waiting.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", "high").alias("level")))
        ready, waiting = now.where("open = 0").select("conv_id", "call_id", "level"), now.where("open > 0")
        done = done.unionByName(ready)
    heads = done.withColumnsRenamed({"call_id": "anchor", "level": "base"})
    return closed.join(heads, ["conv_id", "anchor"]).select("conv_id", "call_id", (F.col("base") + F.col("steps")).cast("int").alias("level"))


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments: a list of words, empty if they fit the tool's schema."""
    kind = lambda key: F.schema_of_variant(F.variant_get(arguments, f"$.{key}", "variant"))
    out = F.array(F.lit("unknown tool"))
    for tool, properties in schemas.items():
        found = []
        for key, (wanted, required) in properties.items():
            have = kind(key)
            missing = have.isNull() | (have == "VOID")
            wrong = F.when(missing, F.lit(f"{key} is missing") if required else F.lit(None)).when(~have.startswith(_TYPES[wanted]), f"{key} is not {wanted}")
            found.append(wrong)
        found.append(F.when(~F.schema_of_variant(arguments).startswith("OBJECT"), "not an object"))
        out = F.when(name == tool, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(out)
    return F.when(arguments.isNull(), F.array(F.lit("not JSON"))).otherwise(out)


def left_over(messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, item) of what is neither a call nor the result of one.

    Turns that are neither user's nor assistant's, whole; results without a
    call (orphan), and all but the first of a call (repeated).  turn and
    call_id name the call whose row holds the item: the next one of the
    conversation, or the last if none follows; they are null if it has none.
    Turns without conv_id or turn are left out, as in implicit_calls.
    """
    item = lambda kind, name, role, text, turn: F.struct(turn.alias("turn"), kind.alias("kind"), role.alias("role"), name.alias("id"), text.alias("text"))
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND coalesce(role, '') NOT IN ('user', 'assistant')")
    nothing = F.lit(None).cast("string")
    items = known.select("conv_id", item(F.lit("turn"), nothing, F.col("role"), F.col("text"), F.col("turn")).alias("item"))
    called = calls.where("call_id IS NOT NULL").select("conv_id", "call_id").distinct().withColumn("called", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("result_turn", "result"))
    rest = results.withColumn("nth", nth).join(called, ["conv_id", "call_id"], "left").where("called IS NULL OR nth > 1")
    kind = F.when(F.col("called"), "repeated").otherwise("orphan")
    items = settle(items.unionByName(rest.select("conv_id", item(kind, F.col("call_id"), F.lit("result"), F.col("result"), F.col("result_turn")).alias("item"))))

    homes = settle(calls.where("conv_id IS NOT NULL AND turn IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("call_id").alias("call_id")))
    places = items.select("conv_id", F.col("item.turn").alias("turn")).distinct()
    marks = homes.select("conv_id", "turn", F.lit(True).alias("home")).unionByName(places.select("conv_id", "turn", F.lit(False).alias("home")))
    later = F.last(F.when(F.col("home"), F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("home")).rowsBetween(Window.unboundedPreceding, 0))
    last = homes.groupBy("conv_id").agg(F.max("turn").alias("last"))
    found = marks.withColumn("later", later).where("NOT home").join(last, "conv_id", "left").select("conv_id", F.col("turn").alias("at"), F.coalesce("later", "last").alias("turn"))
    found = settle(found.join(homes, ["conv_id", "turn"], "left"))
    here = found.withColumnRenamed("conv_id", "conv")
    return items.join(here, (items.conv_id.eqNullSafe(here.conv)) & items["item.turn"].eqNullSafe(here["at"]), "left").select("conv_id", "turn", "call_id", "item")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, others: DataFrame | None = None) -> DataFrame:
    """One row for each call: its result, level, problems and canonical JSON.

    The first result of an identifier, by turn, then text, is its result; a
    call without one has a null result.  Repeated calls of an identifier each
    have a row.  Null identifiers are linked to nothing and have no level.
    Canonical JSON has keys in order and no white space; arguments that are
    not JSON, or repeat a key, are left out of it.  With the rows of
    ``left_over`` as ``others``, a call's JSON lists its items as "unlinked".
    """
    first = results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "result")).alias("r"))
    first = first.select("conv_id", "call_id", "r.result_turn", "r.result")
    calls = calls.withColumn("parsed", F.try_parse_json("arguments"))
    keys = ["conv_id", "call_id"]
    out = calls.join(first.hint("shuffle_hash"), keys, "left").join(levels(calls), keys, "left")
    out = out.withColumn("problems", problems(F.col("name"), F.col("parsed"), schemas))
    parts = [F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "level", "name", "result", "result_turn", "turn"]
    if others is not None:
        held = others.where("call_id IS NOT NULL").groupBy("conv_id", "turn", "call_id").agg(F.array_sort(F.collect_list("item")).alias("unlinked"))
        out = out.join(held, ["conv_id", "turn", "call_id"], "left")
        parts.append(F.transform("unlinked", in_order).alias("unlinked"))
    text = F.to_json(F.struct(*parts))
    return out.select("conv_id", "call_id", "turn", "name", "level", "result_turn", "problems", text.alias("json"))


def in_order(item: Column) -> Column:
    return F.struct(*(item[k].alias(k) for k in ("id", "kind", "role", "text", "turn")))


def op2_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` as calls with their results, and what belongs to no call; an empty table gives no rows."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    (calls, results), (more_calls, more_results) = implicit_calls(messages), explicit_calls(messages)
    calls, results = calls.unionByName(more_calls), results.unionByName(more_results)
    others = settle(left_over(messages, calls, results))
    linked = link_tool_calls(calls, results, others=others).withColumn("n_problems", F.size("problems")).drop("problems")
    none = lambda name: F.lit(None).cast(linked.schema[name].dataType).alias(name)
    alone = others.where("call_id IS NULL").select("conv_id", none("call_id"), F.col("item.turn").alias("turn"), none("name"), none("level"), none("result_turn"), none("n_problems"), F.to_json(in_order(F.col("item"))).alias("json"))
    return linked.unionByName(alone).select("conv_id", "call_id", "turn", "name", "level", "result_turn", "n_problems", "json")
