"""Tool-call linking: calls and results joined by identifier, ordered by dependence, validated, written as canonical JSON.

Everything is DataFrame operations. Arguments are parsed as variants, whose objects keep their keys in order, so that
writing them back gives one form for equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import pinned

# Calls of a conversation that are numbered in one task: places of one bucket of turns.
BUCKET = 1_024
# Rows of a bucket beyond which its turns are numbered one by one, in so many parts each.
CROWDED, SALTS = 100_000, 64


def json_type(value: Column) -> Column:
    """JSON type name of a variant; numbers without a fraction are integers."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("number")
    )


def _problem(given: Column, p: Column) -> Column:
    """What is wrong with one parameter `p` (param, type, required, low, high) of the argument map; null if nothing."""
    value = F.element_at(given, p["param"])
    kind = json_type(value)
    length = F.char_length(F.try_variant_get(value, "$", "string")).cast("double")
    size = F.when(p["type"] == "string", length).otherwise(F.try_variant_get(value, "$", "double"))
    fits = (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer"))
    return (
        F.when(~F.map_contains_key(given, p["param"]), F.when(p["required"], F.concat(F.lit("missing "), p["param"])))
        .when(~fits, F.concat(F.lit("wrong type "), p["param"]))
        .when((size < p["low"]) | (size > p["high"]), F.concat(F.lit("out of range "), p["param"]))
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`calls` with `parsed` (variant) and `problems` (sorted array) from the parameters declared for the call's tool.

    `schemas` has a row for each tool and parameter: name, param, type, required, low, high (lengths of strings or
    values of numbers; null: no bound). Arguments must be an object; undeclared parameters and tools are problems.
    """
    tools = schemas.groupBy(F.col("name").alias("tool")).agg(F.collect_list(F.struct("param", "type", "required", "low", "high")).alias("params"))
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("given", F.try_variant_get("parsed", "$", "map<string,variant>"))
    parsed = parsed.join(tools, F.col("name") == F.col("tool"), "left")
    own = F.filter(F.transform("params", lambda p: _problem(F.col("given"), p)), lambda e: e.isNotNull())
    extra = F.transform(F.array_except(F.map_keys("given"), F.transform("params", lambda p: p["param"])), lambda k: F.concat(F.lit("undeclared "), k))
    problems = (
        F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(F.sort_array(F.concat(own, extra)))
    )
    return parsed.withColumn("problems", problems).drop("given", "tool", "params")


def _jumped(single: DataFrame) -> DataFrame:
    """(node, to, d) of nodes with one need: the first node of the chain that has none or several, and how far it is.

    Pointers double every round, so a chain of n calls takes log n rounds. Chains that end in a loop are left out.
    """
    far, before = pinned(single), None
    while True:
        through = far.select(F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("d").alias("_d"))
        far = pinned(far.join(through, F.col("to") == F.col("_node"), "left").select("node", F.coalesce("_to", "to").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
        inside = far.join(single.select(F.col("node").alias("_node")), F.col("to") == F.col("_node"), "left_semi").count()
        if inside in (0, before):  # each round ends some chain, but for loops
            return far.join(single.select(F.col("node").alias("_node")), F.col("to") == F.col("_node"), "left_anti")
        before = inside


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, level): the longest chain of calls that a call waits for; calls in or behind a loop are left out.

    needs: distinct (node, to) between the distinct `nodes`. Chains of calls with one need each are jumped over. On what
    is left, a round takes the calls all of whose needs are taken; there are as many as calls with several needs follow
    one another. Every round's tables are checkpointed.
    """
    count = needs.groupBy(F.col("node").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    counted = pinned(nodes.join(count, F.col("node") == F.col("_of"), "left").select("node", F.coalesce("_n", F.lit(0)).alias("n")))
    edges = pinned(needs.join(counted, "node"))
    far = pinned(_jumped(edges.where("n = 1").select("node", "to", F.lit(1).cast("long").alias("d"))))
    done = counted.where("n = 0").select("node", F.lit(0).cast("long").alias("level"))
    head = far.select(F.col("node").alias("_node"), F.col("to").alias("_head"), F.col("d").alias("_d"))
    waiting = pinned(edges.where("n > 1").join(head, F.col("to") == F.col("_node"), "left").select(
        "node", F.coalesce("_head", "to").alias("to"), (F.lit(1) + F.coalesce("_d", F.lit(0))).alias("w")))
    while not waiting.isEmpty():
        told = done.select(F.col("node").alias("_to"), F.col("level").alias("_level"))
        ready = waiting.join(told, F.col("to") == F.col("_to"), "left").groupBy("node").agg(
            F.max(F.col("_level") + F.col("w")).alias("level"), F.count_if(F.col("_level").isNull()).alias("open")).where("open = 0")
        ready = pinned(ready.select("node", "level"))
        if ready.isEmpty():
            break
        done = pinned(done.unionByName(ready))
        waiting = pinned(waiting.join(ready.select("node"), "node", "left_anti"))
    top = done.select(F.col("node").alias("_to"), F.col("level").alias("_level"))
    return done.unionByName(far.join(top, F.col("to") == F.col("_to")).select("node", (F.col("_level") + F.col("d")).alias("level")))


def ordered(linked: DataFrame) -> DataFrame:
    """Adds `position` from 0 inside the conversation, by (level, turn, call_id); rows without a level come last.

    Rows are numbered inside buckets of turns and the buckets' counts are added up, so that a conversation of any
    length is dealt over tasks. Of a bucket with more than CROWDED rows, turns are numbered one by one, and the rows of
    a turn in no particular order.
    """
    rows = linked.withColumn("_late", F.col("level").isNull()).withColumn("_bucket", F.floor(F.col("turn") / BUCKET))
    first = ["conv_id", "_late", "level", "_bucket"]
    crowded = pinned(rows.groupBy(*first).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select(*[F.col(k).alias(f"_of{k}") for k in first]))

    def same(keys: list[str]) -> Column:
        found = F.lit(True)
        for k in keys:
            found = found & F.col(k).eqNullSafe(F.col(f"_of{k}"))
        return found

    if crowded.isEmpty():
        rows = rows.withColumn("_turn", F.lit(None).cast("long")).withColumn("_salt", F.lit(0).cast("long"))
    else:
        rows = rows.join(crowded.withColumn("_is", F.lit(True)), same(first), "left").drop(*[f"_of{k}" for k in first])
        rows = rows.withColumn("_turn", F.when(F.col("_is"), F.col("turn"))).withColumn("_salt", F.when(F.col("_is"), F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(0)).drop("_is")
    keys = [*first, "_turn", "_salt"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_late", "level", "_bucket", "_turn", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*[F.col(k).alias(f"_of{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "call_id", "_row")) - 1
    placed = rows.withColumn("_own", own).join(carried, same(keys))
    return placed.withColumn("position", F.col("_before") + F.col("_own")).select(*[c for c in linked.columns if c != "_row"], "position")


def _node(id_: str = "call_id") -> Column:
    """A call's identifier in its conversation; null without one. A null conversation is one of its own."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\n"), F.col(id_))


def link(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row of kind `call` for every call, and one of kind `result` for every result that no call row holds.

    calls: call_id, conv_id, turn, name, arguments (JSON text); results: call_id, conv_id, turn, content; needs:
    call_id, conv_id, needs_id. Identifiers count inside their conversation. Returns kind, call_id, conv_id, turn, name,
    level, position, n_results, problems, canonical.

    Of calls that repeat an identifier the first (by turn and content, nulls first) has the results and the needs; all
    are rows with that problem and the identifier's level. A call row holds the first result (by turn, then content);
    further results, results without a call and results without an identifier are rows of their own. Calls without an
    identifier have level 0 and no results. Needs of unknown calls are a problem and otherwise ignored; needs without
    an identifier on either side are ignored. `canonical` is the JSON of arguments, identifier, name, needs and result
    with sorted keys and no spaces; a result that is a JSON object or array is written as one. Empty tables are fine.
    """
    calls = pinned(calls.select("call_id", "conv_id", "turn", "name", "arguments", _node().alias("node")).withColumn("_row", F.monotonically_increasing_id()))
    results = pinned(results.select("call_id", "conv_id", "turn", "content", _node().alias("node")).withColumn("_row", F.monotonically_increasing_id()))
    firsts = pinned(calls.where("node is not null").groupBy("node").agg(F.min(F.struct("turn", "name", "arguments", "_row"))["_row"].alias("first"), F.count(F.lit(1)).alias("n_calls")))
    known = firsts.select("node")
    edges = pinned(needs.select(_node().alias("node"), _node("needs_id").alias("to"), "needs_id").where("node is not null and `to` is not null").distinct())
    fine = edges.select("node", "to").join(known, "node", "left_semi").join(known.withColumnRenamed("node", "to"), "to", "left_semi").select("node", "to")
    unknown = edges.join(known.withColumnRenamed("node", "to"), "to", "left_anti").select(F.col("node").alias("u")).distinct()
    wanted = edges.groupBy(F.col("node").alias("w")).agg(F.sort_array(F.collect_set("needs_id")).alias("needs"))
    answers = results.where("node is not null").groupBy(F.col("node").alias("r")).agg(F.min(F.struct("turn", "content", "_row")).alias("a"), F.count(F.lit(1)).alias("n_results"))
    answers = pinned(answers.join(known, F.col("r") == F.col("node"), "left_semi"))

    ids = firsts.join(answers, F.col("node") == F.col("r"), "left").join(wanted, F.col("node") == F.col("w"), "left").join(unknown, F.col("node") == F.col("u"), "left")
    ids = ids.join(levels(known, pinned(fine)).withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").select(F.col("node").alias("_id"), "first", "n_calls", "a", "n_results", "needs", "u", "level")
    checked_ = validated(calls, schemas).join(ids, F.col("node") == F.col("_id"), "left")
    is_first = F.coalesce(F.col("_row") == F.col("first"), F.lit(False))
    checked_ = checked_.withColumn("needs", F.when(is_first, F.col("needs"))).withColumn("a", F.when(is_first, F.col("a")))
    n_results = F.when(is_first, F.coalesce("n_results", F.lit(0))).otherwise(0).cast("long")
    found = F.array_compact(F.array(
        F.when(F.col("node").isNull(), "no identifier"), F.when(is_first & (n_results == 0), "no result"), F.when(n_results > 1, "several results"),
        F.when(F.col("n_calls") > 1, "repeated call"), F.when(is_first & F.col("u").isNotNull(), "unknown need"), F.when(F.col("node").isNotNull() & F.col("level").isNull(), "circular needs")))
    rows = checked_.select(
        F.lit("call").alias("kind"), "call_id", "conv_id", "turn", "name", F.when(F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")).alias("level"),
        n_results.alias("n_results"), F.concat(F.coalesce("problems", F.array().cast("array<string>")), found).alias("problems"),
        _canonical(F.col("parsed"), F.coalesce("needs", F.array().cast("array<string>")), F.col("a.content")).alias("canonical"), "_row")

    held = answers.select(F.col("r").alias("_id"), F.col("a._row").alias("first"))
    others = results.join(held, F.col("node") == F.col("_id"), "left").where(F.col("first").isNull() | (F.col("_row") != F.col("first")))
    why = F.when(F.col("node").isNull(), "no identifier").when(F.col("_id").isNull(), "result without call").otherwise("further result")
    others = others.select(
        F.lit("result").alias("kind"), "call_id", "conv_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("level"), F.lit(1).cast("long").alias("n_results"),
        F.array(why).alias("problems"), _canonical(F.lit(None).cast("variant"), F.array().cast("array<string>"), F.col("content")).alias("canonical"), "_row")
    return ordered(pinned(rows.unionByName(others)))


def _canonical(arguments: Column, needs: Column, content: Column) -> Column:
    """JSON text of a row with columns call_id and name."""
    text = F.trim(content)
    result = F.coalesce(F.when(F.substring(text, 1, 1).isin("{", "["), F.try_parse_json(text)), content.cast("variant"))
    whole = F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "name", needs.alias("needs"), result.alias("result"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A conversations table read as tool use: (calls, results, needs).

    System turns are `configure` calls and user turns `ask` calls; an assistant turn is the result of the turn before.
    The k-th question needs question (k - 1) div 2, the first one a system turn before it.
    """
    name = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    calls = turns.where(F.col("role").isin("system", "user")).select(
        name.alias("call_id"), "conv_id", "turn", F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"),
        F.to_json(F.struct("turn", "text", F.char_length("text").alias("chars")), {"ignoreNullFields": "false"}).alias("arguments"))
    at = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = turns.where(F.col("role") == "assistant").select(at.alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    k = F.floor(F.col("turn") / 2)
    before = F.when(k > 0, F.col("turn") - 2 * (k - F.floor((k - 1) / 2))).when(F.col("turn") == 1, F.lit(0))
    needs = turns.where((F.col("role") == "user") & before.isNotNull()).select(
        name.alias("call_id"), "conv_id", F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), before.cast("string")).alias("needs_id"))
    return calls, results, needs


# The parameters that the two calls read from conversations are declared with.
CONVERSATION_TOOLS = [
    (name, param, kind, required, low, high)
    for name in ("ask", "configure")
    for param, kind, required, low, high in (("chars", "integer", True, 1.0, 400.0), ("text", "string", True, 1.0, 400.0), ("turn", "integer", False, 0.0, None))
]
TOOL_SCHEMA = "name string, param string, type string, required boolean, low double, high double"
