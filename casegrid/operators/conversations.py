"""Chat turns out of agent traces, as windows and joins.

Which call a tool result answers is a queue: calls wait in order, a result takes
the oldest, and one that finds none gets a call of its own. Over the steps of a
trace, let ``asked`` be the calls so far and ``told`` the results so far. Calls
had to be made up as often as results ran ahead of calls at the worst moment yet:
``made_up`` = the running maximum of told - asked, and 0. A result is made up for
where that number grows; any other answers the call whose number is told - made_up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: the parts of a trace's steps that are read; JSON inside stays text
STEPS = (
    "array<struct<turn:string,content:string,tool_result:string,forced:boolean,args:string,result:string,"
    "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"
)
#: Identifiers of calls that a trace doesn't name, and of the gold calls.
FORCED_ID, MADE_UP_ID = "forced_extract_0", "synthetic_tool_call_"
GOLD_EXTRACT_ID, GOLD_LOOKUP_ID, GOLD_VALIDATE_ID = "gold_extract_0", "gold_lookup_", "gold_validate_0"
EXTRACT_TOOL, LOOKUP_CONDITION_TOOL, LOOKUP_NAME_TOOL, VALIDATE_TOOL = "extract_codes_from_text", "lookup_reportable_conditions", "lookup_displayname", "validate_fhir_extraction"
AXES = ("conditions", "loincs", "rxnorms")

CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"


def compact(json: Column, empty: str) -> Column:
    """JSON text without blanks between its parts; other text as it is; ``empty`` for none."""
    return F.coalesce(F.get_json_object(json, "$"), json, F.lit(empty))


def turn(role: str, content: Column, **more: Column) -> Column:
    """A chat turn as JSON text, with its further fields in front of or behind the content, as the role has them."""
    fields = {"role": F.lit(role), "content": content, **more} if role == "assistant" else {"role": F.lit(role), **more, "content": content}
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def call(number: Column, name: Column, arguments: Column, kind: Column | None = None) -> Column:
    function = F.struct(name.alias("name"), arguments.alias("arguments"))
    return F.struct(number.alias("id"), F.coalesce(kind if kind is not None else F.lit(None), F.lit("function")).alias("type"), function.alias("function"))


def trace_turns(rows: DataFrame, id_column: str, trace: str, tasks: int | None = None) -> DataFrame:
    """id, pos, part, role, call_id, name, json: the tool turns of each trace (JSON array of steps), in order of pos and part.

    A step with a result is a tool turn (part 1), behind a call made up for it
    (part 0) where none was open; a step with named calls is one assistant turn
    (call_id and name: its first call's). Other steps are left out. ``tasks``: tasks
    that results and calls are paired in, by default as many as a shuffle has.
    """
    steps = rows.select(id_column, F.posexplode(F.from_json(trace, STEPS)).alias("pos", "s"))
    # columns of their own, so that what a query doesn't ask for isn't sorted with the rest
    fields = [F.col(f"s.{k}").alias(f"step_{k}") for k in ("content", "tool_result", "forced", "args", "result")]
    listed = F.transform(
        F.coalesce("s.tool_calls", F.array().cast(f"array<{CALL}>")),
        lambda c, k: call(
            F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("trace_turn_"), F.coalesce("s.turn", F.lit("x")), F.lit("_call_"), k.cast("string"))),
            c["function"]["name"],
            compact(c["function"]["arguments"], "{}"),
            F.nullif(c["type"], F.lit("")),
        ),
    )
    told = F.coalesce(F.col("s.tool_result") != "", F.lit(False))
    steps = steps.select(id_column, "pos", *fields, told.alias("told"), F.when(told, F.array().cast(f"array<{CALL}>")).otherwise(F.filter(listed, lambda c: F.coalesce(c["function"]["name"] != "", F.lit(False)))).alias("calls"))
    so_far = Window.partitionBy(id_column).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("asked", F.sum(F.size("calls")).over(so_far)).withColumn("ahead", F.sum(F.col("told").cast("int")).over(so_far))
    counted = counted.withColumn("made_up", F.greatest(F.lit(0), F.max(F.col("ahead") - F.col("asked")).over(so_far)))
    before = F.lag("made_up", 1, 0).over(Window.partitionBy(id_column).orderBy("pos"))
    counted = counted.withColumn("alone", F.col("told") & (F.col("made_up") > before)).withColumn("number", F.when(F.col("told") & ~F.col("alone"), F.col("ahead") - F.col("made_up")))
    asked = counted.where(F.size("calls") > 0)
    open_calls = asked.select(F.col(id_column).alias("of"), F.posexplode("calls").alias("k", "c"), (F.col("asked") - F.size("calls")).alias("base"))
    open_calls = open_calls.select("of", (F.col("base") + F.col("k") + 1).alias("nth"), F.col("c.id").alias("open_id"), F.col("c.function.name").alias("open_name"))
    told_steps = counted.where("told")
    if tasks:
        told_steps, open_calls = told_steps.repartition(tasks, id_column, "number"), open_calls.repartition(tasks, "of", "nth")
    results = told_steps.join(open_calls, (F.col(id_column) == F.col("of")) & (F.col("number") == F.col("nth")), "left")
    own_id = F.when(F.coalesce("step_forced", F.lit(False)), FORCED_ID).otherwise(F.concat(F.lit(MADE_UP_ID), (F.col("made_up") - 1).cast("string")))
    results = results.withColumn("call_id", F.coalesce("open_id", own_id)).withColumn("name", F.coalesce("open_name", "step_tool_result"))

    def shaped(df: DataFrame, part: int, role: str, call_id: Column, name: Column, json: Column) -> DataFrame:
        return df.select(id_column, "pos", F.lit(part).alias("part"), F.lit(role).alias("role"), call_id.alias("call_id"), name.alias("name"), json.alias("json"))

    said = shaped(asked, 0, "assistant", F.col("calls")[0]["id"], F.col("calls")[0]["function"]["name"], turn("assistant", F.coalesce("step_content", F.lit("")), tool_calls=F.col("calls")))
    own_call = F.array(call(F.col("call_id"), F.col("name"), compact(F.col("step_args"), "{}")))
    made = shaped(results.where("alone"), 0, "assistant", F.col("call_id"), F.col("name"), turn("assistant", F.lit(""), tool_calls=own_call))
    answers = shaped(results, 1, "tool", F.col("call_id"), F.col("name"), turn("tool", compact(F.col("step_result"), "null"), tool_call_id=F.col("call_id"), name=F.col("name")))
    return said.union(made).union(answers)


def _assembled(rows: DataFrame, id_column: str, turns: DataFrame, system: Column, user: Column, last: Column) -> DataFrame:
    """``rows`` with conversations: system and user turns, the ``turns`` (id, pos, part, json) in order, and the last one; null without any turn."""
    listed = turns.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("pos", "part", "json"))).alias("turns"))
    middle = F.transform("turns", lambda t: t["json"])
    whole = F.concat(F.array(turn("system", F.coalesce(system, F.lit(""))), turn("user", F.coalesce(user, F.lit("")))), middle, F.array(turn("assistant", last)))
    return rows.join(listed, id_column, "left").withColumn("conversations", F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]"))).drop("turns")


def conversations(rows: DataFrame, id_column: str = "case_id") -> DataFrame:
    """Id, conversations (JSON or null) from id (unique), system, user, trace (JSON array) and target (JSON object); a trace without a call gives none."""
    turns = trace_turns(rows, id_column, "trace")
    return _assembled(rows, id_column, turns, F.col("system"), F.col("user"), compact(F.col("target"), "{}")).select(id_column, "conversations")


def missing_codes(rows: DataFrame, id_column: str, names: DataFrame) -> DataFrame:
    """Id, axis, code, query, result, nth for each target code that the candidate lacks; without a known query, query and nth are null.

    ``rows``: id, candidate and target, both struct of an array of codes for each
    axis; ``names``: axis, code, query, result (what looking it up returns, JSON).
    """
    none = F.array().cast("array<string>")

    def of_axis(n: int, axis: str) -> Column:
        codes = F.array_except(F.coalesce(F.col("target")[axis], none), F.coalesce(F.col("candidate")[axis], none))
        return F.transform(codes, lambda code, k: F.struct(F.lit(n).alias("a"), k.alias("k"), F.lit(axis).alias("axis"), code.alias("code")))

    lacking = F.concat(*[of_axis(n, axis) for n, axis in enumerate(AXES)])
    one = rows.select(id_column, F.explode(lacking).alias("m")).select(id_column, "m.*")
    found = one.join(names.select("axis", "code", "query", "result"), ["axis", "code"], "left")
    known = F.col("query").isNotNull()
    nth = F.row_number().over(Window.partitionBy(id_column, known).orderBy("a", "k")) - 1
    return found.withColumn("nth", F.when(known, nth)).select(id_column, "axis", "code", "query", "result", "nth")


def gold_conversations(rows: DataFrame, names: DataFrame, id_column: str = "case_id") -> DataFrame:
    """Id, conversations, lookup_calls, missing_lookup_queries ("axis:code", in order of axis): extract, a lookup for each code that extraction lacked, validate, answer.

    ``rows``: id (unique), system, user, candidate and target (struct of arrays by axis), validation (JSON result).
    """
    found = missing_codes(rows, id_column, names)
    empty = {axis: F.coalesce(F.col("target")[axis], F.array().cast("array<string>")).alias(axis) for axis in AXES}
    target = F.to_json(F.struct(*empty.values()))

    def pair(df: DataFrame, pos: Column, call_id: Column, tool: Column, args: Column, result: Column) -> DataFrame:
        asked = df.select(id_column, pos.alias("pos"), F.lit(0).alias("part"), turn("assistant", F.lit(""), tool_calls=F.array(call(call_id, tool, args))).alias("json"))
        return asked.union(df.select(id_column, pos.alias("pos"), F.lit(1).alias("part"), turn("tool", result, tool_call_id=call_id, name=tool).alias("json")))

    extracted = pair(rows, F.lit(-1), F.lit(GOLD_EXTRACT_ID), F.lit(EXTRACT_TOOL), F.to_json(F.struct(F.coalesce("user", F.lit("")).alias("text"))), F.to_json("candidate"))
    condition = F.col("axis") == "conditions"
    by_name = F.to_json(F.struct(F.col("query").alias("name"), F.regexp_replace("axis", "s$", "").alias("codeset")))
    args = F.when(condition, F.to_json(F.struct("query", F.lit(3).alias("top_k")))).otherwise(by_name)
    looked = pair(found.where("nth is not null"), F.col("nth"), F.concat(F.lit(GOLD_LOOKUP_ID), F.col("nth").cast("string")), F.when(condition, LOOKUP_CONDITION_TOOL).otherwise(LOOKUP_NAME_TOOL), args, compact(F.col("result"), "null"))
    checked = pair(rows, F.lit(2**30), F.lit(GOLD_VALIDATE_ID), F.lit(VALIDATE_TOOL), F.concat(F.lit('{"extraction":'), target, F.lit("}")), compact(F.col("validation"), "null"))
    made = _assembled(rows, id_column, extracted.union(looked).union(checked), F.col("system"), F.col("user"), target)
    order = F.array_position(F.array(*map(F.lit, AXES)), F.col("axis"))
    counted = found.groupBy(id_column).agg(F.count("nth").cast("int").alias("lookup_calls"), F.array_sort(F.collect_list(F.when(F.col("nth").isNull(), F.struct(order.alias("o"), F.concat_ws(":", "axis", "code").alias("m"))))).alias("l"))
    out = made.join(counted, id_column, "left")
    return out.select(id_column, "conversations", F.coalesce("lookup_calls", F.lit(0)).alias("lookup_calls"), F.coalesce(F.transform("l", lambda x: x["m"]), F.array().cast("array<string>")).alias("missing_lookup_queries"))


def grounded_union(grounded: Column, model: Column) -> Column:
    """With codes grounded by tools, these and those of the model's that are among them, each once; without, the model's."""
    kept = F.array_distinct(F.concat(grounded, F.array_intersect(model, grounded)))
    return F.when(F.size(grounded) > 0, kept).otherwise(F.array_distinct(model))
