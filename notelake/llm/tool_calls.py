"""Tool calls linked to their results: joined by identifier, ordered by dependence, checked, and written as JSON.

calls (conv_id, turn, call_id, name, arguments, depends_on) meet results (conv_id, turn, call_id, content) in a hash join on
conversation and identifier. A call may only come after those that it depends on: its level is the length of the longest
chain of dependences below it, 0 without any. Where calls have one dependence each, levels come from pointer jumping, in
as many rounds as the longest chain has binary digits; conversations with calls of several dependences take rounds of
joins, each of which places the calls whose dependences are placed. Calls in a cycle, or after one, have a null level and
come last. Arguments are JSON texts that must be objects with the required fields of the tool's schema, of the stated
types and within the stated bounds, and no others. A linked call is one canonical JSON text: keys sorted, no blanks, null
fields kept; NaN and infinities aren't JSON, and what UTF-8 can't hold is escaped.

Statuses: linked; unanswered (no result); orphan (a result without a call). Of several results of a call the one with
the least turn and content counts, and n_results tells how many there were; a call stated several times likewise.
Nulls: where the conversation or the identifier is null, a call or result meets nothing and stays a row of its own; null
arguments are invalid; null turns come first. Extra columns are not read. Empty tables give no rows. No window or group
holds more than one conversation's rows, sorted on disk if need be.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Schemas by tool: field -> (type, required, least, most); bounds are of a string's length or of a number.
Schemas = dict[str, dict[str, tuple[str, bool, int | None, int | None]]]
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def _constant(text: str):
    raise ValueError(f"{text} is not JSON")


def parsed(text: str):
    """A JSON text's value; ValueError where it isn't JSON, or a number or a depth that can't be held."""
    try:
        value = json.loads(text, parse_constant=_constant)
        json.dumps(value, allow_nan=False)
    except RecursionError as e:
        raise ValueError("too deep") from e
    return value


def problem(name: str | None, arguments: str | None, schemas: Schemas) -> str | None:
    """What is wrong with a call's arguments; None if nothing is."""
    if name not in schemas:
        return "unknown tool"
    try:
        given = parsed(arguments) if arguments is not None else None
    except ValueError:
        return "not JSON"
    if not isinstance(given, dict):
        return "not an object"
    schema = schemas[name]
    for field in sorted(given.keys() - schema.keys()):
        return f"{field}: unknown"
    for field, (kind, required, least, most) in schema.items():
        if field not in given:
            if required:
                return f"{field}: missing"
            continue
        value = given[field]
        if not isinstance(value, _KINDS[kind]) or kind != "boolean" and isinstance(value, bool):
            return f"{field}: not of type {kind}"
        size = len(value) if isinstance(value, (str, list)) else value if kind in ("integer", "number") else None
        if size is not None and (least is not None and size < least or most is not None and size > most):
            return f"{field}: out of bounds"
    return None


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if any("\ud800" <= c <= "\udfff" for c in text):  # halves of pairs
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return text


def _serialised(schemas: Schemas):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors, texts = [], []
            for r in f.to_dict("records"):
                if r["status"] == "orphan":
                    errors.append(None)
                    texts.append(canonical({"id": r["call_id"], "result": r["content"], "type": "orphan_result"}))
                    continue
                wrong = problem(r["name"], r["arguments"], schemas)
                try:
                    given = parsed(r["arguments"]) if r["arguments"] is not None else None
                except ValueError:
                    given = r["arguments"]
                errors.append(wrong)
                texts.append(canonical({"arguments": given, "depends_on": list(r["depends_on"]) if r["depends_on"] is not None else [], "id": r["call_id"], "name": r["name"], "result": r["content"], "type": "tool_call", "valid": wrong is None}))
            yield f.assign(error=errors, canonical_json=texts).drop(columns=["arguments", "content", "depends_on", "name"])

    return run


LINKED = "conv_id long, call_id string, status string, call_turn long, result_turn long, level long, position long, n_results long, error string, canonical_json string"


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of distinct calls (conv_id, id, depends_on); null level: in or after a cycle.

    Identifiers that no call of the conversation has are no dependences."""
    ids = written(calls.select("conv_id", "id"), "calls")
    needs = calls.select("conv_id", "id", F.explode("depends_on").alias("need")).distinct()
    needs = written(needs.join(ids.withColumnRenamed("id", "need"), ["conv_id", "need"]), "needs")
    several = written(needs.groupBy("conv_id", "id").count().where("count > 1").select("conv_id").distinct(), "several")
    # one dependence each: below is how far up leads down; it doubles until nothing is left below or only cycles are
    single = ids.join(several, "conv_id", "left_anti").join(needs, ["conv_id", "id"], "left")
    single = written(single.select("conv_id", "id", F.col("need").alias("up"), F.col("need").isNotNull().cast("long").alias("below")), "chains")
    most, reach = ids.count(), 1
    while reach < most and not single.where("up IS NOT NULL").isEmpty():
        next_up = single.select("conv_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("below").alias("_below"))
        single = written(single.join(next_up, ["conv_id", "up"], "left").select("conv_id", "id", F.col("_up").alias("up"), (F.col("below") + F.coalesce("_below", F.lit(0))).alias("below")), "chains")
        reach *= 2
    out = single.select("conv_id", "id", F.when(F.col("up").isNull(), F.col("below")).alias("level"))
    if several.isEmpty():
        return out
    open_needs = written(needs.join(several, "conv_id", "left_semi"), "needs")
    waiting = written(ids.join(several, "conv_id", "left_semi"), "waiting")
    level = 0
    while True:
        blocked = open_needs.select("conv_id", "id").distinct()
        ready = written(waiting.join(blocked, ["conv_id", "id"], "left_anti"), "ready")
        if ready.isEmpty():
            return out.union(waiting.withColumn("level", F.lit(None).cast("long")))
        out = out.union(ready.withColumn("level", F.lit(level).cast("long")))
        if level % 50 == 49:
            out = written(out, "levels")
        waiting = written(waiting.join(ready, ["conv_id", "id"], "left_anti"), "waiting")
        open_needs = written(open_needs.join(ready.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_anti"), "needs")
        level += 1


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a conversation and an identifier, and the others."""
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    return rows.where(known), rows.where(~known)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and each result without a call."""
    named, lone = _split(calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on"))
    call = named.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select("conv_id", "call_id", "c.*", F.concat(F.lit("i"), "call_id").alias("id"))
    lone = written(lone, "lone").withColumn("id", F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))  # read from a table: numbers stay
    call = call.unionByName(lone)
    answered, orphans = _split(results.select("conv_id", "turn", "call_id", "content"))
    result = answered.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    result = result.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("r.turn").alias("result_turn"), "r.content", "n_results")
    placed = levels(call.select("conv_id", "id", F.transform("depends_on", lambda x: F.concat(F.lit("i"), x)).alias("depends_on"))).select(F.col("conv_id").alias("_c"), F.col("id").alias("_id"), "level")
    call = call.join(placed, (F.col("conv_id").eqNullSafe(F.col("_c"))) & (F.col("id") == F.col("_id")), "left")
    call = call.withColumnRenamed("turn", "call_turn").withColumn("called", F.lit(True))
    joined = call.join(result, (F.col("conv_id") == F.col("_conv")) & (F.col("call_id") == F.col("_call")), "full_outer")
    joined = joined.withColumns({"conv_id": F.coalesce("conv_id", "_conv"), "call_id": F.coalesce("call_id", "_call")})
    joined = joined.unionByName(orphans.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results")), allowMissingColumns=True)
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    order = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "call_turn", "result_turn", "call_id", "content")
    rows = joined.select("conv_id", "call_id", status.alias("status"), "call_turn", "result_turn", "level", F.row_number().over(order).cast("long").alias("position"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "arguments", "content", "depends_on", "name")
    return rows.mapInArrow(_as_arrow(schemas), LINKED)


def _as_arrow(schemas: Schemas):
    """The pandas step by Arrow batches, whose integers stay integers where there are nulls."""
    import pyarrow as pa

    write = _serialised(schemas)
    names = [x.split()[0] for x in LINKED.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in LINKED.split(", ")]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            frame = pd.DataFrame(rows, columns=batch.schema.names, dtype=object)
            for done in write([frame]):
                yield pa.RecordBatch.from_arrays([pa.array([None if x is None else x for x in done[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return run


#: The tools that the query's calls name, with their schemas.
TOOLS: Schemas = {
    "lookup": {"query": ("string", True, 1, 200), "limit": ("integer", True, 1, 20)},
    "summarise": {"query": ("string", True, 1, None), "words": ("integer", False, 0, 500)},
    "reply": {"query": ("string", True, 1, None), "limit": ("integer", False, 1, None), "after": ("string", False, None, None)},
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that turns (conv_id, turn, role, text) stand for.

    A user's turn calls `summarise` where it has many words, `lookup` where it has line breaks, else `reply`. A lookup
    depends on the turn two after, which tells what to look for; another call on the turn two before, but on no lookup.
    An assistant's turn is the result of the turn before it."""
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), "\\s+"))
    name = F.when(words > 60, "summarise").when(F.col("text").contains("\n"), "lookup").otherwise("reply")
    key = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    user = turns.where("role = 'user'").withColumn("name", name)
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.when(name != "summarise", F.greatest(words, F.lit(1))).alias("limit"), F.when(name == "summarise", words).alias("words"), F.when(name == "reply", F.col("role")).alias("after")))
    lookups = user.where("name = 'lookup'").select(F.col("conv_id").alias("_conv"), (F.col("turn") + 2).alias("_after")).distinct()
    user = user.join(lookups, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_after")), "left")
    depends = F.when(F.col("name") == "lookup", F.array(key(F.col("turn") + 2))).when((F.col("turn") >= 2) & F.col("_after").isNull(), F.array(key(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = user.select("conv_id", "turn", key(F.col("turn")).alias("call_id"), "name", arguments.alias("arguments"), depends.alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call and every assistant turn as a result, linked, ordered, checked and serialised; a turn of
    another role, or of none, is a row of its own with the status `other`."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    other = turns.where("role IS NULL OR role NOT IN ('user', 'assistant')")
    text = F.to_json(F.struct(F.col("text").alias("content"), "role", F.lit("turn").alias("type")), {"ignoreNullFields": "false"})
    null = lambda kind: F.lit(None).cast(kind)
    rows = other.select("conv_id", null("string").alias("call_id"), F.lit("other").alias("status"), F.col("turn").alias("call_turn"), null("long").alias("result_turn"), null("long").alias("level"), null("long").alias("position"), F.lit(0).cast("long").alias("n_results"), null("string").alias("error"), text.alias("canonical_json"))
    return link(*calls_of(turns), TOOLS).unionByName(rows)
