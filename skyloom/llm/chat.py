"""Tool-call linking for chat formatting, in DataFrame operations only.

Calls and results meet by a hash join on their identifier, calls get a topological level
from what they depend on, their arguments are validated against schemas, and each call
becomes one canonical JSON object (sorted keys, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.session import as_table

KEY = ["conv_id", "call_id"]
_TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"],
    "boolean": ["BOOLEAN"],
    "object": ["OBJECT"],
    "array": ["ARRAY"],
}


def quoted(c: Column) -> Column:
    """A string or number as JSON; null as null."""
    text = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substr(text, F.lit(2), F.length(text) - 2))


def _valid(tool: Column, value: Column, schemas: dict[str, dict]) -> Column:
    """Whether parsed arguments fit the tool's schema: {name: {type, required, maxLength}}; other names are not allowed."""
    verdict = F.lit(False)
    for name, fields in schemas.items():
        keys = F.json_object_keys(F.to_json(value))
        ok = F.schema_of_variant(value).startswith("OBJECT") & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0)
        for field, asked in fields.items():
            path = f"$['{field}']"
            kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            fits = F.regexp_extract(kind, "^([A-Z]+)", 1).isin(_TYPES[asked["type"]])
            if "maxLength" in asked:
                fits &= F.length(F.try_variant_get(value, path, "string")) <= asked["maxLength"]
            missing = F.lit(not asked.get("required", True))
            ok &= F.when(kind.isNull(), missing).otherwise(fits)
        verdict = F.when(tool == name, F.coalesce(ok, F.lit(False))).otherwise(verdict)
    return verdict


def _chains(edges: DataFrame) -> DataFrame:
    """For each call with one parent: the nearest ancestor without that property (anchor), and the steps to it.

    Pointers double their reach each round; a pointer that still moves after as many rounds
    as the number of calls has digits is on or behind a cycle and gets a null anchor.
    """
    single = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("parent").alias("anchor")).where("n = 1")
    jumps = as_table(single.select(*KEY, "anchor", F.lit(1).cast("long").alias("steps")), "chains")
    rounds = jumps.count().bit_length() + 1
    for left in range(rounds, 0, -1):
        on = jumps.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        moved = jumps.join(on, ["conv_id", "anchor"], "left")
        anchor = F.coalesce("next", "anchor") if left > 1 else F.when(F.col("next").isNull(), F.col("anchor"))
        steps = F.col("steps") + F.coalesce("more", F.lit(0))
        jumps = as_table(moved.select(*KEY, anchor.alias("anchor"), steps.alias("steps"), F.col("next").isNotNull().alias("moved")), "chains")
        if jumps.where("moved").isEmpty():
            break
    return jumps.drop("moved")


def levels(calls: DataFrame) -> DataFrame:
    """Topological level of each call: 0 without parents, else one more than its highest parent.

    ``calls``: conv_id, call_id (distinct), parents. Parents that are no calls of the same
    conversation are ignored. Calls on or behind a cycle get null. Chains of calls with one
    parent each are followed in a logarithmic number of rounds; what is left, the calls with
    several parents, takes one round for each of them on the longest way.
    """
    nodes = as_table(calls.select(*KEY), "calls")
    edges = calls.select(*KEY, F.explode(F.array_distinct("parents")).alias("parent"))
    known = nodes.select("conv_id", F.col("call_id").alias("parent"))
    edges = as_table(edges.join(known, ["conv_id", "parent"]), "call-edges")
    chains = _chains(edges)
    several = edges.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    by_parent = chains.select("conv_id", F.col("call_id").alias("parent"), "anchor", "steps", F.lit(True).alias("chained"))
    short = edges.join(several, KEY).join(by_parent, ["conv_id", "parent"], "left")
    anchor = F.when(F.col("chained"), F.col("anchor")).otherwise(F.col("parent"))
    short = as_table(short.select(*KEY, anchor.alias("anchor"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "short-edges")

    zero = nodes.join(edges, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("level"))
    found, waiting = as_table(zero, "call-levels"), short.select(*KEY).distinct().count()
    while waiting:
        at = found.select("conv_id", F.col("call_id").alias("anchor"), "level")
        met = short.join(at, ["conv_id", "anchor"], "left").groupBy(*KEY)
        ready = met.agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.max(F.col("level").isNull()).alias("open"))
        new = as_table(ready.where("not open").select(*KEY, "level").join(found, KEY, "left_anti"), "call-levels")
        reached = new.count()
        if not reached:  # only cycles and what hangs on them
            break
        found, waiting = as_table(found.union(new), "call-levels"), waiting - reached
    at = found.select("conv_id", F.col("call_id").alias("anchor"), "level")
    behind = chains.join(at, ["conv_id", "anchor"], "left").select(*KEY, (F.col("level") + F.col("steps")).alias("level"))
    some = found.unionByName(behind)
    return nodes.join(some, KEY, "left").select(*KEY, F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, call_id, tool, level, valid, linked, n_results, json.

    ``calls``: conv_id, call_id, parents (array), tool, arguments (JSON text).
    ``results``: conv_id, call_id, place, content. Extra columns are ignored.

    * A repeated call_id within a conversation is one call (its least tool, arguments and
      parents); of several results for a call the first by place, then content, is taken.
    * Rows with a null conv_id or call_id link with nothing and are left out.
    * Malformed or null arguments are not valid and stand in the JSON as a string or null;
      an unknown tool is not valid.
    * A result without a call has no tool and level, and is not valid.
    """
    one = lambda df: df.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(*KEY)
    parents = F.coalesce(F.sort_array("parents"), F.array().cast("array<string>"))
    calls = calls.select(*KEY, "tool", "arguments", F.array_compact(parents).alias("parents"))
    single = one(calls).agg(F.min(F.struct("tool", "arguments", "parents")).alias("c"))
    first = one(results).agg(F.min(F.struct("place", "content")).alias("r"), F.count("*").alias("n_results"))
    ordered = levels(single.select(*KEY, F.col("c.parents").alias("parents")))
    joined = single.join(first, KEY, "full").join(ordered, KEY, "left")
    value = F.try_parse_json(F.col("c.arguments"))
    tool = F.col("c.tool")
    valid = F.when(tool.isNull() | value.isNull(), F.lit(False)).otherwise(_valid(tool, value, schemas))
    arguments = F.coalesce(F.to_json(value), quoted(F.col("c.arguments")))
    linked = F.col("c").isNotNull() & F.col("r").isNotNull()
    depends = F.coalesce(F.to_json(F.col("c.parents")), F.lit("[]"))
    json = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"parents":'), depends, F.lit(',"result":'), quoted(F.col("r.content")), F.lit(',"tool":'), quoted(tool), F.lit(',"valid":'), valid.cast("string"), F.lit("}"),
    )
    return joined.select(*KEY, tool.alias("tool"), "level", valid.alias("valid"), linked.alias("linked"), F.coalesce("n_results", F.lit(0)).alias("n_results"), json.alias("json"))


#: What the two kinds of calls read from conversations must look like.
SCHEMAS = {
    "answer": {"prompt": {"type": "string", "maxLength": 400}, "turn": {"type": "integer"}},
    "configure": {"prompt": {"type": "string"}, "turn": {"type": "integer"}},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user turn calls ``answer`` and a system turn ``configure``; the identifier is
    <conv_id>-<turn>. An assistant turn is the result of the turn before it. A call
    depends on the user turn two before it and on a system turn right before it.
    """
    name = lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back)
    earlier = lambda back: F.when(F.col("turn") >= back, name(back))
    usable = turns.where("conv_id is not null and turn is not null")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    tool = F.when(F.col("role") == "user", "answer").otherwise("configure")
    asked = usable.where(F.col("role").isin("user", "system"))
    calls = asked.select("conv_id", name(0).alias("call_id"), F.array_compact(F.array(earlier(1), earlier(2))).alias("parents"), tool.alias("tool"), arguments.alias("arguments"))
    given = usable.where(F.col("role") == "assistant")
    return calls, given.select("conv_id", name(1).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content"))
