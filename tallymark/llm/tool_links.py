"""Chat formatting: tool calls linked to their results, in DataFrame functions only.

Calls and results meet in a hash join by identifier. Calls are ordered topologically:
a call's level is one more than the highest level of the calls that it depends
on, and calls on or behind a cycle have none. Calls with one need form chains, which pointers walk in doubling
steps: a chain of n calls takes log2(n) rounds. Where calls need several others, what is left after that, the calls with
several needs and the chains between them, settles in as many rounds as its longest path has calls. Arguments are checked
against the schema of their tool and serialised as canonical JSON: members by key, no white space.

Every identifier gives one row. Of repeated identifiers the least (position, name,
arguments) counts, of a call's results the least (position, content); rows without an identifier
are left out. Identifiers that a call depends on but that are no call are errors, as are unknown tools,
arguments that are no JSON object or hold a key twice, missing, unknown and wrongly typed
members, missing results, and numbers of more than 38 digits or with an exponent from 270 (the arguments are then written
as null). The result is null where there is none. A row is one call, so a conversation of any length is never gathered.
Other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle, settle_path, small

#: Types of a schema: JSON Schema's names, by the name of a variant's type.
TYPES = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "VOID": "null", "DOUBLE": "number", "FLOAT": "number",
         "DECIMAL": "number", "OBJECT": "object", "ARRAY": "array"}

#: A number of more than 38 digits, or with an exponent of 270 or more, with which 38 digits may exceed a double.
TOO_LONG = r"(?:\d\.?){39}|[eE][+-]?0*(?:[1-9]\d{3,}|[3-9]\d\d|2[7-9]\d)"


def _json_type(value: Column) -> Column:
    head = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    return F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), head)


def _one_of_each(calls: DataFrame) -> DataFrame:
    least = F.min(F.struct("position", "name", "arguments", "depends", "conv_id"))
    return calls.where("call_id is not null").groupBy("call_id").agg(least.alias("c")).select("call_id", "c.*")


def _read(paths: list[str], df: DataFrame) -> DataFrame:
    """The tables of all paths, as one scan."""
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def _walked(single: DataFrame, ends: DataFrame) -> DataFrame:
    """(call_id, top, steps): where the chain of a call with one need ends, for those that reach one of `ends` (call_id).

    single: (call_id, needs), one row for each call. Each round doubles the steps of all pointers.
    """
    end = ends.select(F.col("call_id").alias("top"), F.lit(True).alias("is_end"))
    first = single.select("call_id", F.col("needs").alias("top"), F.lit(1).cast("bigint").alias("steps")).join(end, "top", "left")
    now = settle(first.select("call_id", "top", "steps", F.coalesce("is_end", F.lit(False)).alias("ended")), "pointers")
    done: list[str] = []
    while True:
        done.append(settle_path(now.where("ended"), "ended"))
        left = settle(now.where("not ended"), "walking")
        if left.isEmpty():
            break
        seen = _read(done, now).union(left).select(F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("then"))
        now = settle(left.join(seen, "top").select("call_id", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"),
                                                   F.col("then").alias("ended")), "pointers")
        # A round in which no chain ends leaves calls on or behind cycles only.
        if now.where("ended").isEmpty():
            break
    return _read(done, now).select("call_id", "top", "steps")


def levels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(call_id, level) of the calls that no cycle keeps from having one. links: (call_id, needs), both among nodes (call_id)."""
    links = settle(links.distinct(), "needs")
    counts = settle(nodes.join(links.groupBy("call_id").agg(F.count("*").alias("n")), "call_id", "left"), "counts")
    ends = counts.where("n is null or n > 1").select("call_id")
    walked = settle(_walked(links.join(counts.where("n = 1").select("call_id"), "call_id", "left_semi"), ends), "chains")

    # What calls with several needs wait for, through chains: (call_id, needs, steps) among the ends.
    several = links.join(counts.where("n > 1").select("call_id"), "call_id", "left_semi")
    over = walked.select(F.col("call_id").alias("needs"), "top", F.col("steps").alias("more"))
    single = counts.where("n = 1").select(F.col("call_id").alias("needs"), F.lit(True).alias("chained"))
    waits = several.join(single, "needs", "left").join(over, "needs", "left")
    # A need on a chain that ends nowhere stays open for ever.
    waits = waits.select("call_id", F.when(F.col("chained") & F.col("top").isNull(), F.lit(None)).otherwise(F.coalesce("top", "needs")).alias("needs"),
                         (F.coalesce("more", F.lit(0)) + 1).alias("steps"))
    waits = settle(waits.groupBy("call_id", "needs").agg(F.max("steps").alias("steps")), "waits")
    fresh = settle(counts.where("n is null").select("call_id", F.lit(0).cast("bigint").alias("level")), "levels")
    done, best = [settle_path(fresh, "levels")], waits.select("call_id", F.lit(0).cast("bigint").alias("level")).limit(0)
    while not waits.isEmpty() and not fresh.isEmpty():
        reached = settle(waits.join(fresh.withColumnRenamed("call_id", "needs"), "needs", "left"), "reached")
        met = reached.where("level is not null").select("call_id", (F.col("level") + F.col("steps")).alias("level"))
        best = settle(best.union(met).groupBy("call_id").agg(F.max("level").alias("level")), "best")
        waits = settle(reached.where("level is null").select("call_id", "needs", "steps"), "waits")
        # A call is next when none of its needs is open any more; its last need sets its level.
        fresh = settle(best.join(waits.select("call_id").distinct(), "call_id", "left_anti"), "levels")
        best = settle(best.join(fresh.select("call_id"), "call_id", "left_anti"), "best")
        done.append(settle_path(fresh, "levels"))
    known = settle(_read(done, fresh), "levels")
    chains = walked.join(known.select(F.col("call_id").alias("top"), F.col("level").alias("base")), "top")
    return known.union(chains.select("call_id", (F.col("base") + F.col("steps")).alias("level"))).select("call_id", F.col("level").cast("int").alias("level"))


def _checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds arguments_json and problems (of the arguments alone)."""
    fields = F.sort_array(F.collect_set(F.struct("field", "type", "required")))
    tools = settle(schemas.where("name is not null").groupBy(F.col("name").alias("tool")).agg(fields.alias("fields")), "tools")
    rows = calls.join(small(tools), F.col("name") == F.col("tool"), "left")
    parsed = F.try_parse_json("arguments")
    whole = F.schema_of_variant(parsed).startswith("OBJECT")
    # Numbers are looked for between the strings.
    bare = F.regexp_replace("arguments", r'"(?:[^"\\]|\\.)*+"', '""')
    rows = rows.withColumn("inexact", F.coalesce(bare.rlike(TOO_LONG), F.lit(False)))
    rows = rows.withColumn("v", F.when(whole & ~F.col("inexact"), parsed))
    rows = rows.withColumn("members", F.from_json(F.to_json("v"), "map<string, variant>"))
    # A variant's object has its members sorted by key, and is written without white space.
    rows = rows.withColumn("arguments_json", F.coalesce(F.to_json("v"), F.lit("null")))
    rows = rows.withColumn("kinds", F.transform_values("members", lambda k, v: F.coalesce(_json_type(v), F.lit("null")))).drop("v", "members")

    def kind(field: Column) -> Column:
        return F.element_at("kinds", field["field"])

    def fits(field: Column) -> Column:
        return (kind(field) == field["type"]) | ((field["type"] == "number") & (kind(field) == "integer"))

    named = F.filter("fields", lambda f: f["field"].isNotNull())
    missing = F.transform(F.filter(named, lambda f: f["required"] & kind(f).isNull()), lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(F.filter(named, lambda f: kind(f).isNotNull() & ~fits(f)), lambda f: F.concat(F.lit("type:"), f["field"]))
    unknown = F.transform(F.array_except(F.map_keys("kinds"), F.transform(named, lambda f: f["field"])), lambda k: F.concat(F.lit("unknown:"), k))
    problems = (F.when(F.col("fields").isNull(), F.array(F.lit("no tool"))).when(F.col("inexact"), F.array(F.lit("number")))
                .when(F.col("kinds").isNull(), F.array(F.lit("no object")))
                .otherwise(F.concat(missing, wrong, F.array_sort(unknown))))
    return rows.withColumn("problems", problems).drop("tool", "fields", "kinds", "inexact")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, position, name, level, has_result, valid, errors, json.

    calls: (conv_id, call_id, position, name, arguments, depends array of call ids); results: (call_id,
    position, content); schemas: (name, field, type, required), one row for each member of a tool's
    arguments, with field null for a tool without any.
    """
    calls = settle(_one_of_each(calls), "calls")
    answer = (results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("position", "content")).alias("r"))
              .select("call_id", F.lit(True).alias("answered"), F.col("r.content").alias("content")))
    wanted = calls.select("call_id", F.explode(F.array_distinct("depends")).alias("needs")).where("needs is not null")
    known = calls.select(F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    needs = settle(wanted.join(known, "needs", "left"), "depends")
    lost = needs.where("there is null").groupBy("call_id").agg(F.sort_array(F.collect_set("needs")).alias("lost"))
    ordered = levels(needs.where("there").select("call_id", "needs"), calls.select("call_id"))

    rows = _checked(calls, schemas)
    for side in (answer, ordered, lost):
        rows = rows.join(side.hint("shuffle_hash"), "call_id", "left")
    has = F.coalesce("answered", F.lit(False))
    nothing = F.array().cast("array<string>")
    errors = F.concat("problems", F.when(~has, F.array(F.lit("no result"))).otherwise(nothing),
                      F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(nothing),
                      F.transform(F.coalesce("lost", nothing), lambda k: F.concat(F.lit("depends:"), k)))
    # to_json of a struct keeps the order of its fields, which here is that of their names.
    parts = [F.lit('{"arguments":'), "arguments_json",
             F.lit(","), _members(F.struct(F.col("call_id").alias("id"), F.coalesce("level", F.lit(-1)).alias("level"),
                                           F.coalesce("name", F.lit("")).alias("name"))), F.lit(","),
             F.when(has, _members(F.struct(F.coalesce("content", F.lit("")).alias("result")))).otherwise('"result":null'), F.lit("}")]
    return rows.select("conv_id", "call_id", "position", "name", "level", has.alias("has_result"),
                       (F.size(errors) == 0).alias("valid"), errors.alias("errors"),
                       F.concat(*[F.col(p) if isinstance(p, str) else p for p in parts]).alias("json"))


def _members(struct: Column) -> Column:
    """The members of a struct as JSON, without the braces."""
    text = F.to_json(struct)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A system or user turn is a call, of `configure` or `answer`; the assistant turn right
    after a call is its result; a call depends on the call of the turn before, or of the one before that where
    an assistant's turn is between. Rows without conv_id or turn are left out; of rows that share both the least counts.
    """
    rows = (conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn")
            .agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text"))
    rows = settle(rows, "turns")

    def call_id(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    turn = F.col("turn")
    arguments = F.to_json(F.struct("turn", F.col("text"), F.col("role")))
    calls = rows.where("role in ('system', 'user')").withColumn("before", call_id(turn - 1)).withColumn("earlier", call_id(turn - 2))
    there = rows.where("role in ('system', 'user')").select(call_id(turn).alias("call"))
    spoken = rows.where("role = 'assistant'").select(call_id(turn).alias("said"))
    calls = calls.join(there.withColumnRenamed("call", "c1"), F.col("before") == F.col("c1"), "left")
    calls = calls.join(there.withColumnRenamed("call", "c2"), F.col("earlier") == F.col("c2"), "left")
    calls = calls.join(spoken, F.col("before") == F.col("said"), "left")
    depends = F.array_compact(F.array(F.coalesce("c1", F.when(F.col("said").isNotNull(), F.col("c2")))))
    calls = calls.select("conv_id", call_id(turn).alias("call_id"), turn.cast("bigint").alias("position"),
                         F.when(F.col("role") == "system", "configure").otherwise("answer").alias("name"), arguments.alias("arguments"),
                         depends.alias("depends"))
    results = rows.where("role = 'assistant'").select(call_id(turn - 1).alias("call_id"), turn.cast("bigint").alias("position"),
                                                      F.col("text").alias("content"))
    return calls, results


#: (name, field, type, required) of the two tools that chat_calls writes.
CHAT_SCHEMAS = (("configure", "role", "string", True), ("configure", "text", "string", True), ("configure", "turn", "integer", True),
                ("answer", "role", "string", True), ("answer", "text", "string", True), ("answer", "turn", "integer", True))


def json_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations (conv_id, turn, role, text) hold as JSON texts.

    An assistant's text that is an object with `tool_calls`, a list of objects, makes a call of each: `id`; `name` and
    `arguments`, or both inside `function`, the arguments as an object or as text; `depends_on`, a list of ids. A tool's text that is an object with
    `tool_call_id` is a result, its `content` as text. Calls of one conversation are told apart from those of others by conv_id, which
    becomes part of the id. Other texts make neither; rows without conv_id are left out.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("bigint").alias("position"), "role", F.try_parse_json("text").alias("v"))
    rows = rows.where("v is not null")

    def own(call_id: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit("/"), call_id)

    def text(value: Column) -> Column:
        """A JSON string's text, and other JSON as it is written."""
        return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", value.try_cast("string")), F.to_json(value))

    each = rows.where("role = 'assistant'").select("conv_id", "position", F.explode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("c"))
    part = {p: F.try_variant_get("c", f"$.{p}", "variant") for p in ("id", "name", "arguments", "function.name", "function.arguments")}
    needs = F.try_variant_get("c", "$.depends_on", "array<string>")
    calls = each.select("conv_id", own(text(part["id"])).alias("call_id"), "position", F.coalesce(text(part["name"]), text(part["function.name"])).alias("name"),
                        F.coalesce(text(part["arguments"]), text(part["function.arguments"])).alias("arguments"),
                        F.transform(F.coalesce(needs, F.array().cast("array<string>")), lambda n: own(n)).alias("depends"))
    results = rows.where("role = 'tool'").select(own(text(F.try_variant_get("v", "$.tool_call_id", "variant"))).alias("call_id"), "position",
                                                 text(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    return calls, results.where("call_id is not null")
