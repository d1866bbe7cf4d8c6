"""Rows in and out: JSON lines, shapes, validation, trace exports to canonical rows, trainer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ordered spellings of the same thing in trace exports; the first that is filled wins.
PROMPT_KEYS = ("prompt", "question", "input", "task", "ask")
STEP_KEYS = ("steps", "tool_trace", "trace")
FINAL_KEYS = ("final_text", "final", "output", "response", "answer")
VERSION = "1"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines with a given schema; without one, each line as ``variant`` (null where it isn't JSON) beside its text."""
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("variant"), "value")


def write_jsonl(rows: DataFrame, path: str, *, files: int | None = None) -> None:
    """JSON lines, a file a partition; ``files`` only for exports that are small."""
    (rows if files is None else rows.coalesce(files)).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def first_filled(columns: list[str], names: tuple[str, ...]) -> Column:
    there = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def detect_shape(columns: list[str]) -> Column:
    """Which known shape a row has; the first rule that fits wins."""
    there = lambda c: F.col(c).isNotNull() if c in columns else F.lit(False)
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) if c in columns else F.lit(False)
    packed = F.lit(False)
    for c in columns:
        if c.endswith("_json"):
            packed = packed | F.col(c).isNotNull()
    return (
        F.when(there("schema_version"), "v1").when(packed, "hf_flat").when(filled("messages") & ~filled("steps") & ~there("final_text"), "training")
        .when(there("scenario_id"), "engine").when(there("tool_trace") & ~filled("steps"), "platform_pull").when(there("conversation_id"), "otel").otherwise("loose")
    )


def problems(columns: list[str], kind: str = "rollout") -> Column:
    """Problem codes of a row as an array, empty where it is fine."""
    codes = []
    if "schema_version" in columns:
        codes.append(F.when(F.col("schema_version").isNotNull() & ~F.col("schema_version").isin("0", VERSION), "unknown_schema_version"))
    if "reward" in columns:
        codes.append(F.when(F.col("reward").isNotNull() & F.col("reward").cast("string").try_cast("double").isNull(), "reward_not_number"))
    if kind == "training":
        codes.append(F.when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "messages_missing") if "messages" in columns else F.lit("messages_missing"))
        if "messages" in columns:
            codes.append(F.when(F.exists("messages", lambda m: m["role"].isNull()), "message_without_role"))
        if {"loss_mask", "messages"} <= {*columns}:
            codes.append(F.when(F.col("loss_mask").isNotNull() & (F.size("loss_mask") != F.size("messages")), "loss_mask_invalid"))
    if kind == "preference":
        codes += [F.when(F.col(c).isNull(), f"{c}_missing") if c in columns else F.lit(f"{c}_missing") for c in ("chosen", "rejected")]
    return F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")


#: A step of a trajectory: what the user said, what the agent said, or a tool call with its result.
STEP = "struct<user:string,text:string,tool:string,arguments:string,result:string>"


def steps_from_messages(messages: str) -> Column:
    """Steps of chat messages (array of struct of role, content, name, tool_call_id and tool_calls: array of struct of id, name, arguments).

    A user's message is a step, an agent's message its calls and then its text. A tool's answer goes to the call of its id,
    else to the first call of its name without a result, else to the first call without one; an answer that no call asked for is a step
    of its own. The walk is a fold over one conversation's messages.
    """
    none = F.lit(None).cast("string")
    step = lambda user, text, tool, arguments, result, call: F.struct(user.alias("user"), text.alias("text"), tool.alias("tool"), arguments.alias("arguments"), result.alias("result"), call.alias("call"))
    kind = STEP.replace(">", ",call:string>")
    empty = F.array().cast(f"array<{kind}>")
    filled = lambda x: F.coalesce(x, F.lit("")) != ""

    def answer(done: Column, m: Column) -> Column:
        free = lambda x: x["tool"].isNotNull() & x["result"].isNull()
        first = lambda test: F.array_position(F.transform(done, lambda x: F.coalesce(free(x) & test(x), F.lit(False))), True)
        by_id = F.when(filled(m["tool_call_id"]), first(lambda x: x["call"] == m["tool_call_id"])).otherwise(0)
        by_name = F.when(filled(m["name"]), first(lambda x: x["tool"] == m["name"])).otherwise(0)
        at = F.coalesce(F.nullif(by_id, F.lit(0)), F.nullif(by_name, F.lit(0)), first(lambda _: F.lit(True)))
        content = F.coalesce(m["content"], F.lit(""))
        own = step(none, none, F.coalesce(m["name"], F.lit("")), F.lit("{}"), content, none)
        put = F.transform(done, lambda x, i: F.when(i + 1 == at, step(x["user"], x["text"], x["tool"], x["arguments"], content, x["call"])).otherwise(x))
        return F.when(at > 0, put).otherwise(F.concat(done, F.array(own)))

    def walk(done: Column, m: Column) -> Column:
        calls = F.coalesce(F.transform(m["tool_calls"], lambda c: step(none, none, F.coalesce(c["name"], F.lit("")), F.coalesce(c["arguments"], F.lit("{}")), none, F.nullif(c["id"], F.lit("")))), empty)
        said = F.when(filled(m["content"]), F.array(step(none, m["content"], none, none, none, none))).otherwise(empty)
        return (
            F.when(m["role"] == "user", F.concat(done, F.array(step(F.coalesce(m["content"], F.lit("")), none, none, none, none, none))))
            .when(m["role"] == "assistant", F.concat(done, calls, said)).when(m["role"] == "tool", answer(done, m)).otherwise(done)
        )

    walked = F.aggregate(F.coalesce(F.col(messages), F.filter(F.col(messages), lambda _: F.lit(False))), empty, walk)
    return F.transform(walked, lambda x: F.struct(*(x[c].alias(c) for c in ("user", "text", "tool", "arguments", "result"))))


def load_traces(rows: DataFrame) -> DataFrame:
    """prompt, steps, final_text and reward, whatever they were called; every other column is carried.

    Steps are the first of ``STEP_KEYS`` that holds any (arrays of ``STEP``), else those of ``messages``. Without a prompt the first
    user step asks; without a reply the last agent step is it. A reward other than 0 or 1 is null. Rows with neither ask nor steps go.
    """
    columns = rows.columns
    reward = F.col("reward").cast("string").try_cast("double") if "reward" in columns else F.lit(None).cast("double")
    empty = F.array().cast(f"array<{STEP}>")
    held = [F.when(F.size(c) > 0, F.col(c).cast(f"array<{STEP}>")) for c in STEP_KEYS if c in columns]
    steps = F.coalesce(*held, *([steps_from_messages("messages")] if "messages" in columns else []), empty)
    rest = [F.col(f"`{c}`") for c in columns if c not in (*PROMPT_KEYS, *STEP_KEYS, *FINAL_KEYS, "reward")]
    out = rows.select(*rest, first_filled(columns, PROMPT_KEYS).alias("prompt"), steps.alias("steps"), first_filled(columns, FINAL_KEYS).alias("final_text"), F.when(reward.isin(0.0, 1.0), reward).alias("reward"))
    asked = F.try_element_at(F.filter("steps", lambda s: s["user"].isNotNull()), F.lit(1))["user"]
    said = F.try_element_at(F.filter("steps", lambda s: s["text"].isNotNull()), F.lit(-1))["text"]
    out = out.withColumn("prompt", F.coalesce("prompt", asked, F.lit(""))).withColumn("final_text", F.coalesce("final_text", said, F.lit("")))
    return out.where((F.col("prompt") != "") | (F.size("steps") > 0))


def bind_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv, at, tool, arguments, result): each call with its result by call id, else the next free one of the same tool.

    Results that no call asked for become steps of their own. Both sides are ranked among what the id didn't
    bind, so a conversation's steps are joined, not walked through.
    """
    by_id = calls.join(results.where("call_id IS NOT NULL").select("conv", "call_id", F.col("at").alias("_rat"), "result"), ["conv", "call_id"], "left")
    bound = by_id.where("_rat IS NOT NULL").select("conv", "at", "tool", "arguments", "result", "_rat")
    rank = lambda df: df.withColumn("_k", F.row_number().over(_window("conv", "tool", "at")))
    loose_calls = rank(by_id.where("_rat IS NULL").select("conv", "at", "tool", "arguments"))
    loose_results = rank(results.join(bound.select("conv", F.col("_rat").alias("at")), ["conv", "at"], "left_anti").select("conv", "at", "tool", "result"))
    met = loose_calls.join(loose_results.withColumnRenamed("at", "_rat"), ["conv", "tool", "_k"], "full_outer")
    return bound.drop("_rat").unionByName(met.select("conv", F.coalesce("at", "_rat").alias("at"), "tool", "arguments", "result"))


def _window(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns[:-1]).orderBy(columns[-1])


def from_parallel(rows: DataFrame, *, prompt: str = "prompt", completions: str = "completions", rewards: str = "rewards") -> DataFrame:
    """One row a completion of arrays that run in parallel; arrays of unequal length and rewards outside [0, 1] raise an error."""
    zipped = F.arrays_zip(F.col(completions).alias("final_text"), F.col(rewards).alias("reward"))
    out = rows.where(F.when(F.size(completions) != F.size(rewards), F.raise_error(F.lit("completions and rewards differ in length")).cast("boolean")).otherwise(F.lit(True)))
    out = out.select(*(c for c in rows.columns if c not in (completions, rewards)), F.posexplode(zipped).alias("rollout_index", "_z")).select("*", "_z.final_text", "_z.reward").drop("_z")
    return out.where(F.when(~F.col("reward").between(0, 1), F.raise_error(F.lit("reward outside [0, 1]")).cast("boolean")).otherwise(F.lit(True)))


def training_rows(rows: DataFrame, *, system_prompt: str | None = None, strip_think: bool = True, mask_mode: str = "assistant", max_tool_chars: int | None = None) -> DataFrame:
    """Rows for a trainer: the system prompt first, reasoning markup out, tool output capped, a loss mask for each message."""
    from gradeloom.operators.trajectories import loss_mask

    def clean(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        if strip_think:
            content = F.when(m["role"] == "assistant", F.trim(F.regexp_replace(content, r"(?is)<think>.*?</think>", ""))).otherwise(content)
        if max_tool_chars is not None:
            long = (m["role"] == "tool") & (F.length(content) > max_tool_chars)
            cut = F.concat(F.substring(content, 1, max_tool_chars), F.lit(" [cut "), (F.length(content) - max_tool_chars).cast("string"), F.lit(" characters]"))
            content = F.when(long, cut).otherwise(content)
        return F.struct(m["role"].alias("role"), content.alias("content"))

    messages = F.transform("messages", clean)
    if system_prompt is not None:
        head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
        messages = F.when(F.exists("messages", lambda m: m["role"] == "system"), messages).otherwise(F.concat(head, messages))
    return rows.withColumn("messages", messages).withColumn("loss_mask", loss_mask("messages", mask_mode))


def tool_call_roundtrip(calls: DataFrame, arguments: str = "arguments") -> DataFrame:
    """How many exported tool calls were looked at and how many have arguments that aren't JSON objects."""
    ok = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(arguments)), F.lit("OBJECT")), F.lit(False))
    return calls.agg(F.count("*").alias("checked"), F.sum((~ok).cast("long")).alias("broken"))


def preference_rows(pairs: DataFrame, *, drop_ties: bool = True) -> DataFrame:
    """(prompt, chosen, rejected) of pairs for a preference trainer; judged ties go, and so do pairs whose sides are equal."""
    out = pairs.where("chosen IS NOT NULL AND rejected IS NOT NULL AND chosen <> rejected")
    if drop_ties and "winner" in pairs.columns:
        out = out.where("winner IS NULL OR winner <> 'tie'")
    return out.select("prompt", "chosen", "rejected")
