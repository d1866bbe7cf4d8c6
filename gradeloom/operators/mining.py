"""Mining of traces: what tools got and returned, regions by outcome, flags on steps, grounding of arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses and words of failure, and what a tool's name and arguments say about its kind.
FAIL_STATUSES = ("error", "failed", "failure", "timeout", "permission_denied", "denied", "not_found", "rejected", "unknown_tool")
FAIL_TEXT = r"(?i)^\s*(error|traceback|failed|denied|timeout|exception)\b"
KINDS = ("read", "write", "delete", "command")
KIND_BY_NAME = (
    ("delete", r"(?i)delete|remove|\brm\b|unlink|drop"),
    ("command", r"(?i)run|exec|shell|bash|command|terminal|subprocess|sh$"),
    ("write", r"(?i)write|edit|create|save|put|patch|replace|append|update_file|insert"),
    ("read", r"(?i)read|cat|open|view|get_file|show|load|list"),
)
PATH_KEYS = ("path", "file_path", "filepath", "file", "filename", "target", "target_file")
CONTENT_KEYS = ("content", "contents", "new_string", "new_str", "text", "data", "body", "code")
COMMAND_KEYS = ("command", "cmd", "script", "shell")


def step_failed(result: Column, failed: Column | None = None, error: Column | None = None) -> Column:
    """A flag or error of the step's own, else a result (JSON or text) with a failing status, an error, an exit code other than 0, or an error word at its start.

    Of exit_code, returncode and code the first that is there counts, if it is a whole number.
    """
    key = lambda k: F.get_json_object(result, f"$.{k}")
    status = F.lower(F.coalesce(key("status"), F.lit("")))
    code = F.coalesce(key("exit_code"), key("returncode"), key("code"))
    exits = F.when(F.rlike(code, F.lit(r"^-?\d+$")), code.try_cast("long") != 0)
    wrong = ~F.coalesce(key("error"), F.lit("")).isin("", "false", "0", "null", "[]", "{}")
    found = status.isin(*FAIL_STATUSES) | wrong | F.coalesce(exits, F.lit(False)) | F.coalesce(F.rlike(result, F.lit(FAIL_TEXT)), F.lit(False))
    if failed is not None:
        found = F.coalesce(failed, F.lit(False)) | found
    if error is not None:
        found = F.coalesce(error != "", F.lit(False)) | found
    return found


def _argument(arguments: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds a text other than blanks."""
    texts = [F.get_json_object(arguments, f"$.{k}") for k in keys]
    return F.coalesce(*(F.when(F.trim(t) != "", t) for t in texts))


def step_kind(tool: Column, arguments: Column | None = None, kinds: dict[str, str] | None = None) -> Column:
    """What a call did: read, write, delete, command, or null for none of them.

    ``kinds`` settles tools by name; one that isn't a known kind is none. Else the arguments decide first (a command
    is a command, a path with content a write) and the name breaks the tie.
    """
    by_name = F.coalesce(*(F.when(F.rlike(tool, F.lit(p)), k) for k, p in KIND_BY_NAME), F.lit(None).cast("string"))
    has = lambda keys: _argument(arguments, keys).isNotNull() if arguments is not None else F.lit(False)
    path = has(PATH_KEYS)
    found = (
        F.when(has(COMMAND_KEYS) & (by_name.isNull() | (by_name == "command")), "command").when((by_name == "delete") & path, "delete").when(path & has(CONTENT_KEYS), "write")
        .when(by_name.isin("write", "delete", "command"), by_name).when(path, "read").otherwise(by_name)
    )
    for name, kind in (kinds or {}).items():
        found = F.when(tool == name, F.lit(kind if kind in KINDS else None).cast("string")).otherwise(found)
    return found


def called(tool: Column, arguments: Column, result: Column, kinds: dict[str, str] | None = None) -> Column:
    """A call as the flags read it: struct of kind, command, path, content, failed."""
    return F.struct(step_kind(tool, arguments, kinds).alias("kind"), _argument(arguments, COMMAND_KEYS).alias("command"), _argument(arguments, PATH_KEYS).alias("path"), _argument(arguments, CONTENT_KEYS).alias("content"), step_failed(result).alias("failed"))


def tool_arguments(calls: DataFrame, *, tool: str = "tool", arguments: str = "arguments") -> DataFrame:
    """(tool, argument, calls): the argument names that each tool was called with."""
    names = F.explode(F.json_object_keys(arguments)).alias("argument")
    return calls.select(F.col(tool).alias("tool"), names).groupBy("tool", "argument").agg(F.count("*").alias("calls"))


def exemplars(results: DataFrame, *, tool: str, result: str, order: list[str], per_tool: int = 3, max_chars: int = 2000) -> DataFrame:
    """The first results of each tool whose sets of keys differ, none failed, none too long.

    The first of each shape is found by a partial aggregation, so a busy tool's results aren't ranked together.
    """
    good = results.where(~step_failed(F.col(result)) & (F.length(result) <= max_chars))
    shape = F.array_join(F.array_sort(F.coalesce(F.json_object_keys(result), F.array(F.lit("text")))), ",")
    place = F.struct(*order)
    first = good.groupBy(F.col(tool).alias("tool"), shape.alias("shape")).agg(F.min(place).alias("_at"), F.min_by(result, place).alias("result"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("tool").orderBy("_at"))).where(F.col("k") <= per_tool).drop("_at")


def regions(rows: DataFrame, *, region: str, failed: str, late: str, min_support: int = 3, exploration: float = 0.2) -> DataFrame:
    """Per region: rows and fail rates early and late, what became of it, a shrunk priority and its share of the budget."""
    n = lambda x: F.sum(x.cast("long"))
    bad, new = F.col(failed), F.col(late)
    out = rows.groupBy(F.col(region).alias("region")).agg(F.count("*").alias("support"), n(~new).alias("n0"), n(new).alias("n1"), n(bad & ~new).alias("f0"), n(bad & new).alias("f1"))
    out = out.withColumns({"early": F.try_divide(F.col("f0"), F.col("n0")), "late": F.try_divide(F.col("f1"), F.col("n1"))})
    status = (
        F.when(F.col("support") < min_support, "uncertain").when((F.col("f0") == 0) & (F.col("f1") == 0), "passing").when(F.col("f1") == 0, F.when(F.col("n1") > 0, "solved").otherwise("uncertain"))
        .when(F.coalesce(F.col("f0"), F.lit(0)) == 0, "new").when(F.col("late") < F.col("early"), "improving").otherwise("persistent")
    )
    weight = F.when(F.col("status") == "new", 1.0).when(F.col("status") == "persistent", 0.9).when(F.col("status") == "improving", 0.6).when(F.col("status") == "uncertain", 0.4).otherwise(0.0)
    fails = F.col("f0") + F.col("f1")
    priority = weight * F.least(F.lit(1.0), 0.5 + 0.5 * F.least(fails, F.lit(6)) / 6) * (0.25 + 0.75 * (fails + 1) / (F.col("support") + 2))
    out = out.withColumn("status", status).withColumn("priority", priority)
    total = out.agg(F.sum("priority").alias("_p"))
    return out.join(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide((1 - F.lit(exploration)) * F.col("priority"), F.col("_p")), F.lit(0.0))).drop("_p", "n0", "n1", "f0", "f1")


def ungrounded(values: Column, context: Column, least: int = 3) -> Column:
    """The values of an array that the context doesn't hold, nor without white space, ``_`` and ``-`` on both sides."""
    plain = F.lower(F.coalesce(context, F.lit("")))
    bare = lambda x: F.regexp_replace(F.lower(x), r"[\s_-]", "")
    return F.filter(values, lambda v: (F.length(v) >= least) & ~F.contains(plain, F.lower(v)) & ~F.contains(bare(context), bare(v)))


def region_weight(count: Column, risk: Column, novelty: Column, behaviour: Column, *, alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.5, delta: float = 0.5) -> Column:
    """alpha / (1 + count)^2 + beta risk + gamma novelty + delta behaviour, to six places."""
    return F.round(alpha / F.pow(1 + count, F.lit(2.0)) + beta * risk + gamma * novelty + delta * behaviour, 6)


def copies_missing(counts: DataFrame, count: str, copies: int) -> DataFrame:
    """How many rows are missing until every cell has ``copies``."""
    return counts.agg(F.sum(F.greatest(F.lit(0), F.lit(copies) - F.col(count))).cast("long").alias("missing"), F.count("*").alias("cells"))
