"""Gates on single rollouts: reward predicates, why a row can't be trained on, endings, faults.

A row has the columns prompt, final_text, reward, and where they exist label_source, steps (array of struct with
tool, result, text and truncated), messages (array of struct with role and content) and others named in the functions.
``columns`` are the names that a row has; what isn't there is taken as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import looks_finished

# Patterns, statuses and lengths that define the gates.
STRONG_ACTION = r"(?i)\b(merge|refund|schedule|commit|deploy|rebase|checkout)\b"
IDISH = r"(?i)\b([A-Z]{2,}[-_]\d+|#\d+|asin\b|ord[-_]\w+|pr\s*#?\s*\d+)\b"
INFRA_STUB = r"(?i)^<agent error:|returned\s+[45]\d\d\b|^(https?://\S+\s+)?[45]\d\d(\s|$)"
DEGENERATE = r"(.)\1{29,}"
HARNESS_LEAK = r"(?i)<USER_TURN>|\b(scene brief|scenario_dimensions|world_state|situation card|region_id)\b"
TOOL_MARKUP = r"(?i)</?tool_call>"
SCHEMA_DUMP = r"(?is)\"name\"\s*:\s*\"[^\"]+\".{0,500}\"description\"\s*:.{0,500}\"parameters\"\s*:"
QUESTION_END = r"\?\s*$"
VERIFIED_SOURCES = ("claude", "gold")
FAULT_STATUSES = ("error", "timeout", "not_found", "denied", "malformed")
NO_WORLD = ("unspecified", "unknown")
REPLY_CAP = 600
PASS_THRESHOLD = 0.5


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def _get(columns: list[str], name: str, kind: str = "string") -> Column:
    return F.col(name) if name in columns else F.lit(None).cast(kind)


def _some(columns: list[str], name: str, test) -> Column:
    """Whether an element of the array passes the test; not where there is no array."""
    return F.coalesce(F.exists(F.col(name), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False)) if name in columns else F.lit(False)


# -- rewards ------------------------------------------------------------------------------------------


def _rewards(columns: list[str], names: tuple[str, ...]) -> list[Column]:
    return [F.col(n).cast("double") for n in names if n in columns]


def binary_label(columns: list[str], names: tuple[str, ...] = ("reward", "fallback_reward")) -> Column:
    """The first of the rewards that is exactly 0 or 1, as int."""
    return F.coalesce(*(F.when(r.isin(0.0, 1.0), r.cast("int")) for r in _rewards(columns, names)), F.lit(None).cast("int"))


def scalar_reward(columns: list[str], names: tuple[str, ...] = ("reward", "fallback_reward")) -> Column:
    """The first of the rewards that is a number."""
    return F.coalesce(*(F.when(~F.isnan(r), r) for r in _rewards(columns, names)), F.lit(None).cast("double"))


def graded_reward(columns: list[str], names: tuple[str, ...] = ("reward", "fallback_reward")) -> Column:
    """The first of the rewards that is a finite number; partial scores are graded too."""
    return F.coalesce(*(F.when(~F.isnan(r) & (F.abs(r) != float("inf")), r) for r in _rewards(columns, names)), F.lit(None).cast("double"))


def in_reward_range(reward: Column, lo: float, hi: float, *, inclusive: bool = True) -> Column:
    return F.coalesce(reward.between(lo, hi) if inclusive else (reward > lo) & (reward < hi), F.lit(False))


def reward_views(rows: DataFrame) -> DataFrame:
    """How many rows pass, fail, are partial, unjudged, come from an evaluation; and whether all graded rows agree on one value.

    A partial row has a number but no binary label in any reward. Two graded rows are the least that can agree.
    """
    c = rows.columns
    n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    reward, label, graded = _get(c, "reward", "double").cast("double"), binary_label(c), graded_reward(c)
    out = rows.agg(
        F.count("*").alias("n"), n(reward == 1).alias("passes"), n(reward == 0).alias("failures"), n((reward > 0) & (reward < 1)).alias("partials"),
        n(graded.isNotNull() & label.isNull()).alias("partial_only"), n(~_get(c, "judge_status").eqNullSafe(F.lit("ok"))).alias("unjudged"),
        n(_get(c, "lineage_source") == "eval").alias("eval_sourced"), n(graded.isNotNull()).alias("graded"), F.min(graded).alias("_lo"), F.max(graded).alias("_hi"),
    )
    return out.withColumn("degenerate", F.coalesce((F.col("graded") >= 2) & (F.col("_lo") == F.col("_hi")), F.lit(False))).drop("_lo", "_hi")


# -- what a row holds -----------------------------------------------------------------------------------


def has_tool_call(columns: list[str]) -> Column:
    """A step with a tool, or where the row has the array ``tool_calls``, an element of it."""
    listed = F.coalesce(F.size("tool_calls") > 0, F.lit(False)) if "tool_calls" in columns else F.lit(False)
    return _some(columns, "steps", lambda s: s["tool"] != "") | listed


def wants_tools(columns: list[str]) -> Column:
    """Whether the situation asks for something to be done: by its stamps, else by what the prompt says."""
    world = _get(columns, "world_state")
    stamped = _get(columns, "tool_known", "boolean").cast("boolean") | (_get(columns, "ask_family") == "tool") | (F.length(_get(columns, "faults")) > 0) | ((F.length(world) > 0) & ~world.isin(*NO_WORLD))
    return F.coalesce(stamped, F.lit(False)) | _has(_get(columns, "prompt"), STRONG_ACTION) | _has(_get(columns, "prompt"), IDISH)


def is_do_nothing(columns: list[str], *, has_tools: bool = True) -> Column:
    """An ask for action without a tool call; never for an agent without tools."""
    return wants_tools(columns) & ~has_tool_call(columns) if has_tools else F.lit(False)


def visible_text(columns: list[str]) -> Column:
    """The reply, the agent's turns in the steps and in the messages, by line."""
    parts = [F.array(F.coalesce(_get(columns, "final_text"), F.lit("")))]
    if "steps" in columns:
        parts.append(F.coalesce(F.filter(F.transform("steps", lambda s: s["text"]), lambda t: F.coalesce(t != "", F.lit(False))), F.array().cast("array<string>")))
    if "messages" in columns:
        said = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
        parts.append(F.coalesce(said, F.array().cast("array<string>")))
    return F.array_join(F.concat(*parts), "\n")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def is_incomplete_junk(columns: list[str]) -> Column:
    """Empty, an error in place of a reply, leaked or raw markup, cut, or a conversation that doesn't end on the agent."""
    final, tool = _stripped(_get(columns, "final_text")), has_tool_call(columns)
    shown = visible_text(columns)
    overlong = F.coalesce(_get(columns, "overlong", "boolean"), F.lit(False))
    junk = (final == "") | F.startswith(F.lower(final), F.lit("<agent error")) | (~tool & _has(final, INFRA_STUB)) | _has(final, DEGENERATE) | _has(final, HARNESS_LEAK) | _has(shown, TOOL_MARKUP) | _has(shown, SCHEMA_DUMP)
    junk = junk | ((F.length(final) > REPLY_CAP) & ~looks_finished(final) & ~overlong)
    stub = ~tool & _has(final, QUESTION_END) & (F.size(F.filter(F.split(_stripped(_get(columns, "prompt")), r"\s+"), lambda w: w != "")) <= 2)
    if "messages" not in columns:
        return junk | stub
    last = F.try_element_at(F.col("messages"), F.lit(-1))["role"]
    ends = F.when(F.coalesce(F.size("messages"), F.lit(0)) < 1, ~tool).otherwise(F.coalesce(last.isin("user", "tool"), F.lit(False)) | stub)
    return junk | ends


def is_unusable_label(columns: list[str]) -> Column:
    return binary_label(columns).isNull()


def is_verified_zero(columns: list[str]) -> Column:
    """Reward 0 from a label source that is trusted."""
    source = F.lower(F.coalesce(_get(columns, "label_source"), F.lit("")))
    trusted = F.lit(False)
    for prefix in VERIFIED_SOURCES:
        trusted = trusted | F.startswith(source, F.lit(prefix))
    return F.coalesce(_get(columns, "reward", "double").cast("double") == 0, F.lit(False)) & trusted


def has_content(columns: list[str]) -> Column:
    """A tool call, a reply or an agent's turn: something to train on."""
    spoken = _some(columns, "messages", lambda m: (m["role"] == "assistant") & (m["content"] != ""))
    return has_tool_call(columns) | (_stripped(_get(columns, "final_text")) != "") | spoken


def drop_reason(columns: list[str], *, has_tools: bool = True, text_gates: bool = True) -> Column:
    """The first reason to drop a row, null to keep it.

    A verified zero with content passes, whatever it says: it is the failure to learn from. Then junk, then
    doing nothing where no label says otherwise, then no usable label. ``text_gates=False`` asks for the label only.
    """
    text = F.lit(text_gates)
    return (
        F.when(is_verified_zero(columns) & has_content(columns), None).when(text & is_incomplete_junk(columns), "incomplete_junk")
        .when(text & binary_label(columns).isNull() & is_do_nothing(columns, has_tools=has_tools), "do_nothing").when(is_unusable_label(columns), "unusable_label")
    )


def filter_rows(rows: DataFrame, *, has_tools: bool = True, text_gates: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, (reason, n) of what went, and ``kept_verified_zero`` for zeros that stay against a gate)."""
    c = rows.columns
    told = rows.withColumn("_why", drop_reason(c, has_tools=has_tools, text_gates=text_gates))
    spared = F.col("_why").isNull() & is_verified_zero(c) & (is_incomplete_junk(c) | is_do_nothing(c, has_tools=has_tools))
    report = told.select(F.coalesce("_why", F.when(spared, "kept_verified_zero"), F.lit("kept")).alias("why")).groupBy("why").agg(F.count("*").alias("n"))
    return told.where("_why IS NULL").drop("_why"), report


def lost_reason(columns: list[str]) -> Column:
    """Why a finished rollout is no row: agent_error, empty_reply, tool_markup, or null."""
    final, shown = _stripped(_get(columns, "final_text")), visible_text([c for c in columns if c != "messages"])
    return F.when(F.startswith(F.lower(final), F.lit("<agent error")), "agent_error").when(final == "", "empty_reply").when(_has(shown, TOOL_MARKUP) | _has(shown, SCHEMA_DUMP), "tool_markup")


def fault_worthy(columns: list[str]) -> Column:
    """A planned fault, or a step whose result has a fault's status; no reward is looked at."""
    status = lambda s: F.lower(F.get_json_object(s["result"], "$.status")).isin(*FAULT_STATUSES)
    return F.coalesce(F.length(_get(columns, "faults")) > 0, F.lit(False)) | _some(columns, "steps", status)


def flawed(columns: list[str]) -> Column:
    """An observed fault or the label 0."""
    return fault_worthy([c for c in columns if c != "faults"]) | F.coalesce(binary_label(columns) == 0, F.lit(False))


def failed_criteria(markers: Column, threshold: float = PASS_THRESHOLD) -> Column:
    """Names of a map's markers below the threshold, in order."""
    return F.array_sort(F.map_keys(F.map_filter(markers, lambda _, v: v < threshold)))
