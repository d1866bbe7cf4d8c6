"""Trace spans to conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attributes(entries: str):
    """An OTLP list of key and string value as a map; the last of a key wins."""
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k, F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(-1))["value"]["stringValue"])))


def conversations(spans: DataFrame, *, conversation: str, start: str, kind: str, key: str, fault: str = "error", value: str = "value") -> DataFrame:
    """One row a conversation: its spans, faults, first and last kind and summed value, without gathering its spans."""
    at = F.struct(F.col(start), F.col(key))
    return spans.groupBy(conversation).agg(
        F.count("*").alias("spans"), F.sum((F.col(kind) == fault).cast("long")).alias("faults"),
        F.min_by(kind, at).alias("first_kind"), F.max_by(kind, at).alias("last_kind"), F.round(F.sum(value), 4).alias("total_value"),
    )


def otlp_rows(spans: DataFrame, *, conversation_key: str = "gen_ai.conversation.id") -> DataFrame:
    """(conversation, prompt, steps, final_text, input_tokens, output_tokens) of spans with trace_id, name, start, attrs (map).

    A conversation id anywhere in a trace claims the whole trace, else the trace stands for itself. Spans go by start time;
    the first user text is the prompt, spans with a tool name are the steps, the last output text the final one.
    """
    ids = spans.select("trace_id", F.col("attrs")[conversation_key].alias("c")).where("c IS NOT NULL").groupBy("trace_id").agg(F.min("c").alias("conversation"))
    met = spans.join(ids, "trace_id", "left").withColumn("conversation", F.coalesce("conversation", "trace_id"))
    get = lambda k: F.col("attrs")[k]
    step = F.when(get("gen_ai.tool.name").isNotNull(), F.struct(F.col("start"), get("gen_ai.tool.name").alias("tool"), get("gen_ai.tool.arguments").alias("arguments"), get("gen_ai.tool.result").alias("result")))
    count = lambda k: F.sum(F.coalesce(get(k).try_cast("long"), F.lit(0)))
    out = met.groupBy("conversation").agg(
        F.min_by(get("gen_ai.prompt"), F.when(get("gen_ai.prompt").isNotNull(), F.col("start"))).alias("prompt"),
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.max_by(get("gen_ai.completion"), F.when(get("gen_ai.completion").isNotNull(), F.col("start"))).alias("final_text"),
        count("gen_ai.usage.input_tokens").alias("input_tokens"), count("gen_ai.usage.output_tokens").alias("output_tokens"),
    )
    return out
