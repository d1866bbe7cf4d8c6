"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, further ones included.

Rows with nulls in any column, empty texts and repeated rows go through every stage; each stage says what becomes
of them. A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bpe_chunks, line_dedup, mixing, near_dedup, toxicity
from gradeloom.llm.cluster import table, written

#: SQL can't express the trained classifier, the raking and the tokeniser; tests/llm/test_edges_and_recall.py holds each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity reaches 0.3; the classifier learns from the labelled ones among ``docs``.

    Null and empty texts get the model's bias. A model that learnt no feature, as without labels of both classes,
    rejects nothing. Repeated rows are judged alike; a row without id is judged by its text.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not model.weights:
        return docs
    return toxicity.score_documents(docs, model, score="_toxicity").where("_toxicity < 0.3").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; n_chars follows. A document left without text stays, empty.

    Null texts stay null, with a null n_chars. Rows equal in id and text are one document and keep the same lines.
    """
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays: the one with the smallest id.

    Documents without words and rows without id all stay. Rows that share an id that stays are kept, each text
    once; of rows equal in id and text the one that is least in the other columns.
    """
    groups = near_dedup.near_groups(docs.select("doc_id", "text"), percent=80)
    kept = written(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows")), "kept")
    stay = docs.join(kept, "doc_id").select(*docs.columns, "_rows")
    if kept.where("_rows > 1").limit(1).count():  # rows that share a kept id: each of their texts stays once
        rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
        once = stay.where("_rows > 1").groupBy("doc_id", "text").agg(F.min(rest).alias("_rest")).select("doc_id", "text", "_rest.*")
        stay = stay.where("_rows = 1").select(*docs.columns).unionByName(once.select(*docs.columns))
    return stay.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of source, language and topic.

    Null sources and languages are categories of their own. Documents without words are in cells without tokens, if all
    of their cell are: those go, unless no document has any. Repeated rows are sampled alike.
    """
    return mixing.mix(docs).where("_mix.sampled").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256 and ids of every row; a null text counts as empty."""
    return bpe_chunks.encode_documents(docs, carry=("doc_id", "source", "lang"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
