"""A corpus pipeline of five operators: toxicity, exact and near deduplication, personal data, packing.

Each stage takes (spark, docs, sf_dir); run() writes each stage's rows to the shared folder and rereads them as the next
one's docs.  All stages but the last return the columns of documents.  A row without doc_id is a document of its own:
the filter keeps or drops it by its own text, and the two deduplications, which tell documents by doc_id, keep it.
Rows that repeat a doc_id are one document: they stay or go together, but for the filter, which judges each row's text.
Docs may have any columns besides doc_id and text, by any name; nulls in them stay as they are.  A null text is an empty
one.  Long texts are judged whole.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionframe.llm import exact_dedup, near_dedup, packing, pii, toxicity
from motionframe.llm.common import fresh_path

NEAR_PERCENT = 80  # op2's query has 85
PACKING_WORDS = 100_000  # that a worker remembers, which stays in memory beside the other stages' tables; op5's query has 500,000

ORACLE_SQL = None  # toxicity is learnt and packing is a search; tests hold the stages against brute force


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score 0.5 or more.  The model learns from the labels in sf_dir and the documents there.

    A null or empty text scores as one without matches and stays; rows that repeat are scored alike; a score of just 0.5
    goes.  Columns of docs stay as they are, one named score too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    names = docs.columns
    score = fresh_name(docs, "score")
    scored = docs.mapInArrow(toxicity.scorer(model, names, score), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
    return scored.where(F.col(score) < 0.5).select(*names)


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs without the doc_ids that decisions don't keep; a doc_id may stand there more than once."""
    gone = decisions.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def once_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without copies: of equal texts, white space aside, the smallest doc_id stays."""
    return without(docs, exact_dedup.exact_dedup(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near-duplicates: of each group of documents linked at a similarity of 0.8 the smallest doc_id stays."""
    return without(docs, near_dedup.near_dedup(docs, percent=NEAR_PERCENT))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in their texts replaced by its kind; n_chars, where there is one, follows the new text.

    Null texts stay null, with their n_chars; every row stays, repeated ones and those without doc_id too.  Of spans that
    overlap the first one's kind stands for all; base spans come before candidates where both begin together and are as long.
    """
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return redacted.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of at most 4096 tokens, with their ids.

    A null or empty text is one piece of the end id alone; rows that repeat are packed as often as they come; of pieces of one
    length any may come first; other columns of docs are ignored.
    """
    return packing.best_fit_packing(docs, words=PACKING_WORDS)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("exact_dedup", once_each),
    ("near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
