"""Documents to training sequences: toxic documents go, one of each group of near duplicates
stays, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
``documents``, with text and n_chars as the stage leaves them. Rows without id
pass like all others; nulls in other columns are carried along; an empty table
gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit.llm import near_dedup, packing, repeats, severity
from govaudit.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, doesn't call toxic."""
    model = severity.fit(docs, table(spark, sf_dir, "labels"))
    return severity.score(docs, model, keep=True).where("NOT toxic").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id. Documents without id are known by
    their text and come after those with one; of rows with the same id and text one stays, and of near
    duplicates with the same id too."""
    key = "key"
    while key in docs.columns or f"{key}_mark" in docs.columns:
        key += "_"
    mark = f"{key}_mark"
    keyed = (docs.withColumn(key, F.expr("coalesce(CAST(doc_id AS BIGINT), 4611686018427387904 + (xxhash64(coalesce(text, '')) & 4611686018427387903))"))
             .withColumn(mark, F.xxhash64("text")))
    found = near_dedup.near_duplicate_rows(keyed.select(F.col(key).alias("doc_id"), "text")).where("kept")
    kept = (found.groupBy("doc_id", "component", F.expr("if(component IS NULL, mark, NULL)").alias("alone"))
            .agg(F.min("mark").alias(mark)).select(F.col("doc_id").alias(key), mark))
    return keyed.join(kept, [key, mark], "left_semi").dropDuplicates([key, "text"]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes and more that start earlier in the corpus."""
    cut = repeats.remove_repeats(docs, as_text=True, carry=tuple(c for c in docs.columns if c != "text"))
    columns = {c: F.col(f"carried.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
