"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. A stage that decides about rows by their neighbours first stores
them with a number each, so that a decision finds its row again however often and by however many
tasks the rows are read.

1. language: rows without a letter go, and rows whose predicted language is little better than a
   guess to the network (a score under a tenth of the way from 1 / languages to 1); others stay, in
   any language. Without labels to learn from, all rows with a letter stay.
2. exact: of texts equal up to white space, the row with the smallest doc_id stays.
3. near: of documents linked by five-word shingles at a similarity of 0.8 or more, one stays.
4. mix: rows are repeated to the sources' target weights and shuffled.
5. pack: documents become full sequences of tokens.

Defined results. Null and empty texts, and texts of white space, have no letter and go at the first
stage; very long texts are read whole. Null doc_ids come after all others where the smallest stays,
and rows of one doc_id, or that are equal in all columns, are rows of their own: exactly one of each
group stays. Null languages and sources are kept as they are. Other columns come through unchanged;
one named driftline_row is an error, as stages name their rows so. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, language_id, mixing, near_dedup, packing
from driftline.llm.common import free, materialise, numbered, scoped, table


def _without(docs: DataFrame, label: str, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that are dropped: a function from numbered rows to numbers (row)."""
    if "driftline_row" in docs.columns:
        raise ValueError("driftline_row is the name of the stages' own column")
    rows = numbered(docs, label)
    numbers = materialise(dropped(rows).select(F.col("row").alias("driftline_row")), "dropped")
    return rows.join(numbers, "driftline_row", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(language_id.stays(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "exact", lambda rows: exact_dedup.exact_duplicates(rows, row="driftline_row").filter(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, "near", lambda rows: near_dedup.near_duplicates(rows, row="driftline_row").filter(~F.col("stays")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, added=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Trained networks, MinHash candidates and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scoped() as kept:
            docs = materialise(stage(spark, before, sf_dir), name)
            kept.append(docs)
        if i:
            free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
