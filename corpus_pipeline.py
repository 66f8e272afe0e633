"""From documents to training shards: drop poor text, near copies and benchmark text, mix sources, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written out before the next one reads it. All but
the last return the columns of documents.

Decisions: a document scored under 0.5 goes; of documents that share four fifths of their five-word shingles one stays; a document
with any benchmark phrase goes; the mix repeats or leaves out documents as the sources' targets ask, in training order; the rest is sharded by
size. Only doc_id, text and source are read; other columns are passed on, whatever their names (size, shard and slot are returned as size_input, shard_input
and slot_input). `run` deletes a stage's intermediate files, and its input, once its output is written.

Defined cases: null and empty texts are scored as empty text; if they stay, they have no set and so no near copies, no benchmark phrase, and no words to mix, and are kept once where
their source is read at all; very long texts go through whole; rows of equal doc_id and text are one document in near-dedup and stay once, rows of equal doc_id and other texts stay apart;
null doc_ids stay; a null source is a source of its own; ties are broken by doc_id and a hash of the text; an empty table gives no rows with the same columns, an empty benchmark takes nothing, and without usable labels
every document has the same score, 0.5, and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import decontamination, mixing, neardups, quality, sharding
from orefield.llm.common import delete, freed, stage, table


def renamed(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with names that no stage adds, and the columns that give the old names back."""
    new = {c: c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items())), [F.col(n).alias(c) for c, n in new.items()]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.learned(docs, table(spark, sf_dir, "labels"))
    rows, names = renamed(docs)
    return quality.scored(rows, machine, "score").where("score >= 0.5").select(*names)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardups.one_of_each(docs, shingle=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = renamed(docs)
    return decontamination.scan(rows, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, weights=(1, 2, 3), cap=3.0, shapes=mixing.CURRICULUM)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs, 24)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]

#: SQL expresses neither the classifier nor the hashed orders; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        with freed(spark) as keep:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs._staged_at)
        if before:
            delete(spark, before)
        before = docs._staged_at
    return STAGES[-1][1](spark, docs, sf_dir)
