"""A corpus pipeline of four training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written and read again before the
next. The first three return the columns of documents.

* toxicity: a conditional random field is fitted to labelled rows of the stage's documents; documents
  whose score reaches its threshold go.
* jaccard: documents whose five-word shingles have a similarity of 0.8 or more are a group, through
  others too; the smallest doc_id of a group stays. Rows of one doc_id stay or go together; rows
  without doc_id stay.
* suffix_array: strings of 200 bytes that start more than once in the corpus are removed wherever they
  stand; a character goes whole or stays; a document of which nothing is left goes.
* packing: what is left is tokenized and packed into sequences of 4096 tokens.

An empty table goes through all stages and gives no rows; null texts stay null until they are packed as
empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import jaccard, packing, suffix_array, toxicity
from basalt.llm.common import materialize, read

NEAR = jaccard.Join(words=5, percent=80, scheme="prefix")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard.near_duplicates(docs, NEAR).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_array.clean_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_duplicates), ("suffix_array", cut_repeats), ("packing", pack)]

#: The fitted field and the tokenizer have no SQL form; tests hold the operators of the stages against brute force and run the stages in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
