"""From raw documents to packed training sequences.

Five stages, each an operator of :mod:`tidewheel.llm` applied to all that the
stage before it kept. Each result is written as Parquet to the shared folder
and read again, so a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import exact_dedup, minhash, packing, substrings, toxicity
from tidewheel.llm.support import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null texts are scored as empty ones, rows that repeat stay or go together,
    an empty table gives an empty one. All columns stay, whatever their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null equals the empty text. Rows that repeat id and text all stay; null ids
    lose against others and stay where a group has no others. An empty table
    gives an empty one.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id.

    Texts without words (null, empty, white space) are one class. Rows that
    repeat the kept id stay, as do all rows of a class without ids. An empty
    table gives an empty one.
    """
    return minhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier; what has none is left as it is.

    A changed text is its kept words joined by one space, and n_chars follows
    it. A document that is nothing but repeats stays as an empty text. Null
    texts have no words and stay null, null ids are later than all others, rows
    that repeat an id are not earlier than one another. An empty table gives an
    empty one. Columns may have any names.
    """
    prefix = "_cut_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    cut = substrings.substring_dedup(docs, docs.columns, texts="changed", prefix=prefix)
    changed = F.col(f"{prefix}n_removed") > 0
    out = cut.withColumn("text", F.when(changed, F.col(f"{prefix}kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences.

    Null and empty texts are one piece of one token; null and repeated ids are
    documents of their own. An empty table gives no rows.
    """
    return packing.best_fit_pack(docs, added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Classifier and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
