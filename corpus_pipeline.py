"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token store.

Each stage reads all that its predecessor kept. Rejected are documents without
an identified language or far below certainty, all but one document of each
near-duplicate group, and documents that leak a benchmark item. Mixing keeps
every document and decides their order, which is the row order of the table it
writes; the last stage stores the documents' tokens in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontaminate, language_id, mixing, near_copies, token_store
from loomframe.llm.common import new_path, table
from loomframe.llm.queries import END_ID, WEIGHTS, tokenizer_path

#: Below this calibrated probability no learned language is taken to be right.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(language_id.learning_rows(docs))
    got = language_id.identified(docs, model)
    return got.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(docs, WEIGHTS)
    return mixed.repartitionByRange("mix_at").sortWithinPartitions("mix_at").select(*docs.columns)


def in_row_order(docs: DataFrame) -> DataFrame:
    """`docs` with `row_order`, which grows with file and row of the table it is read from (or, of another, with partition and row)."""
    if not docs.inputFiles():
        return docs.withColumn("row_order", F.monotonically_increasing_id())
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return docs.withColumn("row_order", F.shiftleft(part, 33) + F.col("_metadata.row_index"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    token_store.write_store(in_row_order(docs), out, tokenizer_path(), END_ID, order_col="row_order")
    return token_store.read_sums(spark, out, width=2)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", in_mixed_order),
    ("token store", tokens),
]
#: A classifier, fingerprints and a tokenizer cannot be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
