"""A training corpus from ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's documents.  All but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.llm import mixing, toxicity
from textgauge.llm.common import shared_folder, table
from textgauge.llm.contamination import strip_spans
from textgauge.llm.ngram_join import drop_near_duplicates
from textgauge.llm.sharding import shard_rows

SHARDS = 8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go.

    It learns from the rows of ``labels`` that meet ``docs``; without any the fixed
    words decide.  Null and empty texts hold no clause and stay unless such a text
    scores 0.5; rows that repeat share their fate; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id:
    shingles of five words, a similarity of 0.8 or more.

    Null, empty and blank texts are like nothing and all stay, as do rows without a
    doc_id; of rows that repeat a doc_id one stays; an empty table stays empty."""
    return drop_near_duplicates(docs, width=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in the benchmark are cut out of the texts; ``n_chars`` follows.

    Every row stays, null and empty texts as they are, repeated rows cut alike; an
    empty benchmark or table changes nothing."""
    return strip_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rarer languages are repeated until token totals meet smoothed
    targets; none is dropped.

    A repeated document is a whole row again, with its doc_id.  Null and empty texts
    are repeated at the rate of the languages' mean membership; without a label, and
    in an empty table, all rows stay once."""
    return mixing.mix(docs, docs.withColumn("domain", F.col("lang")), floor=1.0)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row, of which the two together are the key: rows
    that mixing repeated share their doc_id and their shard, and have slots of their own.

    Null texts have size one and the checksum of the empty text; an empty table has
    no rows."""
    return shard_rows(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("source_mixing", mix_languages),
    ("sharding", put_into_shards),
]

#: Learned models and iterative propagation are beyond SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what lies between them is written to the shared
    folder, and deleted when the stage after next no longer reads it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    written: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written.append(f"{folder}/{k}-{name}")
            docs.write.parquet(written[-1])
            docs = spark.read.parquet(written[-1])
            for path in written[:-1]:
                _delete(spark, path)
            del written[:-1]
    return docs
