"""A corpus pipeline: toxic documents go, of near duplicates one stays, contaminated documents go, secrets are taken out
of the texts, and what is left is packed into sequences of 1024 tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``; the last gives the pieces of each sequence with their token ids. ``run`` writes each stage's
result as Parquet into the shared folder and reads it again for the next. With ``keep_in`` the stages' tables stay there,
each under its name, and a run that failed is taken up after the last stage whose table is complete; without it, each run
starts over. Empty tables pass through every stage; nulls and repeated rows are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvina.llm import decontam, neardup, packing, secret_scan, toxicity
from corvina.llm.common import written

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(spark, docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(spark, docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def take_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER), capacity=1024, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", take_out_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier, the tokenizer or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def run(spark: SparkSession, sf_dir: str, keep_in: str | None = None) -> DataFrame:
    """The last stage's rows. ``keep_in``: a folder for the stages' tables, one for each corpus, in a file system that
    driver and executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if keep_in is None:
            docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
            continue
        path = f"{keep_in.rstrip('/')}/{name}"
        if not complete(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
