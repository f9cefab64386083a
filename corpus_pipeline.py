"""From raw documents to packed training sequences: the stages of a corpus run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survperf.llm import decontaminate, packing, quality, secrets, similar
from survperf.llm.common import checkpoint_dir, delete_folder, table
from survperf.llm.queries import learnable, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good.

    A null or empty text has one empty line, scored like any other; repeated rows are judged alike; without labels of both
    classes every score is 0.5 and all documents stay. Any further columns go on as they are.
    """
    model = quality.fit(docs, learnable(spark, sf_dir), "quality")
    return quality.keep_good(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest id stays, rows without an id come last, and of rows equal in id and text one stays; null and empty texts are copies of each
    other; texts of fewer than five words are one shingle.
    """
    return similar.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window.

    A null or empty text has no words and stays; an item without words has no windows; with an empty benchmark all documents stay.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows.

    A null text stays null with its n_chars, an empty one empty; repeated rows are replaced alike.
    """
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences.

    A null text is empty and is one piece of the closing id alone; equal rows are packed each for itself; an empty table gives an empty result.
    """
    pieces = packing.tokenize_pieces(docs, tokenizer_path())
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
        if n:
            delete_folder(spark, f"{base}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
