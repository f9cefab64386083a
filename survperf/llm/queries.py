"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survperf.llm import decontaminate, html, licenses, media, packing, quality, secrets, sharding, simhash, spelling, suffix, toxicity, trie
from survperf.llm.common import held_out, table


def tokenizer_path() -> str:
    """The public tokenizer's file; SURVPERF_TOKENIZER overrides its place."""
    if path := os.environ.get("SURVPERF_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    return labels.filter(~held_out(F.col("doc_id")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, learnable(spark, sf_dir), "quality")
    scored = quality.with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = decontaminate.covered(F.col("spans"))
    rows = found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.drop("copy")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, ["doc_id", "piece", "ids_crc32"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("secret_spans").alias("s"))
    of = lambda *kinds: F.filter("s", lambda x: x["kind"].isin(*kinds))
    counts = {f"n_{k}": F.size(of(k)).cast("long") for k in ("assign", "access", "hex")}
    return found.select("doc_id", *[v.alias(k) for k, v in counts.items()], F.sha2(secrets.as_text(of("assign", "access", "hex")), 256).alias("base_sha256"), secrets.as_text(F.col("s")).alias("spans"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.pandas_udf("string")
    def feature(marks: pd.Series) -> pd.Series:
        return marks.map(lambda m: media.fingerprint_of(np.asarray(m, np.int64)))

    tail = F.expr("substring(payload, -64, 64)")
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature("landmarks").alias("feature"), "landmarks",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = sharding.shuffle_into_shards(docs.select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return done.select("doc_id", sharding.size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.template", ",").alias("licenses"), F.coalesce(F.round(F.array_max("licenses.share"), 6), F.lit(0.0)).alias("best_share"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learnable(spark, sf_dir), "toxic")
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches")


def op11_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove(table(spark, sf_dir, "documents"), digest=True)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspell=97))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = trie.ordered(table(spark, sf_dir, "conversations"))
    rebuilt, convs = trie.borrowed(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return trie.prefix_trie(rebuilt, convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_packing, op4_secrets, op5_html, op6_media, op7_sharding, op8_licenses, op9_simhash, op10_toxicity, op11_suffix, op12_spelling, op13_trie)}
