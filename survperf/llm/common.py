"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so a batch stays a few MB.
BATCH_ROWS = "256"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches handed to Python small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "survperf-checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_remembered: dict[str, Callable[[], None]] = {}


def take_worker(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called by an operator's Python code when it starts in a worker: what other operators left in a reused worker is dropped."""
    for other in [k for k in _remembered if k != operator]:
        _remembered.pop(other)()
    if forget:
        _remembered[operator] = forget


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, instead_of: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared checkpoint folder, and the table's own folder; the folder ``instead_of`` is removed then.

    A checkpoint keeps its plan's guess of its size, and a join's is the product of its sides': in a loop of joins the guess would
    double its digits with each round, all of them in the driver. A table read again has the size of its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of:
        delete_folder(spark, instead_of)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path), path


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once though ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, fold: Callable[[Column, Column], Column], zero: Column, chunk: int = 128) -> Column:
    """For each of ``values`` the fold of those before it.

    An array that grew by one element at a time would be copied as often; here chunks are folded first, so the
    work is in proportion to the number of values times the size of a chunk.
    """

    def inside(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda k: F.slice(v, k * chunk + 1, chunk))
        return let(parts, lambda ps: let(F.transform(ps, lambda p: F.aggregate(p, zero, fold)), lambda tops: F.flatten(F.transform(ps, lambda p, k: let(F.aggregate(F.slice(tops, F.lit(1), k), zero, fold), lambda base: F.transform(p, lambda _, i: F.aggregate(F.slice(p, F.lit(1), i), base, fold)))))))

    return let(values, lambda v: F.when(F.size(v) > 0, inside(v)).otherwise(F.slice(v, 1, 0)))


def at_most(values: Column, limit: Column) -> Column:
    """How many of the ascending ``values``, a lambda's variable, are not above ``limit``; by bisection."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(values))))

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        low = (acc["lo"] < acc["hi"]) & (F.get(values, middle) <= limit)
        return F.struct(F.when(low, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(F.greatest(acc["lo"], middle)).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), step, lambda acc: acc["lo"])


#: Least and most 64-bit numbers of a bit set, and bits for each key: 1 MB at most.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 6, 1 << 17, 16


def bit_set(keys: DataFrame, count: int) -> DataFrame:
    """One row, one array of numbers: a set of the hashes in the only column of ``keys``, with false hits but no misses."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, count * BITS_EACH // 64).bit_length()))
    place = F.col(keys.columns[0]).bitwiseAND(F.lit(64 * size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    held = keys.select(F.shiftright(place, 6).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = keys.sparkSession.range(size).select(F.col("id").alias("i")).join(held, "i", "left")
    numbers = F.sort_array(F.collect_list(F.struct("i", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))))
    return every.agg(F.transform(numbers, lambda x: x["b"]).alias("bits"))


def in_bits(bits: Column, key: Column) -> Column:
    """Whether ``key`` may be in a bit set, a lambda's variable."""
    place = key.bitwiseAND(F.lit(64) * F.size(bits).cast("bigint") - 1)
    return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and no other letter, in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def fold(doc_id: Column, k: int = 3) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``k``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels must not be learned from."""
    return fold(doc_id) == 1
