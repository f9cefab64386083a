"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records into memory-sized buckets by a seeded hash; pass two gathers each
bucket in an array, permutes it by Spark's Fisher-Yates ``shuffle`` and numbers its members. Buckets are dealt
round to at most ``LANES`` partitions, each of which shuffles its buckets in the order of their numbers: the order follows from
the seed and the records alone, not from the partitions of a session. The number in the whole shuffled order is the bucket's prefix
sum plus the place in the bucket; shard = number mod shards, so that counts differ by one at most ("rows").

There are so many buckets that their records have about ``BUCKET_BYTES`` each; a record counts the bytes of its
texts and binaries and ``FIELD_BYTES`` for each other field.

Equal records are counted before they are scattered and dealt out by their copy number, so that
no repeated row fills a bucket. Groups of equal texts have different ids and scatter evenly. Hashes of the records tell which
may be repeated, through a set of bits without misses: only these are shuffled to be counted, whole, before all records are shuffled
into the buckets.

Defined cases: a null text has no bytes; null ids are a value like any other; maps, at any depth, are
counted and hashed as their sorted entries and come back as maps; an empty table
gives an empty result. Input columns named shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survperf.llm.common import bit_set, cut, in_bits, let, written

SHARDS = 8
SEED = 20_240
#: Bytes of a bucket, and of a field that is neither text nor binary.
BUCKET_BYTES, FIELD_BYTES = 1 << 23, 16
LEAST_BUCKETS = 32
#: Partitions that buckets are dealt to, however many buckets there are.
LANES = 4096
#: Buckets whose sums are broadcast; those of more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Buckets whose sizes are summed in one group.
SUMMED = 1024


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_bytes(schema: T.StructType) -> Column:
    """About the bytes of a record, held in the column ``row``."""
    total = F.lit(0).cast("long")
    for f in schema.fields:
        value = F.col("row")[f.name]
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
        total = total + FIELD_BYTES
    return total


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and has_map(kind.elementType))


def without_maps(value: Column, kind: T.DataType) -> Column:
    """``value`` with each map as the array of its entries by key, which can be compared and hashed."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[without_maps(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_maps(x, kind.elementType))
    entry = lambda e: F.struct(without_maps(e["key"], kind.keyType).alias("key"), without_maps(e["value"], kind.valueType).alias("value"))
    return F.sort_array(F.transform(F.map_entries(value), entry))


def with_maps(value: Column, kind: T.DataType) -> Column:
    """What ``without_maps`` was given."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[with_maps(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: with_maps(x, kind.elementType))
    return F.map_from_entries(F.transform(value, lambda e: F.struct(with_maps(e["key"], kind.keyType).alias("key"), with_maps(e["value"], kind.valueType).alias("value"))))


def scatter(df: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """(bucket, row, nth): distinct records of ``df.row`` once for each time they occur, scattered."""
    one, own = F.lit(1).cast("long"), F.xxhash64("row")
    repeated = cut(df.select(own.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    if count := repeated.count():
        marked = df.crossJoin(F.broadcast(bit_set(repeated, count))).withColumn("again", let(F.col("bits"), lambda b: in_bits(b, own)))
        counted = marked.filter("again").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        copies = counted.select("row", F.explode(F.sequence(one, F.col("n"))).alias("nth"))
        copies = copies.unionByName(marked.filter("not again").select("row", one.alias("nth")))
    else:
        copies = df.select("row", one.alias("nth"))
    return copies.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row", "nth"), F.lit(buckets)).cast("int"))


def prefix_sums(sizes: DataFrame) -> DataFrame:
    """(bucket, base): the sum of ``n`` over the buckets before each, in groups of ``SUMMED`` and then over the groups."""
    rows = sizes.withColumn("g", F.floor(F.col("bucket") / SUMMED))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("bucket", "g", F.coalesce(F.sum("n").over(before("g", "bucket")), F.lit(0)).alias("own"))
    groups = rows.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(before("g")), F.lit(0)).alias("all"))
    return own.join(groups, "g").select("bucket", (F.col("own") + F.col("all")).alias("base"))


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, lanes: int = LANES) -> DataFrame:
    """``df`` with shard and slot: a uniform random order dealt round to ``shards``."""
    df = df.drop("shard", "slot")
    # the input's columns stay inside a struct, so that none has a name of ours
    records = df.select(F.struct(*[without_maps(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType).alias(f.name) for f in df.schema.fields]).alias("row"))
    # only the number of buckets hangs on this sum, so the records are read twice instead of kept
    size = records.agg(F.sum(record_bytes(records.schema["row"].dataType)).alias("n")).first().n or 0
    buckets = max(least_buckets, -(-size // bucket_bytes))
    lanes = min(lanes, buckets)
    key = F.xxhash64(F.lit(seed + 1), "row", "nth").alias("h")
    dealt = scatter(records, buckets, seed).withColumn("lane", F.col("bucket") % lanes).repartitionById(lanes, F.col("lane"))
    gathered = dealt.groupBy("lane", "bucket").agg(F.sort_array(F.collect_list(F.struct(key, "nth", "row"))).alias("rows"))
    # Fisher-Yates draws from the seed plus the partition's number, for one bucket after the other
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "r"))
    shuffled = written(shuffled.select("bucket", "at", "r.row"))[0]
    bases = prefix_sums(shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    placed = shuffled.join(F.broadcast(bases) if buckets <= MOST_BROADCAST else bases, "bucket")
    number = F.col("base") + F.col("at")
    own = [with_maps(F.col("row")[f.name], f.dataType).alias(f.name) for f in df.schema.fields]
    return placed.select(*own, (number % shards).cast("int").alias("shard"), F.floor(number / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **options: int) -> None:
    """Shuffle ``df`` and write one folder for each shard; its files' rows are in slot order, as are the files by their smallest slot."""
    done = shuffle_into_shards(df, **options)
    done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
