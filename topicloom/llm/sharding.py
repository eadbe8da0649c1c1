"""Two-pass external shuffle of a table into shards of equal row counts.

Pass one scatters records uniformly into buckets that fit in a task's memory, by a seeded
hash. Pass two shuffles each bucket (Spark's ``shuffle`` is a Fisher-Yates shuffle inside the
JVM). A record's position in the shuffled table is the rows of all earlier buckets plus its
place in its own, and shards are equal stretches of positions. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.stash import stash

BUCKET_BYTES = 8 << 20  # of record payload that one bucket should hold
OVERHEAD = 16  # bytes counted for a record besides its text
N_SHARDS = 40
SEED = 20_240_601

# Buckets whose rows are summed together before the running total over all buckets.
BUCKET_BLOCK = 1_000


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus ``OVERHEAD``."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def with_salt(records: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``records`` with a salt column that tells rows repeated under one key apart.

    A unique key needs none. Otherwise rows are numbered and written to the shared folder,
    so that a retried task finds the same numbers; then a key that holds a third of all rows
    is scattered like any other.
    """
    salt = "_" * (1 + max((len(c) for c in records.columns), default=0)) + "salt"
    repeated = records.groupBy(key).count().where("count > 1").limit(1).count()
    if not repeated:
        return records.withColumn(salt, F.lit(0).cast("long")), salt
    return stash(records.withColumn(salt, F.monotonically_increasing_id()), "salted"), salt


def bucket_offsets(buckets: DataFrame) -> DataFrame:
    """``(bucket, before)``: rows in all earlier buckets, by a two-level running total."""
    sized = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    sized = sized.withColumn("block", F.floor(F.col("bucket") / F.lit(BUCKET_BLOCK)).cast("int"))
    blocks = sized.groupBy("block").agg(F.sum("n").alias("block_n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("blocks_before"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sized.join(blocks, "block").select("bucket", (F.col("inside") + F.col("blocks_before")).alias("before"))


def shuffle_into_shards(
    records: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_shards: int = N_SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """Whole ``records`` (struct column ``record``) with ``shard`` and gapless ``slot``.

    Shard sizes differ by one row at most. Equal input and seed give the same shuffle,
    however it is partitioned, when ``key`` is unique; rows repeated under one key, null keys
    included, are told apart by their place in the input. Null and empty texts are records
    like others; an empty table gives an empty result. Columns must be of orderable types.
    """
    total = records.agg(F.count("*"), F.sum(record_size(text))).first()
    n, n_bytes = total[0], total[1] or 0
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    salted, salt = with_salt(records, key)
    draw = F.xxhash64(F.lit(seed), F.col(key), F.col(salt))
    placed = salted.select(
        F.pmod(draw, F.lit(n_buckets)).cast("int").alias("bucket"),
        F.struct(
            F.xxhash64(F.lit(seed + 1), F.col(key), F.col(salt)).alias("draw"),
            F.col(salt).alias("salt"),
            F.struct(*records.columns).alias("record"),
        ).alias("entry"),
    )
    offsets = bucket_offsets(placed.select("bucket"))
    nothing = F.lit(None).cast(placed.schema["entry"].dataType)
    # Bucket k is partition k, one row in it, so the shuffle depends on seed and bucket only.
    together = placed.withColumn("before", F.lit(None).cast("long")).unionByName(
        offsets.select("bucket", nothing.alias("entry"), "before")
    )
    filled = (
        together.repartitionById(n_buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.collect_list("entry").alias("entries"), F.max("before").alias("before"))
    )
    shuffled = filled.select("before", F.shuffle(F.sort_array("entries"), F.lit(seed)).alias("entries"))
    out = shuffled.select("before", F.posexplode("entries").alias("place", "entry")).select(
        F.col("entry.record").alias("record"), (F.col("before") + F.col("place")).alias("position")
    )
    rows = max(1, n)
    shard = F.expr(f"CAST(position * {n_shards}L DIV {rows}L AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {rows}L + {n_shards - 1}L) DIV {n_shards}L")
    return out.withColumn("shard", shard).select("record", "shard", (F.col("position") - first).alias("slot"))


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Write whole records to ``path``, one folder per shard, in slot order.

    Shards are cut into ranges of slots first, so no task holds a whole shard.
    """
    placed = shuffle_into_shards(records, **options)
    (
        placed.select("record.*", "shard", "slot")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
