"""Intermediate tables in the cluster's shared folder, and size-checked joins.

A stash is a parquet table under ``spark.checkpoint.dir``. It cuts lineage, survives the
loss of any executor, keeps column pruning and filter pushdown for whoever reads it, and
tells Catalyst its real size, which a lazy aggregate cannot.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table is broadcast up to this many rows and this many bytes of its values.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

# Row counts of stashes: None until somebody asks. A stash never changes once written.
_stashed_rows: weakref.WeakKeyDictionary[DataFrame, int | None] = weakref.WeakKeyDictionary()

# Rows of one join key that a single task may receive before the key is cut into slices.
ROWS_PER_SLICE = 1_000_000

# Below this many documents per core, a table is spread before work that is heavy on CPU.
SPREAD_ROWS = 10_000

# No more than this many keys can each hold over 1/MAX_HEAVY_KEYS of all rows.
MAX_HEAVY_KEYS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a machine-local one is made only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="topicloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/topicloom-{app}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return the table read back.

    ``schema`` reads the columns back under another type of the same physical layout
    (a struct written, a ``VectorUDT`` read).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(schema or df.schema).parquet(path)
    _stashed_rows[table] = None
    return table


def discard(table: DataFrame) -> None:
    """Delete a stash that nothing reads any more."""
    spark = table.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_count(df: DataFrame) -> int:
    """Number of rows; counted once for a stash, from its file footers."""
    if df not in _stashed_rows:
        return df.count()
    if _stashed_rows[df] is None:
        _stashed_rows[df] = df.count()
    return _stashed_rows[df]


def at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has no more than ``limit`` rows; counting stops just beyond it."""
    if df in _stashed_rows:
        return row_count(df) <= limit
    return df.limit(limit + 1).count() <= limit


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: texts by their length, everything else as eight."""
    size = F.lit(0)
    for field in df.schema.fields:
        text = isinstance(field.dataType, (T.StringType, T.BinaryType))
        size = size + (F.coalesce(F.octet_length(field.name), F.lit(0)) if text else F.lit(0)) + F.lit(8)
    return size


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows that take at most ``max_bytes``."""
    if not at_most(df, limit):
        return False
    return (df.agg(F.sum(value_bytes(df))).first()[0] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` is known to hold at most ``limit`` rows and few bytes.

    A larger table is returned without a hint: Catalyst then shuffles, and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def spread(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """Give every core a share of a table too small to have a split for each.

    Moves data only when there are at most ``SPREAD_ROWS`` rows per core; a larger table
    comes in enough splits of its own and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if rows <= SPREAD_ROWS * cores else df


def join_on_term(
    rows: DataFrame,
    terms: DataFrame,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join document-term ``rows`` to the ``terms`` table on ``term`` (inner or left_semi).

    ``terms`` carries ``df``, the number of rows per term. Within ``broadcast_rows`` it is
    broadcast and ``rows`` does not move. Beyond that both sides are shuffled, and terms so
    frequent that one task would drown in them are cut into slices by document: the heavy
    terms (at most ``MAX_HEAVY_KEYS`` by counting) tell each row its slice, and the lookup
    side repeats a heavy term once per slice. No row is lost on either way.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"unsupported join type {how}")
    if how == "left_semi":
        out = rows.columns
    else:
        out = rows.columns + [c for c in terms.columns if c not in rows.columns]
    if fits_broadcast(terms, broadcast_rows):
        return rows.join(F.broadcast(terms), "term", how).select(*out)

    total = terms.agg(F.sum("df")).first()[0] or 0
    per_slice = max(rows_per_slice, -(-total // MAX_HEAVY_KEYS))
    slices = F.ceil(F.col("df") / F.lit(per_slice)).cast("int")
    heavy = terms.where(F.col("df") > per_slice).select("term", slices.alias("n_slices"))
    placed = rows.join(F.broadcast(heavy), "term", "left").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id"), F.coalesce("n_slices", F.lit(1))).cast("int")
    )
    repeated = terms.withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1))
    )
    return placed.join(repeated, ["term", "slice"], how).select(*out)
