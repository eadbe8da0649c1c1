"""Exact deduplication by merging sorted digest runs in a tree.

Every input partition turns its texts into one sorted run of digests. Runs then meet in
rounds: ``FAN`` neighbours at a time send their digests to the task of a digest slice, Spark's
sort merges them, and equal digests collapse into the row that stays. A round never holds
more than one row per run and digest, so copies shrink long before the last round, and
a slice of the digest space bounds what one task reads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import LOWER, join_groups, text_slices
from topicloom.stash import row_count, stash

FAN = 8  # runs that meet in one round

KEYS = ["sha", "n_bytes", "crc"]


def digest_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of each normalised ``text`` (A-Z to a-z; null is empty) in its place."""
    rest = [c for c in rows.columns if c != "text"]
    schema = T.StructType(
        [rows.schema[c] for c in rest]
        + [
            T.StructField("sha", T.BinaryType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("crc", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(len(rest))):
                low = memoryview(LOWER[data])
                texts = [low[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(rest))]
                    + [
                        pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                    ],
                    schema.names,
                )

    return rows.select(*rest, "text").mapInArrow(run, schema)


def _heads(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which a new key begins, and rows at which a new key or id begins."""
    sha = np.frombuffer(b"".join(table["sha"].to_pylist()), np.uint8).reshape(-1, 32)
    new_key = np.ones(table.num_rows, bool)
    new_key[1:] = (sha[1:] != sha[:-1]).any(axis=1)
    for name in ("run", "n_bytes", "crc"):
        values = table[name].to_numpy()
        new_key[1:] |= values[1:] != values[:-1]
    ids = table["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    new_id = new_key.copy()
    new_id[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new_key), np.flatnonzero(new_id)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours of a sorted stream become one row; the last one waits for the next batch.

    Rows count as equal only when digest, length and checksum all agree. Ids ascend within a
    key, so its last row has the largest; ``copies`` counts the rows that carry that id, ``n``
    all rows.
    """
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        if not table.num_rows:
            continue
        keys, ids = _heads(table)
        last = np.append(keys[1:], table.num_rows) - 1
        copies = np.add.reduceat(table["copies"].to_numpy(), ids)
        merged = table.take(last)
        new = {
            "copies": copies[np.searchsorted(ids, last, "right") - 1],
            "n": np.add.reduceat(table["n"].to_numpy(), keys),
        }
        for name, values in new.items():
            merged = merged.set_column(merged.schema.get_field_index(name), merged.schema.field(name), [values])
        waiting = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).combine_chunks().to_batches()
    if waiting is not None:
        yield from waiting.combine_chunks().to_batches()


def merge_runs(runs: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """Merge ``(run, sha, n_bytes, crc, doc_id, copies, n)`` until one run is left."""
    level = runs.mapInArrow(_collapse, runs.schema)
    while True:
        slice_of = F.substring(F.hex("sha"), 1, 4)
        level = (
            level.withColumn("run", F.floor(F.col("run") / F.lit(fan)).cast("int"))
            .withColumn("digest_slice", slice_of)
            .repartition("run", "digest_slice")
            .drop("digest_slice")
            .select(*runs.columns)
            .sortWithinPartitions("run", *KEYS, F.asc_nulls_first("doc_id"))
            .mapInArrow(_collapse, runs.schema)
        )
        n_runs = -(-n_runs // fan)
        if n_runs <= 1:
            return level.drop("run")


def digest_groups(docs: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: a digest per row of ``docs``, and one row per distinct text.

    ``groups`` has the digest, ``doc_id`` (the largest of the group), ``copies`` and ``n``.
    Both are tables in the shared folder.
    """
    rows = digest_rows(docs.select("doc_id", "text")).withColumn("run", F.spark_partition_id())
    order = ["run", *KEYS, F.asc_nulls_first("doc_id")]
    rows = stash(rows.sortWithinPartitions(*order), "digests")
    one = F.lit(1).cast("long")
    runs = rows.select("run", *KEYS, "doc_id", one.alias("copies"), one.alias("n"))
    last = rows.agg(F.max("run")).first()[0]
    groups = stash(merge_runs(runs, 1 if last is None else last + 1, fan), "digest-groups")
    return rows.drop("run"), groups


def exact_duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest ``doc_id`` stays; a null id is the smallest, and stays only
    where the whole group has none. Rows repeated under one id share its decision and each
    counts in ``group_size``. An empty table gives an empty result.
    """
    rows, groups = digest_groups(docs, fan)
    total = row_count(rows)
    found = join_groups(
        rows,
        groups.select(*KEYS, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")),
        KEYS,
        "group_size",
        ["doc_id"],
        total,
    )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Whole rows of ``docs``, one of each class of equal texts: that with the largest id.

    Of rows that repeat the id as well as the text, which nothing tells apart, one stays.
    Digests are made again beside the rows, so nothing is matched by id alone.
    """
    _, groups = digest_groups(docs, fan)
    shared = groups.where("n > 1").select(*KEYS, F.col("doc_id").alias("keep_id"), "copies", "n")
    rows = digest_rows(docs.select(F.struct(*docs.columns).alias("record"), "doc_id", "text"))
    found = join_groups(rows, shared, KEYS, "n", ["doc_id"], docs.count())
    kept = found.where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if groups.where("copies > 1").limit(1).count():
        once = kept.where("coalesce(copies, 1) = 1")
        kept = once.unionByName(kept.where("copies > 1").dropDuplicates(KEYS))
    return kept.select("record.*")
