"""Near-duplicate detection by MinHash bands and odd sketches, confirmed on full sets.

1. Every text becomes the set of its word shingles, MinHash samples of that set, band keys
   (``ROWS`` samples each) and an odd sketch: the samples hashed into a bitmap of parities. Texts
   with the same set are one class, named by its smallest id.
2. Classes that share a band key are candidates. Within a bucket the exclusive-or of two
   odd sketches counts the differing samples, which estimates high similarities sharply;
   pairs estimated clearly below the threshold are out. What is left forms clusters.
3. Inside a cluster, similarities are computed exactly on full shingle sets, and the
   components of the exact links are the answer.

Large buckets and clusters are cut into blocks and every pair of blocks is a cell of its
own, so no task holds a whole group; a task sends out one link per text at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import (
    distinct_per_doc,
    join_groups,
    mix,
    shingle_hashes,
    signed,
    split_words,
    text_slices,
)
from topicloom.llm.components import LINKS, components, links_out
from topicloom.stash import row_count, stash


@dataclass(frozen=True)
class Settings:
    """``percent`` of the union that two sets must share, in shingles of ``width`` words.

    With 48 bands of 6 samples a pair at 0.8 shares no band once in two million. An odd
    sketch of 512 bits estimates 0.8 with a standard error near 0.03, so ``screen``, five of
    them lower, loses as few.
    """

    width: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    bits: int = 512
    screen: float = 0.65
    block: int = 256

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Differing sketch bits expected at similarity ``screen``."""
        differing = 2 * self.samples * (1 - self.screen)
        return int(self.bits / 2 * (1 - exp(-2 * differing / self.bits)))


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    codes = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return codes[:n] | np.uint64(1), codes[n:]


def min_samples(values: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """MinHash samples (sets x ``n``): the smallest of each hash family over each set."""
    factor, shift = _families(n)
    out = np.empty((heads.size, n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(values * factor[k] + shift[k], heads)
    return out


def band_keys(samples: np.ndarray, settings: Settings) -> np.ndarray:
    parts = samples.reshape(len(samples), settings.bands, settings.rows)
    key = np.arange(1, settings.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)
    key = np.repeat(key, len(samples), axis=0)
    for k in range(settings.rows):
        key = mix(key ^ parts[:, :, k])
    return key


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (sets x bits/8 bytes): each sample, with its number, flips one bit."""
    number = mix(np.arange(1, samples.shape[1] + 1, dtype=np.uint64))
    at = (mix(samples ^ number) % np.uint64(bits)).astype(np.int64)
    flat = (np.arange(len(samples))[:, None] * bits + at).ravel()
    parity = np.bincount(flat, minlength=len(samples) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(samples), bits), axis=1)


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """``(doc_id, n_shingles, set1, set2, keys, sketch)`` per row; null text is empty."""
    schema = T.StructType(
        [docs.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("n_shingles", "set1", "set2")]
        + [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), 1 << 18):
                doc, values = distinct_per_doc(*shingle_hashes(split_words(data, offsets), settings.width))
                n = hi - lo
                sizes = np.bincount(doc, minlength=n)
                full = np.flatnonzero(sizes)
                keys = np.zeros((n, settings.bands), np.uint64)
                sketches = np.zeros((n, settings.bits // 8), np.uint8)
                sums = np.zeros((2, n), np.uint64)
                if full.size:
                    heads = (np.cumsum(sizes) - sizes)[full]
                    samples = min_samples(values, heads, settings.samples)
                    keys[full] = band_keys(samples, settings)
                    sketches[full] = odd_sketches(samples, settings.bits)
                    sums[0, full] = np.add.reduceat(mix(values), heads)
                    sums[1, full] = np.bitwise_xor.reduceat(mix(values + np.uint64(1)), heads)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(sizes.astype(np.int64)),
                        signed(sums[0]),
                        signed(sums[1]),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1, dtype=np.int32) * settings.bands), signed(keys.ravel())
                        ),
                        pa.array([s.tobytes() for s in sketches], pa.binary()),
                    ],
                    schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classes_of(signed_docs: DataFrame) -> DataFrame:
    """One row per distinct shingle set: smallest id, number of rows, keys and sketch."""
    return (
        signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set1", "set2", "n_shingles")
        .agg(
            F.min("doc_id").alias("id"),
            F.count("*").alias("rows"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        )
    )


def buckets_of(classes: DataFrame) -> DataFrame:
    """``(key, members)`` of band buckets with two classes or more, each set of members once."""
    sized = (
        classes.select("id", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(
            F.count("*").alias("members"),
            F.min("id").alias("first"),
            F.bit_xor(F.xxhash64("id")).alias("x1"),
            F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("x2"),
        )
        .where("members > 1")
    )
    return sized.groupBy("members", "first", "x1", "x2").agg(F.min("key").alias("key")).select("key", "members")


def in_cells(rows: DataFrame, group: str, members: str, block: int) -> DataFrame:
    """Rows of each group in cells ``(group, lo, hi)``: pairs of blocks of about ``block`` rows.

    A group of one block is one cell. A row of a larger group goes to a cell with every block,
    so any two rows of the group meet in a cell.
    """
    n_blocks = F.ceil(F.col(members) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(11), "id"), n_blocks).cast("int")
    spread = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    return (
        spread.withColumn("lo", F.least("mine", "other"))
        .withColumn("hi", F.greatest("mine", "other"))
        .drop("mine", "other", members)
        .repartition(group, "lo", "hi")
        .sortWithinPartitions(group, "lo", "hi")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a sorted stream, with the rows at which groups begin."""
    waiting: pa.Table | None = None

    def heads_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in names:
            values = table[name].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        heads = heads_of(table)
        waiting = table.slice(heads[-1])
        if heads.size > 1:
            yield table.slice(0, heads[-1]), heads[:-1]
    if waiting is not None:
        yield waiting, np.zeros(1, np.int64)


def _near(sketches: np.ndarray, sizes: np.ndarray, a, b, settings: Settings) -> np.ndarray:
    """Whether pairs pass the screen: sizes that allow the threshold, few differing bits."""
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    bits = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=-1, dtype=np.int64)
    return (100 * low >= settings.percent * high) & (bits <= settings.most_bits)


def screen_cells(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between texts whose odd sketches are close, from rows ``(key, lo, hi, id, n, sketch)``."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table, heads in whole_groups(batches, ["key", "lo", "hi"]):
            ids, sizes = table["id"].to_numpy(), table["n_shingles"].to_numpy()
            raw = b"".join(table["sketch"].to_pylist())
            sketches = np.frombuffer(raw, np.uint64).reshape(len(ids), -1)
            ends = np.append(heads[1:], len(ids))
            counts = ends - heads
            end_of = np.repeat(ends, counts)
            small = np.repeat(counts <= 32, counts)
            for step in range(1, 32):
                a = np.flatnonzero(small[: len(ids) - step] & (np.arange(len(ids) - step) + step < end_of[: len(ids) - step]))
                if not a.size:
                    break
                ok = _near(sketches, sizes, a, a + step, settings)
                yield ids[a[ok]], ids[a[ok] + step]
            for lo, hi in zip(heads[counts > 32], ends[counts > 32]):
                for k in range(lo, hi - 1):
                    rest = np.arange(k + 1, hi)
                    ok = _near(sketches, sizes, k, rest, settings)
                    yield np.full(int(ok.sum()), ids[k]), ids[rest[ok]]

    return lambda batches: links_out(_gathered(pairs(batches)))


def _gathered(parts, size: int = 100_000):
    """Parts joined to larger ones before they are contracted."""
    us, vs, n = [], [], 0
    for u, v in parts:
        us.append(u), vs.append(v)
        n += u.size
        if n >= size:
            yield np.concatenate(us), np.concatenate(vs)
            us, vs, n = [], [], 0
    if us:
        yield np.concatenate(us), np.concatenate(vs)


def exact_links(ids: np.ndarray, doc: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts with ``100 * shared >= percent * union``, counted on full sets.

    Shingles found in one text only cannot be shared; the others are columns of a 0/1 matrix
    whose product with itself, a stretch of columns at a time, counts what texts share.
    """
    n = len(ids)
    sizes = np.bincount(doc, minlength=n)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = doc[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = 1024
    for lo in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    u, v = np.nonzero(np.triu((100 * shared >= percent * union) & (shared > 0), 1))
    return ids[u], ids[v]


def confirm_cells(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact links from rows ``(cluster, lo, hi, id, text)``."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table, heads in whole_groups(batches, ["cluster", "lo", "hi"]):
            for lo, hi in zip(heads, np.append(heads[1:], table.num_rows)):
                part = table.slice(lo, hi - lo)
                docs, sets = [], []
                for a, _, data, offsets in text_slices(part["text"]):
                    doc, values = distinct_per_doc(*shingle_hashes(split_words(data, offsets), settings.width))
                    docs.append(doc + a), sets.append(values)
                yield exact_links(part["id"].to_numpy(), np.concatenate(docs), np.concatenate(sets), settings.percent)

    return lambda batches: links_out(_gathered(pairs(batches)))


def near_links(docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """``(node, label)``: component of every linked class but the smallest of each component."""
    buckets = stash(buckets_of(classes), "buckets")
    named = classes.select("id", F.explode("keys").alias("key"))
    members = join_groups(
        named, buckets, ["key"], "members", ["id"], row_count(classes) * settings.bands, "inner"
    )
    sketched = members.join(classes.select("id", "n_shingles", "sketch"), "id")
    screened = in_cells(sketched, "key", "members", settings.block)
    clusters = components(screened.mapInArrow(screen_cells(settings), LINKS), "candidates")
    roots = clusters.groupBy("label").agg(F.count("*").alias("others"))
    everyone = clusters.select(F.col("node").alias("id"), F.col("label").alias("cluster")).union(
        roots.select(F.col("label").alias("id"), F.col("label").alias("cluster"))
    )
    everyone = join_groups(
        everyone,
        roots.select(F.col("label").alias("cluster"), (F.col("others") + 1).alias("members")),
        ["cluster"],
        "members",
        ["id"],
        2 * row_count(classes),
        "inner",
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(everyone, "id")
    cells = in_cells(texts, "cluster", "members", settings.block)
    return components(cells.mapInArrow(confirm_cells(settings), LINKS), "links")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether that is the row's
    own id. Texts without words (null, empty, blanks) are linked with nothing. Rows under one id
    are one document, linked if any of its texts is; of rows with a null id, those whose
    set another document has join it, the others stand alone with a null component and stay.
    ``doc_id`` must be a long. An empty table gives an empty result.
    """
    signed_docs = stash(signatures(docs, settings), "signatures")
    classes = stash(classes_of(signed_docs), "classes")
    links = near_links(docs, classes, settings)
    named = classes.select("set1", "set2", "n_shingles", "id", "rows").join(
        links, F.col("id") == F.col("node"), "left"
    )
    named = named.select(
        "set1", "set2", "n_shingles", "rows", F.coalesce("label", "id").alias("component")
    )
    found = join_groups(
        signed_docs.select("doc_id", "n_shingles", "set1", "set2"),
        named,
        ["set1", "set2", "n_shingles"],
        "rows",
        ["doc_id"],
        row_count(signed_docs),
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def distinct_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Whole rows of ``docs``, one document of each component: that with the smallest id.

    Rows with a null id cannot be named by a link, so they stay; rows under one id share its fate.
    """
    dropped = near_duplicates(docs, settings).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
