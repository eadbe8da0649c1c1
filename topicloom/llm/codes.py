"""Vector code compression: product codes found by partial distances in the Walsh-Hadamard domain.

Vectors become integers and are cut into equal parts; every part position has a codebook of entries,
and a part is written as the number of its nearest entry. Parts and entries, padded with zeros to a power
of two, go through the integer Walsh-Hadamard transform, which keeps squared distances up to that power. Smooth
rows of the transform (few sign changes) come first: they carry most of a difference, so sums of squares
cut off after a few of them already exceed the distance of a good entry, and far entries drop out early. Everything is
integers, so the nearest entry and its ties are exact.

Codebooks are fitted on all vectors by rounds of assigning and averaging: tasks send sums per entry,
and only the new entries, whose number is fixed, come back to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import join_groups
from topicloom.llm.vectors import scaled_entries, whole_rows
from topicloom.stash import fits_broadcast, row_count, stash

# Pairs of a part and an entry that are compared at a time.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """Entries are ``floor(scale * x)``. ``parts`` per vector, ``entries`` (256 at most) per codebook."""

    scale: int = 256
    parts: int = 16
    entries: int = 64
    rounds: int = 2


def walsh(rows: np.ndarray) -> np.ndarray:
    """Transform of each row, padded with zeros to a power of two, in order of sign changes."""
    n = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), n), np.int64)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < n:
        pairs = out.reshape(len(rows), n // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(rows), n)
        half *= 2
    # Row r of the transform matrix has the sign (-1) ** (number of bits that r and the place share).
    places = np.arange(n)
    signs = np.array([[int(a & b).bit_count() & 1 for b in places] for a in places])
    return out[:, np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry (the lowest on ties) and squared distance, of transformed rows."""
    n = parts.shape[1]
    sums = (parts[:, :1] - entries[None, :, 0]) ** 2
    guess = sums.argmin(axis=1)
    bound = ((parts - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for k in range(1, n):
        sums = sums + (parts[row, k] - entries[entry, k]) ** 2
        if k + 1 < n and k & (k + 1) == 0:
            # The best so far, summed up, is a sharper bound.
            heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            ahead = np.flatnonzero(sums == np.repeat(np.minimum.reduceat(sums, heads), np.diff(np.append(heads, row.size))))
            bound[row[ahead]] = np.minimum(bound[row[ahead]], ((parts[row[ahead]] - entries[entry[ahead]]) ** 2).sum(axis=1))
        alive = sums <= bound[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(sums, heads)
    first = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(heads, row.size))))
    first = first[np.concatenate(([True], row[first[1:]] != row[first[:-1]]))]
    return entry[first], least // n


class Codebooks:
    """Entries ``(parts, entries, width)`` and their transforms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.transforms = [walsh(book) for book in entries]

    @property
    def sha256(self) -> str:
        """Digest of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def check(self, x: np.ndarray) -> None:
        parts, _, width = self.entries.shape
        if x.shape[1] != parts * width:
            raise ValueError(f"vectors of {x.shape[1]} and of {parts * width} entries in one table")
        n = self.transforms[0].shape[1]
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if n * (2 * n * largest) ** 2 >= 1 << 63:
            raise ValueError(f"entries of {largest} are too large for exact distances")

    def assign(self, x: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """``(part, first row, end row, entry numbers, squared distances)`` for all parts and rows."""
        self.check(x)
        parts, entries, width = self.entries.shape
        step = max(1, PAIRS // entries)
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            for part in range(parts):
                own = walsh(some[:, part * width : (part + 1) * width])
                yield part, lo, lo + len(some), *nearest(own, self.transforms[part])


def first_codebooks(vectors: DataFrame, column: str, settings: Settings) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; None without vectors. Equal ids: by the vectors themselves."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), column).limit(settings.entries)
    column_type = pa.list_(pa.float64())
    rows = [r[0] for r in first.select(F.col(column).cast("array<double>")).collect()]
    if not rows:
        return None
    x = scaled_entries(pa.array(rows, column_type), settings.scale)
    if x.shape[1] % settings.parts:
        raise ValueError(f"vectors of {x.shape[1]} entries do not fall into {settings.parts} equal parts")
    return Codebooks(x.reshape(len(x), settings.parts, -1).transpose(1, 0, 2))


def averaged(vectors: DataFrame, column: str, books: Codebooks, settings: Settings) -> Codebooks:
    """Each entry replaced by the floor of its parts' mean; an entry that is nearest to none stays."""
    n_parts, n_entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_parts, n_entries), np.int64)
        sums = np.zeros((n_parts, n_entries, width), np.int64)
        for batch in batches:
            x = scaled_entries(batch.column(0), settings.scale)
            for part, lo, hi, entry, _ in books.assign(x):
                order = np.argsort(entry, kind="stable")
                heads = np.flatnonzero(np.diff(entry[order], prepend=-1))
                own = x[lo:hi, part * width : (part + 1) * width][order]
                counts[part] += np.bincount(entry, minlength=n_entries)
                sums[part, entry[order][heads]] += np.add.reduceat(own, heads)
        used = np.flatnonzero(counts.ravel())
        lists = pa.array(list(sums.reshape(-1, width)[used]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts.ravel()[used]), lists], ["slot", "n", "sums"])

    found = vectors.select(column).mapInArrow(run, "slot long, n long, sums array<long>")
    # Decimals hold sums over any number of rows.
    totals = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    entries = books.entries.reshape(-1, width).copy()
    for slot, n, *sums in found.groupBy("slot").agg(F.sum("n"), *totals).collect():  # one row per entry
        entries[slot] = [int(s) // n for s in sums]
    return Codebooks(entries.reshape(books.entries.shape))


def fit_codebooks(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> Codebooks | None:
    """Codebooks fitted on all whole rows of ``vectors``; None when there are none."""
    whole = whole_rows(vectors, column)
    books = first_codebooks(whole, column, settings)
    for _ in range(settings.rounds if books else 0):
        books = averaged(whole, column, books, settings)
    return books


def encode_vectors(
    vectors: DataFrame, books: Codebooks | None, column: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """``(record, code, error)``: each whole row of ``vectors``, its code and squared distance from its entries.

    Rows with a null vector or a null or non-finite entry are left out; other columns may have any names.
    ``code`` has two hexadecimal digits per part. Equal vectors get equal codes, ties go to the lower number.
    Without vectors the result is empty. All vectors have one length, a multiple of ``parts``, and entries
    small enough for exact 64-bit sums (below 2**19 for parts of four); anything else raises ``ValueError``.
    """
    whole = whole_rows(vectors, column)
    out = whole.select(
        F.struct(*vectors.columns).alias("record"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), column
    )
    schema = T.StructType(out.schema.fields[:3])
    if books is None:
        return out.select("record", "code", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled_entries(batch.column(3), settings.scale)
            codes, errors = np.zeros((len(x), len(books.entries)), np.uint8), np.zeros(len(x), np.int64)
            for part, lo, hi, entry, distance in books.assign(x):
                codes[lo:hi, part] = entry
                errors[lo:hi] += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(errors)], schema.names
            )

    return out.mapInArrow(run, schema)


def compress_vectors(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of all whole rows of ``vectors``.

    ``label_error`` adds up the errors of equal labels, nulls being one label.
    """
    slim = vectors.select("vec_id", "label", column)
    books = fit_codebooks(slim, column, settings)
    encoded = encode_vectors(slim, books, column, settings)
    # Nulls get a key of their own.
    key = F.coalesce(F.concat(F.lit("0"), F.col("record.label").cast("string")), F.lit("1"))
    coded = stash(encoded.select("record.vec_id", key.alias("label_key"), "code", "error"), "codes")
    labels = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows"))
    labels = stash(labels, "label-errors")
    if fits_broadcast(labels):
        joined = coded.join(F.broadcast(labels), "label_key")
    else:
        joined = join_groups(coded, labels, ["label_key"], "n_rows", ["vec_id", "code"], row_count(coded), "inner")
    digest = F.lit(books.sha256 if books else None).cast("string")
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
