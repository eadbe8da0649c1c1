"""Shared pieces of the operators: Arrow text slices, word hashes, sliced joins, fixed tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Text handled at a time inside a task: bounds NumPy's temporary arrays.
SLICE_BYTES = 1 << 20

# Rows of one join key that a single task may receive before the key is cut into slices.
ROWS_PER_SLICE = 20_000

# A list of heavy keys holds at most this many rows, by counting, so it may be broadcast.
MAX_HEAVY_KEYS = 10_000

_BYTES = np.arange(256)
# A-Z to a-z, and the six characters that separate words.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
GAP = np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
# Everything but ASCII letters, digits and the bytes of other characters: for bare words.
NOT_LETTER = ~(((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128))

_rng = np.random.default_rng(20_240_601)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of a string column, about ``size`` bytes each.

    A null counts as an empty text. A text longer than ``size`` is a slice of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte positions, number of the text, 64-bit hash."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray


def _hash_runs(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of ``inside`` bytes; arithmetic is modulo 2**64."""
    heads = np.cumsum(lengths) - lengths
    local = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), WORD_BASE, np.uint64))
    sums = np.add.reduceat(BYTE_CODES[data[inside]] * powers[local], heads)
    return mix(sums ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def split_words(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = GAP, size: int = 4 * SLICE_BYTES
) -> Words:
    """Maximal runs of bytes outside ``gap``, lower-cased for A-Z only, within each text.

    Long slices are worked off in pieces cut at a separator, so memory beyond the result is
    bounded unless a single word is longer than ``size``.
    """
    edges = offsets[1:-1]
    parts, lo = [], 0
    while lo < data.size:
        hi = min(data.size, lo + size)
        while hi < data.size and not gap[LOWER[data[hi - 1]]]:
            more = np.flatnonzero(gap[LOWER[data[hi : hi + size]]])
            hi = hi + int(more[0]) + 1 if more.size else min(data.size, hi + size)
        low = LOWER[data[lo:hi]]
        inside = ~gap[low]
        first = np.zeros(hi - lo + 1, bool)
        first[0] = first[-1] = True
        first[edges[(edges >= lo) & (edges <= hi)] - lo] = True
        before = np.concatenate(([False], inside[:-1])) & ~first[:-1]
        after = np.concatenate((inside[1:], [False])) & ~first[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if starts.size:
            parts.append((starts + lo, ends + lo, _hash_runs(low, inside, ends - starts)))
        lo = hi
    if not parts:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64))
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    return Words(starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the text, hash)`` of every run of ``width`` words.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    h, doc, n = words.hashes, words.doc, words.hashes.size
    odd = np.uint64(2) * mix(np.arange(1, width + 1, dtype=np.uint64)) + np.uint64(1)
    if n == 0:
        return doc, h
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        whole += h[k : k + whole.size] * odd[k]
    at = np.flatnonzero(doc[: whole.size] == doc[width - 1 :]) if whole.size else np.empty(0, np.int64)
    out_doc, out = doc[at], mix(whole[at])
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    counts = np.diff(np.append(heads, n))
    for head, count in zip(heads[counts < width], counts[counts < width]):
        short = (h[head : head + count] * odd[:count]).sum(dtype=np.uint64) + np.uint64(count)
        out_doc, out = np.append(out_doc, doc[head]), np.append(out, mix(np.atleast_1d(short)))
    return out_doc, out


def distinct_per_doc(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(doc, value)`` pairs sorted by both."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(doc.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[new], values[new]


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    salt: list[str],
    total: int,
    how: str = "left",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``rows`` to ``groups`` (unique by ``keys``), cutting heavy keys into slices.

    ``size`` in ``groups`` counts the rows of a key and ``total`` all rows. Keys with more
    than ``per_slice`` rows are listed (at most ``MAX_HEAVY_KEYS`` of them, by counting) and
    broadcast; their rows go to slices by a hash of ``salt``, and their group is repeated
    once per slice. No row is lost.
    """
    per_slice = max(rows_per_slice, -(-total // MAX_HEAVY_KEYS))
    slices = F.ceil(F.col(size) / F.lit(per_slice)).cast("int")
    heavy = groups.where(F.col(size) > per_slice).select(*keys, slices.alias("n_slices"))
    placed = (
        rows.join(F.broadcast(heavy), keys, "left")
        .withColumn("slice", F.pmod(F.xxhash64(*salt), F.coalesce("n_slices", F.lit(1))).cast("int"))
        .drop("n_slices")
    )
    repeated = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1)))
    return placed.join(repeated, [*keys, "slice"], how).drop("slice")
