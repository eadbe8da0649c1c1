"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF over passages of all documents, with the benchmark's words as terms: no other
   word can bring a passage closer to an item. All others count as one more term in the passage's length.
2. A randomised SVD: every task multiplies its passages with the same random matrix
   and back (``A'A`` times it), partial products are summed in Spark, and the small
   result gives the leading right singular vectors (Nystroem's formula).
3. Windows slide over every document in sizes that fit the items; latent cosine against the items
   of that size finds candidates.
4. A candidate is confirmed by the longest common subsequence of words with the item, which a
   paraphrase keeps for the most part, and by the item's answer words, its rarest ones.
5. Items too short for that are found by an exact match of their words, one after the other.

Scoring is row by row against a model of the whole benchmark, whose size is checked, so documents
are never shuffled. Terms, weights and basis are those of all items; only the scoring goes by blocks of items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import NOT_LETTER, Words, mix, split_words, text_slices


TERM_BLOCK = 64  # terms whose partial products travel as one row
PARTS = "block int, part array<double>"


@dataclass(frozen=True)
class Settings:
    """``passage`` words make a passage; ``rank`` latent dimensions; ``cosine`` finds candidates.

    A leak has ``share`` of an item's words in order and ``answers`` of its ``answer_words``
    rarest words. Items of fewer than ``min_words`` words must stand in the document word for word, and those
    of fewer than ``phrase_words`` must be the whole document. A benchmark may have ``max_bytes`` of text;
    ``block`` items are scored at a time.
    """

    passage: int = 64
    rank: int = 64
    extra: int = 8
    cosine: float = 0.5
    share: float = 0.6
    answer_words: int = 6
    answers: float = 0.5
    min_words: int = 8
    phrase_words: int = 3
    max_bytes: int = 64 << 20
    block: int = 2_000


@dataclass
class Items:
    """Items in order of their ids: ids, word hashes, and the sorted distinct hashes of all items as terms."""

    ids: list
    words: list[np.ndarray]
    terms: np.ndarray

    def blocks(self, size: int) -> Iterator[Items]:
        for lo in range(0, len(self.ids), size):
            yield Items(self.ids[lo : lo + size], self.words[lo : lo + size], self.terms)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each hash, or -1."""
        if not self.terms.size:
            return np.full(hashes.size, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), self.terms.size - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def bare_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return split_words(data, offsets, NOT_LETTER)


def read_items(rows: list) -> Items:
    """Items with at least one word."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0], r[1]))
    ids, words = [], []
    for lo, hi, data, offsets in text_slices(pa.array([r[1] for r in rows], pa.string())):
        found = bare_words(data, offsets)
        for k in range(hi - lo):
            own = found.hashes[found.doc == k]
            if own.size:
                ids.append(rows[lo + k][0])
                words.append(own)
    terms = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
    return Items(ids, words, terms)


def _passages(found: Words, size: int) -> np.ndarray:
    """A number for the passage of each word; passages do not cross documents."""
    new = np.concatenate(([True], found.doc[1:] != found.doc[:-1]))
    heads = np.flatnonzero(new)
    place = np.arange(found.doc.size) - np.repeat(heads, np.diff(np.append(heads, found.doc.size)))
    return np.cumsum(new | (place % size == 0)) - 1


def term_counts(docs: DataFrame, items: Items, settings: Settings) -> tuple[int, np.ndarray]:
    """Number of passages, and of passages per term; the last term is that of all other words."""
    n_terms = items.terms.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms + 2, np.int64)  # the last two: other words, passages
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                found = bare_words(data, offsets)
                if not found.doc.size:
                    continue
                passage, term = _passages(found, settings.passage), items.index(found.hashes)
                counts[-1] += passage[-1] + 1
                known = term >= 0
                pairs = np.unique(passage[known] * n_terms + term[known])
                counts[:-2] += np.bincount(pairs % max(1, n_terms), minlength=n_terms)
                counts[-2] += np.unique(passage[~known]).size
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["term", "n"])

    counts = np.zeros(n_terms + 2, np.int64)
    summed = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in summed.collect():  # one row per benchmark term
        counts[term] = n
    return int(counts[-1]), counts[:-1]


def _weights(passage: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzeros of the TF-IDF rows ``(row, term, weight)``, each row of length 1 with its other words.

    Term -1 is that of other words; the last ``idf`` is its own. It adds to the length only.
    """
    n_terms = idf.size - 1
    pairs, tf = np.unique(passage * idf.size + np.where(term < 0, n_terms, term), return_counts=True)
    row, term = pairs // idf.size, pairs % idf.size
    weight = (1 + np.log(tf)) * idf[term]
    _, at = np.unique(row, return_inverse=True)
    length = np.sqrt(np.bincount(at, weight**2))
    weight = weight / np.maximum(length[at], 1e-9)
    known = term < n_terms
    _, at = np.unique(row[known], return_inverse=True)
    return at, term[known], weight[known].astype(np.float32)


def _gram_times(row, term, weight, omega: np.ndarray) -> np.ndarray:
    """``A'A omega`` for rows given by their nonzeros, sorted by row."""
    heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    projected = np.add.reduceat(weight[:, None] * omega[term], heads)
    order = np.argsort(term, kind="stable")
    sorted_term = term[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_term[1:] != sorted_term[:-1])))
    out = np.zeros_like(omega)
    out[sorted_term[heads]] = np.add.reduceat(weight[order, None] * projected[row[order]], heads)
    return out


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the parts of each key, as they stream by."""
    sums: dict[tuple, np.ndarray] = {}
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names
        keys = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns) if k != 1))
        for key, part in zip(keys, batch.column(1)):
            values = part.values.to_numpy()
            sums[key] = sums[key] + values if key in sums else values.copy()
    if sums:
        columns = list(zip(*sums))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int32()),
                pa.array(list(sums.values()), pa.list_(pa.float64())),
                *(pa.array(c, pa.int32()) for c in columns[1:]),
            ],
            names,
        )


def latent_basis(docs: DataFrame, items: Items, idf: np.ndarray, settings: Settings) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the passages and the items.

    The items' own rows are weighted up to the passages' total, or a large corpus would leave
    them no direction. Partial products have the size terms x (rank + extra); they are cut
    into blocks of terms, and a block's parts are summed as they stream by, in two rounds.
    """
    n_terms = idf.size - 1
    wide = min(settings.rank + settings.extra, n_terms)
    rng = np.random.default_rng(11)
    omega = rng.standard_normal((n_terms, wide)).astype(np.float32)
    size = settings.passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(omega.shape, np.float64), 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), 1 << 19):
                found = bare_words(data, offsets)
                if not found.doc.size:
                    continue
                term = items.index(found.hashes)
                if (term >= 0).any():
                    row, column, weight = _weights(_passages(found, size), term, idf)
                    total += _gram_times(row, column, weight, omega)
                    rows += row[-1] + 1
        blocks = [total[k : k + TERM_BLOCK] for k in range(0, len(total), TERM_BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(blocks) + 1), pa.int32()),
                pa.array([b.ravel() for b in blocks] + [np.array([float(rows)])], pa.list_(pa.float64())),
            ],
            ["block", "part"],
        )

    parts = docs.select("text").mapInArrow(run, PARTS)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (("block", "salt"), ("block",)):
        parts = parts.repartition(*keys).select("block", "part", *keys[1:])
        parts = parts.mapInArrow(_sum_parts, PARTS + ", salt int" * (len(keys) > 1))
    got = {r[0]: np.array(r[1]) for r in parts.collect()}  # terms x (rank + extra) numbers
    n_blocks = -(-n_terms // TERM_BLOCK)
    own_row, own_term, own_weight = _weights(
        np.repeat(np.arange(len(items.words)), [w.size for w in items.words]),
        items.index(np.concatenate(items.words)),
        idf,
    )
    own = _gram_times(own_row, own_term, own_weight, omega).astype(np.float64)
    rows = float(got[n_blocks][0]) if n_blocks in got else 0.0
    product = own * max(1.0, rows / len(items.words))
    if rows:
        product += np.concatenate([got[k] for k in range(n_blocks)]).reshape(omega.shape)
    core = omega.T.astype(np.float64) @ product
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > 1e-9 * max(values.max(), 1e-30)
    left, _, _ = np.linalg.svd(product @ vectors[:, good] / np.sqrt(values[good]), full_matrices=False)
    return left[:, : settings.rank].astype(np.float32)


class Judge:
    """Scores documents against the items of one block."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray, settings: Settings):
        self.items, self.settings = items, settings
        self.vectors = (idf[:-1, None] * basis).astype(np.float32)
        self.masks, self.answers, by_size = [], [], defaultdict(list)
        by_length = defaultdict(list)
        for k, words in enumerate(items.words):
            if words.size < settings.min_words:
                by_length[words.size].append(k)
                self.masks.append({})
                self.answers.append(words)
                continue
            mask: dict[int, int] = {}
            for at, word in enumerate(words.tolist()):
                mask[word] = mask.get(word, 0) | 1 << at
            self.masks.append(mask)
            distinct = np.unique(words)
            rare = distinct[np.argsort(-idf[items.index(distinct)], kind="stable")]
            self.answers.append(rare[: settings.answer_words])
            width = 12
            while width < 1.2 * words.size:
                width = width * 3 // 2
            by_size[width].append(k)
        self.classes = []
        for width, members in sorted(by_size.items()):
            latent = np.array([self.vectors[items.index(items.words[k])].sum(axis=0) for k in members])
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
            rare = np.zeros(items.terms.size, np.int64)
            rare[items.index(np.concatenate([self.answers[k] for k in members]))] = 1
            least = min(self.needed(k) for k in members)
            self.classes.append((width, max(1, width // 6), np.array(members), latent.astype(np.float32), rare, least))

        # Short items by length: sorted keys of their words, and the first item of each key.
        self.phrases = []
        for length, members in sorted(by_length.items()):
            keys = phrase_keys(np.concatenate([items.words[k] for k in members]), length)[::length]
            distinct, first = np.unique(keys, return_index=True)
            self.phrases.append((length, distinct, np.array(members)[first]))

    def needed(self, item: int) -> int:
        """Answer words that a window must have."""
        return int(np.ceil(self.settings.answers * len(self.answers[item])))

    def common(self, item: int, window: list[int]) -> int:
        """Length of the longest common subsequence, one machine word of bits per 64 item words."""
        mask, n = self.masks[item], self.items.words[item].size
        every = (1 << n) - 1
        row = every
        for word in window:
            hit = mask.get(word)
            if hit:
                both = row & hit
                row = ((row + both) | (row - both)) & every
        return n - row.bit_count()

    def verdict(self, item: int, window: np.ndarray) -> float | None:
        """Share of the item's words that the window has in order, if it is enough to confirm."""
        share = self.common(item, window.tolist()) / self.items.words[item].size
        if share < self.settings.share or np.isin(self.answers[item], window).sum() < self.needed(item):
            return None
        return share

    def judge(self, found: Words, n_docs: int) -> list[tuple | None]:
        """Best confirmed ``(share, -item, item, cosine)`` of each document, or None."""
        best: list[tuple | None] = [None] * n_docs
        if not found.doc.size:
            return best
        term = self.items.index(found.hashes)
        known = term >= 0
        heads = np.flatnonzero(np.concatenate(([True], found.doc[1:] != found.doc[:-1])))
        ends = np.append(heads[1:], found.doc.size)
        at_known = np.concatenate(([0], np.cumsum(known)))
        terms = term[known]
        for length, keys, members in self.phrases:
            found_keys = phrase_keys(found.hashes, length)
            at = np.minimum(np.searchsorted(keys, found_keys), keys.size - 1)
            for begin in np.flatnonzero(keys[at] == found_keys).tolist():
                doc, item = int(found.doc[begin]), int(members[at[begin]])
                place = np.searchsorted(heads, begin, "right") - 1
                whole = heads[place] == begin and ends[place] == begin + length
                inside = begin + length <= ends[place] and (whole or length >= self.settings.phrase_words)
                if inside and (found.hashes[begin : begin + length] == self.items.words[item]).all():
                    best[doc] = max(best[doc], (1.0, -item, item, 1.0)) if best[doc] else (1.0, -item, item, 1.0)
        for width, step, members, latent, rare, least in self.classes:
            answers = np.concatenate(([0], np.cumsum(np.where(known, rare[term], 0))))
            counts = np.maximum(1, -(-(ends - heads - width) // step) + 1)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = np.repeat(heads, counts) + place * step
            last = np.repeat(ends, counts)
            end = np.minimum(begin + width, last)
            # Without answer words of any of these items no verdict can be confirmed.
            go = np.flatnonzero(answers[end] - answers[begin] >= least)
            first = np.repeat(heads, counts)
            for lo in range(0, go.size, 4096):
                some = go[lo : lo + 4096]
                a, sizes = at_known[begin[some]], at_known[end[some]] - at_known[begin[some]]
                starts = np.cumsum(sizes) - sizes
                local = np.arange(sizes.sum()) - np.repeat(starts, sizes)
                vectors = np.add.reduceat(self.vectors[terms[np.repeat(a, sizes) + local]], starts)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                cosine = vectors @ latent.T
                for w, k in zip(*np.nonzero(cosine >= self.settings.cosine)):
                    item, at = int(members[k]), some[w]
                    doc = int(found.doc[begin[at]])
                    if best[doc] is not None and best[doc][:2] >= (1.0, -item):
                        continue  # nothing can beat it
                    own = np.isin(self.answers[item], found.hashes[begin[at] : end[at]]).sum()
                    if own < self.needed(item):
                        continue  # other items of the block let this window pass
                    margin = self.items.words[item].size // 4
                    window = found.hashes[max(first[at], begin[at] - margin) : min(last[at], end[at] + margin)]
                    share = self.verdict(item, window)
                    if share is not None and (best[doc] is None or (share, -item) > best[doc][:2]):
                        best[doc] = (share, -item, item, float(cosine[w, k]))
        return best


def phrase_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """A key for every run of ``length`` words."""
    keys = np.zeros(max(0, hashes.size - length + 1), np.uint64)
    for k, odd in enumerate(mix(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)):
        keys += hashes[k : k + keys.size] * odd
    return keys


def read_benchmark(benchmark: DataFrame, settings: Settings) -> Items:
    """The whole benchmark on the driver, once its size is known to fit."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > settings.max_bytes:
        raise ValueError(f"a benchmark of {size} bytes, at most {settings.max_bytes} are supported")
    return read_items(benchmark.select("item_id", F.lower("text")).collect())


def find_contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(record, contaminated, item_id, share, cosine)``: each whole row of ``docs`` as a struct.

    Case and punctuation make no difference. ``item_id`` is the item with the largest confirmed ``share`` (ties: the first by id),
    ``cosine`` that of its window, 1 for a short item; both null for a clean row. Null and empty texts, and items
    without words, match nothing. Repeated rows get equal verdicts. An empty
    benchmark leaves every row clean, an empty table gives an empty result.
    """
    item_type = benchmark.schema["item_id"].dataType
    out = docs.select(
        F.struct(*docs.columns).alias("record"),
        F.lit(None).cast(item_type).alias("item_id"),
        F.lit(None).cast("double").alias("share"),
        F.lit(None).cast("double").alias("cosine"),
        F.lower("text").alias("text"),
    )
    items = read_benchmark(benchmark, settings)
    if items.ids:
        texts = docs.select(F.lower("text").alias("text"))
        n, counts = term_counts(texts, items, settings)
        idf = np.log((n + 1) / (counts + 1)) + 0.1
        basis = latent_basis(texts, items, idf, settings)
        for block in items.blocks(settings.block):
            out = out.mapInArrow(_scorer(Judge(block, idf, basis, settings)), out.schema)
    return out.select("record", F.col("share").isNotNull().alias("contaminated"), "item_id", "share", "cosine")


def _scorer(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(4)):
                part = batch.slice(lo, hi - lo)
                columns = [part.column(k).to_pylist() for k in (1, 2, 3)]
                for k, found in enumerate(judge.judge(bare_words(data, offsets), hi - lo)):
                    # Blocks go by id, so an equal share does not replace that of an earlier block.
                    if found is not None and (columns[1][k] is None or found[0] > columns[1][k]):
                        for column, value in zip(columns, (judge.items.ids[found[2]], found[0], found[3])):
                            column[k] = value
                arrays = [pa.array(c, batch.schema.types[k + 1]) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, part.column(4)], batch.schema.names)

    return run
