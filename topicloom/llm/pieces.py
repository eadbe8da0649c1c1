"""SentencePiece encoding and decoding with a batched NumPy Viterbi.

A text becomes pieces of the vocabulary whose scores add up to the most. No piece crosses the
start of a word, so words are segmented alone, each distinct word once per batch and all words of
one length together: for every piece length, the hashes of all substrings are probed in
the sorted keys of that length (hits are confirmed letter by letter), and for every end
position a vectorised maximum over piece lengths stores the backpointer. Ties go to the longer
last piece. Letters outside the vocabulary become their UTF-8 byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import mix
from topicloom.llm.token_counts import read_model

SPACE = "▁"
LONG_WORD = 64  # letters; longer words are cut where no piece can cross
MEMO_WORDS = 300_000  # distinct words that a task remembers before it starts anew
UNKNOWN_PENALTY = 10.0

BASE = np.uint64(0x9E3779B97F4A7C15)


def letters_of(words: Sequence[str]) -> np.ndarray:
    """Code points of words of one length (words x letters)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), -1)


class Memo:
    """Segmented words: their place by spelling, and the ids of all of them end to end."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self._ids, self._sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self._ids.append(ids)
        self._sizes.append(sizes)

    def _joined(self, parts: list[np.ndarray]) -> np.ndarray:
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    def ids(self) -> np.ndarray:
        return self._joined(self._ids)

    def sizes(self) -> np.ndarray:
        return self._joined(self._sizes)

    def heads(self) -> np.ndarray:
        return np.cumsum(self.sizes()) - self.sizes()


class PieceCodec:
    """Pieces, scores and lookup tables of a model given as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = source.get_piece_size()
        self.pieces = [source.id_to_piece(k) for k in range(n)]
        self.unknown = source.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        text, normal = [b""] * n, []
        for k, piece in enumerate(self.pieces):
            if source.is_byte(k):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], text[k] = k, bytes([value])
            elif not (source.is_control(k) or source.is_unknown(k) or source.is_unused(k)):
                normal.append(k)
                text[k] = piece.replace(SPACE, " ").encode()
        self.bytes_of = np.frombuffer(b"".join(text), np.uint8)
        self.byte_lengths = np.array([len(x) for x in text], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        scores = np.array([source.get_score(k) for k in range(n)], np.float64)
        self.unknown_score = (min(scores[normal]) if normal else 0.0) - UNKNOWN_PENALTY
        self.bigrams = {self.pieces[k][i : i + 2] for k in normal for i in range(len(self.pieces[k]) - 1)}
        crosses = any(b[1] == SPACE and b[0] != SPACE for b in self.bigrams)
        self.word = re.compile(".+" if crosses else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(self.pieces[k]) for k in normal}):
            ids = np.array([k for k in normal if len(self.pieces[k]) == size], np.int32)
            letters = letters_of([self.pieces[k] for k in ids])
            keys = np.zeros(len(ids), np.uint64)
            for k in range(size):
                keys = keys * BASE + mix(letters[:, k].astype(np.uint64) + np.uint64(1))
            order = np.argsort(keys)
            self.tables[size] = keys[order], ids[order], letters[order], scores[ids[order]]

    def parts(self, word: str) -> list[str]:
        """A word, or its parts between letters that stand side by side in no piece."""
        if len(word) <= LONG_WORD:
            return [word]
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.bigrams]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def segment(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best piece ids of words of one length (words x letters), end to end, and their counts."""
        n, length = letters.shape
        codes = mix(letters.astype(np.uint64) + np.uint64(1))
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        size_at = np.ones((n, length + 1), np.int32)
        id_at = np.full((n, length + 1), self.unknown, np.int32)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hashes = np.zeros((n, length), np.uint64)
        for size in range(1, min(length, max(self.tables, default=0)) + 1):
            hashes = hashes[:, : length - size + 1] * BASE + codes[:, size - 1 :]
            if size not in self.tables:
                continue
            keys, ids, spelled, scores = self.tables[size]
            at = np.minimum(np.searchsorted(keys, hashes.ravel()), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes.ravel())
            row, start = np.divmod(hit, hashes.shape[1])
            same = (letters[row[:, None], start[:, None] + np.arange(size)] == spelled[at[hit]]).all(axis=1)
            hit, at = hit[same], at[hit[same]]
            score, number = np.full(hashes.size, -np.inf), np.full(hashes.size, self.unknown, np.int32)
            score[hit], number[hit] = scores[at], ids[at]
            found[size] = score.reshape(hashes.shape), number.reshape(hashes.shape)
        for end in range(1, length + 1):
            top = best[:, end - 1] + self.unknown_score
            for size, (score, number) in found.items():
                if size > end:
                    break
                total = best[:, end - size] + score[:, end - size]
                better = total >= top
                better &= total > -np.inf
                top = np.where(better, total, top)
                size_at[better, end] = size
                id_at[better, end] = number[better, end - size]
            best[:, end] = top
        # Follow the backpointers of all words at once, last piece first.
        end, taken = np.full(n, length), []
        active = np.arange(n)
        while active.size:
            start = end[active] - size_at[active, end[active]]
            taken.append((active, id_at[active, end[active]], start))
            end[active] = start
            active = active[start > 0]
        row, number, start = (np.concatenate(x) for x in zip(*taken))
        order = np.lexsort((start, row))
        row, number, start = row[order], number[order], start[order]
        odd = np.flatnonzero(number == self.unknown)
        if odd.size:
            row, number = self._with_bytes(row, number, odd, letters[row[odd], start[odd]])
        return number, np.bincount(row, minlength=n)

    def _with_bytes(self, row, number, odd, letters) -> tuple[np.ndarray, np.ndarray]:
        """Unknown pieces replaced by the byte pieces of their letter."""
        distinct, which = np.unique(letters, return_inverse=True)
        spelled = [self.byte_ids[list(chr(int(x)).encode("utf-8", "surrogatepass"))] for x in distinct]
        sizes = np.ones(row.size, np.int64)
        sizes[odd] = np.array([x.size for x in spelled])[which]
        heads = np.cumsum(sizes) - sizes
        out = np.repeat(number, sizes)
        for k, ids in enumerate(spelled):
            at = heads[odd[which == k]]
            out[at[:, None] + np.arange(ids.size)] = ids
        return np.repeat(row, sizes), out

    def encode(self, texts: Sequence[str], memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, end to end, and how many each has.

        ``memo`` keeps segmented words between calls.
        """
        memo = Memo() if memo is None else memo
        if len(memo.place) > MEMO_WORDS:
            memo.__init__()
        place, find = memo.place, self.word.findall
        split = []
        for text in texts:
            words = find(SPACE + text.replace(" ", SPACE)) if text else []
            if words and max(map(len, words)) > LONG_WORD:
                words = [part for word in words for part in self.parts(word)]
            split.append(words)
        by_length: dict[int, list[str]] = {}
        for word in set().union(*split).difference(place):
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            step = max(1, 200_000 // length)
            for lo in range(0, len(words), step):
                some = words[lo : lo + step]
                memo.add(some, *self.segment(letters_of(some)))
        at = np.fromiter((place[w] for words in split for w in words), np.int64)
        sizes = memo.sizes()[at]
        ids = memo.ids()[np.repeat(memo.heads()[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0] + [len(words) for words in split])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text from all its ids, end to end; the space in front goes."""
        lengths = self.byte_lengths[ids]
        heads = np.cumsum(lengths) - lengths
        at = np.repeat(self.byte_starts[ids] - heads, lengths) + np.arange(int(lengths.sum()))
        flat = self.bytes_of[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[a:b].tobytes().removeprefix(b" ") for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def _codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def encode_texts(rows: DataFrame, model: bytes | None = None) -> DataFrame:
    """``(record, ids, n_pieces, round_trip)``: each whole row of ``rows`` as a struct.

    ``ids`` are the pieces of ``text``; ``round_trip`` tells whether decoding them gives the text
    back, which fails only where it has a literal ``▁`` (it reads as a space). Null and empty
    texts have no pieces. Repeated rows stay; an empty table gives an empty result. No shuffle.
    """
    model = read_model() if model is None else model
    prepared = rows.select(F.struct(*rows.columns).alias("record"), F.col("text").alias("text"))
    schema = T.StructType(
        [
            prepared.schema["record"],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_pieces", T.LongType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(model), Memo()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pc.fill_null(part.column(1), "").to_pylist()
                ids, counts = codec.encode(texts, memo)
                back = codec.decode(ids, counts)
                same = [a == b.encode("utf-8", "surrogatepass") for a, b in zip(back, texts)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids)
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], schema.names
                )

    return prepared.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: bytes | None = None) -> DataFrame:
    """``(record, text)``: each row as a struct and the text of its ``ids`` (null ids: null).

    Bytes that are no valid UTF-8, as only ids made elsewhere can spell, become U+FFFD.
    """
    model = read_model() if model is None else model
    prepared = rows.select(F.struct(*rows.columns).alias("record"), F.col("ids").alias("ids"))
    schema = T.StructType([prepared.schema["record"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(1)
                flat = np.array(lists.flatten().to_pylist(), np.int64)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = [b.decode("utf-8", "replace") for b in codec.decode(flat, counts)]
                known = lists.is_valid().to_pylist()
                column = pa.array([t if ok else None for t, ok in zip(texts, known)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), column], schema.names)

    return prepared.mapInArrow(run, schema)
