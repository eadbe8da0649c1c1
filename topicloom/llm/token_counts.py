"""Token counts of whole texts; huge texts by overlapping chunks that resynchronise.

A piece vocabulary proves where a text may be cut. If two characters stand side by side in
no piece, no merge ever joins them, so the tokens left and right of that boundary do not
depend on each other. ``count_tokens`` encodes a huge text in overlapping chunks with
offsets. In each overlap it looks for a boundary that both encodings have and the vocabulary
proves stable, and splices there: tokens before it come from the left chunk, the others from
the right one. If an overlap has none it is widened, in the end to the whole text.

The count equals the library's on the whole text. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
CHUNK = 32_768  # characters of a chunk; texts up to twice as long are encoded at once
OVERLAP = 256  # characters of the first overlap tried
TOKEN_LIMIT = 4096
SPACE = "▁"

Span = tuple[int, int]  # of a token, in characters


class PieceCounter:
    """Counts tokens with a SentencePiece model given as bytes."""

    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.codec = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = (
            self.codec.id_to_piece(i)
            for i in range(self.codec.get_piece_size())
            if not (self.codec.is_control(i) or self.codec.is_byte(i) or self.codec.is_unknown(i))
        )
        self.bigrams = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        # Cuts are only proven if the model passes characters through one by one.
        probe = "  éﬁ① \t\na  "
        self.identity = self.codec.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can ever cross position ``at`` of ``text``."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.bigrams

    def spans(self, text: str, begin: int, end: int) -> list[Span]:
        """Tokens of a chunk as character spans of the whole text."""
        part = text[begin:end]
        at_byte, byte = {0: begin}, 0
        for k, letter in enumerate(part):
            byte += len(letter.encode("utf-8", "surrogatepass"))
            at_byte[byte] = begin + k + 1
        found = self.codec.encode(part, return_type="proto").pieces
        return [(at_byte[p.begin], at_byte[p.end]) for p in found]

    def splice(self, text: str, left: list[Span], right: list[Span], begin: int, end: int) -> int | None:
        """A stable boundary in ``begin < p < end`` that both encodings have."""
        common = {b for b, _ in left if begin < b < end} & {b for b, _ in right if begin < b < end}
        return next((p for p in sorted(common) if self.stable(text, p)), None)

    def count_long(self, text: str) -> int:
        """Tokens of one text by overlapping chunks."""
        total, begin, kept_from, n = 0, 0, 0, len(text)
        end = min(n, self.chunk)
        left = self.spans(text, begin, end)
        while end < n:
            overlap, cut = self.overlap, None
            while cut is None and end - overlap > kept_from:
                right_from, right_to = end - overlap, min(n, end + self.chunk)
                right = self.spans(text, right_from, right_to)
                cut = self.splice(text, left, right, right_from, end)
                overlap *= 2
            if cut is None:
                # No boundary anywhere in the chunk: let the chunk itself grow.
                end = min(n, end + max(self.chunk, end - begin))
                left = self.spans(text, begin, end)
                continue
            total += sum(1 for b, _ in left if kept_from <= b < cut)
            begin, end, left, kept_from = right_from, right_to, right, cut
        return total + sum(1 for b, _ in left if b >= kept_from)

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        counts = [0] * len(texts)
        limit = 2 * self.chunk if self.identity else float("inf")
        short = [k for k, text in enumerate(texts) if 0 < len(text) <= limit]
        for k, ids in zip(short, self.codec.encode([texts[k] for k in short], num_threads=1)):
            counts[k] = len(ids)
        for k, text in enumerate(texts):
            if len(text) > limit:
                counts[k] = self.count_long(text)
        return counts


@lru_cache(maxsize=2)
def _counter(model: bytes, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(model, chunk, overlap)


def read_model(path: str | None = None) -> bytes:
    """The vocabulary file (about 0.5 MB) as bytes, read on the driver and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as file:
        return file.read()


def count_tokens(
    docs: DataFrame,
    model: bytes | None = None,
    limit: int = TOKEN_LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``; no shuffle.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are;
    other columns are ignored. A text is never cut short.
    """
    model = read_model() if model is None else model
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model, chunk, overlap)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = pc.fill_null(part.column(1), "")
                tokens = counter.count(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
