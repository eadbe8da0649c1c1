"""XML files read by many tasks each, whatever comments, CDATA sections or single-byte encoding they hold.

A file is cut before every closing record tag, split by split. Whether a cut is a real end depends on where
in the markup it lies, which a task that begins in the middle of a file cannot know. So

1. every chunk is taken as a function from the lexer's state at its start to the state at its end,
   and the functions are composed chunk by chunk within a split;
2. the functions of whole splits, one small row each, are composed file by file, which tells every split the
   state it begins in;
3. with that state each chunk drops comments and instructions and writes CDATA as escaped text, and chunks that a
   comment or CDATA section runs across are put together, one record at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.stash import broadcast_if_small, stash

# States of the lexer; the openings and closings are fixed values of XML.
TEXT, COMMENT, CDATA, INSTRUCTION = STATES = range(4)
OPENING = re.compile(rb"<!--|<!\[CDATA\[|<\?")
ENTERED = {b"<!--": COMMENT, b"<![CDATA[": CDATA, b"<?": INSTRUCTION}
CLOSING = {COMMENT: b"-->", CDATA: b"]]>", INSTRUCTION: b"?>"}
TAG_END = re.compile(rb"\A\s*>")

CHUNKS = (
    "file string, start long, number long, chunk binary, "
    "before array<int>, ended array<long>, after array<int>, ends array<long>"
)
SPLITS = "file string, start long, state int, ended long"
PARTS = "file string, run long, start long, number long, whole boolean, text string"


def walk(chunk: bytes, state: int) -> tuple[list[tuple[int, int, int]], int]:
    """Stretches ``(state, from, to)`` of a chunk entered in ``state``, and the state it is left in."""
    at, found = 0, []
    while True:
        if state == TEXT:
            opening = OPENING.search(chunk, at)
            end = opening.start() if opening else -1
        else:
            end = chunk.find(CLOSING[state], at)
        found.append((state, at, len(chunk) if end < 0 else end))
        if end < 0:
            return found, state
        if state == TEXT:
            state, at = ENTERED[opening.group()], opening.end()
        else:
            state, at = TEXT, end + len(CLOSING[state])


def escaped(text: bytes) -> bytes:
    return text.replace(b"&", b"&amp;").replace(b"<", b"&lt;").replace(b">", b"&gt;")


def visible(chunk: bytes, state: int, tag: bytes) -> tuple[bytes, int]:
    """What a chunk entered in ``state`` adds to its record, with the cut behind it, and the state it is left in."""
    stretches, left = walk(chunk, state)
    parts = []
    for kind, lo, hi in stretches:
        part = chunk[lo:hi]
        if kind == TEXT:
            # What is left of the closing tag before this chunk.
            parts.append(TAG_END.sub(b"", part) if state == TEXT and lo == 0 else part)
        elif kind == CDATA:
            parts.append(escaped(part))
    if left == TEXT:
        parts.append(b"</" + tag + b">")
    elif left == CDATA:
        parts.append(escaped(b"</" + tag))
    return b"".join(parts), left


def compose_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's splits, in order, with the composed functions before and behind them.

    For each state that the split may begin in: the state, and the number of real ends so far.
    """
    place, number, state, ends = None, 0, [], []
    schema = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("chunk", pa.binary())]
        + [(name, pa.list_(pa.int32() if name in ("before", "after") else pa.int64())) for name in ("before", "ended", "after", "ends")]
    )
    for batch in batches:
        rows = []
        for file, start, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, start) != place:
                place, number, state, ends = (file, start), 0, list(STATES), [0] * len(STATES)
            left = {s: walk(chunk, s)[1] for s in set(state)}
            after = [left[s] for s in state]
            new = [n + (s == TEXT) for n, s in zip(ends, after)]
            rows.append((file, start, number, chunk, state, ends, after, new))
            number, state, ends = number + 1, after, new
        columns = list(zip(*rows)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def compose_splits(splits: pd.DataFrame) -> pd.DataFrame:
    """State at the start of every split of one file, and the real ends before it."""
    splits = splits.sort_values("start")
    state, ended, found = TEXT, 0, []
    for after, ends in zip(splits["after"], splits["ends"]):
        found.append((state, ended))
        state, ended = int(after[state]), ended + int(ends[state])
    return splits[["file", "start"]].assign(state=[s for s, _ in found], ended=[n for _, n in found])


def record_texts(spark: SparkSession, files: list[str], tag: str, encoding: str) -> DataFrame:
    """``(file, text)``: stretches of ``files``, each up to a real closing tag, without comments and CDATA marks.

    ``encoding`` must write ASCII characters as ASCII bytes. The chunks are kept in the shared folder, since
    they are used twice. A file has one row per split in the second step: for 1 TB in splits of 128 MB, 8,000.
    """
    lines = spark.read.option("lineSep", f"</{tag}").text(files)
    raw = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("chunk"),
    )
    chunks = stash(raw.mapInArrow(compose_chunks, CHUNKS), "chunks")
    splits = chunks.groupBy("file", "start").agg(F.max_by(F.struct("after", "ends"), "number").alias("last"))
    entered = splits.select("file", "start", "last.*").groupBy("file").applyInPandas(compose_splits, SPLITS)
    placed = chunks.drop("after", "ends").join(
        broadcast_if_small(stash(entered.withColumnRenamed("ended", "ended_before"), "splits")), ["file", "start"]
    )
    placed = placed.select(
        "file",
        (F.col("ended_before") + F.get("ended", F.col("state"))).alias("run"),
        "start",
        "number",
        F.get("before", F.col("state")).alias("state"),
        "chunk",
    )
    name = tag.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole = [], []
            for state, chunk in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                text, left = visible(chunk, state, name)
                texts.append(text.decode(encoding, "replace"))
                whole.append(state == left == TEXT)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(whole, pa.bool_()), pa.array(texts, pa.string())],
                ["file", "run", "start", "number", "whole", "text"],
            )

    parts = stash(placed.mapInArrow(run, PARTS).where("text <> ''"), "parts")
    pieces = F.array_sort(F.collect_list(F.struct("start", "number", "text")))
    joined = parts.where("NOT whole").groupBy("file", "run").agg(F.array_join(pieces["text"], "").alias("text"))
    return parts.where("whole").select("file", "text").unionByName(joined.select("file", "text"))
