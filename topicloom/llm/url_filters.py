"""URL verdicts from glob rules, all of them at once, by a bit-parallel automaton.

A canonical URL is ``.host/path``: host lower-cased for A-Z, query and fragment gone. Glob
syntax: ``*`` is any run of characters other than ``/``, ``**`` any run at all, everything
else is literal; a glob fits the whole canonical URL. All globs are packed side by side into
64-bit words (Shift-And): one bit per position, one shift, and two table look-ups per byte
advance every rule over every URL of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import text_slices

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains when the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


# The host rules of the contract.
HOST_RULES = (
    HostRule(BLOCK, "net", "/"),
    HostRule(ALLOW, "example.net", "/en/"),
    HostRule(BLOCK, "example.com", "/de/"),
    HostRule(ALLOW, "org", "/fr/"),
)

# Bytes of automaton state that a task holds at a time.
STATE_BYTES = 8 << 20

# The filter's own block list, for URLs that no host rule fits; whatever is left is allowed.
BLOCK_GLOBS = (
    "*spam-farm*/**",
    "*cheap-pills*/**",
    "*casino*/**",
    "**/ads/**",
    "**/wp-login.php",
)


class GlobAutomaton:
    """Shift-And over many globs. Bit 0 of a glob is its start, the last one its acceptance.

    Built once, in time linear in the rules, and sent to the tasks: its tables take 256 bits per position.
    """

    def __init__(self, globs: Sequence[str]):
        self.globs = tuple(globs)
        literals, literal_bits, shallow, deep, starts, finals, at = [], [], [], [], [], [], 0
        for glob in self.globs:
            starts.append(at)
            data, k = glob.encode(), 0
            while k < len(data):
                if data[k] != ord("*"):
                    at += 1
                    literals.append(data[k])
                    literal_bits.append(at)
                    k += 1
                elif data[k : k + 2] == b"**":
                    deep.append(at)
                    k += 2
                else:
                    shallow.append(at)
                    k += 1
            finals.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        bits = np.array(literal_bits, np.int64)
        np.bitwise_or.at(self.step, (np.array(literals, np.int64), bits // 64), _one(bits))
        # Loops for any byte but "/", and those for "/".
        self.stay = np.stack([self._mask(deep + shallow), self._mask(deep)])
        self.initial, self.final = self._mask(starts), self._mask(finals)
        self.finals = np.array(finals, np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        bits, mask = np.array(bits, np.int64), np.zeros(self.words, np.uint64)
        np.bitwise_or.at(mask, bits // 64, _one(bits))
        return mask

    def advance(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """One byte for every URL: ``state`` is URLs x words, ``byte`` one value per URL."""
        shifted = state << np.uint64(1)
        shifted[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return (shifted & self.step[byte]) | (state & self.stay[(byte == ord("/")).astype(np.intp)])

    def accepted(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Acceptance bits, URLs x words. Longer URLs stay active while shorter ones are done."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        heads, left = offsets[:-1][order], lengths[order]
        state = np.tile(self.initial, (lengths.size, 1))
        for k in range(int(left[0]) if left.size else 0):
            active = int(np.searchsorted(-left, -k, "left"))
            state[:active] = self.advance(state[:active], data[heads[:active] + k])
        out = np.empty_like(state)
        out[order] = state & self.final
        return out

    def first(self, data: np.ndarray, offsets: np.ndarray, state_bytes: int = STATE_BYTES) -> np.ndarray:
        """Number of the first glob that fits each URL, or -1, in slices whose state takes ``state_bytes``."""
        found = np.full(offsets.size - 1, -1, np.int64)
        rows = max(1, state_bytes // (8 * self.words))
        for lo in range(0, found.size, rows):
            state = self.accepted(data, offsets[lo : lo + rows + 1])
            word = (state != 0).argmax(axis=1)
            value = state[np.arange(len(state)), word]
            lowest = value & (~value + np.uint64(1))
            bit = word * 64 + np.frexp(lowest.astype(np.float64))[1] - 1
            hit = value != 0
            found[lo : lo + rows][hit] = np.searchsorted(self.finals, bit[hit])
        return found


def _one(bits: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (bits % 64).astype(np.uint64)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    upper = [chr(c) for c in range(65, 91)]
    return F.coalesce(F.translate(found, "".join(upper), "".join(upper).lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, glob)`` per row of ``pages``; no shuffle.

    The host rule with the longest name that fits decides; ``rule`` names it. Without one,
    the first block glob that fits decides (``glob``), else the URL is allowed. A null URL or
    one without ``://`` has an empty host and path, fits nothing and is allowed. Repeated rows
    stay; other columns are ignored.
    """
    # In the order in which they decide, so that the first one that fits is the verdict.
    ranked = sorted(host_rules, key=lambda rule: -len(rule.name))
    automaton = GlobAutomaton([rule.glob for rule in ranked] + list(block_globs))
    unset = [None] * len(ranked)
    # The last entry, which number -1 picks, is for URLs that nothing fits.
    names = np.array([rule.name for rule in ranked] + [None] * (len(block_globs) + 1), object)
    verdicts = np.array([rule.verdict for rule in ranked] + [BLOCK] * len(block_globs) + [ALLOW], object)
    own_globs = np.array(unset + list(block_globs) + [None], object)
    schema = T.StructType(
        [pages.schema["page_id"]]
        + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "glob")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(3)):
                first = automaton.first(data, offsets)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2)]
                    + [pa.array(x[first], pa.string()) for x in (names, verdicts, own_globs)],
                    ["page_id", "host", "path", "rule", "verdict", "glob"],
                )

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.select("*", F.concat(F.lit("."), "host", "path").alias("canonical")).mapInArrow(run, schema)
