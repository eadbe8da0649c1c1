"""Mixing sources to target weights by systematic sampling.

1. Sources are numbered in order (nulls last) and get weights; their targets are a water level: weight
   times level, but at most ``most`` times what the source has.
2. Every document expects a number of copies, at first target by size of its source. Laid end to end, the
   expected copies of a source's documents are an interval; prefix sums tell where each one's piece lies. One random
   offset per source shifts integer marks over the interval, and a document is emitted once for each mark
   within its piece. So it gets its expected copies rounded down or up, and neighbours make up for each other.
3. Documents are laid out from the longest to the shortest in a few phases. A phase expects what the earlier ones
   left of the target, so the rounding of a very long document is made up by the shorter ones behind it. Where
   these could not make up for it, as the document is longer than all that is due (or than all that may be left out), its
   phase expects none (or ``most``), and the shorter ones are the mix.

Positions need no sorted source: documents fall into cells (source, class of sizes, slice of an id
hash) of a bounded number of rows, cells are counted, and only within a cell are rows ranked. Documents of a
phase expect the same, so the prefix sum inside it is position times rate, which no order of summation can change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import MAX_HEAVY_KEYS, join_groups
from topicloom.operators.levels import numbered
from topicloom.stash import fits_broadcast, row_count, stash


@dataclass(frozen=True)
class Settings:
    """``weights`` go to the sources in order, repeating. Targets add up to ``share`` of all words.

    No document is taken more than ``most`` times. A new phase begins where the longer documents hold
    ``phases`` 16ths of a source's words. ``rows_per_cell`` rows are ranked together.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    share: float = 1.0
    most: int = 3
    phases: tuple[int, ...] = (2, 4, 8, 12, 14)
    seed: int = 11
    rows_per_cell: int = 500


def word_count(text: Column | str) -> Column:
    """Runs of characters other than blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of a digest."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    """Sixteen classes per doubling, in order of size; below 32 each size is one."""
    shift = F.greatest(F.length(F.bin(size)) - 5, F.lit(0)).cast("int")
    return (shift * 32 + F.call_function("shiftright", size, shift)).cast("int")


def water_level(sources: DataFrame, total: int, share: float) -> tuple[float, float]:
    """``(amount, weight)``: the level amount / weight at which capped targets add up to ``share * total``.

    ``sources`` has ``weight`` and ``cap``. The excess of sources at their cap is shared by the
    others, which can lift more of them to theirs; each round is one aggregate of the table.
    """
    amount, weight, capped = float(total) * share, 0.0, -1
    while True:
        reached = F.lit(False) if not weight else F.col("cap") * weight < F.col("weight") * amount
        n, caps, weights = sources.agg(
            F.count_if(reached), F.sum(F.when(reached, F.col("cap"))), F.sum(F.when(~reached, F.col("weight")))
        ).first()
        if n == capped or not weights:
            return amount, weight
        capped, amount, weight = n, float(total) * share - (caps or 0), float(weights)


def source_targets(grouped: DataFrame, settings: Settings) -> DataFrame:
    """``(source_key, n_rows, source_size, target, start)`` per source; ``start`` is its random offset."""
    sources = numbered(grouped, "source_key")
    weights = F.array(*[F.lit(w) for w in settings.weights])
    sources = sources.withColumn("weight", F.get(weights, F.pmod("ix", F.lit(len(settings.weights)))))
    sources = sources.withColumn("cap", (F.col("source_size") * settings.most).cast("double"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    amount, weight = water_level(sources, total, min(settings.share, float(settings.most)))
    level = F.col("weight") * F.lit(amount) / F.lit(weight or 1.0)
    reached = F.col("cap") * F.lit(weight) < F.col("weight") * F.lit(amount)
    return sources.select(
        "source_key",
        "n_rows",
        "source_size",
        F.when(reached, F.col("cap")).otherwise(F.least(level, "cap")).alias("target"),
        unit(F.md5(F.concat(F.lit(f"{settings.seed}:"), F.substring("source_key", 2, 1 << 30)))).alias("start"),
    )


def prepare(docs: DataFrame, settings: Settings = Settings(), keep_rows: bool = True) -> DataFrame:
    """Sizes and keys of ``docs``, written to the shared folder; with the whole row in ``record`` if kept."""
    record = F.struct(*docs.columns) if keep_rows else F.struct("doc_id")
    digest = F.md5(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(
        record.alias("record"),
        word_count("text").alias("size"),
        # Nulls get a key of their own, behind all others.
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
        digest.alias("digest"),
        # Tells rows under one id apart.
        F.xxhash64("text").alias("text_hash"),
    )
    return stash(sized.withColumn("class", size_class(F.col("size"))), "sized")


def positions(rows: DataFrame, sources: DataFrame, settings: Settings) -> DataFrame:
    """``(record, size, source_key, phase, position)``: each row's place from 1 in its source's phase."""
    total = row_count(rows)
    kinds = rows.groupBy("source_key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    longer = Window.partitionBy("source_key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = stash(kinds.withColumn("above", F.coalesce(F.sum("words").over(longer), F.lit(0))), "kinds")
    # What share of the words is longer tells the phase; integers, so no rounding.
    passed = [F.when(F.col("above") * 16 >= F.col("source_size") * k, 1).otherwise(0) for k in settings.phases]
    sizes = sources.select("source_key", "source_size")
    sizes = F.broadcast(sizes) if fits_broadcast(sizes) else sizes
    # At most as many heavy kinds as cells fit into all rows, so their list may be broadcast.
    per_cell = max(settings.rows_per_cell, -(-total // MAX_HEAVY_KEYS))
    heavy = kinds.where(F.col("n") > per_cell).select(
        "source_key", "class", F.ceil(F.col("n") / F.lit(per_cell)).cast("int").alias("n_cells")
    )
    cell = F.floor(unit(F.col("digest")) * F.coalesce("n_cells", F.lit(1))).cast("int")
    placed = rows.join(F.broadcast(heavy), ["source_key", "class"], "left").withColumn("cell", cell).drop("n_cells")

    keys = ["source_key", "class", "cell"]
    phases = kinds.join(sizes, "source_key").select("source_key", "class", sum(passed, F.lit(0)).alias("phase"))
    cells = placed.groupBy(*keys).agg(F.count("*").alias("n")).join(phases, ["source_key", "class"])
    earlier = Window.partitionBy("source_key", "phase").orderBy(F.desc("class"), "cell")
    before = F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = stash(cells.select(*keys, "phase", before.alias("before")), "cells")
    inside = Window.partitionBy(*keys).orderBy("size", "digest", "record.doc_id", "text_hash")
    ranked = placed.withColumn("place", F.row_number().over(inside))
    ranked = ranked.join(F.broadcast(cells) if fits_broadcast(cells) else cells, keys)
    return ranked.select(
        "record", "size", "source_key", "digest", "phase", (F.col("before") + F.col("place")).alias("position")
    )


def plan_copies(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(record, size, source_size, target, expected, copies, taken)`` of every row that ``prepare`` wrote."""
    grouped = rows.groupBy("source_key").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    sources = stash(source_targets(stash(grouped, "sources"), settings), "targets")
    few, total = fits_broadcast(sources), row_count(rows)
    placed = stash(positions(rows, sources, settings), "positions")

    def with_rates(some: DataFrame, rates: DataFrame) -> DataFrame:
        keys = ["source_key", "phase"]
        if few:
            return some.join(F.broadcast(rates.drop("n_phase")), keys)
        return join_groups(some, rates, keys, "n_phase", ["digest"], total, "inner")

    # The whole copies of a rate are equal for all; the marks share out its fraction.
    rate, place, start = F.col("rate"), F.col("position").cast("double"), F.col("start")
    part = rate - F.floor("rate")
    copies = F.floor("rate") + F.floor(place * part + start) - F.floor((place - 1.0) * part + start)
    taken = F.col("size") * copies

    totals = stash(
        placed.groupBy("source_key", "phase").agg(
            F.count("*").alias("n_phase"), F.sum("size").alias("words"), F.max("size").alias("longest")
        ),
        "phases",
    )
    rates = None
    left = sources.select("source_key", F.col("target").alias("due"), F.col("source_size").alias("rest"), "start")
    most, due, rest = float(settings.most), F.col("due"), F.col("rest")
    behind, risk = rest - F.col("words"), F.col("longest") * rest
    for phase in range(len(settings.phases) + 1):
        spare = rest * most - due
        expected = (
            F.when(rest <= 0, 0.0)
            .when((due * behind < risk) & (due * 2 <= behind * most), 0.0)
            .when((spare * behind < risk) & (spare * 2 <= behind * most), most)
            .otherwise(F.least(F.greatest(due / rest, F.lit(0.0)), F.lit(most)))
        )
        of_phase = totals.where(F.col("phase") == phase).join(left, "source_key").withColumn("rate", expected)
        rates = of_phase if rates is None else rates.unionByName(of_phase)
        if phase < len(settings.phases):
            chosen = with_rates(placed.where(F.col("phase") == phase), of_phase.select("source_key", "phase", "n_phase", "rate", "start"))
            got = chosen.groupBy("source_key").agg(F.sum(taken).alias("got"))
            end = start + F.col("n_phase") * part
            after = of_phase.join(got, "source_key").select(
                "source_key",
                (F.col("due") - F.col("got")).alias("new_due"),
                (F.col("rest") - F.col("words")).alias("new_rest"),
                (end - F.floor(end)).alias("new_start"),
            )
            left = left.join(after, "source_key", "left").select(
                "source_key", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("due", "rest", "start")]
            )
            left = stash(left, "left")
    rates = rates.select("source_key", "phase", "n_phase", "rate", "start")
    rates = stash(rates.join(sources.select("source_key", "source_size", "target"), "source_key"), "all-rates")
    return with_rates(placed, rates).select(
        "record", "size", "source_size", "target", rate.alias("expected"), copies.cast("int").alias("copies"), taken.alias("taken")
    )


def mix_sources(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix itself: the whole rows of ``docs``, each as often as it is taken, with ``copy`` from 1.

    Rows are ``(record, copy)``; columns of ``docs`` may have any names. ``docs`` has ``doc_id``, ``text`` and
    ``source``. Null ids and null or empty texts have size 0 and are sampled like others; a source without words has target 0 and gives no row. Null
    sources are one source, the last. Repeated rows are rows of their own, next to each other, so they share copies
    between them; which of two equal rows is taken makes no difference. An empty table
    gives an empty mix. The same table and seed give the same mix, however it is partitioned.
    """
    planned = plan_copies(prepare(docs, settings), settings).where("copies > 0")
    return planned.select("record", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
