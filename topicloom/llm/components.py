"""Connected components of a link table, inside tasks and across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import join_groups
from topicloom.stash import row_count, stash

LINKS = "u long, v long"


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to stars: every node but the smallest of its component, with that smallest node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: u.size], at[u.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(nodes.size)
    return nodes[far], nodes[label[far]]


def links_out(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Contract what one task has found: at most one link per node leaves it."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for a, b in parts:
        if a.size:
            u, v = contract(np.concatenate((u, a)), np.concatenate((v, b)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame, name: str) -> DataFrame:
    """``(node, label)`` of every node but the smallest of its component, from ``(u, v)`` links.

    Each round connects all neighbours of a node to the smallest of them, and a table in the
    shared folder ends its lineage. It stops when only stars are left. A hub is cut into
    slices when its links are joined back.
    """
    apart = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = stash(apart.distinct(), name)
    while True:
        n = row_count(links)
        if not n:
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")
        )
        joined = join_groups(both, least, ["u"], "degree", ["v"], 2 * n)
        pairs = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        new = pairs.where("p.v <> p.m").select(
            F.greatest("p.v", "p.m").alias("u"), F.least("p.v", "p.m").alias("v")
        )
        links = stash(new.distinct(), name)
        many = links.groupBy("u").count().where("count > 1").select("u")
        chained = links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if not many.union(chained).limit(1).count():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
