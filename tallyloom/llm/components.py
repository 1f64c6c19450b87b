"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of links, every node with the smallest node it reaches within the batch."""
    for b in batches:
        if not b.num_rows:
            continue
        nodes, ends = np.unique(np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()]), return_inverse=True)
        u, v = ends[: b.num_rows], ends[b.num_rows :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node of the links ``u``, ``v`` but the roots.

    Links are contracted batch by batch and then by alternating large-star and small-star steps, so a hub's
    neighbours are only ever grouped by partial minima. Each round is written to the shared folder.
    """
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = common.materialize(e.mapInArrow(contract, "u long, v long").distinct(), "links")
    before = old = None
    while True:
        common.discard(old)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        # Large star: every larger neighbour of a node is linked to the smallest of the node's neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        old, e = e, common.materialize(small.where("u <> v").distinct(), "links")
