"""Connected components of a table of links, by rounds of joins: nothing gathers in one task or the driver.

Each node's label falls to the smallest label beside it, then to its label's label, until no label changes. Labels are
nodes of the same component and the smallest node keeps its own, so at the end each label is the component's smallest node.
Short cuts over labels keep the rounds near the logarithm of the longest path. Up to ALONE links (4 MB) take one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.scratch import Scratch

#: Links up to which one task finds the components, as rounds would cost more than the work.
ALONE = 1 << 18


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all links at once, by the same rounds over arrays."""
    sides = [np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*((b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches), strict=True)]
    nodes, at = np.unique(np.concatenate(sides or [np.zeros(0, dtype=np.int64)]), return_inverse=True)
    a, b = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (before[a], before[b], a, b):
            np.minimum.at(label, side, least)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def joined(labels: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (node, label) that more links (a, b) make of those there are."""
    over = labels.select(F.col("node").alias("_node"), F.col("label").alias("_over"))
    for side in "ab":
        more = more.join(over, F.col(side) == F.col("_node"), "left").withColumn(side, F.coalesce("_over", side)).drop("_node", "_over")
    found = scratch.keep(components(more, scratch), "labels").select(F.col("node").alias("_node"), F.col("label").alias("_to"))
    old = labels.join(found, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    new = found.join(labels, F.col("_node") == F.col("node"), "left_anti").select(F.col("_node").alias("node"), F.col("_to").alias("label"))
    return old.union(new)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label of every node of links (a, b): label is the smallest node that links lead to."""
    links = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if links.count() <= ALONE:
        labels = scratch.keep(links.coalesce(1).mapInArrow(_alone, "node long, label long"), "labels")
        scratch.drop(links)
        return labels
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        hooked = labels.join(beside, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "_near").alias("_to"))
        root = labels.select(F.col("node").alias("_to"), F.col("label").alias("_over"))
        jumped = hooked.join(root, "_to", "left").select("node", F.least(F.col("_to"), F.col("_over")).alias("label"), (F.least(F.col("_to"), F.col("_over")) < F.col("label")).alias("moved"))
        after = scratch.keep(jumped, "labels")
        scratch.drop(labels)
        labels = after
        if labels.where("moved").isEmpty():
            scratch.drop(links)
            return labels.select("node", "label")
