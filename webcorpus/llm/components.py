"""Connected components of an edge table by least-label propagation.

Each round every node takes the least label among its neighbours and its own, the node
that its old label names takes it as well (hooking), and labels are then replaced by
their labels (pointer jumping). Only joins and partially aggregated minima; every round
is written to the shared folder, so no round is repeated when an executor is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the least node reachable."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_shared(both.where("a is not null and b is not null").distinct(), "edges")
    labels = write_shared(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")

    def total(frame):
        return frame.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]

    before = total(labels)
    while before is not None:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
        near = near.groupBy("a").agg(F.min("near").alias("near"))
        own = labels.join(near.withColumnRenamed("a", "node"), "node")
        moved = own.select("node", F.least("label", "near").alias("label")).unionByName(own.select(F.col("label").alias("node"), "near").withColumnRenamed("near", "label"))
        moved = moved.groupBy("node").agg(F.min("label").alias("label"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("over"))
        labels = write_shared(moved.join(jump, "label").select("node", F.least("label", "over").alias("label")), "labels")
        after = total(labels)
        if after == before:
            break
        before = after
    return labels.withColumnRenamed("label", "component")


def forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links (rows a and b of ``node``) as stars: the least node of
    each with every other one. Fewer edges than nodes, and tables that see parts of one
    component mostly name the same centres."""
    ids, place = np.unique(node[np.append(a, b)], return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[out]], ids[out]
