"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloscope.session import materialize

#: links up to which one task joins them (16 bytes each)
FEW_LINKS = 100_000


def _components_of_few(links: DataFrame) -> DataFrame:
    """The same for a small table, in one task."""
    def join(batches):
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not ends:
            return
        a, b = (np.concatenate(x) for x in zip(*ends))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b, label = at[:len(a)], at[len(a):], np.arange(len(nodes))  # nodes are sorted, so the smallest place is the smallest node
        while True:
            step = label.copy()
            least = np.minimum(label[a], label[b])
            for x in (a, b, label[a], label[b]):
                np.minimum.at(step, x, least)
            step = step[step]
            if (step == label).all():
                break
            label = step
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

    return materialize(links.select("a", "b").filter("a <> b").coalesce(1).mapInArrow(join, "node long, component long"))


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable: ``node``, ``component`` for every node of ``links`` (``a``, ``b``).

    Few links are joined at once (``FEW_LINKS``, 16 bytes each). With more, each round takes the smallest label among neighbours and then the label's own label, so paths shrink by more
    than half. Rounds work on written tables; nothing but a change count goes to the driver.
    """
    if links.count() <= FEW_LINKS:
        return _components_of_few(links)
    both = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near")))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        jumped = least.join(labels.select(F.col("node").alias("c"), F.col("component").alias("up")), "c", "left")
        step = materialize(jumped.select("node", "was", F.least("c", "up").alias("component")))
        if step.filter("was <> component").isEmpty():
            return labels
        labels = step.select("node", "component")
