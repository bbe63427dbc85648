"""Connected components of a link table, as joins that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Each round takes the smallest label among neighbours, then the label's own
    label, so that long chains shrink fast; hubs are pre-aggregated by the
    grouped minimum, and in the join labels stand once for each node, so that a
    hub's links can be split. Every round is written to the shared folder, and
    removed when the next one stands.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a)))
    both = written(both.where("node <> other").distinct(), f"{name}-links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label").hint("shuffle_hash"), "other").groupBy("node").agg(F.min("label").alias("low"))
        stepped = labels.select("node", "label").join(near.hint("shuffle_hash"), "node").select("node", "label", F.least("label", "low").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        jumped = written(stepped.join(up.hint("shuffle_hash"), "low").select("node", F.col("top").alias("label"), (F.col("top") < F.col("label")).alias("changed")), name)
        discard(labels)
        labels = jumped
        if jumped.where("changed").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
