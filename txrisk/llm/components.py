"""Connected components of a link table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all ends of ``links`` (a, b: long); component: the smallest node reachable.

    Each round gives every node, and the node it points at, the smallest label
    among its neighbours, then halves the pointer chains; the number of rounds
    grows with the logarithm of the longest path.  Every round is written, so
    nothing is recomputed after a loss.  Joins read written tables on both sides,
    so that the runtime can split hub nodes.  Null ends are left out.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = scratch.keep(
        links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                     .alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).distinct(), "edges")
    labels = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m"))
                          .select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("v"), "label"), "v")
                .groupBy("u").agg(F.min("label").alias("m")))
        hooked = (labels.join(near, labels["node"] == near["u"])
                  .select(F.explode(F.array(
                      F.struct(F.col("node"), F.least("label", "m").alias("label")),
                      F.struct(F.col("label").alias("node"), F.least("label", "m").alias("label")))).alias("x"))
                  .groupBy("x.node").agg(F.min("x.label").alias("label")))
        hooked = scratch.keep(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = hooked.join(up, "label").select("node", F.least("label", "top").alias("next"))
        new = scratch.keep(
            jumped.join(labels, "node").select("node", F.col("next").alias("label"),
                                               (F.col("next") != F.col("label")).alias("moved")), "labels")
        if new.filter("moved").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
