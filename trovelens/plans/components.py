"""Connected components of a graph given as links, by hooking to the smallest label and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelens.plans.lineage import cut
from trovelens.plans.skew import LEAST, skewed_join


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node in ``links`` (a long, b long); component is the smallest node it reaches.

    Each round every node takes the smallest label among its own and its neighbours', then the label
    of that label, so a chain of labels halves. Labels only fall, and the loop ends when none does.
    Rounds are written tables; only their number of changes comes to the driver. A hub's links and a giant
    component's nodes would each be one join key: both joins deal their hot keys to many places.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = cut(edges)
    # A key is hot only with more than LEAST rows, which small graphs don't have.
    dealt = edges.count() > LEAST
    degrees = cut(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))) if dealt else None

    def joined(many: DataFrame, one: DataFrame, key: str, sizes: DataFrame | None) -> DataFrame:
        return skewed_join(many, one, [key], sizes=sizes) if dealt else many.join(one, key)

    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = joined(edges, labels.select(F.col("node").alias("b"), "component"), "b", degrees).groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        hooked = cut(hooked)
        of = hooked.select(F.col("node").alias("c"), F.col("c").alias("next"))
        labels = cut(joined(hooked, of, "c", None).select("node", "was", F.least("c", "next").alias("component")))
        if labels.filter("component <> was").isEmpty():
            return labels.select("node", "component")
