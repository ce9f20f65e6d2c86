"""Connected components by contraction, in tables: neither links nor components come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likegraph.llm.shared import drop_written, written
from likegraph.spread import dealt, hot_keys, joined, met


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b: long); a component's nodes share a root.

    In each round every node goes to the neighbour of most links (ties: the least id), or stays if it is
    that itself, and links between what they went to are left. A star of any size takes one round. Null
    ends and links of a node to itself make no link; repeated links count once; no links, no rows. A node
    of very many links, or a root of very many nodes, is dealt to several tasks.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = written(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")), "degrees")
        ends_at = lambda x: degree.select(F.col("node").alias(x), F.col("d").alias("_n"))
        links_left = edges.count()
        ends = joined(both, degree.select(F.col("node").alias("b"), "d"), ["b"], ends_at("b"), 2 * links_left)
        best = ends.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("d", (-F.col("b")).alias("k"))).alias("best"))
        goes = written(
            best.join(degree, "node").select("node", F.when(F.struct("best.d", "best.k") > F.struct("d", (-F.col("node")).alias("k")), -F.col("best.k")).otherwise(F.col("node")).alias("root")),
            "goes",
        )
        moved = joined(labels, goes.select(F.col("node").alias("root"), F.col("root").alias("next")), ["root"], how="left").select("node", F.coalesce("next", "root").alias("root")) if labels is not None else goes
        new_labels = written(moved, "labels")
        hot = [hot_keys(ends_at(x), 2 * links_left) for x in "ab"]
        left = dealt(dealt(edges, hot[0], ["a"], "_pa"), hot[1], ["b"], "_pb")
        for x, h in zip("ab", hot, strict=True):
            left = met(left, goes.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), h, [x], part=f"_p{x}")
        new_edges = written(left.filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
        drop_written(edges, goes, degree, *([labels] if labels is not None else []))
        edges, labels = new_edges, new_labels
        if edges.isEmpty():
            return labels
