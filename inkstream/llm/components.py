"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.staging import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    Labels spread along edges and jump to their own label's label, so a chain of
    n nodes takes about log n rounds; every round's table is written to the
    shared folder. Ends when no label changes; it is an error if 64 rounds don't
    do.
    """
    ways = F.array(*(F.struct(F.col(a).alias("node"), F.col(b).alias("next")) for a, b in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))))
    both = written(edges.where("a <> b").select(F.inline(ways)).distinct())
    label = written(both.groupBy("node").agg(F.min("next").alias("root")))
    for _ in range(64):
        own = F.max(F.when(F.col("node") == F.col("next"), F.col("root"))).alias("old")
        new = both.join(label.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("root").alias("new"), own)
        # a label's own label is a shortcut
        new = new.join(label.select(F.col("node").alias("new"), F.col("root").alias("jump")), "new")
        new = written(new.select("node", F.least("new", "jump").alias("root"), "old"))
        label = new.select("node", "root")
        if not new.where("root <> old").take(1):
            return label
    raise RuntimeError("labels of components still change after 64 rounds")
