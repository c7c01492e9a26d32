"""Connected components of an edge table as joins and aggregates.

In a round every node points to the smallest of itself and its neighbours, and on to
where that one points; then the edges are drawn between what their ends point to. An
edge inside one node disappears, equal edges become one, so the table shrinks from
round to round. Each round is written; only the count of edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, join_checked


def components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(k, comp) for each node of the written ``edges`` (a, b): comp is the smallest key reachable."""
    labels, turn, kind = None, 0, dict(edges.dtypes)["a"]
    while True:
        both = edges.select(F.col("a").alias("k"), "b").unionAll(edges.select(F.col("b").alias("k"), F.col("a").alias("b")))
        near = space.table(both.groupBy("k").agg(F.least("k", F.min("b")).alias("to")), f"{name}-near{turn}")
        nodes = near.count()  # of ends too
        onward = near.select(F.col("k").alias("to"), F.col("to").alias("end"))
        ends = space.table(join_checked(near, onward, "to", rows=nodes).select("k", "end"), f"{name}-ends{turn}")
        if labels is None:
            labels = ends.withColumnRenamed("end", "comp")
        else:
            moved = join_checked(labels, ends.select(F.col("k").alias("comp"), "end"), "comp", "left", rows=nodes)
            labels = space.table(moved.select("k", F.coalesce("end", "comp").alias("comp")), f"{name}-labels{turn}")
        drawn = join_checked(edges.select("a", "b"), ends.select(F.col("k").alias("a"), F.col("end").alias("x")), "a", rows=nodes)
        drawn = join_checked(drawn, ends.select(F.col("k").alias("b"), F.col("end").alias("y")), "b", rows=nodes)
        drawn = drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = space.table(drawn.select(F.col("a").cast(kind), F.col("b").cast(kind)), f"{name}-edges{turn}")
        turn += 1
        if edges.isEmpty():
            return labels
