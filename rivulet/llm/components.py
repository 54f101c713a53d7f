"""Connected components of links by contraction, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.session import fresh_folder


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of links (a, b).

    In each round every node hooks to its smallest neighbour if that is smaller, jumps (each halves the chains that arise) take it to the end of its chain, and
    the edges are drawn anew between what the nodes hook to. Edges inside a component vanish with that, so all edges are
    joined in the first round alone, and what is left shrinks geometrically. No neighbours of a node are ever gathered.
    """
    spark, folder = links.sparkSession, fresh_folder(links.sparkSession, "components")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def drawn(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = written(drawn(links.select("a", "b")), "edges-0")
    both = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(both.select("node", F.col("node").alias("root")), "labels-0")
    turn = 0
    while edges.limit(1).count():
        turn += 1
        hooks, jump = written(edges.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")), f"hooks-{turn}-0"), 0
        while hooks.select(F.col("to").alias("from")).join(hooks.select("from"), "from", "left_semi").limit(1).count():
            jump += 1
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("further"))
            hooks = written(hooks.join(further, "to", "left").select("from", F.coalesce("further", "to").alias("to")), f"hooks-{turn}-{jump}")

        def moved(frame: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            to = hooks.select(F.col("from").alias(column), F.col("to").alias("hooked"))
            return frame.join(to, column, "left").withColumn(column, F.coalesce("hooked", column)).drop("hooked")

        edges = written(drawn(moved(moved(edges, "a"), "b")), f"edges-{turn}")
        labels = written(moved(labels, "root"), f"labels-{turn}")
    return labels.select("node", "root")
