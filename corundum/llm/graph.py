"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations and joins over links only and is written to the shared folder, so
no round recomputes another and nothing is gathered on the driver. A star's centre is aggregated
before the shuffle; its many links are split by the adaptive skew join. A round that the next one
has read is removed.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import drop_dir, written


def components(links: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node that a link (a, b) names."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, folder, f"{name}0")
    for k in count(1):
        # Edges go from larger to smaller nodes. Where no node has two parents, or one and children,
        # they are stars around their smallest nodes, which are the components.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children"))
        ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("parents").alias("parents"), F.max("children").alias("children"))
        if ends.where("parents > 1 or parents = 1 and children = 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, folder, f"{name}{k}")
        drop_dir(edges.sparkSession, f"{folder}/{name}{k - 1}")


def of_documents(signed: DataFrame, reps: DataFrame, links: DataFrame, folder: str, id_of: Callable[[Column], Column] = lambda rep: rep) -> DataFrame:
    """id, n_shingles, class_id and component_id of each row of signed (id, and n, low and high: the
    size and the signature of its set). reps: the node of each class (n, low, high, rep); links are
    between nodes; id_of gives a node's id. Rows that share an id link the classes that they are in.
    An empty set is in no class; a null id has no component."""
    c = F.col
    sign = F.struct("n", "low", "high")
    unlike = signed.where("id is not null").groupBy("id").agg(F.min(sign).alias("least"), F.max(sign).alias("most")).where("least <> most").select("id")
    unlike = written(unlike, folder, "unlike")  # ids whose rows have several sets
    repeated = not unlike.isEmpty()
    if repeated:
        classes_of = signed.where("n > 0").join(unlike, "id", "left_semi").join(reps, ["n", "low", "high"]).select("id", "rep").distinct()
        classes_of = written(classes_of, folder, "classes_of")
        first_of = classes_of.groupBy("id").agg(F.min("rep").alias("first"))
        links = links.union(classes_of.join(first_of, "id").select(c("rep").alias("a"), c("first").alias("b")))
    reached = components(links, folder).select(c("node").alias("rep"), "component")
    of_class = reps.join(reached, "rep", "left")
    of_class = of_class.select(c("n").alias("n_"), c("low").alias("low_"), c("high").alias("high_"), "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.join(of_class, (c("n") == c("n_")) & (c("low") == c("low_")) & (c("high") == c("high_")), "left")
    alone, by_itself = (c("n") == 0) | c("id").isNull(), c("id")
    if repeated:  # an empty row of an id that has others goes with them
        of_id = first_of.join(reached, c("first") == c("rep"), "left").select(c("id").alias("id_"), id_of(F.coalesce("component", "first")).alias("of_id"))
        out, by_itself = out.join(of_id, c("id") == c("id_"), "left"), F.coalesce("of_id", "id")
    return out.select("id", c("n").cast("long").alias("n_shingles"), F.when(alone, c("id")).otherwise(id_of(c("rep"))).alias("class_id"), F.when(alone, by_itself).otherwise(id_of(c("component"))).alias("component_id"))
