"""Connected components of a link table, by minimum labels with pointer jumping; nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, class_id) of every node of links (a, b): class_id is the smallest node that it is connected with."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class_id")).withColumnRenamed("a", "node"), "labels")
    while True:
        # A node takes the least label of itself and its neighbours, then that label's own label.
        near = both.join(label.select(F.col("node").alias("b"), "class_id"), "b").groupBy("a").agg(F.min("class_id").alias("best"))
        low = stored(label.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("class_id").alias("old"), F.least("class_id", "best").alias("class_id")), "labels")
        jump = low.select(F.col("node").alias("root"), F.col("class_id").alias("root_label"))
        new = stored(low.join(jump, F.col("class_id") == F.col("root"), "left").select("node", "old", F.least("class_id", "root_label").alias("class_id")), "labels")
        label = new.select("node", "class_id")
        if new.where("old <> class_id").isEmpty():
            return label
