"""Connected components of a table of links, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node that can be reached; only nodes that have a link.

    ``links`` has long columns a and b, read in both directions. Labels are
    written to a scratch table after each round, which replaces the last one, so
    no plan grows with the number of rounds; a round takes the least label among the neighbours, then
    the label of that label. Nothing is collected but a count of changes.
    """
    both = scratch(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    held = labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = scratch(lower.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "labels")
        discard(held)
        held, labels = new, new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            discard(both)
            return labels
