"""Connected components of a link table, by alternating large and small stars on Spark.

Each round hangs the neighbours of a node on the smallest of them. Links never leave the executors: the
driver only compares one checksum per round. A hub's links are reduced by ``min`` before any join, and the
joins are on the node, which Spark splits when one is hot. The number of rounds grows with the logarithm
of the longest path.
"""

from pyspark.sql import DataFrame, functions as F

from pairwise.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b. Large: hang larger neighbours on the smallest; small: the smaller ones and itself."""
    if large:
        both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(
            links.select(F.col("b").alias("n"), F.col("a").alias("m"))
        )
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("least"))
        hung = both.filter("m > n").join(least, "n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        joined = links.join(least, "a")
        hung = joined.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return hung.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes but the roots. Links: (a, b) bigint."""
    current = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    current = stage(current, "links")
    before = None
    while True:
        current = stage(_star(_star(current, large=True), large=False), "stars")
        after = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
