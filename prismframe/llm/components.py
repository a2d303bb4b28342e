"""Connected components over links, with alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismframe.llm.common import free, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id that each linked id reaches.

    Each round replaces links by links to smaller neighbours (the large-star and small-star steps of
    Kiveris et al., "Connected Components in MapReduce and Beyond"), so the number of rounds grows with the logarithm of a
    component's size, links never multiply and no component is gathered in one task: the minimum of
    a neighbourhood is aggregated before the shuffle and joined back.  Ids without links are not returned.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # by now an id has few smaller neighbours, minima of others' neighbourhoods
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        old, edges = edges, materialize(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct(),
            "links",
        )
        if before is not None:
            free(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
