"""Connected components of a table of links, by large-star and small-star rounds.

Each round re-links every node's neighbours to the least of them, first the larger ones
(large-star), then all but the larger (small-star), until the links are a forest of stars.
Links stay in Spark; each half of a round is cut off by a table in the shared folder, which is
removed when the next one is there, and reads that table twice: the driver's plans, stages and
broadcasts stay few, whatever the links. Of a hub's neighbours no list is made: groups only give
minima, combined before the shuffle, and the joins with these stream; where a hub's rows fill
a partition, Spark's adaptive skew join splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written


def _least(links: DataFrame) -> DataFrame:
    """(u, m): a node and its least neighbour, for nodes that have a smaller one."""
    return links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """links (a, b) with a > b; a node without a smaller neighbour is its own least."""
    met = links.join(_least(links), F.col("b") == F.col("u"), "left")
    return met.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links (a, b) with a > b; a node's link to its least neighbour stays, the others link that neighbour with the least."""
    met = links.join(_least(links), F.col("a") == F.col("u"))
    return met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link, and none is a smaller end."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(int(c == "a")).alias("larger")) for c in "ab"])
    nodes = links.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.larger").alias("links"), F.min("end.larger").alias("least"))
    # a node that is only a smaller end has no links; one that is both, or a larger end twice, is not a star's
    return not nodes.where("links > least").agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots; root is its component's least node.

    Links with a null end and loops are ignored; direction and repeats don't matter.
    """
    ends = links.where((F.col("a") != F.col("b")))
    now = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        if _are_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        for star in (_large_star, _small_star):
            last, now = now, written(star(now), "links")
            discard(last)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
