"""Connected components of an edge table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: A key with more than this share of the rows is joined apart from the others, so there are fewer than 1 / HOT of them.
HOT = 1 / 1000


def join_hot(rows: DataFrame, each: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of each (one row for each key) but `count`, the number of rows of the key.

    Keys with more than HOT * total rows are so few that they are broadcast, so
    their rows stay where they are; all others meet in a shuffle.
    """
    limit = max(1, int(total * HOT))
    more = [c for c in each.columns if c not in (key, count)]
    named = each.select(F.col(key).alias("__key"), F.struct(*more).alias("__more"), F.col(count).alias("__n"))
    hot = rows.join(F.broadcast(named.filter(F.col("__n") > limit).select("__key", "__more")), F.col(key) == F.col("__key"), "left").drop("__key")
    done = hot.filter(F.col("__more").isNotNull())
    rest = hot.filter(F.col("__more").isNull()).drop("__more").join(named.filter(F.col("__n") <= limit).select("__key", "__more"), F.col(key) == F.col("__key")).drop("__key")
    return done.unionByName(rest).select(*rows.columns, "__more.*")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both.filter("v > u"), least, "u", "n", total).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    over = join_hot(down, least, "u", "n", total).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge; edges has u and v, root is the smallest node reachable.

    Each round is two joins on the edges that are left, cut from the lineage;
    the number of rounds grows with the logarithm of the longest path.  A node
    in the middle of very many edges is joined apart (`join_hot`).
    """
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _sum(now)
    while seen[0]:
        now = cut(_small_star(cut(_large_star(now, 2 * seen[0])), seen[0]))
        if (new := _sum(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
