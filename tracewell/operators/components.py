"""Connected components of links in DataFrames, by alternating large and small stars.

Each round replaces a node's links by links to the least node that it sees; the number of rounds grows with the logarithm of the
longest chain.  Every round is written and nothing is collected.  Nodes of very many links (hubs) are joined where their links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.lineage import Written


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_hot(rows: DataFrame, values: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """A left join in which the rows of ``hot`` keys stay where they are; ``hot`` has few of the rows of ``values``."""
    columns = [c for c in values.columns if c != key]
    near = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    dealt = near.where("_hot is null").select(*rows.columns).join(values, key, "left")
    return near.where("_hot").select(*rows.columns, *columns).unionByName(dealt.select(*rows.columns, *columns))


def spread_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``values``, which has a row for each key at most; a key of very many rows isn't dealt to one task.

    Keys that have more rows than a partition's share are broadcast with their values: fewer than there are partitions, whatever the data.
    """
    parts = _parts(rows)
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    many = [r[0] for r in counted.where((F.col("_n") > total / parts) & (F.col("_n") > 100)).select(key).collect()]
    if not many:
        return rows.join(values, key, "left")
    kind = rows.schema[key].dataType
    hot = rows.sparkSession.range(1).select(F.explode(F.lit(many).cast(f"array<{kind.simpleString()}>")).alias(key))
    return _with_hot(rows, values, values.join(F.broadcast(hot), key, "left_semi"), key)


def _round(edges: DataFrame, hub: int | None) -> DataFrame:
    """One large and one small star over links from greater to lesser nodes (``u``, ``v``); ``hub`` is how many links make one, if there are any.

    Both joins use the partitions of the groupings; without the hints each would be sent around by itself.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    least = seen.select("u", F.least("u", "m").alias("m"))
    greater = both.where("v > u")
    met = greater.join(least.hint("merge"), "u") if hub is None else _with_hot(greater, least, seen.where(F.col("n") > hub).select("u", F.least("u", "m").alias("m")), "u")
    large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """How many links there are, the most that one lesser node has, and whether they are stars: no node is below one and above another, or below two."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    each = sides.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    n, most, other = each.agg(F.sum("up"), F.max(F.col("n") - F.col("up")), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
    return n or 0, most or 0, not other


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, its component's least node, of every linked node that isn't its own root."""
    at = Written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        total, most, stars = _state(at.df)
        if stars:
            break
        # Fewer hubs than partitions, since all of their links together are no more than there are.
        share = max(100, total // _parts(at.df))
        last, at = at, Written(_round(at.df, share if most > share else None))
        last.drop()
    return at.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
