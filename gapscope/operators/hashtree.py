"""Stored hash trees of ordered records: two versions are compared level by level, down to the records that differ."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .ledger import FANOUT, digest_leaves, digest_parents

#: Positions of one branch, and leaf folders over which the branches go in turn, however sparse positions are.
BRANCH, FOLDERS = FANOUT * FANOUT, 64


def branch_of(n: Column) -> Column:
    return F.pmod(F.floor(n / BRANCH), F.lit(FOLDERS))


def write_tree(records: DataFrame, position: str, content: Column, path: str, levels: int = 4) -> None:
    """Store the tree of ``batch_digest`` under ``path``, a folder for each level, the leaves in folders by branch.

    Every level is built from the one stored below it, so records are hashed once. An empty table gives a tree without nodes.
    """
    leaves = digest_leaves(records, position, content, levels).withColumn("branch", branch_of(F.col("n")))
    leaves.hint("rebalance", "branch").write.partitionBy("branch").parquet(f"{path}/level=0")
    for level in range(1, levels + 1):
        nodes = read_level(records.sparkSession, path, level - 1).select("n", "h")
        digest_parents(nodes).write.parquet(f"{path}/level={level}")


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    schema = "n long, h string" if level else "n long, h string, branch long"
    return spark.read.schema(schema).parquet(f"{path}/level={level}")


def tampered(spark: SparkSession, stored: str, found: str, levels: int = 4) -> DataFrame:
    """One row per record that differs between two stored trees: ``position, change, stored_hash, found_hash``.

    ``change`` is changed, removed or added. From the root on, only children of nodes that differ are compared; leaves of
    other branches are not read. Equal trees, two empty ones included, give no row.
    """
    parents = None
    for level in range(levels, -1, -1):
        sides = [read_level(spark, path, level) for path in (stored, found)]
        if parents is not None:
            parent = F.floor(F.col("n") / FANOUT) == F.col("parent")
            if level == 0:
                parent &= F.col("branch") == F.col("parent_branch")
            sides = [side.join(parents.filter("parent >= 0"), parent, "left_semi") for side in sides]
        before, after = (side.select("n", F.col("h").alias(name)) for side, name in zip(sides, ("stored_hash", "found_hash")))
        differing = before.join(after, "n", "full_outer").filter(~F.col("stored_hash").eqNullSafe(F.col("found_hash")))
        if level:
            above = parents
            parents = cut_lineage(differing.select(F.col("n").alias("parent"), branch_of(F.col("n") * FANOUT).alias("parent_branch")))
            if above is not None:
                discard(above)
    change = F.when(F.col("found_hash").isNull(), "removed").when(F.col("stored_hash").isNull(), "added").otherwise("changed")
    return differing.select(F.col("n").alias("position"), change.alias("change"), "stored_hash", "found_hash")
