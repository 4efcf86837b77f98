"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import cut

MAX_ROUNDS = 60
SALTS = 8


def _least(star: DataFrame, low: DataFrame, node: str, other: str) -> DataFrame:
    """star(u, v) with the `least` neighbour of `node` where `low` has one, else v. A node can have very many neighbours,
    so its rows are dealt by the `other` end to SALTS parts in the join; minima are two longs a node."""
    parts = low.select(F.col("u").alias(node), "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = star.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return dealt.join(parts, [node, "salt"], "left").select("u", "v", F.coalesce("least", "v").alias("least"))


def _hang_larger(star: DataFrame) -> DataFrame:
    """Each node's larger neighbours under the smallest node that it sees."""
    low = star.groupBy("u").agg(F.min("v").alias("least"))
    return _least(star, low, "v", "u").select("u", F.col("least").alias("v"))


def _hang_smaller(star: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours under the smallest of them; only nodes with several need their minimum."""
    low = star.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).where("n > 1")
    ends = F.explode(F.array("u", "v"))
    return _least(star, low, "u", "v").select(ends.alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _settled(star: DataFrame) -> bool:
    """Whether every node hangs under one node only, and that one under none."""
    end = lambda node, up, low: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(low).alias("low"))
    ends = star.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up > 0 and low > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that occurs in `edges`; a component is named by its smallest node.

    Alternating star contraction: each round hangs every node's larger neighbours, then its smaller ones, under the
    smallest node in sight, so the number of rounds grows with the logarithm of the longest path. Minima are
    pre-aggregated before the shuffle, and the neighbours of one node are dealt to several tasks.
    Edges with a null end and loops only contribute their nodes; nulls vanish.
    """
    own = cut(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")))
    nodes = own.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    star = cut(own.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        star = cut(_hang_smaller(_hang_larger(star)))
        if _settled(star):
            break
    else:
        raise RuntimeError("connected_components did not settle")
    return nodes.join(star, nodes.node == star.u, "left").select("node", F.coalesce("v", "node").alias("component"))
